"""Batch scoring and ranked predictions."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..functions import vectors


def score_batches(rows: DataFrame, make_predictor: Callable[[], Callable], features_col: str, *,
                  feature_shape: Sequence[int], into: str = "logits", batch_size: int = 256,
                  time_into: str | None = None) -> DataFrame:
    """Add the logits of every row.

    ``make_predictor`` is called once per Python worker and returns a function
    from an array ``(rows, *feature_shape)`` to an array ``(rows, classes)``.
    ``time_into`` names a column for the milliseconds of the model per row: the
    time of its batch, shared equally.
    """
    if time_into:
        timed = predict_batch_udf(
            lambda: _clocked(make_predictor()), batch_size=batch_size, input_tensor_shapes=[list(feature_shape)],
            return_type=T.StructType([T.StructField("logits", T.ArrayType(T.DoubleType())), T.StructField("ms", T.DoubleType())]))
        scored = rows.select("*", timed(F.col(features_col)).alias(_SCORED))
        return scored.withColumns({
            into: F.col(f"{_SCORED}.logits"), time_into: F.col(f"{_SCORED}.ms")}).drop(_SCORED)
    score = predict_batch_udf(
        make_predictor, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size,
        input_tensor_shapes=[list(feature_shape)],
    )
    return rows.withColumn(into, score(F.col(features_col)))


_SCORED = "__scored"


def _clocked(predict: Callable) -> Callable:
    def run(batch: np.ndarray) -> dict[str, np.ndarray]:
        started = time.perf_counter()
        logits = np.asarray(predict(batch))
        return {"logits": logits, "ms": np.full(len(batch), (time.perf_counter() - started) * 1000 / len(batch))}

    return run


def predicted_class(rows: DataFrame, logits_col: str = "logits") -> DataFrame:
    """Add ``predicted`` (first class on ties) and its probability ``confidence``."""
    probabilities = vectors.softmax(F.col(logits_col))
    return rows.withColumn("_p", probabilities).withColumns({
        "predicted": vectors.argmax(F.col("_p")),
        "confidence": F.array_max("_p"),
    }).drop("_p")


def rank_predictions(rows: DataFrame, catalog: DataFrame, *, id_col: str = "image",
                     logits_col: str = "logits", top_k: int = C.TOP_K, carry: Sequence[str] = ()) -> DataFrame:
    """One row per image and rank with the class's attributes and the image's ``carry`` columns. No shuffle of the images.

    A ranked class outside the catalog (more logits than classes) is an error when evaluated.
    """
    ranked = rows.select(
        id_col, *carry, F.explode(vectors.top_k(vectors.softmax(F.col(logits_col)), top_k)).alias("p")
    ).select(id_col, *carry, "p.*")
    classes = catalog.select(
        F.col("id").alias("class_id"), F.col("index").alias("class_index"),
        F.col("key").alias("class_key"), "display_name", "crop", "disease",
    )
    unknown = F.concat(F.lit("no class with index "), F.col("class_index").cast("string"))
    class_id = F.when(F.col("class_id").isNull(), F.raise_error(unknown)).otherwise(F.col("class_id"))
    return ranked.join(classes, "class_index", "left").select(
        id_col, "rank", class_id.alias("class_id"), "class_index", "class_key", "display_name", "crop", "disease",
        "confidence", (F.col("confidence") * 100).alias("confidence_percent"), *carry,
    )


def nest_predictions(ranked: DataFrame, id_col: str = "image", carry: Sequence[str] = ()) -> DataFrame:
    """One row per image with its ``carry`` columns and its predictions in rank order (at most ``top_k`` each)."""
    fields = [c for c in ranked.columns if c not in (id_col, "rank", *carry)]
    return ranked.groupBy(id_col).agg(
        *[F.first(c).alias(c) for c in carry],
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("predictions")
    )


def flag_uncertain(rows: DataFrame, minimum: float = C.LOW_CONFIDENCE) -> DataFrame:
    return rows.withColumns({
        "confidence_percent": F.col("confidence") * 100,
        "uncertain": F.col("confidence") < minimum,
    })
