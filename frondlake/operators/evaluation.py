"""Classification metrics from (target, predicted) rows keyed by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .. import constants as C
from ..functions import text, vectors


def _all() -> WindowSpec:
    """One frame over a class-sized table."""
    return Window.partitionBy()


def confusion_counts(rows: DataFrame, target: str = "target", predicted: str = "predicted") -> DataFrame:
    """Non-zero cells. The fact table is read once; all metrics derive from these counts."""
    return rows.groupBy(
        F.col(target).cast("int").alias("target"), F.col(predicted).cast("int").alias("predicted")
    ).agg(F.count(F.lit(1)).alias("images"))


def confusion_matrix(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Long matrix over all catalog classes with zero cells kept.

    Counts of a class outside the catalog are an error when evaluated.
    """
    lowest, highest = catalog.agg(F.min("index")).scalar(), catalog.agg(F.max("index")).scalar()
    inside = F.col("target").between(lowest, highest) & F.col("predicted").between(lowest, highest)
    counts = counts.withColumn("images", F.when(F.coalesce(inside, F.lit(False)), F.col("images")).otherwise(
        F.raise_error(F.lit("a counted class is not in the catalog"))))
    listed = catalog.select("index", F.collect_list("index").over(_all()).alias("_every"))
    grid = listed.select(F.col("index").alias("target"), F.explode("_every").alias("predicted"))
    return grid.join(counts, ["target", "predicted"], "left").select(
        "target", "predicted", F.coalesce("images", F.lit(0)).alias("images")
    )


def normalize_rows(matrix: DataFrame) -> DataFrame:
    """Add each cell's share of its target row; empty rows stay 0."""
    total = F.sum("images").over(Window.partitionBy("target"))
    return matrix.withColumn("share", F.coalesce(F.try_divide(F.col("images"), total), F.lit(0.0)))


def wide_matrix(matrix: DataFrame, catalog: DataFrame, names: list[str]) -> DataFrame:
    """Matrix as a report table: one row per actual class, one column per name in ``names``.

    ``names`` are the display names in class order.
    """
    labels = catalog.select(F.col("index").alias("predicted"), F.col("display_name").alias("_name"))
    actual = catalog.select(F.col("index").alias("target"), F.col("display_name").alias("actual/predicted"))
    return (
        matrix.join(labels, "predicted").groupBy("target").pivot("_name", names).sum("images")
        .join(actual, "target").orderBy("target")
        .select("`actual/predicted`", *[F.col(f"`{n}`") for n in names])
    )


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def class_scores(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1, support and predicted count of every class that occurs."""
    sides = counts.select(
        F.explode(F.array(
            F.struct(F.col("target").alias("class_index"), F.col("images").alias("support"),
                     F.lit(0).cast("bigint").alias("predicted_count"),
                     F.when(F.col("target") == F.col("predicted"), F.col("images"))
                     .otherwise(F.lit(0)).cast("bigint").alias("hits")),
            F.struct(F.col("predicted").alias("class_index"), F.lit(0).cast("bigint").alias("support"),
                     F.col("images").alias("predicted_count"),
                     F.lit(0).cast("bigint").alias("hits")),
        )).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class_index").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted_count", "hits")]
    )
    return sums.withColumns({
        "precision": _ratio(F.col("hits"), F.col("predicted_count")),
        "recall": _ratio(F.col("hits"), F.col("support")),
        "f1": _ratio(2.0 * F.col("hits"), F.col("predicted_count") + F.col("support")),
    })


def classification_report(counts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Per-class rows for every catalog class, then accuracy, macro and weighted averages.

    Undefined ratios are 0. The accuracy row carries it in ``f1`` only.
    """
    measures = ("precision", "recall", "f1")
    names = catalog.select(F.col("index").alias("class_index"), "display_name")
    per_class = names.join(class_scores(counts), "class_index", "left").select(
        F.col("display_name").alias("label"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in measures],
        F.coalesce("support", F.lit(0)).alias("support"),
        F.coalesce("hits", F.lit(0)).alias("_hits"),
    )
    support = F.sum("support")
    macro = per_class.agg(
        F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in measures],
        support.alias("support"))
    weighted = per_class.agg(
        F.lit("weighted avg").alias("label"),
        *[_ratio(F.sum(F.col(c) * F.col("support")), support).alias(c) for c in measures],
        support.alias("support"))
    nothing = F.lit(None).cast("double")
    accuracy = per_class.agg(
        F.lit("accuracy").alias("label"), nothing.alias("precision"), nothing.alias("recall"),
        _ratio(F.sum("_hits"), support).alias("f1"), support.alias("support"))
    return per_class.drop("_hits").unionByName(accuracy).unionByName(macro).unionByName(weighted)


def eval_metrics(counts: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted F1, balanced accuracy.

    Macro F1 averages the classes that occur as target or prediction; balanced
    accuracy averages recall over the classes that occur as target.
    """
    s = class_scores(counts)
    return s.agg(
        _ratio(F.sum("hits"), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        _ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum("support").alias("images"),
    )


def prediction_detail(samples: DataFrame, predictions: DataFrame, catalog: DataFrame,
                      key: str = "image") -> DataFrame:
    """Actual and predicted class of every sample, paired by key and never by position.

    ``samples`` has the key and ``target``; ``predictions`` the key, ``predicted``
    and ``confidence``. :func:`named_predictions` needs no join when one table
    holds both.
    """
    found = predictions.select(key, "predicted", "confidence", F.lit(True).alias("_found"))
    lonely = F.concat(F.lit("sample without a prediction: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    paired = samples.select(key, "target").join(found, key, "left").withColumn(
        "predicted", F.when(F.col("_found").isNull(), F.raise_error(lonely)).otherwise(F.col("predicted")))
    return named_predictions(paired, catalog, key)


def named_predictions(rows: DataFrame, catalog: DataFrame, key: str = "image") -> DataFrame:
    """Class ids and names of rows ``(key, target, predicted, confidence)``.

    A class outside the catalog is an error when evaluated; no row is lost.
    """
    names = catalog.select("index", F.col("id"), "display_name")
    actual = names.select(F.col("index").alias("target"), F.col("id").alias("actual_class_id"),
                          F.col("display_name").alias("actual_name"))
    guessed = names.select(F.col("index").alias("predicted"), F.col("id").alias("predicted_class_id"),
                           F.col("display_name").alias("predicted_name"))
    return (
        rows.select(key, F.col("target").cast("int").alias("target"), "predicted", "confidence")
        .join(actual, "target", "left").join(guessed, "predicted", "left")
        .select(key, _known("actual_class_id", "target"), "actual_name",
                _known("predicted_class_id", "predicted"), "predicted_name",
                text.rounded(F.col("confidence"), 7).alias("confidence"),
                (F.col("target") == F.col("predicted")).alias("correct"))
    )


def _known(found: str, index: str) -> Column:
    message = F.concat(F.lit("no class with index "), F.coalesce(F.col(index).cast("string"), F.lit("NULL")))
    return F.when(F.col(found).isNull(), F.raise_error(message)).otherwise(F.col(found)).alias(found)


def batch_losses(rows: DataFrame, weights: DataFrame, *, logits_col: str = "logits",
                 target: str = "target", batch_col: str = "batch",
                 smoothing: float = C.LABEL_SMOOTHING) -> DataFrame:
    """Class-weighted, label-smoothed cross entropy of each batch.

    ``weights`` has ``class_index`` and ``weight`` of every logit. It becomes one
    array with an entry per class, passed on as the result of a scalar subquery.
    """
    vector = weights.agg(F.transform(
        F.array_sort(F.collect_list(F.struct("class_index", "weight"))), lambda s: s["weight"]
    ).alias("_w")).scalar()
    return rows.withColumn("_w", vector).select(
        F.col(batch_col).alias("batch"),
        vectors.smoothed_cross_entropy(F.col(logits_col), F.col(target), F.col("_w"), smoothing).alias("_loss"),
        F.get(F.col("_w"), F.col(target)).alias("_weight"),
        (vectors.argmax(F.col(logits_col)) == F.col(target)).alias("_hit"),
    ).groupBy("batch").agg(
        (F.sum("_loss") / F.sum("_weight")).alias("loss"),
        F.count(F.lit(1)).alias("images"),
        F.count_if("_hit").alias("correct"),
    )


def mean_loss(losses: DataFrame) -> DataFrame:
    """One row: batch losses averaged by batch size, and the share of correct images."""
    return losses.agg(
        (F.sum(F.col("loss") * F.col("images")) / F.sum("images")).alias("loss"),
        _ratio(F.sum("correct"), F.sum("images")).alias("accuracy"),
        F.sum("images").alias("images"),
    )
