"""Epoch selection, artifact choice, batches and the linear head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from .ordering import rank_by_digest, shuffle_key


def epoch_progress(history: DataFrame, *, score_col: str = "val_macro_f1", epoch_col: str = "epoch",
                   patience: int = C.PATIENCE, run_col: str | None = None) -> DataFrame:
    """Mark each epoch of a training history.

    ``improved`` is a strict improvement on every earlier epoch, ``stale`` the
    epochs since then, and ``ran`` whether training was still going, i.e. no
    earlier epoch reached ``patience``. The windows hold one run's epochs.
    """
    run = Window.partitionBy(*([run_col] if run_col else [])).orderBy(epoch_col)
    earlier = run.rowsBetween(Window.unboundedPreceding, -1)
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best_before = F.max(score_col).over(earlier)
    marked = history.withColumns({
        "_at": F.row_number().over(run),
        "improved": best_before.isNull() | (F.col(score_col) > best_before),
    })
    marked = marked.withColumn(
        "stale", F.col("_at") - F.max(F.when(F.col("improved"), F.col("_at"))).over(so_far)
    )
    stopped = F.coalesce(F.max(F.col("stale") >= patience).over(earlier), F.lit(False))
    return marked.withColumn("ran", ~stopped).drop("_at")


def early_stop(history: DataFrame, **options) -> DataFrame:
    """The epochs that are run: up to and including the one that reaches ``patience``."""
    return epoch_progress(history, **options).where("ran").drop("ran")


def best_epoch(history: DataFrame, *, score_col: str = "val_macro_f1", epoch_col: str = "epoch",
               patience: int = C.PATIENCE, run_col: str | None = None) -> DataFrame:
    """One row per run: the best epoch before stopping, its score, and the epochs completed."""
    ran = early_stop(history, score_col=score_col, epoch_col=epoch_col, patience=patience, run_col=run_col)
    improved_at = F.when(F.col("improved"), F.col(epoch_col))
    results = [
        F.max(improved_at).alias("best_epoch"),
        F.max_by(score_col, improved_at).alias("best_score"),
        F.count(F.lit(1)).alias("epochs_completed"),
        (F.max("stale") >= patience).alias("stopped_early"),
    ]
    return ran.groupBy(run_col).agg(*results) if run_col else ran.agg(*results)


def artifact_priority(name: Column) -> Column:
    """2 for names containing ``best``, 1 for ``final``, else 0."""
    lowered = F.lower(name)
    return F.when(F.contains(lowered, F.lit("best")), 2).when(
        F.contains(lowered, F.lit("final")), 1).otherwise(0)


def latest_artifact(artifacts: DataFrame, *, name_col: str = "path", time_col: str = "mtime") -> DataFrame:
    """One row: the newest artifact of the best available kind (best, then final, then others)."""
    row = F.struct(*artifacts.columns)
    choice = F.struct(artifact_priority(F.col(name_col)), F.col(time_col), F.col(name_col))
    return artifacts.agg(F.max_by(row, choice).alias("a")).where("a IS NOT NULL").select("a.*")


def epoch_batches(samples: DataFrame, *, id_col: str, seed: int, epoch: int = 0,
                  batch_size: int = 32, shuffle: bool = True, digits: int = 4) -> DataFrame:
    """Assign every sample a place in a seeded permutation and a fixed-size batch.

    The same seed and epoch give the same batches on any cluster; all but the
    last batch are full. ``id_col`` must be unique. Without ``shuffle`` the
    order is that of epoch 0, so it does not change from epoch to epoch.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    keyed = samples.withColumn("_digest", shuffle_key(F.col(id_col), seed, epoch if shuffle else 0))
    ranked = rank_by_digest(keyed, "_digest", "place", digits)
    return ranked.withColumn(
        "batch", F.floor((F.col("place") - 1) / batch_size).cast("bigint")
    ).drop("_digest")


def fit_linear_head(samples: DataFrame, weights: DataFrame, *, features_col: str = "features",
                    label_col: str = "target", max_iter: int = 30, regularization: float = 1e-4):
    """Fit a class-weighted multinomial linear classifier on frozen features (runs jobs).

    ``features_col`` is an array column; ``weights`` has ``class_index`` and
    ``weight``. Returns the fitted model, whose input columns are
    ``_features``; use :func:`linear_head_input` before transforming.
    """
    from pyspark.ml.classification import LogisticRegression

    vector = weights.agg(F.map_from_entries(F.collect_list(F.struct(F.col("class_index").cast("int"), "weight")))).scalar()
    missing = F.concat(F.lit("no weight for class "), F.coalesce(F.col(label_col).cast("string"), F.lit("NULL")))
    prepared = linear_head_input(samples, features_col).withColumn("_w", vector).withColumn(
        "_weight", F.coalesce(F.try_element_at("_w", F.col(label_col).cast("int")), F.raise_error(missing).cast("double"))
    ).drop("_w").withColumn("_label", F.col(label_col).cast("double"))
    return LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", family="multinomial",
        maxIter=max_iter, regParam=regularization,
    ).fit(prepared)


def linear_head_input(samples: DataFrame, features_col: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return samples.withColumn("_features", array_to_vector(F.col(features_col).cast("array<double>")))
