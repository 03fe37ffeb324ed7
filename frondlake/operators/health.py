"""Health score and training readiness of a collection, from one-row summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text
from .balance import class_imbalance
from .rows import merge_single_rows


def health_score(quality: DataFrame, duplicates: DataFrame, distribution: DataFrame) -> DataFrame:
    """One row: ``score`` 0-100, ``status`` band and the list of penalty ``notes``.

    ``quality`` comes from ``quality_summary``, ``duplicates`` from
    ``duplicate_report`` and ``distribution`` from ``class_distribution``.
    """
    merged = merge_single_rows(
        quality.select("total_records", "corrupt", "small", "severely_undersized", "extreme_aspect"),
        duplicates.select("exact_duplicate_files", "exact_cross_class_groups",
                          "visual_cross_class_groups"),
        class_imbalance(distribution).select("max_to_min"),
    )
    total = F.greatest(F.lit(1), F.col("total_records"))

    def rate(column: str) -> Column:
        return F.col(column) / total

    def capped(points: Column) -> Column:
        return F.least(F.lit(15), points).cast("int")

    none = F.lit(0)
    # Penalties, thresholds and notes.
    penalties: list[tuple[str, Column, str]] = [
        ("corrupt", capped(F.ceil(rate("corrupt") * 100)), "corrupt-image penalty"),
        ("exact", capped(F.ceil(rate("exact_duplicate_files") * 50)), "exact-duplicate penalty"),
        ("exact_cross", capped(F.col("exact_cross_class_groups") * 3),
         "exact cross-class-duplicate penalty"),
        ("visual_cross", capped(F.col("visual_cross_class_groups") * 2),
         "visual cross-class-duplicate penalty"),
        ("very_small", F.when(rate("small") > 0.10, 8).otherwise(none),
         "low-resolution penalty (>10% below 300px)"),
        ("small", F.when((rate("small") > 0.03) & ~(rate("small") > 0.10), 4).otherwise(none),
         "low-resolution penalty (>3% below 300px)"),
        ("severe", F.when(rate("severely_undersized") > 0.02, 5).otherwise(none),
         "severely-undersized penalty (>2% below 150px)"),
        ("aspect", F.when(rate("extreme_aspect") > 0.10, 5).otherwise(none),
         "aspect-ratio penalty"),
        ("imbalance_20", F.when(F.col("max_to_min") > 20, 10).otherwise(none),
         "severe class-imbalance penalty"),
        ("imbalance", F.when(F.col("max_to_min") > 20, 0).when(F.col("max_to_min") > 10, 6)
         .when(F.col("max_to_min") > 5, 3).otherwise(none), "class-imbalance penalty"),
    ]
    scored = merged.withColumns({f"_{name}": points for name, points, _ in penalties})
    lost = sum((F.col(f"_{name}") for name, _, _ in penalties), F.lit(0))
    notes = F.array_compact(F.array(*[
        F.when(F.col(f"_{name}") > 0,
               F.concat(F.lit("-"), F.col(f"_{name}").cast("string"), F.lit(f" {note}")))
        for name, _, note in penalties
    ]))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.lit(100) - lost))
    return scored.select(
        score.cast("int").alias("score"), text.score_band(score).alias("status"), notes.alias("notes")
    )


def readiness_report(quality: DataFrame, distribution: DataFrame, *,
                     minimum: int = C.MIN_PER_CLASS, ideal: int = C.IDEAL_PER_CLASS) -> DataFrame:
    """One row: how many images and classes are fit for training at the model's input size.

    An empty collection counts as one image of ideal size.
    """
    n = F.col("images")

    def below(limit: int) -> Column:
        return F.array_sort(F.collect_list(F.when((n > 0) & (n < limit), F.col("class_id"))))

    merged = merge_single_rows(
        quality.select("valid", "small", "below_ideal_resolution", "severely_undersized"),
        distribution.agg(below(minimum).alias("classes_below_minimum"),
                         below(ideal).alias("classes_below_ideal")),
        class_imbalance(distribution).select(F.col("max").alias("_max"), F.col("min").alias("_min")),
    )
    total = F.greatest(F.lit(1), F.col("valid"))
    fit = total - F.col("below_ideal_resolution")
    return merged.select(
        fit.alias("at_or_above_ideal"),
        text.percent_text(fit, total).alias("at_or_above_ideal_pct"),
        F.col("small").alias("below_target"),
        text.percent_text(F.col("small"), total).alias("below_target_pct"),
        F.col("severely_undersized"),
        text.percent_text(F.col("severely_undersized"), total).alias("severely_undersized_pct"),
        "classes_below_minimum", "classes_below_ideal",
        text.ratio_text(F.col("_max"), F.col("_min")).alias("imbalance_ratio"),
    )
