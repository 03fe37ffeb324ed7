"""Image inspection flags, per-class profile, global summary, examples, histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import flags
from .ordering import exact_percentiles
from .rows import merge_single_rows

# Summary column -> flag column of an inspected image.
FLAGS = {
    "small": "small",
    "below_ideal_resolution": "below_ideal_resolution",
    "severely_undersized": "severely_undersized",
    "extreme_aspect": "extreme_aspect",
    "grayscale": "grayscale",
    "alpha": "has_alpha",
    "tiny_files": "tiny_file",
    "large_files": "large_file",
}


def with_quality(records: DataFrame, *, width: str = "width", height: str = "height",
                 file_size: str = "file_size", mode: str = "mode",
                 transparent_palette: Column | None = None) -> DataFrame:
    """Add pixel count, aspect ratio and every quality flag to raw inspection columns."""
    w, h = F.col(width), F.col(height)
    ratio = flags.aspect_ratio(w, h)
    return records.withColumns({
        "pixels": w.cast("bigint") * h.cast("bigint"),
        "aspect_ratio": ratio,
        **flags.resolution_flags(w, h),
        "extreme_aspect": flags.extreme_aspect(ratio),
        **flags.size_flags(F.col(file_size)),
        **flags.mode_flags(F.col(mode), transparent_palette),
    })


def _only_valid(column: str) -> Column:
    return F.when(F.col("valid"), F.col(column))


def _flag_counts() -> list[Column]:
    return [F.count_if(F.col("valid") & F.col(flag)).alias(name) for name, flag in FLAGS.items()]


def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def class_quality_profile(records: DataFrame, class_col: str = "class_id") -> DataFrame:
    """One row per class: counts, flags, and size statistics of its valid images."""
    spread = ("width", "height", "pixels", "file_size")
    base = records.groupBy(class_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("corrupt"),
        *_flag_counts(),
        *[agg(_only_valid(c)).alias(f"{c}_{name}") for c in spread
          for name, agg in (("min", F.min), ("mean", F.avg), ("max", F.max))],
    )
    valid = records.where("valid")
    medians = exact_percentiles(
        valid, [class_col],
        {"width": F.col("width"), "height": F.col("height"),
         "pixels": F.col("pixels"), "file_size": F.col("file_size")},
        {"p10": 0.10, "median": 0.50, "p90": 0.90},
    )
    sides = [f"{c}_{s}" for c in ("width", "height")
             for s in ("min", "median", "mean", "p10", "p90", "max")]
    sizes = [f"{c}_{s}" for c in ("pixels", "file_size") for s in ("min", "median", "mean", "max")]
    medians = medians.withColumnRenamed(class_col, "_class")
    return base.join(medians, F.col(class_col).eqNullSafe(F.col("_class")), "left").select(
        class_col, "total", "valid", "corrupt", *FLAGS,
        *[_zero(F.col(c)).alias(c) for c in sides + sizes],
    )


def quality_summary(records: DataFrame) -> DataFrame:
    """One row over all records. Zero dimensions and ratios are left out of the statistics."""
    def known(column: str) -> Column:
        return F.when(F.col("valid") & (F.col(column) != 0), F.col(column))

    both = F.col("valid") & (F.col("width") != 0) & (F.col("height") != 0)
    width, height = F.when(both, F.col("width")), F.when(both, F.col("height"))
    counts = records.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("corrupt"),
        *_flag_counts(),
        _zero(F.min(width)).alias("min_width"),
        _zero(F.min(height)).alias("min_height"),
        _zero(F.min(known("pixels"))).alias("min_pixels"),
        _zero(F.min(known("aspect_ratio"))).alias("min_aspect_ratio"),
        _zero(F.max(known("aspect_ratio"))).alias("max_aspect_ratio"),
        _zero(F.sum(_only_valid("file_size"))).alias("total_bytes"),
        _zero(F.avg(_only_valid("file_size"))).alias("mean_bytes"),
        _zero(F.max(_only_valid("file_size"))).alias("maximum_bytes"),
    )
    medians = exact_percentiles(
        records, [],
        {"width": width, "height": height,
         "pixels": known("pixels"),
         "aspect_ratio": known("aspect_ratio"),
         "bytes": _only_valid("file_size")},
        {"median": 0.50},
    )
    names = ("width", "height", "pixels", "aspect_ratio", "bytes")
    return merge_single_rows(counts, medians).select(
        *counts.columns,
        *[_zero(F.col(f"{n}_median")).alias(f"median_{n}") for n in names],
    )


def histogram(records: DataFrame, column: str, class_col: str | None = None) -> DataFrame:
    """Valid images per format or mode, per class or overall (order by ``images`` to print)."""
    keys = [column] if class_col is None else [class_col, column]
    return records.where("valid").groupBy(*keys).agg(F.count(F.lit(1)).alias("images"))


def defect_examples(records: DataFrame, count: int = C.EXAMPLE_COUNT,
                    order_by: Sequence[str] = ("class_id", "relative_path")) -> DataFrame:
    """The first ``count`` images of every defect in a fixed order.

    Spark limits each partition to ``count`` rows per defect before the
    shuffle, so a frequent defect does not travel.
    """
    defects = {
        "corrupt": ~F.col("valid"),
        "small": F.col("valid") & F.col("small"),
        "severely_undersized": F.col("valid") & F.col("severely_undersized"),
        "extreme_aspect": F.col("valid") & F.col("extreme_aspect"),
        "tiny_file": F.col("valid") & F.col("tiny_file"),
    }
    rows = records.select(
        *order_by,
        F.explode(F.array_compact(F.array(*[
            F.when(test, F.lit(name)) for name, test in defects.items()
        ]))).alias("defect"),
    )
    window = Window.partitionBy("defect").orderBy(*order_by)
    return rows.withColumn("example", F.row_number().over(window)).where(F.col("example") <= count)
