"""Class distribution, completeness, imbalance and class weights.

Everything after :func:`class_counts` works on at most one row per class id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from .. import constants as C
from ..functions import text


def _all() -> WindowSpec:
    """One frame over a class-sized table."""
    return Window.partitionBy()


def class_counts(files: DataFrame, class_col: str = "class_id") -> DataFrame:
    return files.groupBy(F.col(class_col).alias("class_id")).agg(F.count(F.lit(1)).alias("images"))


def label_names(rows: DataFrame, catalog: DataFrame, class_col: str = "class_id") -> DataFrame:
    """Add ``display_name``; ids outside the catalog become ``Unknown Class <id>``."""
    names = catalog.select(F.col("id").alias(class_col), F.col("display_name").alias("_label"))
    return (
        rows.join(names, class_col, "left")
        .withColumn("display_name", F.coalesce(
            "_label", F.concat(F.lit("Unknown Class "), F.col(class_col).cast("string"))))
        .drop("_label")
    )


def class_distribution(catalog: DataFrame, files: DataFrame, class_col: str = "class_id") -> DataFrame:
    """Images per class: empty catalog classes stay with 0, unknown ids get a row."""
    expected = catalog.select(F.col("id").alias("class_id"), "display_name", F.lit(True).alias("expected"))
    return (
        expected.join(class_counts(files, class_col), "class_id", "full_outer")
        .select(
            "class_id",
            F.coalesce("display_name", F.concat(
                F.lit("Unknown Class "), F.col("class_id").cast("string"))).alias("display_name"),
            F.coalesce("expected", F.lit(False)).alias("expected"),
            F.coalesce("images", F.lit(0)).cast("bigint").alias("images"),
        )
    )


def distribution_totals(distribution: DataFrame) -> DataFrame:
    """One row: total, smallest and largest non-empty class, and their ratio (or NULL)."""
    filled = F.when(F.col("images") > 0, F.col("images"))
    return distribution.agg(
        F.coalesce(F.sum("images"), F.lit(0)).alias("total"),
        F.coalesce(F.min(filled), F.lit(0)).alias("minimum"),
        F.coalesce(F.max(filled), F.lit(0)).alias("maximum"),
        (F.max(filled) / F.min(filled)).alias("ratio"),
    )


def class_imbalance(distribution: DataFrame) -> DataFrame:
    """One row over non-empty classes; the id lists are strict comparisons with the median."""
    filled = distribution.where("images > 0").withColumn(
        "_median", F.median("images").over(_all())
    )
    n, median = F.col("images"), F.col("_median")

    def ids(test):
        return F.array_sort(F.collect_list(F.when(test, F.col("class_id"))))

    return filled.agg(
        F.coalesce(F.max(median), F.lit(0.0)).alias("median"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max(n), F.lit(0)).alias("max"),
        F.coalesce(F.min(n), F.lit(0)).alias("min"),
        (F.max(n) / F.min(n)).alias("max_to_min"),
        ids(n < median * 0.25).alias("classes_below_25pct_median"),
        ids(n < median * 0.50).alias("classes_below_50pct_median"),
        ids(n > median * 2).alias("classes_above_2x_median"),
    )


def class_completeness(distribution: DataFrame) -> DataFrame:
    """One row: how many catalog classes have images, which are empty, which ids are unexpected."""
    def ids(test):
        return F.array_sort(F.collect_list(F.when(test, F.col("class_id"))))

    return distribution.agg(
        F.count_if("expected").alias("expected_classes"),
        F.count_if(F.col("expected") & (F.col("images") > 0)).alias("classes_with_images"),
        ids(F.col("expected") & (F.col("images") == 0)).alias("empty_classes"),
        ids(~F.col("expected")).alias("unexpected_class_ids"),
    )


def balanced_weights(distribution: DataFrame, digits: int = 4) -> DataFrame:
    """``N / (K * n)`` of every non-empty class."""
    weight = F.sum("images").over(_all()) / (F.count(F.lit(1)).over(_all()) * F.col("images"))
    return distribution.where("images > 0").select(
        "class_id", "images", text.rounded(weight, digits).alias("weight")
    )


def effective_number_weights(catalog: DataFrame, samples: DataFrame, *,
                             class_col: str = "class_index", beta: float = C.BALANCE_BETA) -> DataFrame:
    """``(1 - beta) / (1 - beta ** n)`` scaled to sum up to the class count.

    A class without samples fails the query when it runs.
    """
    counts = samples.groupBy(F.col(class_col).cast("int").alias("class_index")).agg(
        F.count(F.lit(1)).alias("images")
    )
    every = catalog.select(F.col("index").alias("class_index")).join(counts, "class_index", "left")
    checked = F.when(
        F.col("images").isNull(),
        F.raise_error(F.concat(F.lit("class without samples: "), F.col("class_index").cast("string"))),
    ).otherwise(F.col("images"))
    raw = every.withColumn("images", checked.cast("bigint")).withColumn(
        "_raw", (1.0 - beta) / (1.0 - F.pow(F.lit(beta), F.col("images")))
    )
    return raw.select(
        "class_index", "images",
        (F.col("_raw") / F.sum("_raw").over(_all()) * F.count(F.lit(1)).over(_all())).alias("weight"),
    )
