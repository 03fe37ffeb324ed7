"""Manifest validation and summary jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity
from ..operators.rows import merge_single_rows


def dataset_violations(catalog: DataFrame, manifest: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Every problem of a catalog and its manifest as ``(stage, code, subject)`` rows.

    Stages follow the order in which a sequential check would meet them.
    """
    catalog_rows = integrity.catalog_violations(catalog).select(
        F.lit(0).alias("stage"), F.col("rule").alias("code"), F.col("class_key").alias("subject"))
    manifest_rows = integrity.manifest_violations(manifest, catalog, files).select(
        "stage", "code", F.col("relative_path").alias("subject"))
    leaking = integrity.family_leakage(manifest).select(
        F.lit(4).alias("stage"), F.lit("family_leakage").alias("code"),
        F.concat_ws("/", F.col("class_id").cast("string"), "family_id").alias("subject"))
    coverage = integrity.split_coverage(catalog, manifest).select(
        F.when(F.col("rule") == "empty_split", 3).otherwise(5).alias("stage"),
        F.col("rule").alias("code"), F.concat_ws("/", "class_key", "split").alias("subject"))
    found = catalog_rows.unionByName(manifest_rows).unionByName(leaking).unionByName(coverage)
    if files is None:
        return found
    bare = integrity.classes_without_files(catalog, files).select(
        F.lit(0).alias("stage"), F.lit("class_without_files").alias("code"), F.col("key").alias("subject"))
    return found.unionByName(bare)


def dataset_summary(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: class, image and family counts, per split and per class."""
    splits = integrity.split_counts(manifest)
    matrix = integrity.class_split_matrix(catalog, manifest)
    per_class = integrity.family_counts(catalog, manifest)
    families = integrity.families(manifest)

    def entries(frame: DataFrame, key: str, value, name: str) -> DataFrame:
        return frame.agg(F.map_from_entries(F.array_sort(F.collect_list(
            F.struct(F.col(key).alias("k"), value.alias("v"))))).alias(name))

    return merge_single_rows(
        catalog.agg(F.count(F.lit(1)).alias("class_count")),
        splits.agg(F.sum("images").alias("image_count")),
        families.agg(F.count(F.lit(1)).alias("family_count"),
                     F.count_if(F.bit_count("split_bits") > 1).alias("family_leakage_count")),
        entries(splits, "split", F.col("images"), "split_counts"),
        entries(per_class, "class_key", F.col("families"), "family_counts_by_class"),
        entries(matrix, "class_key", F.struct("train", "val", "test"), "split_class_counts"),
    )


def summary_document(summary: DataFrame) -> DataFrame:
    return summary.select(F.to_json(F.struct(*summary.columns)).alias("value"))
