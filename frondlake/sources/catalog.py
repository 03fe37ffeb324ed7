"""Class catalog: JSON document, plain label list, derived names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import CATALOG, CATALOG_DOCUMENT


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Classes of a ``{"classes": [...]}`` document with their 0-based file ``position``.

    A document without classes fails the query when it runs.
    """
    document = spark.read.schema(CATALOG_DOCUMENT).option("mode", "FAILFAST").json(path, multiLine=True)
    classes = F.when(
        F.coalesce(F.size("classes"), F.lit(0)) < 1, F.raise_error(F.lit("the catalog has no classes"))
    ).otherwise(F.col("classes"))
    return document.select(F.posexplode(classes).alias("position", "c")).select("c.*", "position")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``(id, display_name)`` from lines ``<id> <display name>``."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).cast("int").alias("id"), F.get(parts, F.lit(1)).alias("display_name")
    )


def derive_catalog(rows: DataFrame, class_id: Column, crop: Column, disease: Column) -> DataFrame:
    """Catalog from ids and free-text crop and disease names (slugs, keys, directories, titles)."""
    made = rows.select(
        class_id.cast("int").alias("id"), text.checked_slug(crop, "crop").alias("crop"),
        text.checked_slug(disease, "disease").alias("disease"),
    )
    return made.select(
        "id", (F.col("id") - 1).alias("index"),
        text.class_key(F.col("crop"), F.col("disease")).alias("key"),
        text.class_display_name(F.col("crop"), F.col("disease")).alias("display_name"),
        "crop", "disease",
        text.class_directory(F.col("crop"), F.col("disease")).alias("relative_directory"),
    )


def catalog_document(catalog: DataFrame) -> DataFrame:
    """One row ``value``: the catalog as JSON with its class count, classes by index.

    The catalog is a dimension of known size, so gathering it is fine.
    """
    fields = CATALOG.fieldNames()
    ordered = F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("index").alias("_at"), F.struct(*fields).alias("c")))),
        lambda s: s["c"],
    )
    return catalog.agg(
        F.to_json(F.struct(F.count(F.lit(1)).alias("class_count"), ordered.alias("classes"))).alias("value")
    )


def label_lines(catalog: DataFrame) -> DataFrame:
    """``value`` lines ``<id> <display name>`` sorted by id."""
    return catalog.orderBy("id").select(F.format_string("%d %s", "id", "display_name").alias("value"))
