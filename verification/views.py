"""The driver's tables seen as catalogs, manifests, assets, vectors and histories.

The tables hold no images, so each view derives the columns an operator needs
from columns that are there. Every view covers its whole table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frondlake.operators.profile import with_quality
from frondlake.sources.catalog import derive_catalog

# event type -> class key; "pepper__unhealthy" exercises the LIKE wildcard.
EVENT_CLASSES = {
    "click": "corn__common_rust",
    "error": "tomato__late_blight",
    "purchase": "lemon__curl_virus",
    "signup": "pepper__unhealthy",
    "view": "corn__healthy",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def classes(spark: SparkSession, folder: str) -> DataFrame:
    """25 classes: regions as crops, nations as diseases."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    rows = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return derive_catalog(rows, F.col("n_nationkey") + 1, F.col("r_name"), F.col("n_name"))


def legacy_classes(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog with faults: ids from 0, reversed file order, one directory per crop."""
    return classes(spark, folder).select(
        F.col("index").alias("id"), "index", "key", "display_name", "crop", "disease",
        F.col("crop").alias("relative_directory"), (F.lit(24) - F.col("index")).alias("position"),
    )


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as images, customers as families, customers' nations as classes."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    catalog = classes(spark, folder)
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(
        catalog, F.col("c_nationkey") == F.col("index"))
    return rows.select(
        _split().alias("split"), F.col("id").alias("class_id"), F.col("index").alias("class_index"),
        F.col("key").alias("class_key"), "display_name", "crop", "disease",
        F.col("c_custkey").cast("string").alias("family_id"),
        F.col("o_orderpriority").alias("augmentation"),
        F.concat("relative_directory", F.lit("/"), F.col("o_orderkey").cast("string"), F.lit(".jpg"))
        .alias("relative_path"),
    )


def _split():
    status = F.col("o_orderstatus")
    return F.when(status == "F", "train").when(status == "O", "val").when(status == "P", "test")


def faulty_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with faults that depend on the orders' and customers' values."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    catalog = classes(spark, folder)
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(
        catalog, F.col("c_nationkey") == F.col("index"))
    low, urgent = F.col("o_orderpriority") == "5-LOW", F.col("o_orderpriority") == "1-URGENT"
    return rows.select(
        F.when(F.col("o_totalprice") > 450000, "holdout").otherwise(_split()).alias("split"),
        F.when(F.col("o_totalprice") < 20000, "n/a")
        .when(F.col("c_acctbal") < 0, (F.col("id") + 100).cast("string"))
        .otherwise(F.col("id").cast("string")).alias("class_id"),
        F.col("index").cast("string").alias("class_index"),
        F.when(urgent & (F.col("c_mktsegment") == "MACHINERY"), F.upper("key"))
        .otherwise(F.col("key")).alias("class_key"),
        "display_name", "crop", "disease",
        F.col("c_custkey").cast("string").alias("family_id"),
        F.col("o_orderpriority").alias("augmentation"),
        F.concat("relative_directory", F.lit("/"), F.col("o_orderkey").cast("string"),
                 F.when(low, ".gif").otherwise(".JPG")).alias("relative_path"),
    )


def supplier_files(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as files of the class after their nation: class 1 is empty, 26 is unknown."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("file_id"), (F.col("s_nationkey") + 2).alias("class_id"))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as inspected images; parts of size 13 are the corrupt ones."""
    size = F.col("p_size")
    valid = size != 13
    kind = F.col("p_type")
    # Part type -> image format; part colour word -> colour mode.
    formats = {"ECONOMY": "jpeg", "LARGE": "png", "MEDIUM": "bmp", "PROMO": "webp",
               "SMALL": "tiff", "STANDARD": "jpeg"}
    modes = {"blue": "RGB", "cold": "RGBA", "hot": "L", "large": "CMYK",
             "new": "P", "old": "LA", "red": "I;16", "small": "LAB"}
    lookup = F.create_map(*[F.lit(x) for item in {**formats, **modes}.items() for x in item])
    rows = table(spark, folder, "part").select(
        F.substring("p_brand", 7, 10).cast("int").alias("class_id"),
        F.concat(F.lower(kind), F.lit("/"), F.col("p_partkey").cast("string")).alias("relative_path"),
        valid.alias("valid"),
        F.when(valid, size * 12).cast("int").alias("width"),
        F.when(valid, F.round(F.col("p_retailprice") * 10).cast("int") % 640 + 40).cast("int").alias("height"),
        F.try_element_at(lookup, kind).alias("format"),
        F.when(valid, F.try_element_at(lookup, F.split("p_name", " ")[0])).alias("mode"),
        (size * size * size * 100).cast("bigint").alias("file_size"),
        F.sha2(F.concat_ws("|", "p_name", size.cast("string")), 256).alias("sha256"),
        F.when(valid, F.conv(F.substring(F.md5(F.concat_ws("|", "p_name", kind)), 1, 15), 16, 10)
               .cast("bigint")).alias("dhash"),
    )
    return with_quality(rows)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, their sources as classes."""
    return table(spark, folder, "documents").select(
        "doc_id", F.col("source").alias("class_id"),
        F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt"))
        .alias("relative_path"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        F.octet_length("text").cast("bigint").alias("file_size"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings as gray grids, logits of ten classes (sums of every tenth value), and their targets."""
    logits = F.array(*[
        reduce(lambda a, b: a + b, [F.get("embedding", F.lit(i)).cast("double") for i in range(k, 64, 10)]) for k in range(10)])
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("image"), "embedding", logits.alias("logits"),
        F.col("label").alias("target"),
    )


def history(spark: SparkSession, folder: str) -> DataFrame:
    """Events as scans."""
    return scans_from_events(table(spark, folder, "events"))


def scans_from_events(events: DataFrame) -> DataFrame:
    """Works on a batch and on a stream of events."""
    lookup = F.create_map(*[F.lit(x) for item in EVENT_CLASSES.items() for x in item])
    key = F.try_element_at(lookup, F.col("event_type"))
    crop, disease = F.split(key, "__")[0], F.split(key, "__")[1]
    shown = F.initcap(F.concat_ws(" ", crop, F.replace(disease, F.lit("_"), F.lit(" "))))
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("Leaf-"), F.col("user_id").cast("string"), F.lit(".jpg")).alias("filename"),
        F.lit("image/jpeg").alias("content_type"),
        F.col("props").cast("binary").alias("image"),
        key.alias("class_key"), crop.alias("crop"), disease.alias("disease"), shown.alias("display_name"),
        (F.col("value") / 1000).alias("confidence"), F.col("value").alias("confidence_percent"),
        (F.col("value") * 2).alias("inference_ms"), F.col("ts").alias("created_at"),
    )


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Days as epochs, the mean event value as the validation score."""
    return table(spark, folder, "events").groupBy(
        F.date_diff(F.to_date("ts"), F.lit("2023-12-31").cast("date")).alias("epoch")
    ).agg(F.round(F.avg("value"), 4).alias("val_macro_f1"))


def artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Conversation turns as saved models; the turn is the time."""
    role = F.col("role")
    kind = F.when(role == "assistant", "model_Best").when(role == "user", "model_final").otherwise("model")
    return table(spark, folder, "conversations").select(
        F.concat_ws("_", kind, F.lpad(F.col("conv_id").cast("string"), 12, "0")).alias("path"),
        F.col("turn").alias("mtime"),
    )
