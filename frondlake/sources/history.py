"""Scan history table: partitioned parquet, append with new ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import rank_by_digest
from ..schemas import SCAN_HISTORY

PARTITIONS = ("scan_date", "batch_id")
# Batches written without a stream share this partition value.
NO_BATCH = -1


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The history without its partition columns.

    ``id`` and ``created_at`` filters reach the parquet scan; a listing that
    does not name ``image`` never reads it.
    """
    return with_partitions(spark, path).select(*SCAN_HISTORY.fieldNames())


def with_partitions(spark: SparkSession, path: str) -> DataFrame:
    """The history with ``scan_date`` and ``batch_id``, for pruning by date."""
    schema = SCAN_HISTORY.simpleString()[len("struct<"):-1].replace(":", " ")
    return spark.read.schema(f"{schema}, scan_date DATE, batch_id BIGINT").parquet(path)


def scan_key(rows: DataFrame, key_cols: tuple[str, ...] = ("filename", "created_at", "image")) -> DataFrame:
    """Add ``_key``: a content digest that is the same on every attempt."""
    parts = [F.sha2(c, 256) if dict(rows.dtypes)[c] == "binary" else F.col(c).cast("string")
             for c in key_cols]
    return rows.withColumn("_key", F.sha2(F.concat_ws("|", *parts), 256))


def append_scans(scans: DataFrame, path: str, first_id: int = 1) -> None:
    """Append scored scans with new ids above the existing ones (runs jobs).

    One writer at a time; concurrent writers should use the stream, whose ids
    come from the batch number.
    """
    spark = scans.sparkSession
    stamped = scans if "created_at" in scans.columns else scans.withColumn(
        "created_at", F.current_timestamp())
    try:
        highest = with_partitions(spark, path).agg(F.max("id")).first()[0]
    except Exception as problem:  # a table that does not exist yet
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        highest = None
    base = first_id - 1 if highest is None else highest
    ranked = rank_by_digest(scan_key(stamped).drop("id"), "_key")
    write_scans(ranked.withColumn("id", F.lit(base) + F.col("rank")), path, NO_BATCH, "append")


def write_scans(rows: DataFrame, path: str, batch_id: int, mode: str) -> None:
    """Write complete scan rows below ``scan_date=/batch_id=``.

    The rebalance gives a day few files; AQE splits a day that is too large for one.
    """
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCAN_HISTORY]
    (rows.select(*columns)
     .withColumns({"scan_date": F.to_date("created_at"), "batch_id": F.lit(batch_id).cast("bigint")})
     .hint("rebalance", "scan_date").write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*PARTITIONS).parquet(path))
