"""Continuously maintained history statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def class_totals(scans: DataFrame) -> DataFrame:
    """Counts and confidence sums per class of a stream or batch of scans.

    The state has one row per class, so it needs no watermark.
    ``operators.history.stats_from_classes`` turns the result into totals.
    """
    return scans.groupBy("class_key", "display_name").agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum("confidence_percent").alias("percent_sum"),
        F.count("confidence_percent").alias("percent_count"),
    )


def maintain_class_totals(scans: DataFrame, path: str, checkpoint: str, *, keep: int = 3,
                          **trigger) -> StreamingQuery:
    """Store the class totals of everything read so far after every batch (see ``store_class_totals``)."""
    def store(batch: DataFrame, batch_id: int) -> None:
        store_class_totals(batch, batch_id, path, keep=keep)

    writer = class_totals(scans).writeStream.outputMode("complete").foreachBatch(store)
    return writer.option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def store_class_totals(totals: DataFrame, batch_id: int, path: str, *, keep: int = 3) -> None:
    """Write one batch's totals as a snapshot and remove those that it replaces.

    A snapshot is a ``batch_id=`` folder of its own and complete once it holds
    ``_SUCCESS``. It covers all earlier batches, so the ones before the newest
    ``keep`` go when it is complete; the others serve readers that opened them.
    A repeated batch replaces its own snapshot only.
    """
    if keep < 1:
        raise ValueError("keep at least one snapshot")
    totals.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    files = _file_system(totals.sparkSession, path)
    for _, old in _snapshots(totals.sparkSession, path)[:-keep]:
        files.delete(old, True)


def latest_class_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest complete snapshot; no other one is opened."""
    found = _snapshots(spark, path)
    if not found:
        raise FileNotFoundError(f"no complete class totals below {path}")
    return spark.read.schema(
        "class_key STRING, display_name STRING, scans BIGINT, percent_sum DOUBLE, percent_count BIGINT"
    ).parquet(str(found[-1][1]))


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _snapshots(spark: SparkSession, path: str) -> list:
    """Complete snapshots as ``(batch id, folder)``, oldest first; retention bounds their number."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = _file_system(spark, path)
    if not files.exists(at(path)):
        return []
    folders = [entry.getPath() for entry in files.listStatus(at(path))]
    numbered = [(int(f.getName().split("=")[1]), f) for f in folders if f.getName().startswith("batch_id=")]
    return sorted(((n, f) for n, f in numbered if files.exists(at(f, "_SUCCESS"))), key=lambda pair: pair[0])
