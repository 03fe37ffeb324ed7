"""Reads of the stored history that open only the partitions they need."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..operators.history import list_scans, scan_image
from ..sources.history import NO_BATCH, with_partitions
from ..streaming.uploads import BATCH_IDS


def stored_days(spark: SparkSession, path: str) -> list[date]:
    """The days of the history, newest first, from its folder names (one entry per day)."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = (entry.getPath().getName() for entry in store.listStatus(folder))
    prefix = "scan_date="
    days = [n[len(prefix):] for n in names if n.startswith(prefix)]
    return sorted((date.fromisoformat(d) for d in days if d[:1].isdigit()), reverse=True)


def newest_scans(spark: SparkSession, path: str, *, limit: int = C.HISTORY_LIMIT, category: str = "all",
                 query: str = "", growth: int = 8) -> DataFrame:
    """Same rows as ``list_scans`` over the whole history, reading newest days first (runs jobs).

    The rows are ordered by time and a partition holds one day, so as soon as
    the newest days give ``limit`` rows no older day can add one. The number of
    days read grows by ``growth`` from try to try.
    """
    days = stored_days(spark, path)
    history = with_partitions(spark, path)
    span = 1
    while True:
        rows = history if span >= len(days) else history.where(F.col("scan_date") >= F.lit(days[span - 1]))
        listed = list_scans(rows, limit=limit, category=category, query=query)
        if span >= len(days) or listed.count() == limit:
            return listed
        span *= growth


def find_scan_image(spark: SparkSession, path: str, scan_id: int) -> DataFrame:
    """Image of one scan. A streamed id names its batch, so only that batch's files are opened."""
    history = with_partitions(spark, path)
    if scan_id >= BATCH_IDS:
        batches = [scan_id // BATCH_IDS]
    else:  # the stream's first batch, or appended outside a stream
        batches = [0, NO_BATCH]
    return scan_image(history.where(F.col("batch_id").isin(*batches)), scan_id)
