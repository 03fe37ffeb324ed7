"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the operators are planned for. AQE re-plans joins from
# measured sizes, splits skewed join partitions and coalesces small ones, so no
# operator needs a hand-set partition count or an unchecked broadcast hint.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Decoded images are large: bound the batches sent to Python by bytes, not rows only.
    "spark.sql.execution.arrow.maxBytesPerBatch": "32m",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  memory: str = "8g", name: str = "frondlake") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # Recording a Python call site for every expression takes longer than planning it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def checkpoint_folder(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster.

    ``spark.checkpoint.dir`` names it. A temporary folder is used only by a
    session running on one machine that has none set (tests); anywhere else
    the missing setting is an error, because another executor could not read it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor shares")
        folder = tempfile.mkdtemp(prefix="frondlake-checkpoint-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and continue from there (an action).

    Unlike an RDD checkpoint the table keeps column pruning and filter
    push-down for its readers, and it survives lost executors. It is removed
    when the application ends, or by ``discard``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/frondlake-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    place, files = _place(spark, path)
    files.deleteOnExit(place)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def _place(spark: SparkSession, path: str):
    """Hadoop's path and file system."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*stored: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` returned; nothing may read them any more."""
    for df in stored:
        place, files = _place(df.sparkSession, df.stored_at)
        files.delete(place, True)


@contextmanager
def shuffles_released(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of an action go when it ends, whatever the driver's garbage collector does."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
