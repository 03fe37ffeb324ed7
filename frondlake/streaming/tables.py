"""Tables read as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Stream of a Parquet table, stored as one file or as a folder of part files.

    A stream source takes a plain path for a folder; a pattern that matches only
    this path reads either.
    """
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
