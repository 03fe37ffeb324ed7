"""Image manifest: CSV with a checked header, line numbers, version digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST, MissingColumns
from .records import read_records


def read_manifest(spark: SparkSession, path: str, required: Sequence[str] = tuple(MANIFEST.fieldNames()),
                  number_lines: bool = False) -> DataFrame:
    """Manifest rows as text. Missing required columns are an error, extra ones are kept.

    Only the header line is looked at here; the data is read lazily.
    ``number_lines`` adds ``line``, the 1-based line of its file a record begins on
    (data starts at line 2); records may then hold quoted line breaks.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    names = reader.csv(path).columns
    missing = sorted(set(required) - set(names))
    if missing:
        raise MissingColumns(f"manifest is missing columns: {missing}")
    schema = ", ".join(f"`{name}` STRING" for name in names)
    if not number_lines:
        return reader.option("enforceSchema", False).schema(schema).csv(path)
    records = read_records(spark, path).where("line > 1")
    parsed = F.from_csv("record", schema, {"escape": '"'})
    return records.select(parsed.alias("r"), "line").select("r.*", "line")


def manifest_digest(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of each manifest file: the version id of a manifest."""
    return spark.read.format("binaryFile").load(path).select(
        "path", F.sha2("content", 256).alias("sha256")
    )
