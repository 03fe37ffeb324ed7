"""Explicit schemas of every table the library reads or writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(),
    "DOUBLE": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BINARY": T.BinaryType(),
    "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
    "ARRAY<DOUBLE>": T.ArrayType(T.DoubleType()),
}


def _struct(spec: str) -> T.StructType:
    """Schema from ``name TYPE, ...``; usable before a session exists."""
    pairs = (field.split() for field in spec.split(", "))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


CATALOG = _struct(
    "id INT, index INT, key STRING, display_name STRING, crop STRING, "
    "disease STRING, relative_directory STRING"
)

CATALOG_DOCUMENT = T.StructType(
    [
        T.StructField("class_count", T.LongType()),
        T.StructField("classes", T.ArrayType(CATALOG)),
    ]
)

# Ids stay text on read, so that unparsable ones can be reported.
MANIFEST = _struct(
    "split STRING, class_id STRING, class_index STRING, class_key STRING, "
    "display_name STRING, crop STRING, disease STRING, family_id STRING, "
    "augmentation STRING, relative_path STRING"
)

ASSET_RECORDS = _struct(
    "path STRING, relative_path STRING, valid BOOLEAN, width INT, height INT, "
    "pixels BIGINT, aspect_ratio DOUBLE, format STRING, mode STRING, channels INT, "
    "file_size BIGINT, sha256 STRING, dhash BIGINT, error STRING, small BOOLEAN, "
    "below_ideal_resolution BOOLEAN, severely_undersized BOOLEAN, "
    "extreme_aspect BOOLEAN, tiny_file BOOLEAN, large_file BOOLEAN, "
    "grayscale BOOLEAN, has_alpha BOOLEAN, class_id INT"
)

SCAN_HISTORY = _struct(
    "id BIGINT, filename STRING, content_type STRING, image BINARY, "
    "class_key STRING, crop STRING, disease STRING, display_name STRING, "
    "confidence DOUBLE, confidence_percent DOUBLE, inference_ms DOUBLE, "
    "created_at TIMESTAMP"
)

GUIDANCE = _struct(
    "class_key STRING, display_name STRING, classification STRING, agent STRING, "
    "cause_factors ARRAY<STRING>, cure_points ARRAY<STRING>, "
    "prevention_points ARRAY<STRING>, management_label STRING, note STRING, "
    "disclaimer STRING, sources ARRAY<STRING>"
)

GUIDANCE_POINTS = _struct("class_key STRING, section STRING, position INT, text STRING")

UPLOADS = _struct(
    "upload_id STRING, filename STRING, content_type STRING, payload BINARY, "
    "received_at TIMESTAMP"
)


class MissingColumns(ValueError):
    """A table lacks columns its contract requires."""


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df`` unchanged, or fail when columns are missing (a superset is fine)."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise MissingColumns(f"{what} is missing columns: {missing}")
    return df
