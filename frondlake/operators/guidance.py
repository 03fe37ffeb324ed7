"""Attach guidance records to predicted classes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import GUIDANCE
from ..sources.guidance import DISCLAIMER, HEALTHY, HEALTHY_SUFFIX, SOURCES


def with_guidance(rows: DataFrame, records: DataFrame, class_col: str = "class_key") -> DataFrame:
    """Inner join of rows with the guidance of their class.

    A key without its own record that ends literally in ``__healthy`` gets the
    healthy record, whatever the crop; other unknown keys have no row.
    """
    fields = [f for f in GUIDANCE.fieldNames() if f != "class_key"]
    named = records.select(F.col("class_key").alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = rows.join(named, F.col(class_col) == F.col("_key"), "left")
    fallback = F.col("_key").isNull() & F.endswith(F.col(class_col), F.lit(HEALTHY_SUFFIX))

    crop = F.replace(F.get(F.split(F.col(class_col), "__", 2), F.lit(0)), F.lit("pepper"),
                     F.lit("bell pepper"))

    def texts(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    made = {
        "display_name": F.concat(_title_keeping_underscores(crop), F.lit(" Healthy")),
        **{name: F.lit(value) for name, value in HEALTHY.items() if isinstance(value, str)},
        **{name: texts(value) for name, value in HEALTHY.items() if not isinstance(value, str)},
        "disclaimer": F.lit(DISCLAIMER),
        "sources": texts(SOURCES),
    }
    return joined.where(F.col("_key").isNotNull() | fallback).select(
        *rows.columns,
        *[F.when(fallback, made[f]).otherwise(F.col(f"_{f}")).alias(f"guidance_{f}"
          if f in rows.columns else f) for f in fields],
    )


def guidance_for_keys(keys: DataFrame, records: DataFrame) -> DataFrame:
    """Guidance of a list of class keys, one row per known key."""
    return with_guidance(keys.select("class_key"), records)


def _title_keeping_underscores(name: Column) -> Column:
    pieces = F.transform(F.split(name, "_"), text.title_words)
    return F.array_join(pieces, "_")
