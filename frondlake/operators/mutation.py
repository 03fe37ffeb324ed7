"""Catalog changes with their effect on the manifest, as planned DataFrames.

Nothing is written here: looking at the frames is the dry run, writing them
(``sources.sinks``) applies the change. Directory moves are returned as plans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import text
from ..schemas import CATALOG


def _all() -> WindowSpec:
    """One frame over a class-sized table."""
    return Window.partitionBy()
_FIELDS = CATALOG.fieldNames()


@dataclass(frozen=True)
class Change:
    """``moves`` is NULL-free ``(old_path, new_path)``; ``details`` is one row for the log."""

    catalog: DataFrame
    manifest: DataFrame | None
    moves: DataFrame | None
    details: DataFrame


def _guard(value: Column, problem: Column, message: str) -> Column:
    return F.when(problem, F.raise_error(F.lit(message))).otherwise(value)


def create_class(catalog: DataFrame, crop: str, disease: str,
                 display_name: str | None = None) -> Change:
    """Append an empty class with the next id and index; an existing key is an error."""
    crop_slug = text.checked_slug(F.lit(crop), "crop")
    disease_slug = text.checked_slug(F.lit(disease), "disease")
    key = text.class_key(crop_slug, disease_slug)
    shown = F.lit(display_name.strip()) if display_name else text.class_display_name(
        crop_slug, disease_slug)
    facts = catalog.agg(
        F.count(F.lit(1)).cast("int").alias("_n"),
        F.coalesce(F.bool_or(F.col("key") == key), F.lit(False)).alias("_taken"),
    )
    row = facts.select(
        (F.col("_n") + 1).alias("id"), F.col("_n").alias("index"),
        _guard(key, F.col("_taken"), "class already exists").alias("key"),
        shown.alias("display_name"), crop_slug.alias("crop"), disease_slug.alias("disease"),
        text.class_directory(crop_slug, disease_slug).alias("relative_directory"),
    )
    return Change(catalog.select(*_FIELDS).unionByName(row), None, None, row)


def rename_class(catalog: DataFrame, manifest: DataFrame, class_id: int, *, crop: str | None = None,
                 disease: str | None = None, display_name: str | None = None) -> Change:
    """Give one class a new key, directory and name, and rewrite its manifest rows.

    Unknown ids, a key of another class, an empty name, and manifest paths
    outside the class directory are errors when the frames are evaluated.
    """
    if display_name is not None and display_name and not display_name.strip():
        raise ValueError("display name cannot be empty")
    here = F.col("id") == class_id
    new_crop = text.checked_slug(F.lit(crop), "crop") if crop else F.col("crop")
    new_disease = text.checked_slug(F.lit(disease), "disease") if disease else F.col("disease")
    new_key = F.max(F.when(here, text.class_key(new_crop, new_disease))).over(_all())
    facts = catalog.withColumn("_key", new_key)
    clash = F.bool_or(~here & (F.col("key") == F.col("_key"))).over(_all())
    facts = facts.withColumns({
        "_old_directory": F.col("relative_directory"),
        "key": F.when(here, _guard(F.col("_key"), clash, "another class already has this key"))
        .otherwise(_guard(F.col("key"), F.col("_key").isNull(), f"unknown class id: {class_id}")),
        "display_name": F.when(here, F.lit(display_name.strip()) if display_name else F.col("display_name"))
        .otherwise(F.col("display_name")),
        "relative_directory": F.when(here, text.class_directory(new_crop, new_disease))
        .otherwise(F.col("relative_directory")),
        "crop": F.when(here, new_crop).otherwise(F.col("crop")),
        "disease": F.when(here, new_disease).otherwise(F.col("disease")),
    })
    updated = facts.select(*_FIELDS)
    changed = facts.where(here).select(
        F.col("id").cast("bigint").alias("_id"), F.col("_old_directory"),
        *[F.col(c).alias(f"_{c}") for c in _FIELDS if c != "id"],
    )
    # `changed` is the single row of one class id.
    joined = manifest.join(
        F.broadcast(changed), F.col("class_id").cast("bigint") == F.col("_id"), "left")
    affected = F.col("_id").isNotNull()
    moved = F.concat(
        F.col("_relative_directory"),
        F.substr(F.col("relative_path"), F.length("_old_directory") + 1),
    )
    inside = F.startswith(F.col("relative_path"), F.concat(F.col("_old_directory"), F.lit("/")))
    new_path = _guard(moved, ~inside, "manifest path does not match the class directory")

    def either(name: str, value: Column) -> Column:
        return F.when(affected, value).otherwise(F.col(name)).alias(name)

    replaced = {
        "class_index": F.col("_index").cast(manifest.schema["class_index"].dataType),
        "class_key": F.col("_key"), "display_name": F.col("_display_name"),
        "crop": F.col("_crop"), "disease": F.col("_disease"), "relative_path": new_path,
    }
    rewritten = joined.select(*[
        either(c, replaced[c]) if c in replaced else F.col(c) for c in manifest.columns
    ])
    moves = joined.where(affected).select(
        F.col("relative_path").alias("old_path"), new_path.alias("new_path")
    ).where("old_path <> new_path")
    details = manifest.where(F.col("class_id").cast("bigint") == class_id).agg(
        F.count(F.lit(1)).alias("manifest_rows")
    ).withColumn("class_id", F.lit(class_id))
    return Change(updated, rewritten, moves, details)


def delete_class(catalog: DataFrame, manifest: DataFrame, class_id: int, *,
                 position_col: str = "position", archive: str = "archive") -> Change:
    """Remove a class, renumber the others in catalog order and refresh the manifest.

    Deleting the only class, an unknown id, or a manifest row of a class that the
    catalog doesn't have is an error when evaluated: only the rows of the deleted class go.
    ``moves`` archives the removed class's files.
    """
    order = position_col if position_col in catalog.columns else "index"
    counted = catalog.withColumns({
        "_n": F.count(F.lit(1)).over(_all()),
        "_here": F.count_if(F.col("id") == class_id).over(_all()),
    })
    checked = counted.withColumn("id", _guard(
        _guard(F.col("id"), F.col("_here") == 0, f"unknown class id: {class_id}"),
        (F.col("_n") == 1) & (F.col("_here") == 1), "refusing to delete the only class",
    ))
    place = F.row_number().over(_all().orderBy(order))
    kept = checked.where(F.col("id") != class_id).withColumn("_old", F.col("id")).withColumns({
        "id": place.cast("int"), "index": (place - 1).cast("int"),
    })
    remap = kept.select(
        F.col("_old").cast("bigint").alias("_old"), F.col("id").alias("_id"),
        F.col("index").alias("_index"), F.col("key").alias("_key"),
        F.col("display_name").alias("_display_name"), F.col("crop").alias("_crop"),
        F.col("disease").alias("_disease"),
    )
    types = manifest.schema
    stray = F.concat(F.lit("manifest row of an unknown class: "), F.coalesce(F.col("class_id").cast("string"), F.lit("NULL")))
    new_id = F.when(F.col("_old").isNull(), F.raise_error(stray)).otherwise(F.col("_id"))
    replaced = {
        "class_id": new_id.cast(types["class_id"].dataType),
        "class_index": F.col("_index").cast(types["class_index"].dataType),
        "class_key": F.col("_key"), "display_name": F.col("_display_name"),
        "crop": F.col("_crop"), "disease": F.col("_disease"),
    }
    others = manifest.where(~F.col("class_id").cast("bigint").eqNullSafe(F.lit(class_id)))
    rewritten = others.join(remap, F.col("class_id").cast("bigint") == F.col("_old"), "left").select(*[
        replaced[c].alias(c) if c in replaced else F.col(c) for c in manifest.columns
    ])
    gone = manifest.where(F.col("class_id").cast("bigint") == class_id)
    moves = gone.select(
        F.col("relative_path").alias("old_path"),
        F.concat(F.lit(f"{archive}/"), F.col("relative_path")).alias("new_path"),
    )
    details = gone.agg(F.count(F.lit(1)).alias("manifest_rows")).withColumn("class_id", F.lit(class_id))
    return Change(kept.select(*_FIELDS), rewritten, moves, details)


def rewrite_rows(manifest: DataFrame, columns: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Rewrite a manifest with column expressions, dropping rows where ``keep`` is not true."""
    rows = manifest if keep is None else manifest.where(keep)
    return rows.withColumns(columns).select(*manifest.columns)


def rewrite_rows_with(manifest: DataFrame, change: Callable[[dict], dict | None]) -> DataFrame:
    """Rewrite a manifest with a Python row function; ``None`` drops the row.

    For logic that no column expression covers; batches travel by Arrow.
    """
    names = manifest.columns

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [change(row) for row in batch.to_dict("records")]
            yield pd.DataFrame([row for row in made if row is not None], columns=names)

    return manifest.mapInPandas(apply, manifest.schema)
