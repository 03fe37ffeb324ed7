"""Differences between two versions of a catalog and its manifest."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mutation import Change
from .rows import merge_single_rows

_ATTRIBUTES = ("id", "index", "key", "display_name", "crop", "disease", "relative_directory")


def catalog_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row per class of either version: ``change``, ``old`` and ``new`` attributes (NULL where absent).

    Classes are the same if their keys are; of the rest, those of equal id are one
    class that was ``renamed``. Others are ``added``, ``removed``, ``changed`` (any
    attribute), or ``same``. Keys must be unique in each version. Class-sized tables.
    """
    def side(catalog: DataFrame, name: str) -> DataFrame:
        return catalog.select(F.struct(*_ATTRIBUTES).alias(name))

    before, after = side(old, "old"), side(new, "new")
    same_key = F.col("old.key") == F.col("new.key")
    kept = before.join(after, same_key)
    rest = before.join(after, same_key, "left_anti").join(
        after.join(before, same_key, "left_anti"), F.col("old.id") == F.col("new.id"), "full")
    kind = (F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
            .when(~F.col("old.key").eqNullSafe(F.col("new.key")), "renamed"))
    equal = reduce(and_, [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in _ATTRIBUTES])
    return kept.unionByName(rest).select(
        kind.otherwise(F.when(equal, "same").otherwise("changed")).alias("change"), "old", "new")


def manifest_changes(old: DataFrame, new: DataFrame, moves: DataFrame | None = None, *,
                     path_col: str = "relative_path") -> DataFrame:
    """One row per path whose rows differ between two versions of a manifest.

    ``change`` is ``added``, ``removed`` or ``changed``; ``old_rows`` and ``new_rows``
    count the differing rows; ``fields`` lists the columns in which the smallest of
    them differ, in table order. With ``moves`` (``old_path``, ``new_path``, each old
    path once) a moved file is one changed path, named by its new place.

    Rows are compared as a bag and NULL equals NULL, so repeated rows count. Only
    differing rows are grouped by path; equal ones cancel out before, combined map-side.
    """
    columns = old.columns
    types = {f.name: f.dataType for f in old.schema}
    latter = new.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])
    former = old.select("*", F.col(path_col).alias("__path"))
    if moves is not None:
        places = moves.select(F.col("old_path").alias("__old"), F.col("new_path").alias("__new"))
        former = old.join(places, F.col(path_col) == F.col("__old"), "left").select(
            *columns, F.coalesce("__new", path_col).alias("__path"))
    both = former.withColumn("__side", F.lit(-1)).unionByName(
        latter.select("*", F.col(path_col).alias("__path")).withColumn("__side", F.lit(1)))
    row = F.struct(*columns).alias("__row")
    differing = both.groupBy("__path", *columns).agg(F.sum("__side").alias("__n")).where("__n <> 0").select(
        "__path", "__n", row)
    gone, come = F.col("__n") < 0, F.col("__n") > 0
    paths = differing.groupBy("__path").agg(
        F.coalesce(F.sum(F.when(gone, -F.col("__n"))), F.lit(0)).alias("old_rows"),
        F.coalesce(F.sum(F.when(come, F.col("__n"))), F.lit(0)).alias("new_rows"),
        F.min(F.when(gone, F.col("__row"))).alias("__old"), F.min(F.when(come, F.col("__row"))).alias("__new"))

    def differs(name: str) -> Column:
        return F.when(~F.col(f"__old.{name}").eqNullSafe(F.col(f"__new.{name}")), F.lit(name))

    changed = (F.col("old_rows") > 0) & (F.col("new_rows") > 0)
    return paths.select(
        F.col("__path").alias(path_col),
        F.when(changed, "changed").when(F.col("old_rows") > 0, "removed").otherwise("added").alias("change"),
        "old_rows", "new_rows",
        F.when(changed, F.array_compact(F.array(*[differs(c) for c in columns])))
        .otherwise(F.array().cast("array<string>")).alias("fields"))


def change_record(change: Change, catalog: DataFrame, manifest: DataFrame | None = None, *,
                  applied: bool) -> DataFrame:
    """One row for the operation log: classes before and after, ids that moved, rows and files touched.

    ``old_classes`` and ``new_classes`` hold the attributes of each class that was
    added, removed or renamed; ``id_remap`` maps the old id of every class that stays
    to its new one. Row counts are NULL for a change without a manifest.
    """
    def listed(side: str) -> Column:
        touched = F.col("change").isin("added", "removed", "renamed") & F.col(side).isNotNull()
        return F.array_sort(F.collect_list(F.when(touched, F.col(side)))).alias(f"{side}_classes")

    stays = F.col("old").isNotNull() & F.col("new").isNotNull()
    ids = F.array_sort(F.collect_list(F.when(stays, F.struct(
        F.col("old.id").cast("string").alias("k"), F.col("new.id").alias("v")))))
    frames = [catalog_changes(catalog, change.catalog).agg(
        listed("old"), listed("new"), F.map_from_entries(ids).alias("id_remap"))]
    if change.manifest is not None and manifest is not None:
        rows = manifest_changes(manifest, change.manifest, change.moves)
        frames.append(rows.agg(*[
            F.count_if(F.col("change") == c).alias(f"manifest_paths_{c}") for c in ("added", "removed", "changed")]))
    if change.moves is not None:
        frames.append(change.moves.agg(F.count(F.lit(1)).alias("moved_files")))
    return merge_single_rows(*frames).withColumn("applied", F.lit(applied))

