"""Catalog and manifest validation.

All violations are reported as rows instead of stopping at the first one;
:func:`first_violation` gives the one a line-by-line reader would stop at.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import constants as C
from ..functions import text
from ..schemas import CATALOG, MANIFEST, require_columns

# Which catalog rules each kind of caller insists on.
_COMMON = ("bad_id", "bad_index", "ids_not_contiguous", "indices_not_contiguous")
CATALOG_RULES = {
    "manager": ("missing_field", *_COMMON, "empty_key", "empty_directory",
                "duplicate_key", "duplicate_directory"),
    "auditor": (*_COMMON, "id_index_mismatch", "empty_display_name"),
    "trainer": (*_COMMON, "id_out_of_order", "index_out_of_order", "duplicate_key"),
}
CATALOG_RULES["all"] = tuple(dict.fromkeys(r for rules in list(CATALOG_RULES.values()) for r in rules))

_SPLIT_BITS = {split: 1 << i for i, split in enumerate(C.SPLITS)}


def catalog_violations(catalog: DataFrame, rules: str | Iterable[str] = "all",
                       position_col: str = "position") -> DataFrame:
    """Rows ``(rule, class_id, class_key)`` for every broken rule.

    ``position_col`` is the 0-based place in the catalog file; the order rules
    need it. Whole-catalog rules have a NULL class. The windows run over the
    catalog only.
    """
    wanted = set(CATALOG_RULES[rules] if isinstance(rules, str) else rules)
    every = Window.partitionBy()
    directory = F.replace(F.col("relative_directory"), F.lit("\\"), F.lit("/"))
    rows = catalog.withColumns({
        "_directory": directory,
        "_n": F.count(F.lit(1)).over(every),
    }).withColumns({
        "_same_key": F.count(F.lit(1)).over(Window.partitionBy("key")),
        "_same_directory": F.count(F.lit(1)).over(Window.partitionBy("_directory")),
    })
    missing = F.lit(False)
    for name in CATALOG.fieldNames():
        missing = missing | F.col(name).isNull()
    tests: dict[str, Column] = {
        "missing_field": missing,
        "bad_id": F.col("id") < 1,
        "bad_index": F.col("index") < 0,
        "empty_key": F.col("key") == "",
        "empty_directory": F.col("_directory") == "",
        "duplicate_key": F.col("_same_key") > 1,
        "duplicate_directory": F.col("_same_directory") > 1,
        "id_index_mismatch": F.col("id") != F.col("index") + 1,
        "empty_display_name": F.trim("display_name") == "",
    }
    if position_col in catalog.columns:
        tests["id_out_of_order"] = F.col("id") != F.col(position_col) + 1
        tests["index_out_of_order"] = F.col("index") != F.col(position_col)
    elif {"id_out_of_order", "index_out_of_order"} & wanted and not isinstance(rules, str):
        raise ValueError(f"the order rules need column {position_col!r}")
    single = rows.select(
        F.explode(F.array_compact(F.array(*[
            F.when(test, F.lit(rule)) for rule, test in tests.items() if rule in wanted
        ]))).alias("rule"),
        F.col("id").cast("bigint").alias("class_id"), F.col("key").alias("class_key"),
    )

    def contiguous(column: str, first: int) -> Column:
        n = F.count(F.lit(1))
        return ((F.count_distinct(column) == n) & (F.min(column) == first)
                & (F.max(column) == first + n - 1))

    whole = {"ids_not_contiguous": contiguous("id", 1), "indices_not_contiguous": contiguous("index", 0)}
    checks = [F.when(~ok, F.lit(rule)) for rule, ok in whole.items() if rule in wanted]
    if not checks:
        return single
    overall = catalog.agg(F.array_compact(F.array(*checks)).alias("_rules")).select(
        F.explode("_rules").alias("rule"),
        F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("string").alias("class_key"),
    )
    return single.unionByName(overall)


def whole_number(value: Column) -> Column:
    """Integer value of text, NULL when it is not one."""
    return F.when(
        F.regexp_like(value, F.lit(r"^\s*[+-]?[0-9]+\s*$")), F.trim(value).try_cast("bigint")
    )


def manifest_violations(manifest: DataFrame, catalog: DataFrame, files: DataFrame | None = None, *,
                        attributes: Sequence[str] = ("class_index", "class_key", "display_name",
                                                     "crop", "disease"),
                        path_col: str = "relative_path") -> DataFrame:
    """Rows ``(stage, code_order, code, relative_path[, line])`` for every broken manifest rule.

    ``attributes`` are compared with the catalog; a training run compares only
    ``class_index`` and ``class_key``. ``files`` is a listing with
    ``relative_path``; without it, existence is not checked. A row whose class
    is unknown is not also reported as a mismatch.
    """
    require_columns(manifest, ["split", "class_id", *attributes, path_col], "manifest")
    keep = [c for c in ("line",) if c in manifest.columns]
    source = {"class_index": F.col("index").cast("string"), "class_key": F.col("key"),
              "display_name": F.col("display_name"), "crop": F.col("crop"),
              "disease": F.col("disease")}
    known = catalog.select(
        F.col("id").cast("bigint").alias("_id"),
        *[source[a].alias(f"_expected_{a}") for a in attributes],
    )
    numbered = manifest.withColumn("_class", whole_number(F.col("class_id").cast("string")))
    joined = numbered.join(known, F.col("_class") == F.col("_id"), "left")
    bad_number = F.col("_class").isNull()
    if "class_index" in attributes:
        bad_number = bad_number | whole_number(F.col("class_index").cast("string")).isNull()
    unknown = ~bad_number & F.col("_id").isNull()
    differs = F.lit(False)
    for a in attributes:
        actual = F.col(a).cast("string")
        if a == "class_index":
            actual = whole_number(actual).cast("string")
        differs = differs | ~actual.eqNullSafe(F.col(f"_expected_{a}"))
    tests = {
        "bad_split": ~F.coalesce(F.col("split").isin(*C.SPLITS), F.lit(False)),
        "bad_number": bad_number,
        "unknown_class": unknown,
        "class_mismatch": ~bad_number & ~unknown & differs,
        "bad_extension": ~F.coalesce(text.file_extension(F.col(path_col)).isin(*C.IMAGE_EXTENSIONS), F.lit(False)),
    }
    found = joined.select(
        F.explode(F.array_compact(F.array(*[
            F.when(test, F.struct(F.lit(i).alias("code_order"), F.lit(code).alias("code")))
            for i, (code, test) in enumerate(tests.items(), start=1)
        ]))).alias("v"),
        path_col, *keep,
    ).select(F.lit(1).alias("stage"), "v.*", path_col, *keep)
    if files is None:
        return found
    missing = missing_files(manifest, files, path_col).select(
        F.lit(2).alias("stage"), F.lit(len(tests) + 1).alias("code_order"),
        F.lit("missing_file").alias("code"), path_col, *keep,
    )
    return found.unionByName(missing)


def first_violation(violations: DataFrame) -> DataFrame:
    """The violation a sequential reader would report: lowest stage, line, then check order."""
    order = [c for c in ("stage", "line", "code_order", "relative_path") if c in violations.columns]
    return violations.orderBy(*order).limit(1)


def unknown_classes(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """Manifest rows whose class id is not in the catalog."""
    known = catalog.select(F.col("id").cast("bigint").alias("_id"))
    return manifest.join(
        known, whole_number(F.col("class_id").cast("string")) == F.col("_id"), "left_anti"
    )


def missing_files(manifest: DataFrame, files: DataFrame, path_col: str = "relative_path") -> DataFrame:
    """Manifest rows without a file of the listing."""
    return manifest.join(files.select(path_col), path_col, "left_anti")


def classes_without_files(catalog: DataFrame, files: DataFrame,
                          path_col: str = "relative_path") -> DataFrame:
    """Catalog classes under whose directory the listing has no file.

    A file's ancestor directories are matched, so nested folders count.
    """
    pieces = F.split(path_col, "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(pieces, 1, n), "/"),
    )
    directories = files.select(F.explode(ancestors).alias("relative_directory")).distinct()
    return catalog.join(directories, "relative_directory", "left_anti").select(*catalog.columns)


def missing_directories(catalog: DataFrame, directories: DataFrame) -> DataFrame:
    """Catalog classes whose directory does not exist; ``directories`` may list empty ones too."""
    found = directories.select("relative_directory")
    return catalog.join(found, "relative_directory", "left_anti").select(*catalog.columns)


def manifest_class_counts(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows per catalog class, zeros kept; rows of unknown ids are not counted."""
    counts = manifest.groupBy(F.col("class_id").cast("bigint").alias("id")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    names = catalog.select(F.col("id").cast("bigint").alias("id"), "display_name")
    return names.join(counts, "id", "left").select(
        F.col("id").alias("class_id"), "display_name",
        F.coalesce("_n", F.lit(0)).alias("manifest_images"),
    )


def split_counts(manifest: DataFrame) -> DataFrame:
    """Rows per split of the closed domain, zeros kept; one aggregation, no join."""
    return manifest.agg(*[F.count_if(F.col("split") == s).alias(s) for s in C.SPLITS]).select(
        F.explode(F.array(*[
            F.struct(F.lit(s).alias("split"), F.col(s).alias("images")) for s in C.SPLITS
        ])).alias("r")
    ).select("r.*")


def class_split_matrix(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Class by split counts with zeros kept."""
    counts = manifest.groupBy(F.col("class_id").cast("bigint").alias("_id")).agg(
        *[F.count_if(F.col("split") == s).alias(s) for s in C.SPLITS]
    )
    return catalog.join(counts, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias("class_id"), F.col("key").alias("class_key"), "display_name",
        *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in C.SPLITS],
    )


def families(manifest: DataFrame) -> DataFrame:
    """One row per (class, family): image count and a bit set of the splits it occurs in."""
    bit = F.lit(0)
    for split, value in _SPLIT_BITS.items():
        bit = F.when(F.col("split") == split, F.lit(value)).otherwise(bit)
    return manifest.groupBy(F.col("class_id").cast("bigint").alias("class_id"), "family_id").agg(
        F.count(F.lit(1)).alias("images"), F.bit_or(bit).alias("split_bits"),
    )


def family_counts(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Distinct families per catalog class, zeros kept."""
    counts = families(manifest).groupBy(F.col("class_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return catalog.join(counts, F.col("id") == F.col("_id"), "left").select(
        F.col("id").alias("class_id"), F.col("key").alias("class_key"),
        F.coalesce("_n", F.lit(0)).alias("families"),
    )


def family_leakage(manifest: DataFrame) -> DataFrame:
    """(class, family) groups whose images are in more than one split."""
    return families(manifest).where(F.bit_count("split_bits") > 1).select(
        "class_id", "family_id", "images",
        F.array_join(F.array_compact(F.array(*[
            F.when(F.col("split_bits").bitwiseAND(F.lit(b)) != 0, F.lit(s))
            for s, b in _SPLIT_BITS.items()
        ])), ",").alias("splits"),
    )


def split_coverage(catalog: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows ``(rule, class_key, split)`` for empty splits and for classes absent from a split."""
    empty = split_counts(manifest).where("images = 0").select(
        F.lit("empty_split").alias("rule"), F.lit(None).cast("string").alias("class_key"), "split"
    )
    absent = class_split_matrix(catalog, manifest).select(
        F.lit("class_without_split").alias("rule"), "class_key",
        F.explode(F.array_compact(F.array(*[
            F.when(F.col(s) == 0, F.lit(s)) for s in C.SPLITS
        ]))).alias("split"),
    )
    return empty.unionByName(absent)


def check_manifest_header(manifest: DataFrame) -> DataFrame:
    """Fail when required manifest columns are missing; extra ones are kept."""
    return require_columns(manifest, MANIFEST.fieldNames(), "manifest")
