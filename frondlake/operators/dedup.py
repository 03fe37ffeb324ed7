"""Exact, visual and near duplicates.

Groups are only ever described by aggregates; members stay rows. A group of
copies holding a large share of all rows is therefore combined map-side, and
the largest groups reach their members by broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import vectors
from ..session import cut_lineage
from .rows import join_group_rows, merge_single_rows

_ORDER = ("class_id", "relative_path")


def _usable(records: DataFrame, key: str) -> DataFrame:
    usable = records.where(F.col(key).isNotNull())
    return usable.where("valid") if "valid" in records.columns else usable


def hash_groups(records: DataFrame, key: str, *, class_col: str = "class_id",
                order_by: Sequence[str] = _ORDER) -> DataFrame:
    """One row per distinct hash of the valid records.

    ``keep`` is the first record in ``order_by``; ``cross_class`` tells whether
    the group spans classes.
    """
    return _usable(records, key).groupBy(key).agg(
        F.count(F.lit(1)).alias("files"),
        (F.min(class_col) != F.max(class_col)).alias("cross_class"),
        F.min(F.struct(*order_by)).alias("keep"),
    )


def duplicate_groups(records: DataFrame, key: str, *, class_col: str = "class_id",
                     order_by: Sequence[str] = _ORDER) -> DataFrame:
    """Hash groups with more than one file, with the kept record's columns spread out."""
    return (
        hash_groups(records, key, class_col=class_col, order_by=order_by)
        .where("files > 1")
        .select(key, "files", "cross_class", *[F.col(f"keep.{c}").alias(f"keep_{c}") for c in order_by])
    )


def duplicate_summary(records: DataFrame, key: str, *, class_col: str = "class_id") -> DataFrame:
    """One row: distinct hashes, duplicate groups, redundant files, groups across and within classes."""
    return (
        _usable(records, key).groupBy(key)
        .agg(F.count(F.lit(1)).alias("files"),
             (F.min(class_col) != F.max(class_col)).alias("cross_class"))
        .agg(
            F.count(F.lit(1)).alias("unique_hashes"),
            F.count_if(F.col("files") > 1).alias("duplicate_groups"),
            F.coalesce(F.sum(F.col("files") - 1), F.lit(0)).alias("duplicate_files"),
            F.count_if((F.col("files") > 1) & F.col("cross_class")).alias("cross_class_groups"),
            F.count_if((F.col("files") > 1) & ~F.col("cross_class")).alias("within_class_groups"),
        )
    )


def cross_class_examples(records: DataFrame, key: str, *, count: int = C.EXAMPLE_COUNT,
                         class_col: str = "class_id", order_by: Sequence[str] = _ORDER) -> DataFrame:
    """Members of the first ``count`` groups that span classes, numbered by ``example``."""
    first = (
        hash_groups(records, key, class_col=class_col, order_by=order_by)
        .where((F.col("files") > 1) & F.col("cross_class"))
        .orderBy("keep").limit(count)
    )
    numbered = first.agg(F.array_sort(F.collect_list(F.struct("keep", key))).alias("g")).select(
        F.posexplode("g").alias("at", "g")
    ).select((F.col("at") + 1).alias("example"), F.col(f"g.{key}").alias(key))
    # The example list has at most `count` rows, so it is safe to broadcast.
    return _usable(records, key).join(F.broadcast(numbered), key).select("example", key, *order_by)


def dedup_plan(records: DataFrame, key: str, *, class_col: str = "class_id",
               order_by: Sequence[str] = _ORDER) -> DataFrame:
    """Every member of a duplicate group with its status, ``KEEP`` or ``DUPLICATE``.

    Nothing is deleted. ``order_by`` must identify a record.
    """
    groups = hash_groups(records, key, class_col=class_col, order_by=order_by).where("files > 1")
    return (
        join_group_rows(_usable(records, key), groups.select(key, "files", "keep"), key, "files")
        .select(
            key, *order_by, "files",
            F.when(F.struct(*order_by) == F.col("keep"), "KEEP").otherwise("DUPLICATE").alias("status"),
        )
    )


def removal_plan(records: DataFrame, *, exact_key: str = "sha256", visual_key: str = "dhash",
                 order_by: Sequence[str] = _ORDER) -> DataFrame:
    """Every file that duplicate removal would delete, with the file kept in its place.

    Exact copies go first (``stage`` is ``exact``); visual duplicates are judged among
    the files that remain, so none is deleted on account of a file that goes itself
    and none is listed twice. ``files`` is the size of the group in its stage. Invalid
    records and records without a hash stay. ``order_by`` must identify a file; the same
    file listed twice is no duplicate of itself.

    Groups travel as keys: one narrow row per distinct exact hash is written to the
    checkpoint folder and carries the visual hash of the record it keeps.
    """
    usable = records.where("valid") if "valid" in records.columns else records
    row = F.struct(*order_by, F.col(visual_key).alias("_visual"))
    exact = cut_lineage(usable.where(F.col(exact_key).isNotNull()).groupBy(F.col(exact_key).alias("_hash")).agg(
        F.count(F.lit(1)).alias("files"), F.min(row).alias("keep")))
    bare = usable.where(F.col(exact_key).isNull()).select(F.col(visual_key).alias("_visual"), *order_by)
    remaining = exact.select("keep._visual", *[F.col(f"keep.{c}").alias(c) for c in order_by]).unionByName(bare).where(
        "_visual is not null")
    visual = remaining.groupBy("_visual").agg(
        F.count(F.lit(1)).alias("files"), F.min(F.struct(*order_by)).alias("keep")).where("files > 1")

    def gone(members: DataFrame, groups: DataFrame, key: str, stage: str) -> DataFrame:
        joined = join_group_rows(members.select(key, *order_by), groups.select(key, "files", "keep"), key, "files")
        first = F.struct(*[F.col(f"keep.{c}").alias(c) for c in order_by])
        return joined.where(F.struct(*order_by) != first).select(
            F.lit(stage).alias("stage"), *order_by, *[F.col(f"keep.{c}").alias(f"keep_{c}") for c in order_by], "files")

    members = usable.where(F.col(exact_key).isNotNull()).withColumn("_hash", F.col(exact_key))
    return gone(members, exact.where("files > 1"), "_hash", "exact").unionByName(
        gone(remaining, visual, "_visual", "visual"))


def removal_counts(plan: DataFrame) -> DataFrame:
    """One row: files that each stage of a removal plan deletes."""
    return plan.agg(*[F.count_if(F.col("stage") == s).alias(f"{s}_removed") for s in ("exact", "visual")])


def example_classes(examples: DataFrame, key: str, *, class_col: str = "class_id",
                    id_col: str = "relative_path") -> DataFrame:
    """Cross-class examples per group and class: number of files and the first of them.

    Its size is bounded by examples times classes, whatever the groups' sizes.
    """
    return examples.groupBy("example", key, class_col).agg(
        F.count(F.lit(1)).alias("files"), F.min(id_col).alias("first_file"))


def keep_first(records: DataFrame, key: str, *, order_by: Sequence[str] = _ORDER) -> DataFrame:
    """All records but the redundant members of duplicate groups.

    Invalid records and records without a hash belong to no group and stay.
    One aggregation: the smallest record of each hash carries its row along.
    """
    columns = records.columns
    grouped = F.col(key).isNotNull()
    if "valid" in columns:
        grouped = grouped & F.col("valid")
    row = F.struct(*order_by, *[c for c in columns if c not in order_by])
    first = records.where(grouped).groupBy(key).agg(F.min_by(row, F.struct(*order_by)).alias("_row"))
    kept = first.select(*[F.col(f"_row.{c}").alias(c) for c in columns])
    return kept.unionByName(records.where(~F.coalesce(grouped, F.lit(False))))


def _masks(bits: Sequence[int], parts: int) -> list[list[int]]:
    """Deal bit positions into ``parts`` runs of nearly equal length."""
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [list(bits[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _mask(bits: Sequence[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def _flips(bits: Sequence[int]) -> str:
    """SQL array of 0 and every single bit. SQL text, because it holds a literal per bit."""
    return "array(" + ", ".join(f"{_signed(f)}L" for f in [0, *[1 << b for b in bits]]) + ")"


def _probes(part: int, bits: Sequence[int]) -> str:
    """SQL for the masked hash and its single-bit neighbours as ``(part, flip, probe)``."""
    return (f"transform({_flips(bits)}, (f, i) -> struct({part} AS part, int(i) AS flip, "
            f"(hash & {_mask(bits)}L) ^ f AS probe))")


def _by_part(texts: Sequence[str]) -> str:
    return "CASE part " + " ".join(f"WHEN {p} THEN {t}" for p, t in enumerate(texts)) + " END"


def _canonical(a: str, b: str, flip: str) -> Column:
    """True for exactly one of the probes at which two values within distance 2 meet."""
    fa, fb = F.col(f"{a}.{flip}"), F.col(f"{b}.{flip}")
    return (fa < fb) | ((fa == 0) & (fb == 0))


def _first_part(difference: Column, part: Column, groups: Sequence[Sequence[int]]) -> Column:
    """True when no earlier group of bits differs in two or fewer places."""
    test = F.lit(True)
    for number, bits in enumerate(groups):
        far = F.bit_count(difference.bitwiseAND(F.lit(_mask(bits)).cast("bigint"))) > 2
        test = test & ((part <= number) | far)
    return test


def near_duplicates(records: DataFrame, *, hash_col: str = "dhash", class_col: str = "class_id",
                    id_col: str = "relative_path", bits: int = 64,
                    max_distance: int = C.HAMMING_LIMIT,
                    hot_value_rows: int | None = 200) -> DataFrame:
    """Pairs of one class whose hashes differ in at most ``max_distance`` bits.

    Members of equal-hash groups take part in no pair. The result is exact:

    * With ``max_distance // 3 + 1`` parts, two hashes within the limit differ in
      at most two bits of some part. Each hash is looked up under every part's
      value and under that value with one bit flipped, so such two hashes share
      a probe, and an equi-join on (class, part, probe) finds them.
    * A pair may meet at several probes and parts; the join condition accepts
      one of them, so no distinct is needed afterwards.
    * Part values shared by more than ``hot_value_rows`` rows (flat images) leave
      that join. Their rows meet the rows of every value within two bits by
      probing the remaining bits in the same way. Hashes are distinct here, so
      the remaining bits really divide them. Their number has no limit.
    """
    single = _single_hashes(records, hash_col, class_col, id_col)
    found = _near_hashes(single, bits, max_distance, hot_value_rows)
    left = single.select(F.col("hash").alias("hash_a"), F.col("id").alias("_a"))
    right = single.select(F.col("hash").alias("hash_b"), F.col("id").alias("_b"))
    return (
        found.join(left, "hash_a").join(right, "hash_b")
        .select("class_id", F.least("_a", "_b").alias("file_a"),
                F.greatest("_a", "_b").alias("file_b"), "hamming_distance")
    )


def _near_hashes(single: DataFrame, bits: int, max_distance: int, hot_value_rows: int | None,
                 carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct hashes of one class within the distance, each once; ``carry`` columns come along from both."""
    if not 0 <= max_distance <= bits <= 64:
        raise ValueError("0 <= max_distance <= bits <= 64 is required")
    every = list(range(bits))
    parts = min(max_distance // 3 + 1, bits)
    groups = _masks(every, parts)
    values = ", ".join(f"struct({p} AS part, hash & {_mask(g)}L AS value)" for p, g in enumerate(groups))
    placed = single.selectExpr("class_id", "hash", *carry, f"inline(array({values}))")

    def accepted(difference: Column) -> Column:
        return (F.bit_count(difference) <= max_distance) & _first_part(difference, F.col("a.part"), groups)

    def equal(*names: str) -> Column:
        return reduce(and_, [F.col(f"a.{n}") == F.col(f"b.{n}") for n in names])

    difference = F.col("a.hash").bitwiseXOR(F.col("b.hash"))
    pair = (
        F.col("a.class_id").alias("class_id"), F.col("a.hash").alias("hash_a"),
        F.col("b.hash").alias("hash_b"), F.bit_count(difference).alias("hamming_distance"),
        *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in carry],
    )
    # With one part a value is a whole hash, and those are distinct.
    refine = hot_value_rows is not None and parts > 1
    if refine:
        hot = (
            placed.groupBy("class_id", "part", "value").agg(F.count(F.lit(1)).alias("_n"))
            .where(F.col("_n") > hot_value_rows)
            .select("class_id", "part", "value", F.lit(True).alias("hot"))
        )
        placed = placed.join(hot, ["class_id", "part", "value"], "left").withColumn(
            "hot", F.coalesce("hot", F.lit(False)))
        cold = placed.where(~F.col("hot"))
    else:
        cold = placed

    probed = cold.selectExpr(
        "class_id", "hash", *carry, f"inline({_by_part([_probes(p, g) for p, g in enumerate(groups)])})")
    # Merge join: its sides are many times larger than what Spark estimates for them.
    found = probed.alias("a").join(
        probed.alias("b").hint("merge"),
        equal("class_id", "part", "probe") & (F.col("a.hash") < F.col("b.hash"))
        & _canonical("a", "b", "flip") & accepted(difference),
    ).select(*pair)

    if refine:
        ball = _by_part([
            f"array_distinct(flatten(transform({_flips(g)}, f -> transform({_flips(g)}, h -> f ^ h))))"
            for g in groups
        ])
        around = hot.selectExpr("class_id", "part", "value AS center", f"explode({ball}) AS offset").selectExpr(
            "class_id", "part", "center", "center ^ offset AS value")
        rest = [[b for b in every if b not in g] for g in groups]
        finer = [_masks(r, min(parts, len(r))) for r in rest]
        subprobes = _by_part([
            "concat(" + ", ".join(_probes(q, g) for q, g in enumerate(sub)) + ")" for sub in finer])
        sub = (f"inline({subprobes}) AS (subpart, flip, probe)",)
        centers = placed.where("hot").selectExpr("class_id", "part", "value AS center", "hash", *carry, *sub)
        neighbours = placed.join(around.hint("merge"), ["class_id", "part", "value"]).selectExpr(
            "class_id", "part", "center", "value", "hot", "hash", *carry, *sub)
        first_sub = reduce(or_, [
            (F.col("a.part") == p) & _first_part(difference, F.col("a.subpart"), g)
            for p, g in enumerate(finer)
        ])
        # A pair of one hot value is ordered by hash, a pair of two hot values by value.
        same = F.col("b.value") == F.col("b.center")
        oriented = F.when(same, F.col("a.hash") < F.col("b.hash")).otherwise(
            ~F.col("b.hot") | (F.col("b.center") < F.col("b.value")))
        found = found.unionByName(
            centers.alias("a").join(
                neighbours.alias("b").hint("merge"),
                equal("class_id", "part", "center", "subpart", "probe") & oriented
                & _canonical("a", "b", "flip") & first_sub & accepted(difference),
            ).select(*pair)
        )

    return found


def near_duplicate_classes(records: DataFrame, *, hash_col: str = "dhash", class_col: str = "class_id",
                           id_col: str = "relative_path", bits: int = 64, max_distance: int = C.HAMMING_LIMIT,
                           hot_value_rows: int | None = 200) -> DataFrame:
    """One row per record with a near duplicate: ``class_id``, the record, ``near_class`` and its number of ``links``.

    ``near_class`` is the smallest id among the records that links connect. The pairs
    of ``near_duplicates`` are made in the join and summed up there, per record and per
    class of records, and never stored or shuffled. Classes grow in rounds: each one
    learns the smallest class it has a link to and joins it if that is smaller; the
    number of classes at least halves around every local minimum, so a few rounds do.
    """
    single = cut_lineage(_single_hashes(records, hash_col, class_col, id_col))
    ends = F.explode(F.array("hash_a", "hash_b")).alias("hash")
    links = _near_hashes(single, bits, max_distance, hot_value_rows).select(ends).groupBy("hash").agg(
        F.count(F.lit(1)).alias("links"))
    nodes = cut_lineage(single.join(links, "hash").withColumn("root", F.col("hash")))
    while True:
        met = _near_hashes(nodes.select("class_id", "hash", "root"), bits, max_distance, hot_value_rows, ["root"]).where(
            "root_a <> root_b")
        heard = met.select(F.explode(F.array(
            F.struct(F.col("root_a").alias("root"), F.col("root_b").alias("next")),
            F.struct(F.col("root_b").alias("root"), F.col("root_a").alias("next")))).alias("x")).groupBy("x.root").agg(
            F.min("x.next").alias("next"))
        parent = cut_lineage(heard.where("next < root"))
        if parent.isEmpty():
            break
        while True:  # each class takes the end of its chain
            further = parent.select(F.col("root").alias("next"), F.col("next").alias("end"))
            longer = cut_lineage(parent.join(further, "next", "left").select(
                "root", F.coalesce("end", "next").alias("next"), F.col("end").isNotNull().alias("moved")))
            parent = longer.select("root", "next")
            if longer.where("moved").isEmpty():
                break
        nodes = cut_lineage(nodes.join(parent, "root", "left").withColumn("root", F.coalesce("next", "root")).drop("next"))
    names = nodes.groupBy("root").agg(F.min("id").alias("near_class"))
    return nodes.join(names, "root").select(
        "class_id", F.col("id").alias(id_col), "near_class", F.col("links").cast("bigint").alias("links"))


def near_duplicate_counts(pairs: DataFrame, class_col: str = "class_id") -> DataFrame:
    """Pairs per class and the first of them as an example.

    The pairs of a dense cluster are counted where the join makes them and are
    neither stored nor shuffled.
    """
    first = F.min(F.struct("file_a", "file_b", "hamming_distance"))
    return pairs.groupBy(class_col).agg(F.count(F.lit(1)).alias("pairs"), first.alias("_first")).select(
        class_col, "pairs", "_first.*")


def _single_hashes(records: DataFrame, hash_col: str, class_col: str, id_col: str) -> DataFrame:
    return (
        _usable(records, hash_col)
        .groupBy(F.col(hash_col).cast("bigint").alias("hash"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min(class_col).alias("class_id"), F.min(id_col).alias("id"))
        .where("_n = 1").drop("_n")
    )


def duplicate_report(records: DataFrame, *, exact_key: str = "sha256", visual_key: str = "dhash",
                     class_col: str = "class_id") -> DataFrame:
    """Exact and visual summaries as one row with ``exact_`` and ``visual_`` prefixes."""
    def prefixed(key: str, prefix: str) -> DataFrame:
        summary = duplicate_summary(records, key, class_col=class_col)
        return summary.select(*[F.col(c).alias(f"{prefix}_{c}") for c in summary.columns])

    return merge_single_rows(prefixed(exact_key, "exact"), prefixed(visual_key, "visual"))


def with_difference_hash(rows: DataFrame, grid: str, *, columns: int = C.HASH_SIDE + 1,
                         rows_per_grid: int = C.HASH_SIDE, into: str = "dhash") -> DataFrame:
    """Add the difference hash of a row-major gray grid column."""
    return rows.withColumn(into, vectors.difference_hash(F.col(grid), columns, rows_per_grid))
