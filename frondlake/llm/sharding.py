"""Shards balanced in bytes, tokens and rows at once, by vector bin packing.

Groups of equal texts are packed, not rows. A group whose share of some measure
exceeds ``1 / (shards * FINE)`` is an item of its own (at most
``3 * shards * FINE`` of them, by arithmetic); all others are bundled by hash
into ``BUNDLES`` items. Each item, largest first, goes to the shard where the dot
product of its vector with the residual capacity is highest; a few exchanges even
out what the sum of measures hid. Items are few
whatever the size of the data, so the driver packs them; the resulting plan
places every row by an expression and a broadcast of the large groups.

A group larger than a whole shard cannot stay together if the shards are to be
near equal: it is cut by row into pieces of at most half a shard. All other
groups stay together.

Rows: null text counts as an empty text and is placed with the empty texts.
Null keys and repeated rows are placed like any other row, each with a slot of
its own. Very long texts are measured whole and never leave the task that reads them. An
empty table gives an empty table. ``assign`` returns the key, the measures and what
``extra`` names; ``place``, ``with_slots`` and ``write_shards`` pass columns unchanged, whatever
their names, and the added ``shard`` and ``slot`` replace columns of the same name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ordered import free_names

FINE = 256
BUNDLES = 4096
SLOT_ROWS = 1_000_000
EXCHANGES = 200
CLOSE = 0.001
MEASURES = ("size", "tokens", "one")


@dataclass(frozen=True)
class Packing:
    """Shard of each bundle, and (group, piece) -> shard of the large groups."""

    shards: int
    bundles: tuple[int, ...]
    large: tuple[tuple[str, int, int], ...]
    pieces: tuple[tuple[str, int], ...]


def pack(items: list[tuple[float, ...]], shards: int) -> list[int]:
    """Shard of each item; vectors are shares of the totals. Ties go to the emptier, then the lower shard."""
    capacity = [[1.0 / shards] * len(items[0]) for _ in range(shards)] if items else []
    placed = [0] * len(items)
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i]), -sum(items[i]), i)):
        item = items[i]

        def fit(shard: int) -> tuple[float, float, int]:
            left = capacity[shard]
            return round(sum(a * b for a, b in zip(item, left)), 15), round(sum(left), 15), -shard

        best = max(range(shards), key=fit)
        placed[i] = best
        capacity[best] = [left - own for left, own in zip(capacity[best], item)]
    return even_out(items, placed, shards)


def even_out(items: list[tuple[float, ...]], placed: list[int], shards: int) -> list[int]:
    """Exchange items between the two shards furthest apart in a measure while that lessens the imbalance."""
    if not items:
        return placed
    vectors, at = np.array(items), np.array(placed)
    for _ in range(EXCHANGES):
        load = np.stack([vectors[at == s].sum(0) for s in range(shards)]) - vectors.sum(0) / shards
        if np.abs(load).max() * shards < CLOSE:
            break
        k = int(np.abs(load).max(0).argmax())
        high, low = int(load[:, k].argmax()), int(load[:, k].argmin())
        give, take = np.flatnonzero(at == high), np.flatnonzero(at == low)
        # Nothing against one item, or one item against another; a zero row stands for nothing.
        change = np.vstack([vectors[give], [0.0] * vectors.shape[1]])[:, None] - np.vstack(
            [vectors[take], [0.0] * vectors.shape[1]])[None]
        after = ((load[high] - change) ** 2).sum(-1) + ((load[low] + change) ** 2).sum(-1)
        i, j = np.unravel_index(after.argmin(), after.shape)
        if after[i, j] >= (load[high] ** 2).sum() + (load[low] ** 2).sum() - 1e-15:
            break
        at[give[i:i + 1]] = low
        at[take[j:j + 1]] = high
    return [int(s) for s in at]


def measured(docs: DataFrame, text: str = "text") -> list[Column]:
    """Columns that describe a row: group, size in bytes plus one, words, one."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.md5(F.encode(whole, "UTF-8")).alias("text_group"), (F.octet_length(whole) + 1).cast("long").alias("size"),
            F.regexp_count(whole, F.lit(r"[^ \x09-\x0D]+")).cast("long").alias("tokens"), F.lit(1).cast("long").alias("one")]


def _bundle(group: str) -> Column:
    return F.pmod(F.xxhash64(group), F.lit(BUNDLES)).cast("int")


def plan(rows: DataFrame, shards: int) -> Packing:
    """Packing for rows with the columns of ``measured``."""
    total = rows.agg(*[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES]).first()
    share = [F.col(m) / F.lit(float(max(total[m], 1))) for m in MEASURES]
    groups = rows.groupBy("text_group").agg(*[F.sum(m).alias(m) for m in MEASURES])
    large = F.greatest(*share) > 1.0 / (shards * FINE)
    items = groups.select(F.when(large, F.col("text_group")).alias("large"),
                          F.when(~large, _bundle("text_group")).alias("bundle"), *MEASURES).groupBy(
        "large", "bundle").agg(*[F.sum(m).alias(m) for m in MEASURES]).collect()  # BUNDLES + 3 * shards * FINE at most
    names, vectors, pieces = [], [], []
    for item in sorted(items, key=lambda r: (r["bundle"] is None, r["bundle"], r["large"])):
        vector = [item[m] / max(total[m], 1) for m in MEASURES]
        parts = math.ceil(2 * shards * max(vector)) if max(vector) > 1.0 / shards else 1
        if parts > 1:
            pieces.append((item["large"], parts))
        for part in range(parts):
            names.append((item["large"], item["bundle"], part))
            vectors.append(tuple(v / parts for v in vector))
    shard = pack(vectors, shards)
    bundles = [0] * BUNDLES
    for (_, bundle, _), at in zip(names, shard):
        if bundle is not None:
            bundles[bundle] = at
    return Packing(shards, tuple(bundles), tuple((g, part, at) for (g, _, part), at in zip(names, shard) if g),
                   tuple(pieces))


def place(rows: DataFrame, packing: Packing, key: str = "doc_id", group: str = "text_group") -> DataFrame:
    """Add ``shard`` to rows whose column ``group`` is that of ``measured``; nothing is shuffled."""
    spark = rows.sparkSession
    parts = dict(packing.pieces)
    own, count, to = free_names([*rows.columns, "shard"], "own", "count", "to")
    known = spark.createDataFrame([(g, p, s, parts.get(g, 1)) for g, p, s in packing.large] or [(None, 0, 0, 1)],
                                  f"{own} string, piece int, shard int, {count} int")
    grouped = known.where(F.col(own).isNotNull()).groupBy(own, count).agg(F.array_sort(F.collect_list(
        F.struct("piece", "shard"))).alias(to))  # a large group has few pieces
    joined = rows.drop("shard").join(F.broadcast(grouped), F.col(group) == F.col(own), "left")
    piece = F.pmod(F.xxhash64(F.lit("piece"), key), F.col(count)).cast("int")
    bundle = F.get(F.array(*map(F.lit, packing.bundles)), _bundle(group))
    return joined.withColumn("shard", F.coalesce(F.get(F.col(to), piece)["shard"], bundle)).drop(own, count, to)


def with_slots(rows: DataFrame, count: int, key: str = "doc_id") -> DataFrame:
    """Add ``slot``: gapless numbers from 0 in each shard.

    A shard is cut by hash into strips; strips are numbered from the sums of
    those before them, and rows within their strip, so no task orders a shard.
    """
    strips = max(64, count // SLOT_ROWS)
    strip, number, start, row = free_names([*rows.columns, "slot"], "strip", "number", "start", "row")
    cut = rows.drop("slot").withColumn(strip, F.pmod(F.xxhash64(F.lit("slot"), key), F.lit(strips)))
    before = Window.partitionBy("shard").orderBy(strip).rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("shard", strip).agg(F.count(F.lit(1)).alias(number)).select(
        "shard", strip, F.coalesce(F.sum(number).over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy("shard", strip).orderBy(F.col(key).asc_nulls_first(), "text_group")
    numbered = cut.withColumn(row, F.row_number().over(inside))
    return numbered.join(starts, ["shard", strip]).withColumn(
        "slot", (F.col(start) + F.col(row) - 1).cast("long")).drop(strip, row, start)


def assign(docs: DataFrame, shards: int = 8, text: str = "text", key: str = "doc_id",
           extra: list[Column] | None = None) -> DataFrame:
    """Key, measures, ``extra`` columns, ``shard`` and ``slot`` of every row; the texts are read once."""
    rows = cut_lineage(docs.select(F.col(key), *measured(docs, text), *(extra or [])))
    packing = plan(rows, shards)
    return with_slots(cut_lineage(place(rows, packing, key)), rows.count(), key)


def write_shards(docs: DataFrame, path: str, shards: int = 8, text: str = "text", key: str = "doc_id") -> None:
    """Write whole rows below ``path/shard=N``; texts are not shuffled, files follow the input's partitions."""
    (group,) = free_names([*docs.columns, "shard"], "text_group")
    packing = plan(docs.select(*measured(docs, text)), shards)
    grouped = docs.withColumn(group, measured(docs, text)[0])
    place(grouped, packing, key, group).drop(group).write.partitionBy("shard").parquet(path)
