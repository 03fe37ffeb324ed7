"""Near-duplicate classes: consistent weighted sampling over TF-IDF shingles, banded and verified.

Words are separated by ASCII white space after lower-casing; a shingle is five
consecutive words. The weight of a shingle in a text is TF-IDF: its count times
``ln(1 + N / max(df, LEAST))``, ``df`` being the exact number of documents that hold it, for every
shingle. ``LEAST`` is 2: what two texts share stands in two at least, so what stands in one alone
weighs the same.

Frequencies are counted by a shuffle. Texts are stored in blocks of about 1 MB; a block sends
each of its distinct shingles once, with the number of its texts that hold it, to a bucket of
the shingle's hash, where the numbers are summed. Sums above ``LEAST`` go back to their blocks and
meet the texts there. A shingle of every text thus costs one entry a block, and neither the driver
nor a task sees the shingles of the whole table.

Improved consistent weighted sampling gives ``BANDS * ROWS`` samples a text; texts that
agree in all samples of a band meet in a bucket. Buckets are never
expanded into pairs: every member is compared with the bucket's representative,
the member that shares most buckets. Comparisons are exact weighted Jaccard
similarities of whole texts; texts are linked if it is at least ``threshold``. With
``plain`` (off by default) they are also linked if the plain Jaccard similarity of their shingle
sets is, for which as many bands of min-hashes (the same with unit weights) are added.
Members the representative left meet ``CENTRAL`` more of the bucket. What they may
still be linked to is found by exact bounds (``undecided``) and compared too, a few
pairs of each text first, until no such pair lies in two classes. Classes are the
connected components of the links, found by label propagation with pointer
jumping, every step stored in the checkpoint folder.

Copies of a text (equal words) are one node from the start and get their class
back by a join that Spark can split.

Rows: null text is never a copy and is its own class; texts without words are
copies of each other; texts of fewer than five words have only exact copies.
The class id is the smallest key of the class (null only if all are null).
Repeated rows are in one class; the filter keeps one of them. An empty table
gives an empty table. Other columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage, discard, shuffles_released
from .arrow import output_schema, replace_column, slices, text_bytes, tidy
from .ordered import free_names

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
RARE = 1 / 100
LEAST = 2
COMMON = 32
CENTRAL = 8
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
SEED = 20_240_601
TABLE = 1 << 16

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)
_BASE = np.uint64(0x100000001B3)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:  # doubling: base ** (done + i) = base ** done * base ** i, modulo 2 ** 64
        more = min(done, n - done)
        out[done:done + more] = out[:more] * (out[done - 1:done] * base)
        done += more
    return out


class Words:
    """Hashes of all words of a batch of texts, and the text each belongs to."""

    def __init__(self):
        self.powers = _powers(1 << 12, _BASE)

    def _piece(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word of some bytes."""
        gap = (data == 32) | ((data >= 9) & (data <= 13))
        inside = ~gap
        starts = np.flatnonzero(inside & np.concatenate(([True], gap[:-1])))
        if not len(starts):
            return starts, np.zeros(0, np.uint64)
        place = np.zeros(len(data), np.int64)
        place[starts] = np.diff(starts, prepend=0)
        place = np.arange(len(data)) - np.cumsum(place)
        longest = int(place.max()) + 1
        if longest > len(self.powers):
            self.powers = _powers(longest, _BASE)
        values = (data.astype(np.uint64) + np.uint64(1)) * self.powers[np.maximum(place, 0)]
        values[gap] = 0
        return starts, mix(np.add.reduceat(values, starts))

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ends`` are row offsets of ``data``; a row border also ends a word."""
        hashes, rows = [], []
        for first in range(len(ends) - 1):  # rows are joined up to SLICE_BYTES by the caller; long rows are cut here
            if ends[first + 1] - ends[first] > 4 * SLICE_BYTES:
                break
        else:
            spaced = np.full(len(data) + len(ends) - 1, 32, np.uint8)
            row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            spaced[np.arange(len(data)) + row] = data
            starts, found = self._piece(spaced)
            return found, np.searchsorted(ends[1:] + np.arange(1, len(ends)), starts, "right")
        for row in range(len(ends) - 1):
            at, end = int(ends[row]), int(ends[row + 1])
            while at < end:
                stop = min(end, at + 4 * SLICE_BYTES)
                while stop < end and not (data[stop] == 32 or 9 <= data[stop] <= 13):
                    stop += 1
                found = self._piece(data[at:stop])[1]
                hashes.append(found)
                rows.append(np.full(len(found), row))
                at = stop
        return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, int))


def shingles(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), ordered by row and shingle."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, int)
    value = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        value = value * _MIX + words[i:i + n]
    inside = rows[:n] == rows[SHINGLE - 1:]
    row, value = rows[:n][inside], mix(value[inside])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (value[1:] != value[:-1])))[:len(row)])
    return row[first], value[first], np.diff(np.append(first, len(row)))


def weights(count: np.ndarray, df: np.ndarray, total: int) -> np.ndarray:
    """TF-IDF weights of shingles from their counts in the text and their exact document frequencies."""
    return count * np.log1p(total / np.maximum(df, LEAST))


class Sampler:
    """Improved consistent weighted sampling with tabulated gamma and uniform variates."""

    def __init__(self, samples: int = BANDS * ROWS):
        draw = np.random.Generator(np.random.PCG64(SEED))
        self.rate = draw.gamma(2.0, size=TABLE).astype(np.float32)
        self.inverse = (1 / self.rate).astype(np.float32)
        self.log_c = np.log(draw.gamma(2.0, size=TABLE)).astype(np.float32)
        self.shift = draw.random(TABLE).astype(np.float32)
        self.seeds = draw.integers(1, 1 << 63, samples, dtype=np.uint64)
        self.plain_seeds = draw.integers(1, 1 << 63, samples, dtype=np.uint64)

    def __call__(self, row_starts: np.ndarray, value: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Samples (row, sample) as 64-bit values; rows are runs of elements ordered by value."""
        log_w = np.log(weight).astype(np.float32)
        sizes = np.diff(np.append(row_starts, len(value)))
        out = np.empty((len(row_starts), len(self.seeds)), np.uint64)
        low = np.uint64(TABLE - 1)
        for k, seed in enumerate(self.seeds):
            x = (value ^ seed) * _MIX
            x ^= x >> np.uint64(32)
            rate = self.rate[x & low]
            step = np.floor(log_w * self.inverse[x & low] + self.shift[(x >> np.uint64(16)) & low])
            score = self.log_c[(x >> np.uint64(48))] - rate * (step - self.shift[(x >> np.uint64(16)) & low] + 1)
            least = np.minimum.reduceat(score, row_starts)
            at = np.flatnonzero(score == np.repeat(least, sizes))
            first = at[np.searchsorted(at, row_starts)]  # ties go to the smallest value
            out[:, k] = mix(value[first] + step[first].astype(np.int64).astype(np.uint64) * _MIX2)
        return out

    def plain(self, row_starts: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Samples of the sets without weights: the least of as many hashes of the elements."""
        out = np.empty((len(row_starts), len(self.plain_seeds)), np.uint64)
        for k, seed in enumerate(self.plain_seeds):
            x = (value ^ seed) * _MIX
            x ^= x >> np.uint64(32)
            x *= _MIX2
            out[:, k] = np.minimum.reduceat(x, row_starts)
        return out


def _batches(batches: Iterator[pa.RecordBatch], text: str):
    words = Words()
    for batch in batches:
        column = batch.column(text)
        for low, high in slices(column, SLICE_BYTES):
            part = batch.slice(low, high - low)
            yield part, *words(*text_bytes(part.column(text)))


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_t")


def stamped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, tag, null, text, block): lower-cased texts; a block is a run of rows of about ``SLICE_BYTES``."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("tag"), F.col(text).isNull().alias("null"),
                       _lowered(text).alias("text"))

    def run(batches):
        for batch in batches:
            for low, high in slices(batch.column("text"), SLICE_BYTES):
                block = uuid.uuid4().int >> 65
                yield replace_column(batch.slice(low, high - low), {"block": pa.array(np.full(high - low, block, np.int64))})
        tidy()

    return cut_lineage(rows.mapInArrow(run, output_schema(rows, {"block": T.LongType()})), "zstd")  # stored: names of blocks are random


def spread(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each shingle, ascending with it, and its name: 48 bits of the hash below the bucket's 16."""
    bucket = (value >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return bucket.astype(np.int64), value & np.uint64((1 << 48) - 1) | bucket << np.uint64(48)


def pack(names: np.ndarray) -> bytes:
    """The 48 bits of names that stand in one bucket."""
    return names.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(column: pa.Array | pa.ChunkedArray, bucket: pa.Array | pa.ChunkedArray) -> np.ndarray:
    data = column.to_pylist()
    names = np.zeros((sum(map(len, data)) // 6, 8), np.uint8)
    names[:, :6] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
    return names.view(np.uint64).ravel() | np.repeat(bucket.to_numpy().astype(np.uint64) << np.uint64(48), [len(x) // 6 for x in data])


def numbers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32)


def bucket_count(stored: DataFrame) -> int:
    size = stored.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(1, size // CHUNK_BYTES), 1 << 16)


def counted(stored: DataFrame, buckets: int, least: int = 1) -> DataFrame:
    """(block, bucket, shingle, df): per block its distinct shingles that at least ``least`` of all texts hold.

    ``shingle`` and ``df`` are packed arrays. Shingles meet in buckets by their hash, each block
    sending a shingle once; a bucket holds those of about ``CHUNK_BYTES`` of text.
    """
    def packed(batches):
        for part, hashes, row in _batches(batches, "text"):
            blocks = part.column("block").to_numpy()
            owner, value, _ = shingles(hashes, row)
            starts = np.flatnonzero(np.concatenate(([True], blocks[1:] != blocks[:-1])))
            cuts = np.append(np.searchsorted(owner, starts), len(value))
            for start, low, high in zip(starts, cuts[:-1], cuts[1:]):
                found, n = np.unique(value[low:high], return_counts=True)
                bucket, names = spread(found, buckets)
                begin = np.flatnonzero(np.diff(bucket, prepend=-1))
                ends = np.append(begin[1:], len(found))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(begin), blocks[start])), pa.array(bucket[begin]),
                    pa.array([pack(names[i:j]) for i, j in zip(begin, ends)], pa.binary()),
                    pa.array([n[i:j].astype(np.int32).tobytes() for i, j in zip(begin, ends)], pa.binary())],
                    ["block", "bucket", "shingle", "n"])
        tidy()

    def summed(table: pa.Table) -> pa.Table:
        name, n = unpack(table.column("shingle"), table.column("bucket")), numbers(table.column("n"))
        order = np.argsort(name)
        first = np.flatnonzero(np.diff(name[order], prepend=~name[order[:1]]))
        df = np.empty(len(name), np.int32)
        df[order] = np.repeat(np.add.reduceat(n[order], first), np.diff(np.append(first, len(name))))
        ends = np.cumsum([len(x) // 6 for x in table.column("shingle").to_pylist()])
        kept = [(x[d >= least], d[d >= least]) for x, d in zip(np.split(name, ends[:-1]), np.split(df, ends[:-1]))]
        held = np.array([len(d) > 0 for _, d in kept])
        tidy()
        return pa.Table.from_arrays([
            table.column("block").combine_chunks().filter(pa.array(held)), table.column("bucket").combine_chunks().filter(pa.array(held)),
            pa.array([pack(x) for x, d in kept if len(d)], pa.binary()),
            pa.array([d.tobytes() for _, d in kept if len(d)], pa.binary())], ["block", "bucket", "shingle", "df"])

    parts = stored.select("block", "text").mapInArrow(packed, "block long, bucket long, shingle binary, n binary")
    return parts.groupBy("bucket").applyInArrow(summed, "block long, bucket long, shingle binary, df binary")


class Frequent:
    """The names (``spread``) of the frequent shingles, ascending, and their document frequencies."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.counts, self.total = hashes[order], counts[order], total


def frequent_shingles(docs: DataFrame, text: str = "text") -> Frequent:
    """Exact document frequencies of all shingles in at least ``RARE`` of the documents, for reports."""
    total = docs.count()
    stored = stamped(docs.select(F.lit(0).alias("doc_id"), F.col(text).alias("text")))

    def chosen(batches):
        for batch in batches:
            names = unpack(batch.column("shingle"), batch.column("bucket"))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(numbers(batch.column("df")))], ["shingle", "n"])

    often = counted(stored, bucket_count(stored), max(1, math.ceil(RARE * total))).mapInArrow(chosen, "shingle long, n int")
    found = often.distinct().collect()  # at most shingles per text / RARE
    return Frequent(np.array([r["shingle"] for r in found], np.int64).view(np.uint64),
                    np.array([r["n"] for r in found], np.int64), max(total, 1))


def signatures(stored: DataFrame, total: int, plain: bool = False) -> DataFrame:
    """Stored (key, tag, node, bands, text, df): ``tag`` hashes the text as it is, ``node`` names its sequence of words.

    ``df`` packs the document frequencies (``LEAST`` at least) of the text's distinct shingles, ascending by shingle.
    """
    schema = output_schema(stored.select("key", "tag"), {"node": T.StringType(), "bands": T.ArrayType(T.LongType()),
                                                         "text": T.StringType(), "df": T.BinaryType()})
    buckets = bucket_count(stored)
    back = cut_lineage(counted(stored, buckets, LEAST + 1), "zstd")  # what is not sent back weighs like ``LEAST``

    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        known, often = unpack(sent.column("shingle"), sent.column("bucket")), numbers(sent.column("df"))
        order = np.argsort(known)
        known, often = known[order], often[order]
        sample, kinds = sampler(), BANDS * (2 if plain else 1)
        found = []
        for part, hashes, row in _batches(rows.combine_chunks().to_batches(), "text"):
            n = part.num_rows
            bands = np.zeros((n, kinds), np.uint64)  # weighted, then plain
            starts = np.searchsorted(row, np.arange(n))
            place = np.arange(len(row)) - starts[row]
            powers = _powers(int(place.max()) + 1 if len(place) else 1, _MIX)
            name = np.zeros((2, n), np.uint64)
            for i, salt in enumerate((_MIX, _MIX2)):
                np.add.at(name[i], row, mix(hashes ^ salt) * powers[place])
            owner, value, count = shingles(hashes, row)
            df = np.full(len(value), LEAST, np.int32)
            if len(known) and len(value):
                names = spread(value, buckets)[1]
                at = np.minimum(np.searchsorted(known, names), len(known) - 1)
                hit = known[at] == names
                df[hit] = often[at[hit]]
            if len(value):
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                samples = sample(first, value, weights(count, df, total))
                if plain:
                    samples = np.hstack([samples, sample.plain(first, value)])
                for b in range(kinds):
                    own = np.full(len(first), b, np.uint64)
                    for r in range(ROWS):
                        own = mix(own * _MIX2 + samples[:, b * ROWS + r])
                    bands[owner[first], b] = own
            has = np.zeros(n, bool)
            has[owner] = True
            nodes = [f"{a:016x}{b:016x}" for a, b in zip(*name.tolist())]
            cut = np.searchsorted(owner, np.arange(n + 1))
            found.append(pa.RecordBatch.from_arrays([
                part.column("key"), part.column("tag"),
                pa.array([None if null else node for node, null in zip(nodes, part.column("null").to_pylist())], pa.string()),
                pa.array([band if h else [] for band, h in zip(bands.view(np.int64).tolist(), has)], pa.list_(pa.int64())),
                part.column("text"), pa.array([df[cut[i]:cut[i + 1]].tobytes() for i in range(n)], pa.binary())], schema.names))
        return pa.Table.from_batches(found)

    signed = cut_lineage(stored.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, schema), "zstd")
    discard(back)
    return signed


@lru_cache(maxsize=1)
def sampler() -> Sampler:
    """The sampler of a worker process."""
    return Sampler()


def similarity(a: tuple, b: tuple) -> tuple[float, float]:
    """Weighted and plain Jaccard similarity of (shingles, weights), shingles ascending."""
    (x, wx), (y, wy) = a, b
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = np.minimum(wx[i], wy[j]).sum()
    either, union = wx.sum() + wy.sum() - shared, len(x) + len(y) - len(i)
    return float(shared / either) if either else 0.0, len(i) / union if union else 0.0


def compare(pairs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """(a, b, weighted, plain) of pairs of nodes."""
    rows = pairs
    for side in ("a", "b"):  # ordered by b where Spark merges
        rows = rows.join(texts.select(F.col("node").alias(side), F.col("text").alias(f"t{side}"), F.col("df").alias(f"d{side}")), side)

    def run(batches):
        words = Words()

        def sets(column: pa.Array, df: pa.Array) -> list:
            out = []
            for low, high in slices(column, SLICE_BYTES):
                n = high - low
                owner, value, count = shingles(*words(*text_bytes(column.slice(low, n))))
                weight = weights(count, numbers(df.slice(low, n)), total)
                cut = np.searchsorted(owner, np.arange(n + 1))
                out += [(value[cut[i]:cut[i + 1]], weight[cut[i]:cut[i + 1]]) for i in range(n)]
            return out

        for whole in batches:
            for low, high in slices(whole.column("ta"), 4 * SLICE_BYTES):
                batch = whole.slice(low, high - low)
                names = batch.column("b").to_pylist()
                fresh = [i for i, name in enumerate(names) if i == 0 or name != names[i - 1]]
                right, at = sets(batch.column("tb").take(pa.array(fresh)), batch.column("db").take(pa.array(fresh))), -1
                results = []
                for i, left in enumerate(sets(batch.column("ta"), batch.column("da"))):
                    at += i == 0 or names[i] != names[i - 1]
                    results.append(similarity(left, right[at]))
                yield pa.RecordBatch.from_arrays([
                    batch.column("a"), batch.column("b"), pa.array([r[0] for r in results], pa.float64()),
                    pa.array([r[1] for r in results], pa.float64())], ["a", "b", "weighted", "plain"])
        tidy()

    return rows.mapInArrow(run, "a string, b string, weighted double, plain double")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``links`` (a, b); the root is the smallest node."""
    edges = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select(
        "node", F.least("node", "m").alias("root")))
    while True:
        heard = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("root").alias("heard"))
        better = labels.join(heard, labels.node == heard.a).select(
            "node", F.col("root").alias("old"), F.least("root", "heard").alias("root"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("far"))
        new = cut_lineage(better.join(jump, better.root == jump.j, "left").select(
            "node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        labels = new.select("node", "root")
        if new.where("old <> root").isEmpty():
            return labels


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
            plain: bool = False) -> DataFrame:
    """(key, tag, node, root, class_id) of every row of ``docs``.

    A table or a shuffle that holds texts or shingles is as large as ``docs``: each goes as soon as the next step is stored.
    """
    with shuffles_released(docs.sparkSession):
        return _classes(docs, text, key, threshold, plain)


def _classes(docs: DataFrame, text: str, key: str, threshold: float, plain: bool) -> DataFrame:
    stored = stamped(docs, text, key)
    total = max(stored.count(), 1)
    signed = signatures(stored, total, plain)
    discard(stored)
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("key").alias("key"), F.min("bands").alias("bands"))
    met = nodes.select("node", F.explode("bands").alias("bucket"))
    full = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    members = cut_lineage(met.join(full, "bucket", "left_semi"))
    wanted = members.select("node").distinct()
    texts = cut_lineage(signed.select("node", "text", "df").join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    names = cut_lineage(signed.select("key", "tag", "node"))
    discard(signed)

    linked = F.col("weighted") >= threshold
    if plain:
        linked = linked | (F.col("plain") >= threshold)
    # The representative is the member that meets most: copies edited least share most buckets.
    size = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    degree = members.join(size, "bucket").groupBy("node").agg(F.sum("n").alias("degree"))
    weighed = members.join(degree, "node")
    heads = weighed.groupBy("bucket").agg(F.max(F.struct("degree", "node"))["node"].alias("b"))
    meets = cut_lineage(members.withColumnRenamed("node", "a").join(heads, "bucket").where("a <> b"))
    if meets.isEmpty():
        return _attach(names, names.where("node is not null").select("node", F.col("node").alias("root")).distinct(), texts)
    found = compare(meets.select("a", "b").distinct(), texts, total)
    judged = cut_lineage(meets.join(found, ["a", "b"]).withColumn("linked", linked))
    roots = components(judged.where("linked").select("a", "b").distinct())
    # Members that were left meet a few more central ones; that joins most classes before pairs are looked for.
    slot = F.pmod(F.xxhash64("bucket", "node"), F.lit(CENTRAL))
    others = weighed.groupBy("bucket", slot.alias("s")).agg(F.max(F.struct("degree", "node"))["node"].alias("x"))
    again = judged.where(~F.col("linked")).select("bucket", "a", "b").join(others, "bucket").where("x <> a and x <> b")
    pairs = again.select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()
    more = cut_lineage(compare(pairs, texts, total).where(linked))
    roots = cut_lineage(joined_roots(roots, more))
    ranked, done, taken = undecided(judged, roots, texts, total, threshold, plain), 0, 2
    while ranked is not None:
        # A few pairs of each text at a time: those that come to lie in one class need no comparison.
        more = cut_lineage(compare(ranked.where(F.col("r").between(done + 1, taken)).select("a", "b"), texts, total))
        roots = cut_lineage(joined_roots(roots, more.where(linked)))
        ranked = cut_lineage(apart(ranked.where(F.col("r") > taken), roots).select("a", "b", "r"))
        if ranked.isEmpty():
            break
        done, taken = taken, taken ** 4
    return _attach(names, roots, texts)


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of different classes, with the roots ``ra`` and ``rb``."""
    for side in ("a", "b"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
        pairs = pairs.join(named, side, "left").withColumn(f"r{side}", F.coalesce(f"r{side}", side))
    return pairs.where("ra <> rb")


def joined_roots(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Roots after further links: only classes that the links touch are joined, as nodes of a smaller graph."""
    edges = cut_lineage(apart(links.select("a", "b"), roots).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if edges.isEmpty():
        return roots
    new = components(edges).select(F.col("node").alias("old"), F.col("root").alias("new"))
    moved = roots.join(new, roots["root"] == new["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    # Texts without a link so far are no nodes of ``roots`` yet.
    fresh = new.join(roots, new["old"] == roots["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return moved.union(fresh)


def undecided(judged: DataFrame, roots: DataFrame, texts: DataFrame, total: int, threshold: float,
              plain: bool = False) -> DataFrame | None:
    """Pairs (a, b, r) of different classes that may be linked though no representative decided them.

    ``r`` numbers the pairs of each text.

    One of the two was left by a representative.

    Let the texts of buckets with such members be the texts in question. Two of them share at most
    the lesser of their numbers of common shingles (in more than ``COMMON`` of these texts), and
    the other shingles that both have. The latter are counted by a join on shingles in at most
    ``COMMON`` texts, so its size is linear; pairs without any must have enough common shingles, and
    are looked for inside the bucket among texts that do. Both counts are also taken by weight.
    """
    counts = judged.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.count_if(~F.col("linked")).alias("left"))
    inside = cut_lineage(judged.join(counts.where("members > 1 and left > 0").select("bucket"), "bucket"))
    if inside.isEmpty():
        return None
    nodes = cut_lineage(inside.groupBy(F.col("a").alias("node")).agg(F.bool_or(~F.col("linked")).alias("open")).withColumn(
        "short", F.xxhash64("node")))
    held = cut_lineage(elements(nodes, texts, total))
    spread = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    tagged = cut_lineage(held.join(spread.where("df > 1"), "shingle", "left"))
    common = F.col("df") > COMMON
    own = cut_lineage(nodes.join(tagged.groupBy("short").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.count_if(common).alias("c"),
        F.coalesce(F.sum(F.when(common, F.col("w"))), F.lit(0.0)).alias("v")), "short").join(
        roots, "node", "left").withColumn("root", F.coalesce("root", "node")))

    may_be_plain = F.lit(plain)

    def described(rows: DataFrame, tag: str, *on: str) -> DataFrame:
        named = own.select(*[F.col(c).alias(f"{c}_{tag}") for c in ("node", "short", "n", "w", "c", "v")])
        return rows.join(named, F.col(on[0]) == F.col(on[1]))

    def reach(shared: Column, one: Column, other: Column) -> Column:
        """Highest similarity of texts of these sizes that share at most so much."""
        shared = F.least(shared, one, other)
        return shared / F.greatest(one + other - shared, F.lit(1e-12)) + 1e-9

    few = tagged.where(F.col("df") <= COMMON).select("shingle", "short", "w").join(own.select("short", "open", "root"), "short")
    met = few.where("open").select("shingle", F.col("short").alias("p"), F.col("w").alias("wp"), F.col("root").alias("rp")).join(
        few.select("shingle", F.col("short").alias("q"), F.col("w").alias("wq"), F.col("root").alias("rq")), "shingle").where(
        "rp <> rq").groupBy(
        "p", "q").agg(F.count(F.lit(1)).alias("o"), F.sum(F.least("wp", "wq")).alias("ow"))
    met = described(described(met, "a", "p", "short_a"), "x", "q", "short_x").where(
        (may_be_plain & (reach(F.least("c_a", "c_x") + F.col("o"), F.col("n_a"), F.col("n_x")) >= threshold))
        | (reach(F.least("v_a", "v_x") + F.col("ow"), F.col("w_a"), F.col("w_x")) >= threshold)).select("node_a", "node_x")

    seen = inside.select("bucket", "b", F.col("a").alias("name"), "weighted", "plain")
    rows = seen.join(own, seen["name"] == own["node"]).drop("name", "b")
    floor = rows.groupBy("bucket").agg(F.min("n").alias("n_min"), F.min("w").alias("w_min"))
    rows = cut_lineage(rows.join(floor, "bucket").where(
        (may_be_plain & (reach(F.col("c"), F.col("n"), F.greatest("n_min", "c")) >= threshold))
        | (reach(F.col("v"), F.col("w"), F.greatest("w_min", "v")) >= threshold)))
    a, x = (rows.select("bucket", *[F.col(c).alias(f"{c}_{t}") for c in ("node", "root", "open", "n", "w", "c", "v", "weighted", "plain")])
            for t in ("a", "x"))
    fits = (may_be_plain & (reach(F.least("c_a", "c_x"), F.col("n_a"), F.col("n_x")) >= threshold)) | (
        reach(F.least("v_a", "v_x"), F.col("w_a"), F.col("w_x")) >= threshold)
    close = (F.abs(F.col("weighted_a") - F.col("weighted_x")) <= 1 - threshold) | (
        may_be_plain & (F.abs(F.col("plain_a") - F.col("plain_x")) <= 1 - threshold))  # the triangle inequality
    alike = a.where("open_a").join(x, "bucket").where((F.col("root_a") != F.col("root_x")) & fits & close)
    both = met.union(alike.select("node_a", "node_x"))
    order = Window.partitionBy("a").orderBy(F.xxhash64("a", "b"))
    pairs = cut_lineage(both.select(F.least("node_a", "node_x").alias("a"), F.greatest("node_a", "node_x").alias("b"))
                        .distinct().withColumn("r", F.row_number().over(order)))
    return None if pairs.isEmpty() else pairs


def elements(nodes: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """(short, shingle, w): the weighted shingles of each node."""
    rows = texts.join(nodes, "node").select("short", "text", "df")

    def run(batches):
        for part, hashes, row in _batches(batches, "text"):
            owner, value, count = shingles(hashes, row)
            short = np.array(part.column("short").to_pylist(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(short[owner]), pa.array(value.view(np.int64)),
                 pa.array(weights(count, numbers(part.column("df")), total))],
                ["short", "shingle", "w"])
        tidy()

    return rows.mapInArrow(run, "short long, shingle long, w double")


def _attach(names: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    rows = cut_lineage(names.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(texts, names)
    first = rows.where("root is not null").groupBy("root").agg(F.min("key").alias("class_id"))
    return rows.join(first, "root", "left").withColumn("class_id", F.when(
        F.col("root").isNull(), F.col("key")).otherwise(F.col("class_id")))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD,
                plain: bool = False) -> DataFrame:
    """One row of each class, the one with the smallest key (ties: smallest tag); rows of null text stay."""
    with shuffles_released(docs.sparkSession):
        found = cut_lineage(classes(docs, text, key, threshold, plain))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("key", "tag")).alias("s"))
    name, tag = free_names(docs.columns, "key", "tag")
    keepers = first.select(F.col("s.key").alias(f"{name}_"), F.col("s.tag").alias(f"{tag}_"))
    tagged = docs.where(F.col(text).isNotNull()).withColumn(tag, F.xxhash64(text))
    named = tagged.alias("d").join(keepers.alias("k"), F.col(f"d.`{key}`").eqNullSafe(F.col(f"k.{name}_"))
                                   & (F.col(f"d.{tag}") == F.col(f"k.{tag}_")), "left_semi")
    repeated = found.where("root is not null").groupBy("key", "tag").count().where("count > 1")
    if not repeated.isEmpty():  # equal rows: one stays
        named = named.dropDuplicates([key, tag])
    return named.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.where(F.col(text).isNull()))
