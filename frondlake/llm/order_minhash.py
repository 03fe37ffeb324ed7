"""Order MinHash: fingerprints whose likeness follows edit distance.

A text is the set of its k-mers (``K`` code points), each with its occurrence
number, so repeated k-mers stay distinct. For each of ``SAMPLES`` permutations
the ``TUPLE`` smallest elements are selected, put back into text order, and their
k-mers hashed as a tuple. Two texts agree in a sample if they share the selected
k-mers in the same order, which Jaccard similarity does not see. The fingerprint
is the list of samples in hexadecimal, eight digits each; likeness is the share
of equal samples.

Texts shorter than ``K`` code points have one element, the whole text; an empty
text has the fingerprint of no element, so empty texts are alike to each other
only. Null text counts as empty. All work on a text is linear but for one sort of
its k-mers, in slices of fixed size.

``with_next`` pairs each document with its successor by key without ordering
everything in one task: rows are range-partitioned once, and the first document of
every range is sent to the range before it as well. Keys are whole numbers; rows of null or equal
key follow one another in the order of their texts and lie in one range.

Repeated rows have equal fingerprints, each row is followed by the next copy. Columns
pass ``with_next`` unchanged, whatever their names, but for those it adds; ``fingerprint_edits``
returns the key and its own columns only. An empty table gives an empty table, a single row
is followed by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .arrow import output_schema, replace_column
from .ordered import free_names

K = 6
TUPLE = 2
SAMPLES = 48
SEED = 7_654_321
SLICE = 1 << 12


class OrderMinHash:
    def __init__(self, k: int = K, tuple_size: int = TUPLE, samples: int = SAMPLES, seed: int = SEED):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.k, self.size = k, tuple_size
        self.factors = draw.integers(1 << 16, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
        self.buffer = np.empty((samples, SLICE), np.uint32)
        self.base = draw.integers(1 << 40, 1 << 63, k, dtype=np.uint64) | np.uint64(1)

    def elements(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each k-mer, and the 32-bit element of (k-mer, occurrence number)."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        n = max(len(points) - self.k + 1, 1 if len(points) else 0)
        kmer = np.zeros(n, np.uint64)
        for i in range(min(self.k, len(points))):
            kmer += (points[i:i + n] + np.uint64(i + 1)) * self.base[i]
        kmer ^= kmer >> np.uint64(32)
        kmer *= np.uint64(0x9E3779B97F4A7C15)
        kmer ^= kmer >> np.uint64(29)
        occurrence = np.zeros(n, np.uint64)
        if n > 1:  # equal k-mers side by side, in text order; sorting whole words is faster than sorting places
            bits = np.uint64(n.bit_length())
            ordered = np.sort((kmer << bits) | np.arange(n, dtype=np.uint64))
            group, at = ordered >> bits, (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            same = group[1:] == group[:-1]
            if same.any():
                run = np.arange(n)
                run[1:][same] = 0
                occurrence[at] = np.arange(n) - np.maximum.accumulate(run)
        element = (kmer + occurrence * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
        return kmer, (element >> np.uint64(32)).astype(np.uint32)

    def samples(self, text: str) -> np.ndarray:
        """One 32-bit value per permutation."""
        kmer, element = self.elements(text)
        count = len(self.factors)
        if not len(element):
            return np.zeros(count, np.uint32)
        best = np.full((count, self.size), 1 << 32, np.uint64)
        place = np.full((count, self.size), -1, np.int64)
        rows = np.arange(count)
        for at in range(0, len(element), SLICE):
            part = element[at:at + SLICE]
            values = np.multiply(part[None], self.factors[:, None], out=self.buffer[:, :len(part)])
            found, where = [best], [place]
            for _ in range(min(self.size, len(part))):
                first = values.argmin(1)
                found.append(values[rows, first].astype(np.uint64)[:, None])
                where.append((first + at)[:, None])
                values[rows, first] = 0xFFFFFFFF
            found, where = np.hstack(found), np.hstack(where)
            pick = np.argsort(found, 1, kind="stable")[:, :self.size]
            best, place = np.take_along_axis(found, pick, 1), np.take_along_axis(where, pick, 1)
        place.sort(1)  # text order; missing elements (-1) come first
        chosen = np.where(place >= 0, kmer[place], np.uint64(1))
        value = np.zeros(count, np.uint64)
        for i in range(self.size):
            value = (value ^ chosen[:, i]) * np.uint64(0x94D049BB133111EB)
            value ^= value >> np.uint64(31)
        return (value >> np.uint64(16)).astype(np.uint32)

    def fingerprint(self, text: str) -> bytes:
        return self.samples(text).astype(">u4").tobytes()


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples of two fingerprints (hexadecimal columns)."""
    def pick(i: Column) -> Column:
        return F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8))

    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), pick)) / F.lit(float(samples))
    return F.when(a == b, F.lit(1.0)).otherwise(same)


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of each text in hexadecimal."""
    schema = output_schema(docs, {fingerprint: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]):
        hasher = OrderMinHash()
        for batch in batches:
            found = [hasher.fingerprint(t.as_py() or "").hex() for t in batch.column(text)]
            yield replace_column(batch, {fingerprint: pa.array(found, pa.string())})

    return docs.mapInArrow(run, schema)


def _range(borders: list[int], key: str, first: int = 0) -> Column:
    """Number of borders not above the key: a binary decision tree."""
    if not borders:
        return F.lit(first)
    half = len(borders) // 2
    return F.when(F.col(key) < borders[half], _range(borders[:half], key, first)).otherwise(
        _range(borders[half + 1:], key, first + half + 1))


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", tie: str = "text",
              keys: DataFrame | None = None) -> DataFrame:
    """Add ``next_<column>`` of the following row by ascending key (null first; ties by ``tie``).

    The last row is followed by the first. Ranges of keys are as many as
    ``spark.sql.shuffle.partitions``; rows move once. ``keys`` may name a frame with the same
    keys that costs less to read than ``docs``.
    """
    spark = docs.sparkSession
    k, part, at, own_range, before, first = free_names(
        [*docs.columns, *[f"next_{c}" for c in columns]], "k", "part", "at", "own_range", "before", "first")
    rows = docs.withColumn(k, F.col(key).cast("long"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = (docs if keys is None else keys).select(F.col(key).cast("long").alias(k))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    quantiles = keys.agg(F.percentile_approx(k, shares, 10 * parts)).first()[0] or []
    place = F.coalesce(_range(sorted({int(q) for q in quantiles}), k), F.lit(0))
    place = F.when(F.col(k).isNull(), 0).otherwise(place)
    firsts = [(r["r"], r["first"][k]) for r in keys.groupBy(place.alias("r")).agg(
        F.min(F.struct(k)).alias("first")).orderBy("r").collect()]  # one row a range
    ring = [(r, firsts[i - 1][0], low) for i, (r, low) in enumerate(firsts)] or [(0, 0, None)]
    known = F.broadcast(spark.createDataFrame(ring, f"{own_range} int, {before} int, {first} long"))
    own = F.struct(F.col(own_range).alias("r"), F.lit(0).alias("extra"))
    extra = F.struct(F.col(before).alias("r"), F.lit(1).alias("extra"))
    spread = rows.withColumn(part, place).join(known, F.col(part) == F.col(own_range)).withColumn(
        at, F.explode(F.when(F.col(k).eqNullSafe(F.col(first)), F.array(own, extra)).otherwise(F.array(own))))
    window = Window.partitionBy(f"{at}.r").orderBy(f"{at}.extra", F.col(k).asc_nulls_first(), F.col(tie).asc_nulls_first())
    following = spread.select(*docs.columns, at, *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return following.where(f"{at}.extra = 0").drop(at)


def edited(text: Column, following: Column) -> Column:
    """The text with its second half replaced by as many first code points of another."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.length(text) - half), F.substr(following, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, both fingerprints, near_edited, near_next."""
    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"))
    short = fingerprints(rows).withColumn("fingerprint", F.unhex("fingerprint"))  # half the bytes on the way
    paired = with_next(short, ["text", "fingerprint"], key, keys=docs)

    def hexadecimal(column: str) -> Column:
        return F.lower(F.hex(column)).alias(column)

    changed = paired.select(key, F.length("text").cast("long").alias("n_chars"), hexadecimal("fingerprint"),
                            hexadecimal("next_fingerprint"),
                            edited(F.col("text"), F.col("next_text")).alias("edited"))
    hashed = fingerprints(changed.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_fingerprint")
    return hashed.select(
        key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
