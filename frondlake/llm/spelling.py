"""Spelling variants by pivotal grams.

Words within one edit are found without comparing all of them. The bigrams of a
word are ordered by how few words hold them, then by their place. The *prefix* is its first
``2 * EDITS + 1`` bigrams in that order; *pivots* are ``EDITS + 1`` bigrams of the prefix that do
not overlap, chosen by dynamic programming so that the fewest words share them. One edit
leaves at least one of two disjoint bigrams whole, so of two near words the one whose
prefix ends earlier in the order has a pivot in the other's prefix (which for that also
holds its last bigram one place further, where an insertion may have moved it). Pivots are
looked up in an index of the prefixes. Position limits: a surviving bigram moves by nothing
or by the difference of the lengths. An edit behind the surviving bigram leaves the head
of the word unchanged, one before it the tail; that side is part of the key, which splits the
groups of frequent bigrams. What remains of the word is halved: an edit in one half leaves the
other unchanged, which joins the key (``halves``). A key thus fixes more than half of a word, so words
that share an end and a length are not all compared. The other pivot bounds the edit too: a half
it cannot be in is not looked up. Words that meet are verified by their edit distance.

A word's *form* is its near word of largest count if that is ``FACTOR`` times its own at
least; its *root* is where the forms lead. Counts grow by the factor at each step, so a
chain has at most 18 of them and five doublings of the step find its end.

On the cluster: words are cut out and counted by SQL functions, with partial counts before
the shuffle; one row per distinct word remains. Only the table of bigrams is broadcast:
its size is bounded by the square of the alphabet (90 characters).

Rows: null text has no words; a null id is written as nothing. Very long texts give one
array of words; repeated rows count again; an empty table gives an empty table. Ties of
counts go to the first word in code-point order. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shuffles_released

RUNS = r"[A-Za-zÀ-ÿ]+"
CHUNK_WORDS, CHUNK_CHARS = 2048, 1 << 17
LEAST_CHARS = 7
LEAST_COUNT = 2
FACTOR = 10
DELETE_EACH = 31
EDITS = 1
GRAM = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(run: Column, key: Column) -> Column:
    """The run without one code point if ``DELETE_EACH`` divides the checksum of ``<key>:<run>``."""
    number = F.crc32(F.encode(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    cut = (number % F.length(run)).cast("int")
    shorter = F.concat(F.substr(run, F.lit(1), cut), F.substr(run, cut + 2))
    return F.when(number % DELETE_EACH == 0, shorter).otherwise(run)


def words(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``word`` and ``n``: the distinct words of at least ``LEAST_CHARS`` code points that occur ``LEAST_COUNT`` times."""
    runs = F.regexp_extract_all(F.col(text), F.lit(r"[A-Za-zÀ-ÿ]{%d,}" % LEAST_CHARS), F.lit(0))
    found = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))
    spelled = found.select(damaged(F.col("run"), F.col("key")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return spelled.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def grams(word: str) -> list[str]:
    return [word[i:i + GRAM] for i in range(len(word) - GRAM + 1)]


def prefix(word: str, shared: dict[str, int]) -> tuple[list[int], list[int]]:
    """Places of the first ``GRAM * EDITS + 1`` bigrams in the order (bigram, place), and those of the prefix for look-ups.

    The latter also has the last bigram where an inserted character would have moved it.
    """
    own = grams(word)
    first = sorted(range(len(own)), key=lambda i: (shared[own[i]], own[i], i))[:GRAM * EDITS + 1]
    last = first[-1]
    moved = [i for i in range(last + 1, min(last + EDITS, len(own) - 1) + 1) if own[i] == own[last]]
    return first, first + moved


def pivots(word: str, places: list[int], shared: dict[str, int]) -> list[int]:
    """``EDITS + 1`` disjoint places of least total frequency, by dynamic programming over the places from left to right."""
    places, own = sorted(places), grams(word)
    best: list[list[tuple[int, tuple[int, ...]] | None]] = [[(0, ())] * (len(places) + 1)]
    for _ in range(EDITS + 1):  # best[k][j]: k disjoint ones of the first j places
        row: list[tuple[int, tuple[int, ...]] | None] = [None]
        for j, place in enumerate(places):
            free = sum(p <= place - GRAM for p in places[:j])  # those that end before this one begins
            before = best[-1][free]
            taken = before and (before[0] + shared[own[place]], (*before[1], place))
            row.append(min((x for x in (row[-1], taken) if x), default=None))
        best.append(row)
    return list(best[-1][-1][1])


def unchanged(size: np.ndarray, one: np.ndarray, two: np.ndarray) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
    """Look-ups for the places an edit can be at: (surviving pivot, side whose rest is the key, unchanged head and tail)."""
    none = np.zeros_like(size)
    return [(two, "head", two + GRAM, none),                         # behind both pivots
            (one, "tail", none, size - one),                         # before both
            (one, "head", one + GRAM, size - two - GRAM),            # between them or in the second
            (two, "tail", one, size - two)]                          # in the first


def halves(side: str, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of characters of a word of this length: those of the unchanged side, the near half and the far half of the rest."""
    kept = at + GRAM if side == "head" else length - at
    near = (length - kept) // 2
    return kept, near, length - kept - near


class Digests:
    """Digests of the two ends of words, from running sums over the characters of all words."""

    STEP = np.uint64(0x9E3779B97F4A7C15)
    BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, words: list[str]):
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.size) - self.size
        powers = np.cumprod(np.full(len(points), self.STEP)) * self.BACK
        self.back = np.cumprod(np.full(len(points) + 1, self.BACK)) * self.STEP
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(points + np.uint64(1)) * powers)))

    def piece(self, low: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (self.sums[low + count] - self.sums[low]) * self.back[low]

    def __call__(self, word: np.ndarray, kind: int, at: np.ndarray, length: np.ndarray, head: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Of kind, place, length, and so many characters of the head and of the tail of the words."""
        low = self.starts[word]
        found = mixed((kind + 4 * at).astype(np.uint64)) + mixed(length.astype(np.uint64) * self.BACK + self.piece(low, head))
        return mixed(found * self.STEP + self.piece(low + self.size[word] - tail, tail)).view(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(digest: Digests, word: np.ndarray, side: str, at: np.ndarray, length: np.ndarray, least: np.ndarray | None = None,
         most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(which, key): keys of words for an edit in either half of what remains beside the bigram at ``at``.

    ``length`` is that of the word looked for. The edit leaves from ``least`` to ``most`` characters
    of the unchanged side's end; without them it may be anywhere.
    """
    kept, near, far = halves(side, at, length)
    in_near, in_far = near > 0, np.ones(len(at), bool)
    if least is not None:
        in_near &= (least < kept + near) & (least <= most)
        in_far &= (most >= kept + near) & (least <= most)
    out = []
    for kind, which, own, other in ((0, in_near, kept, far), (1, in_far, kept + near, np.zeros_like(far))):
        i = np.flatnonzero(which)
        head, tail = (own[i], other[i]) if side == "head" else (other[i], own[i])
        out.append((i, digest(word[i], kind + 2 * (side == "tail"), at[i], length[i], head, tail)))
    return np.concatenate([i for i, _ in out]), np.concatenate([k for _, k in out])


def described(vocabulary: DataFrame, shared: DataFrame) -> DataFrame:
    """(word, n, last, places, pivots) of every word; ``last`` is the rank of its last prefix bigram."""
    frequency = {r["gram"]: r["words"] for r in shared.collect()}  # at most the square of the alphabet
    known = vocabulary.sparkSession.sparkContext.broadcast(frequency)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        order = {g: i for i, g in enumerate(sorted(counts, key=lambda g: (counts[g], g)))}
        for batch in batches:
            last, held, chosen = [], [], []
            for word in batch.column("word").to_pylist():
                first, places = prefix(word, counts)
                last.append(order[word[first[-1]:first[-1] + GRAM]])
                held.append(places)
                chosen.append(pivots(word, first, counts))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(last, pa.int32()), pa.array(held, pa.list_(pa.int32())),
                 pa.array(chosen, pa.list_(pa.int32()))], ["word", "n", "last", "places", "pivots"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, last int, places array<int>, pivots array<int>")


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The batches in parts of ``CHUNK_WORDS`` words or about ``CHUNK_CHARS`` characters, with their words."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        low = held = 0
        for i, word in enumerate(words):
            held += len(word)
            if i + 1 - low == CHUNK_WORDS or held > CHUNK_CHARS or i + 1 == len(words):
                yield batch.slice(low, i + 1 - low), words[low:i + 1]
                low, held = i + 1, 0


def held_entries(stored: DataFrame) -> DataFrame:
    """(met, b, b_n, b_last): the prefix entries of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches):
            digest, places = Digests(words), batch.column("places")
            word = np.repeat(np.arange(len(words)), [len(x) for x in places.to_pylist()])
            at = places.flatten().to_numpy().astype(np.int64)
            for side in ("head", "tail"):
                i, key = keys(digest, word, side, at, digest.size[word])
                rows = batch.take(pa.array(word[i]))
                yield pa.RecordBatch.from_arrays([pa.array(key), *(rows.column(c) for c in ("word", "n", "last"))], ["met", "b", "b_n", "b_last"])

    return stored.select("word", "n", "last", "places").mapInArrow(run, "met long, b string, b_n long, b_last int")


def asked_entries(stored: DataFrame) -> DataFrame:
    """(meet, a, a_n, a_last): the look-ups of every word's pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches):
            digest, word = Digests(words), np.arange(len(words))
            one, two = batch.column("pivots").flatten().to_numpy().astype(np.int64).reshape(-1, EDITS + 1).T
            for at, side, head, tail in unchanged(digest.size, one, two):
                least, other = (head, tail) if side == "head" else (tail, head)
                for more in (-1, 0, 1):  # the word looked for is so much longer; unless it is, the edit takes a character of this one
                    i, key = keys(digest, word, side, at + more * (side == "tail"), digest.size + more, least, digest.size - other - (more < 1))
                    rows = batch.take(pa.array(i))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), *(rows.column(c) for c in ("word", "n", "last"))], ["meet", "a", "a_n", "a_last"])

    return stored.select("word", "n", "last", "pivots").mapInArrow(run, "meet long, a string, a_n long, a_last int")


def near(vocabulary: DataFrame) -> DataFrame:
    """All pairs of near words, both ways: ``word``, ``other``, ``other_n``. ``vocabulary``: word, n, stored."""
    places = F.sequence(F.lit(1), F.length("word") - GRAM + 1)
    held = F.explode(F.array_distinct(F.transform(places, lambda i: F.substr("word", i, F.lit(GRAM)))))
    shared = vocabulary.select(held.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("words"))
    stored = cut_lineage(described(vocabulary, shared))
    asked, held = asked_entries(stored), held_entries(stored)  # many times larger than Spark estimates: joined by a merge
    fits = (F.col("a_last") <= F.col("b_last")) & (F.levenshtein("a", "b", EDITS) == EDITS)
    met = asked.join(held.hint("merge"), (F.col("meet") == F.col("met")) & fits).select("a", "a_n", "b", "b_n")
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
                             F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))))
    return met.select(both.alias("x")).select("x.*").distinct()


def groups(vocabulary: DataFrame) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for a stored table of ``word`` and ``n``."""
    best = near(vocabulary).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = vocabulary.join(best, "word", "left")
    strong = -F.col("best.less") >= FACTOR * F.col("n")
    formed = cut_lineage(joined.select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n")))
    step = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(5):  # counts fit 64 bits and grow ten times a step: at most 18 steps
        step = cut_lineage(step)
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return formed.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Words of the texts with their forms and roots."""
    with shuffles_released(docs.sparkSession):
        return groups(cut_lineage(words(docs, text, key)))


def sql() -> str:
    """DuckDB SQL for the rows of the query over ``documents``: all words of neighbouring lengths are compared."""
    wide = "".join(map(chr, range(0xC0, 0x100)))
    narrow = "".join(chr(c) for c in range(33, 127) if not 97 <= c <= 122 and c not in (39, 92))[:64]
    bits = "list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]{{{LEAST_CHARS},}}')) AS run FROM documents),
lines AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS line, count(*) AS n FROM runs GROUP BY ALL),
octets AS (SELECT run, n, list_transform(regexp_extract_all(hex(encode(line)), '..'), lambda h: ('0x' || h)::BIGINT) AS octets FROM lines),
sums AS (SELECT run, n, xor(list_reduce([4294967295::BIGINT] || octets, lambda c, b: {bits}), 4294967295) AS h FROM octets),
spelled AS (
  SELECT CASE WHEN h % {DELETE_EACH} = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2)
    ELSE run END AS word, n FROM sums),
words AS (SELECT word, sum(n)::BIGINT AS n, translate(word, '{wide}', '{narrow}') AS plain FROM spelled
  WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM words a JOIN words b
    ON length(b.word) BETWEEN length(a.word) - 1 AND length(a.word) + 1 AND levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'form': other}}) AS top FROM near GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.less >= {FACTOR} * w.n THEN top.form END AS form,
    CASE WHEN -top.less >= {FACTOR} * w.n THEN -top.less END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, seen, step) AS (
  SELECT word, word, 0 FROM formed UNION ALL
  SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.seen WHERE f.form IS NOT NULL)
SELECT f.word, form, arg_max(c.seen, c.step) AS root, f.n, n_near, form_n FROM formed f JOIN chain c USING (word)
GROUP BY f.word, form, f.n, n_near, form_n"""
