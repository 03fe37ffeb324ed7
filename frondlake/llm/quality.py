"""Quality rules whose thresholds follow the data of each language and source.

One pass measures every text (``measure``). The measures of the texts that pass
the base rules go into quantile sketches per (language, source): relative-error
histograms whose bucket is the value cut to its leading ``BITS`` bits. Counts of
equal buckets add up, so sketches merge exactly, in any order, and the result
does not depend on how the rows are spread or on which task was run twice.
The sketch of a (language, source) is blended with that of its language, which is
itself blended with the sketch of everything: the parent's shares count like ``prior``
further rows, so shares move smoothly from the parent's to the group's own as its rows
become more, and there is no size at which the rule changes. Where a group and its parent
differ much, their blend has two heights and a quartile may still step from one to the
other; the wide range between its quartiles then spares both. From the blended sketch:

    upper = q3 + REACH * max(q3 - q1, spread),  lower = q1 - REACH * max(q3 - q1, spread)

A text is kept if it passes the base rules and no measure is outside its
fences. Only far outliers of the own group fall, whatever is usual there.

The sketches have a few hundred rows per group and come from a map-side combined
aggregate; they and the measured table (no texts) are kept in the checkpoint folder.
The latter is joined with the fences, a join that Spark may broadcast or split when one
source holds most rows. Only built-in functions are used.

Rows: null text counts as empty; it has no words and fails the base rules. Null
language or source is a group of its own. Ties and repeated rows count each.
Very long texts are measured whole, in one task each. Input columns other than the measured ones pass unchanged, except columns with
the name of a result. An empty table gives an empty table.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ordered import free_names

SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "
WINDOW = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

#: measure, numerator, factor, denominator, least spread, two-sided
MEASURES = (
    ("symbol_rate", "n_symbols", 1000, "n_words", 100, False),
    ("word_length", "word_chars", 100, "n_words", 100, True),
    ("repeat_rate", "n_repeat_words", 1000, "n_words", 100, False),
    ("line_repeat_rate", "n_dup_lines", 1000, "n_lines", 150, False),
    ("capital_rate", "n_capitals", 1000, "word_chars", 100, False),
)
REACH = 3
PRIOR = 100
BITS = 6
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that occur twice or more in the text."""
    last = F.size(words) - WINDOW + 1

    def windows(keys: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(keys, i, WINDOW)))

    def ordered(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        """Places whose window has an equal neighbour in the order of the windows."""
        def equal(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(s, i).h == F.get(s, j).h, F.lit(False))

        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                         lambda i: equal(i, i - 1) | equal(i, i + 1))
        return F.array_sort(F.transform(twice, lambda i: F.get(s, i).i))

    def covered(places: Column) -> Column:
        """Length of the union of [place, place + WINDOW)."""
        state = F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
            lambda a, p: F.struct((a.n + WINDOW - F.greatest(a.end - p, F.lit(0))).alias("n"),
                                  (p + WINDOW).alias("end")))
        return state.n

    def count(hashes: Column) -> Column:
        some = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(some, bind(ordered(hashes), lambda s: covered(starts(s)))).otherwise(0)

    keys = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last < 2, 0).otherwise(bind(keys, lambda k: bind(windows(k), count))).cast("long")


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` and ``base_failed``, drop the text."""
    kept = [c for c in docs.columns if c not in (*COUNTS, "base_failed", text)]
    whole, words, lines = free_names([*docs.columns, *COUNTS], "whole", "words", "lines")
    rows = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(whole)).withColumn(
        words, F.array_remove(F.split(whole, r"[ \x09-\x0D]+"), "")).withColumn(
        lines, F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^ \x09-\x0D]")))

    def without(characters: str) -> Column:
        return F.length(F.translate(whole, characters, ""))

    rows = rows.select(
        *kept, F.size(words).cast("long").alias("n_words"), without(SPACES).cast("long").alias("word_chars"),
        (F.length(whole) - without(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(words)).alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"),
        (F.length(whole) - without(string.ascii_uppercase)).cast("long").alias("n_capitals"))
    return rows.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def rate(numerator: str, factor: int, denominator: str) -> Column:
    return F.expr(f"(({factor} * {numerator}) div greatest({denominator}, 1))")


def bucket(value: Column) -> Column:
    """The value with all but its leading ``BITS`` bits cleared: the lower edge of its bucket."""
    shift = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    size = F.pow(F.lit(2.0), shift).cast("long")
    return F.floor(value / size).cast("long") * size


def sketches(measured: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, measure, bucket, n) of the texts that pass the base rules."""
    values = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), bucket(rate(top, factor, below)).alias("bucket"))
        for name, top, factor, below, _, _ in MEASURES])).alias("v")
    return measured.where(~F.col("base_failed")).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), values).groupBy(
        "lang", "source", "v.measure", "v.bucket").agg(F.count(F.lit(1)).alias("n"))


def _blend(sketch: DataFrame, keys: list[str], parent: DataFrame | None, prior: int) -> DataFrame:
    """(keys, measure, bucket, share): the part of the values up to each bucket, the parent's counted as ``prior`` rows.

    ``parent`` is the blend of all but the last key; it has every bucket of this level.
    """
    counts = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy(*keys, "measure").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys, "measure")
    running, rows = F.sum("n").over(upto).cast("double"), F.sum("n").over(whole).cast("double")
    if parent is None:
        return counts.select(*keys, "measure", "bucket", (running / rows).alias("share"))
    above = parent.groupBy(*keys[:-1], "measure").agg(
        F.collect_list(F.struct("bucket", "share")).alias("above"))  # the buckets of one measure: a few hundred
    above = above.select(*[F.col(k).alias(f"above_{k}") for k in keys[:-1]], F.col("measure").alias("above_measure"), "above")
    on = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"above_{k}")), keys[:-1], F.col("measure") == F.col("above_measure"))
    groups = counts.select(*keys, "measure").distinct()
    # without keys the parent is a row a measure, each of at most 2 ** BITS * 64 buckets
    grid = groups.join(above if keys[:-1] else F.broadcast(above), on).select(*keys, "measure", F.explode("above").alias("a"))
    none, zero = F.lit(None).cast("double").alias("share"), F.lit(0).cast("long").alias("n")
    both = grid.select(*keys, "measure", "a.bucket", zero, "a.share").unionByName(
        counts.select(*keys, "measure", "bucket", "n", none))
    filled = both.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"), F.max("share").alias("share"))
    mixed = (running + F.lit(float(prior)) * F.col("share")) / (rows + F.lit(float(prior)))
    return filled.select(*keys, "measure", "bucket", mixed.alias("share"))


def fences(sketch: DataFrame, prior: int = PRIOR) -> DataFrame:
    """One row per (lang, source) with a map from measure to (lower, upper)."""
    blend = None
    for keys in ([], ["lang"], ["lang", "source"]):
        blend = _blend(sketch, keys, blend, prior)

    def quartile(quarters: float) -> Column:
        return F.min(F.when(4 * F.col("share") >= quarters, F.col("bucket")))

    spread = F.create_map(*[F.lit(x) for m in MEASURES for x in (m[0], m[4])])
    two = F.create_map(*[F.lit(x) for m in MEASURES for x in (m[0], m[5])])
    picked = blend.groupBy("lang", "source", "measure").agg(quartile(1.0).alias("q1"), quartile(3.0).alias("q3")).withColumn(
        "reach", REACH * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("measure")]))
    limits = picked.select("lang", "source", "measure", F.struct(
        F.when(two[F.col("measure")], F.col("q1") - F.col("reach")).alias("lower"),
        (F.col("q3") + F.col("reach")).alias("upper")).alias("limits"))
    return limits.groupBy("lang", "source").agg(
        F.map_from_entries(F.collect_list(F.struct("measure", "limits"))).alias("fences"))  # five entries


def judge(measured: DataFrame, lang: str = "lang", source: str = "source", prior: int = PRIOR) -> DataFrame:
    """Add ``kept`` and ``outside``, the measures outside their fences, to a stored ``measure`` table."""
    own_lang, own_source, own = free_names([*measured.columns, "kept", "outside"], "of_lang", "of_source", "fences")
    limits = fences(cut_lineage(sketches(measured, lang, source)), prior).select(
        F.col("lang").alias(own_lang), F.col("source").alias(own_source), F.col("fences").alias(own))
    on = F.col(lang).eqNullSafe(F.col(own_lang)) & F.col(source).eqNullSafe(F.col(own_source))
    kept = [c for c in measured.columns if c not in ("kept", "outside")]
    rows = measured.select(*kept).join(limits, on, "left")
    tests = []
    for name, top, factor, below, _, _ in MEASURES:
        value, limit = bucket(rate(top, factor, below)), F.col(own)[name]
        tests.append(F.when((value > limit.upper) | (value < F.coalesce(limit.lower, value)), name))
    outside = F.filter(F.array(*tests), lambda t: t.isNotNull())
    return rows.select(*kept, outside.alias("outside")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("outside") == 0))


def rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          prior: int = PRIOR) -> DataFrame:
    """Measure, learn the fences from all rows, and judge every row. The texts are read once."""
    return judge(cut_lineage(measure(docs, text)), lang, source, prior)


def keep(docs: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` whose key has been kept."""
    return docs.join(verdicts.where("kept").select(key), key, "left_semi")


#: Result columns of the contract beside those of the method.
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def sql(documents: str = "documents") -> str:
    """Plain SQL of the rules."""
    space = r"[ \t\n\x0B\f\r]+"
    upper = string.ascii_uppercase
    values = " UNION ALL ".join(
        f"SELECT r, lang, source, base_failed, '{name}' AS measure, ({factor} * {top}) // greatest({below}, 1) AS v, "
        f"{spread} AS spread, {str(two).lower()} AS two FROM measured" for name, top, factor, below, spread, two in MEASURES)
    cut = f"(v >> greatest(length(bin(v)) - {BITS}, 0)) << greatest(length(bin(v)) - {BITS}, 0)"

    def shares(name: str, keys: list[str], above: str | None) -> str:
        own = "".join(f"g.{k}, " for k in keys)
        part = f"PARTITION BY {own}g.measure"
        up = "".join(f" AND g.{k} IS NOT DISTINCT FROM a.{k}" for k in keys[:-1])
        same = "".join(f" AND g.{k} IS NOT DISTINCT FROM c.{k}" for k in keys)
        running = f"sum(coalesce(c.n, 0)) OVER ({part} ORDER BY p.b)::DOUBLE"
        total = f"sum(coalesce(c.n, 0)) OVER ({part})::DOUBLE"
        share = f"({running} + {PRIOR}.0::DOUBLE * a.share) / ({total} + {PRIOR}.0::DOUBLE)" if above else f"{running} / {total}"
        plain = "".join(f"{k}, " for k in keys)
        return f"""{name} AS (SELECT {own}g.measure, p.b, {share} AS share
  FROM (SELECT DISTINCT {plain}measure FROM buckets WHERE NOT base_failed) g
  JOIN (SELECT DISTINCT measure, b FROM buckets WHERE NOT base_failed) p ON g.measure = p.measure
  LEFT JOIN (SELECT {plain}measure, b, count(*) AS n FROM buckets WHERE NOT base_failed GROUP BY {plain}measure, b) c
    ON g.measure = c.measure AND p.b = c.b{same}""" + (
            f"\n  JOIN {above} a ON g.measure = a.measure AND p.b = a.b{up}" if above else "") + ")"

    return f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM {documents}),
words AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM texts),
windows AS (SELECT r, i, w[i:i + {WINDOW - 1}] AS win FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, win) > 1),
repeats AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) AS s(k) GROUP BY r),
measured AS (SELECT words.r, doc_id, lang, source, len(w) AS n_words,
  length(regexp_replace(t, '{space}', '', 'g')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(t) - length(translate(t, '{upper}', '')) AS n_capitals,
  n_words < {LEAST_WORDS} OR 100 * coalesce(n, 0) > {REPEAT_PERCENT} * n_words AS base_failed
  FROM words LEFT JOIN repeats ON words.r = repeats.r),
vals AS ({values}),
buckets AS (SELECT *, {cut} AS b FROM vals),
{shares('everything', [], None)},
{shares('tongue', ['lang'], 'everything')},
{shares('own', ['lang', 'source'], 'tongue')},
quartiles AS (SELECT lang, source, measure, min(b) FILTER (4 * share >= 1) AS q1, min(b) FILTER (4 * share >= 3) AS q3
  FROM own GROUP BY lang, source, measure),
limits AS (SELECT k.r, k.b, k.two, k.spread, q1, q3 FROM buckets k JOIN quartiles q
  ON k.lang IS NOT DISTINCT FROM q.lang AND k.source IS NOT DISTINCT FROM q.source AND k.measure = q.measure
  WHERE NOT k.base_failed),
outside AS (SELECT DISTINCT r FROM limits WHERE b > q3 + {REACH} * greatest(q3 - q1, spread)
  OR (two AND b < q1 - {REACH} * greatest(q3 - q1, spread)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND outside.r IS NULL AS kept FROM measured LEFT JOIN outside ON measured.r = outside.r"""
