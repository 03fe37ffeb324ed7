"""Temperature mixing of sources.

Token shares ``p`` of the sources become weights ``p ** a / sum(p ** a)``; a smaller
exponent gives a flatter mix. The exponent is found by bisection on a dyadic
grid: the flattest mix whose largest number of repeats of a source stays within
``max_repeats``, or the steepest mix whose entropy (in nats) still reaches
``entropy``. One pass over the source table makes several bisection steps. The
budget is given in tokens or, by default, the least one that repeats no
source less than once, so that no document is lost.

Realising a weight: a source with budget ``q`` and ``t`` tokens gets ``floor(q / t)``
whole passes and, of one more, the leading blocks of a seeded permutation of its
blocks as long as they fit the rest. Documents belong to a block by a digest of
their key. A source is described by its number of passes and the position of
its last block, so documents meet one row per source: a broadcast if these are
counted to be at most ``BROADCAST_SOURCES``, else a join that Spark can split for a
hot source.

Rows: null text has no tokens; a null source is a source of its own; a source
without tokens has weight 0 and is passed once. Repeated rows count and are
mixed like other rows; the length of a text changes nothing but its weight. Input columns pass unchanged, whatever their names; ``mix_pass`` replaces one of
that name. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .ordered import free_names

MAX_REPEATS = 2.0
STEPS = 14
STEPS_A_PASS = 7
BLOCK_DIGITS = 3
SEED = "mix"
BROADCAST_SOURCES = 100_000


def tokens(text: str) -> Column:
    """Whitespace-separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("long")


def block(key: str) -> Column:
    return F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, BLOCK_DIGITS)


def position(source: Column, block_: Column, seed: str) -> Column:
    """Place of a block in the permutation of its source."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(source, F.lit("")), block_).cast("binary"))


def exponent(sources: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None,
             budget: float | None = None) -> float:
    """Bisect the exponent for a table of (source, tokens); only sums are collected.

    Repeats and entropy fall as the exponent grows. A repetition limit that even the
    shares as they are miss (exponent 1) gives 1; an entropy above that of equal
    weights gives 0.
    """
    known = sources.where("tokens > 0").select("tokens")
    total = known.agg(F.sum("tokens")).first()[0]
    if total is None:
        return 1.0
    power = F.pow("p", F.col("a"))

    def reached(r) -> bool:
        """Whether the exponent is large enough (repeats), or too large (entropy)."""
        if entropy is not None:
            return math.log(r["z"]) - r["e"] / r["z"] < entropy - 1e-12
        repeats = r["most"] / r["least"] if budget is None else r["most"] / r["z"] * budget / total
        return repeats <= max_repeats + 1e-12

    low, high = -1, 1 << STEPS  # the first grid point that is reached lies in (low, high]
    while high - low > 1:
        step = -(-(high - low) >> STEPS_A_PASS) or 1
        points = list(range(low + step, high, step))
        sums = known.select((F.col("tokens") / F.lit(float(total))).alias("p"), F.explode(F.array(*map(F.lit, points))).alias(
            "k")).withColumn("a", F.col("k") / F.lit(float(1 << STEPS))).groupBy("k").agg(
            F.sum(power).alias("z"), F.sum(power * F.col("a") * F.log("p")).alias("e"),
            F.max(F.pow("p", F.col("a") - 1)).alias("most"), F.min(F.pow("p", F.col("a") - 1)).alias("least")).collect()
        first = min((r["k"] for r in sums if reached(r)), default=high)
        low, high = max([k for k in points if k < first], default=low), first
    return (high if entropy is None else max(low, 0)) / (1 << STEPS)


def passes(measured: DataFrame, sources: DataFrame, alpha: float, budget: float | None, seed: str) -> DataFrame:
    """(source, weight, whole, last): whole passes and the position of the last block of a further one."""
    share = F.when(F.col("tokens") > 0, F.pow("tokens", F.lit(alpha))).otherwise(0.0)
    sums = sources.agg(F.sum(share).alias("z"), F.min(F.when(
        F.col("tokens") > 0, share / F.col("tokens"))).alias("least")).first()  # two numbers
    z, least = sums["z"] or 1.0, sums["least"] or 1.0
    size = z / least if budget is None else float(budget)
    weighted = sources.withColumn("weight", share / F.lit(z)).withColumn(
        "ratio", F.when(F.col("tokens") > 0, F.col("weight") * size / F.col("tokens")).otherwise(1.0)).withColumn(
        "whole", F.floor(F.col("ratio") + 1e-9).cast("int")).withColumn(
        "rest", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)) * F.col("tokens"))
    blocks = measured.groupBy("source", "block").agg(F.sum("tokens").alias("n")).withColumn(
        "at", position(F.col("source"), F.col("block"), seed))
    order = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = blocks.withColumn("run", F.sum("n").over(order)).alias("b").join(
        weighted.alias("w"), F.col("b.source").eqNullSafe(F.col("w.source")))
    last = F.max(F.when(F.col("run") <= F.col("rest") + 1e-6, F.col("at"))).alias("last")
    return running.groupBy(F.col("w.source").alias("source"), "weight", "whole").agg(last)


def mix(docs: DataFrame, max_repeats: float = MAX_REPEATS, entropy: float | None = None, budget: float | None = None,
        text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with ``mix_pass`` from 0."""
    own = docs.select(F.col(source).alias("source"), block(key).alias("block"), tokens(text).alias("tokens"))
    measured = cut_lineage(own.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")))
    sources = measured.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    alpha = exponent(sources, max_repeats, entropy, budget)
    kept = [c for c in docs.columns if c != "mix_pass"]
    at, of, whole, last = free_names([*docs.columns, "mix_pass"], "at", "of", "whole", "last")
    taken = passes(measured, sources, alpha, budget, seed).select(
        F.col("source").alias(of), F.col("whole").alias(whole), F.col("last").alias(last))
    if sources.count() <= BROADCAST_SOURCES:  # a hundred bytes each; beyond it Spark joins and splits hot sources
        taken = F.broadcast(taken)
    joined = docs.select(*kept, position(F.col(source), block(key), seed).alias(at)).join(
        taken, F.col(source).eqNullSafe(F.col(of)), "left")
    times = F.col(whole) + F.coalesce((F.col(at) <= F.col(last)).cast("int"), F.lit(0))
    numbers = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return joined.select(*kept, F.explode(numbers).alias("mix_pass"))


def sql(documents: str = "documents") -> str:
    """Plain SQL of the mix with the default settings: every grid point is tried."""
    return f"""
WITH docs AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'),
  lambda x: x <> '')) AS n_tokens, substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {BLOCK_DIGITS}) AS block FROM {documents}),
sources AS (SELECT source, sum(n_tokens) AS t FROM docs GROUP BY source),
shares AS (SELECT t / (SELECT sum(t) FROM sources)::DOUBLE AS p FROM sources WHERE t > 0),
grid AS (SELECT k / {float(1 << STEPS)} AS a FROM range(0, {(1 << STEPS) + 1}) AS g(k)),
fit AS (SELECT coalesce(min(a), 1.0) AS a FROM (SELECT a FROM grid, shares GROUP BY a
  HAVING max(pow(p, a - 1)) / min(pow(p, a - 1)) <= {MAX_REPEATS} + 1e-12)),
sized AS (SELECT source, t, CASE WHEN t > 0 THEN pow(t, (SELECT a FROM fit)) ELSE 0 END AS s FROM sources),
ratios AS (SELECT source, t, CASE WHEN t > 0 THEN s / (SELECT min(s / t) FROM sized WHERE t > 0) / t ELSE 1.0 END AS r FROM sized),
wholes AS (SELECT source, t, floor(r + 1e-9)::INT AS whole, greatest(r - floor(r + 1e-9), 0) * t AS rest FROM ratios),
blocks AS (SELECT source, block, md5('{SEED}|' || coalesce(source, '') || '|' || block) AS place, sum(n_tokens) AS n
  FROM docs GROUP BY source, block),
runs AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY place) AS run FROM blocks),
copies AS (SELECT b.source, b.block, whole + CASE WHEN run <= rest + 1e-6 THEN 1 ELSE 0 END AS times
  FROM runs b JOIN wholes w ON b.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, d.source, n_tokens, unnest(range(0, times))::INT AS mix_pass
FROM docs d JOIN copies c ON d.source IS NOT DISTINCT FROM c.source AND d.block = c.block"""
