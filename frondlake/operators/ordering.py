"""Exact ranks and percentiles without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage


def shuffle_key(id_column: Column, seed: int, epoch: int = 0) -> Column:
    """Hex text that orders rows in a seeded pseudo-random permutation."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.lit(epoch), id_column.cast("string")))


def rank_by_digest(df: DataFrame, digest: str, into: str = "rank", digits: int = 4) -> DataFrame:
    """Add the exact 1-based rank of every row in the order of a hex digest column.

    The first ``digits`` hex digits split the rows into at most ``16 ** digits``
    evenly filled buckets (a digest is uniform). Only the bucket counts are
    accumulated in one place; the sort runs inside each bucket. ``digest`` must
    be unique, i.e. the digest of a unique id.
    """
    bucket = F.substring(F.col(digest), 1, digits)
    tagged = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_bucket").orderBy(digest)
    return (
        tagged.join(offsets, "_bucket")
        .withColumn(into, F.col("_before") + F.row_number().over(inside))
        .drop("_bucket", "_before")
    )


# A pass cuts an interval of values in so many buckets; one with so few rows is ordered at last.
BUCKETS = 1024
FEW_ROWS = 1 << 14


def exact_percentiles(df: DataFrame, group_by: Sequence[str], metrics: Mapping[str, Column],
                      probabilities: Mapping[str, float], few: int = FEW_ROWS) -> DataFrame:
    """Exact linearly interpolated percentiles, one ``<metric>_<name>`` column each.

    Multi-pass selection. The first pass takes number, minimum and maximum of
    every group and metric. Each further pass reads the rows again, keeps those in
    the intervals that still hold a wanted rank, counts them in buckets whose width
    follows from the interval, and narrows the interval to the extremes of the
    bucket with the rank. An interval ends as one value, or with at most ``few``
    rows, whose values are then counted and ordered. So no exchange carries the
    values: at most ``BUCKETS`` sums per task and interval, and ``few`` values per
    interval at the end. A pass divides the rows of an interval by about a thousand,
    a dense one is cut off from outliers by its extremes; two or three passes do for
    any number of rows. NULL and NaN are ignored; groups without values are absent.
    """
    keys = [f"_g{i}" for i in range(len(group_by))]
    series = [*keys, "_metric"]
    melted = df.select(
        *[F.col(g).alias(k) for g, k in zip(group_by, keys)],
        F.explode(F.array(*[F.struct(F.lit(i).alias("_metric"), value.cast("double").alias("_value"))
                            for i, value in enumerate(metrics.values())])).alias("_m"),
    ).select(*keys, "_m.*").where(F.col("_value").isNotNull() & ~F.isnan("_value"))

    def rank(p: float, upper: bool) -> Column:
        position = (F.col("_total") - 1) * F.lit(float(p))
        return (F.ceil(position) if upper else F.floor(position)).cast("bigint")

    whole = melted.groupBy(*series).agg(
        F.count(F.lit(1)).alias("_total"), F.min("_value").alias("_lo"), F.max("_value").alias("_hi"))
    wanted = F.array_distinct(F.array(*[rank(p, up) for p in probabilities.values() for up in (False, True)]))
    targets = cut_lineage(whole.select(
        *series, "_total", "_lo", "_hi", F.col("_total").alias("_n"), F.lit(0).cast("bigint").alias("_before"),
        F.explode(wanted).alias("_rank")))
    interval = [*series, "_lo", "_hi"]

    def inside(intervals: DataFrame) -> DataFrame:
        """The rows of some intervals; these are disjoint within a series."""
        named = intervals.select(*[F.col(c).alias(f"{c}_") for c in interval]).distinct()
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in series])
        within = (F.col("_value") >= F.col("_lo_")) & (F.col("_value") <= F.col("_hi_"))
        return melted.join(named, same & within).select(*series, "_value", F.col("_lo_").alias("_lo"), F.col("_hi_").alias("_hi"))

    def located(rows: DataFrame, counted: DataFrame) -> DataFrame:
        """Targets with the counted part (``_c`` rows, ``_first`` to ``_last``) their rank falls in."""
        upto = Window.partitionBy(*interval).orderBy("_first").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counted.withColumn("_upto", F.sum("_c").over(upto)).select(
            *[F.col(c).alias(f"{c}_") for c in interval], "_c", "_first", "_last", "_upto")
        same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in interval])
        behind = F.col("_rank") - F.col("_before")
        return rows.join(summed, same & (behind < F.col("_upto")) & (behind >= F.col("_upto") - F.col("_c")))

    wide = (F.col("_lo") < F.col("_hi")) & (F.col("_n") > few)
    while not targets.where(wide).isEmpty():
        share = (F.col("_value") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        bucket = (F.when(F.col("_value") == F.col("_lo"), 0).when(F.col("_value") == F.col("_hi"), BUCKETS - 1)
                  .otherwise(F.least(F.floor(F.nanvl(share, F.lit(0.5)) * BUCKETS), F.lit(BUCKETS - 1))))
        counted = inside(targets.where(wide)).groupBy(*interval, bucket.alias("_bucket")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_value").alias("_first"), F.max("_value").alias("_last"))
        narrowed = located(targets.where(wide), counted).select(
            *series, "_total", F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), F.col("_c").alias("_n"),
            (F.col("_before") + F.col("_upto") - F.col("_c")).alias("_before"), "_rank")
        targets = cut_lineage(targets.where(~wide).unionByName(narrowed))

    ended = targets.where("_lo = _hi").select(*series, "_total", "_rank", F.col("_lo").alias("_at"))
    rest = targets.where("_lo < _hi")
    ordered = inside(rest).groupBy(*interval, "_value").agg(F.count(F.lit(1)).alias("_c")).withColumns(
        {"_first": F.col("_value"), "_last": F.col("_value")})
    placed = located(rest, ordered).select(*series, "_total", "_rank", F.col("_first").alias("_at"))
    found = ended.unionByName(placed)

    def at(number: int, p: float, upper: bool) -> Column:
        return F.max(F.when((F.col("_metric") == number) & (F.col("_rank") == rank(p, upper)), F.col("_at")))

    columns = []
    for number, metric in enumerate(metrics):
        total = F.max(F.when(F.col("_metric") == number, F.col("_total")))
        for name, p in probabilities.items():
            low, high, position = at(number, p, False), at(number, p, True), (total - 1) * F.lit(float(p))
            columns.append((low + F.when(high == low, 0.0).otherwise(high - low) * (position - F.floor(position)))
                           .alias(f"{metric}_{name}"))
    result = found.groupBy(*keys).agg(*columns) if keys else found.agg(*columns)
    return result.select(*[F.col(k).alias(g) for k, g in zip(keys, group_by)], *[f"{m}_{n}" for m in metrics for n in probabilities])
