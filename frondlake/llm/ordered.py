"""Places and running sums inside ordered groups of any size.

Rows are range-partitioned by (group, order), so a hot group spreads over many
partitions. Each partition numbers its rows and sums their measure group by
group while they stream by; what lies in earlier partitions is added afterwards
from one total per (partition, group). Only the first group of a partition can
have begun in an earlier one, so the table of what to add has at most one row a
partition and is broadcast.

Rows: the group column must not be null; equal rows keep a fixed order by their
place in the input. Other columns pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..session import cut_lineage
from .arrow import output_schema, replace_column


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, lengthened until they clash with none of the columns."""
    taken = {c.lower() for c in columns}
    found = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def _number(group: str, measure: str | None, added: tuple[str, str, str]):
    part_name, at_name, before_name = added

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen, summed = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            groups = batch.column(group)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or groups[0].as_py() != last
            values = np.ones(n, np.int64) if measure is None else batch.column(measure).to_numpy(zero_copy_only=False)
            sums = np.concatenate([[0], np.cumsum(values)])
            starts = np.flatnonzero(new)
            run_of = np.searchsorted(starts, np.arange(n), "right") - 1  # -1: the group of the batch before
            begin = np.where(run_of < 0, 0, starts[np.maximum(run_of, 0)]) if len(starts) else np.zeros(n, np.int64)
            carried = run_of < 0
            at = np.arange(n) - begin + np.where(carried, seen, 0)
            before = sums[:-1] - sums[begin] + np.where(carried, summed, 0)
            last, seen, summed = groups[n - 1].as_py(), int(at[-1]) + 1, int(before[-1] + values[-1])
            yield replace_column(batch, {part_name: pa.array(np.full(n, part, np.int32)),
                                         at_name: pa.array(at.astype(np.int64)), before_name: pa.array(before.astype(np.int64))})

    return run


def ranked(df: DataFrame, group: str, order: list[str], measure: str | None = None,
           at: str = "at", before: str | None = None) -> DataFrame:
    """Add ``at``, the place of a row in its group from 0, and ``before``, the measure of the rows before it."""
    part, tie, sums, rows, total = free_names([*df.columns, at, before or at], "part", "tie", "sums", "rows", "total")
    keys = [F.col(group), *[F.col(c).asc_nulls_first() for c in order], F.col(tie)]
    spread = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    added = (part, at, before or sums)
    schema = output_schema(spread, {part: T.IntegerType(), at: T.LongType(), added[2]: T.LongType()})
    stored = cut_lineage(spread.mapInArrow(_number(group, measure, added), schema).drop(tie))
    last = (F.col(added[2]) + (F.lit(1) if measure is None else F.col(measure)))
    totals = stored.groupBy(part, group).agg((F.max(at) + 1).alias(rows), F.max(last).alias(total))
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offset = totals.select(F.col(part).alias("_part"), F.col(group).alias("_group"), F.sum(rows).over(earlier).alias("_rows"),
                           F.sum(total).over(earlier).alias("_total")).where("_rows > 0")  # one row a partition at most
    joined = stored.alias("s").join(F.broadcast(offset), (F.col(f"s.{part}") == F.col("_part")) & (F.col(f"s.{group}") == F.col("_group")), "left")
    columns = [F.col(f"s.`{c}`") for c in df.columns if c not in (at, before)]
    columns.append((F.col(f"s.{at}") + F.coalesce("_rows", F.lit(0))).alias(at))
    if before:
        columns.append((F.col(f"s.{before}") + F.coalesce("_total", F.lit(0))).alias(before))
    return joined.select(*columns)
