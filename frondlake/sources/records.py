"""Records of CSV files with the line each begins on, quoted line breaks included.

A file is read in splits, and whether a split begins inside quotes depends on all
before it. So every split is first described for both cases (quotes open or not):
its number of lines, the case it ends in, and the line its last record begins on. These
few numbers, one row a split, are composed in file order; then the splits are
read again, each from its known case. Records of one line stay where they are; only
the lines of longer ones meet by file and first line.

Quotes are doubled inside quotes; a quote inside an unquoted field is a character. Lines end
in a line feed, with or without a carriage return. An unclosed quote makes the rest of its
file one record. Empty lines are no records; empty files have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Options with which Spark writes fields as they are, for ``read_records`` and other readers of the standard format.
CSV_OPTIONS = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_SPLIT = "file string, block bigint, lines bigint, open_after boolean, closed_after boolean, open_last bigint, closed_last bigint"
_START = "file string, block bigint, first_line bigint, inside boolean, open_line bigint"
_LINE = "file string, line bigint, start bigint, value string, whole boolean"


def inside_after(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether quotes are open at the end of a line that begins inside or outside of them."""
    at, fresh = 0, not inside
    if '"' not in line:
        return inside
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, fresh, at = False, False, at + 1
        elif fresh and line.startswith('"', at):
            inside, at = True, at + 1
        else:
            at = line.find(separator, at) + 1
            if not at:
                return False
            fresh = True


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(zip(*rows), fields)], [n for n, _ in fields])


def _describe(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, []
        for batch in batches:
            for file, block, line in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "value"))):
                if key != (file, block):
                    if key:
                        yield _table([(*key, *state)], _SPLIT)
                    key, state = (file, block), [0, True, False, -1, -1]  # begun with open quotes, or not
                for case, last in ((1, 3), (2, 4)):
                    if not state[case]:
                        state[last] = state[0]
                    state[case] = inside_after(line, state[case], separator)
                state[0] += 1
        if key:
            yield _table([(*key, *state)], _SPLIT)

    return run


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Splits in file order to the case and line each begins with."""
    file, lines, inside, open_line = None, 0, False, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if row["file"] != file:
                file, lines, inside, open_line = row["file"], 0, False, None
            out.append((file, row["block"], lines + 1, inside, open_line))
            last = row["open_last"] if inside else row["closed_last"]
            open_line = open_line if last < 0 else lines + last + 1
            inside = row["open_after"] if inside else row["closed_after"]
            lines += row["lines"]
        if out:
            yield _table(out, _START)


def _number(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, inside, start = None, 0, False, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if key != (row["file"], row["block"]):
                    key = (row["file"], row["block"])
                    at, inside, start = row["first_line"], row["inside"], row["open_line"]
                begins = not inside
                start = at if begins else start
                inside = inside_after(row["value"], inside, separator)
                out.append((row["file"], at, start, row["value"], begins and not inside))
                at += 1
            if out:
                yield _table(out, _LINE)

    return run


def read_records(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """``(file, line, record)``: the text of every record and the 1-based line of its file it begins on."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = lines.mapInArrow(_describe(separator), _SPLIT)
    starts = splits.repartition("file").sortWithinPartitions("file", "block").mapInArrow(_compose, _START)
    known = F.broadcast(starts.withColumnsRenamed({"file": "_file", "block": "_block"}))  # one row a split
    placed = lines.join(known, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).select(
        "file", "block", "value", "first_line", "inside", "open_line").mapInArrow(_number(separator), _LINE)
    several = placed.where("NOT whole").groupBy("file", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n").alias("record"))
    found = placed.where("whole").select("file", F.col("start").alias("line"), F.col("value").alias("record")).unionByName(
        several.select("file", F.col("start").alias("line"), "record"))
    return found.withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
