"""Folder listings as rows.

Directories are rows of a frontier; each pass lists one level in parallel, stores
what it found and goes on with the directories among it. A local directory is
read as a stream of names, and the names, dealt out anew, are looked up
(size and time) by other tasks, so neither a flat folder nor one huge class keeps a task
or the driver busy or full. Other stores return sizes with the names; they are
reached through pyarrow from the workers.

Links to directories are not followed. Entries that vanish meanwhile are left out. An
empty directory is a row of its own; a root that does not exist is an error.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

ENTRY = "path string, directory boolean, file_size bigint, modified timestamp"
_ARROW = pa.schema([("path", pa.string()), ("directory", pa.bool_()), ("file_size", pa.int64()),
                    ("modified", pa.timestamp("us", tz="UTC"))])
NAMES_A_BATCH = 5_000
DIRECTORIES_A_TASK = 64


def _local(uri: str) -> str | None:
    """The local path of a ``file:`` URI."""
    return "/" + uri[5:].lstrip("/") if uri.startswith("file:") else None


def _below(uri: str) -> Iterator[tuple[str, bool, int | None, datetime | None]]:
    """Entries right below a directory; sizes of local files are left to another task."""
    folder = _local(uri)
    if folder is not None:
        with os.scandir(folder) as names:
            for entry in names:
                if entry.is_dir(follow_symlinks=False):
                    yield f"{uri}/{entry.name}", True, None, None
                elif entry.is_file():
                    yield f"{uri}/{entry.name}", False, None, None
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    for entry in store.get_file_info(fs.FileSelector(path)):
        if entry.type == fs.FileType.Directory:
            yield f"{uri}/{entry.base_name}", True, None, None
        elif entry.type == fs.FileType.File:
            yield f"{uri}/{entry.base_name}", False, entry.size, entry.mtime


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == NAMES_A_BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ARROW)], schema=_ARROW)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batches(row for batch in batches for uri in batch.column("path").to_pylist() for row in _below(uri))


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                try:
                    found = os.stat(_local(uri))
                except FileNotFoundError:
                    continue
                yield uri, False, found.st_size, datetime.fromtimestamp(found.st_mtime, timezone.utc)

    return _batches(rows())


def root_uri(root: str) -> str:
    """``root`` with its scheme, without a slash at the end; local paths as ``file:/x``."""
    whole = root.rstrip("/") or "/"
    if ":" not in whole.split("/")[0]:
        whole = os.path.abspath(whole)
        return f"file:{whole}"
    return "file:/" + whole[5:].lstrip("/") if whole.startswith("file:") else whole


def list_entries(spark: SparkSession, root: str) -> DataFrame:
    """``(path, directory, file_size, modified)`` of every file and directory below ``root`` (stored).

    ``file_size`` and ``modified`` of directories are NULL.
    """
    tasks = spark.sparkContext.defaultParallelism
    frontier = spark.createDataFrame([(root_uri(root),)], "path string")
    count, levels = 1, []
    while count:
        dealt = frontier.repartition(min(count, max(tasks, count // DIRECTORIES_A_TASK)))
        names = cut_lineage(dealt.mapInArrow(_list, ENTRY))
        unknown = ~F.col("directory") & F.col("file_size").isNull()
        levels.append(names.where(~unknown))
        if not names.where(unknown).isEmpty():
            levels.append(cut_lineage(names.where(unknown).select("path").repartition(tasks).mapInArrow(_look_up, ENTRY)))
        frontier = names.where("directory").select("path")
        count = frontier.count()
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found
