"""Helpers for operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def output_schema(df: DataFrame, added: dict[str, T.DataType]) -> T.StructType:
    """Schema of ``df`` with the added columns last; a column of an added name is replaced."""
    return T.StructType([f for f in df.schema if f.name not in added]
                        + [T.StructField(n, t) for n, t in added.items()])


def replace_column(batch: pa.RecordBatch, added: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [n for n in batch.schema.names if n not in added]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in kept] + list(added.values()), kept + list(added))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its row offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def slices(column: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text; a longer text stands alone."""
    ends = text_bytes(column)[1]
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + size, "right")) - 1)
        yield row, last
        row = last


def tidy() -> None:
    """Give freed memory back to the system: idle workers stay while other stages need it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass
