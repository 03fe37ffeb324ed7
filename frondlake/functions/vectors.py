"""Array expressions: hashes, probabilities, ranked predictions, losses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_hash(grid: Column, columns: int, rows: int) -> Column:
    """Pack "left neighbour is larger" bits of a row-major grid, first bit highest.

    ``columns`` x ``rows`` cells give ``(columns - 1) * rows`` bits in a signed
    64-bit value (two's complement).
    """
    per_row = columns - 1
    bits = per_row * rows
    if bits > 64:
        raise ValueError(f"{bits} bits do not fit into 64")
    lefts = F.array(*[F.lit(b // per_row * columns + b % per_row) for b in range(bits)])
    return F.aggregate(
        lefts,
        F.lit(0).cast("bigint"),
        lambda packed, left: F.shiftleft(packed, 1).bitwiseOR(
            F.when(F.get(grid, left) > F.get(grid, left + 1), F.lit(1).cast("bigint"))
            .otherwise(F.lit(0).cast("bigint"))
        ),
    )


def hash_text(value: Column) -> Column:
    """Sixteen lower-case hex digits of a 64-bit hash."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def hamming_distance(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    A column named inside a lambda is evaluated anew for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _powers(logits: Column, top: Column) -> Column:
    return F.transform(logits, lambda x: F.exp(x.cast("double") - top))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def softmax(logits: Column) -> Column:
    """Probabilities of a logit array; the maximum is subtracted before ``exp``."""
    def shares(powers: Column) -> Column:
        return bind(_total(powers), lambda total: F.transform(powers, lambda x: x / total))

    return bind(F.array_max(logits), lambda top: bind(_powers(logits, top), shares))


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(probabilities: Column, k: int) -> Column:
    """``array<struct<rank,class_index,confidence>>`` of the ``k`` largest values.

    ``k`` is capped at the array length; ties go to the lower class index.
    """
    if k < 1:
        raise ValueError("top_k must be at least 1")
    ordered = F.array_sort(
        F.transform(
            probabilities, lambda p, i: F.struct((-p).alias("negated"), i.cast("int").alias("at"))
        )
    )
    return F.transform(
        F.slice(ordered, 1, k),
        lambda s, i: F.struct(
            (i + 1).cast("int").alias("rank"),
            s["at"].alias("class_index"),
            (-s["negated"]).alias("confidence"),
        ),
    )


def normalize_channels(pixels: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """Scale interleaved 0-255 channel values to 0-1, then standardise per channel."""
    means = F.array(*[F.lit(float(m)) for m in mean])
    stds = F.array(*[F.lit(float(s)) for s in std])
    channels = len(mean)
    return F.transform(
        pixels,
        lambda x, i: (x.cast("double") / 255.0 - F.get(means, i % channels)) / F.get(stds, i % channels),
    )


def smoothed_cross_entropy(logits: Column, target: Column, weights: Column,
                           smoothing: float) -> Column:
    """Numerator of the class-weighted, label-smoothed cross entropy of one row.

    ``weights`` is an array by class index. The mean of a batch is the sum of
    this value over the sum of the rows' ``weights[target]``.
    """
    def combined(losses: Column) -> Column:
        weighted = _total(F.zip_with(losses, weights, lambda loss, w: loss * w))
        return (
            (1.0 - smoothing) * F.get(losses, target) * F.get(weights, target)
            + smoothing / F.size(losses) * weighted
        )

    def losses(log_total: Column) -> Column:
        return F.transform(logits, lambda x: log_total - x.cast("double"))

    return bind(F.array_max(logits).cast("double"), lambda top: bind(
        top + F.ln(_total(_powers(logits, top))), lambda log_total: bind(losses(log_total), combined)))
