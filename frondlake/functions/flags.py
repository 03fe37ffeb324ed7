"""Quality flags of one inspected image."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def resolution_flags(width: Column, height: Column, *, target: int = C.INPUT_SIZE,
                     ideal: int = C.IDEAL_SIZE, severe: int = C.SEVERE_SIZE) -> dict[str, Column]:
    area = width.cast("bigint") * height.cast("bigint")
    return {
        "small": _known((width < target) | (height < target) | (area < target * target)),
        "below_ideal_resolution": _known((width < ideal) | (height < ideal)),
        "severely_undersized": _known((width < severe) | (height < severe)),
    }


def aspect_ratio(width: Column, height: Column) -> Column:
    """Width over height; NULL for height zero."""
    return F.try_divide(width.cast("double"), height.cast("double"))


def extreme_aspect(ratio: Column, *, low: float = C.MIN_ASPECT, high: float = C.MAX_ASPECT) -> Column:
    return _known((ratio < low) | (ratio > high))


def size_flags(file_size: Column, *, tiny: int = C.TINY_FILE_BYTES,
               large: int = C.LARGE_FILE_BYTES) -> dict[str, Column]:
    return {"tiny_file": _known(file_size < tiny), "large_file": _known(file_size > large)}


def mode_flags(mode: Column, transparent_palette: Column | None = None) -> dict[str, Column]:
    """Channel count, grayscale and alpha flags of a colour mode.

    Unknown modes have NULL channels; any mode spelled with an ``A`` counts as
    having alpha, as does a palette with transparency.
    """
    channels = F.create_map(*[F.lit(x) for item in C.MODE_CHANNELS.items() for x in item])
    alpha = F.contains(mode, F.lit("A"))
    if transparent_palette is not None:
        alpha = alpha | ((mode == "P") & transparent_palette)
    return {
        "channels": F.try_element_at(channels, mode).cast("int"),
        "grayscale": _known(mode.isin(*C.GRAYSCALE_MODES)),
        "has_alpha": _known(alpha),
    }


def _known(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))
