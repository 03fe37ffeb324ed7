"""Arrow UDFs on decoded pixels: gray grids for hashing, model input.

Decoding itself is done by Spark's ``image`` source. Spark has no resize
expression, so these two steps run on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.clip(1 - np.abs(x), 0, None)


@lru_cache(maxsize=256)
def resampling_matrix(source: int, target: int, kernel: str = "lanczos") -> np.ndarray:
    """``(target, source)`` weights of an antialiased one-dimensional resize."""
    function, radius = {"lanczos": (_lanczos, 3.0), "bilinear": (_triangle, 1.0)}[kernel]
    scale = source / target
    stretch = max(scale, 1.0)
    centers = (np.arange(target) + 0.5) * scale
    offsets = (np.arange(source)[None, :] + 0.5 - centers[:, None]) / stretch
    weights = np.where(np.abs(offsets) < radius, function(offsets), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


@lru_cache(maxsize=256)
def _windows(source: int, target: int, kernel: str) -> tuple[np.ndarray, np.ndarray]:
    """The non-zero run of each row of the matrix as ``(target, taps)`` positions and weights."""
    matrix = resampling_matrix(source, target, kernel)
    used = matrix != 0
    first = used.argmax(axis=1)
    last = source - 1 - used[:, ::-1].argmax(axis=1)
    at = first[:, None] + np.arange((last - first).max() + 1)[None, :]
    inside = at < source
    at = np.minimum(at, source - 1)
    return at, np.where(inside, np.take_along_axis(matrix, at, axis=1), 0.0)


def _across(plane: np.ndarray, target: int, kernel: str) -> np.ndarray:
    """Resize the columns of a plane; few taps are summed, many are multiplied as a matrix."""
    source = plane.shape[1]
    at, weights = _windows(source, target, kernel)
    if at.shape[1] * 4 > source:
        return plane @ resampling_matrix(source, target, kernel).T
    made = np.zeros((plane.shape[0], target))
    for tap in range(at.shape[1]):
        made += plane[:, at[:, tap]] * weights[:, tap]
    return made


def pixels_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """RGB or gray ``uint8`` array from the image source's row-major BGR(A) bytes."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return pixels if channels == 1 else pixels[:, :, 2::-1]


def to_gray(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] == 1:
        return pixels[:, :, 0].astype(np.float64)
    # ITU-R 601 luma in 16-bit fixed point.
    red, green, blue = (pixels[:, :, c].astype(np.int64) for c in range(3))
    return ((red * 19595 + green * 38470 + blue * 7471 + 32768) >> 16).astype(np.float64)


def resize(plane: np.ndarray, height: int, width: int, kernel: str) -> np.ndarray:
    """Resize one 8-bit plane, rows first, rounding to 8 bits after each pass."""
    def byte(values: np.ndarray) -> np.ndarray:
        return np.clip(np.floor(values + 0.5), 0, 255)

    return byte(_across(byte(_across(plane, width, kernel)).T, height, kernel).T)


def gray_of(pixels: np.ndarray, columns: int = C.HASH_SIDE + 1, rows: int = C.HASH_SIDE) -> np.ndarray:
    """Row-major gray grid of a gray or RGB image."""
    return resize(to_gray(pixels), rows, columns, "lanczos").astype(np.int32).ravel()


def gray_grid(columns: int = C.HASH_SIDE + 1, rows: int = C.HASH_SIDE):
    """UDF ``(data, height, width, nChannels)`` -> row-major gray grid, NULL when undecoded."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def grid(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        made = []
        for d, h, w, c in zip(data, height, width, channels):
            if d is None or h is None or h <= 0 or w <= 0:
                made.append(None)
            else:
                made.append(gray_of(pixels_of(d, int(h), int(w), int(c)), columns, rows))
        return pd.Series(made)

    return grid


def model_input(size: int = C.INPUT_SIZE, mean: Sequence[float] = C.CHANNEL_MEAN,
                std: Sequence[float] = C.CHANNEL_STD):
    """UDF ``(data, height, width, nChannels)`` -> standardised planar RGB values.

    The array holds ``3 * size * size`` values, channel by channel.
    """
    means = np.asarray(mean, dtype=np.float32)[:, None, None]
    stds = np.asarray(std, dtype=np.float32)[:, None, None]

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def prepared(data: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.Series:
        made = []
        for d, h, w, c in zip(data, height, width, channels):
            if d is None or h is None or h <= 0 or w <= 0:
                made.append(None)
                continue
            pixels = pixels_of(d, int(h), int(w), int(c))
            if pixels.shape[2] == 1:
                pixels = np.repeat(pixels, 3, axis=2)
            planes = np.stack([
                resize(pixels[:, :, i].astype(np.float64), size, size, "bilinear") for i in range(3)
            ]).astype(np.float32)
            made.append((((planes / np.float32(255)) - means) / stds).ravel())
        return pd.Series(made)

    return prepared
