"""Image headers and completeness without decoding: a walk over the markers of the bytes.

PNG chunks are followed with their checksums from the header to the end chunk, JPEG
segments through every scan to the end marker, GIF blocks to the trailer. Bytes that are
cut, forged or of another kind have no header. The walk skips pixel data by its lengths
(JPEG scans by the next marker) and reads each payload once.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import functions as F

HEADER = "format string, width int, height int, mode string"
# Colour types of PNG, components of JPEG.
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}

Header = tuple[str, int, int, str]


def png_header(data: bytes) -> Header | None:
    at, found, pixels = 8, None, False
    while at + 12 <= len(data):
        length, kind = int.from_bytes(data[at:at + 4]), data[at + 4:at + 8]
        end = at + 12 + length
        if end > len(data) or zlib.crc32(memoryview(data)[at + 4:end - 4]) != int.from_bytes(data[end - 4:end]):
            return None
        if found is None:
            if kind != b"IHDR" or length != 13:
                return None
            depth, colour = data[at + 16], data[at + 17]
            mode = {1: "1", 16: "I;16"}.get(depth, "L") if colour == 0 else PNG_MODES.get(colour)
            found = ("PNG", int.from_bytes(data[at + 8:at + 12]), int.from_bytes(data[at + 12:at + 16]), mode)
        pixels = pixels or kind == b"IDAT"
        if kind == b"IEND":
            return found if pixels and found[1] and found[2] and found[3] else None
        at = end
    return None


def jpeg_header(data: bytes) -> Header | None:
    at, found, scanned = 2, None, False
    while at + 2 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
            continue
        if marker == 0xD9:
            return found if scanned else None
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        length = int.from_bytes(data[at + 2:at + 4])
        if length < 2 or at + 2 + length > len(data):
            return None
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = int.from_bytes(data[at + 5:at + 7]), int.from_bytes(data[at + 7:at + 9])
            mode = JPEG_MODES.get(data[at + 9]) if length >= 8 else None
            if not (height and width and mode):
                return None
            found = ("JPEG", width, height, mode)
        at += 2 + length
        if marker == 0xDA:
            scanned = found is not None
            at = data.find(b"\xff", at)
            while 0 <= at < len(data) - 1 and (data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7):
                at = data.find(b"\xff", at + 2)  # stuffed bytes and restart markers belong to the scan
            if at < 0:
                return None
    return None


def gif_header(data: bytes) -> Header | None:
    def colours(flags: int) -> int:
        return 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def blocks(place: int) -> int:
        """The place behind a chain of data blocks, beyond the bytes if it is cut."""
        while place < len(data) and data[place]:
            place += data[place] + 1
        return place + 1

    if len(data) < 13:
        return None
    found = ("GIF", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), "P")
    at, images = 13 + colours(data[10]), 0
    while at < len(data):
        if data[at] == 0x3B:
            return found if images else None
        if data[at] == 0x21:
            at = blocks(at + 2)
        elif data[at] == 0x2C and at + 10 < len(data):
            images += 1
            at = blocks(at + 11 + colours(data[at + 9]))
        else:
            return None
    return None


def header(data: bytes | None) -> Header | None:
    """``(format, width, height, mode)`` of complete image bytes."""
    if not data:
        return None
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return png_header(data)
    if data.startswith(b"\xff\xd8\xff"):
        return jpeg_header(data)
    if data.startswith((b"GIF87a", b"GIF89a")):
        return gif_header(data)
    return None


def image_header():
    """UDF ``content`` -> header of each payload, NULL fields for bytes that are no complete image."""

    @F.pandas_udf(HEADER)
    def walked(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(c) or (None, None, None, None) for c in content],
                            columns=["format", "width", "height", "mode"]).astype({"width": "Int32", "height": "Int32"})

    return walked
