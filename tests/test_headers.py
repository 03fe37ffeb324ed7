"""Headers of complete, cut and forged image bytes."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from frondlake.functions import headers
from frondlake.streaming import uploads


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(width=30, height=20, depth=8, colour=2, more=b""):
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + more
            + chunk(b"IDAT", b"pixels") + chunk(b"IEND", b""))


def jpeg(width=30, height=20, parts=3, sof=0xC0, scan=b"data\xff\x00more\xff\xd3rest", scans=1):
    frame = struct.pack(">BHHB", 8, height, width, parts) + b"\x01\x11\x00" * parts
    one = b"\xff\xda" + struct.pack(">H", 8) + b"\x01\x01\x00\x00\x3f\x00" + scan
    return (b"\xff\xd8\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xff" + bytes([sof]) + struct.pack(">H", len(frame) + 2)
            + frame + one * scans + b"\xff\xd9")


def gif(width=30, height=20, colours=1):
    table = bytes(3 << colours + 1)
    return (b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | colours, 0, 0) + table + b"\x21\xf9\x04abcd\x00"
            + b"\x2c" + bytes(8) + b"\x80" + bytes(6) + b"\x08\x03abc\x02de\x00" + b"\x3b")


@pytest.mark.parametrize("data, want", [
    (png(), ("PNG", 30, 20, "RGB")), (png(7, 9, 16, 0), ("PNG", 7, 9, "I;16")), (png(depth=1, colour=0), ("PNG", 30, 20, "1")),
    (png(colour=6, more=chunk(b"tEXt", b"x" * 1000)), ("PNG", 30, 20, "RGBA")), (jpeg(), ("JPEG", 30, 20, "RGB")),
    (jpeg(parts=1, sof=0xC2, scans=3), ("JPEG", 30, 20, "L")), (jpeg(70_00, 5), ("JPEG", 7000, 5, "RGB")), (gif(), ("GIF", 30, 20, "P")),
    (png() + b"after the end", ("PNG", 30, 20, "RGB")), (jpeg() + b"\x00", ("JPEG", 30, 20, "RGB"))])
def test_headers(data, want):
    assert headers.header(data) == want


@pytest.mark.parametrize("data", [png(), jpeg(scan=b"abc\xff\x00def", scans=2), gif()])
def test_cut_bytes_have_none(data):
    for size in range(len(data)):
        assert headers.header(data[:size]) is None


def test_forged_bytes_have_none():
    good = png()
    for at in range(8, len(good)):
        assert headers.header(good[:at] + bytes([good[at] ^ 1]) + good[at + 1:]) is None
    for data in (None, b"", b"text", png(width=0), jpeg(parts=2), b"\x89PNG\r\n\x1a\n" + chunk(b"IEND", b""),
                 b"\xff\xd8\xff\xd9", b"GIF89a" + bytes(7) + b"\x3b", b"\xff\xd8\xff" + b"\xff" * 1000):
        assert headers.header(data) is None


def test_random_bytes_do_not_raise():
    rng = random.Random(2)
    for start in (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"GIF89a", b""):
        for _ in range(300):
            assert headers.header(start + rng.randbytes(rng.randint(0, 60))) is None


def test_uploads_are_rejected_in_order(spark):
    rows = [(1, "image/png", png()), (2, "image/jpeg", jpeg()), (3, "image/png", gif()), (4, "image/png", png()[:-3]), (5, "image/png", b""),
            (6, "image/png", None), (7, "text/plain", png()), (8, None, png()), (9, "image/png", png(more=chunk(b"tEXt", bytes(500))))]
    found = uploads.inspect_uploads(spark.createDataFrame(rows, "n int, content_type string, payload binary"), max_bytes=400)
    got = {r["n"]: (r["reject_reason"], r["format"], r["width"]) for r in found.orderBy(F.col("n")).collect()}
    assert got == {1: (None, "PNG", 30), 2: (None, "JPEG", 30), 3: ("image_format_415", "GIF", 30), 4: ("not_an_image_400", None, None),
                   5: ("empty_400", None, None), 6: ("empty_400", None, None), 7: ("content_type_415", None, None),
                   8: ("content_type_415", None, None), 9: ("too_large_413", None, None)}
