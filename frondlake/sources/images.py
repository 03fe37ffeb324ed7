"""Image folders: listing, class assignment, inspection."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import images as pixels
from ..functions import text, vectors
from ..operators.profile import with_quality
from ..schemas import ASSET_RECORDS
from .listing import list_entries


def extension_glob(extensions: Sequence[str] = C.IMAGE_EXTENSIONS) -> str:
    """Case-insensitive file name pattern for a list of extensions."""
    def either(letter: str) -> str:
        return f"[{letter.lower()}{letter.upper()}]" if letter.isalpha() else letter

    return "*.{" + ",".join("".join(map(either, e.lstrip("."))) for e in extensions) + "}"


def _plain(path: Column) -> Column:
    """The two sources spell local paths ``file:/x`` and ``file:///x``."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _relative(path: Column, root: str) -> Column:
    base = re.sub("^file:/+", "file:/", root.rstrip("/"))
    if ":" not in base.split("/")[0]:
        base = "file:" + base
    return F.when(
        F.startswith(path, F.lit(base + "/")), F.substring(path, len(base) + 2, 1 << 30)
    ).otherwise(path)


def _reader(spark: SparkSession, source: str, extensions: Sequence[str]):
    return (spark.read.format(source).option("recursiveFileLookup", True)
            .option("pathGlobFilter", extension_glob(extensions)))


def list_images(spark: SparkSession, root: str, extensions: Sequence[str] = C.IMAGE_EXTENSIONS, *,
                include_empty: bool = True) -> DataFrame:
    """``(path, relative_path, file_size, modified)`` of every image file below ``root``.

    File contents are not read. The listing is made of rows level by level
    (``listing.list_entries``). Without ``include_empty`` Spark's own file index is used,
    which reaches any store Spark reads but is kept in the driver and skips empty files.
    """
    if include_empty:
        found = _image_files(spark, root, extensions)
    else:
        found = _reader(spark, "binaryFile", extensions).load(root).select(
            _plain(F.col("path")).alias("path"), F.col("length").alias("file_size"),
            F.col("modificationTime").alias("modified"))
    return found.withColumn("relative_path", _relative(F.col("path"), root))


def _image_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    files = list_entries(spark, root).where(~F.col("directory") & text.file_extension(F.col("path")).isin(
        *[e.lower() for e in extensions]))
    return files.select("path", "file_size", "modified")


def empty_files(spark: SparkSession, root: str,
                extensions: Sequence[str] = C.IMAGE_EXTENSIONS) -> DataFrame:
    """``(path, file_size, modified)`` of the zero-length image files below ``root``, which Spark's sources skip."""
    return _image_files(spark, root, extensions).where("file_size = 0")


def list_directories(spark: SparkSession, root: str) -> DataFrame:
    """``(path, relative_directory)`` of every directory below ``root``, empty ones included."""
    found = list_entries(spark, root).where("directory").select("path")
    return found.withColumn("relative_directory", _relative(F.col("path"), root))


def with_class(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add ``class_id`` from the class directory a file lies below; other files are dropped.

    A file is matched through each of its ancestor directories, an equi-join on
    the catalog, so nested class directories both claim it.
    """
    pieces = F.split("relative_path", "/")
    ancestors = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda n: n > 0),
        lambda n: F.array_join(F.slice(pieces, 1, n), "/"),
    )
    classes = catalog.select(F.col("id").alias("class_id"), F.col("relative_directory").alias("_directory"))
    return files.withColumn("_directory", F.explode(ancestors)).join(classes, "_directory").drop("_directory")


def _starts(content: Column, hex_bytes: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(hex_bytes) // 2)) == hex_bytes


def container_format(content: Column) -> Column:
    """Image format by leading bytes, NULL when none matches."""
    # Magic numbers.
    return (
        F.when(_starts(content, "FFD8FF"), "jpeg")
        .when(_starts(content, "89504E470D0A1A0A"), "png")
        .when(_starts(content, "424D"), "bmp")
        .when(_starts(content, "47494638"), "gif")
        .when(_starts(content, "49492A00") | _starts(content, "4D4D002A"), "tiff")
        .when(_starts(content, "52494646") & _starts(content, "57454250", 9), "webp")
    )


def complete_format(content: Column) -> Column:
    """Image format of bytes that are whole from the first to the last marker, NULL for others.

    A PNG ends in its end chunk, a JPEG in its end marker, a GIF in its trailer;
    BMP and WebP state their length. It tells truncated and made-up payloads
    from images, but decodes no pixels.
    """
    size = F.octet_length(content)

    def little_endian(at: int) -> Column:
        return F.conv(F.concat(*[F.hex(F.substring(content, at + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("bigint")

    kind = container_format(content)
    whole = (
        F.when(kind == "png", (size >= 57) & F.endswith(F.hex(content), F.lit("0000000049454E44AE426082"))
               & (F.hex(F.substring(content, 9, 8)) == "0000000D49484452"))
        .when(kind == "jpeg", (size > 4) & F.endswith(F.hex(content), F.lit("FFD9")))
        .when(kind == "gif", (size > 13) & F.endswith(F.hex(content), F.lit("3B")))
        .when(kind == "bmp", little_endian(3) == size)
        .when(kind == "webp", little_endian(5) + 8 == size)
        .otherwise(kind == "tiff")
    )
    return F.when(whole, kind)


def png_mode(content: Column) -> Column:
    """Colour mode from a PNG header (bit depth and colour type), NULL for other bytes."""
    depth, colour = F.hex(F.substring(content, 25, 1)), F.hex(F.substring(content, 26, 1))
    return F.when(container_format(content) == "png", (
        F.when(colour == "00", F.when(depth == "01", "1").when(depth == "10", "I;16").otherwise("L"))
        .when(colour == "02", "RGB").when(colour == "03", "P")
        .when(colour == "04", "LA").when(colour == "06", "RGBA")
    ))


def png_transparency(content: Column) -> Column:
    """Whether a palette PNG has a transparency chunk."""
    letters = F.decode(content, "ISO-8859-1")
    chunk, pixels_at = F.instr(letters, "tRNS"), F.instr(letters, "IDAT")
    # It stands before the pixels, whose compressed bytes may spell it by chance.
    return F.when(
        png_mode(content) == "P", (chunk > 0) & ((pixels_at == 0) | (chunk < pixels_at))
    ).otherwise(False)


def inspect_images(spark: SparkSession, root: str, catalog: DataFrame | None = None,
                   extensions: Sequence[str] = C.IMAGE_EXTENSIONS, *,
                   include_empty: bool = True) -> DataFrame:
    """One inspection record per image file; a broken file is a record with ``valid = false``.

    Bytes are hashed in one scan and decoded by the JVM in another. Both scans
    drop the image data before their results meet, so only short rows are
    shuffled. Keep the result (write it, or ``session.cut_lineage``) before
    running several reports on it.
    """
    hashed = _reader(spark, "binaryFile", extensions).load(root).select(
        _plain(F.col("path")).alias("path"),
        F.col("length").alias("file_size"),
        F.sha2("content", 256).alias("sha256"),
        container_format(F.col("content")).alias("_container"),
        png_mode(F.col("content")).alias("_png_mode"),
        png_transparency(F.col("content")).alias("_transparent"),
    )
    decoded = _reader(spark, "image", extensions).option("dropInvalid", False).load(root)
    image = F.col("image")
    grid = pixels.gray_grid()(image["data"], image["height"], image["width"], image["nChannels"])
    shapes = decoded.select(
        _plain(image["origin"]).alias("path"),
        F.when(image["height"] > 0, image["height"]).alias("height"),
        F.when(image["width"] > 0, image["width"]).alias("width"),
        image["nChannels"].alias("_bands"), grid.alias("_grid"),
    ).withColumn("dhash", vectors.difference_hash(F.col("_grid"), C.HASH_SIDE + 1, C.HASH_SIDE))
    shapes = shapes.select("path", "height", "width", "_bands",
                           F.when(F.col("_grid").isNotNull(), F.col("dhash")).alias("dhash"))
    if include_empty:
        none = empty_files(spark, root, extensions).select(
            "path", "file_size", F.sha2(F.lit(b""), 256).alias("sha256"))
        hashed = hashed.unionByName(none, allowMissingColumns=True)
    records = hashed.join(shapes, "path", "left")
    records = records.withColumns({
        "valid": F.coalesce(F.col("width") > 0, F.lit(False)),
        "relative_path": _relative(F.col("path"), root),
        "error": F.when(F.coalesce(F.col("width"), F.lit(0)) <= 0, "the image cannot be decoded"),
    })
    mode = F.coalesce("_png_mode", F.when(F.col("_container") == "gif", "P"), F.when(
        F.col("_bands") == 1, "L").when(F.col("_bands") == 3, "RGB").when(F.col("_bands") == 4, "RGBA"))
    records = records.withColumn("mode", mode)
    return _finish(records, catalog)


def _finish(records: DataFrame, catalog: DataFrame | None) -> DataFrame:
    """Common tail of both inspections: format fallback, flags, class, column order."""
    records = records.withColumns({
        "mode": F.when(F.col("valid"), F.col("mode")),
        "format": F.when(F.col("valid") & F.col("_container").isNotNull(), F.col("_container"))
        .otherwise(F.ltrim(text.file_extension(F.col("path")), F.lit("."))),
    })
    full = with_quality(records, transparent_palette=F.col("_transparent"))
    if catalog is not None:
        full = with_class(full, catalog)
    elif "class_id" not in full.columns:
        full = full.withColumn("class_id", F.lit(None).cast("int"))
    return full.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ASSET_RECORDS])


def inspect_contents(rows: DataFrame, decode: Callable[[bytes], tuple[str, str, bool, np.ndarray]], *,
                     content_col: str = "content", catalog: DataFrame | None = None) -> DataFrame:
    """Inspection records of images kept in a table column, for collections too large for loose files.

    ``rows`` has ``path``, ``relative_path`` and the bytes; ``decode`` returns
    ``(format, mode, transparent palette, uint8 array (height, width, channels))``
    with RGB order, or raises for a broken image. Bytes are read once and never
    shuffled.
    """
    grid_of = pixels.gray_of

    @F.pandas_udf("valid boolean, width int, height int, _container string, mode string, _transparent boolean, "
                  "_grid array<int>, error string")
    def inspected(contents: pd.Series) -> pd.DataFrame:
        made = []
        for content in contents:
            try:
                kind, mode, transparent, image = decode(content)
                height, width = image.shape[:2]
                made.append((True, width, height, kind.lower(), mode, transparent, grid_of(image), None))
            except Exception as problem:  # a broken image is a finding, not a failure
                made.append((False, None, None, None, None, False, None, str(problem) or type(problem).__name__))
        return pd.DataFrame(made, columns=["valid", "width", "height", "_container", "mode", "_transparent",
                                           "_grid", "error"])

    looked = rows.select(
        *[c for c in ("path", "relative_path", "class_id") if c in rows.columns],
        F.octet_length(content_col).cast("bigint").alias("file_size"),
        F.sha2(content_col, 256).alias("sha256"), inspected(F.col(content_col)).alias("i"),
    )
    flat = looked.select("*", "i.*").drop("i")
    hashed = vectors.difference_hash(F.col("_grid"), C.HASH_SIDE + 1, C.HASH_SIDE)
    return _finish(flat.withColumn("dhash", F.when(F.col("valid"), hashed)), catalog)


def read_model_input(spark: SparkSession, root: str, size: int = C.INPUT_SIZE,
                     extensions: Sequence[str] = C.IMAGE_EXTENSIONS) -> DataFrame:
    """``(image, features)``: decoded, resized and standardised images, NULL features when broken."""
    decoded = _reader(spark, "image", extensions).option("dropInvalid", False).load(root)
    image = F.col("image")
    made = pixels.model_input(size)(image["data"], image["height"], image["width"], image["nChannels"])
    return decoded.select(
        _relative(_plain(image["origin"]), root).alias("image"), made.alias("features")
    )
