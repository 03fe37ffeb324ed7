"""Uploads: triage, scoring and append to the history, once per upload."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as C
from ..functions.headers import image_header
from ..operators.ordering import rank_by_digest
from ..sources import history as table

# Ids of one streamed batch start at batch_id * BATCH_IDS.
BATCH_IDS = 1 << 40


def reject_reason(content_type: Column, size: Column, decoded_format: Column, *,
                  max_bytes: int = C.MAX_UPLOAD_BYTES) -> Column:
    """First failed check of an upload, NULL when it is accepted.

    ``decoded_format`` is the image format found in the bytes, NULL when they
    are no image. The codes end in the HTTP status such an upload would get.
    """
    return (
        F.when(~F.coalesce(content_type.isin(*C.UPLOAD_CONTENT_TYPES), F.lit(False)),
               "content_type_415")
        .when(F.coalesce(size, F.lit(0)) == 0, "empty_400")
        .when(size > max_bytes, "too_large_413")
        .when(decoded_format.isNull(), "not_an_image_400")
        .when(~F.upper(decoded_format).isin(*C.UPLOAD_FORMATS), "image_format_415")
    )


def triage(uploads: DataFrame, decoded_format: Column, *, content_type: str = "content_type",
           payload: str = "payload", max_bytes: int = C.MAX_UPLOAD_BYTES) -> DataFrame:
    """Add ``file_size`` and ``reject_reason``; works on batches and streams."""
    size = F.octet_length(payload).cast("bigint")
    return uploads.withColumns({
        "file_size": size,
        "reject_reason": reject_reason(F.col(content_type), size, decoded_format, max_bytes=max_bytes),
    })


def inspect_uploads(uploads: DataFrame, *, content_type: str = "content_type", payload: str = "payload",
                    max_bytes: int = C.MAX_UPLOAD_BYTES) -> DataFrame:
    """``triage`` by the headers of the bytes; adds ``format``, ``width``, ``height``, ``mode`` too.

    Payloads that would be rejected before their bytes are looked at are not walked.
    """
    size = F.octet_length(payload)
    early = reject_reason(F.col(content_type), size, F.lit(C.UPLOAD_FORMATS[0]), max_bytes=max_bytes)
    looked = uploads.withColumn("_header", image_header()(F.when(early.isNull(), F.col(payload))))
    flat = looked.select("*", *[F.col(f"_header.{n}").alias(n) for n in ("format", "width", "height", "mode")]).drop("_header")
    return triage(flat, F.col("format"), content_type=content_type, payload=payload, max_bytes=max_bytes)


def accepted(triaged: DataFrame) -> DataFrame:
    return triaged.where(F.col("reject_reason").isNull()).drop("reject_reason")


def quarantined(triaged: DataFrame) -> DataFrame:
    return triaged.where(F.col("reject_reason").isNotNull())


def store_scans(triaged: DataFrame, score: Callable[[DataFrame], DataFrame], history_path: str,
                quarantine_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score accepted uploads into the history and rejects into a quarantine table.

    ``score`` turns accepted uploads into complete scan rows but for ``id``.
    Every batch overwrites its own ``batch_id`` partitions and derives ids from
    the batch number and the rows' content, so a repeated batch writes the same
    rows to the same place.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        triaged_once = batch.persist(StorageLevel.DISK_ONLY)  # read and checked once; lost parts are computed anew
        try:
            rejected = quarantined(triaged_once).withColumn("batch_id", F.lit(batch_id))
            (rejected.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(quarantine_path))
            write_batch(score(accepted(triaged_once)), batch_id, history_path)
        finally:
            triaged_once.unpersist()

    writer = triaged.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def write_batch(scans: DataFrame, batch_id: int, history_path: str) -> None:
    """Write one batch of scans; writing it again replaces it. The scans are evaluated once.

    Ids are ranked over the keys alone. The rows with their images move once, to meet
    their ids through a hash join that does not sort them.
    """
    keyed = table.scan_key(scans).persist(StorageLevel.DISK_ONLY)
    try:
        ids = rank_by_digest(keyed.select("_key"), "_key").select(
            F.col("_key").alias("_ranked"), (F.lit(batch_id * BATCH_IDS) + F.col("rank")).alias("id"))
        placed = keyed.drop("id").join(ids.hint("shuffle_hash"), F.col("_key") == F.col("_ranked"))
        table.write_scans(placed, history_path, batch_id, "overwrite")
    finally:
        keyed.unpersist()
