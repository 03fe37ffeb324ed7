"""Scan history: listing, search, point lookup, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import text

LISTED = ("id", "filename", "class_key", "crop", "disease", "display_name",
          "confidence", "confidence_percent", "inference_ms", "created_at")
SEARCHED = ("crop", "disease", "display_name", "filename")


def filter_scans(history: DataFrame, category: str = "all", query: str = "") -> DataFrame:
    """Category and substring filter.

    ``%`` and ``_`` in ``query`` work as wildcards; case is ignored for A-Z only.
    """
    if category not in C.CATEGORIES:
        raise ValueError(f"category must be one of {C.CATEGORIES}")
    if len(query) > C.HISTORY_QUERY_CHARS:
        raise ValueError(f"query is longer than {C.HISTORY_QUERY_CHARS} characters")
    rows = history
    if category != "all":
        healthy = text.is_healthy(F.col("class_key"))
        rows = rows.where(healthy if category == "healthy" else ~healthy)
    wanted = query.strip()
    if wanted:
        match = F.lit(False)
        for column in SEARCHED:
            match = match | text.folded_like(F.col(column), f"%{wanted}%")
        rows = rows.where(match)
    return rows


def list_scans(history: DataFrame, *, limit: int = C.HISTORY_LIMIT, category: str = "all",
               query: str = "") -> DataFrame:
    """Newest scans first (then highest id), without the image bytes.

    The sort and limit run as a per-partition top-n.
    """
    if not 1 <= limit <= C.HISTORY_LIMIT:
        raise ValueError(f"limit must be between 1 and {C.HISTORY_LIMIT}")
    return (
        filter_scans(history, category, query).select(*LISTED)
        .orderBy(F.desc("created_at"), F.desc("id")).limit(limit)
        .withColumn("image_url", F.format_string("/history/%d/image", "id"))
    )


def scan_image(history: DataFrame, scan_id: int) -> DataFrame:
    """Image bytes and content type of one scan; no row when the id is unknown."""
    return history.where(F.col("id") == scan_id).select("image", "content_type")


def most_common_disease(history: DataFrame) -> DataFrame:
    """At most one row: the most frequent class that is not healthy, by name on ties."""
    return (
        history.where(~text.is_healthy(F.col("class_key")))
        .groupBy("class_key", "display_name").agg(F.count(F.lit(1)).alias("occurrence_count"))
        .orderBy(F.desc("occurrence_count"), F.asc("display_name"), F.asc("class_key")).limit(1)
    )


def history_stats(history: DataFrame) -> DataFrame:
    """One row of totals, also for an empty history.

    The history is first reduced to one row per class, which serves the totals
    and the most common disease alike.
    """
    per_class = history.groupBy("class_key", "display_name").agg(
        F.count(F.lit(1)).alias("scans"),
        F.sum("confidence_percent").alias("percent_sum"),
        F.count("confidence_percent").alias("percent_count"),
    )
    return stats_from_classes(per_class)


def stats_from_classes(per_class: DataFrame) -> DataFrame:
    """Totals from rows ``(class_key, display_name, scans, percent_sum, percent_count)``."""
    healthy = text.is_healthy(F.col("class_key"))
    # Largest count first, then the alphabetically first name; NULL orders are skipped.
    rank = F.when(~healthy, F.struct(-F.col("scans"), F.col("display_name"), F.col("class_key")))
    return per_class.agg(
        F.coalesce(F.sum("scans"), F.lit(0)).alias("total_scans"),
        F.coalesce(F.sum(F.when(healthy, F.col("scans"))), F.lit(0)).alias("healthy_diagnoses"),
        F.coalesce(F.sum(F.when(~healthy, F.col("scans"))), F.lit(0)).alias("diseases_detected"),
        text.rounded(
            F.coalesce(F.try_divide(F.sum("percent_sum"), F.sum("percent_count")), F.lit(0.0)), 1
        ).alias("average_confidence"),
        F.min_by("display_name", rank).alias("most_common_disease"),
    )
