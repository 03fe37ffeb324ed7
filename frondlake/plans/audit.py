"""Dataset audit: one inspection table in, every report out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..operators import balance, dedup, health, profile
from ..operators.rows import merge_single_rows
from ..sources.sinks import write_document


@dataclass(frozen=True)
class Audit:
    """Frames of one audit; class-sized or one-row unless noted."""

    distribution: DataFrame
    totals: DataFrame
    imbalance: DataFrame
    completeness: DataFrame
    weights: DataFrame
    class_quality: DataFrame
    formats: DataFrame
    modes: DataFrame
    quality: DataFrame
    defects: DataFrame
    duplicates: DataFrame
    exact_examples: DataFrame
    visual_examples: DataFrame
    near_duplicates: DataFrame  # grows with the number of pairs
    removal_plan: DataFrame  # exact, then visual removals; grows with the number of duplicates
    readiness: DataFrame
    health: DataFrame


def audit_records(records: DataFrame, catalog: DataFrame, *,
                  max_distance: int = C.HAMMING_LIMIT, hash_bits: int = 64) -> Audit:
    """Plan all reports over inspection records.

    ``records`` is scanned by many reports: pass a written table or the result
    of ``session.cut_lineage``, not a lazy image inspection.
    """
    distribution = balance.class_distribution(catalog, records)
    quality = profile.quality_summary(records)
    duplicates = dedup.duplicate_report(records)
    return Audit(
        distribution=distribution,
        totals=balance.distribution_totals(distribution),
        imbalance=balance.class_imbalance(distribution),
        completeness=balance.class_completeness(distribution),
        weights=balance.balanced_weights(distribution),
        class_quality=profile.class_quality_profile(records),
        formats=profile.histogram(records, "format", "class_id"),
        modes=profile.histogram(records, "mode", "class_id"),
        quality=quality,
        defects=profile.defect_examples(records),
        duplicates=duplicates,
        exact_examples=dedup.cross_class_examples(records, "sha256"),
        visual_examples=dedup.cross_class_examples(records, "dhash"),
        near_duplicates=dedup.near_duplicates(records, max_distance=max_distance, bits=hash_bits),
        removal_plan=dedup.removal_plan(records),
        readiness=health.readiness_report(quality, distribution),
        health=health.health_score(quality, duplicates, distribution),
    )


def _nested(frame: DataFrame, name: str) -> DataFrame:
    return frame.select(F.struct(*frame.columns).alias(name))


def _by_class(frame: DataFrame, name: str, key: str = "class_id") -> DataFrame:
    """A class-sized frame as one array of structs in key order."""
    rest = [c for c in frame.columns if c != key]
    return frame.agg(F.array_sort(F.collect_list(F.struct(key, *rest))).alias(name))


def _map(frame: DataFrame, key: str, value: str, name: str) -> DataFrame:
    entries = F.array_sort(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col(value).alias("v"))))
    return frame.agg(F.map_from_entries(entries).alias(name))


def audit_document(audit: Audit, catalog: DataFrame, root: str = "") -> DataFrame:
    """One row ``value``: the audit report as JSON. Only class-sized results are gathered."""
    near = audit.near_duplicates
    examples = (
        near.orderBy("class_id", "file_a", "file_b").limit(C.EXAMPLE_COUNT)
        .agg(F.array_sort(F.collect_list(F.struct("class_id", "file_a", "file_b", "hamming_distance")))
             .alias("near_duplicate_examples"))
    )

    def across(found: DataFrame, key: str, name: str) -> DataFrame:
        return _by_class(dedup.example_classes(found, key), name, "example")

    # Fixed values used by this audit.
    configuration = F.create_map(*[F.lit(x) for pair in (
        ("min_acceptable_size", float(C.INPUT_SIZE)), ("ideal_source_size", float(C.IDEAL_SIZE)),
        ("severely_undersized", float(C.SEVERE_SIZE)), ("min_pixels", float(C.INPUT_SIZE ** 2)),
        ("min_aspect_ratio", C.MIN_ASPECT), ("max_aspect_ratio", C.MAX_ASPECT),
        ("large_file_mb", C.LARGE_FILE_BYTES / 1024 ** 2), ("tiny_file_kb", C.TINY_FILE_BYTES / 1024),
        ("near_dup_hamming_threshold", float(C.HAMMING_LIMIT)),
    ) for x in pair])
    merged = merge_single_rows(
        audit.totals.withColumnRenamed("total", "total_images"),
        _by_class(audit.distribution, "distribution"),
        _map(catalog, "id", "display_name", "labels"),
        _nested(audit.imbalance, "imbalance"), _nested(audit.completeness, "completeness"),
        _nested(audit.quality, "quality"), _by_class(audit.class_quality, "class_quality"),
        _by_class(audit.formats, "formats"), _by_class(audit.modes, "modes"),
        _by_class(audit.defects, "defect_examples", "defect"),
        _nested(audit.duplicates, "duplicates"),
        across(audit.exact_examples, "sha256", "exact_cross_class_examples"),
        across(audit.visual_examples, "dhash", "visual_cross_class_examples"),
        near.agg(F.count(F.lit(1)).alias("near_duplicate_pairs")), examples,
        _nested(dedup.removal_counts(audit.removal_plan), "removal"),
        _nested(audit.readiness, "readiness"), _map(audit.weights, "class_id", "weight", "class_weights"),
        _nested(audit.health, "health"),
    ).withColumns({"dataset_root": F.lit(root), "configuration": configuration})
    return merged.select(F.to_json(F.struct(*merged.columns)).alias("value"))


def write_audit(audit: Audit, catalog: DataFrame, path: str, root: str = "") -> None:
    """Write the report document, the removal plan and the members of the cross-class examples below ``path``.

    The report holds class-sized results only; what grows with the duplicates is
    written as tables, many files wide.
    """
    write_document(audit_document(audit, catalog, root), f"{path}/report")
    audit.removal_plan.write.mode("overwrite").parquet(f"{path}/removals")
    for name, examples in (("exact", audit.exact_examples), ("visual", audit.visual_examples)):
        examples.write.mode("overwrite").parquet(f"{path}/{name}_examples")


def training_config(distribution: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row ``value``: input size, normalisation, class names, counts and weights as JSON."""
    def numbers(values):
        return F.array(*[F.lit(v) for v in values])

    merged = merge_single_rows(
        catalog.agg(F.count(F.lit(1)).alias("num_classes")),
        _map(catalog, "id", "display_name", "class_names"),
        _map(distribution, "class_id", "images", "class_counts"),
        _map(balance.balanced_weights(distribution), "class_id", "weight", "class_weights"),
    ).withColumns({
        # Fixed values.
        "model": F.lit(C.MODEL_NAME), "input_size": F.lit(C.INPUT_SIZE), "resize_size": F.lit(C.RESIZE_SIZE),
        "normalization_mean": numbers(C.CHANNEL_MEAN), "normalization_std": numbers(C.CHANNEL_STD),
        "suggested_split": F.lit("70/15/15 or 80/10/10, stratified by class"),
    })
    return merged.select(F.to_json(F.struct(*merged.columns)).alias("value"))
