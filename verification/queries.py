"""One callable per operator: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from frondlake.functions import text, vectors
from frondlake.operators import (
    balance, dedup, evaluation, guidance, health, history, integrity, mutation, ordering, profile,
    scoring, training, versions,
)
from frondlake.plans.dataset import dataset_summary, dataset_violations
from frondlake.session import checkpoint_folder
from frondlake.sources.catalog import label_lines
from frondlake.sources.guidance import guidance_records
from frondlake.sources.history import with_partitions
from frondlake.sources.manifest import read_manifest
from frondlake.sources.records import CSV_OPTIONS
from frondlake.streaming import stats, uploads
from frondlake.streaming.tables import table_stream

from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

NEAR_DISTANCE = 14
HASH_BITS = 56
UPLOAD_BYTES = 4096
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def long(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("bigint")


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


# -- catalog and manifest ---------------------------------------------------

@query
def class_catalog(spark, folder):
    return V.classes(spark, folder).select(
        F.col("id").alias("class_id"), F.col("index").alias("class_index"),
        F.col("key").alias("class_key"), "display_name", "crop", "disease", "relative_directory")


@query
def slugify(spark, folder):
    name = F.concat_ws(" / ", "p_brand", "p_type", "p_name")
    return V.table(spark, folder, "part").select("p_partkey", text.slug(name).alias("slug"))


@query
def label_text(spark, folder):
    return label_lines(V.classes(spark, folder)).select(F.col("value").alias("line"))


@query
def label_fallback(spark, folder):
    named = balance.label_names(V.supplier_files(spark, folder), V.classes(spark, folder))
    return named.select("file_id", "class_id", "display_name")


@query
def catalog_violations(spark, folder):
    return integrity.catalog_violations(V.legacy_classes(spark, folder))


@query
def class_create(spark, folder):
    change = mutation.create_class(V.classes(spark, folder), " Sweet-Corn ", "Leaf  RUST (2nd)!")
    return change.catalog.select(
        F.col("id").alias("class_id"), F.col("index").alias("class_index"),
        F.col("key").alias("class_key"), "display_name", "crop", "disease", "relative_directory")


def _manifest_columns(manifest: DataFrame) -> DataFrame:
    return manifest.select("split", "class_id", "class_index", "class_key", "display_name", "crop",
                           "disease", "family_id", "augmentation", "relative_path")


@query
def class_rename(spark, folder):
    change = mutation.rename_class(
        V.classes(spark, folder), V.manifest(spark, folder), 3, crop="Far East", display_name=" Far East 2 ")
    return _manifest_columns(change.manifest)


@query
def class_delete(spark, folder):
    change = mutation.delete_class(V.classes(spark, folder), V.manifest(spark, folder), 7)
    return _manifest_columns(change.manifest)


def _changes(spark, folder) -> tuple[DataFrame, DataFrame, dict[str, mutation.Change]]:
    catalog, manifest = V.classes(spark, folder), V.manifest(spark, folder)
    return catalog, manifest, {
        "rename": mutation.rename_class(catalog, manifest, 3, crop="Far East", display_name=" Far East 2 "),
        "delete": mutation.delete_class(catalog, manifest, 7)}


@query
def manifest_changes(spark, folder):
    """Paths that a rename and a deletion of a class touch."""
    _, manifest, changes = _changes(spark, folder)
    found = [versions.manifest_changes(manifest, c.manifest, c.moves if name == "rename" else None).withColumn("operation", F.lit(name))
             for name, c in changes.items()]
    return found[0].unionByName(found[1]).withColumn("fields", joined("fields"))


@query
def change_records(spark, folder):
    """What the operation log keeps of a rename and a deletion."""
    catalog, manifest, changes = _changes(spark, folder)
    records = [versions.change_record(c, catalog, manifest, applied=False).withColumn("operation", F.lit(name))
               for name, c in changes.items()]
    pairs = F.transform(F.map_entries("id_remap"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return records[0].unionByName(records[1]).select(
        "operation", F.array_join("old_classes.key", ",").alias("old_keys"),
        F.array_join("new_classes.key", ",").alias("new_keys"),
        F.array_join("new_classes.display_name", ",").alias("new_names"), F.array_join(F.array_sort(pairs), ",").alias("id_remap"),
        "manifest_paths_added", "manifest_paths_removed", "manifest_paths_changed", "moved_files", "applied")


@query
def manifest_scan(spark, folder):
    return _manifest_columns(integrity.check_manifest_header(V.manifest(spark, folder)))


@query
def manifest_class_counts(spark, folder):
    return integrity.manifest_class_counts(V.classes(spark, folder), V.manifest(spark, folder))


@query
def split_counts(spark, folder):
    return integrity.split_counts(V.manifest(spark, folder))


@query
def class_split_matrix(spark, folder):
    return integrity.class_split_matrix(V.classes(spark, folder), V.manifest(spark, folder)).select(
        long("class_id").alias("class_id"), "class_key", "display_name", "train", "val", "test")


@query
def family_counts(spark, folder):
    return integrity.family_counts(V.classes(spark, folder), V.manifest(spark, folder)).select(
        long("class_id").alias("class_id"), "class_key", "families")


@query
def family_leakage(spark, folder):
    return integrity.family_leakage(V.manifest(spark, folder))


@query
def split_coverage(spark, folder):
    """The catalog has one class more than the manifest."""
    catalog = mutation.create_class(V.classes(spark, folder), "sweet corn", "rust").catalog
    return integrity.split_coverage(catalog, V.manifest(spark, folder))


@query
def manifest_rewrite(spark, folder):
    rewritten = mutation.rewrite_rows(
        V.manifest(spark, folder), {"augmentation": text.slug(F.col("augmentation"))},
        keep=F.col("augmentation") != "4-NOT SPECIFIED")
    return rewritten.select("relative_path", "split", "class_id", "augmentation")


@query
def manifest_violations(spark, folder):
    return integrity.manifest_violations(V.faulty_manifest(spark, folder), V.classes(spark, folder))


@query
def first_manifest_violation(spark, folder):
    return integrity.first_violation(
        integrity.manifest_violations(V.faulty_manifest(spark, folder), V.classes(spark, folder)))


@query
def manifest_lines(spark, folder):
    """The manifest written as CSV files of 4,096 orders, quoted line breaks among them, and read with its lines."""
    key = F.regexp_extract("relative_path", r"([0-9]+)\.jpg$", 1).cast("bigint")
    said = F.when(key % 5 == 0, F.concat("augmentation", F.lit('\nsaid "so", twice\n'))).otherwise(F.col("augmentation"))
    rows = V.manifest(spark, folder).withColumns({"augmentation": said, "key": key, "bucket": F.floor(key / 4096)})
    path = f"{checkpoint_folder(spark)}/manifest-{uuid.uuid4().hex}"
    (rows.repartitionByRange("bucket").sortWithinPartitions("bucket", "key").drop("key").write.partitionBy("bucket")
     .options(**CSV_OPTIONS).csv(path))
    return read_manifest(spark, f"{path}/bucket=*", number_lines=True).select("relative_path", "augmentation", "line")


@query
def unknown_classes(spark, folder):
    return integrity.unknown_classes(V.faulty_manifest(spark, folder), V.classes(spark, folder)).select(
        "relative_path", "class_id")


@query
def missing_assets(spark, folder):
    return integrity.missing_files(
        V.table(spark, folder, "documents").select("doc_id", "source"),
        V.table(spark, folder, "labels"), "doc_id")


@query
def dataset_summary_counts(spark, folder):
    s = dataset_summary(V.classes(spark, folder), V.manifest(spark, folder))
    return s.select("class_count", "image_count", "family_count", "family_leakage_count",
                    *[F.col("split_counts")[x].alias(f"{x}_images") for x in ("train", "val", "test")])


@query
def dataset_violation_counts(spark, folder):
    found = dataset_violations(V.classes(spark, folder), V.faulty_manifest(spark, folder).withColumn(
        "class_id", F.coalesce(F.col("class_id").try_cast("bigint").cast("string"), F.lit("-1"))))
    return found.groupBy("stage", "code").agg(F.count(F.lit(1)).alias("violations"))


# -- balance ----------------------------------------------------------------

def _distribution(spark, folder) -> DataFrame:
    return balance.class_distribution(V.classes(spark, folder), V.supplier_files(spark, folder))


@query
def class_distribution(spark, folder):
    return _distribution(spark, folder)


@query
def distribution_totals(spark, folder):
    return balance.distribution_totals(_distribution(spark, folder)).select(
        "total", "minimum", "maximum", r6("ratio").alias("ratio"))


@query
def class_imbalance(spark, folder):
    return balance.class_imbalance(_distribution(spark, folder)).select(
        r6("median").alias("median"), r6("mean").alias("mean"), "max", "min",
        r6("max_to_min").alias("max_to_min"), joined("classes_below_25pct_median"),
        joined("classes_below_50pct_median"), joined("classes_above_2x_median"))


@query
def class_completeness(spark, folder):
    return balance.class_completeness(_distribution(spark, folder)).select(
        "expected_classes", "classes_with_images", joined("empty_classes"), joined("unexpected_class_ids"))


@query
def balanced_class_weights(spark, folder):
    return balance.balanced_weights(
        balance.class_distribution(V.classes(spark, folder), V.manifest(spark, folder)))


@query
def effective_class_weights(spark, folder):
    train = V.manifest(spark, folder).where("split = 'train'")
    return balance.effective_number_weights(V.classes(spark, folder), train).select(
        "class_index", "images", r6("weight").alias("weight"))


# -- quality ----------------------------------------------------------------

@query
def quality_flags(spark, folder):
    return V.assets(spark, folder).select(
        "relative_path", "valid", "pixels", r6("aspect_ratio").alias("aspect_ratio"), "small",
        "below_ideal_resolution", "severely_undersized", "extreme_aspect", "tiny_file", "large_file",
        "grayscale", "has_alpha", "channels")


@query
def mode_channels(spark, folder):
    return V.assets(spark, folder).where("valid").groupBy("mode", "channels", "grayscale", "has_alpha").agg(
        F.count(F.lit(1)).alias("images"))


@query
def class_quality_profile(spark, folder):
    p = profile.class_quality_profile(V.assets(spark, folder))
    return p.select(*[
        r6(c).alias(c) if c.split("_")[-1] in ("median", "mean", "p10", "p90") else long(c).alias(c)
        for c in p.columns])


@query
def quality_summary(spark, folder):
    s = profile.quality_summary(V.assets(spark, folder))
    return s.select(*[
        r6(c).alias(c) if c.startswith(("median", "mean")) or "ratio" in c else long(c).alias(c)
        for c in s.columns])


@query
def format_histogram(spark, folder):
    return profile.histogram(V.assets(spark, folder), "format", "class_id")


@query
def defect_examples(spark, folder):
    return profile.defect_examples(V.assets(spark, folder))


@query
def report_formatting(spark, folder):
    count, total = F.col("p_size"), F.round("p_retailprice").cast("int")
    return V.table(spark, folder, "part").select(
        "p_partkey", text.percent_text(count, total).alias("percent"),
        text.ratio_text(total, count - 25).alias("ratio"),
        text.byte_size_text(F.pow(count, F.lit(7)) * F.col("p_retailprice")).alias("size"))


@query
def readiness_report(spark, folder):
    assets = V.assets(spark, folder)
    r = health.readiness_report(
        profile.quality_summary(assets), balance.class_distribution(V.classes(spark, folder), assets))
    return r.select(
        *[c for c in r.columns if not c.startswith("classes")],
        joined("classes_below_minimum"), joined("classes_below_ideal"))


@query
def health_score(spark, folder):
    assets = V.assets(spark, folder)
    h = health.health_score(
        profile.quality_summary(assets), dedup.duplicate_report(assets),
        balance.class_distribution(V.classes(spark, folder), assets))
    return h.select("score", "status", F.array_join("notes", "; ").alias("notes"))


@query
def all_assets(spark, folder):
    def part(name: str, key: str, content: str) -> DataFrame:
        return V.table(spark, folder, name).select(
            F.lit(name).alias("kind"), F.col(key).alias("item"),
            F.octet_length(content).cast("bigint").alias("bytes"))

    return (part("documents", "doc_id", "text").unionByName(part("pages", "page_id", "html"))
            .unionByName(part("benchmark", "item_id", "text")))


# -- duplicates -------------------------------------------------------------

@query
def content_digest(spark, folder):
    return V.files(spark, folder).select("doc_id", "sha256", "file_size")


@query
def exact_duplicates(spark, folder):
    return dedup.duplicate_groups(V.files(spark, folder), "sha256")


@query
def exact_duplicate_summary(spark, folder):
    return dedup.duplicate_summary(V.files(spark, folder), "sha256")


@query
def exact_duplicate_examples(spark, folder):
    return dedup.cross_class_examples(V.files(spark, folder), "sha256")


@query
def dedup_plan(spark, folder):
    return dedup.dedup_plan(V.files(spark, folder), "sha256")


@query
def removal_plan(spark, folder):
    return dedup.removal_plan(V.assets(spark, folder))


@query
def removal_counts(spark, folder):
    return dedup.removal_counts(dedup.removal_plan(V.assets(spark, folder)))


@query
def duplicate_example_classes(spark, folder):
    return dedup.example_classes(dedup.cross_class_examples(V.files(spark, folder), "sha256"), "sha256")


@query
def dedup_keep_first(spark, folder):
    return dedup.keep_first(V.files(spark, folder), "sha256")


def _hashed(spark, folder, grid: str = "embedding", columns: int = 8, rows: int = 8) -> DataFrame:
    hashed = dedup.with_difference_hash(
        V.vectors(spark, folder), grid, columns=columns, rows_per_grid=rows)
    return hashed.select(F.col("target").alias("class_id"), F.col("image").alias("relative_path"), "dhash")


@query
def difference_hash(spark, folder):
    return _hashed(spark, folder).select(
        F.col("relative_path").alias("image"), "dhash", vectors.hash_text(F.col("dhash")).alias("hash_text"))


@query
def visual_duplicates(spark, folder):
    return dedup.duplicate_groups(_hashed(spark, folder, "logits", columns=5, rows=2), "dhash")


@query
def visual_duplicate_summary(spark, folder):
    return dedup.duplicate_summary(_hashed(spark, folder, "logits", columns=5, rows=2), "dhash")


@query
def near_duplicates(spark, folder):
    pairs = dedup.near_duplicates(_hashed(spark, folder), bits=HASH_BITS, max_distance=NEAR_DISTANCE)
    return pairs.select("class_id", "file_a", "file_b", "hamming_distance")


@query
def near_duplicate_counts(spark, folder):
    return dedup.near_duplicate_counts(
        dedup.near_duplicates(_hashed(spark, folder), bits=HASH_BITS, max_distance=NEAR_DISTANCE))


@query
def near_duplicate_classes(spark, folder):
    return dedup.near_duplicate_classes(_hashed(spark, folder), bits=HASH_BITS, max_distance=NEAR_DISTANCE)


def _payload() -> Column:
    """Image bytes around a document's text, the kind by a digit of its digest: JPEG, PNG, GIF, cut, forged, none."""
    def number(value: Column | int, octets: int) -> Column:
        return F.unhex(F.lpad(F.hex(value if isinstance(value, Column) else F.lit(value)), 2 * octets, "0"))

    def raw(text: str) -> Column:
        return F.unhex(F.lit(text.replace(" ", "")))

    def chunk(kind: str, data: Column, flaw: int = 0) -> Column:
        whole = F.concat(F.lit(kind).cast("binary"), data)
        return F.concat(number(F.octet_length(data), 4), whole, number(F.crc32(whole).bitwiseXOR(F.lit(flaw).cast("bigint")), 4))

    body, digit = F.col("text").cast("binary"), F.substring(F.md5(F.col("text").cast("binary")), 1, 1)
    width, height = 1 + F.col("doc_id") % 4000, 1 + F.col("doc_id") % 3000
    shape = F.concat(number(height, 2), number(width, 2))
    jpeg = F.concat(raw("FFD8 FFE0 0010 4A46494600 0101 00 0001 0001 0000 FFC0 0011 08"), shape,
                    raw("03 011100 021100 031100 FFDA 000C 03 0100 0211 0311 003F00"), body, raw("FFD9"))
    start = F.concat(raw("89504E470D0A1A0A"), chunk("IHDR", F.concat(number(width, 4), number(height, 4), raw("0802000000"))))
    end = chunk("IEND", raw(""))
    png = F.concat(start, chunk("IDAT", body), end)
    little = F.concat(*[F.reverse(F.lpad(F.hex(v), 4, "0")) for v in (width, height)])
    sides = F.unhex(F.regexp_replace(little, "(.)(.)", "$2$1"))
    gif = F.concat(F.lit("GIF89a").cast("binary"), sides, raw("000000 2C 00000000"), sides, raw("00 08 10"),
                   F.unhex(F.md5(body)), raw("00 3B"))
    return (F.when(digit < "5", jpeg).when(digit < "9", png).when(digit < "c", gif).when(digit < "e", body)
            .when(digit == "e", F.substr(png, F.lit(1), F.octet_length(png) - 7))
            .otherwise(F.concat(start, chunk("IDAT", body, flaw=1), end)))


def _uploads(documents: DataFrame, *more: str) -> DataFrame:
    """Documents as uploads: declared type by language, image bytes around the text."""
    declared = F.when(F.col("lang") == "es", "text/plain").when(
        F.col("lang") == "fr", "image/png").otherwise("image/jpeg")
    rows = documents.select("doc_id", declared.alias("content_type"), _payload().alias("payload"), *more)
    return uploads.inspect_uploads(rows, max_bytes=UPLOAD_BYTES)


@query
def upload_triage(spark, folder):
    return _uploads(V.table(spark, folder, "documents")).select(
        "doc_id", "content_type", "file_size", "format", "width", "height", "mode", "reject_reason")


# -- scoring and evaluation -------------------------------------------------

@query
def softmax_topk(spark, folder):
    ranked = scoring.rank_predictions(V.vectors(spark, folder), V.classes(spark, folder))
    return ranked.select(
        "image", "rank", "class_id", "class_index", "class_key", "display_name", "crop", "disease",
        r6("confidence").alias("confidence"), F.round("confidence_percent", 4).alias("confidence_percent"))


def _predicted(spark, folder) -> DataFrame:
    return scoring.predicted_class(V.vectors(spark, folder))


@query
def argmax_prediction(spark, folder):
    return _predicted(spark, folder).select("image", "predicted", r6("confidence").alias("confidence"))


@query
def low_confidence(spark, folder):
    return scoring.flag_uncertain(_predicted(spark, folder), 0.14).select(
        "image", F.round("confidence_percent", 4).alias("confidence_percent"), "uncertain")


@query
def normalize_features(spark, folder):
    channel = F.transform("embedding", lambda x: F.round((x.cast("double") + 1) * 127.5))
    normal = vectors.normalize_channels(channel, (0.485, 0.456, 0.406), (0.229, 0.224, 0.225))
    return V.vectors(spark, folder).select(
        "image", F.posexplode(normal).alias("position", "value")).withColumn("value", r6("value"))


def _linear_head():
    k, j = np.meshgrid(np.arange(10), np.arange(64), indexing="ij")
    weights = ((k * 7 + j * 3) % 11 - 5) / 10.0

    def predict(batch: np.ndarray) -> np.ndarray:
        return batch.astype(np.float64) @ weights.T

    return predict


@query
def batch_scoring(spark, folder):
    scored = scoring.score_batches(
        V.vectors(spark, folder).drop("logits"), _linear_head, "embedding", feature_shape=[64])
    return scoring.predicted_class(scored).select("image", "predicted", r6("confidence").alias("confidence"))


def _counts(spark, folder) -> DataFrame:
    return evaluation.confusion_counts(_predicted(spark, folder))


@query
def confusion_matrix(spark, folder):
    return evaluation.confusion_matrix(_counts(spark, folder), V.classes(spark, folder))


@query
def confusion_normalized(spark, folder):
    matrix = evaluation.confusion_matrix(_counts(spark, folder), V.classes(spark, folder))
    return evaluation.normalize_rows(matrix).select("target", "predicted", r6("share").alias("share"))


@query
def classification_report(spark, folder):
    return evaluation.classification_report(_counts(spark, folder), V.classes(spark, folder)).select(
        "label", *[r6(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def eval_metrics(spark, folder):
    return evaluation.eval_metrics(_counts(spark, folder)).select(
        *[r6(c).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1", "balanced_accuracy")], "images")


@query
def prediction_detail(spark, folder):
    return evaluation.prediction_detail(
        V.vectors(spark, folder), _predicted(spark, folder), V.classes(spark, folder))


def _losses(spark, folder) -> DataFrame:
    rows = V.vectors(spark, folder).withColumn("batch", F.floor(F.col("image") / 64))
    targets = rows.groupBy("target").agg(F.count(F.lit(1)).alias("images")).select(
        F.col("target").alias("class_id"), "images")
    weights = balance.balanced_weights(targets).select(F.col("class_id").alias("class_index"), "weight")
    return evaluation.batch_losses(rows, weights)


@query
def smoothed_cross_entropy(spark, folder):
    return _losses(spark, folder).select("batch", r6("loss").alias("loss"), "images", "correct")


@query
def weighted_mean_loss(spark, folder):
    return evaluation.mean_loss(_losses(spark, folder)).select(
        r6("loss").alias("loss"), r6("accuracy").alias("accuracy"), "images")


@query
def linear_head(spark, folder):
    """Training images and weight per class, and whether the fitted head beats the largest class.

    Single predictions depend on the arithmetic of the fit and are not compared.
    """
    rows = V.vectors(spark, folder)
    weights = balance.balanced_weights(
        rows.groupBy(F.col("target").alias("class_id")).agg(F.count(F.lit(1)).alias("images"))
    ).select(F.col("class_id").alias("class_index"), "weight")
    model = training.fit_linear_head(rows, weights, features_col="embedding")
    guessed = model.transform(training.linear_head_input(rows, "embedding"))
    counts = guessed.groupBy("target").agg(
        F.count(F.lit(1)).alias("images"),
        F.count_if(F.col("prediction") == F.col("target")).alias("correct"))
    every = Window.partitionBy()  # over ten classes
    return counts.join(weights, F.col("class_index") == F.col("target")).select(
        "target", "images", "weight",
        (F.sum("correct").over(every) > F.max("images").over(every)).alias("beats_largest_class"))


# -- history and guidance ---------------------------------------------------

def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumn("created_at", F.date_format("created_at", TIME_FORMAT))


@query
def history_list(spark, folder):
    return _shown(history.list_scans(V.history(spark, folder)))


@query
def history_search(spark, folder):
    return _shown(history.list_scans(V.history(spark, folder), limit=50, query=" LATE_bl "))


@query
def history_category(spark, folder):
    return history.filter_scans(V.history(spark, folder), category="disease").select(
        "id", "class_key", "filename")


@query
def history_lookup(spark, folder):
    return history.scan_image(V.history(spark, folder), 123).select(
        F.hex("image").alias("image"), "content_type")


@query
def history_stats(spark, folder):
    return history.history_stats(V.history(spark, folder))


@query
def most_common_disease(spark, folder):
    return history.most_common_disease(V.history(spark, folder))


@query
def guidance_lookup(spark, folder):
    found = guidance.with_guidance(
        V.history(spark, folder).select("id", "class_key"), guidance_records(spark))
    sizes = [long(F.size(c)).alias(f"n_{c}") for c in ("cause_factors", "cure_points", "prevention_points")]
    return found.select("id", "class_key", "display_name", "classification", "agent", "management_label", *sizes)


# -- training ---------------------------------------------------------------

@query
def best_epoch(spark, folder):
    return training.best_epoch(V.epochs(spark, folder))


@query
def early_stop(spark, folder):
    return training.early_stop(V.epochs(spark, folder), patience=4).select(
        "epoch", "val_macro_f1", "improved", long("stale").alias("stale"))


@query
def latest_artifact(spark, folder):
    return training.latest_artifact(V.artifacts(spark, folder))


@query
def epoch_batches(spark, folder):
    return training.epoch_batches(
        V.table(spark, folder, "documents").select("doc_id"), id_col="doc_id", seed=42, epoch=3)


@query
def exact_percentiles(spark, folder):
    return ordering.exact_percentiles(
        V.table(spark, folder, "lineitem"), ["l_returnflag"],
        {"price": F.col("l_extendedprice"), "quantity": F.col("l_quantity")},
        {"p10": 0.10, "median": 0.50, "p90": 0.90},
    ).select("l_returnflag", *[
        r6(f"{m}_{p}").alias(f"{m}_{p}") for m in ("price", "quantity") for p in ("p10", "median", "p90")])


# -- streams ----------------------------------------------------------------

def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = V.table(spark, folder, name).schema
    return table_stream(spark, f"{folder}/{name}.parquet", schema)


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def _finish(stream: StreamingQuery) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


@query
def stream_triage(spark, folder):
    """Uploads from a stream: headers walked, accepted ones scored into the history, others set aside."""
    base = _scratch(spark)
    digits = F.sha2("text", 256)
    features = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substr(digits, i, F.lit(1))) + i * i / F.lit(7919.0))
    documents = _stream(spark, folder, "documents")
    triaged = _uploads(documents.withColumn("features", features), "features")

    def as_scans(accepted: DataFrame) -> DataFrame:
        scored = scoring.score_batches(accepted, _linear_head, "features", feature_shape=[64])
        named = scoring.predicted_class(scored)
        unknown = [F.lit(None).cast(t).alias(n) for n, t in (
            ("crop", "string"), ("disease", "string"), ("display_name", "string"), ("inference_ms", "double"))]
        return named.select(
            F.col("doc_id").cast("string").alias("filename"), "content_type", F.col("payload").alias("image"),
            F.concat(F.lit("class_"), "predicted").alias("class_key"), "confidence",
            (F.col("confidence") * 100).alias("confidence_percent"), *unknown, F.timestamp_seconds("doc_id").alias("created_at"))

    _finish(uploads.store_scans(triaged, as_scans, f"{base}/history", f"{base}/rejects", f"{base}/checkpoint"))
    taken = with_partitions(spark, f"{base}/history").select(
        F.col("filename").cast("bigint").alias("doc_id"), F.lit("accepted").alias("outcome"), "class_key",
        r6("confidence").alias("confidence"), F.octet_length("image").cast("bigint").alias("image_bytes"))
    rejected = spark.read.parquet(f"{base}/rejects").select("doc_id", F.col("reject_reason").alias("outcome"))
    return taken.unionByName(rejected, allowMissingColumns=True)


@query
def stream_history(spark, folder):
    base = _scratch(spark)
    scans = V.scans_from_events(_stream(spark, folder, "events"))

    def store(batch: DataFrame, batch_id: int) -> None:
        keyed = batch.withColumn("filename", F.concat_ws("#", "filename", F.col("id").cast("string")))
        uploads.write_batch(keyed, batch_id, f"{base}/history")

    _finish(scans.writeStream.foreachBatch(store).option("checkpointLocation", f"{base}/checkpoint")
            .trigger(availableNow=True).start())
    stored = with_partitions(spark, f"{base}/history")
    return stored.groupBy("class_key", "scan_date").agg(
        F.count(F.lit(1)).alias("scans"), F.count_distinct("id").alias("ids"),
        F.round(F.sum("confidence_percent"), 4).alias("percent_sum"),
    ).withColumn("scan_date", F.col("scan_date").cast("string"))


@query
def stream_stats(spark, folder):
    base = _scratch(spark)
    scans = V.scans_from_events(_stream(spark, folder, "events"))
    _finish(stats.maintain_class_totals(scans, f"{base}/totals", f"{base}/checkpoint"))
    return history.stats_from_classes(stats.latest_class_totals(spark, f"{base}/totals"))
