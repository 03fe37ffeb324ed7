import json

import pytest
from pyspark.sql import functions as F

from frondlake.operators import balance, dedup, health, profile
from frondlake.plans.audit import audit_document, audit_records, training_config, write_audit

RAW = ("class_id int, relative_path string, valid boolean, width int, height int, format string, mode string, "
       "file_size bigint, sha256 string, dhash bigint")


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        (1, "a/1", True, 100, 100, "png", "RGB", 100, "h1", 1), (1, "a/2", True, 300, 300, "png", "RGBA", 6000, "h2", 2),
        (1, "a/3", True, 1000, 300, "jpeg", "L", 20_000_000, "h3", 3), (1, "a/4", False, None, None, "png", None, 5, "h4", None),
        (2, "b/1", True, 500, 500, "png", "P", 7000, "h1", 1),
    ]
    return profile.with_quality(spark.createDataFrame(rows, RAW))


def counts_of(spark, counts):
    rows = [(c, n) for c, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "class_id int, n int")


def test_distribution_keeps_empty_and_unknown_classes(spark, catalog):
    d = balance.class_distribution(catalog, counts_of(spark, {1: 4, 3: 1, 9: 2}))
    got = {r["class_id"]: (r["display_name"], r["expected"], r["images"]) for r in d.collect()}
    assert got == {1: ("Corn Common Rust", True, 4), 2: ("Corn Healthy", True, 0), 3: ("Lemon Curl Virus", True, 1),
                   9: ("Unknown Class 9", False, 2)}
    assert tuple(balance.distribution_totals(d).first()) == (7, 1, 4, 4.0)
    complete = balance.class_completeness(d).first()
    assert tuple(complete) == (3, 2, [2], [9])
    weights = {r["class_id"]: r["weight"] for r in balance.balanced_weights(d).collect()}
    assert weights == {1: round(7 / 12, 4), 3: round(7 / 3, 4), 9: round(7 / 6, 4)}


def test_imbalance_is_strict(spark, catalog):
    d = balance.class_distribution(catalog, counts_of(spark, {1: 8, 2: 4, 3: 1, 4: 2, 5: 9}))
    row = balance.class_imbalance(d).first()
    assert (row["median"], row["max"], row["min"], row["max_to_min"]) == (4.0, 9, 1, 9.0)
    assert row["classes_below_25pct_median"] == [] and row["classes_below_50pct_median"] == [3]
    assert row["classes_above_2x_median"] == [5]
    empty = balance.class_imbalance(d.where("class_id > 50")).first()
    assert (empty["median"], empty["max"], empty["max_to_min"]) == (0.0, 0, None)
    assert tuple(balance.distribution_totals(d.where("class_id > 50")).first()) == (0, 0, 0, None)


def test_effective_weights(spark, catalog):
    samples = spark.createDataFrame([(0,)] * 3 + [(1,)] * 1 + [(2,)] * 2, "class_index int")
    got = {r["class_index"]: r["weight"] for r in balance.effective_number_weights(catalog, samples, beta=0.9).collect()}
    raw = {i: 0.1 / (1 - 0.9 ** n) for i, n in {0: 3, 1: 1, 2: 2}.items()}
    assert got == pytest.approx({i: w / sum(raw.values()) * 3 for i, w in raw.items()})
    with pytest.raises(Exception, match="class without samples: 2"):
        balance.effective_number_weights(catalog, samples.where("class_index < 2")).collect()


def test_class_profile(records):
    row = {r["class_id"]: r for r in profile.class_quality_profile(records).collect()}
    one = row[1]
    assert (one["total"], one["valid"], one["corrupt"]) == (4, 3, 1)
    assert (one["small"], one["below_ideal_resolution"], one["severely_undersized"]) == (1, 3, 1)
    assert (one["extreme_aspect"], one["grayscale"], one["alpha"]) == (1, 1, 1)
    assert (one["tiny_files"], one["large_files"]) == (1, 1)
    assert (one["width_min"], one["width_median"], one["width_max"]) == (100, 300, 1000)
    assert one["width_p10"] == pytest.approx(140) and one["width_p90"] == pytest.approx(860)
    assert one["pixels_median"] == 90000
    assert row[2]["height_p10"] == 500


def test_class_of_corrupt_images_has_zero_statistics(records):
    row = profile.class_quality_profile(records.where("not valid")).first()
    assert (row["total"], row["valid"], row["width_min"], row["width_median"], row["file_size_max"]) == (1, 0, 0, 0, 0)


def test_summary_and_examples(records):
    s = profile.quality_summary(records).first()
    assert (s["total_records"], s["valid"], s["corrupt"], s["small"]) == (5, 4, 1, 1)
    assert (s["min_width"], s["median_width"], s["median_height"]) == (100, 400, 300)
    assert s["max_aspect_ratio"] == pytest.approx(10 / 3) and s["total_bytes"] == 20_013_100
    empty = profile.quality_summary(records.where("class_id > 9")).first()
    assert (empty["total_records"], empty["median_bytes"], empty["total_bytes"]) == (0, 0, 0)
    examples = [(r["defect"], r["example"], r["relative_path"]) for r in profile.defect_examples(records, 1).collect()]
    assert sorted(examples) == [("corrupt", 1, "a/4"), ("extreme_aspect", 1, "a/3"),
                                ("severely_undersized", 1, "a/1"), ("small", 1, "a/1"), ("tiny_file", 1, "a/1")]
    assert {(r["format"], r["images"]) for r in profile.histogram(records, "format").collect()} == {("png", 3), ("jpeg", 1)}


def _score(spark, *, total=1000, corrupt=0, small=0, severe=0, aspect=0, dup=0, exact_cross=0, visual_cross=0,
           ratio=None):
    quality = spark.createDataFrame([(total, corrupt, small, severe, aspect)],
                                    "total_records long, corrupt long, small long, severely_undersized long, extreme_aspect long")
    duplicates = spark.createDataFrame([(dup, exact_cross, visual_cross)],
                                       "exact_duplicate_files long, exact_cross_class_groups long, visual_cross_class_groups long")
    images = [] if ratio is None else [(1, 100), (2, int(100 * ratio))]
    distribution = spark.createDataFrame(images, "class_id int, images long")
    row = health.health_score(quality, duplicates, distribution).first()
    return row["score"], row["status"], list(row["notes"])


@pytest.mark.parametrize("given, want", [
    ({}, 100), ({"corrupt": 1}, 99), ({"corrupt": 11}, 98), ({"corrupt": 900}, 85), ({"dup": 1}, 99), ({"dup": 20}, 99),
    ({"dup": 21}, 98), ({"dup": 900}, 85), ({"exact_cross": 1}, 97), ({"exact_cross": 9}, 85),
    ({"visual_cross": 2}, 96), ({"visual_cross": 99}, 85), ({"small": 30}, 100), ({"small": 31}, 96),
    ({"small": 100}, 96), ({"small": 101}, 92), ({"severe": 20}, 100), ({"severe": 21}, 95),
    ({"aspect": 100}, 100), ({"aspect": 101}, 95), ({"ratio": 5}, 100), ({"ratio": 5.01}, 97), ({"ratio": 10}, 97),
    ({"ratio": 10.01}, 94), ({"ratio": 20}, 94), ({"ratio": 20.01}, 90),
    ({"total": 0}, 100),
])
def test_health_thresholds(spark, given, want):
    assert _score(spark, **given)[0] == want


def test_health_notes_and_floor(spark):
    score, status, notes = _score(spark, corrupt=900, dup=900, exact_cross=9, visual_cross=9, small=900, severe=900,
                                  aspect=900, ratio=30)
    assert (score, status) == (12, "POOR")
    assert notes[0] == "-15 corrupt-image penalty" and notes[-1] == "-10 severe class-imbalance penalty"
    assert len(notes) == 8


def test_readiness(spark, records, catalog):
    d = balance.class_distribution(catalog, counts_of(spark, {1: 149, 2: 150, 3: 400}))
    row = health.readiness_report(profile.quality_summary(records), d).first()
    assert (row["at_or_above_ideal"], row["at_or_above_ideal_pct"]) == (1, "25.00%")
    assert (row["classes_below_minimum"], row["classes_below_ideal"]) == ([1], [1, 2])
    assert row["imbalance_ratio"] == "2.68:1"
    nothing = records.where("class_id > 9")
    empty = health.readiness_report(
        profile.quality_summary(nothing), balance.class_distribution(catalog, nothing)).first()
    assert (empty["at_or_above_ideal"], empty["at_or_above_ideal_pct"], empty["imbalance_ratio"]) == (1, "100.00%", "N/A")


def test_audit_document(records, catalog):
    audit = audit_records(records, catalog)
    report = json.loads(audit_document(audit, catalog, "/data").first()["value"])
    assert report["total_images"] == 5 and report["labels"]["2"] == "Corn Healthy"
    assert report["duplicates"]["exact_cross_class_groups"] == 1
    assert report["quality"]["corrupt"] == 1 and report["health"]["score"] == audit.health.first()["score"]
    assert report["near_duplicate_pairs"] == 1
    assert report["near_duplicate_examples"][0] == {
        "class_id": 1, "file_a": "a/2", "file_b": "a/3", "hamming_distance": 1}
    assert report["configuration"]["min_pixels"] == 90000
    config = json.loads(training_config(audit.distribution, catalog).first()["value"])
    assert config["num_classes"] == 3 and config["class_counts"] == {"1": 4, "2": 1, "3": 0}
    assert config["class_weights"] == {"1": 0.625, "2": 2.5} and config["normalization_mean"] == [0.485, 0.456, 0.406]


def test_audit_document_names_examples_and_removals(spark, records, catalog, tmp_path):
    audit = audit_records(records, catalog)
    write_audit(audit, catalog, str(tmp_path), "/data")
    report = json.loads(spark.read.text(f"{tmp_path}/report").first()["value"])
    assert report["exact_cross_class_examples"] == [
        {"example": 1, "sha256": "h1", "class_id": 1, "files": 1, "first_file": "a/1"},
        {"example": 1, "sha256": "h1", "class_id": 2, "files": 1, "first_file": "b/1"}]
    assert [e["class_id"] for e in report["visual_cross_class_examples"]] == [1, 2]
    assert report["removal"] == {"exact_removed": 1, "visual_removed": 0}
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/removals").collect()] == [("exact", 2, "b/1", 1, "a/1", 2)]
    assert spark.read.parquet(f"{tmp_path}/exact_examples").count() == 2
