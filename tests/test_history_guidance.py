from datetime import datetime

import pytest
from pyspark.sql import functions as F

from frondlake.operators import guidance, history
from frondlake.sources.guidance import FACTS, guidance_records
from frondlake.sources.history import append_scans, read_history
from frondlake.streaming.stats import class_totals

SCAN = ("id long, filename string, content_type string, image binary, class_key string, crop string, "
        "disease string, display_name string, confidence double, confidence_percent double, "
        "inference_ms double, created_at timestamp")


def scan(i, key="corn__common_rust", filename="leaf.png", name=None, percent=50.0, at=datetime(2024, 5, 1), crop=None):
    made, disease = key.split("__", 1) if "__" in key else (key, "")
    return (i, filename, "image/png", b"img%d" % i, key, crop or made, disease, name or key.replace("_", " ").title(),
            percent / 100, percent, 3.0, at)


@pytest.fixture(scope="module")
def scans(spark):
    return spark.createDataFrame([
        scan(1, at=datetime(2024, 5, 1, 0, 0, 0)), scan(2, at=datetime(2024, 5, 1, 0, 0, 0, 500000)),
        scan(3, at=datetime(2024, 5, 1, 0, 0, 0, 500000)), scan(4, "x__healthy", "100%_a\\b.png"),
        scan(5, "x__unhealthy"), scan(6, "X__HEALTHY", "École.png"), scan(7, "xhealthy"),
    ], SCAN)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_newest_first_then_highest_id(scans):
    assert ids(history.list_scans(scans.where("id <= 3"))) == [3, 2, 1]
    listed = history.list_scans(scans, limit=1)
    assert "image" not in listed.columns and listed.first()["image_url"] == "/history/3/image"


@pytest.mark.parametrize("category, want", [("healthy", [4, 5, 6]), ("disease", [1, 2, 3, 7]), ("all", [1, 2, 3, 4, 5, 6, 7])])
def test_categories_use_the_wildcard(scans, category, want):
    assert sorted(ids(history.list_scans(scans, category=category))) == want


@pytest.mark.parametrize("query, want", [
    ("LEAF", [1, 2, 3, 5, 7]), ("École", [6]), ("école", []), ("100%", [4]), ("a\\b", [4]), ("x__un", [5]),
    ("l_af.p%g", [1, 2, 3, 5, 7]), ("   ", [1, 2, 3, 4, 5, 6, 7]), ("COMMON rust", [1, 2, 3]),
])
def test_search(scans, query, want):
    found = sorted(ids(history.list_scans(scans, query=query)))
    assert found == want


@pytest.mark.parametrize("options", [{"limit": 0}, {"limit": 101}, {"category": "urgent"}, {"query": "q" * 101}])
def test_parameter_domain(scans, options):
    with pytest.raises(ValueError):
        history.list_scans(scans, **options)


def test_lookup(scans):
    assert bytes(history.scan_image(scans, 4).first()["image"]) == b"img4"
    assert history.scan_image(scans, 99).count() == 0


def test_stats(scans):
    row = history.history_stats(scans).first()
    assert tuple(row) == (7, 3, 4, 50.0, "Corn  Common Rust")
    assert tuple(history.stats_from_classes(class_totals(scans)).first()) == tuple(row)
    empty = history.history_stats(scans.where("id > 99")).first()
    assert tuple(empty) == (0, 0, 0, 0.0, None)
    assert history.most_common_disease(scans.where("id > 99")).count() == 0


def test_mean_is_rounded_half_even_and_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([scan(1, "b__x", name="B", percent=0.3), scan(2, "a__x", name="A", percent=0.4)], SCAN)
    row = history.history_stats(df).first()
    assert row["average_confidence"] == round((0.3 + 0.4) / 2, 1) and row["most_common_disease"] == "A"


def test_append_and_read_back(spark, tmp_path):
    path = str(tmp_path / "history")
    new = spark.createDataFrame([scan(0, filename=f"history-leaf-{i}.png") for i in range(3)], SCAN).drop("id")
    append_scans(new, path)
    append_scans(new.limit(1).withColumn("filename", F.lit("late.png")), path)
    stored = read_history(spark, path)
    assert sorted(ids(stored)) == [1, 2, 3, 4]
    found = history.list_scans(stored, query="late")
    assert [r["id"] for r in found.collect()] == [4]
    assert bytes(history.scan_image(stored, 4).first()["image"]) == b"img0"
    unstamped = new.limit(1).drop("created_at")
    append_scans(unstamped, path)
    assert read_history(spark, path).where("created_at is null").count() == 0


# The 25 class labels in id order.
LABELS = """
Corn Cercospora Leaf Spot / Gray Leaf Spot
Corn Common Rust
Corn Healthy
Corn Northern Leaf Blight
Lemon Anthracnose
Lemon Bacterial Blight
Lemon Citrus Canker
Lemon Curl Virus
Lemon Deficiency Leaf
Lemon Dry Leaf
Lemon Healthy
Lemon Sooty Mould
Lemon Spider Mites
Bell Pepper Bacterial Spot
Bell Pepper Healthy
Tomato Bacterial Spot
Tomato Early Blight
Tomato Healthy
Tomato Late Blight
Tomato Leaf Mold
Tomato Septoria Leaf Spot
Tomato Spider Mites / Two-Spotted Spider Mite
Tomato Target Spot
Tomato Mosaic Virus
Tomato Yellow Leaf Curl Virus
"""


def test_every_label_has_guidance(spark):
    keys = [fact[0] for fact in FACTS]
    keys += [f"{crop}__healthy" for crop in ("corn", "lemon", "pepper", "tomato")]
    frame = spark.createDataFrame([(k,) for k in keys], "class_key string")
    found = guidance.guidance_for_keys(frame, guidance_records(spark)).collect()
    assert sorted(r["display_name"] for r in found) == sorted(LABELS.strip().splitlines())
    healthy = next(r for r in found if r["class_key"] == "pepper__healthy")
    assert healthy["management_label"] == "Care Steps" and healthy["cure_points"] and healthy["prevention_points"]
    assert all(len(r["sources"]) == 7 and r["disclaimer"] for r in found)
    assert all(r[s] and all(r[s]) for r in found for s in ("cause_factors", "cure_points", "prevention_points"))
    assert [r["class_key"] for r in found if r["note"] and r["classification"] != "Healthy"] == ["lemon__curl_virus"]


def test_guidance_fallback_is_a_literal_suffix(spark):
    frame = spark.createDataFrame(
        [("not-a-model-class", "n"), ("kiwi__healthy", "n"), ("kiwi__unhealthy", "n"), ("sweet_pea__healthy", "n"),
         ("corn__common_rust", "n")], "class_key string, display_name string")
    found = {r["class_key"]: r["guidance_display_name"]
             for r in guidance.with_guidance(frame, guidance_records(spark)).collect()}
    assert found == {"kiwi__healthy": "Kiwi Healthy", "sweet_pea__healthy": "Sweet_Pea Healthy",
                     "corn__common_rust": "Corn Common Rust"}


def test_guidance_points_come_from_rows(spark):
    points = spark.createDataFrame(
        [("corn__common_rust", "cure_points", 2, "second"), ("corn__common_rust", "cure_points", 1, "first"),
         ("corn__common_rust", "cause_factors", 1, "cause")],
        "class_key string, section string, position int, text string")
    rows = {r["class_key"]: r for r in guidance_records(spark, points).collect()}
    assert len(rows) == 21
    assert rows["corn__common_rust"]["cure_points"] == ["first", "second"]
    assert rows["corn__common_rust"]["cause_factors"] == ["cause"]
    assert rows["lemon__dry_leaf"]["cure_points"]
