"""Rows that match nothing are reported, never dropped."""

import time

import pytest
from pyspark.sql import functions as F

from frondlake.functions import vectors
from frondlake.operators import evaluation, integrity, mutation, scoring, training
from frondlake.streaming.tables import table_stream

MANIFEST = ("split string, class_id long, class_index int, class_key string, display_name string, crop string, "
            "disease string, family_id string, augmentation string, relative_path string")


def manifest(spark, catalog, paths, extra=()):
    rows = catalog.orderBy("id").collect()
    return spark.createDataFrame(
        [("train", r["id"], r["index"], r["key"], r["display_name"], r["crop"], r["disease"], f"f{r['id']}", "none",
          path if path is None else f"{r['relative_directory']}/{path}") for r, path in zip(rows, paths)] + list(extra), MANIFEST)


def test_delete_class_reports_unknown_classes(spark, catalog):
    stray = ("train", 99, 98, "x__y", "X", "x", "y", "f", "none", "x/a.jpg")
    good = manifest(spark, catalog, ["a.jpg", "b.jpg", "c.jpg"])
    kept = mutation.delete_class(catalog, good, 1).manifest
    assert sorted(r.class_id for r in kept.collect()) == [1, 2]
    with pytest.raises(Exception, match="unknown class: 99"):
        mutation.delete_class(catalog, good.union(spark.createDataFrame([stray], MANIFEST)), 1).manifest.collect()


def test_empty_path_is_a_violation(spark, catalog):
    found = integrity.manifest_violations(manifest(spark, catalog, ["a.jpg", None, "c.txt"]), catalog).collect()
    assert sorted(r["code"] for r in found) == ["bad_extension", "bad_extension"]


def test_ranks_outside_the_catalog_are_an_error(spark, catalog):
    rows = spark.createDataFrame([("a", [0.1, 0.2, 0.3])], "image string, logits array<double>")
    assert scoring.rank_predictions(rows, catalog, top_k=3).count() == 3
    wide = spark.createDataFrame([("a", [0.1, 0.2, 0.3, 0.9])], "image string, logits array<double>")
    with pytest.raises(Exception, match="no class with index 3"):
        scoring.rank_predictions(wide, catalog, top_k=3).collect()


def test_samples_without_prediction_or_class_are_an_error(spark, catalog):
    samples = spark.createDataFrame([("a", 0), ("b", 1)], "image string, target int")
    one = spark.createDataFrame([("a", 0, 0.5)], "image string, predicted int, confidence double")
    with pytest.raises(Exception, match="without a prediction: b"):
        evaluation.prediction_detail(samples, one, catalog).collect()
    both = one.union(spark.createDataFrame([("b", 7, 0.5)], one.schema))
    with pytest.raises(Exception, match="no class with index 7"):
        evaluation.prediction_detail(samples, both, catalog).collect()
    counts = evaluation.confusion_counts(spark.createDataFrame([(0, 7)], "target int, predicted int"))
    with pytest.raises(Exception, match="not in the catalog"):
        evaluation.confusion_matrix(counts, catalog).collect()


def test_labels_without_weight_are_an_error(spark):
    rows = spark.createDataFrame([([1.0, 0.0], 0), ([0.0, 1.0], 1)] * 5, "features array<double>, target int")
    weights = spark.createDataFrame([(0, 1.0)], "class_index int, weight double")
    with pytest.raises(Exception, match="no weight for class 1"):
        training.fit_linear_head(rows, weights)


@pytest.mark.parametrize("parts", [0, 3])
def test_streams_read_files_and_folders(spark, tmp_path, parts):
    path = tmp_path / "events.parquet"
    rows = spark.range(1000).withColumn("v", F.col("id") % 7)
    if parts:
        rows.repartition(parts).write.parquet(str(path))
    else:
        rows.toPandas().to_parquet(path)
    stream = table_stream(spark, str(path), rows.schema)
    query = stream.writeStream.format("memory").queryName(f"t{parts}").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "checkpoint")).start()
    query.awaitTermination()
    assert spark.table(f"t{parts}").count() == 1000


def test_softmax_and_loss_are_linear_in_classes(spark):
    def seconds(classes):
        rows = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(classes)), lambda i: F.sin(i + F.col("id"))).alias("x"))
        weights = F.array_repeat(F.lit(1.0), classes)
        out = rows.select(F.sum(vectors.smoothed_cross_entropy(F.col("x"), F.lit(1), weights, 0.1)),
                          F.sum(vectors.softmax(F.col("x"))[0]))
        out.collect()
        started = time.perf_counter()
        out.collect()
        return time.perf_counter() - started

    assert seconds(400) < 30 * max(seconds(50), 0.05)
