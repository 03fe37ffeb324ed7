import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from frondlake.operators import evaluation, scoring, training
from frondlake.plans.evaluate import evaluate_scored, evaluate_split
from frondlake.sources import sinks


def rows_of(spark, pairs):
    return spark.createDataFrame(pairs, "target int, predicted int")


def test_metrics_use_their_own_label_sets(spark, catalog):
    # Class 2 is only predicted, class 1 is never predicted.
    counts = evaluation.confusion_counts(rows_of(spark, [(0, 0), (0, 0), (0, 2), (1, 0)]))
    row = evaluation.eval_metrics(counts).first()
    f0 = 2 * 2 / (3 + 3)
    assert row["accuracy"] == 0.5
    assert row["macro_f1"] == pytest.approx(f0 / 3)
    assert row["weighted_f1"] == pytest.approx(f0 * 3 / 4)
    assert row["balanced_accuracy"] == pytest.approx((2 / 3 + 0) / 2)
    report = {r["label"]: r for r in evaluation.classification_report(counts, catalog).collect()}
    assert report["Corn Common Rust"]["precision"] == pytest.approx(2 / 3)
    assert report["Corn Healthy"]["recall"] == 0 and report["Corn Healthy"]["support"] == 1
    assert report["Lemon Curl Virus"]["f1"] == 0 and report["Lemon Curl Virus"]["support"] == 0
    assert report["macro avg"]["f1"] == pytest.approx(f0 / 3) and report["accuracy"]["f1"] == 0.5
    assert report["weighted avg"]["precision"] == pytest.approx(2 / 3 * 3 / 4)


def test_absent_classes_count_in_the_report_only(spark, catalog):
    counts = evaluation.confusion_counts(rows_of(spark, [(0, 0), (1, 1)]))
    assert evaluation.eval_metrics(counts).first()["macro_f1"] == 1.0
    report = {r["label"]: r["f1"] for r in evaluation.classification_report(counts, catalog).collect()}
    assert report["macro avg"] == pytest.approx(2 / 3)


def test_all_wrong(spark):
    row = evaluation.eval_metrics(evaluation.confusion_counts(rows_of(spark, [(0, 1), (1, 0)]))).first()
    assert tuple(row)[:4] == (0, 0, 0, 0)


def test_matrix_keeps_zero_cells(spark, catalog):
    counts = evaluation.confusion_counts(rows_of(spark, [(0, 0), (0, 1)]))
    matrix = evaluation.normalize_rows(evaluation.confusion_matrix(counts, catalog))
    cells = {(r["target"], r["predicted"]): (r["images"], r["share"]) for r in matrix.collect()}
    assert len(cells) == 9 and cells[0, 1] == (1, 0.5) and cells[2, 2] == (0, 0.0)
    names = ["Corn Common Rust", "Corn Healthy", "Lemon Curl Virus"]
    wide = evaluation.wide_matrix(matrix, catalog, names)
    assert wide.columns == ["actual/predicted", *names]
    assert [tuple(r) for r in wide.collect()] == [
        ("Corn Common Rust", 1, 1, 0), ("Corn Healthy", 0, 0, 0), ("Lemon Curl Virus", 0, 0, 0)]


def test_details_are_paired_by_key(spark, catalog):
    samples = spark.createDataFrame([("a", 0), ("b", 1)], "image string, target int")
    predictions = spark.createDataFrame([("b", 1, 0.123456789), ("a", 2, 1.0)],
                                        "image string, predicted int, confidence double")
    rows = {r["image"]: r for r in evaluation.prediction_detail(samples, predictions, catalog).collect()}
    assert rows["b"]["correct"] and rows["b"]["confidence"] == round(0.123456789, 7)
    assert (rows["a"]["actual_class_id"], rows["a"]["predicted_name"], rows["a"]["correct"]) == (1, "Lemon Curl Virus", False)


def test_batch_losses_against_the_definition(spark):
    logits = {1: [2.0, -1.0, 0.5], 2: [0.0, 0.0, 3.0], 3: [1.0, 1.0, 1.0]}
    targets, weight, eps = {1: 0, 2: 1, 3: 2}, [0.5, 2.0, 1.0], 0.1
    rows = spark.createDataFrame([(i, logits[i], targets[i], i // 3) for i in logits],
                                 "image int, logits array<double>, target int, batch int")
    weights = spark.createDataFrame(list(enumerate(weight)), "class_index int, weight double")

    def loss(members):
        top = bottom = 0.0
        for i in members:
            z = math.log(sum(math.exp(v) for v in logits[i]))
            nll = [z - v for v in logits[i]]
            top += (1 - eps) * weight[targets[i]] * nll[targets[i]] + eps / 3 * sum(w * n for w, n in zip(weight, nll))
            bottom += weight[targets[i]]
        return top / bottom

    got = {r["batch"]: r for r in evaluation.batch_losses(rows, weights).collect()}
    assert got[0]["loss"] == pytest.approx(loss([1, 2])) and got[1]["loss"] == pytest.approx(loss([3]))
    assert (got[0]["images"], got[0]["correct"]) == (2, 1)
    mean = evaluation.mean_loss(evaluation.batch_losses(rows, weights)).first()
    assert mean["loss"] == pytest.approx((loss([1, 2]) * 2 + loss([3])) / 3)
    assert mean["accuracy"] == pytest.approx(1 / 3)


def test_ranked_predictions_and_exports(spark, catalog, tmp_path):
    rows = spark.createDataFrame([("a", [0.0, 2.0, 2.0]), ("b", [5.0, 0.0, 0.0])], "image string, logits array<double>")
    ranked = scoring.rank_predictions(rows, catalog, top_k=2)
    got = {(r["image"], r["rank"]): r["class_key"] for r in ranked.collect()}
    assert got == {("a", 1): "corn__healthy", ("a", 2): "lemon__curl_virus", ("b", 1): "corn__common_rust",
                   ("b", 2): "corn__healthy"}
    assert scoring.rank_predictions(rows, catalog, top_k=50).count() == 6
    with pytest.raises(ValueError):
        scoring.rank_predictions(rows, catalog, top_k=0)
    path = str(tmp_path / "predictions")
    sinks.write_predictions_json(scoring.nest_predictions(ranked), path, checkpoint="model")
    stored = {r["image"]: r for r in spark.read.json(path).collect()}
    assert [p["rank"] for p in stored["a"]["predictions"]] == [1, 2] and stored["a"]["checkpoint"] == "model"


def test_inference_time_reaches_the_written_predictions(spark, catalog, tmp_path):
    rows = spark.createDataFrame([(f"i{i}", [float(i), 1.0, 0.0]) for i in range(7)], "image string, features array<double>")

    def predictor():
        return lambda batch: np.asarray(batch, dtype=np.float64)

    plain = scoring.score_batches(rows, predictor, "features", feature_shape=[3])
    timed = scoring.score_batches(rows, predictor, "features", feature_shape=[3], time_into="inference_ms")
    assert timed.columns == ["image", "features", "logits", "inference_ms"]
    assert sorted(timed.drop("inference_ms").collect()) == sorted(plain.collect())
    ranked = scoring.rank_predictions(timed, catalog, top_k=2, carry=["inference_ms"])
    path = str(tmp_path / "predictions")
    sinks.write_predictions_json(scoring.nest_predictions(ranked, carry=["inference_ms"]), path, checkpoint="model")
    stored = spark.read.json(path).collect()
    assert len(stored) == 7 and all(0 <= r["inference_ms"] < 60_000 for r in stored)
    assert all(set(p.asDict()) >= {"rank", "confidence"} and "inference_ms" not in p for r in stored for p in r["predictions"])


def test_low_confidence_is_strict(spark):
    rows = spark.createDataFrame([(0.5,), (0.49,)], "confidence double")
    assert [r["uncertain"] for r in scoring.flag_uncertain(rows).collect()] == [False, True]


def test_evaluation_job(spark, catalog, tmp_path):
    samples = spark.createDataFrame(
        [("a", "test", 0, [1.0, 0.0, 0.0]), ("b", "test", 1, [0.0, 1.0, 0.0]), ("c", "train", 2, [0.0, 0.0, 1.0]),
         ("d", "test", 2, [1.0, 0.0, 0.0])], "image string, split string, target int, features array<double>")

    def predictor():
        return lambda batch: np.asarray(batch, dtype=np.float64) * 4

    result = evaluate_split(samples, catalog, predictor, feature_shape=[3])
    assert result.metrics.first()["accuracy"] == pytest.approx(2 / 3)
    assert {r["image"]: r["correct"] for r in result.details.collect()} == {"a": True, "b": True, "d": False}
    sinks.write_report_csv(result.report, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 6
    sinks.write_predictions_csv(result.details, str(tmp_path / "details"))
    assert spark.read.option("header", True).csv(str(tmp_path / "details")).count() == 3
    again = evaluate_scored(samples.withColumn("logits", F.col("features")), catalog)
    assert again.metrics.first()["images"] == 4


def epochs(spark, scores):
    return spark.createDataFrame(list(enumerate(scores, 1)), "epoch int, val_macro_f1 double")


def test_best_epoch_is_the_first_strict_improvement(spark):
    row = training.best_epoch(epochs(spark, [0.5, 0.7, 0.7, 0.6])).first()
    assert tuple(row) == (2, 0.7, 4, False)
    assert training.best_epoch(epochs(spark, [0.9, 0.1])).first()["best_epoch"] == 1


def test_early_stop_ignores_later_epochs(spark):
    history = epochs(spark, [0.5, 0.4, 0.4, 0.9, 0.95])
    assert tuple(training.best_epoch(history, patience=2).first()) == (1, 0.5, 3, True)
    ran = training.early_stop(history, patience=2).orderBy("epoch").collect()
    assert [(r["epoch"], r["stale"]) for r in ran] == [(1, 0), (2, 1), (3, 2)]
    assert training.early_stop(history, patience=3).count() == 5


def test_epoch_history_export(spark, tmp_path):
    rows = epochs(spark, [0.5, 0.4]).withColumn("learning_rates", F.array(F.lit(1e-4), F.lit(1e-5)))
    sinks.write_epoch_history_csv(rows.orderBy(F.desc("epoch")), str(tmp_path / "h"))
    stored = spark.read.option("header", True).csv(str(tmp_path / "h")).collect()
    assert [(r["epoch"], r["learning_rates"]) for r in stored] == [("1", "[1.0E-4,1.0E-5]"), ("2", "[1.0E-4,1.0E-5]")]


def test_runs_are_separate(spark):
    both = epochs(spark, [0.5, 0.4]).withColumn("run", F.lit("x")).unionByName(
        epochs(spark, [0.1, 0.2, 0.3]).withColumn("run", F.lit("y")))
    got = {r["run"]: r["best_epoch"] for r in training.best_epoch(both, run_col="run").collect()}
    assert got == {"x": 1, "y": 3}


@pytest.mark.parametrize("names, want", [
    ([("m_final.pth", 9), ("m_BEST.pth", 1), ("m.pth", 99)], "m_BEST.pth"), ([("m.pth", 99), ("m_final.pth", 1)], "m_final.pth"),
    ([("best_a", 1), ("best_b", 2)], "best_b"), ([("x", 1), ("y", 5)], "y"),
])
def test_latest_artifact(spark, names, want):
    assert training.latest_artifact(spark.createDataFrame(names, "path string, mtime int")).first()["path"] == want


def test_no_artifact(spark):
    assert training.latest_artifact(spark.createDataFrame([], "path string, mtime int")).count() == 0


def test_epoch_batches(spark):
    df = spark.range(101).withColumnRenamed("id", "image")
    made = training.epoch_batches(df, id_col="image", seed=1, epoch=2, batch_size=10)
    sizes = {r["batch"]: r["n"] for r in made.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes == {**{b: 10 for b in range(10)}, 10: 1}

    def order(**options):
        return [r["image"] for r in training.epoch_batches(df, id_col="image", **options).orderBy("place").collect()]

    assert order(seed=1, epoch=2) == order(seed=1, epoch=2) != order(seed=1, epoch=3)
    assert order(seed=1, epoch=2, shuffle=False) == order(seed=1, epoch=9, shuffle=False)
    with pytest.raises(ValueError):
        order(seed=1, batch_size=0)


def test_linear_head_learns(spark):
    rows = [(i % 2, [float(i % 2), 1.0 - i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "target int, features array<double>")
    weights = spark.createDataFrame([(0, 1.0), (1, 1.0)], "class_index int, weight double")
    model = training.fit_linear_head(df, weights)
    out = model.transform(training.linear_head_input(df))
    assert out.where(F.col("prediction") != F.col("target")).count() == 0
