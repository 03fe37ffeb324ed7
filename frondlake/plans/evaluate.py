"""Evaluation job: score a split, then metrics, report, matrix and per-image rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import evaluation, scoring
from ..session import cut_lineage


@dataclass(frozen=True)
class Evaluation:
    counts: DataFrame
    metrics: DataFrame
    report: DataFrame
    matrix: DataFrame
    details: DataFrame  # one row per image


def evaluate_scored(scored: DataFrame, catalog: DataFrame, *, key: str = "image") -> Evaluation:
    """All evaluation results of rows ``(key, target, logits)``.

    The metrics share one small table of (target, predicted) counts. ``scored``
    is read once for the counts and once for the details: pass stored rows.
    """
    predicted = scoring.predicted_class(scored)
    counts = evaluation.confusion_counts(predicted)
    return Evaluation(
        counts=counts,
        metrics=evaluation.eval_metrics(counts),
        report=evaluation.classification_report(counts, catalog),
        matrix=evaluation.normalize_rows(evaluation.confusion_matrix(counts, catalog)),
        details=evaluation.named_predictions(predicted, catalog, key),
    )


def evaluate_split(samples: DataFrame, catalog: DataFrame, make_predictor: Callable[[], Callable], *,
                   feature_shape: Sequence[int], split: str = "test", key: str = "image",
                   features_col: str = "features") -> Evaluation:
    """Score the samples of one split and evaluate them (runs the scoring job).

    The logits are kept in the checkpoint folder, so the model runs once.
    """
    rows = samples.where(samples["split"] == split) if "split" in samples.columns else samples
    scored = scoring.score_batches(rows, make_predictor, features_col, feature_shape=feature_shape)
    return evaluate_scored(cut_lineage(scored.select(key, "target", "logits")), catalog, key=key)
