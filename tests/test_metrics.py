"""Metrics against brute force on hand-made scores."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from subtide.operators import metrics
from tests.conftest import rows


def _scored(spark, pairs):
    return spark.createDataFrame(pairs, "y_actual int, y_pred double")


def _random_scores(n, ties, seed):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.4), round(rng.random(), ties)) for _ in range(n)]


def _brute_curve(pairs):
    p, n = sum(y for y, _ in pairs), sum(1 - y for y, _ in pairs)
    top = max(s for _, s in pairs) + 1
    curve = [(top, 0.0, 0.0)]
    for t in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(y for y, s in pairs if s >= t)
        fp = sum(1 - y for y, s in pairs if s >= t)
        curve.append((t, fp / n, tp / p))
    return curve


def _without_straight_points(pairs, curve):
    """Origin, first, last and every point where either count's step changes."""
    count = {s: [0, 0] for _, s in pairs}
    for y, s in pairs:
        count[s][y] += 1
    kept = curve[:2]
    for here, after in zip(curve[2:-1], curve[3:]):
        if count[here[0]] != count[after[0]]:
            kept.append(here)
    return kept + curve[-1:]


@pytest.mark.parametrize("buckets", [1, 2, 5, 40])
@pytest.mark.parametrize("ties", [1, 2, 6])
def test_roc_curve_and_area(spark, buckets, ties):
    pairs = _random_scores(300, ties, seed=ties)
    scored = _scored(spark, pairs)
    want = _brute_curve(pairs)
    found = sorted(map(tuple, metrics.roc_curve(scored, buckets=buckets).collect()), reverse=True)
    assert found == want
    thin = metrics.roc_curve(scored, buckets=buckets, drop_intermediate=True)
    assert sorted(map(tuple, thin.collect()), reverse=True) == _without_straight_points(pairs, want)
    wins = sum(
        (a > b) + 0.5 * (a == b) for y, a in pairs if y for z, b in pairs if not z
    )
    p = sum(y for y, _ in pairs)
    area = metrics.auc_score(scored, buckets=buckets).first().auc
    assert area == pytest.approx(wins / (p * (len(pairs) - p)), abs=1e-12)


def test_area_agrees_with_spark_evaluator(spark):
    scored = _scored(spark, _random_scores(400, 3, seed=9))
    evaluator = BinaryClassificationEvaluator(
        rawPredictionCol="y_pred", labelCol="label", numBins=0
    )
    labelled = scored.withColumn("label", F.col("y_actual").cast("double"))
    assert metrics.auc_score(scored).first().auc == pytest.approx(evaluator.evaluate(labelled), abs=1e-9)


def test_one_hot_score_and_one_class(spark):
    same = _scored(spark, [(1, 0.5), (0, 0.5), (1, 0.5)])
    assert rows(metrics.roc_curve(same)) == [(0.5, 1.0, 1.0), (1.5, 0.0, 0.0)]
    assert metrics.auc_score(same).first().auc == 0.5
    positives = _scored(spark, [(1, 0.5), (1, 0.7)])
    assert metrics.auc_score(positives).first().auc is None
    assert {r.fpr for r in metrics.roc_curve(positives).collect()} == {None, 0.0}


def test_missing_score_raises(spark):
    with pytest.raises(ValueError, match="null scores"):
        metrics.roc_curve(_scored(spark, [(1, 0.5), (0, None), (0, 0.2)]))
    with pytest.raises(Exception, match="NaN"):
        metrics.roc_curve(_scored(spark, [(1, 0.5), (0, float("nan")), (0, 0.2)]))


def test_threshold_is_inclusive(spark):
    labels = metrics.threshold_predict(_scored(spark, [(1, 0.55), (0, 0.5499)]), 0.55)
    assert sorted(r.y_label for r in labels.collect()) == [0, 1]


@pytest.fixture
def predicted(spark):
    cells = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 0)] * 3 + [(1, 1)] * 6
    return spark.createDataFrame(cells, "y_actual int, y_label int")


def test_matrix_and_ratios(predicted):
    assert rows(metrics.confusion_matrix(predicted)) == [(5, 2, 3, 6)]
    assert metrics.accuracy(predicted).first()[0] == 11 / 16
    assert metrics.f1_binary(predicted).first()[0] == pytest.approx(12 / 17)
    area = metrics.auc_hard_label(predicted).first()[0]
    assert area == pytest.approx((6 / 9 + 5 / 7) / 2)


def test_hard_label_area_is_that_of_its_curve(predicted):
    scored = predicted.withColumn("y_pred", F.col("y_label").cast("double"))
    hard, curve = metrics.auc_hard_label(predicted), metrics.auc_score(scored)
    assert hard.first().auc == pytest.approx(curve.first().auc)


def test_report(predicted):
    report = {r["class"]: r[1:] for r in metrics.classification_report(predicted).collect()}
    f0, f1 = 2 * 5 / (2 * 5 + 5), 2 * 6 / (2 * 6 + 5)
    assert report["0"] == pytest.approx((5 / 8, 5 / 7, f0, 7))
    assert report["1"] == pytest.approx((6 / 8, 6 / 9, f1, 9))
    assert report["accuracy"] == (None, None, 11 / 16, 16)
    assert report["macro avg"] == pytest.approx(((5 / 8 + 6 / 8) / 2, (5 / 7 + 6 / 9) / 2, (f0 + f1) / 2, 16))
    weighted = (f0 * 7 + f1 * 9) / 16
    assert report["weighted avg"][2] == pytest.approx(weighted)


def test_report_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y_actual int, y_label int")
    report = {r["class"]: r[1:] for r in metrics.classification_report(df).collect()}
    assert report["1"] == (0.0, 0.0, 0.0, 0)
    assert report["accuracy"][2] == 1.0


def test_r2(spark):
    pairs = _random_scores(50, 4, seed=1)
    mean = sum(y for y, _ in pairs) / 50
    want = 1 - sum((y - s) ** 2 for y, s in pairs) / sum((y - mean) ** 2 for y, _ in pairs)
    assert metrics.r2(_scored(spark, pairs)).first()[0] == pytest.approx(want)
    assert metrics.r2(_scored(spark, [(1, 0.2), (1, 0.4)])).first()[0] is None


def test_unknown_labels_raise(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (None, 0, 0.5)], "y_actual int, y_label int, y_pred double")
    for metric in (metrics.confusion_matrix, metrics.accuracy, metrics.r2, metrics.classification_report):
        with pytest.raises(Exception, match="unknown labels"):
            metric(df).collect()
    with pytest.raises(Exception, match="unknown labels"):
        metrics.roc_curve(df)
