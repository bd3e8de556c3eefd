"""Queries of the evaluation metrics on a fixed, repeatable score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.functions import u01
from subtide.operators import encode, metrics
from subtide.plans.churn_plans import features
from subtide.plans.inputs import Inputs
from subtide.plans.registry import query

THRESHOLD = 0.55


def fixed_score(table: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Test rows with a score in [0, 1] that has ties and leans towards the label."""
    _, test = encode.train_test_split(table)
    lift = F.lit(0.4) * F.col("churn") * u01("subid", "lift")
    score = F.round(u01("subid", "score") * 0.6 + lift, 3)
    return test.select("subid", F.col("churn").alias("y_actual"), score.alias("y_pred"), *carry)


def labelled(t: Inputs) -> DataFrame:
    return metrics.threshold_predict(fixed_score(features(t)), THRESHOLD)


_F1 = "coalesce(2.0 * {h} / nullif(2 * {h} + fp + fn, 0), 0)"


@query(
    "threshold_metrics",
    "SELECT tn, fp, fn, tp, CAST(tp AS DOUBLE) / (tp + fp) AS precision, "
    "CAST(tp AS DOUBLE) / (tp + fn) AS recall FROM matrix",
)
def threshold_metrics(t: Inputs) -> DataFrame:
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    return metrics.confusion_matrix(labelled(t)).select(
        *metrics.CELLS,
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
    )


@query(
    "accuracy",
    "SELECT CAST(count(*) FILTER (y_actual = y_label) AS DOUBLE) / count(*) AS accuracy FROM labelled",
)
def accuracy(t: Inputs) -> DataFrame:
    return metrics.accuracy(labelled(t))


@query(
    "r2",
    "SELECT round(1 - sum(pow(y_actual - y_pred, 2)) / sum(pow(y_actual - m, 2)), 8) AS r2 "
    "FROM scored, (SELECT avg(y_actual) AS m FROM scored)",
)
def r2(t: Inputs) -> DataFrame:
    return metrics.r2(fixed_score(features(t))).select(F.round("r2", 8).alias("r2"))


@query("confusion_matrix", "SELECT tn, fp, fn, tp FROM matrix")
def confusion_matrix(t: Inputs) -> DataFrame:
    return metrics.confusion_matrix(labelled(t))


_BY_CLASS = (
    "(SELECT '0' AS class, CAST(tn AS DOUBLE) / (tn + fn) AS precision, "
    f"CAST(tn AS DOUBLE) / (tn + fp) AS recall, {_F1.format(h='tn')} AS f1_score, "
    "tn + fp AS support FROM matrix "
    "UNION ALL SELECT '1', CAST(tp AS DOUBLE) / (tp + fp), CAST(tp AS DOUBLE) / (tp + fn), "
    f"{_F1.format(h='tp')}, tp + fn FROM matrix)"
)


@query(
    "classification_report",
    f"SELECT class, precision, recall, f1_score, support FROM {_BY_CLASS} "
    "UNION ALL SELECT 'accuracy', NULL, NULL, CAST(tn + tp AS DOUBLE) / (tn + fp + fn + tp), "
    "tn + fp + fn + tp FROM matrix "
    "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), "
    f"CAST(sum(support) AS BIGINT) FROM {_BY_CLASS} "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), "
    "sum(recall * support) / sum(support), sum(f1_score * support) / sum(support), "
    f"CAST(sum(support) AS BIGINT) FROM {_BY_CLASS}",
)
def classification_report(t: Inputs) -> DataFrame:
    return metrics.classification_report(labelled(t))


@query("f1_binary", f"SELECT {_F1.format(h='tp')} AS f1 FROM matrix")
def f1_binary(t: Inputs) -> DataFrame:
    return metrics.f1_binary(labelled(t))


_ORIGIN = "SELECT max(score) + 1 AS threshold, CAST(0 AS DOUBLE) AS fpr, CAST(0 AS DOUBLE) AS tpr FROM score_groups"


@query(
    "roc_curve",
    f"SELECT score AS threshold, fps / n AS fpr, tps / p AS tpr FROM score_running, class_totals "
    f"UNION ALL {_ORIGIN}",
)
def roc_curve(t: Inputs) -> DataFrame:
    return metrics.roc_curve(fixed_score(features(t)))


@query(
    "roc_curve_corners",
    f"SELECT score AS threshold, fps / n AS fpr, tps / p AS tpr FROM score_running, class_totals "
    f"WHERE next_pos IS NULL OR pos <> next_pos OR neg <> next_neg "
    f"OR score = (SELECT max(score) FROM score_groups) UNION ALL {_ORIGIN}",
)
def roc_curve_corners(t: Inputs) -> DataFrame:
    return metrics.roc_curve(fixed_score(features(t)), drop_intermediate=True)


@query(
    "auc_score",
    "SELECT CAST(sum(neg * (2 * tps - pos)) AS DOUBLE) / (2.0 * any_value(p) * any_value(n)) AS auc "
    "FROM score_running, class_totals",
)
def auc_score(t: Inputs) -> DataFrame:
    return metrics.auc_score(fixed_score(features(t)))


@query(
    "auc_hard_label",
    "SELECT (CAST(tp AS DOUBLE) / (tp + fn) + 1 - CAST(fp AS DOUBLE) / (fp + tn)) / 2 AS auc FROM matrix",
)
def auc_hard_label(t: Inputs) -> DataFrame:
    return metrics.auc_hard_label(labelled(t))
