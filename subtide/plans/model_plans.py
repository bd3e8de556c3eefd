"""Queries of the churn models. A fit has no SQL form; tests check its quality."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.operators import metrics, models
from subtide.plans.churn_plans import features
from subtide.plans.inputs import Inputs
from subtide.plans.registry import query


def _report(t: Inputs, kind: str) -> DataFrame:
    data = models.prepare(features(t))
    return models.fit_report(models.fit(data, kind), data)


@query("fit_tree")
def fit_tree(t: Inputs) -> DataFrame:
    return _report(t, "tree")


@query("fit_forest")
def fit_forest(t: Inputs) -> DataFrame:
    return _report(t, "forest")


@query("fit_gbt")
def fit_gbt(t: Inputs) -> DataFrame:
    return _report(t, "gbt")


@query("fit_logistic")
def fit_logistic(t: Inputs) -> DataFrame:
    return _report(t, "logistic")


@query("fit_ols")
def fit_ols(t: Inputs) -> DataFrame:
    data = models.prepare(features(t))
    return models.linear_report(models.fit(data, "ols"), data)


@query("grid_tree")
def grid_tree(t: Inputs) -> DataFrame:
    return models.grid_tree(models.prepare(features(t))).table


@query("grid_forest")
def grid_forest(t: Inputs) -> DataFrame:
    return models.grid_forest(models.prepare(features(t))).table


def _importances(t: Inputs, kind: str) -> DataFrame:
    data = models.prepare(features(t))
    return models.importances(t.spark, models.fit(data, kind), data.features)


@query("tree_importances")
def tree_importances(t: Inputs) -> DataFrame:
    return _importances(t, "tree")


@query("forest_importances")
def forest_importances(t: Inputs) -> DataFrame:
    return _importances(t, "forest")


@query("logistic_coefficients")
def logistic_coefficients(t: Inputs) -> DataFrame:
    data = models.prepare(features(t))
    return models.coefficients(t.spark, models.fit(data, "logistic"), data.features)


def scored(t: Inputs, kind: str = "tree") -> DataFrame:
    data = models.prepare(features(t))
    return models.score(models.fit(data, kind), data.test)


@query("scored_test")
def scored_test(t: Inputs) -> DataFrame:
    return scored(t).select("subid", "y_actual", "y_pred")


@query("tree_roc")
def tree_roc(t: Inputs) -> DataFrame:
    return metrics.roc_curve(scored(t))


@query("tree_threshold_report")
def tree_threshold_report(t: Inputs) -> DataFrame:
    return metrics.classification_report(metrics.threshold_predict(scored(t), 0.55))


CLASSIFIERS = ("tree", "logistic", "forest", "gbt")


def _for_each_classifier(t: Inputs, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of the four classifiers on the test rows, marked by ``model``."""
    data = models.prepare(features(t))

    def evaluated(kind: str, model: Model) -> DataFrame:
        return evaluate(models.score(model, data.test)).withColumn("model", F.lit(kind))

    return reduce(DataFrame.unionByName, models.for_each_fit(data, CLASSIFIERS, evaluated))


@query("model_auc")
def model_auc(t: Inputs) -> DataFrame:
    """Area of the score's curve and of the hard label's."""

    def areas(predicted: DataFrame) -> DataFrame:
        hard = metrics.auc_hard_label(predicted).withColumnRenamed("auc", "auc_hard_label")
        return hard.withColumn("auc_score", metrics.auc_score(predicted).scalar())

    return _for_each_classifier(t, areas)


@query("model_roc")
def model_roc(t: Inputs) -> DataFrame:
    return _for_each_classifier(t, metrics.roc_curve)


@query("model_reports")
def model_reports(t: Inputs) -> DataFrame:
    return _for_each_classifier(t, metrics.classification_report)
