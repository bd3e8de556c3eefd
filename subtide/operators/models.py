"""Churn models on ``pyspark.ml``: fitting, grid search, scoring, explanation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from contextvars import copy_context
from dataclasses import dataclass
from functools import partial
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from subtide.functions import u01
from subtide.operators.clv import COST_COLUMNS
from subtide.operators.encode import dummy_encode, feature_columns, with_split
from subtide.operators.ensembles import labels_of_leaves, node_tables
from subtide.operators.metrics import CELLS, confusion_matrix, r2
from subtide.sources import materialize

Job, Result = TypeVar("Job"), TypeVar("Result")
FOLD_KEYS = 100_000
_IO = {"featuresCol": "features", "labelCol": "churn"}
# Kinds of fits by the time they take.
_LONGEST_FIRST = ("gbt", "forest", "logistic", "tree", "ols")
# Tells the fits that the label has two classes, which they would otherwise find
# out by one more pass over the training rows.
_TWO_CLASSES = {"ml_attr": {"name": "churn", "type": "nominal", "vals": ["0", "1"]}}


@dataclass(frozen=True)
class ModelData:
    """The stored modelling table, its stored rows by split, the feature names.

    The rows are (subid, churn, features, cost columns, is_train). ``encoded`` has a
    column for each feature in place of the vector; it is computed when it is read.
    """

    table: DataFrame
    rows: DataFrame
    features: list[str]
    encoded: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.rows.where("is_train").drop("is_train")

    @property
    def test(self) -> DataFrame:
        return self.rows.where("NOT is_train").drop("is_train")


def prepare(features: DataFrame) -> ModelData:
    """Encode, assemble and split a modelling table.

    The table is written once, as its levels are looked up before it is encoded, and
    so are the assembled rows, in one folder for each split: every fit makes many
    passes over them, and none should draw the split or build the vectors again.
    """
    saved = materialize(features, "features")
    encoded = dummy_encode(saved)
    names = feature_columns(encoded)
    marked = with_split(encoded).withColumn("churn", F.col("churn").cast("double"))
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(marked)
    kept = vectors.select("subid", "churn", "features", *COST_COLUMNS, "is_train")
    rows = materialize(kept, "model-rows", ["is_train"])
    return ModelData(saved, rows.withMetadata("churn", _TWO_CLASSES), names, marked)


def _subset(features: int, available: int) -> str:
    """Features tried at a split; all of them where fewer than asked for exist."""
    return str(features) if features < available else "all"


def decision_tree(n_features: int, seed: int = 5) -> Estimator:
    """Entropy tree, depth 6, 12 random features at a split, 30 rows in a leaf.

    A forest of one tree without bootstrap, as only forests draw features.
    """
    return RandomForestClassifier(
        **_IO,
        numTrees=1,
        bootstrap=False,
        impurity="entropy",
        maxDepth=6,
        featureSubsetStrategy=_subset(12, n_features),
        minInstancesPerNode=30,
        seed=seed,
    )


def random_forest(n_features: int, seed: int = 5) -> Estimator:
    """20 entropy trees, depth 8, 12 random features at a split, 30 rows in a leaf."""
    return RandomForestClassifier(
        **_IO,
        numTrees=20,
        impurity="entropy",
        maxDepth=8,
        featureSubsetStrategy=_subset(12, n_features),
        minInstancesPerNode=30,
        seed=seed,
    )


def gradient_boosting(n_features: int, seed: int = 5) -> Estimator:
    """50 rounds of depth 4 at rate 0.1, 8 random features at a split, 30 rows in a leaf."""
    return GBTClassifier(
        **_IO,
        maxIter=50,
        stepSize=0.1,
        maxDepth=4,
        featureSubsetStrategy=_subset(8, n_features),
        minInstancesPerNode=30,
        seed=seed,
    )


def logistic_regression(n_rows: int, c: float = 100.0) -> Estimator:
    """L2 logistic regression with inverse penalty ``c`` on unscaled features.

    Spark's loss is a mean over rows, so the penalty is 1 / (c * rows). The fit goes
    on until the loss settles to ten digits; see :func:`optimum`.
    """
    return LogisticRegression(
        **_IO,
        regParam=1 / (c * max(n_rows, 1)),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=500,
        tol=1e-10,
    )


def linear_probability() -> Estimator:
    """Ordinary least squares on the 0/1 label."""
    return LinearRegression(**_IO, solver="normal", regParam=0.0)


def fit(data: ModelData, kind: str) -> Model:
    """Fit ``tree``, ``forest``, ``gbt``, ``logistic`` or ``ols`` on the training rows."""
    width = len(data.features)
    if kind == "tree":
        estimator = decision_tree(width)
    elif kind == "forest":
        estimator = random_forest(width)
    elif kind == "gbt":
        estimator = gradient_boosting(width)
    elif kind == "logistic":
        estimator = logistic_regression(data.train.count())
    elif kind == "ols":
        estimator = linear_probability()
    else:
        raise ValueError(f"unknown model {kind!r}")
    return estimator.fit(data.train)


def at_once(rows: DataFrame, most: int) -> int:
    """How many fits to run at a time on stored rows: at least two, at most ``most``.

    A fit has a task for each part of the rows and keeps its rows in memory. Where a
    fit's parts are few, more fits share the cores; where they fill the cores, a second
    fit covers the waits of the first, and more would only push rows out of memory.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return min(most, 2 + 4 * cores // max(rows.rdd.getNumPartitions(), 1))


def in_threads(rows: DataFrame, run: Callable[[Job], Result], jobs: Sequence[Job], most: int) -> list[Result]:
    """What ``run`` gives for each job, in the jobs' order, with :func:`at_once` of them at a time.

    Jobs start in their order. What they store belongs to the caller's scope.
    """
    calls = [partial(copy_context().run, run, job) for job in jobs]
    with ThreadPool(min(at_once(rows, most), len(calls))) as pool:
        return pool.map(inheritable_thread_target(rows.sparkSession)(lambda call: call()), calls, chunksize=1)


def for_each_fit(data: ModelData, kinds: Sequence[str], use: Callable[[str, Model], Result]) -> list[Result]:
    """``use`` of each kind's name and fit, in the order of ``kinds``; several run at a time, the longest first."""
    jobs = sorted(kinds, key=_LONGEST_FIRST.index)
    found = dict(zip(jobs, in_threads(data.train, lambda kind: use(kind, fit(data, kind)), jobs, len(jobs))))
    return [found[kind] for kind in kinds]


def score(model: Model, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Predicted probability of churn by subscriber: (subid, y_actual, y_pred, y_label).

    The key, and the columns to ``carry``, travel with the row through the model;
    nothing is matched by position.
    """
    return model.transform(rows).select(
        "subid",
        *carry,
        F.col("churn").cast("int").alias("y_actual"),
        vector_to_array("probability")[1].alias("y_pred"),
        F.col("prediction").cast("int").alias("y_label"),
    )


def score_linear(model: Model, rows: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Fitted value by subscriber: (subid, y_actual, y_pred)."""
    return model.transform(rows).select(
        "subid",
        *carry,
        F.col("churn").cast("int").alias("y_actual"),
        F.col("prediction").alias("y_pred"),
    )


def fit_report(model: Model, data: ModelData) -> DataFrame:
    """Accuracy, F1 of class 1 and confusion counts on the training and the test rows."""
    counts = confusion_matrix(score(model, data.rows, ["is_train"]), by=["is_train"])
    return counts.selectExpr(
        "if(is_train, 'train', 'test') AS split",
        "try_divide(CAST(tn + tp AS DOUBLE), tn + fp + fn + tp) AS accuracy",
        "coalesce(try_divide(2D * tp, 2 * tp + fp + fn), 0D) AS f1",
        *CELLS,
    )


def linear_report(model: Model, data: ModelData) -> DataFrame:
    """R² on the training and on the test rows."""
    fitted = score_linear(model, data.rows, ["is_train"])
    return r2(fitted, by=["is_train"]).selectExpr("if(is_train, 'train', 'test') AS split", "r2")


def importances(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """(feature, importance) of a tree model."""
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, importance double")


def coefficients(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """(feature, coefficient) of a linear model."""
    values = model.coefficients.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values)), "feature string, coefficient double")


def optimum(model: Model, rows: DataFrame, names: Sequence[str], c: float | None = None) -> DataFrame:
    """How near a linear or logistic fit is to the optimum of its loss, by feature.

    One aggregate over the training rows: ``rows``, ``positives``, the loss's ``slope``
    by the feature's weight, and ``size``, the sum of the amounts that cancel out in it.
    ``c`` is the inverse L2 penalty, which the intercept does not have.
    """
    logistic = "probability" in (f.name for f in model.transform(rows.limit(0)).schema)
    fitted = vector_to_array("probability")[1] if logistic else F.col("prediction")
    row = F.array_append(vector_to_array("features"), F.lit(1.0))
    cells = model.transform(rows).select("churn", (fitted - F.col("churn")).alias("gap"), F.posexplode(row).alias("at", "x"))
    pull = F.col("x") * F.col("gap")
    sums = cells.groupBy("at").agg(
        F.count("*").alias("rows"), F.sum("churn").cast("long").alias("positives"), F.sum(pull).alias("slope"), F.sum(F.abs(pull)).alias("size")
    )
    weights = [0.0 if c is None else float(w) / c for w in model.coefficients] + [0.0]
    given = rows.sparkSession.createDataFrame(list(zip(range(len(weights)), [*names, "intercept"], weights)), "at int, feature string, penalty double")
    return given.join(sums, "at").select(
        "feature", "rows", "positives", (F.col("slope") + F.col("penalty")).alias("slope"), (F.col("size") + F.abs("penalty")).alias("size")
    )


@dataclass(frozen=True)
class GridResult:
    """``table`` (max_depth, max_features, accuracy, is_best) and the fitted best ``model``."""

    table: DataFrame
    model: Model


def with_folds(rows: DataFrame, folds: int, key: str = "subid") -> DataFrame:
    """Add ``fold``, dealt in turn to the keys of each label, in order of a draw from the key.

    A label's keys are numbered in slices of about ``FOLD_KEYS``, one task each, so
    folds differ by at most one key a slice. Rows of one key and label share a fold.
    """
    slices = 1 + rows.count() // FOLD_KEYS
    order = Window.partitionBy("churn", F.pmod(F.xxhash64(key), F.lit(slices))).orderBy(u01(key, "fold"), key)
    return rows.withColumn("fold", F.pmod(F.dense_rank().over(order), F.lit(folds)).cast("int"))


def grid_search(
    data: ModelData,
    estimator: RandomForestClassifier,
    depths: Sequence[int],
    features: Sequence[int],
    folds: int = 10,
    parallelism: int = 16,
    key: str = "subid",
) -> GridResult:
    """Cross-validated accuracy of each (max_depth, max_features), and the best setting's model.

    Folds are stratified by label and stored. A fold and number of features has one fit,
    of the greatest depth: its nodes keep their label counts, so the smaller depths are
    cuts of its trees, and one aggregate over the rows left out, by the leaves that the
    fit finds for them, scores all. Up to ``parallelism`` fits run at a time, see
    :func:`at_once`. The best setting is fitted on all training rows.
    """
    width = len(data.features)
    depths, tried = list(depths), [_subset(f, width) for f in features]
    stored = materialize(with_folds(data.train, folds, key), "folds", ["fold"]).withMetadata("churn", _TWO_CLASSES)

    def shares_right(job: tuple[str, int]) -> tuple[float, ...] | None:
        subset, fold = job
        deepest = estimator.copy({estimator.maxDepth: max(depths), estimator.featureSubsetStrategy: subset})
        model = deepest.fit(stored.where(F.col("fold") != fold)).setLeafCol("leaf")
        held = model.transform(stored.where(F.col("fold") == fold)).select("churn", vector_to_array("leaf").alias("leaf"))
        labels = labels_of_leaves(node_tables(model), "leaf", depths)
        right = [F.avg((labels[d] == F.col("churn")).cast("double")).alias(f"right_{d}") for d in depths]
        found = held.agg(*right).first()
        return None if found[0] is None else tuple(found)

    jobs = [(subset, fold) for subset in tried for fold in range(folds)]
    results = in_threads(stored, shares_right, jobs, parallelism)
    scores = {}
    for at, subset in enumerate(tried):
        known = [r for r in results[at * folds : (at + 1) * folds] if r is not None]
        for k, depth in enumerate(depths):
            scores[depth, at] = sum(r[k] for r in known) / len(known)
    settings = [(depth, at) for depth in depths for at in range(len(tried))]
    best = max(settings, key=scores.__getitem__)  # the first of equal ones
    rows = [(depth, tried[at], scores[depth, at], (depth, at) == best) for depth, at in settings]
    table = data.table.sparkSession.createDataFrame(rows, "max_depth int, max_features string, accuracy double, is_best boolean")
    chosen = {estimator.maxDepth: best[0], estimator.featureSubsetStrategy: tried[best[1]]}
    return GridResult(table, estimator.copy(chosen).fit(data.train))


def grid_tree(data: ModelData, folds: int = 10, parallelism: int = 16) -> GridResult:
    """Depth 2-6 by 6, 8, 10, 12 features of a Gini tree with 30 rows in a leaf."""
    tree = RandomForestClassifier(
        **_IO, numTrees=1, bootstrap=False, minInstancesPerNode=30, seed=0
    )
    return grid_search(data, tree, range(2, 7), (6, 8, 10, 12), folds, parallelism)


def grid_forest(data: ModelData, folds: int = 10, parallelism: int = 16) -> GridResult:
    """Depth 4-8 by 6, 8, 10, 12 features of a forest of 10 Gini trees."""
    forest = RandomForestClassifier(**_IO, numTrees=10, seed=0)
    return grid_search(data, forest, range(4, 9), (6, 8, 10, 12), folds, parallelism)
