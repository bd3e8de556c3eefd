"""Model fits: exact against numpy where a solution is unique, else by quality."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from subtide.operators import ensembles, metrics, models
from tests.conftest import rows


@pytest.fixture(scope="module")
def data(feature_table):
    return models.prepare(feature_table)


@pytest.fixture(scope="module")
def matrix(data):
    """Training features and labels as arrays; a test-sized sample only."""
    pdf = data.train.select(vector_to_array("features").alias("x"), "churn").toPandas()
    return np.stack(pdf["x"]), pdf["churn"].to_numpy()


def _check_scores(model, data):
    scored = models.score(model, data.test)
    assert scored.columns == ["subid", "y_actual", "y_pred", "y_label"]
    assert scored.count() == data.test.count()
    low, high = scored.agg(F.min("y_pred"), F.max("y_pred")).first()
    assert 0 <= low <= high <= 1
    assert metrics.auc_score(scored).first().auc > 0.6
    return scored


def test_prepare(data, feature_table):
    assert "discount_price" in data.features and "male_tf_true" in data.features
    assert not {"subid", "churn", "join_fee", "monthly_price", "year", "month"} & set(data.features)
    assert data.train.count() + data.test.count() == feature_table.count()
    assert data.train.join(data.test, "subid").isEmpty()


def test_tree(spark, data):
    model = models.fit(data, "tree")
    assert model.getNumTrees == 1 and model.trees[0].depth <= 6
    scored = _check_scores(model, data)
    report = {r.split: r for r in models.fit_report(model, data).collect()}
    assert report["test"].accuracy == pytest.approx(metrics.accuracy(scored).first()[0])
    assert sum(report["train"][3:]) == data.train.count()
    weights = models.importances(spark, model, data.features)
    assert weights.count() == len(data.features)
    assert weights.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    best = weights.orderBy(F.desc("importance")).first()
    assert best.feature == "discount_price"
    again = models.score(models.fit(data, "tree"), data.test)
    assert rows(again) == rows(scored)


def test_forest_and_boosting(data):
    for kind in ("forest", "gbt"):
        _check_scores(models.fit(data, kind), data)


def test_logistic_against_newton(spark, data, matrix):
    model = models.fit(data, "logistic")
    _check_scores(model, data)
    x, y = matrix
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.eye(x.shape[1]) / 100
    penalty[0, 0] = 0
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
    # Both minimise the same loss; compare it, as single weights settle slowly.
    def loss(v):
        z = x @ v
        return np.sum(np.logaddexp(0, z) - y * z) + 0.5 * v @ penalty @ v

    ours = np.concatenate([[model.intercept], model.coefficients.toArray()])
    assert loss(ours) == pytest.approx(loss(w), rel=1e-3)
    assert models.coefficients(spark, model, data.features).count() == len(data.features)


def test_ols_against_numpy(data, matrix):
    model = models.fit(data, "ols")
    x, y = matrix
    x = np.column_stack([np.ones(len(x)), x])
    w = np.linalg.lstsq(x, y, rcond=None)[0]
    fitted = x @ w
    r2 = 1 - np.sum((y - fitted) ** 2) / np.sum((y - y.mean()) ** 2)
    report = {r.split: r.r2 for r in models.linear_report(model, data).collect()}
    assert report["train"] == pytest.approx(r2, abs=1e-6)
    assert report["train"] == pytest.approx(model.summary.r2, abs=1e-9)


def test_grid(data):
    tree = models.decision_tree(len(data.features), seed=0)
    grid = models.grid_search(data, tree, (2, 4), (6, 99), folds=2, parallelism=4)
    assert models.score(grid.model, data.test).count() == data.test.count()
    grid = grid.table.collect()
    assert [(r.max_depth, r.max_features) for r in grid] == [(2, "6"), (2, "all"), (4, "6"), (4, "all")]
    assert sum(r.is_best for r in grid) == 1
    best = next(r for r in grid if r.is_best)
    assert best.accuracy == max(r.accuracy for r in grid) > 0.5


@pytest.mark.parametrize("kind", ["tree", "forest", "gbt"])
def test_compiled_scores(data, kind):
    model = models.fit(data, kind)
    compiled = ensembles.score_columns(model, data.encoded.where("NOT is_train"), data.features)
    scored = models.score(model, data.test)
    assert compiled.columns == scored.columns and compiled.dtypes == scored.dtypes
    plan = compiled._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "vector" not in plan
    ours, theirs = ({r.subid: r for r in df.collect()} for df in (compiled, scored))
    assert set(ours) == set(theirs)
    for k, r in ours.items():
        assert r.y_pred == pytest.approx(theirs[k].y_pred, abs=1e-9)
        assert (r.y_actual, r.y_label) == (theirs[k].y_actual, theirs[k].y_label)


def test_compiled_scores_of_odd_values(spark):
    """Thresholds and names that need care; unknown values go right, as larger ones do."""
    rows = [(i, float(i >= 50), i * 1e-7 - 3e-6, float(i % 3)) for i in range(100)]
    df = spark.createDataFrame(rows, "subid long, churn double, `a b.c` double, `d``e` double")
    names = ["a b.c", "d`e"]
    vectors = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df.toDF("subid", "churn", "x", "y"))
    model = models.random_forest(2).fit(vectors)
    ours = {r.subid: r.y_pred for r in ensembles.score_columns(model, df, names).collect()}
    assert ours == pytest.approx({r.subid: r.y_pred for r in models.score(model, vectors).collect()}, abs=1e-9)
    odd = spark.createDataFrame([(1, 0.0, None, 0.0), (2, 0.0, float("nan"), 0.0), (3, 0.0, 1e9, 0.0)], df.schema)
    assert len({r.y_pred for r in ensembles.score_columns(model, odd, names).collect()}) == 1


def test_cut_trees_equal_shallow_fits(data):
    """With the same draws (all features), a deep forest cut at a depth labels rows as a fit of that depth."""
    for make, trees in ((models.decision_tree, 1), (models.random_forest, 5)):
        deep = make(len(data.features)).copy().setMaxDepth(7).setNumTrees(trees).setFeatureSubsetStrategy("all").setMinInstancesPerNode(5)
        nodes = ensembles.node_tables(deep.fit(data.train))
        depths = [0, 1, 3, 5, 7]
        labels = ensembles.labels_by_depth(nodes, ensembles.quoted_names(data.features), depths)
        cut = data.encoded.where("NOT is_train").select("subid", *[c.alias(f"d{d}") for d, c in labels.items()])
        cut = {r.subid: r for r in cut.collect()}
        for d in depths:
            shallow = models.score(deep.copy().setMaxDepth(d).fit(data.train), data.test)
            assert {r.subid: r.y_label for r in shallow.collect()} == {k: r[f"d{d}"] for k, r in cut.items()}


def test_grid_accuracy_against_separate_fits(data):
    """One fit a fold gives the accuracies of a fit for each depth, if nothing is drawn."""
    tree = models.RandomForestClassifier(featuresCol="features", labelCol="churn", numTrees=1, bootstrap=False, seed=0)
    grid = models.grid_search(data, tree, (1, 2, 4), (99,), folds=3, parallelism=4).table.collect()
    folds = models.with_folds(data.train, 3).withMetadata("churn", data.train.schema["churn"].metadata)
    for r in grid:
        right = []
        for k in range(3):
            model = tree.copy().setMaxDepth(r.max_depth).setFeatureSubsetStrategy("all").fit(folds.where(F.col("fold") != k))
            scored = models.score(model, folds.where(F.col("fold") == k))
            right.append(scored.agg(F.avg((F.col("y_label") == F.col("y_actual")).cast("double"))).first()[0])
        assert r.accuracy == pytest.approx(sum(right) / 3, abs=1e-12)


def test_folds_are_even_whatever_the_slices(data, monkeypatch):
    for most in (models.FOLD_KEYS, 500):
        monkeypatch.setattr(models, "FOLD_KEYS", most)
        counts = models.with_folds(data.train, 10).groupBy("churn", "fold").count().collect()
        assert len(counts) == 20
        for label in (0, 1):
            sizes = [r["count"] for r in counts if r.churn == label]
            assert max(sizes) - min(sizes) <= 1 + data.train.count() // most


def test_logistic_optimum(data):
    fitted = models.optimum(models.fit(data, "logistic"), data.train, data.features, c=100.0).collect()
    assert all(abs(r.slope) <= 1e-6 * r.size for r in fitted)
    rough = models.logistic_regression(data.train.count()).setMaxIter(3).fit(data.train)
    assert any(abs(r.slope) > 1e-6 * r.size for r in models.optimum(rough, data.train, data.features, c=100.0).collect())


def test_unknown_model(data):
    with pytest.raises(ValueError, match="unknown model"):
        models.fit(data, "oracle")
