"""Fits side by side, and scores that need no condition for each node of a tree."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from subtide.operators import ensembles, models
from subtide.sources import materialize, scope, shared_folder


@pytest.fixture(scope="module")
def data(feature_table):
    return models.prepare(feature_table)


@pytest.mark.parametrize("trees", [1, 5])
def test_labels_of_leaves_equal_those_of_conditions(data, trees):
    forest = models.random_forest(len(data.features)).copy().setMaxDepth(7).setNumTrees(trees).setMinInstancesPerNode(3)
    model = forest.fit(data.train).setLeafCol("leaf")
    nodes, depths = ensembles.node_tables(model), [0, 1, 4, 7]
    cells = [f"x[{i}]" for i in range(len(data.features))]
    of_leaves = ensembles.labels_of_leaves(nodes, "leaf", depths)
    of_nodes = ensembles.labels_by_depth(nodes, cells, depths)
    rows = model.transform(data.test).select("prediction", vector_to_array("leaf").alias("leaf"), vector_to_array("features").alias("x"))
    found = rows.select("prediction", *[of_leaves[d].alias(f"a{d}") for d in depths], *[of_nodes[d].alias(f"b{d}") for d in depths])
    for r in found.collect():
        assert [r[f"a{d}"] for d in depths] == [r[f"b{d}"] for d in depths]
        assert r.a7 == r.prediction
    plan = rows.select(*[c.alias(f"a{d}") for d, c in of_leaves.items()])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get(") <= trees * len(depths) and "if (" not in plan


def test_fits_at_once_follow_the_parts(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(1000)
    assert models.at_once(rows.repartition(1), 100) == 2 + 4 * cores
    assert models.at_once(rows.repartition(1), 3) == 3
    assert models.at_once(rows.repartition(4 * cores + 1), 100) == 2


def test_fits_run_side_by_side_in_the_callers_scope(spark, data, monkeypatch):
    both = threading.Barrier(2, timeout=60)  # breaks if one fit waits for the other
    monkeypatch.setattr(models, "fit", lambda data, kind: both.wait() and None)
    folder = f"{shared_folder(spark)}/subtide"
    before = set(os.listdir(folder))
    with scope(spark):
        stored = models.for_each_fit(data, ("tree", "gbt"), lambda kind, model: materialize(spark.range(1).select(F.lit(kind)), kind))
        assert [df.first()[0] for df in stored] == ["tree", "gbt"]
        assert len(set(os.listdir(folder)) - before) == 2
    assert set(os.listdir(folder)) == before


def test_ensembles_are_compared_in_one_pass(inputs):
    from subtide.plans import BUILDERS

    found = BUILDERS["compiled_ensembles"](inputs)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    rows = found.collect()
    assert {(r.model, r.split) for r in rows} == {(m, s) for m in ("tree", "forest", "gbt") for s in ("train", "test")}
    assert all(r.is_same_score and r.is_same_label for r in rows)
