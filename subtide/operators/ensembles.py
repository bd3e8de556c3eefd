"""Fitted tree ensembles as column expressions.

A fitted tree, forest or boosting is a set of node tables of model size. Written as
nested conditions on feature columns, it scores rows inside code generation, without
feature vectors. The nodes also keep the label counts of every inner node, so a deep
forest holds all shallower ones: a cut at some depth, with leaves of one class merged
as the fit does it, is what a fit of that depth gives for the same draws.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subtide.sources import delete_path, scratch_path


@dataclass(frozen=True)
class Node:
    """A node of a fitted tree; a leaf has no feature. ``counts`` are those of the labels in training."""

    prediction: float
    counts: tuple[float, ...]
    feature: int | None = None
    threshold: float = 0.0
    left: int = -1
    right: int = -1


Tree = dict[int, Node]  # by node number; the root is 0


def node_tables(model: Model) -> list[Tree]:
    """The trees of a fitted ensemble, read from its saved form.

    Only continuous features are known. The driver reads model-sized data.
    """
    spark = SparkSession.builder.getOrCreate()
    path = scratch_path(spark, "model")
    try:
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").collect()
    finally:
        delete_path(spark, path)
    trees: dict[int, Tree] = {}
    for r in rows:
        counts, at = tuple(r["impurityStats"]), r["id"]
        if r["leftChild"] < 0:
            node = Node(r["prediction"], counts)
        else:
            split = r["split"]
            if split["numCategories"] >= 0:
                raise ValueError("categorical splits have no threshold")
            node = Node(r["prediction"], counts, split["featureIndex"], split["leftCategoriesOrThreshold"][0], r["leftChild"], r["rightChild"])
        trees.setdefault(r["treeID"], {})[at] = node
    return [trees[k] for k in sorted(trees)]


def _condition(tree: Tree, features: Sequence[str], leaf: Callable[[int], str], at: int = 0) -> str:
    node = tree[at]
    if node.feature is None:
        return leaf(at)
    left, right = (_condition(tree, features, leaf, child) for child in (node.left, node.right))
    return f"if({features[node.feature]} <= {node.threshold!r}D, {left}, {right})"


def quoted_names(names: Sequence[str]) -> list[str]:
    return ["`" + n.replace("`", "``") + "`" for n in names]


def _share(node: Node) -> float:
    """The share of label 1 among a node's training rows."""
    return node.counts[1] / sum(node.counts)


def _total(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def compiled_score(model: Model, features: Sequence[str]) -> tuple[Column, Column]:
    """The probability of label 1 and the predicted label, as ``model.transform`` gives them.

    ``features`` are SQL expressions of the features in the model's order, such as
    quoted column names. A null or NaN feature takes the right branch.
    """
    trees = node_tables(model)
    if isinstance(model, GBTClassificationModel):
        weights = model.treeWeights
        parts = [F.expr(_condition(t, features, lambda i, t=t, w=w: f"{t[i].prediction * w!r}D")) for t, w in zip(trees, weights)]
        margin = _total(parts)
        return 1 / (1 + F.exp(-2 * margin)), F.when(margin > 0, 1).otherwise(0)
    shares = [F.expr(_condition(t, features, lambda i, t=t: f"{_share(t[i])!r}D")) for t in trees]
    probability = _total(shares) / len(trees)
    return probability, F.when(probability > 0.5, 1).otherwise(0)


def score_columns(model: Model, rows: DataFrame, features: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """Predicted probability of churn by subscriber from plain feature columns: (subid, y_actual, y_pred, y_label)."""
    probability, label = compiled_score(model, quoted_names(features))
    return rows.select("subid", *carry, F.col("churn").cast("int").alias("y_actual"), probability.alias("y_pred"), label.alias("y_label"))


def leaves_at(tree: Tree, depth: int) -> dict[int, int]:
    """For each leaf of a tree, the node that is its leaf when the tree is cut at a depth.

    Two leaves of one node that predict the same class are merged, from below, as the
    fit itself does it.
    """
    found: dict[int, int] = {}

    def walk(at: int, level: int) -> tuple[list[int], bool]:
        """The leaves below a node, and whether the node is a leaf of the cut tree."""
        node = tree[at]
        if node.feature is None:
            found[at] = at
            return [at], True
        left, right = walk(node.left, level + 1), walk(node.right, level + 1)
        below = left[0] + right[0]
        same = left[1] and right[1] and tree[found[left[0][0]]].prediction == tree[found[right[0][0]]].prediction
        if level >= depth or same:
            found.update(dict.fromkeys(below, at))
        return below, level >= depth or same

    walk(0, 0)
    return found


def labels_by_depth(trees: Sequence[Tree], features: Sequence[str], depths: Sequence[int]) -> dict[int, Column]:
    """The label that a forest predicts when its trees are cut at each of some depths.

    A tree's leaf is found once; its share of label 1 at each depth is looked up in an
    array of the shares of that depth.
    """
    places, shares = [], {d: [] for d in depths}
    for tree in trees:
        leaves = [i for i, node in tree.items() if node.feature is None]
        number = {leaf: k for k, leaf in enumerate(leaves)}
        places.append(_condition(tree, features, lambda i, number=number: str(number[i])))
        for d in depths:
            of = leaves_at(tree, d)
            shares[d].append("array(" + ", ".join(f"{_share(tree[of[leaf]])!r}D" for leaf in leaves) + ")")
    return {
        d: F.when(_total([F.expr(f"get({s}, {p})") for s, p in zip(shares[d], places)]) > len(trees) * 0.5, 1).otherwise(0)
        for d in depths
    }


def labels_of_leaves(trees: Sequence[Tree], leaf: str, depths: Sequence[int]) -> dict[int, Column]:
    """:func:`labels_by_depth` for rows whose leaves are known, as a fitted model's ``leafCol`` gives them.

    ``leaf`` is a SQL expression of an array with each tree's leaf, numbered from left
    to right. A tree's shares at a depth are one constant, so the expression has a
    term for each tree and none for its nodes.
    """
    shares: dict[int, list[Column]] = {d: [] for d in depths}
    for t, tree in enumerate(trees):
        leaves = _leaves(tree)
        for d in depths:
            of = leaves_at(tree, d)
            known = ",".join(repr(_share(tree[of[i]])) for i in leaves)
            shares[d].append(F.expr(f"get(cast(split('{known}', ',') AS array<double>), CAST({leaf}[{t}] AS INT))"))
    return {d: F.when(_total(shares[d]) > len(trees) * 0.5, 1).otherwise(0) for d in depths}


def _leaves(tree: Tree, at: int = 0) -> list[int]:
    """The leaves of a tree from left to right."""
    node = tree[at]
    return [at] if node.feature is None else _leaves(tree, node.left) + _leaves(tree, node.right)
