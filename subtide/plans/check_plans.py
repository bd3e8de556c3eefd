"""Queries that state what is certain about fitted models, so that SQL can confirm it.

A fit's numbers have no SQL form, but much of what it returns has one answer: rows,
keys and labels by split, names of features, what an optimum or a leaf must fulfil.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.operators import clv, ensembles, metrics, models, profile
from subtide.operators.churn import MEASURES as OWN_MEASURES
from subtide.plans.channel_plans import technical_cac
from subtide.plans.churn_plans import features
from subtide.plans.inputs import Inputs
from subtide.plans.oracle import MEASURES, u01
from subtide.plans.registry import query

# The features of the sample tables, as the statements list them.
_FEATURES = [
    *[f"{m}_trial" for m in MEASURES],
    *[f"{m}_sum_daily" for m in MEASURES],
    "discount_price",
    "package_type_enhanced",
    "package_type_no_package",
    "preferred_genre_drama",
    "preferred_genre_international",
    "preferred_genre_other",
    "preferred_genre_regional",
    "intended_use_education",
    "intended_use_expand_international_access",
    "intended_use_expand_regional_access",
    "intended_use_other",
    "intended_use_replace_ott",
    "intended_use_supplement_ott",
    "male_tf_true",
    "op_sys_ios",
    "plan_type_high_uae_14_day_trial",
    "plan_type_low_uae_no_trial",
    "payment_type_standard_charter",
]
_SPLIT = f"CASE WHEN {u01('subid', 'split')} < CAST(0.7 AS DOUBLE) THEN 'train' ELSE 'test' END"


def _named(names: list[str], column: str) -> str:
    return f"SELECT unnest({names!r}) AS feature, true AS {column}"


@query("ols_optimum", _named(["intercept", *_FEATURES], "is_optimal"))
def ols_optimum(t: Inputs) -> DataFrame:
    """At the least squares the residuals are orthogonal to every feature and sum to 0."""
    data = models.prepare(features(t))
    fitted = models.fit(data, "ols").transform(data.train)
    row = F.array_append(vector_to_array("features"), F.lit(1.0))
    gap = (F.col("churn") - F.col("prediction")).alias("gap")
    cells = fitted.select(gap, F.posexplode(row).alias("at", "x"))
    sums = cells.groupBy("at").agg(
        F.sum(F.col("x") * F.col("gap")).alias("slope"), F.sum(F.abs(F.col("x") * F.col("gap"))).alias("size")
    )
    names = t.spark.createDataFrame(list(enumerate([*data.features, "intercept"])), "at int, feature string")
    is_zero = F.abs("slope") <= F.lit(1e-7) * F.col("size")
    return names.join(sums, "at").select("feature", is_zero.alias("is_optimal"))


@query(
    "logistic_optimum",
    f"SELECT unnest({['intercept', *_FEATURES]!r}) AS feature, rows, positives, true AS is_optimal FROM "
    f"(SELECT count(*) AS rows, CAST(sum(churn) AS BIGINT) AS positives FROM (SELECT churn, {_SPLIT} AS split FROM features) WHERE split = 'train')",
)
def logistic_optimum(t: Inputs) -> DataFrame:
    """At the optimum of the penalised likelihood its slope by every weight is zero."""
    data = models.prepare(features(t))
    found = models.optimum(models.fit(data, "logistic"), data.train, data.features, c=100.0)
    is_zero = F.abs("slope") <= F.lit(1e-6) * F.col("size")
    return found.select("feature", "rows", "positives", is_zero.alias("is_optimal"))


@query(
    "compiled_ensembles",
    f"SELECT model, split, count(*) AS rows, CAST(sum(churn) AS BIGINT) AS positives, true AS is_same_score, true AS is_same_label "
    f"FROM (SELECT churn, {_SPLIT} AS split FROM features), (SELECT unnest(['tree', 'forest', 'gbt']) AS model) GROUP BY model, split",
)
def compiled_ensembles(t: Inputs) -> DataFrame:
    """Trees as conditions on plain columns score every row as the fitted ensemble does."""
    data = models.prepare(features(t))
    vectors = VectorAssembler(inputCols=data.features, outputCol="features").transform(data.encoded)

    kinds = ("tree", "forest", "gbt")
    both, cells = vectors, []
    for kind, model in zip(kinds, models.for_each_fit(data, kinds, lambda kind, model: model)):
        probability, label = ensembles.compiled_score(model, ensembles.quoted_names(data.features))
        names = {c: f"_{c}_{kind}" for c in ("raw", "probability", "prediction")}
        model.setRawPredictionCol(names["raw"]).setProbabilityCol(names["probability"]).setPredictionCol(names["prediction"])
        both = model.transform(both)
        same_score = F.abs(probability - vector_to_array(names["probability"])[1]) < 1e-9
        cells.append((kind, same_score, label == F.col(names["prediction"])))
    # One pass over the rows compares all models; its one row a split becomes a row a model.
    marked = both.select("is_train", "churn", *[c.alias(f"{name}_{kind}") for kind, *pair in cells for name, c in zip(("score", "label"), pair)])
    counts = marked.groupBy(F.expr("if(is_train, 'train', 'test')").alias("split")).agg(
        F.count("*").alias("rows"),
        F.sum("churn").cast("long").alias("positives"),
        *[F.every(f"{name}_{kind}").alias(f"{name}_{kind}") for kind in kinds for name in ("score", "label")],
    )
    by_model = [
        F.struct(F.lit(kind).alias("model"), F.col(f"score_{kind}").alias("is_same_score"), F.col(f"label_{kind}").alias("is_same_label"))
        for kind in kinds
    ]
    return counts.select("split", "rows", "positives", F.inline(F.array(*by_model))).select(
        "split", "rows", "positives", "is_same_score", "is_same_label", "model"
    )


@query("tree_importance_names", _named(_FEATURES, "is_share"))
def tree_importance_names(t: Inputs) -> DataFrame:
    """Importances have the features' names, lie between 0 and 1 and sum to 1."""
    data = models.prepare(features(t))
    found = models.importances(t.spark, models.fit(data, "tree"), data.features)
    total = F.abs(found.agg(F.sum("importance")).scalar() - 1) < 1e-9
    return found.select("feature", (F.col("importance").between(0, 1) & total).alias("is_share"))


@query(
    "tree_leaf_means",
    f"SELECT count(*) AS rows, CAST(sum(churn) AS BIGINT) AS positives, true AS leaves_are_means "
    f"FROM (SELECT churn, {_SPLIT} AS split FROM features) WHERE split = 'train'",
)
def tree_leaf_means(t: Inputs) -> DataFrame:
    """A leaf's probability is the mean label of the training rows in it."""
    data = models.prepare(features(t))
    scored = models.score(models.fit(data, "tree"), data.train)
    leaves = scored.groupBy("y_pred").agg(F.count("*").alias("n"), F.sum("y_actual").alias("pos"))
    is_mean = F.abs(F.col("pos") / F.col("n") - F.col("y_pred")) < 1e-9
    return leaves.agg(
        F.sum("n").alias("rows"), F.sum("pos").alias("positives"), F.every(is_mean).alias("leaves_are_means")
    )


@query(
    "fit_tree_rows",
    f"SELECT split, count(*) AS rows, CAST(sum(churn) AS BIGINT) AS positives "
    f"FROM (SELECT churn, {_SPLIT} AS split FROM features) GROUP BY split",
)
def fit_tree_rows(t: Inputs) -> DataFrame:
    """The report counts every row of a split once, under its own label."""
    data = models.prepare(features(t))
    report = models.fit_report(models.fit(data, "tree"), data)
    return report.selectExpr("split", "tn + fp + fn + tp AS rows", "fn + tp AS positives")


@query("scored_test_rows", "SELECT subid, y_actual, true AS is_probability FROM scored")
def scored_test_rows(t: Inputs) -> DataFrame:
    """Each test row has one score, a probability, next to its own label."""
    data = models.prepare(features(t))
    scored = models.score(models.fit(data, "tree"), data.test)
    return scored.select("subid", "y_actual", F.col("y_pred").between(0, 1).alias("is_probability"))


@query(
    "tree_roc_shape",
    "SELECT true AS from_origin, true AS to_corner, true AS rises, true AS area_is_known",
)
def tree_roc_shape(t: Inputs) -> DataFrame:
    """The curve runs from (0, 0) to (1, 1) without falling; its area is that of Spark's own evaluator."""
    data = models.prepare(features(t))
    scored = models.score(models.fit(data, "tree"), data.test)
    ranks = F.struct("fpr", "tpr")
    points = metrics.roc_curve(scored)
    # Tree scores are few: at most one for each leaf.
    listed = points.agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("threshold"), ranks.alias("p")))), lambda x: x["p"]).alias("p"))
    rises = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda i: (F.get("p", i)["fpr"] >= F.get("p", i - 1)["fpr"]) & (F.get("p", i)["tpr"] >= F.get("p", i - 1)["tpr"]))
    area = BinaryClassificationEvaluator(rawPredictionCol="y_pred", labelCol="y_actual").evaluate(scored)
    return listed.select(
        (F.get("p", F.lit(0)) == F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))).alias("from_origin"),
        (F.get("p", F.size("p") - 1) == F.struct(F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr"))).alias("to_corner"),
        rises.alias("rises"),
        (F.abs(metrics.auc_score(scored).scalar() - area) < 1e-6).alias("area_is_known"),
    )


@query(
    "clv_of_tree_score_rows",
    "SELECT s.subid, s.y_actual, c.month, c.year, c.attribution, c.join_fee, c.cac_filled, true AS follows_formula "
    "FROM scored s JOIN sub_cac c ON s.subid = c.subid",
)
def clv_of_tree_score_rows(t: Inputs) -> DataFrame:
    """Every scored row keeps its own costs; the value follows from them and the score."""
    data = models.prepare(features(t))
    scored = models.score(models.fit(data, "tree"), data.test, clv.COST_COLUMNS)
    valued = clv.clv(clv.with_costs(scored, technical_cac(t)))
    price = 4 * F.col("discount_price")
    direct = price * 1.03 / (0.03 + F.col("y_pred")) + price + F.col("join_fee") - F.col("cac_filled")
    follows = F.abs(direct - F.col("clv_with_cac")) <= 1e-9 * F.abs(direct)
    kept = ["subid", "y_actual", "month", "year", "attribution", "join_fee", "cac_filled"]
    return valued.select(*kept, follows.alias("follows_formula"))


@query(
    "pearson_p_rows",
    "SELECT a.m AS col_a, b.m AS col_b, (SELECT count(*) FROM engagement WHERE "
    + " AND ".join(f"{m} IS NOT NULL" for m in MEASURES)
    + f") AS n, true AS is_probability FROM (SELECT unnest({list(MEASURES)!r}) AS m) a, "
    f"(SELECT unnest({list(MEASURES)!r}) AS m) b WHERE a.m <> b.m",
)
def pearson_p_rows(t: Inputs) -> DataFrame:
    found = profile.pearson_pairs(t.engagement, OWN_MEASURES, p_values=True)
    return found.select("col_a", "col_b", "n", F.col("p_value").between(0, 1).alias("is_probability"))


_COMPLETE = " AND ".join(f"{m} IS NOT NULL" for m in MEASURES)


def _p_by_series() -> str:
    """The finite series of Student's t for whole degrees of freedom, summed term by term."""
    rows = f"(SELECT * FROM engagement WHERE {_COMPLETE})"
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, count(*) AS n, corr({a}, {b}) AS r FROM {rows}" for a in MEASURES for b in MEASURES if a != b
    )
    known = f"SELECT col_a, col_b, n, n - 2 AS df, abs(r) AS y, ln(1 - r * r) / 2 AS lx FROM ({pairs})"
    even = "exp(lgamma(k + 0.5) - lgamma(k + 1) - ln(pi()) / 2 + 2 * k * lx)"
    odd = "exp(lgamma(k + 1) + ln(pi()) / 2 - ln(2) - lgamma(k + 1.5) + (2 * k + 1) * lx)"
    sums = f"SELECT col_a, col_b, n, df, y, sum(CASE WHEN df % 2 = 0 THEN {even} ELSE {odd} END) AS total FROM ({known}), unnest(range(0, df // 2)) AS u(k) GROUP BY ALL"
    inside = "CASE WHEN df % 2 = 0 THEN y * total ELSE 2 / pi() * (asin(y) + y * total) END"
    return f"SELECT col_a, col_b, n, round(greatest(0, 1 - {inside}), 8) AS p FROM ({sums})"


@query("pearson_p", _p_by_series())
def pearson_p(t: Inputs) -> DataFrame:
    """The p-value of each pair, to eight digits."""
    found = profile.pearson_pairs(t.engagement, OWN_MEASURES, p_values=True)
    return found.select("col_a", "col_b", "n", (F.round("p_value", 8) + F.lit(0.0)).alias("p"))
