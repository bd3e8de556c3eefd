"""Evaluation of 0/1 predictions and scores.

All inputs hold an actual label in ``y_actual`` and a score in ``y_pred`` (or a
0/1 prediction) unless other column names are given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subtide.functions import ratio
from subtide.operators.ordering import in_ranges

CELLS = ("tn", "fp", "fn", "tp")


def threshold_predict(
    scored: DataFrame, threshold: float, score: str = "y_pred", output: str = "y_label"
) -> DataFrame:
    """Add the 0/1 prediction ``score >= threshold``."""
    return scored.withColumn(output, (F.col(score) >= F.lit(threshold)).cast("int"))


def _labelled(rows: DataFrame, *labels: str) -> DataFrame:
    """The rows; one with an unknown label raises when it is read."""
    for c in labels:
        message = F.lit(f"unknown labels in {c!r}")
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(message)).otherwise(F.col(c)))
    return rows


def confusion_matrix(
    predicted: DataFrame,
    actual: str = "y_actual",
    label: str = "y_label",
    by: Sequence[str] = (),
) -> DataFrame:
    """Counts tn, fp, fn, tp, as one row, or one for each group ``by``. An unknown label raises."""
    cells = [(0, 0), (0, 1), (1, 0), (1, 1)]
    return _labelled(predicted, actual, label).groupBy(*by).agg(
        *[
            F.count_if((F.col(actual) == a) & (F.col(label) == p)).alias(name)
            for name, (a, p) in zip(CELLS, cells)
        ]
    )


def _cells() -> list[Column]:
    return [F.col(c) for c in CELLS]


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _f1(hits: Column, misses: Column) -> Column:
    return _or_zero(ratio(2 * hits, 2 * hits + misses))


def accuracy(predicted: DataFrame, actual: str = "y_actual", label: str = "y_label") -> DataFrame:
    """Share of right predictions, as one row."""
    right = (F.col(actual) == F.col(label)).cast("double")
    return _labelled(predicted, actual, label).agg(F.avg(right).alias("accuracy"))


def f1_binary(predicted: DataFrame, actual: str = "y_actual", label: str = "y_label") -> DataFrame:
    """F1 score of class 1, as one row; 0 where it is undefined."""
    tn, fp, fn, tp = _cells()
    return confusion_matrix(predicted, actual, label).select(_f1(tp, fp + fn).alias("f1"))


def r2(
    scored: DataFrame, actual: str = "y_actual", score: str = "y_pred", by: Sequence[str] = ()
) -> DataFrame:
    """Coefficient of determination, as one row (or one for each group); null for a constant label."""
    gap = F.col(actual) - F.col(score)
    error = ratio(F.avg(gap * gap), F.var_pop(actual))
    return _labelled(scored, actual, score).groupBy(*by).agg((1 - error).alias("r2"))


def classification_report(
    predicted: DataFrame, actual: str = "y_actual", label: str = "y_label"
) -> DataFrame:
    """Precision, recall, F1 and support by class, with macro and weighted means.

    Undefined ratios are 0. The accuracy row carries its value in ``f1_score``.
    """
    tn, fp, fn, tp = _cells()
    total = tn + fp + fn + tp
    zero = {"hits": tn, "predicted": tn + fn, "support": tn + fp}
    one = {"hits": tp, "predicted": tp + fp, "support": fn + tp}
    scores = []
    for side in (zero, one):
        scores.append(
            (
                _or_zero(ratio(side["hits"], side["predicted"])),
                _or_zero(ratio(side["hits"], side["support"])),
                _f1(side["hits"], fp + fn),
                side["support"],
            )
        )

    def row(name: str, *values: Column) -> Column:
        fields = ("precision", "recall", "f1_score", "support")
        return F.struct(
            F.lit(name).alias("class"), *[v.alias(f) for v, f in zip(values, fields)]
        )

    pairs = list(zip(*scores))
    n0, n1 = pairs[3]
    macro = [(a + b) / 2 for a, b in pairs[:3]]
    weighted = [_or_zero(ratio(a * n0 + b * n1, total)) for a, b in pairs[:3]]
    unknown = F.lit(None).cast("double")
    rows = [
        row("0", *scores[0]),
        row("1", *scores[1]),
        row("accuracy", unknown, unknown, _or_zero(ratio(tn + tp, total)), total),
        row("macro avg", *macro, total),
        row("weighted avg", *weighted, total),
    ]
    return confusion_matrix(predicted, actual, label).select(F.inline(F.array(*rows)))


def score_counts(scored: DataFrame, actual: str = "y_actual", score: str = "y_pred") -> DataFrame:
    """Positives and negatives at each distinct score."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.count_if(F.col(actual) == 1).alias("pos"),
        F.count_if(F.col(actual) == 0).alias("neg"),
    )


def _cumulative_counts(
    scored: DataFrame, actual: str, score: str, buckets: int | None
) -> tuple[DataFrame, int, int, float | None]:
    """Distinct scores with the counts at and above them, class totals, highest score.

    A running sum over all scores would put them into one task. Instead the counts
    are dealt to ranges of scores as they are written, once; each range gets a running
    sum of its own, and what lies above the range is joined from the range totals. The
    plan is the same for any number of ranges. The driver reads a row for each range,
    as many as there are shuffle partitions.
    """
    counts = score_counts(_labelled(scored, actual), actual, score)
    ranged = in_ranges(counts, ["score"], "scores", buckets)
    is_nan = F.isnan(F.col("score").cast("double"))
    totals = ranged.groupBy("_part").agg(
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
        F.max_by(F.struct("score", "pos", "neg"), "score").alias("top"),
        F.count_if(F.col("score").isNull()).alias("nulls"),
        F.count_if(is_nan).alias("nans"),
    )
    # One row for each range, from the highest down: counts above it; then the highest
    # score below it, which its last row needs to look ahead.
    found = sorted(totals.collect(), key=lambda r: -r["_part"])
    for kind in ("null", "nan"):
        if any(r[f"{kind}s"] for r in found):
            raise ValueError(f"{'NaN' if kind == 'nan' else kind} scores in {score!r}")
    tp = fp = 0
    rows = []
    for r, lower in zip(found, [*found[1:], None]):
        top = lower["top"] if lower else None
        rows.append((r["_part"], tp, fp, top and top["pos"], top and top["neg"]))
        tp, fp = tp + r["pos"], fp + r["neg"]
    highest = found[0]["top"]["score"] if found else None
    schema = "_part int, tps_above long, fps_above long, pos_below long, neg_below long"
    base = F.broadcast(scored.sparkSession.createDataFrame(rows, schema))
    order = Window.partitionBy("_part").orderBy(F.col("score").desc())
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select(
        "_part",
        "score",
        "pos",
        "neg",
        F.sum("pos").over(running).alias("tps"),
        F.sum("neg").over(running).alias("fps"),
        F.lead("pos").over(order).alias("next_pos"),
        F.lead("neg").over(order).alias("next_neg"),
    )
    points = summed.join(base, "_part").select(
        "score",
        "pos",
        "neg",
        (F.col("tps") + F.col("tps_above")).alias("tps"),
        (F.col("fps") + F.col("fps_above")).alias("fps"),
        F.coalesce("next_pos", "pos_below").alias("next_pos"),
        F.coalesce("next_neg", "neg_below").alias("next_neg"),
    )
    return points, tp, fp, highest


def roc_curve(
    scored: DataFrame,
    actual: str = "y_actual",
    score: str = "y_pred",
    drop_intermediate: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """ROC points (threshold, fpr, tpr): one for each distinct score and the origin.

    The origin's threshold is the highest score plus one. ``drop_intermediate``
    leaves out points on a straight line between two others.
    """
    points, positives, negatives, highest = _cumulative_counts(scored, actual, score, buckets)
    if drop_intermediate:
        is_first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
        is_last = F.col("next_pos").isNull()
        turns = (F.col("pos") != F.col("next_pos")) | (F.col("neg") != F.col("next_neg"))
        points = points.where(is_first | is_last | turns)
    curve = points.select(
        F.col("score").alias("threshold"),
        ratio(F.col("fps"), F.lit(negatives)).alias("fpr"),
        ratio(F.col("tps"), F.lit(positives)).alias("tpr"),
    )
    origin = scored.sparkSession.range(1).select(
        (F.lit(highest).cast("double") + 1).alias("threshold"),
        F.lit(0.0).alias("fpr"),
        F.lit(0.0).alias("tpr"),
    )
    return curve.unionByName(origin)


def auc_score(
    scored: DataFrame,
    actual: str = "y_actual",
    score: str = "y_pred",
    buckets: int | None = None,
) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, as one row.

    Twice the area is summed in whole numbers, so the order of the sum is of no
    influence; it is null if a class is missing.
    """
    points, positives, negatives, _ = _cumulative_counts(scored, actual, score, buckets)
    wide = "decimal(19,0)"
    strip = F.col("neg").cast(wide) * (2 * F.col("tps") - F.col("pos")).cast(wide)
    area = F.sum(strip).cast("double")
    box = F.lit(2.0 * positives * negatives)
    return points.agg(ratio(area, box).alias("auc"))


def auc_hard_label(
    predicted: DataFrame, actual: str = "y_actual", label: str = "y_label"
) -> DataFrame:
    """Area under the two-segment curve of a 0/1 prediction, as one row."""
    tn, fp, fn, tp = _cells()
    area = (ratio(tp, tp + fn) + 1 - ratio(fp, fp + tn)) / 2
    return confusion_matrix(predicted, actual, label).select(area.alias("auc"))
