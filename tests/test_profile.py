"""Null rules, counts, shares, correlations and p-values on hand-made tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subtide.operators import profile
from tests.conftest import rows


@pytest.fixture
def people(spark):
    data = [("a", 1, 1.0), ("a", None, 2.0), (None, 3, 4.0), ("b", 4, None)]
    return spark.createDataFrame(data, "kind string, n int, x double")


def test_null_operators(people):
    assert rows(profile.drop_any_null(people)) == [("a", 1, 1.0)]
    assert rows(profile.null_profile(people)) == [("kind", 1), ("n", 1), ("x", 1)]
    assert rows(profile.null_profile(people, ["n"])) == [("n", 1)]
    assert rows(profile.null_rate(people, "kind")) == [(0.25,)]


def test_counts_skip_null(people):
    assert rows(profile.distinct_count(people, "kind")) == [(2,)]
    assert rows(profile.distinct_count(people, "kind", approx=True)) == [(2,)]
    assert rows(profile.row_count(people)) == [(4,)]
    assert rows(profile.min_max(people, "n")) == [(1, 4)]
    assert rows(profile.value_counts(people, "kind")) == [("a", 2), ("b", 1)]
    assert rows(profile.mean(people, "x")) == [(7 / 3,)]


def test_shares_sum_to_one(people):
    shares = dict(rows(profile.value_shares(people, "kind")))
    assert shares == {"a": 2 / 3, "b": 1 / 3}


def test_group_counts_drop_null_keys(people):
    assert rows(profile.group_nonnull_counts(people, ["kind"])) == [("a", 1, 2), ("b", 1, 0)]


def test_pivot_mean(spark):
    df = spark.createDataFrame(
        [("e", 2019, 7, 1.0), ("e", 2019, 7, 3.0), ("f", 2020, 1, 5.0)],
        "attribution string, year int, month int, spend double",
    )
    wide = profile.pivot_mean(df, "attribution", {"spend": "s"}, [(2019, 7), (2020, 1)])
    assert wide.columns == ["attribution", "s_2019_07", "s_2020_01"]
    assert rows(wide) == [("e", 2.0, None), ("f", None, 5.0)]


def test_pivot_months_come_from_the_table(spark):
    df = spark.createDataFrame([("e", 2031, 2, 1.0), ("f", 1990, 12, 5.0)], "attribution string, year int, month int, spend double")
    assert profile.pivot_mean(df, "attribution", {"spend": "s"}).columns == ["attribution", "s_1990_12", "s_2031_02"]


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, None)], "`x y` double, k string")
    assert rows(profile.null_profile(df)) == [("k", 1), ("x y", 2)]
    assert profile.null_rate(df, "x y").first()[0] == 2 / 3
    assert profile.drop_any_null(df).count() == 1
    assert rows(profile.group_nonnull_counts(df, ["k"])) == [("a", 1), ("b", 0)]


def test_pearson_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    data = np.column_stack([x, x + rng.normal(size=200), rng.normal(size=200)])
    table = [tuple(map(float, r)) for r in data] + [(None, 100.0, -100.0)]
    df = spark.createDataFrame(table, "a double, b double, c double")
    found = {(r.col_a, r.col_b): r for r in profile.pearson_pairs(df, "abc", p_values=True).collect()}
    want = np.corrcoef(data, rowvar=False)
    assert len(found) == 6
    for i, a in enumerate("abc"):
        for j, b in enumerate("abc"):
            if a != b:
                row = found[a, b]
                assert row.n == 200
                assert row.r == pytest.approx(want[i, j], abs=1e-12)
                assert row.r == found[b, a].r and row.p_value == found[b, a].p_value
                assert abs(row.r) <= 1 and 0 <= row.p_value <= 1


def student_two_sided(spark, t, df):
    """P(|T| > t), by way of the r that has this t."""
    row = spark.range(1).select(profile.two_sided_p(F.lit(t / math.sqrt(df + t * t)), F.lit(int(df) + 2)).alias("p"))
    return row.first().p


# Table values of Student's t: (t, degrees of freedom, two-sided p).
@pytest.mark.parametrize(
    "t, df, p",
    [(12.7062, 1, 0.05), (2.2281, 10, 0.05), (3.1693, 10, 0.01), (1.9840, 100, 0.05), (1.9600, 10**9, 0.05)],
)
def test_student_table(spark, t, df, p):
    assert student_two_sided(spark, t, df) == pytest.approx(p, rel=2e-4)


@pytest.mark.parametrize("t", [0.1, 0.9, 2.0, 5.0, 9.0])
def test_student_by_integration(spark, t):
    df, grid = 7, np.linspace(0, t, 200_001)
    density = (1 + grid**2 / df) ** (-(df + 1) / 2)
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    inside = 2 * scale * float(np.trapezoid(density, grid))
    assert student_two_sided(spark, t, df) == pytest.approx(1 - inside, abs=1e-9)


def test_student_is_smooth_in_its_degrees_of_freedom(spark):
    below, above = (student_two_sided(spark, 3.0, df) for df in (1e5, 1e5 + 1))
    assert below == pytest.approx(above, rel=1e-7)


def test_student_with_one_and_two_degrees_of_freedom(spark):
    """Closed forms, also far out in the tail."""
    for t in (0.0, 1e-3, 0.3, 1.0, 7.0, 1e3):
        assert student_two_sided(spark, t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t) if t < 10 else 2 / math.pi * math.atan(1 / t), rel=1e-6)
        tail = 2 / ((2 + t * t) * (1 + t / math.sqrt(2 + t * t)))
        assert student_two_sided(spark, t, 2) == pytest.approx(tail, rel=1e-6)


def test_student_tends_to_the_normal_tail(spark):
    for t in (0.5, 3.0, 8.0):
        assert student_two_sided(spark, t, 10**12) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-8)


def test_p_value_of_perfect_and_short_columns(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(10)], "a double, b double")
    assert profile.pearson_pairs(line, "ab", p_values=True).first().p_value == pytest.approx(0, abs=1e-12)
    short = line.limit(2)
    assert profile.pearson_pairs(short, "ab", p_values=True).first().p_value is None
