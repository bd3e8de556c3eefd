"""Forms of operators whose categories, ranges or stored tables may be many."""

from __future__ import annotations

import os

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subtide.functions import u01
from subtide.operators import churn, encode, metrics, profile
from subtide.operators.ordering import in_ranges, running_sums
from subtide.sources import delete_path, load_spend_csv, materialize, scope, scratch_path, shared_folder, split_spend_csv
from tests.conftest import rows


@pytest.fixture
def no_collect(monkeypatch):
    """Fails on driver reads of over a hundred rows."""
    collect = DataFrame.collect

    def few(self):
        found = collect(self)
        assert len(found) <= 100
        return found

    monkeypatch.setattr(DataFrame, "collect", few)


# ---- running sums


def test_running_sums_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 13).alias("v"))
    for parts in (None, 1, 9):
        found = running_sums(in_ranges(df, ["k"], "test", parts), ["k"], {"n": "v", "m": "k"}).collect()
        total = other = 0
        for r in sorted(found, key=lambda r: r.k):
            total, other = total + r.v, other + r.k
            assert (r.n, r.m) == (total, other)
    assert running_sums(in_ranges(df.limit(0), ["k"], "test"), ["k"], {"n": "v"}).columns == ["k", "v", "n"]


def test_score_ranges_do_not_show_in_the_plan(spark):
    scored = spark.range(500).select((F.col("id") % 3 == 0).cast("int").alias("y_actual"), (F.col("id") % 97 / 97.0).alias("y_pred"))
    few, many = (metrics.roc_curve(scored, buckets=b) for b in (2, 64))
    assert rows(few) == rows(many)
    size = [len(df._jdf.queryExecution().optimizedPlan().toString()) for df in (few, many)]
    assert abs(size[0] - size[1]) < 100


# ---- sparse categories


def test_sparse_form_equals_the_wide_form(feature_table):
    columns = list(encode.CATEGORICAL)
    wide = encode.dummy_encode(feature_table.select("subid", "churn", *columns))
    dummies = [c for c in wide.columns if c not in ("subid", "churn")]
    sparse = encode.sparse_encode(feature_table.select("subid", "churn", *columns))
    assert sparse.columns == ["subid", "churn", "categories"]
    ours = sparse.select("subid", "churn", F.transform(vector_to_array("categories"), lambda x: x.cast("int")).alias("v"))
    theirs = wide.select("subid", "churn", F.array(*[F.col(f"`{c}`") for c in dummies]).alias("v"))
    assert rows(ours) == rows(theirs)


def test_sparse_form_of_odd_columns(spark):
    given = [(1, "b", True, None), (2, None, None, None), (2, "a", False, None), (3, "a", True, None), (4, "é", None, None)]
    df = spark.createDataFrame(given, "id long, `x y` string, flag boolean, empty string")
    names = ["x y", "flag", "empty"]
    dictionary = encode.category_dictionary(df, names)
    assert rows(dictionary) == sorted([(0, "x y", "a", None), (0, "x y", "b", 0), (0, "x y", "é", 1), (1, "flag", "false", None), (1, "flag", "true", 2)], key=repr)
    found = rows(encode.sparse_encode(df, names).select("id", vector_to_array("categories").alias("v")))
    assert found == sorted([(1, [1, 0, 1]), (2, [0, 0, 0]), (2, [0, 0, 0]), (3, [0, 0, 1]), (4, [0, 1, 0])], key=repr)
    new = spark.createDataFrame([(9, "unseen", True, "x")], df.schema)
    assert encode.sparse_encode(new, names, dictionary).select(vector_to_array("categories")).first()[0] == [0, 0, 1]
    with pytest.raises(ValueError, match="neither text nor flag"):
        encode.sparse_encode(df, ["id"])


def test_many_levels_without_a_driver_read(spark, no_collect, monkeypatch):
    n = 200_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.format_string("l%07d", F.col("id"))).alias("c"))
    dictionary = encode.category_dictionary(df, ["c"])
    levels = 1 + n - (n + 2) // 3
    assert dictionary.count() == levels
    assert dictionary.agg(F.min("at"), F.max("at"), F.count_distinct("at")).first()[:] == (0, levels - 2, levels - 1)
    found = encode.sparse_encode(df, ["c"], dictionary).select("id", F.unwrap_udt("categories").alias("v"))
    assert found.count() == n
    # "hot" comes first in order, so it is the level left out.
    assert found.where("id % 3 = 0 AND size(v.indices) > 0 OR id % 3 <> 0 AND size(v.indices) <> 1").isEmpty()
    monkeypatch.setattr(encode, "MOST_LEVELS", 50)
    with pytest.raises(ValueError, match="sparse_encode"):
        encode.category_levels(df, ["c"])


# ---- imputation by observed shares


def test_observed_draws_follow_the_slices(spark):
    df = spark.createDataFrame([(i, "abbcccdddd"[i % 10] if i < 1000 else None, i) for i in range(1500)], "subid long, `c d` string, other int")
    filled = churn.impute_categorical(df, "c d")
    assert filled.columns == df.columns and filled.count() == 1500
    draws = df.where("`c d` IS NULL").select("subid", u01("subid", "impute_c d").alias("u")).collect()
    want = {r.subid: "abcd"[sum(r.u >= e for e in (0.1, 0.3, 0.6))] for r in draws}
    assert {r.subid: r["c d"] for r in filled.where("subid >= 1000").collect()} == want
    assert rows(filled.where("subid < 1000")) == rows(df.where("subid < 1000"))


def test_many_observed_categories(spark, no_collect):
    """One category has half of the rows, 50,000 others one each."""
    known = spark.range(100_000).select(F.col("id").alias("subid"), F.when(F.col("id") % 2 == 0, "most").otherwise(F.concat(F.lit("c"), "id")).alias("c"))
    unknown = spark.range(100_000, 104_000).select(F.col("id").alias("subid"), F.lit(None).cast("string").alias("c"))
    repeated = unknown.limit(1).select("subid", "c").crossJoin(spark.range(2000)).drop("id")
    filled = churn.impute_categorical(known.union(unknown).union(repeated), "c").where("subid >= 100000")
    assert filled.count() == 6000 and filled.where("c IS NULL").isEmpty()
    most = filled.groupBy("subid").agg(F.count_distinct("c").alias("n"), F.first("c").alias("c"))
    assert most.where("n > 1").isEmpty()
    assert 0.45 < most.where("c = 'most'").count() / 4000 < 0.55


def test_no_category_is_known(spark):
    df = spark.createDataFrame([(1, None)], "subid long, c string")
    assert rows(churn.impute_categorical(df, "c")) == [(1, None)]


# ---- distinct counts by bitmaps


def test_bitmap_counts(spark):
    df = spark.range(50_000).select((F.col("id") * 37 % 40_000 - 100).alias("k"), (F.col("id") % 3).alias("m"), F.lit("x").alias("g h"))
    df = df.union(spark.createDataFrame([(None, 1, "x"), (2**62, 1, "x"), (-(2**62), 1, "y"), (None, 9, "z")], df.schema))
    by_month = profile.distinct_bitmaps(df, "k", ["m", "g h"])
    want = df.where("k IS NOT NULL").groupBy("m", "g h").agg(F.count_distinct("k").alias("distinct_count"))
    assert rows(profile.count_bitmaps(by_month, ["m", "g h"])) == rows(want)
    merged = profile.merge_bitmaps(by_month)
    assert profile.count_bitmaps(merged).first()[0] == df.agg(F.count_distinct("k")).first()[0]
    plan = profile.count_bitmaps(by_month, ["m"])._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_construct_agg" in plan and profile.count_bitmaps(profile.distinct_bitmaps(df.limit(0), "k")).first()[0] == 0


# ---- stored tables


def _left(spark):
    folder = f"{shared_folder(spark)}/subtide"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_a_scope_leaves_nothing_behind(spark):
    before, outside = _left(spark), materialize(spark.range(3), "outside")
    with scope(spark):
        inner = materialize(spark.range(5), "inner")
        with scope(spark):
            nested = materialize(spark.range(7), "nested")
            assert nested.count() == 7
        assert inner.count() == 5 and len(_left(spark) - before) == 2
        bad = spark.range(100).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("x"))
        with pytest.raises(Exception, match="no"):
            materialize(bad, "fails")
        os.makedirs(scratch_path(spark, "arrays"))
    left = _left(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("outside") and outside.count() == 3
    delete_path(spark, f"{shared_folder(spark)}/subtide/{next(iter(left))}")
    assert _left(spark) == before


def test_a_query_in_a_scope_leaves_nothing_behind(spark, inputs):
    from subtide.plans import BUILDERS

    before = _left(spark)
    for name in ("roc_curve", "dummy_encode", "fit_tree", "sparse_categories"):
        with scope(spark):
            assert BUILDERS[name](inputs).count() > 0
        assert _left(spark) == before


# ---- rejects


def test_bad_records_are_split_off(spark, tmp_path):
    lines = [
        "date,tv,radio x",
        '2019-07-01,"1,000.5",2',
        "2019-07-02,oops,2",
        "2019-13-01,1,2",
        "2019-07-03,1",
        "2019-07-04,1,2,3",
        ",1,2",
        "2019-08-05,,7",
        "",
    ]
    (tmp_path / "spend.csv").write_text("\n".join(lines))
    good, bad = split_spend_csv(spark, str(tmp_path / "spend.csv"))
    assert good.dtypes == [("year", "int"), ("month", "int"), ("tv", "double"), ("radio x", "double")]
    assert rows(good) == [(2019, 7, 1000.5, 2.0), (2019, 8, None, 7.0)]
    found = {r.record: r.bad_columns for r in bad.collect()}
    assert found == {"2019-07-02,oops,2": ["tv"], "2019-13-01,1,2": ["date"], "2019-07-03,1": [], "2019-07-04,1,2,3": [], ",1,2": ["date"]}
    clean = lines[:2] + lines[-2:]
    (tmp_path / "clean.csv").write_text("\n".join(clean))
    assert rows(load_spend_csv(spark, str(tmp_path / "clean.csv"))) == rows(split_spend_csv(spark, str(tmp_path / "clean.csv"))[0])
    (tmp_path / "us.csv").write_text("date,tv\n7/1/2019,5\n2019-07-01,6\n")
    good, bad = split_spend_csv(spark, str(tmp_path / "us.csv"), date_format="M/d/yyyy")
    assert rows(good) == [(2019, 7, 5.0)] and bad.first().record == "2019-07-01,6"
