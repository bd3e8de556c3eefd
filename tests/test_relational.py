"""Joins, id sets, de-duplication, reshaping, sources."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from subtide.operators import relational
from subtide.sources import (
    SUBSCRIBERS,
    checkpoint_table,
    load_spend_csv,
    load_table,
    materialize,
    release,
    require,
    shared_folder,
    write_csv,
)
from tests.conftest import rows


def test_merge_suffixes_and_kinds(spark):
    left = spark.createDataFrame([(1, "l1"), (2, "l2")], "k int, v string")
    right = spark.createDataFrame([(2, "r2"), (3, "r3")], "k int, v string")
    inner = relational.merge(left, right, ["k"])
    assert inner.columns == ["k", "v_x", "v_y"]
    assert rows(inner) == [(2, "l2", "r2")]
    assert rows(relational.merge(left, right, ["k"], "left")) == [(1, "l1", None), (2, "l2", "r2")]
    assert rows(relational.merge(left, right, ["k"], "right")) == [(2, "l2", "r2"), (3, None, "r3")]


def test_merge_fans_out_on_duplicate_right_keys(spark):
    left = spark.createDataFrame([(1,)], "k int")
    right = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert rows(relational.merge(left, right, ["k"], "left")) == [(1, "a"), (1, "b")]


def test_id_intersection_ignores_copies_and_nulls(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (None,)], "subid long")
    b = spark.createDataFrame([(1,), (2,), (None,)], "subid long")
    c = spark.createDataFrame([(2,), (3,)], "subid long")
    assert rows(relational.id_intersection(a, b)) == [(1,), (2,)]
    assert rows(relational.id_intersection(a, b, c)) == [(2,)]
    assert rows(relational.keep_ids(a, b)) == [(1,), (1,), (2,)]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dedup_first_is_stable(spark, parts):
    data = [
        (1, date(2020, 1, 2), 0, "late"),
        (1, date(2020, 1, 1), 1, "second"),
        (1, date(2020, 1, 1), 0, "first"),
        (2, None, 0, "unknown date"),
        (2, date(2021, 1, 1), 5, "known date"),
        (3, None, None, None),
    ]
    df = spark.createDataFrame(data, "subid long, d date, p int, v string").repartition(parts)
    first = relational.dedup_first(df, "subid", ["d", "p"])
    assert first.columns == df.columns
    assert {r.subid: r.v for r in first.collect()} == {1: "first", 2: "known date", 3: None}


@pytest.mark.parametrize("threshold", ["10m", "-1"])
def test_lookup_join_both_ways(spark, threshold):
    left = spark.range(1000).selectExpr("id AS subid", "IF(id % 3 = 0, 'hot', CAST(id % 5 AS STRING)) AS k")
    left = left.unionByName(spark.sql("SELECT 5000L AS subid, CAST(NULL AS STRING) AS k"))
    lookup = spark.createDataFrame([("hot", 1.0), ("1", 2.0), ("2", 3.0)], "k string, v double")
    lookup = materialize(lookup, "lookup")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        joined = relational.lookup_join(left, lookup, ["k"], "subid")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == (threshold == "10m")
        prices = {"hot": 1.0, "1": 2.0, "2": 3.0}
        assert sorted(joined.select("subid", "v").collect()) == [
            (r.subid, prices.get(r.k)) for r in sorted(left.collect())
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key, some without a key."""
    return spark.range(3000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 100 <> 1 THEN id END AS subid", "id AS row"
    )


def test_hot_keys(skewed):
    assert relational.hot_keys(skewed, "subid") == {7: pytest.approx(1 / 3, abs=0.01)}
    assert relational.hot_keys(skewed.where("subid <> 7"), "subid") == {}
    assert relational.hot_keys(skewed.limit(0), "subid") == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("known", ["subid IN (7, 10, 11, 5000)", "subid <> 7"])
def test_hot_keys_are_joined_apart_with_the_same_rows(spark, skewed, how, known):
    right = spark.range(6000).selectExpr("id AS subid", "id * 2 AS twice").where(known)
    apart = relational.join_splitting_hot_keys(skewed, right, "subid", how)
    plain = relational.join_splitting_hot_keys(skewed.where("subid <> 7"), right, "subid", how)
    assert "Union" in apart._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plain._jdf.queryExecution().optimizedPlan().toString()
    assert apart.columns == plain.columns
    assert rows(apart) == rows(skewed.join(right, "subid", how))


def test_a_large_right_side_of_a_hot_key_is_still_split(skewed):
    right = skewed.selectExpr("subid", "row AS other").where("subid = 7 AND other < 300")
    apart = relational.join_splitting_hot_keys(skewed, right, "subid")
    assert "_salt" in apart._jdf.queryExecution().optimizedPlan().toString()
    assert apart.count() == right.count() * skewed.where("subid = 7").count()


def test_other_joins_are_refused(skewed):
    with pytest.raises(ValueError, match="right"):
        relational.join_splitting_hot_keys(skewed, skewed, "subid", "right")


def test_keep_ids_of_a_hot_key(skewed):
    ids = skewed.where("subid = 7 OR subid > 2990").distinct()  # the id side holds copies, too
    kept = relational.keep_ids(skewed, ids)
    assert rows(kept) == rows(skewed.where("subid = 7 OR subid > 2990"))


def test_unpivot_drops_nulls(spark):
    wide = spark.createDataFrame([(2020, 2, 1.0, None)], "year int, month int, a double, b double")
    assert rows(relational.unpivot_channels(wide)) == [(2020, 2, "a", 1.0)]


def test_spend_csv_of_other_dates(spark, tmp_path):
    (tmp_path / "us.csv").write_text("date,email\n7/1/2019,\"1,000\"\n")
    assert rows(load_spend_csv(spark, str(tmp_path / "us.csv"), date_format="M/d/yyyy")) == [(2019, 7, 1000.0)]


def test_stored_tables_are_released(spark):
    kept, gone = (materialize(spark.range(3), name) for name in ("kept", "gone"))
    release(gone)
    assert kept.count() == 3
    with pytest.raises(Exception):
        gone.count()


def test_spend_csv(spark, tmp_path):
    (tmp_path / "spend.csv").write_text('date,facebook,email\n2019-07-01,"1,234","56"\n2019-08-01,,"1,000,000.5"\n')
    spend = load_spend_csv(spark, str(tmp_path / "spend.csv"))
    assert spend.dtypes == [("year", "int"), ("month", "int"), ("facebook", "double"), ("email", "double")]
    assert rows(spend) == [(2019, 7, 1234.0, 56.0), (2019, 8, None, 1000000.5)]


def test_spend_csv_rejects_text(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("date,facebook\n2019-07-01,lots\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        load_spend_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_write_and_checkpoint(spark, tmp_path):
    df = spark.range(5).select("id", (F.col("id") * 2).alias("twice"))
    write_csv(df, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, inferSchema=True).count() == 5
    saved = checkpoint_table(df, str(tmp_path / "table"))
    assert rows(saved) == rows(df) and saved.schema.names == df.columns
    assert "Range" not in saved._jdf.queryExecution().optimizedPlan().toString()
    assert rows(load_table(spark, str(tmp_path / "table"))) == rows(df)


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_contract_errors(spark, inputs):
    require(inputs.subscribers, SUBSCRIBERS)
    with pytest.raises(ValueError, match="plan_type"):
        require(inputs.subscribers.drop("plan_type"), SUBSCRIBERS)
    with pytest.raises(ValueError, match="must be a boolean"):
        require(inputs.subscribers.withColumn("retarget_tf", F.lit(1)), SUBSCRIBERS)
