"""Every query with a SQL form gives the rows of its DuckDB statement."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tests.conftest import SF_DIR

# Types a column has in both engines.
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
}
# The statement names the levels or months that occur at the scale it is checked at.
LARGER_SAMPLE = {"dummy_encode", "pivot_mean", "ols_optimum", "logistic_optimum", "tree_importance_names"}


@pytest.fixture(scope="module")
def connect():
    open_connections = {}

    def of(folder):
        if folder not in open_connections:
            connection = duckdb.connect()
            for file in Path(folder).glob("*.parquet"):
                connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
            open_connections[folder] = connection
        return open_connections[folder]

    return of


def _ordered(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_matches_oracle(name, spark, connect):
    folder = "/root/testdata/sf0.01" if name in LARGER_SAMPLE else SF_DIR
    df = contract.queries()[name](spark, folder)
    result = connect(folder).execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    oracle_types = {d[0]: str(d[1]) for d in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in df.schema.fields} == oracle_types
    ours, theirs = _ordered(df.collect(), df.columns), _ordered(result.fetchall(), names)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert all(_same(x, y) for x, y in zip(a, b)), (a, b)


def test_entry_and_registry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
