from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.maxMetadataStringLength", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from subtide.plans.inputs import Inputs

    return Inputs(spark, SF_DIR).staged()


@pytest.fixture(scope="session")
def feature_table(inputs):
    """The modelling table of the larger sample, written once."""
    from subtide.plans.churn_plans import features
    from subtide.plans.inputs import Inputs
    from subtide.sources import materialize

    return materialize(features(Inputs(inputs.spark, "/root/testdata/sf0.01")), "test-features")


def rows(df):
    """The rows of a small result as sorted tuples."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
