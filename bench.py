"""Time the headline queries and print one JSON line.

The input tables are derived from the sample tables and written first; that time
is reported as ``stage_inputs`` and is part of the total. Each query is then built
and run to the end (the rows go to Spark's no-op sink). Everything runs twice and
the faster run counts, so that JVM warm-up is not measured. Settings come from
BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (names separated by commas).
"""

from __future__ import annotations

import json
import os
import sys
import time
from functools import partial
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from subtide.plans import BUILDERS  # noqa: E402
from subtide.plans.inputs import Inputs  # noqa: E402
from subtide.sources import release_all, scope  # noqa: E402

HEADLINE = [
    "pearson_pairs",
    "null_profile",
    "id_intersection",
    "dedup_first",
    "ab_conversion",
    "ab_power",
    "coverage",
    "channel_cac",
    "marginal_spend",
    "trial_features",
    "daily_features",
    "churn_features",
    "dummy_encode",
    "roc_curve",
    "auc_score",
    "offer_scenario_wide",
    "subscriber_cac",
    "clv_with_cac",
    "fit_tree",
    "fit_logistic",
    "fit_forest",
    "fit_gbt",
    "grid_tree",
    "grid_forest",
    "compiled_ensembles",
    "sparse_categories",
    "distinct_by_month",
]


def faster_of_two(run):
    """The last result and the shorter time of two runs."""
    times = []
    for _ in range(2):
        start = time.perf_counter()
        result = run()
        times.append(time.perf_counter() - start)
    return result, round(min(times), 3)


def run_query(build, inputs: Inputs) -> None:
    with scope(inputs.spark):
        build(inputs).write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # No call site is recorded for each column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    inputs, seconds["stage_inputs"] = faster_of_two(lambda: Inputs(spark, sf_dir).staged())
    for name in names:
        run = partial(run_query, BUILDERS[name], inputs)
        _, seconds[name] = faster_of_two(run)
    release_all(spark)
    spark.stop()
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
