"""Headline queries on one machine; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_ALL=1 to time every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quotegrid.session import local_session  # noqa: E402

HEADLINE = [
    "flt06_quantile_threshold",
    "jon06_as_of_daily",
    "agg01_daily_gap_filled",
    "agg02_weekly_by_dict",
    "agg07_mean_and_quantiles",
    "agg17_market_weighted_mean",
    "win06_lag_lead_bank",
    "top02_keep_first_dedup",
    "rsh01_pivot_company_rates",
    "mod03_all_subsets_ols",
    "mod08_iid_bootstrap_ols",
    "mod19_rolling_origin",
    "mod24_scenario_intervals",
    "dq02_iqr_outliers",
    "dq23_feature_drift",
    "plan_weekly_features",
    "plan_model_selection",
    "plan_price_table",
]


def ensembles():
    """Bagged ridge trainings of the published baseline sizes, on the weekly table of every product."""
    from pyspark.sql import functions as F

    from quotegrid.operators.bootstrap import packed_ridge_ensemble
    from quotegrid.workloads import tables as t
    from quotegrid.workloads.q_models import weighted_rows

    def train(replicates):
        def run(spark, sf):
            rows = weighted_rows(spark, sf, 0.99, 0).select("product", "date", *t.FEATURES, "y", "w")
            e = packed_ridge_ensemble(
                rows, ["product"], "date", "y", t.FEATURES, replicates, 1.0, weight="w", positive=True
            )
            return e.groupBy("product").agg(F.percentile(F.col("coef")[1], F.array(F.lit(0.025), F.lit(0.975))))

        return run

    return {f"train_ridge_bootstrap_{b}": train(b) for b in (1000, 10000)}


def main() -> None:
    from quotegrid.workloads.catalog import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    todo = {n: QUERIES[n] for n in names} | ensembles()
    # one small query so that JVM and Python worker start-up are not charged to the first entry
    QUERIES["mod06_non_negative_weighted_ridge"](spark, sf).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in todo.items():
        start = time.perf_counter()
        fn(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
