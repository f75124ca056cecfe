"""Injected violations must be found; sources and plans end to end on small frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quotegrid.operators import leakage as lk
from quotegrid.operators import quality as dq
from quotegrid.operators.filters import require_non_empty
from quotegrid.operators.quantiles import exact_quantiles
from quotegrid.operators.subsets import beside_hot
from quotegrid.plans.pricing import reject_lag_zero
from quotegrid.sources import scan, sinks

D = dt.date


@pytest.fixture(scope="module")
def table(spark):
    rows = [(D(2024, 1, 1 + i % 28), float(i % 10), "F" if i % 4 else "O") for i in range(100)]
    rows += [(D(2024, 1, 5), 4000.0, "X"), (None, None, "F"), (D(2024, 1, 2), -5.0, "F")]
    return spark.createDataFrame(rows, "date date, value double, status string")


def test_profile_counts(table):
    assert abs(dq.null_percentage(table).first()[0] - 2 / 309 * 100) < 1e-12
    out = dq.outlier_percentage(table).first()
    assert out["n_values"] == 102 and out["n_outliers"] == 1


def test_rules_report_failures(table):
    got = {r["rule"]: r["passed"] for r in dq.evaluate_rules(table, [dq.non_empty(), *dq.positive(["value"]), dq.no_nulls("date")]).collect()}
    assert got == {"non_empty": True, "positive_value": False, "date_not_null": False}
    with pytest.raises(ValueError):
        dq.stage_rules(table, "absent")


def test_column_checks_split_rows(table):
    checks = {"date": dq.ColumnCheck("date", nullable=False), "value": dq.ColumnCheck("double", nullable=False, ge=0, le=100)}
    good, bad = dq.coerce_and_split(table, checks)
    assert good.count() == 100 and bad.count() == 3 and good.columns == ["date", "value"]
    assert sorted(len(r["failed_columns"]) for r in bad.collect()) == [1, 1, 2]


def test_fingerprint_evolution(table):
    before = dq.fingerprint(table, "date")
    after = dq.fingerprint(table.drop("status").withColumn("value", F.col("value").cast("float")).withColumn("n", F.lit(1)))
    got = {r["column_name"]: (r["change"], r["breaking"]) for r in dq.evolution(before, after).collect()}
    assert got == {"status": ("removed", True), "n": ("added", False), "value": ("retyped", True)}
    assert dq.compatibility(before, after).first()[0] == 0.5


def test_checkpoint_statuses(table):
    rules = dq.row_rules(table, [dq.negative_values("value", allowed=1), dq.member("status", ["F", "O"], allowed=5)])
    now = dq.table_metrics(table, "date")
    assert dq.checkpoint_status(None, rules).first()["status"] == "BASELINE"
    assert dq.checkpoint_status(dq.metric_drift(now, now), rules).first()["status"] == "PASSED"
    half = dq.table_metrics(table.where("value < 5"), "date")
    assert dq.checkpoint_status(dq.metric_drift(now, half), rules).first()["status"] == "WARNINGS"
    strict = dq.row_rules(table, [dq.negative_values("value")])
    assert dq.checkpoint_status(dq.metric_drift(now, now), strict).first()["status"] == "FAILED"


def test_drift_finds_a_shift(spark):
    rows = [(D(2024, 1, 1), float(i % 50), float(i % 7)) for i in range(400)] + [(D(2024, 6, 1), float(i % 50) + 60, float(i % 7)) for i in range(100)]
    df = spark.createDataFrame(rows, "date date, a double, b double")
    got = {r["feature"]: (r["status"], r["ks_distance"]) for r in dq.feature_drift(df, "date", "2024-05-01", ["a", "b"]).collect()}
    assert got["a"] == ("CRITICAL", 1.0) and got["b"][0] == "OK" and got["b"][1] < 0.05


def test_leakage_gates(spark):
    split = spark.createDataFrame([("p", D(2024, 1, d), "train" if d < 6 else "test") for d in range(1, 10)], "k string, date date, role string")
    assert lk.temporal_boundary(split, ["k"], "date").first()["status"] == "PASS"
    mixed = split.withColumn("role", F.when(F.dayofmonth("date") % 2 == 0, "train").otherwise("test"))
    assert lk.temporal_boundary(mixed, ["k"], "date").first()["status"] == "HALT"
    r2 = spark.createDataFrame([("a", 0.1), ("b", 0.25), ("c", 0.5)], "k string, r2 double")
    assert {r["k"]: r["status"] for r in lk.r2_gate(r2, ["k"], "r2").collect()} == {"a": "PASS", "b": "WARN", "c": "HALT"}
    with pytest.raises(ValueError):
        reject_lag_zero(["own_rate_t1", "C_lag_0"])
    reject_lag_zero(["own_rate_t1", "competitor_weighted_t2"])


def test_forecast_flags(spark):
    rows = [("good", 10.0 + i, 10.0) for i in range(5)] + [("flat", 10.0, 10.0)] * 5 + [("wild", -1.0, 10.0)] * 4
    df = spark.createDataFrame(rows, "k string, p double, y double")
    got = {r["k"]: r for r in dq.forecast_flags(df, ["k"], "p", "y", 5).collect()}
    assert all(got["good"][c] for c in ("correct_size", "finite_predictions", "positive_predictions", "reasonable_range", "sufficient_variance"))
    assert not got["flat"]["sufficient_variance"]
    assert not got["wild"]["correct_size"] and not got["wild"]["positive_predictions"] and not got["wild"]["reasonable_range"]


def test_interval_order_and_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0)], "k string, p5 double, p95 double")
    assert dq.interval_order(df, ["k"], ["p5", "p95"]).first()["n_disordered"] == 1
    got = {r["column_name"]: r["is_constant"] for r in dq.constant_columns(df, ["p5", "p95"]).collect()}
    assert got == {"p5": False, "p95": True}


def test_snapshots_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    path = str(tmp_path / "snap")
    sinks.write_snapshot(df, path, "2024-01-01")
    sinks.write_snapshot(df.where("id = 1"), path, "2024-02-01")
    assert scan.read_snapshot(spark, path).count() == 1
    assert scan.read_snapshot(spark, path, "2024-01-01").count() == 2
    stage = sinks.save_stage(df, str(tmp_path), "t", "sub")
    assert stage.count() == 2 and sinks.load_stage(spark, str(tmp_path), "t", "sub").count() == 2
    with pytest.raises(ValueError):
        require_non_empty(scan.scan_parquet(spark, path, require_rows=True).where("id = 9"), "id filter")


def test_by_day_sink_overwrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "days")
    a = spark.createDataFrame([(D(2024, 1, 1), 1), (D(2024, 1, 2), 2)], "date date, v int")
    sinks.write_by_day(a, path, "date")
    sinks.write_by_day(a.where("v = 2").withColumn("v", F.lit(9)), path, "date")
    assert sorted(r["v"] for r in spark.read.parquet(path).collect()) == [1, 9]


def test_scan_pushes_filter_and_prunes_columns(spark, sf):
    df = scan.scan_with_filter(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderpriority", "1-URGENT").select("o_totalprice")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderpriority), EqualTo(o_orderpriority,1-URGENT)]" in plan
    assert "ReadSchema: struct<o_totalprice:double,o_orderpriority:string>" in plan


# ---------------------------------------------------------------- content hashes, logs, named schemas
def test_content_hash_is_of_the_rows_not_their_order(spark):
    from quotegrid.operators import content

    rows = [(i % 40, f"v{i % 7}", i / 8, D(2024, 1, 1 + i % 20)) for i in range(200)] + [(None, None, None, None), (1, "v1", float("nan"), None)]
    df = spark.createDataFrame(rows, "a int, b string, c double, d date")
    one = content.content_hash(df.repartition(7)).first()
    assert one == content.content_hash(df.orderBy(F.desc("a"))).first() and one["n_rows"] == 202
    assert content.content_hash(df.union(df.limit(1))).first()["n_duplicates"] == one["n_duplicates"] + 1
    changed = df.withColumn("b", F.when(F.col("a") == 3, "x").otherwise(F.col("b")))
    assert content.content_hash(changed).first()["content_hash"] != one["content_hash"]
    empty = content.content_hash(df.limit(0)).first()
    assert (empty["n_rows"], empty["n_duplicates"]) == (0, 0)
    shifted = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert content.content_hash(shifted.limit(1)).first()["content_hash"] != content.content_hash(shifted.offset(1)).first()["content_hash"]


def test_one_changed_row_touches_one_range(spark):
    from quotegrid.operators import content
    from quotegrid.operators.joins import compare_tables

    a = spark.range(200_000).select("id", (F.col("id") * 0.5).alias("v"), F.when(F.col("id") % 9 != 0, F.lit(1.0)).alias("w"))
    b = a.withColumn("v", F.when(F.col("id") == 77, F.col("v") + 0.25).otherwise(F.col("v")))
    assert content.differing_ranges(a, a.repartition(3), ["id"], ["v", "w"]).count() == 0
    assert content.differing_ranges(a, b, ["id"], ["v", "w"]).count() == 1
    left, right = content.differing_rows(a, b, ["id"], ["v", "w"])
    assert left.count() == right.count() < 200
    got = {r["column_name"]: r for r in compare_tables(a, b, ["id"], ["v", "w"], 1e-9).collect()}
    assert got["v"]["max_abs_diff"] == 0.25 and not got["v"]["equal"] and got["w"]["equal"]
    fewer = {r["column_name"]: r for r in compare_tables(a, b.where("id < 199000"), ["id"], ["v"], 1e-9).collect()}
    assert fewer["v"]["only_left"] == 1000 and fewer["v"]["only_right"] == 0
    nothing = {r["column_name"]: r for r in compare_tables(a, a, ["id"], ["v"], 0.0).collect()}
    assert nothing["v"]["equal"] and nothing["v"]["max_abs_diff"] == 0


def test_missing_keys_meet_in_a_comparison(spark):
    from quotegrid.operators.joins import compare_tables

    a = spark.createDataFrame([(None, 1.0), ("x", 2.0)], "k string, v double")
    b = spark.createDataFrame([(None, 1.5), ("x", 2.0)], "k string, v double")
    r = compare_tables(a, b, ["k"], ["v"], 1e-9).first()
    assert (r["only_left"], r["only_right"], r["max_abs_diff"]) == (0, 0, 0.5)


def test_log_keeps_one_entry_a_version(spark, table, tmp_path):
    from quotegrid.operators import validation_log as log

    path = f"{tmp_path}/log"
    rules = [dq.negative_values("value", allowed=1)]
    assert log.read(spark, path, "t") is None and log.history(spark, path, "t") is None
    assert log.checkpoint(table, "date", rules, path, "t", 1).first()["status"] == "BASELINE"
    assert log.checkpoint(table.where("value < 5"), "date", rules, path, "t", 2).first()["status"] == "WARNINGS"
    assert log.checkpoint(table, "date", rules, path, "t", 2).first()["status"] == "PASSED"  # run again: replaced
    log.checkpoint(table, "date", rules, path, "other", 7)
    for version in range(3, 9):
        log.checkpoint(table, "date", rules, path, "t", version)
    assert [r["version"] for r in log.history(spark, path, "t", 3).orderBy("version").collect()] == [6, 7, 8]
    assert log.before(spark, path, "t", 2).first()["status"] == "BASELINE" and log.before(spark, path, "t", 1) is None


def test_schema_versions_report_changes_and_compatibility(spark, table, tmp_path):
    from quotegrid.operators import validation_log as log

    path = f"{tmp_path}/schemas"
    whole = table.where("date is not null")
    assert log.schema_version(whole, path, "t", 1).count() == 0
    changes = {r["column_name"]: (r["change"], r["breaking"]) for r in log.schema_version(table.drop("status"), path, "t", 2).collect()}
    assert changes == {"status": ("removed", True), "date": ("became_nullable", True), "value": ("became_nullable", True)}
    back = {r["column_name"]: r["change"] for r in log.schema_version(whole, path, "t", 3).collect()}
    assert back == {"status": "added", "date": "became_required", "value": "became_required"}
    got = {r["version"]: r for r in log.schema_history(spark, path, "t").collect()}
    assert got[1]["schema_hash"] == got[3]["schema_hash"] and got[1]["content_hash"] == got[3]["content_hash"]
    assert got[1]["compatibility"] is None and abs(got[2]["compatibility"] - 2 / 3) < 1e-12 and got[2]["n_columns"] == 2


def test_named_schemas_find_violations(spark):
    from quotegrid.operators import schemas

    named = schemas.named_schemas("own")
    assert set(named) == {"sales_data", "time_series_data", "competitive_rates", "weekly_aggregated", "final_dataset"}
    days = [(D(2024, 1, 1) + dt.timedelta(days=i + (15 if i > 60 else 0)), -1.0 if i == 5 else 2.0) for i in range(120)]
    df = spark.createDataFrame(days, "date date, sales double")
    broken = lambda df, name: {(r["check"], r["column_name"]): r["n_violations"] for r in schemas.check_schema(df, named[name]).where("n_violations > 0").collect()}
    assert broken(df, "time_series_data") == {("range", "sales"): 1, ("date_continuity", "date"): 1}
    assert broken(df.where("sales > 0"), "final_dataset") == {("min_rows", None): 1, ("required", "Spread"): 1, ("required", "sales_log"): 1, ("min_features", None): 1}
    assert broken(df.select(F.col("date").cast("string").alias("date"), "sales").limit(0), "weekly_aggregated") == {("not_empty", None): 1, ("min_rows", None): 1, ("kind", "date"): 1}
    checks = schemas.check_schema(df, named["time_series_data"]).withColumn("dataset", F.lit("x"))
    assert tuple(schemas.verdicts(checks).first()) == ("x", 1, 1, False)


def test_severities(spark):
    from quotegrid.functions import grades

    def of(test, *values):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
        return [r["s"] for r in df.select("i", grades.severity(test, "v").alias("s")).orderBy("i").collect()]

    assert of("durbin_watson", 0.9, 1.2, 2.0, 2.6, 3.1) == ["SEVERE", "MODERATE", "NONE", "MODERATE", "SEVERE"]
    assert of("ljung_box", 0.0005, 0.005, 0.03, 0.2) == ["SEVERE", "MODERATE", "MILD", "NONE"]
    assert of("jarque_bera", 0.0005, 0.005, 0.06) == ["MODERATE", "MILD", "NONE"]
    assert of("variance_inflation", 30, 12, 7, 2) == ["SEVERE", "MODERATE", "MILD", "NONE"]


def test_outliers_neither_sort_nor_gather_a_column(spark, table, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = dq.outlier_percentage(table)
        out.explain()
        assert "SortMergeJoin" not in capsys.readouterr().out
        got = out.first()
        assert got["n_values"] == 102 and got["n_outliers"] == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_of_a_hot_key_meet_its_row_in_many_tasks(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.lit("a")).alias("k"), F.col("id").cast("double").alias("v"))
    one = rows.groupBy("k").agg(F.max("v").alias("top"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        met = beside_hot(rows, one, ["k"])
        assert met.columns == ["k", "v", "top"]
        shares = met.groupBy("k", F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top")).collect()
        quartiles = {r["k"]: r["value"] for r in exact_quantiles(rows, "v", [0.5], ["k"], accuracy=100).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r["n"] for r in shares if r["k"] == "a") == 1980 and sum(r["n"] for r in shares if r["k"] is None) == 20
    assert {(r["k"], r["top"]) for r in shares} == {("a", 1999.0), (None, 1900.0)}
    assert max(r["n"] for r in shares) < 1000
    assert quartiles == {"a": 1000.0, None: 950.0}
