"""Inputs that once gave wrong or incomplete results."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tracewise.functions.fmt import pystr
from tracewise.operators.alerts import candidates, outbox
from tracewise.operators.evaluate import parse_judge_reply
from tracewise.operators.rca import bridge, upsert_reports
from tracewise.operators.regression import detect_all
from tracewise.operators.retrieval import knn_dense
from tracewise.operators.sinks import export_tables
from tracewise.operators.traces import trace_waterfall, with_stage_order
from tracewise.session import get_session
from tracewise.sources.lookups import detection_config
from tracewise.sources.tables import scan_stage_events
from tracewise.streaming.jobs import sync_batch

DAY = dt.datetime(2026, 6, 1)


def test_pystr_is_python_str(spark):
    values = [0.0, 45.0, 0.1, 1e7, 12345678.5, 123456789012.25, 9.9e15, 1e16, 1.5e16, 1e22, 0.001, 0.0005, 0.000123,
              1e-4, 1e-5, 2.5e-7, 1e-100, 1e300, -1e7, -0.0005]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", pystr("v").alias("s")).collect()
    assert [r.s for r in got] == [str(r.v) for r in got]


def test_judge_replies(spark):
    replies = ['{"score": "0.8", "reasoning": "ok"}', '{"score": 1, "reasoning": null}', '{"score": ', '{"reasoning": "x"}', None]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string") \
        .select("i", parse_judge_reply(F.col("r")).alias("p")).orderBy("i").collect()
    assert [tuple(r.p) for r in got] == [
        (0.8, "ok", False), (1.0, "", False), (None, "[JUDGE ERROR] invalid JSON", True),
        (None, "[JUDGE ERROR] 'score'", True), (None, "[JUDGE ERROR] invalid JSON", True)]


def test_more_than_fifty_alerts_are_due(spark):
    rows = spark.range(1, 201).withColumn("window_start", F.lit(DAY))
    log = spark.createDataFrame([("rca", "7", True), ("rca", "8", False)],
                                "alert_type string, reference_id string, success boolean")
    due = {tuple(r) for r in outbox(candidates(rows, rows), log).collect()}
    assert len(due) == 399 and ("rca", "7") not in due and ("rca", "8") in due


def _points(spark, days):
    return spark.createDataFrame([(DAY + dt.timedelta(days=i), DAY + dt.timedelta(days=i + 1), 1440, "m", 9.0) for i in range(days)],
                                 "window_start timestamp_ntz, window_end timestamp_ntz, window_minutes int, "
                                 "metric_name string, value double")


def test_new_regressions_get_ids_after_the_stored(spark):
    cfg = detection_config(spark, [("m", 5.0, "above")])
    stored = detect_all(_points(spark, 2), cfg, 1440)
    new = detect_all(_points(spark, 4), cfg, 1440, existing=stored)
    assert sorted(r.id for r in stored.collect()) == [1, 2]
    assert [(r.id, r.window_start.day) for r in new.orderBy("id").collect()] == [(3, 3), (4, 4)]


def test_upsert_keeps_and_gives_ids(spark):
    schema = ("id long, window_start timestamp_ntz, window_minutes int, regression_ids array<long>, "
              "root_cause_category string, confidence string, summary string")
    row = lambda i, d, s: (i, DAY + dt.timedelta(days=d), 1440, [i], "c", "low", s)
    stored = spark.createDataFrame([row(5, 0, "old"), row(6, 1, "old")], schema)
    fresh = spark.createDataFrame([row(1, 1, "new"), row(2, 2, "new")], schema)
    got = upsert_reports(stored, fresh).orderBy("id")
    assert [(r.id, r.summary) for r in got.collect()] == [(5, "old"), (6, "old"), (7, "new")]
    assert bridge(got).count() == 3
    forced = upsert_reports(stored, fresh, force=True).orderBy("id").collect()
    assert [(r.id, r.summary) for r in forced] == [(5, "old"), (7, "new"), (8, "new")]


def _events(spark):
    ev = [("e1", "t", DAY, "a", "success", 1.0), ("e2", "t", DAY + dt.timedelta(seconds=1), "b", "success", 2.0)]
    return spark.createDataFrame(ev + ev[:1], "event_id string, trace_id string, timestamp_start timestamp_ntz, "
                                              "stage_name string, status string, latency_ms double")


def test_repeated_events_stay_single_rows(spark):
    ev = _events(spark)
    assert sorted((r.event_id, r.stage_order) for r in with_stage_order(ev).collect()) == [
        ("e1", 0), ("e1", 1), ("e2", 2)]
    tr = spark.createDataFrame([("t", DAY)], "trace_id string, started_at timestamp_ntz")
    got = trace_waterfall(ev, tr).orderBy("stage_order").collect()
    assert [(r.offset_ms, r.cumulative_latency_ms) for r in got] == [(0.0, 1.0), (0.0, 2.0), (1000.0, 4.0)]


def test_stage_order_shuffles_events_once(spark):
    """Event rows cross one exchange, dealt by trace and minute; the others carry totals."""
    plan = with_stage_order(_events(spark))._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [row_number()" in x]
    assert len(windows) == 1 and "_b#" in windows[0].split("windowspecdefinition(")[1].split("timestamp_start")[0]


def test_broken_lines_fail_the_scan(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "log.json")
    with open(path, "w") as f:
        f.write("{broken\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        scan_stage_events(spark, path).collect()


def test_failed_read_fails_the_batch(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "table")
    batch = spark.createDataFrame([("a", 1)], "k string, v int")
    run = sync_batch(path, ["k"])
    run(batch, 0)
    run(batch, 0)
    assert spark.read.parquet(path).count() == 1
    with open(os.path.join(path, "part-bad.parquet"), "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        run(spark.createDataFrame([("b", 1)], batch.schema), 1)


def test_exports_lack_no_column(spark, tmpdir_path):
    with pytest.raises(ValueError, match="metric_name"):
        export_tables({"regressions": spark.createDataFrame([(1,)], "id long")}, tmpdir_path, strict=True)


def test_static_settings_on_a_live_session(spark):
    get_session(extra_conf={"spark.sql.warehouse.dir": "/tmp/elsewhere"})


def test_no_query_vectors(spark):
    items = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    none = spark.createDataFrame([], "qid long, embedding array<double>")
    assert knn_dense(items, "vec_id", "embedding", none, 3).count() == 0
