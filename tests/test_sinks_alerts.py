import datetime as dt
import os

from pyspark.sql import functions as F

from tracewise.operators.alerts import attempt_rows, candidates, outbox
from tracewise.operators.sinks import (append_events_jsonl, delete_then_insert, export_tables,
                                       new_by_key)
from tracewise.schemas import STAGE_EVENT
from tracewise.sources.tables import scan_stage_events


def test_jsonl_roundtrip_and_missing_path(spark, tmpdir_path):
    t = dt.datetime(2026, 7, 1, 9, 0, 9)
    rows = [("e1", "t1", None, "a", t, t, 1.5, "success", None, None, None, None)]
    df = spark.createDataFrame(rows, STAGE_EVENT)
    path = os.path.join(tmpdir_path, "events")
    append_events_jsonl(df, path)
    append_events_jsonl(df, path)
    back = scan_stage_events(spark, path)
    assert back.count() == 2 and back.first().timestamp_start == t
    with open(os.path.join(path, "bad.json"), "w") as f:
        f.write('{"event_id": "x"\n\n')
    bad = scan_stage_events(spark, path, with_corrupt=True)
    assert len(bad.where(F.col("_corrupt_record").isNotNull())
               .select("_corrupt_record", "event_id").collect()) == 1
    assert scan_stage_events(spark, os.path.join(tmpdir_path, "nope")).count() == 0


def test_insert_if_absent_and_reseed(spark):
    stored = spark.createDataFrame([("t1", 1)], "trace_id string, v int")
    fresh = spark.createDataFrame([("t1", 2), ("t2", 3)], "trace_id string, v int")
    assert [r.trace_id for r in new_by_key(fresh, stored, ["trace_id"]).collect()] == ["t2"]
    out = delete_then_insert(fresh, F.col("v") > 2, spark.createDataFrame([("t9", 9)], "trace_id string, v int"))
    assert sorted(r.trace_id for r in out.collect()) == ["t1", "t9"]


def test_export_roundtrip(spark, tmpdir_path):
    tr = spark.createDataFrame([("t1", None, 3.5, 2, True, "x")],
                               "trace_id string, query_id string, total_latency_ms double, "
                               "num_stages int, has_error boolean, extra string")
    export_tables({"traces": tr}, tmpdir_path, single_file=True, strict=False)
    back = spark.read.parquet(os.path.join(tmpdir_path, "traces.parquet"))
    assert "extra" not in back.columns and back.count() == 1
    csv = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "traces.csv"))
    assert csv.first().trace_id == "t1"


def test_outbox_retries_failed_attempts(spark):
    ws = dt.datetime(2026, 7, 8)
    reg = spark.createDataFrame([(1, ws), (2, ws)], "id long, window_start timestamp_ntz")
    rca = spark.createDataFrame([(1, ws)], "id long, window_start timestamp_ntz")
    due = outbox(candidates(reg, rca), spark.createDataFrame([], "alert_type string, reference_id string, success boolean"))
    assert due.count() == 3
    log = attempt_rows(due, F.col("reference_id") == "1")
    again = {(r.alert_type, r.reference_id) for r in outbox(candidates(reg, rca), log).collect()}
    assert again == {("regression", "2")}


def test_partitioned_rewrite_replaces_only_given_windows(spark, tmpdir_path):
    from tracewise.operators.sinks import write_table
    path = os.path.join(tmpdir_path, "metrics")
    a = spark.createDataFrame([(5, "m", 1.0), (60, "m", 2.0)], "window_minutes int, metric_name string, value double")
    write_table(a, path, partition_by=["window_minutes"])
    write_table(spark.createDataFrame([(5, "m", 9.0)], a.schema), path, partition_by=["window_minutes"])
    got = {(r.window_minutes, r.value) for r in spark.read.parquet(path).collect()}
    assert got == {(5, 9.0), (60, 2.0)}


def test_export_all_seven_tables(spark, tmpdir_path):
    from tracewise.operators.metrics import metrics_long
    from tracewise.operators.rca import rca_reports
    from tracewise.operators.regression import detect_all
    from tracewise.operators.sinks import export_all
    from tracewise.operators.traces import assemble_traces, with_stage_order
    from tracewise.sources.fixtures import stage_events
    from tracewise.sources.lookups import detection_config
    ev = stage_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    tr = assemble_traces(ev)
    mts = metrics_long(tr, ev).withColumn("id", F.monotonically_increasing_id())
    cfg = detection_config(spark, [("latency_p95_ms", 1.0, "above")])
    reg = detect_all(mts, cfg, 1440)
    rep = rca_reports(reg)
    evals = spark.createDataFrame([], "id long, trace_id string, evaluator_name string, score double, "
                                      "reasoning string, skipped boolean, created_at timestamp")
    written = export_all(tr, with_stage_order(ev), mts, evals, reg, rep, tmpdir_path, single_file=True)
    assert len(written) == 7
    bridge = spark.read.parquet(os.path.join(tmpdir_path, "rca_regression_bridge.parquet"))
    assert bridge.count() == reg.count()
    assert spark.read.option("header", True).csv(
        os.path.join(tmpdir_path, "traces.csv")).count() == tr.count()


def test_end_to_end_from_event_log(spark, tmpdir_path):
    """JSON-lines log -> traces (insert-if-absent) -> metrics -> regressions ->
    reports, with plain ``timestamp`` event times, as in the README example."""
    from tracewise.operators.metrics import metrics_long
    from tracewise.operators.rca import rca_reports
    from tracewise.operators.regression import detect_all
    from tracewise.operators.traces import assemble_traces
    from tracewise.sources.fixtures import stage_events
    from tracewise.sources.lookups import detection_config
    ev = stage_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    append_events_jsonl(ev, os.path.join(tmpdir_path, "events"))
    events = scan_stage_events(spark, os.path.join(tmpdir_path, "events"))
    first = assemble_traces(events.where(F.col("timestamp_start") < F.lit("2024-01-15").cast("timestamp")))
    traces = first.unionByName(new_by_key(assemble_traces(events), first, ["trace_id"]))
    assert traces.count() == assemble_traces(ev).count()
    metrics = metrics_long(traces, events)
    regs = detect_all(metrics, detection_config(spark, [("latency_p95_ms", 100.0, "above")]), 1440)
    assert rca_reports(regs).count() == regs.select("window_start").distinct().count()


def test_bucketed_sync_reads_touched_buckets_only(spark, tmp_path):
    from tracewise.operators.sinks import append_bucketed, new_traces_bucketed, sync_traces, sync_traces_bucketed
    from tracewise.operators.traces import assemble_traces
    from tracewise.sources.fixtures import stage_events
    ev = stage_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    old, path = ev.where(F.col("timestamp_start") < cut), str(tmp_path / "traces")
    sync_traces_bucketed(old, path, 32)                                     # no table yet
    stored = spark.read.parquet(path)
    assert stored.count() == old.select("trace_id").distinct().count() > 0
    # the whole log again: the same rows as the full form
    got, want = new_traces_bucketed(ev, path, 32), sync_traces(ev, stored.drop("bucket"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() > 0
    # one new trace and one stored one with a late event: two buckets of 32 at most
    known = stored.agg(F.min("trace_id")).first()[0]
    few = ev.where(F.col("trace_id") == known).unionByName(ev.limit(1).withColumn("trace_id", F.lit("new")))
    new = new_traces_bucketed(few, path, 32)
    files = {f.rsplit("/", 2)[-2] for f in new.inputFiles() if "bucket=" in f}
    plan = new._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(bucket" in plan.replace("\n", " ") and len(files) <= 32
    assert [r.trace_id for r in new.collect()] == ["new"]
    sync_traces_bucketed(few, path, 32)
    sync_traces_bucketed(few, path, 32)
    assert spark.read.parquet(path).groupBy("trace_id").count().where("count > 1").count() == 0
    assert spark.read.parquet(path).where("trace_id = 'new'").count() == 1
