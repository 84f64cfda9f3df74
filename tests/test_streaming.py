import datetime as dt
import os

from pyspark.sql import functions as F

from tracewise.operators.traces import assemble_traces
from tracewise.sources.fixtures import stage_events
from tracewise.streaming.jobs import dedup_events, sync_batch, trace_sessions, window_metrics_stream


def _write_events(spark, tmp):
    ev = stage_events(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    path = os.path.join(tmp, "events")
    ev.withColumn("timestamp_start", F.col("timestamp_start").cast("timestamp")) \
      .withColumn("timestamp_end", F.col("timestamp_end").cast("timestamp")) \
      .repartition(4).write.parquet(path)
    return ev, path


def _run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode) \
          .trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_stream_traces_equal_batch(spark, tmpdir_path):
    ev, path = _write_events(spark, tmpdir_path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    # a gap longer than any trace: one session per trace, all closed at the end
    out = _run(trace_sessions(stream, gap="2 days", delay="0 seconds"), "st_traces")
    batch = assemble_traces(ev)
    got = {(r.trace_id, r.num_stages, r.total_latency_ms, r.slowest_stage) for r in out.collect()}
    want = {(r.trace_id, r.num_stages, r.total_latency_ms, r.slowest_stage) for r in batch.collect()}
    # append mode emits the sessions closed by the watermark: those that ended two days before the newest event
    newest = ev.agg(F.max("timestamp_start")).first()[0]
    ends = {r.trace_id: r.last for r in ev.groupBy("trace_id").agg(F.max("timestamp_start").alias("last")).collect()}
    closed = {w for w in want if ends[w[0]] + dt.timedelta(days=2) <= newest}
    assert got == closed and closed


def test_stream_window_metrics_and_dedup(spark, tmpdir_path):
    ev, path = _write_events(spark, tmpdir_path)
    tr = assemble_traces(ev).withColumn("started_at", F.col("started_at").cast("timestamp"))
    tpath = os.path.join(tmpdir_path, "traces")
    tr.write.parquet(tpath)
    stream = spark.readStream.schema(spark.read.parquet(tpath).schema).parquet(tpath)
    out = _run(window_metrics_stream(stream, 1440, delay="0 seconds"), "st_metrics")
    from tracewise.operators.metrics import window_trace_metrics
    batch = {r.window_start: r for r in window_trace_metrics(tr.withColumn(
        "started_at", F.col("started_at").cast("timestamp_ntz")), [1440]).collect()}
    rows = out.collect()
    assert rows
    for r in rows:
        b = batch[r.window_start.replace(tzinfo=None)]
        assert r.trace_count == b.trace_count
        assert abs(r.latency_p95_ms - b.latency_p95_ms) < 1e-9
    # duplicated deliveries are dropped
    dup = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    d = _run(dedup_events(dup.unionByName(dup.withColumn("latency_ms", F.col("latency_ms") + 1))),
             "st_dedup")
    assert d.count() == ev.count()


def test_foreach_batch_sync_is_idempotent(spark, tmpdir_path):
    ev, _ = _write_events(spark, tmpdir_path)
    tr = assemble_traces(ev)
    target = os.path.join(tmpdir_path, "traces_table")
    fn = sync_batch(target, ["trace_id"])
    fn(tr, 0)
    fn(tr, 0)          # a retried epoch writes nothing twice
    assert spark.read.parquet(target).count() == tr.count()


def test_threshold_alert_stream(spark, tmpdir_path):
    import datetime as dt
    from tracewise.streaming.jobs import threshold_alerts_stream
    from tracewise.sources.lookups import detection_config
    rows = [(f"t{i}", dt.datetime(2026, 7, 1 + i // 10, 10, i % 10), 100.0 + 50 * i, i % 3 == 0)
            for i in range(40)]
    tr = spark.createDataFrame(rows, "trace_id string, started_at timestamp, "
                                     "total_latency_ms double, has_error boolean")
    path = os.path.join(tmpdir_path, "tr")
    tr.write.parquet(path)
    stream = spark.readStream.schema(tr.schema).parquet(path)
    cfg = detection_config(spark, [("latency_p95_ms", 1000.0, "above"), ("error_rate_pct", 50.0, "above")])
    out = _run(threshold_alerts_stream(window_metrics_stream(stream, 1440, delay="0 seconds"), cfg),
               "st_alerts")
    got = {(r.metric_name, r.window_start.day) for r in out.collect()}
    # windows closed by the watermark: days 1-3; p95 above 1000 on days 2 and 3
    assert ("latency_p95_ms", 2) in got and ("latency_p95_ms", 1) not in got


def test_late_event_of_closed_trace_is_dropped(spark, tmpdir_path):
    import datetime as dt
    from tracewise.schemas import STAGE_EVENT

    def ev(eid, tid, hh, mm):
        t = dt.datetime(2026, 7, 1, hh, mm)
        return (eid, tid, None, "s", t, t + dt.timedelta(seconds=1), 1.0, "success",
                None, None, None, None)

    src = os.path.join(tmpdir_path, "src")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    spark.createDataFrame([ev("a1", "A", 10, 0), ev("a2", "A", 10, 1), ev("b1", "B", 12, 0)],
                          STAGE_EVENT).coalesce(1).write.mode("append").parquet(src)

    out = os.path.join(tmpdir_path, "out")

    def run(name):
        target = os.path.join(out, name)
        stream = spark.readStream.schema(STAGE_EVENT).parquet(src)
        q = (trace_sessions(stream, gap="10 minutes", delay="5 minutes").writeStream
             .foreachBatch(lambda df, epoch: df.write.mode("append").parquet(target))
             .outputMode("append").option("checkpointLocation", ckpt)
             .trigger(availableNow=True).start())
        q.awaitTermination()
        if not os.path.exists(target):
            return set()
        return {(r.trace_id, r.num_stages) for r in spark.read.parquet(target).collect()}

    first = run("late_run1")
    assert ("A", 2) in first                 # A closed: the watermark passed its gap
    # a late event of A (behind the watermark) and a newer trace C
    spark.createDataFrame([ev("a3", "A", 10, 2), ev("c1", "C", 13, 0)],
                          STAGE_EVENT).coalesce(1).write.mode("append").parquet(src)
    second = run("late_run2")
    assert not any(t == "A" for t, _ in second)   # never re-emitted, late event dropped
    assert ("B", 1) in second


def _event(eid, tid, minute):
    import datetime as dt
    t = dt.datetime(2026, 7, 1) + dt.timedelta(minutes=minute)
    return (eid, tid, None, "s", t, t + dt.timedelta(seconds=1), 1.0, "success", None, None, None, None)


def test_every_event_is_closed_late_or_open(spark, tmpdir_path):
    import random
    from tracewise.schemas import STAGE_EVENT
    from tracewise.streaming.jobs import session_batches
    rnd = random.Random(5)
    batches = []
    for b in range(5):        # each later by an hour, some events far behind, some traces over several batches
        batches.append([_event(f"{b}-{i}", f"t{rnd.randrange(12)}" if i % 5 else "untraced",
                               60 * b + rnd.randrange(60) - (200 if i % 11 == 0 else 0)) for i in range(60)])
    folder = os.path.join(tmpdir_path, "sessions")
    run = session_batches(folder, gap_minutes=15, delay_minutes=20)
    frames = [spark.createDataFrame(b, STAGE_EVENT) for b in batches]
    for epoch, df in enumerate(frames):
        run(df, epoch)
        run(df, epoch)        # an epoch that runs again changes nothing
    # brute force: the same in plain Python
    newest, open_events, late, closed = None, [], set(), []
    for b in batches:
        mark = newest and newest - 20
        own = [(r[1], (r[4].hour * 60 + r[4].minute + 1440 * (r[4].day - 1)) if r[4].month == 7 else r[4].hour * 60 + r[4].minute - 1440, r[0])
               for r in b]
        late |= {e for _, m, e in own if mark is not None and m < mark}
        open_events += [x for x in own if x[2] not in late]
        newest = max([m for _, m, _ in own] + ([newest] if newest is not None else []))
        still = []
        for t in sorted({x[0] for x in open_events}, key=str):
            session = []
            for x in sorted((x for x in open_events if x[0] == t), key=lambda x: x[1]) + [None]:
                if session and (x is None or x[1] - session[-1][1] > 15):
                    if session[-1][1] + 15 <= newest - 20:
                        closed.append((t, session[0][1], len(session)))
                    else:
                        still += session
                    session = []
                session.append(x)
        open_events = still
    got = spark.read.parquet(folder + "/closed").collect()
    minute = lambda t: (t.replace(tzinfo=None) - __import__("datetime").datetime(2026, 7, 1)).total_seconds() / 60
    assert sorted(((r.trace_id, minute(r.started_at), r.num_stages) for r in got), key=str) == \
        sorted(((t, float(m), n) for t, m, n in closed), key=str) and closed
    assert {r.event_id for r in spark.read.parquet(folder + "/late").collect()} == late and late
    left = {r.event_id for r in spark.read.parquet(folder + f"/open/epoch={len(batches) - 1}").collect()}
    assert left == {x[2] for x in open_events}
    assert sum(r.num_stages for r in got) + len(late) + len(left) == sum(map(len, batches))


def test_session_batches_of_a_stream_account_for_all_events(spark, tmpdir_path):
    from tracewise.operators.traces import assemble_traces as batch_traces
    from tracewise.streaming.jobs import session_batches
    ev, path = _write_events(spark, tmpdir_path)
    folder = os.path.join(tmpdir_path, "s")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 2).parquet(path)
    # a gap and delay longer than the data: nothing is late, every trace is one session, all are open
    q = (stream.writeStream.foreachBatch(session_batches(folder, 100_000, 100_000))
         .option("checkpointLocation", os.path.join(tmpdir_path, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    last = max(int(x.split("=")[1]) for x in os.listdir(folder + "/open") if x.startswith("epoch="))
    left = spark.read.schema(ev.schema).parquet(f"{folder}/open/epoch={last}")
    assert left.count() == ev.count() and spark.read.parquet(folder + "/late").count() == 0
    assert batch_traces(left).count() == batch_traces(ev).count()


def test_window_state_holds_distinct_values(spark, tmpdir_path):
    import datetime as dt
    t0 = dt.datetime(2026, 7, 1)
    rows = [(f"t{i}", t0 + dt.timedelta(days=i % 3, seconds=i % 1000), float(i % 4), i % 5 == 0) for i in range(3000)]
    rows += [("last", t0 + dt.timedelta(days=9), 1.0, False)]
    tr = spark.createDataFrame(rows, "trace_id string, started_at timestamp, total_latency_ms double, has_error boolean")
    path = os.path.join(tmpdir_path, "tr")
    tr.where("trace_id <> 'last'").coalesce(1).write.parquet(path)
    tr.where("trace_id = 'last'").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(tr.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = (window_metrics_stream(stream, 1440, delay="0 seconds").writeStream.format("memory").queryName("st_state")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    most = max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"])
    assert 0 < most <= 3 * 4 + 1                       # windows x distinct latencies, not 3,000 traces
    from tracewise.operators.metrics import window_trace_metrics
    want = {r.window_start: r for r in window_trace_metrics(
        tr.withColumn("started_at", F.col("started_at").cast("timestamp_ntz")), [1440]).collect()}
    got = spark.table("st_state").collect()
    assert len(got) == 3
    for r in got:
        b = want[r.window_start.replace(tzinfo=None)]
        assert [r[c] for c in ("trace_count", "error_rate_pct", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms")] == \
            [b[c] for c in ("trace_count", "error_rate_pct", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms")]


def test_replayed_epoch_sends_nothing_twice(spark, tmpdir_path):
    import datetime as dt
    from tracewise.schemas import ALERT_LOG
    from tracewise.streaming.jobs import outbox_batch
    box, log = os.path.join(tmpdir_path, "box"), os.path.join(tmpdir_path, "log")
    day = dt.datetime(2026, 7, 1)

    def flags(*days):
        return spark.createDataFrame([("latency_p95_ms", day + dt.timedelta(days=d), 1440, 9.0, 5.0) for d in days],
                                     "metric_name string, window_start timestamp, window_minutes int, "
                                     "current_value double, baseline_value double")

    def held():
        return sorted(r.reference_id[-18:-14] for r in spark.read.parquet(box).select("reference_id").collect())

    run = outbox_batch(box, "thresholds", log)
    run(flags(0, 1, 1), 0)
    run(flags(0, 1, 1), 0)               # written, not committed, run again
    assert len(held()) == 2

    class Killed(Exception):
        pass

    def killed_once(batch, epoch, state=[]):
        run(batch, epoch)
        if epoch == 0 and not state:
            state.append(1)
            raise Killed("between write and commit")

    src, check = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "ck")
    flags(5, 6).coalesce(1).write.parquet(src)
    box = os.path.join(tmpdir_path, "box2")
    run = outbox_batch(box, "stream", log)

    def start():
        s = spark.readStream.schema(flags().schema).parquet(src)
        return s.writeStream.foreachBatch(killed_once).option("checkpointLocation", check).trigger(availableNow=True).start()

    import pytest
    with pytest.raises(Exception, match="between write and commit"):
        start().awaitTermination()
    assert len(held()) == 2
    start().awaitTermination()
    assert len(held()) == 2
    # a later epoch holds neither what an earlier one sent nor what the log says was delivered
    reference = f"latency_p95_ms|{(day + dt.timedelta(days=8)).strftime('%Y-%m-%dT%H:%M:%S')}|1440"
    done = {"alert_type": "threshold", "reference_id": reference, "success": True}
    spark.createDataFrame([tuple(done.get(f.name) for f in ALERT_LOG.fields)], ALERT_LOG).write.parquet(log)
    flags(6, 7, 8).coalesce(1).write.mode("append").parquet(src)
    start().awaitTermination()
    assert len(held()) == 3


def test_bad_lines_go_to_a_side_table(spark, tmpdir_path):
    """Good events pass; the two bad lines come out with their file, also when an epoch runs again."""
    from tracewise.streaming.jobs import event_stream, routed_batches
    log, bad, good = (os.path.join(tmpdir_path, x) for x in ("log", "bad", "good"))
    os.makedirs(log)
    line = '{{"event_id": "{}", "trace_id": "t", "stage_name": "s", "timestamp_start": "2024-01-01T00:00:00Z", "latency_ms": 1.5}}'
    for name, lines in (("a.json", [line.format("1"), "{not json", line.format("2")]), ("b.json", ["", line.format("3"), "[1"])):
        with open(os.path.join(log, name), "w") as f:
            f.write("\n".join(lines) + "\n")
    body = routed_batches(bad, lambda df, epoch: df.write.mode("overwrite").parquet(f"{good}/epoch={epoch}"))

    def twice(df, epoch):
        body(df, epoch)
        body(df, epoch)

    q = (event_stream(spark, log, max_files_per_trigger=1, with_corrupt=True).writeStream.foreachBatch(twice)
         .option("checkpointLocation", os.path.join(tmpdir_path, "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.parquet(good).collect()
    assert sorted((r.event_id, r.latency_ms) for r in rows) == [("1", 1.5), ("2", 1.5), ("3", 1.5)]
    assert sorted((r.line, os.path.basename(r._file), r._block_start) for r in spark.read.parquet(bad).collect()) == [
        ("[1", "b.json", 0), ("{not json", "a.json", 0)]


def test_stream_sync_of_buckets_equals_the_full_form(spark, tmpdir_path):
    from tracewise.streaming.jobs import sync_traces_batch
    ev, path = _write_events(spark, tmpdir_path)
    table = os.path.join(tmpdir_path, "table")
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    q = (stream.writeStream.foreachBatch(sync_traces_batch(table, 8)).option("checkpointLocation", os.path.join(tmpdir_path, "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(table).drop("bucket")
    want = assemble_traces(spark.read.parquet(path)).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
