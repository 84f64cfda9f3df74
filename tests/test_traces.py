import datetime as dt
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewise.operators.ranking import rank_within_groups
from tracewise.operators.traces import (assemble_traces, stage_order_violations,
                                        trace_waterfall, with_stage_order)
from tracewise.schemas import STAGE_EVENT


def T(s):
    return dt.datetime.fromisoformat(s)


def ev(eid, tid, stage, start, lat, status="success", qid=None, err=None):
    s = T(start)
    return (eid, tid, qid, stage, s, s + dt.timedelta(milliseconds=lat), float(lat), status,
            None, None, None, err)


ROWS = [
    # full trace, slowest stage tie between b and c -> first (b)
    ev("e1", "t1", "a", "2026-07-01 10:00:00", 5, qid="q1"),
    ev("e2", "t1", "b", "2026-07-01 10:00:01", 9, qid="q1"),
    ev("e3", "t1", "c", "2026-07-01 10:00:02", 9, qid="q1"),
    # failing at the first stage
    ev("e4", "t2", "a", "2026-07-01 11:00:00", 1, "error", err="boom"),
    # failing twice: first failed stage wins; the last-started event is shorter
    ev("e5", "t3", "a", "2026-07-01 12:00:00", 500),
    ev("e6", "t3", "b", "2026-07-01 12:00:00.000001", 2, "error"),
    ev("e7", "t3", "c", "2026-07-01 12:00:01", 1, "error"),
    # zero-microsecond timestamp ordered by time, not by its ISO text
    ev("e8", "t4", "x", "2026-07-01 09:00:09.800000", 1),
    ev("e9", "t4", "y", "2026-07-01 09:00:09", 1),
    # untagged events pool into one trace
    ev("e10", "untraced", "a", "2026-07-01 13:00:00", 3),
    ev("e11", "untraced", "b", "2026-07-01 13:30:00", 4),
]


def frame(spark):
    return spark.createDataFrame(ROWS, STAGE_EVENT)


def test_assemble(spark):
    out = {r.trace_id: r for r in assemble_traces(frame(spark)).collect()}
    t1 = out["t1"]
    assert t1.num_stages == 3 and t1.query_id == "q1"
    assert t1.total_latency_ms == 23.0
    assert t1.slowest_stage == "b" and t1.slowest_stage_latency_ms == 9.0
    assert not t1.has_error and t1.error_stage is None
    assert t1.ended_at == T("2026-07-01 10:00:02.009")
    t3 = out["t3"]
    assert t3.has_error and t3.error_stage == "b"
    # ended_at = end of the last-started event, not the max end
    assert t3.ended_at == T("2026-07-01 12:00:01.001")
    assert out["t4"].started_at == T("2026-07-01 09:00:09")
    assert out["untraced"].num_stages == 2
    assert "untraced" not in {r.trace_id for r in
                              assemble_traces(frame(spark), include_untraced=False).collect()}


def test_stage_order_and_violations(spark):
    so = {r.event_id: r.stage_order for r in with_stage_order(frame(spark)).collect()}
    assert so["e9"] == 0 and so["e8"] == 1          # parsed time order
    assert (so["e5"], so["e6"], so["e7"]) == (0, 1, 2)
    bad = {r.trace_id: r for r in stage_order_violations(frame(spark), ["a", "b", "c"]).collect()}
    assert "t1" not in bad and "t2" not in bad and "t3" not in bad
    assert bad["t4"].first_violation_order == 0 and bad["t4"].actual_stage == "y"


def test_waterfall(spark):
    ev_df = frame(spark)
    w = {r.event_id: r for r in trace_waterfall(ev_df, assemble_traces(ev_df)).collect()}
    assert w["e3"].cumulative_latency_ms == 23.0 and w["e3"].offset_ms == 2000.0
    assert w["e6"].offset_ms == 0.001


def test_hot_trace_ranking_spans_partitions(spark):
    # one trace with most rows: ranks stay exact when it spans partitions
    t0 = T("2026-07-01 00:00:00")
    rows = [(f"e{i:05d}", "hot" if i % 10 else f"t{i}", None, "s", t0 + dt.timedelta(seconds=i),
             t0 + dt.timedelta(seconds=i), 1.0, "success", None, None, None, None)
            for i in range(3000)]
    df = spark.createDataFrame(rows, STAGE_EVENT)
    got = with_stage_order(df).where(F.col("trace_id") == "hot") \
        .orderBy("timestamp_start").select("stage_order").collect()
    assert [r.stage_order for r in got] == list(range(len(got)))


def test_prefix_scan_equals_one_window(spark):
    # positions, sizes and running sums over many buckets, null times, null keys and null values
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["a", None]), rnd.choice([None, *range(40)]), i,
             rnd.choice([None, float(rnd.randrange(9))])) for i in range(2000)]
    df = spark.createDataFrame([(k, None if t is None else T("2026-07-01 00:00:00") + dt.timedelta(seconds=37 * t), i, v)
                                for k, t, i, v in rows], "k string, ts timestamp_ntz, id long, v double")
    spark.sparkContext.setJobGroup("rank-plan", "planning")
    got = rank_within_groups(df, ["k"], ["ts", "id"], running_sum="v")
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("rank-plan")
    spark.sparkContext.setJobGroup("rank-run", "running")
    w = Window.partitionBy("k").orderBy("ts", "id")
    want = df.select("k", "id", (F.row_number().over(w) - 1).alias("_rank"), F.count(F.lit(1)).over(Window.partitionBy("k")).alias("_n"),
                     F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_cum"))
    cols = ["k", "id", "_rank", "_n", "_cum"]
    assert sorted(map(str, got.select(*cols).collect())) == sorted(map(str, want.collect()))
    # the rows themselves are dealt by (group, bucket), never by group
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(k#\d+, _b#", plan)
