import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracewise.functions.timefns import floor_to_window
from tracewise.operators.metrics import metrics_long, replace_windows, window_trace_metrics
from tracewise.operators.ranking import exact_percentiles


def test_exact_percentiles_match_pandas_with_hot_group(spark):
    rng = np.random.default_rng(7)
    g = np.where(rng.random(5000) < 0.6, "hot", rng.choice(["a", "b", "c"], 5000))
    v = np.round(rng.gamma(2.0, 300.0, 5000), 2)
    pdf = pd.DataFrame({"g": g, "v": v})
    pdf.loc[pdf.index[:5], "v"] = np.nan
    frame = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = {r.g: r for r in exact_percentiles(frame, ["g"], "v", {"p50": .5, "p95": .95, "p99": .99}).collect()}
    for key, grp in pdf.dropna().groupby("g"):
        for name, q in (("p50", .5), ("p95", .95), ("p99", .99)):
            assert abs(getattr(got[key], name) - grp.v.quantile(q)) < 1e-9


def test_exact_percentiles_equal_spark(spark):
    rng = np.random.default_rng(11)
    probs = {f"p{i}": p for i, p in enumerate((0.0, .01, .25, .5, .9, .99, 1.0))}
    v = np.concatenate([rng.normal(0, 1e-3, 500), rng.normal(0, 1e9, 500), np.repeat([7.25, -1.5, 0.0], 300),
                        [np.inf, -np.inf, 5e-324, -5e-324]])
    rows = [(str(k) if k else None, float(x)) for k, x in zip(rng.integers(0, 4, len(v)), v)]
    df = spark.createDataFrame(rows + [("none", None), ("one", 3.5)], "g string, v double")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", probs).collect()}
    want = {r.g: r for r in df.where("v is not null").groupBy("g").agg(
        *[F.percentile("v", F.lit(p)).alias(name) for name, p in probs.items()]).collect()}
    assert got.keys() == want.keys() and "none" not in got and None in got
    for g, r in want.items():
        assert [str(getattr(got[g], n)) for n in probs] == [str(r[n]) for n in probs]
    both = {r.g: r for r in exact_percentiles(df, ["g"], "v", {"p": .5}, sums={"n": F.lit(1), "big": (F.col("v") > 1).cast("int")}).collect()}
    assert both["none"].n == 1 and both["none"].p is None and both["none"].big is None
    assert both[None].n == sum(g is None for g, _ in rows) and both["one"].p == 3.5


def test_equal_values_are_counted_before_they_meet(spark):
    """A million equal values are read by many tasks; each sends one row on. Nothing runs while planning."""
    spark.sparkContext.setJobGroup("percentile-plan", "planning")
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit("k").alias("g"), F.lit(2.5).alias("v"))
    out = exact_percentiles(df, ["g"], "v", {"p50": .5, "p99": .99})
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("percentile-plan")
    spark.sparkContext.setJobGroup("percentile-run", "running")
    r = out.first()
    assert (r.p50, r.p99) == (2.5, 2.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_count(" in plan and "percentile(" not in plan


def test_window_floor_epoch_aligned(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 7, 12, 13, 7, 59),)], "ts timestamp_ntz")
    r = df.select(floor_to_window("ts", 5).alias("a"), floor_to_window("ts", 7).alias("b"),
                  floor_to_window("ts", 1440).alias("c")).first()
    assert r.a == dt.datetime(2026, 7, 12, 13, 5)
    assert r.c == dt.datetime(2026, 7, 12)
    minutes = int((dt.datetime(2026, 7, 12, 13, 7, 59) - dt.datetime(1970, 1, 1)).total_seconds() // 60)
    assert r.b == dt.datetime(1970, 1, 1) + dt.timedelta(minutes=minutes // 7 * 7)


def _traces(spark):
    rows = [("t1", dt.datetime(2026, 7, 12, 0, 1), 100.0, False),
            ("t2", dt.datetime(2026, 7, 12, 0, 2), 300.0, True),
            ("t3", dt.datetime(2026, 7, 12, 1, 0), 200.0, False)]
    return spark.createDataFrame(rows, "trace_id string, started_at timestamp_ntz, "
                                       "total_latency_ms double, has_error boolean")


def test_window_trace_metrics(spark):
    m = {(r.window_minutes, r.window_start): r for r in window_trace_metrics(_traces(spark)).collect()}
    d = m[(1440, dt.datetime(2026, 7, 12))]
    assert d.trace_count == 3.0 and abs(d.error_rate_pct - 100 / 3) < 1e-12
    assert d.latency_p50_ms == 200.0 and abs(d.latency_p95_ms - 290.0) < 1e-9
    h = m[(60, dt.datetime(2026, 7, 12))]
    assert h.trace_count == 2.0 and h.error_rate_pct == 50.0 and h.latency_p50_ms == 200.0


def test_replace_windows(spark):
    long = metrics_long(_traces(spark))
    fresh = long.where(F.col("window_minutes") == 60)
    stale = long.withColumn("value", F.lit(-1.0))
    out = replace_windows(stale, fresh)
    assert out.count() == long.count()
    assert out.where((F.col("window_minutes") == 60) & (F.col("value") == -1.0)).count() == 0
    assert out.where((F.col("window_minutes") == 5) & (F.col("value") == -1.0)).count() > 0
