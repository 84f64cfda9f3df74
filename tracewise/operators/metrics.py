"""Windowed metrics (A5-A8, W1) and their idempotent store (K4).

All window sizes are computed in one pass: each trace is exploded once per
size and the size becomes part of the group key.  Percentiles are exact
(linear interpolation) and distributed: see ``ranking.exact_percentiles``.
Stage means pre-aggregate events per (trace, stage) before the join to the
traces, so the events side of the join shrinks to at most one row per
(trace, stage) -- also for a trace holding a third of all events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.timefns import add_minutes, floor_to_window
from tracewise.operators.ranking import exact_percentiles
from tracewise.sources.lookups import DEFAULT_WINDOWS_MINUTES, STAGE_METRIC_PREFIX

TRACE_METRICS = ["trace_count", "error_rate_pct", "latency_p50_ms", "latency_p95_ms",
                 "latency_p99_ms"]
PERCENTILES = {"latency_p50_ms": 0.50, "latency_p95_ms": 0.95, "latency_p99_ms": 0.99}


def _explode_windows(df: DataFrame, ts_col: str, windows: list[int]) -> DataFrame:
    sizes = F.explode(F.array(*[F.lit(int(w)) for w in windows]))
    d = df.withColumn("window_minutes", sizes)
    return d.withColumn("window_start", floor_to_window(F.col(ts_col), F.col("window_minutes")))


def window_trace_metrics(traces: DataFrame, windows: list[int] | None = None) -> DataFrame:
    """A5: per (window_minutes, window_start): trace_count, error_rate_pct and
    exact latency p50/p95/p99 of the traces started in the window (wide)."""
    windows = windows or DEFAULT_WINDOWS_MINUTES
    t = _explode_windows(traces.select("started_at", "total_latency_ms", "has_error"),
                         "started_at", windows)
    keys = ["window_minutes", "window_start"]
    m = exact_percentiles(t, keys, "total_latency_ms", PERCENTILES,
                          sums={"n": F.lit(1), "errors": F.col("has_error").cast("int")})
    # an empty latency series reads 0.0, like the reference
    return m.select(*keys, F.col("n").cast("double").alias("trace_count"),
                    (F.col("errors") / F.col("n") * 100.0).alias("error_rate_pct"),
                    *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in PERCENTILES])


def window_stage_means(events: DataFrame, traces: DataFrame,
                       windows: list[int] | None = None) -> DataFrame:
    """Mean stage latency per (window, stage); an event belongs to the
    window of its trace's start.  Events whose trace is unknown drop out."""
    windows = windows or DEFAULT_WINDOWS_MINUTES
    per_trace_stage = (events.groupBy("trace_id", "stage_name")
                       .agg(F.sum("latency_ms").alias("s"), F.count("latency_ms").alias("c")))
    joined = per_trace_stage.join(traces.select("trace_id", "started_at"), "trace_id")
    t = _explode_windows(joined, "started_at", windows)
    return (t.groupBy("window_minutes", "window_start", "stage_name")
            .agg((F.sum("s") / F.sum("c")).alias("value"))
            .select("window_minutes", "window_start",
                    F.concat(F.lit(STAGE_METRIC_PREFIX), F.col("stage_name")).alias("metric_name"),
                    "value"))


def metrics_long(traces: DataFrame, events: DataFrame | None = None,
                 windows: list[int] | None = None) -> DataFrame:
    """Metric points in long form (window_start, window_end,
    window_minutes, metric_name, value): the unpivoted trace metrics plus
    the stage means."""
    wide = window_trace_metrics(traces, windows)
    long = wide.unpivot(["window_minutes", "window_start"], TRACE_METRICS,
                        "metric_name", "value")
    if events is not None:
        long = long.unionByName(window_stage_means(events, traces, windows))
    return long.select("window_start",
                       add_minutes(F.col("window_start"), F.col("window_minutes")).alias("window_end"),
                       F.col("window_minutes").cast("int").alias("window_minutes"),
                       "metric_name", F.col("value").cast("double").alias("value"))


def replace_windows(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """K4: the new state of the metric table after recomputing the windows in
    ``fresh``: every stored row of a recomputed (window_start,
    window_minutes) is replaced, other windows are kept as they are."""
    keys = ["window_start", "window_minutes"]
    recomputed = fresh.select(*keys).distinct()
    kept = stored.join(recomputed, keys, "left_anti")
    return kept.unionByName(fresh.select(*stored.columns))
