"""Regression detection on metric series (W2-W7) and keep-first store (K3).

A series is one (metric_name, window_minutes) partition ordered by
window_start: one row per window, so a partition is bounded by the number of
windows, never by the raw data.  Threshold, z-score and trend run on one
shared window spec in one pass over the metric table -- no per-metric loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.fmt import fixed, pystr
from tracewise.operators.ids import dense_ids

METHOD_RANK = {"threshold": 0, "zscore": 1, "trend": 2}
OUT_COLS = ["metric_name", "method", "severity", "window_start", "window_minutes",
            "baseline_value", "current_value", "delta_pct", "description"]


def metric_series(metrics: DataFrame, window_minutes: int | None = None,
                  metric_names: list[str] | DataFrame | None = None) -> DataFrame:
    """Points of the chosen window size and metrics, with their
    0-based position in the series."""
    m = metrics
    if window_minutes is not None:
        m = m.where(F.col("window_minutes") == window_minutes)
    if isinstance(metric_names, DataFrame):
        m = m.join(F.broadcast(metric_names.select("metric_name").distinct()), "metric_name",
                   "left_semi")
    elif metric_names is not None:
        m = m.where(F.col("metric_name").isin(list(metric_names)))
    w = Window.partitionBy("metric_name", "window_minutes").orderBy("window_start")
    return m.withColumn("series_pos", (F.row_number().over(w) - 1).cast("int"))


def detect_threshold(metrics: DataFrame, config: DataFrame,
                     window_minutes: int | None = None) -> DataFrame:
    """Strict breach of a fixed threshold; direction 'above' means
    value > threshold, any other direction value < threshold."""
    m = metrics if window_minutes is None else metrics.where(F.col("window_minutes") == window_minutes)
    cfg = config.withColumn("_cfg_pos", F.monotonically_increasing_id())
    j = m.join(F.broadcast(cfg), "metric_name")
    above = F.coalesce(F.col("direction"), F.lit("above")) == "above"
    hit = F.when(above, F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    desc = F.concat(F.col("metric_name"), F.lit("="), fixed("value", 2),
                    F.lit(" breached fixed threshold "), pystr("threshold"),
                    F.lit(" ("), F.coalesce(F.col("direction"), F.lit("above")), F.lit(")."))
    return j.where(hit).select(
        "metric_name", F.lit("threshold").alias("method"), F.lit("critical").alias("severity"),
        "window_start", "window_minutes", F.col("threshold").alias("baseline_value"),
        F.col("value").alias("current_value"), F.lit(None).cast("double").alias("delta_pct"),
        desc.alias("description"), "_cfg_pos")


def _series_stats(metrics: DataFrame, names: DataFrame, window_minutes, lookback: int) -> DataFrame:
    m = metrics if window_minutes is None else metrics.where(F.col("window_minutes") == window_minutes)
    m = m.join(F.broadcast(names), "metric_name", "left_semi")
    w = Window.partitionBy("metric_name", "window_minutes").orderBy("window_start")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("metric_name", "window_minutes")
    return (m.withColumn("_n_before", F.count("value").over(before))
             .withColumn("_mean", F.avg("value").over(before))
             .withColumn("_sd", F.stddev_pop("value").over(before))
             .withColumn("_first", F.lag("value", lookback - 1).over(w))
             .withColumn("_rn", F.row_number().over(w))
             .withColumn("_len", F.count(F.lit(1)).over(whole)))


def detect_zscore(stats: DataFrame, z_thresh: float = 2.0, min_baseline_points: int = 3) -> DataFrame:
    """|value - mean| / pstdev >= z over all earlier points of the
    series (expanding baseline), once at least ``min_baseline_points`` exist
    and the stdev is not 0."""
    z = (F.col("value") - F.col("_mean")) / F.col("_sd")
    s = (stats.where((F.col("_n_before") >= min_baseline_points) & (F.col("_sd") != 0))
              .withColumn("_z", z)
              .where(F.abs(F.col("_z")) >= z_thresh))
    delta = F.when(F.col("_mean") != 0, (F.col("value") - F.col("_mean")) / F.col("_mean") * 100.0)
    desc = F.concat(F.col("metric_name"), F.lit("="), fixed("value", 2), F.lit(" is "),
                    fixed("_z", 2), F.lit(" std devs from baseline mean "),
                    fixed("_mean", 2), F.lit("."))
    return s.select(
        "metric_name", F.lit("zscore").alias("method"),
        F.when(F.abs(F.col("_z")) >= 3, "critical").otherwise("warning").alias("severity"),
        "window_start", "window_minutes", F.col("_mean").alias("baseline_value"),
        F.col("value").alias("current_value"), delta.alias("delta_pct"), desc.alias("description"),
        F.lit(0).cast("long").alias("_cfg_pos"))


def detect_trend(stats: DataFrame, lookback: int = 5, min_change_pct: float = 10.0) -> DataFrame:
    """Last window vs the window ``lookback - 1`` rows before it; flagged
    when the move is at least ``min_change_pct`` percent either way."""
    last = stats.where((F.col("_rn") == F.col("_len")) & (F.col("_len") >= lookback)
                       & (F.col("_first") != 0))
    pct = (F.col("value") - F.col("_first")) / F.col("_first") * 100.0
    s = last.withColumn("_pct", pct).where(F.abs(F.col("_pct")) >= min_change_pct)
    desc = F.concat(F.col("metric_name"), F.lit(" moved "), fixed("_pct", 1, plus=True),
                    F.lit(f"% over the last {lookback} windows ("), fixed("_first", 2),
                    F.lit(" -> "), fixed("value", 2), F.lit(")."))
    return s.select(
        "metric_name", F.lit("trend").alias("method"), F.lit("warning").alias("severity"),
        "window_start", "window_minutes", F.col("_first").alias("baseline_value"),
        F.col("value").alias("current_value"), F.col("_pct").alias("delta_pct"),
        desc.alias("description"), F.lit(0).cast("long").alias("_cfg_pos"))


def detect_flags(metrics: DataFrame, config: DataFrame, window_minutes: int | None = 1440,
                 z_thresh: float = 2.0, min_baseline_points: int = 3,
                 lookback: int = 5, min_change_pct: float = 10.0) -> DataFrame:
    """All raw flags: thresholds per config row, z-score and trend per
    distinct configured metric (duplicates across config rows kept)."""
    names = config.select("metric_name").distinct()
    # all three methods read the same windowed series rows: one row per
    # (configured metric, window), so caching it is cheap; the cache is
    # recomputed from lineage if an executor is lost
    stats = _series_stats(metrics, names, window_minutes, lookback).cache()
    return (detect_threshold(stats, config)
            .unionByName(detect_zscore(stats, z_thresh, min_baseline_points))
            .unionByName(detect_trend(stats, lookback, min_change_pct)))


def _method_rank():
    return (F.when(F.col("method") == "threshold", 0)
            .when(F.col("method") == "zscore", 1).otherwise(2))


def keep_first(flags: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """K3: one flag per (metric_name, method, window_start, window_minutes),
    the first in detection order, minus keys already stored."""
    key = ["metric_name", "method", "window_start", "window_minutes"]
    w = Window.partitionBy(*key).orderBy("_cfg_pos")
    f = flags.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).drop("_k")
    if existing is not None:
        f = f.join(existing.select(*key).distinct(), key, "left_anti")
    return f


def with_regression_ids(flags: DataFrame, start_id=0) -> DataFrame:
    """Ids in the order (metric_name, method threshold<zscore<trend,
    window_start, window_minutes), starting after ``start_id`` (a number or a column)."""
    f = flags.withColumn("_mr", _method_rank())
    f = dense_ids(f, "metric_name", ["_mr", "window_start", "window_minutes"])
    return f.withColumn("id", (F.col("id") + F.lit(start_id)).cast("long")).drop("_mr")


def detect_all(metrics: DataFrame, config: DataFrame, window_minutes: int | None = 1440,
               existing: DataFrame | None = None, **kw) -> DataFrame:
    """W6 + K3: the regression rows a run would store.  Ids go on after the
    highest one of ``existing``."""
    flags = keep_first(detect_flags(metrics, config, window_minutes, **kw), existing)
    start = 0 if existing is None else existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    return with_regression_ids(flags, start).select("id", *OUT_COLS)
