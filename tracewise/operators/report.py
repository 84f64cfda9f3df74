"""Report and BI queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.text import payload_summary, typed_summary
from tracewise.operators.evaluate import Registry, measure_means
from tracewise.operators.ranking import exact_percentiles

# ---- fixed values: dashboard status labels --------------------------------
STATUS_ERROR_LABEL = "❌ error"
STATUS_OK_LABEL = "✅ success"
# ---------------------------------------------------------------------------


def kpi_overview(events: DataFrame) -> DataFrame:
    """A3: traces, events, mean trace latency and error percentage, from the
    per-trace rollup of the event log (one global aggregate)."""
    per_trace = events.groupBy("trace_id").agg(
        F.sum("latency_ms").alias("lat"), F.max(F.col("status") == "error").alias("err"),
        F.count(F.lit(1)).alias("n"))
    return per_trace.agg(
        F.count(F.lit(1)).alias("total_traces"), F.sum("n").alias("total_events"),
        F.avg("lat").alias("avg_trace_latency_ms"),
        (F.sum(F.col("err").cast("long")) / F.count(F.lit(1)) * 100.0).alias("error_rate_pct"))


def stage_avg_latency(events: DataFrame) -> DataFrame:
    """A4: mean latency per stage, slowest first."""
    return (events.groupBy("stage_name").agg(F.avg("latency_ms").alias("avg_latency_ms"))
            .orderBy(F.col("avg_latency_ms").desc(), "stage_name"))


def summary_stats(traces: DataFrame, evaluations: DataFrame, regressions: DataFrame,
                  reports: DataFrame) -> DataFrame:
    """The five counts of the report header as one row."""
    t = traces.agg(F.count(F.lit(1)).alias("total_traces"),
                   F.count(F.when(F.col("has_error"), 1)).alias("error_traces"))
    e = evaluations.agg(F.count(F.lit(1)).alias("total_evaluations"))
    r = regressions.agg(F.count(F.lit(1)).alias("total_regressions"))
    c = reports.agg(F.count(F.lit(1)).alias("total_rca_reports"))
    # four one-row aggregates side by side
    return t.crossJoin(e).crossJoin(r).crossJoin(c).select(
        "total_traces", "total_evaluations", "total_regressions", "total_rca_reports", "error_traces")


def bi_measures(traces: DataFrame, evaluations: DataFrame, regressions: DataFrame,
                evaluators: Registry | None = None) -> DataFrame:
    """BI measures: mean latency, error rate as a ratio, inclusive P95
    (exact, distributed), mean faithfulness / relevance (and what else
    ``evaluators`` measure), count of critical regressions."""
    t = traces.agg(F.avg("total_latency_ms").alias("avg_trace_latency_ms"),
                   (F.count(F.when(F.col("has_error"), 1)) / F.count(F.lit(1))).alias("error_rate"))
    p = exact_percentiles(traces.withColumn("_all", F.lit(1)), ["_all"], "total_latency_ms",
                          {"p95_trace_latency_ms": 0.95}).drop("_all")
    e = evaluations.agg(*measure_means(evaluators))
    r = regressions.agg(F.count(F.when(F.col("severity") == "critical", 1))
                        .alias("critical_regression_count"))
    return t.crossJoin(p).crossJoin(e).crossJoin(r)


def stage_status_breakdown(events: DataFrame) -> DataFrame:
    """Events per stage split by status (fixed pivot values: one pass)."""
    return (events.groupBy("stage_name").pivot("status", ["success", "error"])
            .agg(F.count(F.lit(1))).na.fill(0, ["success", "error"]))


def recent_traces(traces: DataFrame, limit: int = 20) -> DataFrame:
    """Newest traces (top-k, TakeOrdered)."""
    return traces.orderBy(F.col("started_at").desc(), F.col("trace_id")).limit(limit)


def worst_recent_traces(traces: DataFrame, recent: int = 200, top_n: int = 10) -> DataFrame:
    """The ``recent`` newest traces, then the ``top_n`` slowest of them."""
    return (recent_traces(traces, recent)
            .orderBy(F.col("total_latency_ms").desc(), F.col("trace_id")).limit(top_n))


def display_traces(traces: DataFrame) -> DataFrame:
    """Display projection: short id and status label."""
    return traces.select(
        F.concat(F.substring("trace_id", 1, 8), F.lit("...")).alias("trace_id_short"),
        "trace_id", "started_at", "num_stages", "total_latency_ms",
        F.when(F.col("has_error"), F.lit(STATUS_ERROR_LABEL)).otherwise(F.lit(STATUS_OK_LABEL))
         .alias("status"))


def payload_summaries(events: DataFrame, col: str = "output_summary", max_preview: int = 200) -> DataFrame:
    """Privacy-preserving summary of a payload column."""
    s = payload_summary(F.col(col), max_preview)
    return events.select("event_id", s["type"].alias("summary_type"),
                         s["length"].cast("long").alias("summary_length"),
                         s["preview"].alias("summary_preview"))


def argument_summaries(calls: DataFrame, col: str = "args", max_preview: int = 200) -> DataFrame:
    """One row per argument of every call (``col``: array of JSON texts), with its place
    and typed summary; arguments that are no JSON value (objects a method was called on) are left out."""
    # summed up inside the array: a filter after explode is evaluated on the finished summary, not on a second one
    summaries = F.transform(F.col(col), lambda arg: typed_summary(arg, max_preview))
    a = (calls.select("event_id", F.posexplode(summaries).alias("position", "s")).where(F.col("s.type") != "unknown"))
    return a.select("event_id", "position", F.col("s.type").alias("arg_type"), F.col("s.length").alias("arg_length"),
                    F.col("s.preview").alias("arg_preview"), F.col("s.keys").alias("arg_keys"),
                    F.col("s.number").alias("arg_number"), F.col("s.flag").alias("arg_flag"))
