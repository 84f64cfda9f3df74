"""Trace operators: assembly (A1), light rollup (A2), stage order (W8),
stage-order check (W9), waterfall (W10), events of a trace (P3), trace
detail (J3).

Assembly uses only partial-aggregatable functions (``min_by``/``max_by``/
``sum``/``count``/``max``): every map task pre-aggregates its rows per
trace, so even a trace with a third of all events (the pooled ``untraced``
id) ships one partial row per task.  No ``collect_list`` of a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.numeric import py_round
from tracewise.operators.ranking import rank_within_groups

UNTRACED = "untraced"


def _event_order():
    # Events of a trace are ordered by start time, then event id.
    return F.struct("timestamp_start", "event_id")


def assemble_traces(events: DataFrame, include_untraced: bool = True) -> DataFrame:
    """A1: stage events -> one row per trace_id.

    query_id and started_at come from the first event; ended_at is the end of
    the last-*started* event; total latency is the rounded sum of stage
    latencies (not wall clock); the slowest stage is the first event with the
    largest latency; error_stage is the first failed stage.
    """
    if not include_untraced:
        events = events.where(F.col("trace_id") != UNTRACED)
    order = _event_order()
    slow_order = F.struct((-F.col("latency_ms")).alias("neg_latency"),
                          F.col("timestamp_start"), F.col("event_id"))
    is_err = F.col("status") == "error"
    return events.groupBy("trace_id").agg(
        F.min_by("query_id", order).alias("query_id"),
        F.min("timestamp_start").alias("started_at"),
        F.max_by("timestamp_end", order).alias("ended_at"),
        py_round(F.sum("latency_ms"), 3).alias("total_latency_ms"),
        F.count(F.lit(1)).cast("int").alias("num_stages"),
        F.min_by("stage_name", slow_order).alias("slowest_stage"),
        F.max("latency_ms").alias("slowest_stage_latency_ms"),
        F.max(is_err).alias("has_error"),
        F.min_by(F.when(is_err, F.col("stage_name")),
                 F.when(is_err, order)).alias("error_stage"),
    )


def trace_rollup(events: DataFrame) -> DataFrame:
    """A2: dashboard rollup per trace (count, latency sum, any error, first
    start), newest first."""
    return (events.groupBy("trace_id")
            .agg(F.count("stage_name").alias("num_stages"),
                 F.sum("latency_ms").alias("total_latency_ms"),
                 F.max(F.col("status") == "error").alias("has_error"),
                 F.min("timestamp_start").alias("started_at"))
            .orderBy(F.col("started_at").desc(), F.col("trace_id")))


def with_stage_order(events: DataFrame) -> DataFrame:
    """0-based position of each event in its trace by (start, event_id).

    The position is added to the rows themselves, so repeated deliveries of
    an event stay single rows.  A trace is split by minutes.
    """
    ranked = rank_within_groups(events, ["trace_id"], ["timestamp_start", "event_id"], rank_col="_r")
    return ranked.select(*events.columns, F.col("_r").cast("int").alias("stage_order"))


def stage_order_violations(events: DataFrame, expected: list[str]) -> DataFrame:
    """Traces whose fired stages are not a prefix of ``expected``.

    One row per violating trace: number of stages, the first bad position,
    what was expected there (null past the end) and what fired.
    """
    exp = F.array(*[F.lit(s) for s in expected])
    ev = with_stage_order(events)
    want = F.when(F.col("stage_order") < len(expected),
                  F.try_element_at(exp, F.col("stage_order") + 1))
    bad = want.isNull() | (want != F.col("stage_name"))
    ev = ev.withColumn("_want", want).withColumn("_bad", bad)
    agg = ev.groupBy("trace_id").agg(
        F.count(F.lit(1)).cast("int").alias("num_stages"),
        F.min(F.when(F.col("_bad"), F.col("stage_order"))).alias("first_violation_order"),
        F.min_by(F.when(F.col("_bad"), F.col("_want")),
                 F.when(F.col("_bad"), F.col("stage_order"))).alias("expected_stage"),
        F.min_by(F.when(F.col("_bad"), F.col("stage_name")),
                 F.when(F.col("_bad"), F.col("stage_order"))).alias("actual_stage"),
    )
    return agg.where(F.col("first_violation_order").isNotNull())


def trace_waterfall(events: DataFrame, traces: DataFrame) -> DataFrame:
    """Stages of every trace in start order with the offset from the
    trace start and the running latency total."""
    ranked = rank_within_groups(
        events.select("trace_id", "timestamp_start", "event_id", "stage_name", "status", "latency_ms"),
        ["trace_id"], ["timestamp_start", "event_id"], running_sum="latency_ms",
        rank_col="_r", cum_col="cumulative_latency_ms")
    starts = traces.select("trace_id", "started_at")
    offset_us = F.unix_micros(F.col("timestamp_start").cast("timestamp")) - \
        F.unix_micros(F.col("started_at").cast("timestamp"))
    return (ranked.join(starts, "trace_id")
            .select("trace_id", F.col("_r").cast("int").alias("stage_order"), "event_id",
                    "stage_name", "status", "latency_ms",
                    (offset_us / F.lit(1000.0)).alias("offset_ms"),
                    "cumulative_latency_ms"))


def events_of_trace(events: DataFrame, trace_id: str | Column | None = None) -> DataFrame:
    """Events (of one trace, or all) in start order; the id may be a scalar subquery."""
    ev = events if trace_id is None else events.where(F.col("trace_id") == trace_id)
    return ev.orderBy("timestamp_start", "event_id")


def trace_detail(traces: DataFrame, events: DataFrame, evaluations: DataFrame,
                 trace_ids: DataFrame | None = None) -> DataFrame:
    """Trace + its ordered events + its evaluations, as flat rows
    (one per event x evaluation kind is avoided: events and evaluations are
    stacked with a ``kind`` column).  Unknown ids give no rows."""
    tr = traces if trace_ids is None else traces.join(trace_ids, "trace_id", "left_semi")
    ev = with_stage_order(events).select(
        "trace_id", F.lit("event").alias("kind"), F.col("stage_order").alias("seq"),
        F.col("stage_name").alias("name"), F.col("latency_ms").alias("value"),
        F.col("status").alias("detail"))
    evl = evaluations.select(
        "trace_id", F.lit("evaluation").alias("kind"), F.lit(None).cast("int").alias("seq"),
        F.col("evaluator_name").alias("name"), F.col("score").alias("value"),
        F.col("reasoning").alias("detail"))
    parts = ev.unionByName(evl)
    return tr.select("trace_id", "started_at", "total_latency_ms", "has_error") \
             .join(parts, "trace_id")
