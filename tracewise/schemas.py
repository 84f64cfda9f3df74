"""Declared schemas of the stage-event log and the seven analytic tables.

Nothing is inferred: every reader and sink uses these StructTypes.  JSON
payload columns (input/output summaries, metadata) stay JSON strings and are
read with ``get_json_object`` / ``from_json`` where needed, because their
shape differs per stage.
"""

from pyspark.sql import types as T

S, D, I, L, B, TS = (T.StringType(), T.DoubleType(), T.IntegerType(),
                     T.LongType(), T.BooleanType(), T.TimestampType())


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


# One row per pipeline stage call (the JSON-lines event log).
STAGE_EVENT = T.StructType([
    _f("event_id", S, False), _f("trace_id", S, False), _f("query_id", S),
    _f("stage_name", S, False), _f("timestamp_start", TS, False),
    _f("timestamp_end", TS, False), _f("latency_ms", D, False),
    _f("status", S, False), _f("input_summary", S), _f("output_summary", S),
    _f("metadata", S), _f("error", S),
])

TRACE = T.StructType([
    _f("trace_id", S, False), _f("query_id", S), _f("started_at", TS),
    _f("ended_at", TS), _f("total_latency_ms", D), _f("num_stages", I),
    _f("slowest_stage", S), _f("slowest_stage_latency_ms", D),
    _f("has_error", B), _f("error_stage", S),
])

TRACE_EVENT = T.StructType([
    _f("event_id", S, False), _f("trace_id", S, False), _f("stage_name", S),
    _f("stage_order", I), _f("timestamp_start", TS), _f("timestamp_end", TS),
    _f("latency_ms", D), _f("status", S), _f("error", S),
    _f("input_summary", S), _f("output_summary", S), _f("metadata", S),
])

METRIC_POINT = T.StructType([
    _f("window_start", TS, False), _f("window_end", TS, False),
    _f("window_minutes", I, False), _f("metric_name", S, False), _f("value", D),
])

EVALUATION = T.StructType([
    _f("id", L), _f("trace_id", S, False), _f("evaluator_name", S, False),
    _f("score", D), _f("reasoning", S), _f("skipped", B), _f("created_at", TS),
])

REGRESSION = T.StructType([
    _f("id", L), _f("metric_name", S, False), _f("method", S, False),
    _f("severity", S), _f("window_start", TS, False), _f("window_minutes", I),
    _f("baseline_value", D), _f("current_value", D), _f("delta_pct", D),
    _f("description", S), _f("detected_at", TS),
])

RCA_REPORT = T.StructType([
    _f("id", L), _f("window_start", TS, False), _f("window_minutes", I),
    _f("regression_ids", T.ArrayType(L)), _f("root_cause_category", S),
    _f("confidence", S), _f("summary", S), _f("created_at", TS),
])

ALERT_LOG = T.StructType([
    _f("id", L), _f("alert_type", S, False), _f("reference_id", S, False),
    _f("success", B, False), _f("error", S), _f("sent_at", TS),
])

DETECTION_CONFIG = T.StructType([
    _f("metric_name", S, False), _f("threshold", D, False), _f("direction", S),
])

# Column subsets written by the star-schema export, per table.
EXPORT_COLUMNS = {
    "traces": ["trace_id", "query_id", "started_at", "ended_at", "total_latency_ms",
               "num_stages", "slowest_stage", "slowest_stage_latency_ms",
               "has_error", "error_stage"],
    "trace_events": ["event_id", "trace_id", "stage_name", "stage_order",
                     "timestamp_start", "timestamp_end", "latency_ms", "status", "error"],
    "metrics_timeseries": ["id", "window_start", "window_end", "window_minutes",
                           "metric_name", "value"],
    "evaluations": ["id", "trace_id", "evaluator_name", "score", "reasoning",
                    "skipped", "created_at"],
    "regressions": ["id", "metric_name", "method", "severity", "window_start",
                    "window_minutes", "baseline_value", "current_value", "delta_pct",
                    "description", "detected_at"],
    "rca_reports": ["id", "window_start", "root_cause_category", "confidence",
                    "summary", "created_at"],
    "rca_regression_bridge": ["rca_report_id", "regression_id"],
}
