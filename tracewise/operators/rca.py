"""Root-cause attribution per regressed window (R1-R7), report upsert (K5)
and the report/regression bridge (A20).

One ``groupBy`` over the regression table diagnoses every window at once.
All collected lists are per window and bounded by (metrics x methods).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.functions.fmt import fixed
from tracewise.operators.ids import dense_ids
from tracewise.sources.lookups import STAGE_METRIC_PREFIX

P95 = "latency_p95_ms"
ERR = "error_rate_pct"

# ---- fixed values: diagnosis sentences (text must equal the reference) ---
STAGE_SUMMARY = ("Overall trace latency (p95) regressed by {p95}%. The '{stage}' stage's "
                 "average latency regressed by {stage_delta}% in the same window, making it "
                 "the dominant contributor. Root cause: {stage} stage slowdown (e.g. cold index, "
                 "upstream API degradation, or a config change affecting that stage specifically).")
CASCADE_SUMMARY = ("Both latency (p95 {p95}%) and error rate ({err}%) regressed in the same "
                   "window. Likely a cascading failure: elevated latency is causing timeouts or "
                   "downstream errors. Treat the latency regression as primary; re-check error "
                   "rate after latency is addressed.")
ERROR_SUMMARY = ("Error rate spiked to {err}% without an accompanying latency regression. This "
                 "points to a functional bug (e.g. input validation, parsing, or an upstream "
                 "schema change) rather than a performance issue. Check recent "
                 "non-timing-related code or config changes.")
LATENCY_SUMMARY = ("Overall latency regressed by {p95}% without a clearly dominant single stage. "
                   "Check for a broad infrastructure issue (host contention, network) rather "
                   "than a single pipeline stage.")
UNMATCHED_SUMMARY = ("Regression(s) detected on {names} but the pattern doesn't match a known "
                     "rule. Manual investigation needed.")
POLISH_SKIPPED_NOTE = " [LLM polish skipped: no GEMINI_API_KEY set]"
# ---------------------------------------------------------------------------


def _template(tpl: str, **parts) -> F.Column:
    """Fill ``{name}`` slots of a fixed sentence with columns."""
    import re
    pieces, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", tpl):
        if m.start() > pos:
            pieces.append(F.lit(tpl[pos:m.start()]))
        pieces.append(parts[m.group(1)])
        pos = m.end()
    if pos < len(tpl):
        pieces.append(F.lit(tpl[pos:]))
    return F.concat(*pieces)


def evidence(regressions: DataFrame) -> DataFrame:
    """Per (window, metric) the last flag (highest id) and the first id
    (the metric's first-seen position in the window)."""
    last = F.struct("id", "delta_pct", "current_value", "method")
    return (regressions.groupBy("window_start", "window_minutes", "metric_name")
            .agg(F.max_by(last, F.col("id")).alias("last"), F.min("id").alias("first_id"))
            .select("window_start", "window_minutes", "metric_name", "first_id",
                    F.col("last.id").alias("last_id"), F.col("last.delta_pct").alias("delta_pct"),
                    F.col("last.current_value").alias("current_value"),
                    F.col("last.method").alias("method")))


def diagnose(regressions: DataFrame) -> DataFrame:
    """One diagnosis row per (window_start, window_minutes)."""
    ev = evidence(regressions)
    is_stage = F.col("metric_name").startswith(STAGE_METRIC_PREFIX)
    ids = (regressions.groupBy("window_start", "window_minutes")
           .agg(F.sort_array(F.collect_list("id")).alias("regression_ids")))
    per_window = ev.groupBy("window_start", "window_minutes").agg(
        F.max(F.col("metric_name") == P95).alias("has_p95"),
        F.max(F.col("metric_name") == ERR).alias("has_err"),
        F.max(is_stage).alias("has_stage"),
        F.max(F.when(F.col("metric_name") == P95, F.col("delta_pct"))).alias("p95_delta"),
        F.max(F.when(F.col("metric_name") == ERR, F.col("current_value"))).alias("err_current"),
        F.max_by(F.when(is_stage, F.struct("metric_name", "delta_pct")),
                 F.when(is_stage, F.struct(F.coalesce(F.col("delta_pct"), F.lit(0.0)),
                                           -F.col("first_id")))).alias("dominant"),
        F.sort_array(F.collect_list(F.struct("first_id", "metric_name"))).alias("_seen"),
    )
    stage = F.expr("substr(dominant.metric_name, instr(dominant.metric_name, ':') + 1)")
    p95 = fixed("p95_delta", 1, plus=True, none_text="n/a")
    stage_delta = fixed(F.col("dominant.delta_pct"), 1, plus=True, none_text="n/a")
    err = fixed("err_current", 1, none_text="n/a")
    names = F.array_join(F.transform("_seen", lambda s: s["metric_name"]), ", ")
    has_stage, has_p95, has_err = F.col("has_stage"), F.col("has_p95"), F.col("has_err")
    category = (F.when(has_stage & has_p95, F.concat(F.lit("stage_latency:"), stage))
                .when(has_err & has_p95, F.lit("cascading_failure"))
                .when(has_err, F.lit("error_rate_isolated"))
                .when(has_p95, F.lit("latency_isolated"))
                .otherwise(F.lit("unmatched_pattern")))
    confidence = (F.when(has_stage & has_p95, F.lit("high"))
                  .when(has_err | has_p95, F.lit("medium")).otherwise(F.lit("low")))
    summary = (F.when(has_stage & has_p95,
                      _template(STAGE_SUMMARY, p95=p95, stage=stage, stage_delta=stage_delta))
               .when(has_err & has_p95, _template(CASCADE_SUMMARY, p95=p95, err=err))
               .when(has_err, _template(ERROR_SUMMARY, err=err))
               .when(has_p95, _template(LATENCY_SUMMARY, p95=p95))
               .otherwise(_template(UNMATCHED_SUMMARY, names=names)))
    return (per_window.join(ids, ["window_start", "window_minutes"])
            .select("window_start", "window_minutes", "regression_ids",
                    category.alias("root_cause_category"), confidence.alias("confidence"),
                    summary.alias("summary")))


def rca_reports(regressions: DataFrame, polish_note: bool = False) -> DataFrame:
    """Reports for every regressed window, with ids in window order."""
    d = diagnose(regressions)
    if polish_note:
        d = d.withColumn("summary", F.concat("summary", F.lit(POLISH_SKIPPED_NOTE)))
    return dense_ids(d, "window_minutes", ["window_start"]).select(
        "id", "window_start", "window_minutes", "regression_ids", "root_cause_category",
        "confidence", "summary")


def upsert_reports(stored: DataFrame, fresh: DataFrame, force: bool = False) -> DataFrame:
    """K5: new report table.  Without ``force`` a window already reported
    keeps its report and only new windows are added; with ``force`` the
    fresh report replaces the stored one.  Stored reports keep their ids;
    added ones get the ids after the highest stored one."""
    key = ["window_start", "window_minutes"]
    if force:
        kept, added = stored.join(fresh.select(*key), key, "left_anti"), fresh
    else:
        kept, added = stored, fresh.join(stored.select(*key), key, "left_anti")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
    added = (dense_ids(added.drop("id"), "window_minutes", ["window_start"])
             .withColumn("id", (F.col("id") + top).cast("long")))
    return (kept.select(*fresh.columns).withColumn("origin", F.lit("stored"))
            .unionByName(added.select(*fresh.columns).withColumn("origin", F.lit("fresh"))))


def bridge(reports: DataFrame) -> DataFrame:
    """One (rca_report_id, regression_id) row per cited regression;
    reports without ids give none."""
    return reports.select(F.col("id").alias("rca_report_id"),
                          F.explode("regression_ids").alias("regression_id"))


def drilldown(reports: DataFrame, regressions: DataFrame) -> DataFrame:
    """Report -> bridge -> regressions."""
    b = bridge(reports)
    r = reports.select(F.col("id").alias("rca_report_id"), "root_cause_category", "confidence",
                       F.col("window_start").alias("report_window_start"))
    g = regressions.select(F.col("id").alias("regression_id"), "metric_name", "method",
                           "severity", "delta_pct", "current_value")
    return b.join(r, "rca_report_id").join(g, "regression_id")
