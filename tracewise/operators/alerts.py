"""Alert outbox (L1-L3) and the attempt log (K9).

Delivery itself (the webhook POST) is outside Spark; this module computes
what is due, the payload of each alert and the log rows of attempts.  An
alert is due while no *successful* attempt is logged for its (type,
reference); failed and skipped attempts come back on the next run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: alert payload texts and colours ------------------------
REGRESSION_TITLE = "🚨 Regression detected: "
RCA_TITLE = "🔍 Root cause: "
DIGEST_TITLE = "📊 Daily Digest"
COLOR_CRITICAL = 0xE74C3C
COLOR_WARNING = 0xF1C40F
COLOR_RCA = 0x3498DB
COLOR_DIGEST = 0x2ECC71
SUMMARY_MAX_CHARS = 2000
SKIPPED_NO_WEBHOOK = "[SKIPPED] DISCORD_WEBHOOK_URL not set"
# ---------------------------------------------------------------------------


def candidates(regressions: DataFrame, reports: DataFrame) -> DataFrame:
    """Alert candidates: every regression and report."""
    def of(kind, df):
        return df.select(F.lit(kind).alias("alert_type"), F.col("id").cast("string").alias("reference_id"))
    return of("regression", regressions).unionByName(of("rca", reports))


def outbox(cands: DataFrame, log: DataFrame) -> DataFrame:
    """L1: candidates minus (type, reference) pairs with a successful attempt."""
    sent = log.where(F.col("success")).select("alert_type", "reference_id").distinct()
    return cands.join(sent, ["alert_type", "reference_id"], "left_anti")


def _field(name: str, value, inline: bool):
    return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"),
                    F.lit(inline).alias("inline"))


def regression_payloads(due: DataFrame, regressions: DataFrame) -> DataFrame:
    """L2: JSON payload per due regression alert."""
    r = regressions.withColumn("reference_id", F.col("id").cast("string"))
    j = due.where(F.col("alert_type") == "regression").join(r, "reference_id")
    color = F.when(F.col("severity") == "critical", F.lit(COLOR_CRITICAL)).otherwise(F.lit(COLOR_WARNING))
    embed = F.struct(
        F.concat(F.lit(REGRESSION_TITLE), F.col("metric_name")).alias("title"),
        F.col("description").alias("description"), color.alias("color"),
        F.array(_field("Method", F.col("method"), True), _field("Severity", F.col("severity"), True),
                _field("Window", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), False))
         .alias("fields"))
    return j.select("alert_type", "reference_id",
                    F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("payload"))


def rca_payloads(due: DataFrame, reports: DataFrame) -> DataFrame:
    """L2: JSON payload per due report alert (summary cut to 2000 chars)."""
    r = reports.withColumn("reference_id", F.col("id").cast("string"))
    j = due.where(F.col("alert_type") == "rca").join(r, "reference_id")
    embed = F.struct(
        F.concat(F.lit(RCA_TITLE), F.col("root_cause_category")).alias("title"),
        F.substring("summary", 1, SUMMARY_MAX_CHARS).alias("description"),
        F.lit(COLOR_RCA).alias("color"),
        F.array(_field("Confidence", F.col("confidence"), True),
                _field("Window", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), True))
         .alias("fields"))
    return j.select("alert_type", "reference_id",
                    F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("payload"))


def daily_digest(traces: DataFrame, regressions: DataFrame, reports: DataFrame) -> DataFrame:
    """L3: one digest row per date (reference_id = the date) with that day's
    counts and its JSON payload."""
    t = (traces.groupBy(F.to_date("started_at").alias("day"))
         .agg(F.count(F.lit(1)).alias("total_traces"),
              F.count(F.when(F.col("has_error"), 1)).alias("error_traces")))
    r = (regressions.groupBy(F.to_date("window_start").alias("day"))
         .agg(F.count(F.lit(1)).alias("total_regressions")))
    c = (reports.groupBy(F.to_date("window_start").alias("day"))
         .agg(F.count(F.lit(1)).alias("total_rca_reports")))
    d = (t.join(r, "day", "left").join(c, "day", "left")
         .na.fill(0, ["total_regressions", "total_rca_reports"]))
    fields = F.array(*[_field(k, F.col(k), True) for k in
                       ["total_traces", "error_traces", "total_regressions", "total_rca_reports"]])
    embed = F.struct(F.lit(DIGEST_TITLE).alias("title"), F.lit(COLOR_DIGEST).alias("color"),
                     fields.alias("fields"))
    return d.select(F.lit("digest").alias("alert_type"),
                    F.date_format("day", "yyyy-MM-dd").alias("reference_id"),
                    "total_traces", "error_traces", "total_regressions", "total_rca_reports",
                    F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("payload"))


def attempt_rows(due: DataFrame, success, error=None, sent_at=None) -> DataFrame:
    """K9: log rows of a delivery attempt for every due alert."""
    return due.select("alert_type", "reference_id",
                      (success if not isinstance(success, bool) else F.lit(success)).alias("success"),
                      (error if error is not None else F.lit(None).cast("string")).alias("error"),
                      (sent_at if sent_at is not None else F.current_timestamp()).alias("sent_at"))
