"""Golden tests: the eight seeded days of the reference export (7 stable days
and one injected regression) must give its 11 flags and 3 reports."""
import datetime as dt

from pyspark.sql import functions as F

from tracewise.operators.rca import bridge, diagnose, rca_reports, upsert_reports
from tracewise.operators.regression import detect_all
from tracewise.sources.lookups import detection_config

# (day of July 2026, error_rate_pct, latency_p95_ms, chromadb stage mean) from the export
SEEDED = [(1, 2.045, 41.58, 11.568), (2, 1.911, 46.703, 12.339), (3, 2.125, 42.026, 11.85),
          (4, 1.85, 42.974, 12.01), (5, 1.848, 42.832, 12.288), (6, 2.014, 42.987, 12.171),
          (7, 2.099, 41.447, 12.587), (8, 34.0, 210.0, 165.0)]
STAGE = "stage_latency_avg_ms:chromadb_retrieval"


def metrics(spark):
    rows = []
    for d, e, p, s in SEEDED:
        ws = dt.datetime(2026, 7, d)
        for name, v in (("error_rate_pct", e), ("latency_p95_ms", p), (STAGE, s)):
            rows.append((ws, ws + dt.timedelta(days=1), 1440, name, v))
    return spark.createDataFrame(rows, "window_start timestamp_ntz, window_end timestamp_ntz, "
                                       "window_minutes int, metric_name string, value double")


def test_detection_matches_export(spark):
    reg = detect_all(metrics(spark), detection_config(spark), 1440)
    got = {(r.metric_name, r.method, r.window_start.day): r for r in reg.collect()}
    assert len(got) == 11
    r = got[("error_rate_pct", "threshold", 8)]
    assert r.severity == "critical" and r.delta_pct is None
    assert r.description == "error_rate_pct=34.00 breached fixed threshold 10.0 (above)."
    r = got[(STAGE, "zscore", 7)]
    assert r.severity == "warning" and abs(r.baseline_value - 12.037666666666667) < 1e-12
    assert r.description == f"{STAGE}=12.59 is 2.06 std devs from baseline mean 12.04."
    r = got[("error_rate_pct", "zscore", 4)]       # a drop is flagged too (|z| = 2.00)
    assert r.description == "error_rate_pct=1.85 is -2.00 std devs from baseline mean 2.03."
    r = got[("latency_p95_ms", "trend", 8)]
    assert r.description == ("latency_p95_ms moved +388.7% over the last 5 windows "
                             "(42.97 -> 210.00).")
    assert abs(got[(STAGE, "trend", 8)].delta_pct - 1273.8551207327228) < 1e-9
    assert got[("latency_p95_ms", "zscore", 8)].description.endswith(
        "is 101.17 std devs from baseline mean 42.94.")


def test_rca_matches_export(spark):
    reg = detect_all(metrics(spark), detection_config(spark), 1440)
    rep = {r.window_start.day: r for r in rca_reports(reg).collect()}
    assert rep[4].root_cause_category == "error_rate_isolated"
    assert rep[4].summary.startswith("Error rate spiked to 1.9% without an accompanying latency")
    assert rep[7].root_cause_category == "unmatched_pattern" and rep[7].confidence == "low"
    assert rep[7].summary.startswith(f"Regression(s) detected on {STAGE} but the pattern")
    assert rep[8].root_cause_category == "stage_latency:chromadb_retrieval"
    assert rep[8].confidence == "high"
    assert rep[8].summary.startswith("Overall trace latency (p95) regressed by +388.7%. The "
                                     "'chromadb_retrieval' stage's average latency regressed by "
                                     "+1273.9% in the same window")
    assert bridge(rca_reports(reg)).count() == 11


def test_rca_null_delta_and_reruns(spark):
    # a window with only a threshold flag on p95: delta is null -> 'n/a'
    ws = dt.datetime(2026, 7, 9)
    reg = spark.createDataFrame(
        [(1, "latency_p95_ms", "threshold", "critical", ws, 1440, 100.0, 150.0, None, "x")],
        "id long, metric_name string, method string, severity string, window_start timestamp_ntz, "
        "window_minutes int, baseline_value double, current_value double, delta_pct double, "
        "description string")
    r = diagnose(reg).first()
    assert r.root_cause_category == "latency_isolated"
    assert r.summary.startswith("Overall latency regressed by n/a% without")
    stored = rca_reports(reg).withColumn("summary", F.lit("old"))
    fresh = rca_reports(reg)
    assert upsert_reports(stored, fresh).first().summary == "old"
    assert upsert_reports(stored, fresh, force=True).first().summary != "old"


def _series(spark, name, values, start_day=1):
    rows = []
    for i, v in enumerate(values):
        ws = dt.datetime(2026, 6, start_day + i)
        rows.append((ws, ws + dt.timedelta(days=1), 1440, name, float(v)))
    return spark.createDataFrame(rows, "window_start timestamp_ntz, window_end timestamp_ntz, "
                                       "window_minutes int, metric_name string, value double")


def test_detection_edge_cases(spark):
    cfg = detection_config(spark, [("flat", 5.0, "above"), ("zero_first", 100.0, "below"),
                                   ("short", 3.0, "above"), ("short", 1.0, "above")])
    m = (_series(spark, "flat", [5, 5, 5, 5, 5, 5])                    # stdev 0, threshold equal
         .unionByName(_series(spark, "zero_first", [0, 1, 1, 1, 50]))  # trend base 0
         .unionByName(_series(spark, "short", [1, 2, 4, 8])))          # 4 points
    got = {(r.metric_name, r.method, r.window_start.day): r
           for r in detect_all(m, cfg, 1440).collect()}
    assert not any(k[0] == "flat" for k in got)            # no z-score on stdev 0, no '>' on equal
    assert not any(k[0] == "zero_first" and k[1] == "trend" for k in got)
    below = [k for k in got if k[0] == "zero_first" and k[1] == "threshold"]
    assert len(below) == 5                                  # 'below' flags every value < 100
    assert not any(k[0] == "short" and k[1] == "trend" for k in got)   # fewer than 5 points
    # two configs on one metric: one flag per window, the first config's wins when both fire
    short = {k[2]: got[k] for k in got if k[0] == "short" and k[1] == "threshold"}
    assert sorted(short) == [2, 3, 4]
    assert short[4].baseline_value == 3.0 and short[2].baseline_value == 1.0
    # a stored flag is not inserted again
    again = detect_all(m, cfg, 1440, existing=detect_all(m, cfg, 1440))
    assert again.count() == 0
