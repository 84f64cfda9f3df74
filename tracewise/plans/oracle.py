"""DuckDB SQL oracles of the registered queries.

Each oracle is written independently of the Spark code, straight from the
operator's definition, over the same Parquet tables.  Shared derived views
are CTE snippets composed per query.  Doubles are rounded to 6 decimals,
as in ``plans.common.finish``.
"""

from __future__ import annotations

from tracewise.functions.numeric import py_round_ratio_sql
from tracewise.functions.text import EVAL_STOPWORDS
from tracewise.operators import rca as RC
from tracewise.sources.lookups import (FAITHFULNESS_REASONING, JUDGE_SKIPPED_REASONING,
                                       RELEVANCE_REASONING)


def R(expr: str, alias: str) -> str:
    # settle to 9 decimals, then half away from zero at 6 (as plans.common.finish)
    return f"round(round(CAST({expr} AS DOUBLE), 9) * 1000000.0) / 1000000.0 AS {alias}"


def _sqlstr(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fill_sql(template: str, **cols: str) -> str:
    import re
    names = "|".join(cols)
    out, pos = [], 0
    for m in re.finditer(r"\{(" + names + r")\}", template):
        if m.start() > pos:
            out.append(_sqlstr(template[pos:m.start()]))
        out.append(f"({cols[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        out.append(_sqlstr(template[pos:]))
    return " || ".join(out)


EV = """ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id,
         CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS trace_id,
         CAST(user_id AS VARCHAR) AS query_id,
         event_type AS stage_name,
         ts AS timestamp_start,
         ts + to_microseconds(CAST(round(value * 1000) AS BIGINT)) AS timestamp_end,
         value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
         CASE WHEN event_type = 'error' THEN 'Error: ' || props END AS error,
         props AS output_summary
  FROM events)"""

TR = """tr AS (
  SELECT trace_id,
         arg_min(query_id, row(timestamp_start, event_id)) AS query_id,
         min(timestamp_start) AS started_at,
         arg_max(timestamp_end, row(timestamp_start, event_id)) AS ended_at,
         round(sum(latency_ms), 3) AS total_latency_ms,
         CAST(count(*) AS INTEGER) AS num_stages,
         arg_min(stage_name, row(-latency_ms, timestamp_start, event_id)) AS slowest_stage,
         max(latency_ms) AS slowest_stage_latency_ms,
         bool_or(status = 'error') AS has_error,
         arg_min(stage_name, row(timestamp_start, event_id)) FILTER (WHERE status = 'error') AS error_stage
  FROM ev GROUP BY trace_id)"""


def floor_sql(ts: str, minutes: str) -> str:
    step = f"(CAST({minutes} AS BIGINT) * 60000000)"
    return f"make_timestamp(epoch_us({ts}) - (((epoch_us({ts}) % {step}) + {step}) % {step}))"


TW = f"""tw AS (
  SELECT w.window_minutes, {floor_sql('t.started_at', 'w.window_minutes')} AS window_start,
         t.trace_id, t.started_at, t.total_latency_ms, t.has_error
  FROM tr t CROSS JOIN (SELECT CAST(unnest([5, 60, 1440]) AS INTEGER) AS window_minutes) w)"""

TWM = """twm AS (
  SELECT window_minutes, window_start,
         CAST(count(*) AS DOUBLE) AS trace_count,
         sum(CAST(has_error AS INTEGER)) / count(*) * 100.0 AS error_rate_pct,
         quantile_cont(total_latency_ms, 0.5) AS latency_p50_ms,
         quantile_cont(total_latency_ms, 0.95) AS latency_p95_ms,
         quantile_cont(total_latency_ms, 0.99) AS latency_p99_ms
  FROM tw GROUP BY window_minutes, window_start)"""

SWA = """swa AS (
  SELECT tw.window_minutes, tw.window_start,
         'stage_latency_avg_ms:' || ev.stage_name AS metric_name,
         avg(ev.latency_ms) AS value
  FROM ev JOIN tw ON ev.trace_id = tw.trace_id
  GROUP BY tw.window_minutes, tw.window_start, ev.stage_name)"""

MTS = """mts AS (
  SELECT window_start, window_start + to_minutes(window_minutes) AS window_end,
         window_minutes, metric_name, value
  FROM (
    SELECT window_minutes, window_start, 'trace_count' AS metric_name, trace_count AS value FROM twm
    UNION ALL SELECT window_minutes, window_start, 'error_rate_pct', error_rate_pct FROM twm
    UNION ALL SELECT window_minutes, window_start, 'latency_p50_ms', latency_p50_ms FROM twm
    UNION ALL SELECT window_minutes, window_start, 'latency_p95_ms', latency_p95_ms FROM twm
    UNION ALL SELECT window_minutes, window_start, 'latency_p99_ms', latency_p99_ms FROM twm
    UNION ALL SELECT window_minutes, window_start, metric_name, value FROM swa))"""

CFG = """cfg AS (
  SELECT * FROM (VALUES ('error_rate_pct', 45.0::DOUBLE, 'above'),
                        ('latency_p95_ms', 330.0::DOUBLE, 'above'),
                        ('stage_latency_avg_ms:purchase', 52.0::DOUBLE, 'above'))
         AS c(metric_name, threshold, direction))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE_TR = (EV, TR)
BASE_MTS = (EV, TR, TW, TWM, SWA, MTS)


def window_metrics_sql(minutes: int) -> str:
    return with_(*BASE_TR, TW, TWM) + f"""
SELECT window_start, window_minutes, {R('trace_count', 'trace_count')},
       {R('error_rate_pct', 'error_rate_pct')}, {R('latency_p50_ms', 'latency_p50_ms')},
       {R('latency_p95_ms', 'latency_p95_ms')}, {R('latency_p99_ms', 'latency_p99_ms')}
FROM twm WHERE window_minutes = {minutes}"""


SQL: dict[str, str] = {}

SQL["assemble_traces"] = with_(*BASE_TR) + f"""
SELECT trace_id, query_id, started_at, ended_at, {R('total_latency_ms', 'total_latency_ms')},
       num_stages, slowest_stage, {R('slowest_stage_latency_ms', 'slowest_stage_latency_ms')},
       has_error, error_stage
FROM tr"""

SQL["window_metrics_5m"] = window_metrics_sql(5)
SQL["window_metrics_1h"] = window_metrics_sql(60)
SQL["window_metrics_1d"] = window_metrics_sql(1440)

SQL["stage_window_avg"] = with_(*BASE_TR, TW, SWA) + f"""
SELECT window_start, window_minutes, metric_name, {R('value', 'value')} FROM swa"""

SQL["metrics_long"] = with_(*BASE_MTS) + f"""
SELECT window_start, window_end, window_minutes, metric_name, {R('value', 'value')} FROM mts"""

SQL["window_floor"] = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, ts,
       {floor_sql('ts', '5')} AS window_5m,
       {floor_sql('ts', '60')} AS window_1h,
       {floor_sql('ts', '1440')} AS window_1d,
       {floor_sql('ts', '7')} AS window_7m
FROM events"""


# ---- detection / root cause ----------------------------------------------

def mts_chain(sfx: str, tr_filter: str | None = None) -> list[str]:
    """tr{sfx} / tw{sfx} / twm{sfx} / swa{sfx} / mts{sfx} over an optional
    filter of the traces (an earlier run's view)."""
    w = f"WHERE {tr_filter}" if tr_filter else ""
    trx = f"tr{sfx} AS (SELECT * FROM tr {w})"
    twx = (TW.replace("tw AS", f"tw{sfx} AS").replace("FROM tr t", f"FROM tr{sfx} t"))
    twmx = TWM.replace("twm AS", f"twm{sfx} AS").replace("FROM tw ", f"FROM tw{sfx} ")
    swax = SWA.replace("swa AS", f"swa{sfx} AS").replace("JOIN tw ON ev.trace_id = tw.trace_id",
                                                         f"JOIN tw{sfx} tw ON ev.trace_id = tw.trace_id")
    mtsx = (MTS.replace("mts AS", f"mts{sfx} AS").replace("FROM twm", f"FROM twm{sfx}")
            .replace("FROM swa", f"FROM swa{sfx}"))
    return [trx, twx, twmx, swax, mtsx]


CFGP = """cfg AS (
  SELECT * FROM (VALUES ('error_rate_pct', 45.0::DOUBLE, 'above', 0),
                        ('latency_p95_ms', 330.0::DOUBLE, 'above', 1),
                        ('stage_latency_avg_ms:purchase', 52.0::DOUBLE, 'above', 2))
         AS c(metric_name, threshold, direction, pos))"""


def detect_chain(sfx: str) -> list[str]:
    m = f"mts{sfx}"
    stats = f"""stats{sfx} AS (
  SELECT *, count(value) OVER wb AS n_before, avg(value) OVER wb AS mean,
         stddev_pop(value) OVER wb AS sd, lag(value, 4) OVER w AS first_v,
         row_number() OVER w AS rn,
         count(*) OVER (PARTITION BY metric_name, window_minutes) AS len
  FROM {m} WHERE window_minutes = 1440 AND metric_name IN (SELECT metric_name FROM cfg)
  WINDOW w AS (PARTITION BY metric_name, window_minutes ORDER BY window_start),
         wb AS (PARTITION BY metric_name, window_minutes ORDER BY window_start
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    thr = f"""thr{sfx} AS (
  SELECT m.metric_name, 'threshold' AS method, 'critical' AS severity, m.window_start,
         m.window_minutes, c.threshold AS baseline_value, m.value AS current_value,
         NULL::DOUBLE AS delta_pct,
         m.metric_name || '=' || printf('%.2f', round(m.value, 9)) || ' breached fixed threshold '
           || CAST(c.threshold AS VARCHAR) || ' (' || c.direction || ').' AS description,
         c.pos AS cfg_pos
  FROM {m} m JOIN cfg c ON m.metric_name = c.metric_name
  WHERE m.window_minutes = 1440
    AND CASE WHEN c.direction = 'above' THEN m.value > c.threshold ELSE m.value < c.threshold END)"""
    zs = f"""zs{sfx} AS (
  SELECT metric_name, 'zscore' AS method,
         CASE WHEN abs(z) >= 3 THEN 'critical' ELSE 'warning' END AS severity,
         window_start, window_minutes, mean AS baseline_value, value AS current_value,
         CASE WHEN mean <> 0 THEN (value - mean) / mean * 100.0 END AS delta_pct,
         metric_name || '=' || printf('%.2f', round(value, 9)) || ' is ' || printf('%.2f', round(z, 9))
           || ' std devs from baseline mean ' || printf('%.2f', round(mean, 9)) || '.' AS description,
         0 AS cfg_pos
  FROM (SELECT *, (value - mean) / sd AS z FROM stats{sfx} WHERE n_before >= 3 AND sd <> 0)
  WHERE abs(z) >= 2)"""
    trd = f"""trd{sfx} AS (
  SELECT metric_name, 'trend' AS method, 'warning' AS severity, window_start, window_minutes,
         first_v AS baseline_value, value AS current_value, pct AS delta_pct,
         metric_name || ' moved ' || printf('%+.1f', round(pct, 9)) || '% over the last 5 windows ('
           || printf('%.2f', round(first_v, 9)) || ' -> ' || printf('%.2f', round(value, 9)) || ').' AS description,
         0 AS cfg_pos
  FROM (SELECT *, (value - first_v) / first_v * 100.0 AS pct FROM stats{sfx}
        WHERE rn = len AND len >= 5 AND first_v <> 0)
  WHERE abs(pct) >= 10)"""
    flags = f"""flags{sfx} AS (SELECT * FROM thr{sfx} UNION ALL SELECT * FROM zs{sfx}
                                UNION ALL SELECT * FROM trd{sfx})"""
    dedup = f"""dedup{sfx} AS (SELECT * FROM flags{sfx} QUALIFY row_number() OVER (
    PARTITION BY metric_name, method, window_start, window_minutes ORDER BY cfg_pos) = 1)"""
    reg = f"""reg{sfx} AS (
  SELECT row_number() OVER (ORDER BY metric_name,
           CASE method WHEN 'threshold' THEN 0 WHEN 'zscore' THEN 1 ELSE 2 END,
           window_start, window_minutes) AS id,
         metric_name, method, severity, window_start, window_minutes, baseline_value,
         current_value, delta_pct, description
  FROM dedup{sfx})"""
    return [stats, thr, zs, trd, flags, dedup, reg]


def rca_chain(sfx: str) -> list[str]:
    r = f"reg{sfx}"
    evd = f"""evd{sfx} AS (
  SELECT window_start, window_minutes, metric_name, min(id) AS first_id,
         arg_max(row(id, delta_pct, current_value, method), id) AS last
  FROM {r} GROUP BY window_start, window_minutes, metric_name)"""
    win = f"""win{sfx} AS (
  SELECT window_start, window_minutes,
         bool_or(metric_name = 'latency_p95_ms') AS has_p95,
         bool_or(metric_name = 'error_rate_pct') AS has_err,
         bool_or(starts_with(metric_name, 'stage_latency_avg_ms:')) AS has_stage,
         max(CASE WHEN metric_name = 'latency_p95_ms' THEN last[2] END) AS p95_delta,
         max(CASE WHEN metric_name = 'error_rate_pct' THEN last[3] END) AS err_current,
         arg_max(row(metric_name, last[2]), row(coalesce(last[2], 0.0), -first_id))
           FILTER (WHERE starts_with(metric_name, 'stage_latency_avg_ms:')) AS dominant,
         string_agg(metric_name, ', ' ORDER BY first_id) AS names
  FROM evd{sfx} GROUP BY window_start, window_minutes)"""
    ids = f"""rids{sfx} AS (SELECT window_start, window_minutes, list(id ORDER BY id) AS regression_ids
                 FROM {r} GROUP BY window_start, window_minutes)"""
    p95 = "coalesce(printf('%+.1f', round(w.p95_delta, 9)), 'n/a')"
    sd = "coalesce(printf('%+.1f', round(w.dominant[2], 9)), 'n/a')"
    err = "coalesce(printf('%.1f', round(w.err_current, 9)), 'n/a')"
    stage = "substr(w.dominant[1], instr(w.dominant[1], ':') + 1)"
    rca = f"""rca{sfx} AS (
  SELECT row_number() OVER (ORDER BY w.window_minutes, w.window_start) AS id,
         w.window_start, w.window_minutes, i.regression_ids,
         CASE WHEN w.has_stage AND w.has_p95 THEN 'stage_latency:' || {stage}
              WHEN w.has_err AND w.has_p95 THEN 'cascading_failure'
              WHEN w.has_err THEN 'error_rate_isolated'
              WHEN w.has_p95 THEN 'latency_isolated'
              ELSE 'unmatched_pattern' END AS root_cause_category,
         CASE WHEN w.has_stage AND w.has_p95 THEN 'high'
              WHEN w.has_err OR w.has_p95 THEN 'medium' ELSE 'low' END AS confidence,
         CASE WHEN w.has_stage AND w.has_p95 THEN
                {fill_sql(RC.STAGE_SUMMARY, p95=p95, stage=stage, stage_delta=sd)}
              WHEN w.has_err AND w.has_p95 THEN {fill_sql(RC.CASCADE_SUMMARY, p95=p95, err=err)}
              WHEN w.has_err THEN {fill_sql(RC.ERROR_SUMMARY, err=err)}
              WHEN w.has_p95 THEN {fill_sql(RC.LATENCY_SUMMARY, p95=p95)}
              ELSE {fill_sql(RC.UNMATCHED_SUMMARY, names='w.names')} END AS summary
  FROM win{sfx} w JOIN rids{sfx} i USING (window_start, window_minutes))"""
    return [evd, win, ids, rca]


CUT = "started_at < TIMESTAMP '2024-01-20 12:00:00'"
FULL_REG = (*BASE_MTS, CFGP, *detect_chain(""))
FULL_RCA = (*FULL_REG, *rca_chain(""))
EARLY = (*mts_chain("_e", CUT), *detect_chain("_e"))

SQL["metric_series"] = with_(*BASE_MTS, CFGP) + f"""
SELECT window_start, window_end, window_minutes, metric_name, {R('value', 'value')},
       CAST(row_number() OVER (PARTITION BY metric_name, window_minutes ORDER BY window_start) - 1
            AS INTEGER) AS series_pos
FROM mts WHERE window_minutes = 1440 AND metric_name IN (SELECT metric_name FROM cfg)"""

SQL["stage_metric_series"] = with_(*BASE_MTS) + f"""
SELECT window_start, window_minutes, substr(metric_name, instr(metric_name, ':') + 1) AS stage_name,
       {R('value', 'value')}
FROM mts WHERE starts_with(metric_name, 'stage_latency_avg_ms:')"""

_REG_COLS = (f"metric_name, method, severity, window_start, window_minutes, "
             f"{R('baseline_value', 'baseline_value')}, {R('current_value', 'current_value')}, "
             f"{R('delta_pct', 'delta_pct')}, description")
SQL["detect_threshold"] = with_(*FULL_REG) + f"SELECT {_REG_COLS} FROM thr"
SQL["detect_zscore"] = with_(*FULL_REG) + f"SELECT {_REG_COLS} FROM zs"
SQL["detect_trend"] = with_(*FULL_REG) + f"SELECT {_REG_COLS} FROM trd"
SQL["detect_all"] = with_(*FULL_REG) + f"SELECT id, {_REG_COLS} FROM reg"
SQL["regression_dedup"] = with_(*FULL_REG, *EARLY) + f"""
SELECT {_REG_COLS} FROM dedup d
WHERE NOT EXISTS (SELECT 1 FROM reg_e e WHERE e.metric_name = d.metric_name AND e.method = d.method
                  AND e.window_start = d.window_start AND e.window_minutes = d.window_minutes)"""

SQL["rca_evidence"] = with_(*FULL_RCA) + f"""
SELECT window_start, window_minutes, metric_name, first_id, last[1] AS last_id,
       {R('last[2]', 'delta_pct')}, {R('last[3]', 'current_value')} FROM evd"""
_RCA_COLS = "id, window_start, window_minutes, regression_ids, root_cause_category, confidence, summary"
SQL["rca_reports"] = with_(*FULL_RCA) + f"SELECT {_RCA_COLS} FROM rca"
SQL["rca_summary_text"] = with_(*FULL_RCA) + "SELECT window_start, root_cause_category, summary FROM rca"
SQL["rca_bridge"] = with_(*FULL_RCA) + """
SELECT id AS rca_report_id, unnest(regression_ids) AS regression_id FROM rca"""
SQL["rca_drilldown"] = with_(*FULL_RCA) + f"""
SELECT b.rca_report_id, b.regression_id, r.root_cause_category, r.confidence,
       r.window_start AS report_window_start, g.metric_name, g.method, g.severity,
       {R('g.delta_pct', 'delta_pct')}, {R('g.current_value', 'current_value')}
FROM (SELECT id AS rca_report_id, unnest(regression_ids) AS regression_id FROM rca) b
JOIN rca r ON r.id = b.rca_report_id JOIN reg g ON g.id = b.regression_id"""
_UPS = "window_start, window_minutes, root_cause_category, confidence, summary"
_NEXT = ("(SELECT coalesce(max(id), 0) FROM rca_e) "
         "+ row_number() OVER (ORDER BY window_minutes, window_start)")
SQL["rca_upsert"] = with_(*FULL_RCA, *EARLY, *rca_chain("_e")) + f"""
SELECT id, {_UPS}, 'stored' AS origin FROM rca_e
UNION ALL
SELECT {_NEXT}, {_UPS}, 'fresh' FROM rca f
WHERE NOT EXISTS (SELECT 1 FROM rca_e e WHERE e.window_start = f.window_start
                  AND e.window_minutes = f.window_minutes)"""
SQL["rca_upsert_force"] = with_(*FULL_RCA, *EARLY, *rca_chain("_e")) + f"""
SELECT id, {_UPS}, 'stored' AS origin FROM rca_e e
WHERE NOT EXISTS (SELECT 1 FROM rca f WHERE e.window_start = f.window_start
                  AND e.window_minutes = f.window_minutes)
UNION ALL
SELECT {_NEXT}, {_UPS}, 'fresh' FROM rca"""
SQL["flagged_points"] = with_(*FULL_REG) + f"""
SELECT m.window_start, m.window_end, m.window_minutes, m.metric_name, {R('m.value', 'value')},
       m.window_start IN (SELECT window_start FROM reg) AS flagged
FROM mts m WHERE m.window_minutes = 1440 AND m.metric_name IN (SELECT metric_name FROM cfg)"""
_REDONE = """redone AS (
  SELECT DISTINCT window_start, window_minutes FROM mts WHERE window_start >= TIMESTAMP '2024-01-20')"""
SQL["metrics_replace_window"] = with_(*[c.replace(" AS (", " AS MATERIALIZED (", 1) for c in (
    *BASE_MTS, *mts_chain("_e", CUT), _REDONE)]) + f"""
SELECT e.window_start, e.window_end, e.window_minutes, e.metric_name, {R('e.value', 'value')}
FROM mts_e e LEFT JOIN redone d ON d.window_start = e.window_start AND d.window_minutes = e.window_minutes
WHERE d.window_start IS NULL
UNION ALL
SELECT window_start, window_end, window_minutes, metric_name, {R('value', 'value')} FROM mts
WHERE window_start >= TIMESTAMP '2024-01-20'"""
SQL["open_regressions"] = with_(*FULL_REG) + f"""
SELECT id, {_REG_COLS} FROM reg ORDER BY window_start DESC, id LIMIT 50"""
SQL["open_rca_reports"] = with_(*FULL_RCA) + """
SELECT id, window_start, window_minutes, root_cause_category, confidence, summary
FROM rca ORDER BY window_start DESC, id LIMIT 50"""


# ---- evaluation ------------------------------------------------------------
_SW_SQL = "[" + ", ".join(f"'{w}'" for w in sorted(EVAL_STOPWORDS)) + "]"


def tok(x: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), "
            f"lambda w: length(w) >= 3 AND NOT list_contains({_SW_SQL}, w)))")


def overlap(a: str, b: str) -> str:
    k = f"len(list_intersect({tok(a)}, {tok(b)}))"
    n = f"len({tok(a)})"
    return (f"(CASE WHEN {a} IS NULL OR {a} = '' OR {b} IS NULL OR {b} = '' THEN 0.0 "
            f"WHEN {n} = 0 THEN 0.0 ELSE {py_round_ratio_sql(k, n)} END)")


TURNS = """turns AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS trace_id, conv_id, turn,
         text AS query, ctx AS context, next_text AS answer
  FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
               array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), chr(10)) AS ctx
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

_FR, _RR, _JS = (_sqlstr(s) for s in (FAITHFULNESS_REASONING, RELEVANCE_REASONING, JUDGE_SKIPPED_REASONING))


def evals_of(src: str, evaluators: str = "") -> str:
    rows = f"""
  SELECT trace_id, 'heuristic_faithfulness_overlap' AS evaluator_name, {overlap('answer', 'context')} AS score,
         {_FR} AS reasoning, false AS skipped, 0 AS attempt FROM {src}
  UNION ALL SELECT trace_id, 'heuristic_relevance_keyword', {overlap('query', 'answer')}, {_RR}, false, 0 FROM {src}"""
    if evaluators != "heuristic":
        rows += f"""
  UNION ALL SELECT trace_id, 'llm_judge_faithfulness', NULL::DOUBLE, {_JS}, true, 0 FROM {src}
  UNION ALL SELECT trace_id, 'llm_judge_relevance', NULL::DOUBLE, {_JS}, true, 0 FROM {src}"""
    return rows


ALL_EVALS = f"all_evals AS ({evals_of('turns')})"
STORED = (f"stored AS ({evals_of('(SELECT * FROM turns WHERE turn = 0)')}\n  UNION ALL "
          f"{evals_of('(SELECT * FROM turns WHERE turn = 2)', 'heuristic')})")
MISSING = """missing AS (
  SELECT * FROM all_evals a WHERE NOT EXISTS (
    SELECT 1 FROM stored s WHERE s.trace_id = a.trace_id AND s.evaluator_name = a.evaluator_name))"""
EVAL_BASE = (TURNS, ALL_EVALS, STORED, MISSING)


def pivot_sql(src: str) -> str:
    cols = ",\n".join(
        f"  arg_min(score, attempt) FILTER (WHERE evaluator_name = '{n}' AND score IS NOT NULL) AS {n}"
        for n in ["heuristic_faithfulness_overlap", "heuristic_relevance_keyword",
                  "llm_judge_faithfulness", "llm_judge_relevance"])
    return f"SELECT trace_id,\n{cols}\nFROM {src} GROUP BY trace_id"


_SCORES = ["heuristic_faithfulness_overlap", "heuristic_relevance_keyword",
           "llm_judge_faithfulness", "llm_judge_relevance"]

SQL["tokenize"] = with_(TURNS) + f"""
SELECT trace_id, list_sort({tok('query')}) AS query_tokens, list_sort({tok('answer')}) AS answer_tokens
FROM turns"""
SQL["faithfulness_overlap"] = with_(TURNS) + f"""
SELECT trace_id, {R(overlap('answer', 'context'), 'score')} FROM turns"""
SQL["relevance_keyword"] = with_(TURNS) + f"""
SELECT trace_id, {R(overlap('query', 'answer'), 'score')} FROM turns"""
SQL["evaluate_missing"] = with_(*EVAL_BASE) + f"""
SELECT trace_id, evaluator_name, {R('score', 'score')}, reasoning, skipped FROM missing"""
SQL["evaluate_force"] = with_(*EVAL_BASE) + f"""
SELECT a.trace_id, a.evaluator_name, {R('a.score', 'score')}, a.reasoning, a.skipped,
       CAST(coalesce(n.nxt, 0) AS INTEGER) AS attempt
FROM all_evals a LEFT JOIN (SELECT trace_id, max(attempt) + 1 AS nxt FROM stored GROUP BY trace_id) n
  ON a.trace_id = n.trace_id"""
SQL["score_by_evaluator"] = with_(*EVAL_BASE) + f"""
SELECT evaluator_name, {R('avg(score)', 'avg_score')}, count(score) AS n_scored
FROM all_evals WHERE NOT skipped GROUP BY evaluator_name"""
SQL["evaluator_pivot"] = with_(*EVAL_BASE) + "SELECT * FROM (" + pivot_sql(
    "(SELECT * FROM stored UNION ALL SELECT * FROM missing)") + ")"
_mean = ("(SELECT avg(x) FROM unnest([" + ", ".join(f"p.{c}" for c in _SCORES) + "]) AS u(x))")
SQL["combined_quality_report"] = with_(*EVAL_BASE[:2], "piv AS (" + pivot_sql("all_evals") + ")") + f"""
SELECT t.trace_id, t.conv_id, t.turn, length(t.answer) AS answer_chars,
       {", ".join(R('p.' + c, c) for c in _SCORES)},
       {R(_mean, 'avg_quality_score')}
FROM turns t LEFT JOIN piv p ON t.trace_id = p.trace_id"""
SQL["eval_coverage"] = with_(*EVAL_BASE[:2]) + f"""
SELECT e.evaluator_name, {R('avg(e.score)', 'avg_score')}, count(e.score) AS n,
       c.scored_traces, c.total_traces
FROM all_evals e CROSS JOIN (
  SELECT count(*) FILTER (WHERE sc) AS scored_traces, count(*) AS total_traces
  FROM (SELECT trace_id, bool_or(score IS NOT NULL) AS sc FROM all_evals GROUP BY trace_id)) c
WHERE e.score IS NOT NULL
GROUP BY e.evaluator_name, c.scored_traces, c.total_traces"""
CALIB = """calib AS (
  SELECT d.doc_id, d.text AS context,
         CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, 1, instr(d.text, chr(10)) - 1) ELSE d.text END AS query,
         CASE WHEN instr(d.text, chr(10)) > 0 THEN substr(d.text, instr(d.text, chr(10)) + 1) ELSE '' END AS answer,
         CASE WHEN l.quality = 1 THEN 'good' ELSE 'bad' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
SQL["calibration"] = with_(CALIB) + f"""
SELECT round(gf, 3) AS avg_good_faithfulness, round(bf, 3) AS avg_bad_faithfulness,
       round(gr, 3) AS avg_good_relevance, round(br, 3) AS avg_bad_relevance,
       gf > bf AS faithfulness_separates_good_bad, gr > br AS relevance_separates_good_bad
FROM (SELECT avg(f) FILTER (WHERE label = 'good') AS gf, avg(f) FILTER (WHERE label = 'bad') AS bf,
             avg(r) FILTER (WHERE label = 'good') AS gr, avg(r) FILTER (WHERE label = 'bad') AS br
      FROM (SELECT label, {overlap('answer', 'context')} AS f, {overlap('query', 'answer')} AS r FROM calib))"""

_WS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def pystrip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


SQL["parse_responses"] = f"""
SELECT conv_id, turn, {pystrip_sql('text')} AS answer, length({pystrip_sql('text')}) AS char_length,
       starts_with({pystrip_sql('text')}, '[FALLBACK') AS is_fallback
FROM conversations WHERE role = 'assistant'"""
_fb = (f"(starts_with({pystrip_sql('text')}, '[FALLBACK') OR "
       f"starts_with({pystrip_sql('text')}, 'I don''t have enough information'))")
SQL["fallback_rate"] = f"""
SELECT count(*) AS n_answers, count(*) FILTER (WHERE {_fb}) AS n_fallback,
       {R(f'count(*) FILTER (WHERE {_fb}) / count(*)', 'fallback_rate')}
FROM conversations WHERE role = 'assistant'"""
SQL["validate_queries"] = f"""
SELECT conv_id, turn, {pystrip_sql('text')} AS query,
       text IS NOT NULL AND length({pystrip_sql('text')}) BETWEEN 1 AND 1000 AS is_valid,
       CASE WHEN text IS NULL THEN 'Query cannot be None'
            WHEN length({pystrip_sql('text')}) = 0 THEN 'Query cannot be empty'
            WHEN length({pystrip_sql('text')}) > 1000 THEN
              'Query too long (' || CAST(length({pystrip_sql('text')}) AS VARCHAR) || ' chars). Max is 1000.'
       END AS reject_reason
FROM conversations WHERE role = 'user'"""


def _render_sql() -> str:
    from tracewise.operators.evaluate import (JUDGE_FAITHFULNESS_PROMPT, JUDGE_RELEVANCE_PROMPT,
                                              NO_CONTEXT_PLACEHOLDER, RAG_PROMPT)
    ctx = (f"CASE WHEN length({pystrip_sql('context')}) = 0 THEN {_sqlstr(NO_CONTEXT_PLACEHOLDER)} "
           f"ELSE context END")
    p = fill_sql(RAG_PROMPT, context=ctx, query="query")
    jf = fill_sql(JUDGE_FAITHFULNESS_PROMPT, context="left(context, 4000)", answer="answer")
    jr = fill_sql(JUDGE_RELEVANCE_PROMPT, query="query", answer="answer")
    return with_(TURNS) + f"""
SELECT trace_id, {p} AS prompt, {jf} AS judge_faithfulness_prompt, {jr} AS judge_relevance_prompt
FROM turns"""


SQL["render_prompts"] = _render_sql()
SQL["parse_judge_replies"] = f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, {R("TRY_CAST(json_extract_string(props, '$.score') AS DOUBLE)", 'score')},
       CASE WHEN NOT json_valid(props) THEN '[JUDGE ERROR] invalid JSON'
            WHEN TRY_CAST(json_extract_string(props, '$.score') AS DOUBLE) IS NULL THEN '[JUDGE ERROR] ''score'''
            ELSE coalesce(json_extract_string(props, '$.reasoning'), '') END AS reasoning,
       TRY_CAST(json_extract_string(props, '$.score') AS DOUBLE) IS NULL AS skipped
FROM events"""


# ---- corpus and retrieval ----------------------------------------------------

def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


CHUNKS = f"""chunks AS (
  SELECT doc_id, source, CAST(i - 1 AS INTEGER) AS chunk_index,
         CAST(doc_id AS VARCHAR) || '::chunk-' || CAST(i - 1 AS VARCHAR) AS chunk_id, text
  FROM (SELECT doc_id, source, cl, generate_subscripts(cl, 1) AS i, unnest(cl) AS text FROM (
    SELECT doc_id, source,
           list_filter(list_transform(string_split(
             list_reduce(list_prepend('', ps), lambda a, x:
               CASE WHEN length(list_last(string_split(a, chr(1))) || x || chr(10)) >= 200
                    THEN a || x || chr(1) ELSE a || x || chr(10) END), chr(1)),
             lambda c: {strip_sql('c')}), lambda c: length(c) > 0) AS cl
    FROM (SELECT doc_id, source,
                 list_filter(list_transform(string_split(text, chr(10)), lambda p: {strip_sql('p')}),
                             lambda p: length(p) > 0) AS ps
          FROM documents)
    WHERE len(ps) > 0)))"""

_EMB_RE = r"[\pL\pN_]{2,}"


def emb_sql(name: str, src: str, key: str, text: str) -> str:
    return f"""{name} AS (
  SELECT {key}, bucket, count(*) AS cnt, sum(count(*) * count(*)) OVER (PARTITION BY {key}) AS sq
  FROM (SELECT {key}, CAST(('0x' || substr(md5(tok), 1, 8)) AS BIGINT) % 384 AS bucket
        FROM (SELECT {key}, unnest(list_filter(regexp_extract_all(lower({text}), '{_EMB_RE}'),
                                   lambda t: NOT list_contains({_SW_SQL}, t))) AS tok FROM {src}))
  GROUP BY {key}, bucket)"""


QUESTIONS = """questions AS (
  SELECT item_id AS qid, text AS query,
         (['basic', 'intermediate', 'advanced'])[item_id % 3 + 1] AS difficulty FROM benchmark)"""
VQ = f"""vq AS (SELECT qid, {strip_sql('query')} AS query FROM questions
          WHERE query IS NOT NULL AND length({strip_sql('query')}) BETWEEN 1 AND 1000)"""
KNN = f"""dots AS (
  SELECT q.qid, c.chunk_id, sum(q.cnt * c.cnt) AS dot FROM qemb q JOIN cemb c ON q.bucket = c.bucket
  GROUP BY q.qid, c.chunk_id),
qn AS (SELECT vq.qid, coalesce(max(e.sq), 0) AS sq FROM vq LEFT JOIN qemb e ON vq.qid = e.qid GROUP BY vq.qid),
cn AS (SELECT ch.chunk_id, coalesce(max(e.sq), 0) AS sq FROM chunks ch LEFT JOIN cemb e
         ON ch.chunk_id = e.chunk_id GROUP BY ch.chunk_id),
pairs AS (
  SELECT q.qid, c.chunk_id,
         (CASE WHEN q.sq > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN c.sq > 0 THEN 1.0 ELSE 0.0 END)
         - 2.0 * CASE WHEN q.sq > 0 AND c.sq > 0
                      THEN CAST(coalesce(d.dot, 0) AS DOUBLE) / (sqrt(q.sq) * sqrt(c.sq)) ELSE 0.0 END
           AS distance
  FROM qn q CROSS JOIN cn c LEFT JOIN dots d ON d.qid = q.qid AND d.chunk_id = c.chunk_id),
nn AS (
  SELECT p.*, CAST(row_number() OVER (PARTITION BY p.qid ORDER BY p.distance, p.chunk_id) - 1 AS INTEGER) AS rank
  FROM pairs p QUALIFY rank < 6),
nnt AS (SELECT nn.*, ch.doc_id, ch.text FROM nn JOIN chunks ch ON nn.chunk_id = ch.chunk_id),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) - 1 AS INTEGER) AS used_rank
  FROM (SELECT * FROM nnt QUALIFY row_number() OVER (PARTITION BY qid, text ORDER BY distance, chunk_id) = 1)
  QUALIFY used_rank < 3),
packed AS (
  SELECT qid, coalesce(string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY used_rank)
                       FILTER (WHERE run <= 3000), '') AS context
  FROM (SELECT qid, used_rank, piece, sum(length(piece)) OVER (PARTITION BY qid ORDER BY used_rank
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
        FROM (SELECT qid, used_rank, '[Source: ' || CAST(doc_id AS VARCHAR) || ']' || chr(10) || text AS piece
              FROM ranked))
  GROUP BY qid),
srcs AS (SELECT qid, list_sort(list_distinct(list(CAST(doc_id AS VARCHAR)))) AS sources,
                CAST(count(*) AS INTEGER) AS num_chunks_used FROM ranked GROUP BY qid),
expected AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON instr(d.text, b.text) > 0),
hits AS (
  SELECT q.qid, q.difficulty,
         q.query IS NOT NULL AND length({strip_sql('q.query')}) BETWEEN 1 AND 1000 AS is_valid,
         coalesce(EXISTS (SELECT 1 FROM expected e JOIN ranked r ON r.qid = e.qid
                          AND CAST(r.doc_id AS VARCHAR) = CAST(e.doc_id AS VARCHAR)
                          WHERE e.qid = q.qid), false) AS hit
  FROM questions q)"""

RETR = (CHUNKS, emb_sql("cemb", "chunks", "chunk_id", "text"), QUESTIONS, VQ,
        emb_sql("qemb", "vq", "qid", "query"), KNN)

SQL["scan_corpus"] = """
SELECT doc_id, source, length(text) AS n_chars,
       len(list_filter(string_split(text, chr(10)), lambda p: length(trim(p)) > 0)) AS n_lines
FROM documents"""
SQL["chunk_documents"] = with_(CHUNKS) + "SELECT doc_id, source, chunk_index, chunk_id, text FROM chunks"
SQL["hash_embed"] = with_(CHUNKS, emb_sql("cemb", "chunks", "chunk_id", "text")) + f"""
SELECT chunk_id, CAST(bucket AS INTEGER) AS bucket, cnt, CAST(sq AS BIGINT) AS sq, {R('cnt / sqrt(sq)', 'weight')} FROM cemb"""
SQL["knn_topk"] = with_(*RETR) + f"SELECT qid, chunk_id, {R('distance', 'distance')}, rank FROM nn"
SQL["rank_top_k"] = with_(*RETR) + f"SELECT qid, chunk_id, {R('distance', 'distance')}, used_rank FROM ranked"
SQL["retrieve_rank"] = with_(*RETR) + """
SELECT n.qid, CAST(count(*) AS INTEGER) AS num_chunks_retrieved,
       (SELECT CAST(count(*) AS INTEGER) FROM ranked r WHERE r.qid = n.qid) AS num_chunks_used
FROM nn n GROUP BY n.qid"""
SQL["pack_context"] = with_(*RETR) + "SELECT qid, context FROM packed"
SQL["sources_per_query"] = with_(*RETR) + "SELECT qid, sources FROM srcs"
SQL["lookup_topic_source"] = with_(*RETR) + "SELECT qid, doc_id FROM expected"
SQL["hit_rate_at_k"] = with_(*RETR) + f"""
SELECT CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits, count(*) AS n,
       {py_round_ratio_sql('sum(CAST(hit AS BIGINT))', 'count(*)')} AS hit_rate_at_k FROM hits"""
SQL["hit_rate_by_group"] = with_(*RETR) + f"""
SELECT coalesce(difficulty, 'OVERALL') AS difficulty, count(*) AS total,
       CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits, CAST(sum(CAST(NOT is_valid AS BIGINT)) AS BIGINT) AS errors,
       {R('sum(CAST(hit AS BIGINT)) / count(*) * 100.0', 'hit_rate_pct')}
FROM hits GROUP BY ROLLUP (difficulty)"""

SQL["retrieval_rows"] = with_(*RETR) + """
SELECT q.qid, q.query, q.difficulty, h.is_valid, s.sources AS retrieved,
       CASE WHEN s.sources IS NOT NULL THEN list_filter(s.sources, lambda d: list_contains(coalesce(x.docs, []), d)) END AS expected_retrieved,
       h.hit
FROM questions q JOIN hits h ON h.qid = q.qid LEFT JOIN srcs s ON s.qid = q.qid
LEFT JOIN (SELECT qid, list(CAST(doc_id AS VARCHAR)) AS docs FROM expected GROUP BY qid) x ON x.qid = q.qid"""
SQL["question_bank_report"] = with_(EV, TR, *RETR) + f"""
SELECT coalesce(difficulty, 'OVERALL') AS difficulty, count(*) AS total,
       CAST(sum(CAST(hit AS BIGINT)) AS BIGINT) AS hits, CAST(sum(CAST(NOT is_valid AS BIGINT)) AS BIGINT) AS errors,
       {R('sum(CAST(hit AS BIGINT)) / count(*) * 100.0', 'hit_rate_pct')},
       {R('avg(CASE WHEN is_valid THEN latency_ms END)', 'avg_latency_ms')}
FROM hits LEFT JOIN (SELECT CAST(query_id AS BIGINT) AS qid, avg(total_latency_ms) AS latency_ms FROM tr GROUP BY 1) l USING (qid)
GROUP BY ROLLUP (difficulty)"""


def _batch_sql() -> str:
    from tracewise.operators.evaluate import NO_CONTEXT_PLACEHOLDER, RAG_PROMPT
    ctx = (f"CASE WHEN length({strip_sql('coalesce(p.context, ' + chr(39) + chr(39) + ')')}) = 0 "
           f"THEN {_sqlstr(NO_CONTEXT_PLACEHOLDER)} ELSE coalesce(p.context, '') END")
    prompt = fill_sql(RAG_PROMPT, context=ctx, query=strip_sql("q.query"))
    valid = f"(q.query IS NOT NULL AND length({strip_sql('q.query')}) BETWEEN 1 AND 1000)"
    return with_(*RETR) + f"""
SELECT q.qid, {valid} AS is_valid,
       CASE WHEN q.query IS NULL THEN 'Query cannot be None'
            WHEN length({strip_sql('q.query')}) = 0 THEN 'Query cannot be empty'
            WHEN length({strip_sql('q.query')}) > 1000 THEN
              'Query too long (' || CAST(length({strip_sql('q.query')}) AS VARCHAR) || ' chars). Max is 1000.'
       END AS reject_reason,
       s.sources, s.num_chunks_used, p.context,
       CASE WHEN {valid} THEN {prompt} END AS prompt
FROM questions q LEFT JOIN packed p ON q.qid = p.qid LEFT JOIN srcs s ON q.qid = s.qid"""


SQL["retrieve_batch"] = _batch_sql()
SQL["question_slice"] = with_(QUESTIONS) + """
SELECT qid, query, difficulty FROM questions WHERE difficulty = 'intermediate'
ORDER BY qid LIMIT 5 OFFSET 2"""


# ---- reports, dashboards, outbox, sync -------------------------------------------
ALOG = """alog AS (
  SELECT 'regression' AS alert_type, CAST(id AS VARCHAR) AS reference_id, severity = 'critical' AS success,
         CASE WHEN severity <> 'critical' THEN '[SKIPPED] DISCORD_WEBHOOK_URL not set' END AS error,
         window_start + INTERVAL 1 DAY AS sent_at
  FROM reg WHERE window_start < TIMESTAMP '2024-01-20 12:00:00'
  UNION ALL
  SELECT 'rca', CAST(id AS VARCHAR), true, NULL, window_start + INTERVAL 1 DAY
  FROM rca WHERE window_start < TIMESTAMP '2024-01-20 12:00:00')"""
DUE = """cands AS (
  SELECT 'regression' AS alert_type, CAST(id AS VARCHAR) AS reference_id FROM reg
  UNION ALL SELECT 'rca', CAST(id AS VARCHAR) FROM rca),
due AS (SELECT * FROM cands c WHERE NOT EXISTS (
  SELECT 1 FROM alog l WHERE l.success AND l.alert_type = c.alert_type AND l.reference_id = c.reference_id))"""
OUTBOX = (*FULL_RCA, ALOG, DUE)

SQL["alert_log_tail"] = with_(*OUTBOX) + """
SELECT * FROM alog ORDER BY sent_at DESC, alert_type, reference_id LIMIT 50"""
SQL["alert_outbox"] = with_(*OUTBOX) + "SELECT alert_type, reference_id FROM due"
SQL["alert_payloads"] = with_(*OUTBOX) + """
SELECT d.alert_type, d.reference_id, to_json({'embeds': [{
         'title': '🚨 Regression detected: ' || r.metric_name, 'description': r.description,
         'color': CASE WHEN r.severity = 'critical' THEN 15158332 ELSE 15844367 END,
         'fields': [{'name': 'Method', 'value': r.method, 'inline': true},
                    {'name': 'Severity', 'value': r.severity, 'inline': true},
                    {'name': 'Window', 'value': strftime(r.window_start, '%Y-%m-%d %H:%M:%S'), 'inline': false}]}]})::VARCHAR AS payload
FROM due d JOIN reg r ON d.alert_type = 'regression' AND d.reference_id = CAST(r.id AS VARCHAR)
UNION ALL
SELECT d.alert_type, d.reference_id, to_json({'embeds': [{
         'title': '🔍 Root cause: ' || r.root_cause_category, 'description': left(r.summary, 2000),
         'color': 3447003,
         'fields': [{'name': 'Confidence', 'value': r.confidence, 'inline': true},
                    {'name': 'Window', 'value': strftime(r.window_start, '%Y-%m-%d %H:%M:%S'), 'inline': true}]}]})::VARCHAR
FROM due d JOIN rca r ON d.alert_type = 'rca' AND d.reference_id = CAST(r.id AS VARCHAR)"""
SQL["daily_digest"] = with_(*FULL_RCA) + """
SELECT 'digest' AS alert_type, strftime(t.day, '%Y-%m-%d') AS reference_id, t.total_traces, t.error_traces,
       coalesce(r.n, 0) AS total_regressions, coalesce(c.n, 0) AS total_rca_reports,
       to_json({'embeds': [{'title': '📊 Daily Digest', 'color': 3066993, 'fields': [
         {'name': 'total_traces', 'value': CAST(t.total_traces AS VARCHAR), 'inline': true},
         {'name': 'error_traces', 'value': CAST(t.error_traces AS VARCHAR), 'inline': true},
         {'name': 'total_regressions', 'value': CAST(coalesce(r.n, 0) AS VARCHAR), 'inline': true},
         {'name': 'total_rca_reports', 'value': CAST(coalesce(c.n, 0) AS VARCHAR), 'inline': true}]}]})::VARCHAR AS payload
FROM (SELECT CAST(started_at AS DATE) AS day, count(*) AS total_traces,
             count(*) FILTER (WHERE has_error) AS error_traces FROM tr GROUP BY 1) t
LEFT JOIN (SELECT CAST(window_start AS DATE) AS day, count(*) AS n FROM reg GROUP BY 1) r ON t.day = r.day
LEFT JOIN (SELECT CAST(window_start AS DATE) AS day, count(*) AS n FROM rca GROUP BY 1) c ON t.day = c.day"""
SQL["summary_stats"] = with_(*FULL_RCA, *EVAL_BASE[:2]) + """
SELECT (SELECT count(*) FROM tr) AS total_traces, (SELECT count(*) FROM all_evals) AS total_evaluations,
       (SELECT count(*) FROM reg) AS total_regressions, (SELECT count(*) FROM rca) AS total_rca_reports,
       (SELECT count(*) FROM tr WHERE has_error) AS error_traces"""
SQL["kpi_overview"] = with_(EV) + f"""
SELECT count(*) AS total_traces, CAST(sum(n) AS BIGINT) AS total_events, {R('avg(lat)', 'avg_trace_latency_ms')},
       {R('sum(CAST(err AS BIGINT)) / count(*) * 100.0', 'error_rate_pct')}
FROM (SELECT trace_id, sum(latency_ms) AS lat, bool_or(status = 'error') AS err, count(*) AS n
      FROM ev GROUP BY trace_id)"""
SQL["stage_avg_latency"] = with_(EV) + f"""
SELECT stage_name, {R('avg(latency_ms)', 'avg_latency_ms')} FROM ev GROUP BY stage_name"""
SQL["bi_measures"] = with_(*FULL_REG, TURNS, ALL_EVALS) + f"""
SELECT {R('(SELECT avg(total_latency_ms) FROM tr)', 'avg_trace_latency_ms')},
       {R('(SELECT count(*) FILTER (WHERE has_error) / count(*) FROM tr)', 'error_rate')},
       {R('(SELECT quantile_cont(total_latency_ms, 0.95) FROM tr)', 'p95_trace_latency_ms')},
       {R("(SELECT avg(score) FROM all_evals WHERE evaluator_name IN ('heuristic_faithfulness_overlap', 'llm_judge_faithfulness'))", 'avg_faithfulness_score')},
       {R("(SELECT avg(score) FROM all_evals WHERE evaluator_name IN ('heuristic_relevance_keyword', 'llm_judge_relevance'))", 'avg_relevance_score')},
       (SELECT count(*) FROM reg WHERE severity = 'critical') AS critical_regression_count"""
SQL["stage_status_breakdown"] = with_(EV) + """
SELECT stage_name, count(*) FILTER (WHERE status = 'success') AS success,
       count(*) FILTER (WHERE status = 'error') AS error FROM ev GROUP BY stage_name"""
SQL["metric_trend"] = with_(*BASE_MTS) + f"""
SELECT window_start, window_end, window_minutes, metric_name, {R('value', 'value')} FROM mts
WHERE metric_name IN ('latency_p95_ms', 'error_rate_pct')"""
_TRC = (f"trace_id, query_id, started_at, ended_at, {R('total_latency_ms', 'total_latency_ms')}, num_stages, "
        f"slowest_stage, {R('slowest_stage_latency_ms', 'slowest_stage_latency_ms')}, has_error, error_stage")
SQL["recent_traces"] = with_(*BASE_TR) + f"SELECT {_TRC} FROM tr ORDER BY started_at DESC, trace_id LIMIT 20"
SQL["worst_recent_traces"] = with_(*BASE_TR) + f"""
SELECT {_TRC} FROM (SELECT * FROM tr ORDER BY started_at DESC, trace_id LIMIT 200)
ORDER BY total_latency_ms DESC, trace_id LIMIT 10"""
SQL["recent_traces_display"] = with_(*BASE_TR) + f"""
SELECT left(trace_id, 8) || '...' AS trace_id_short, trace_id, started_at, num_stages,
       {R('total_latency_ms', 'total_latency_ms')},
       CASE WHEN has_error THEN '❌ error' ELSE '✅ success' END AS status
FROM (SELECT * FROM tr ORDER BY started_at DESC, trace_id LIMIT 20)"""
SQL["trace_rollup"] = with_(EV) + f"""
SELECT trace_id, count(stage_name) AS num_stages, {R('sum(latency_ms)', 'total_latency_ms')},
       bool_or(status = 'error') AS has_error, min(timestamp_start) AS started_at
FROM ev GROUP BY trace_id"""
SO = """so AS (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY timestamp_start, event_id) - 1
                  AS INTEGER) AS stage_order FROM ev)"""
SQL["stage_order"] = with_(EV, SO) + f"""
SELECT event_id, trace_id, stage_name, stage_order, timestamp_start, timestamp_end,
       {R('latency_ms', 'latency_ms')}, status, error FROM so"""
SQL["stage_order_violations"] = with_(EV, SO) + """
SELECT trace_id, CAST(count(*) AS INTEGER) AS num_stages, min(stage_order) FILTER (WHERE bad) AS first_violation_order,
       arg_min(want, stage_order) FILTER (WHERE bad) AS expected_stage,
       arg_min(stage_name, stage_order) FILTER (WHERE bad) AS actual_stage
FROM (SELECT *, CASE WHEN stage_order < 5 THEN (['signup', 'view', 'click', 'purchase', 'error'])[stage_order + 1] END AS want,
             (stage_order >= 5 OR (['signup', 'view', 'click', 'purchase', 'error'])[stage_order + 1] <> stage_name) AS bad
      FROM so)
GROUP BY trace_id HAVING bool_or(bad)"""
SQL["trace_waterfall"] = with_(EV, TR, SO) + f"""
SELECT s.trace_id, s.stage_order, s.event_id, s.stage_name, s.status, {R('s.latency_ms', 'latency_ms')},
       {R('(epoch_us(s.timestamp_start) - epoch_us(t.started_at)) / 1000.0', 'offset_ms')},
       {R('sum(s.latency_ms) OVER (PARTITION BY s.trace_id ORDER BY s.stage_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'cumulative_latency_ms')}
FROM so s JOIN tr t ON s.trace_id = t.trace_id"""
SQL["trace_detail"] = with_(EV, TR, SO, *EVAL_BASE[:2]) + f"""
SELECT t.trace_id, t.started_at, {R('t.total_latency_ms', 'total_latency_ms')}, t.has_error, p.kind, p.seq,
       p.name, {R('p.value', 'value')}, p.detail
FROM (SELECT trace_id, started_at, total_latency_ms, has_error FROM tr
  UNION ALL SELECT trace_id, NULL::TIMESTAMP, NULL::DOUBLE, false FROM turns) t JOIN (
  SELECT trace_id, 'event' AS kind, stage_order AS seq, stage_name AS name, latency_ms AS value, status AS detail FROM so
  UNION ALL
  SELECT trace_id, 'evaluation', NULL::INTEGER, evaluator_name, score, reasoning FROM all_evals) p
ON t.trace_id = p.trace_id"""
SQL["payload_summary"] = with_(EV) + """
SELECT event_id, CASE WHEN output_summary IS NOT NULL THEN 'str' END AS summary_type,
       length(output_summary) AS summary_length, left(output_summary, 200) AS summary_preview FROM ev"""
SQL["payload_arguments"] = f"""
WITH calls AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, unnest(range(8)) AS i, props, value, event_type, user_id, event_id AS eid FROM events),
args AS (
  SELECT event_id, CAST(i AS INTEGER) AS position, CAST(CASE i
    WHEN 0 THEN props WHEN 1 THEN CAST(value AS VARCHAR) WHEN 2 THEN '"' || event_type || '"'
    WHEN 3 THEN CAST(event_type = 'error' AS VARCHAR) WHEN 4 THEN CASE WHEN event_type = 'error' THEN '"failed"' ELSE 'null' END
    WHEN 5 THEN '[' || user_id || ',' || eid || ']' WHEN 6 THEN CAST(user_id AS VARCHAR)
    ELSE '<' || event_type || ' object>' END AS VARCHAR) AS a
  FROM calls),
typed AS (SELECT event_id, position, CAST(a AS JSON) AS j, json_type(a) AS t FROM args WHERE json_valid(a))
SELECT event_id, position,
       CASE t WHEN 'NULL' THEN 'NoneType' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list'
              WHEN 'OBJECT' THEN 'dict' WHEN 'DOUBLE' THEN 'float' ELSE 'int' END AS arg_type,
       CASE t WHEN 'VARCHAR' THEN length(j ->> '$') WHEN 'ARRAY' THEN CAST(json_array_length(j) AS BIGINT) END AS arg_length,
       CASE t WHEN 'VARCHAR' THEN left(j ->> '$', 200) END AS arg_preview,
       CASE t WHEN 'OBJECT' THEN json_keys(j)[1:10] END AS arg_keys,
       {R("CASE WHEN t IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(j AS DOUBLE) END", 'arg_number')},
       CASE t WHEN 'BOOLEAN' THEN CAST(j AS BOOLEAN) END AS arg_flag
FROM typed"""
SQL["trace_events_of"] = with_(EV, TR) + f"""
SELECT trace_id, event_id, stage_name, timestamp_start, timestamp_end, {R('latency_ms', 'latency_ms')}, status
FROM ev WHERE trace_id = (SELECT trace_id FROM tr ORDER BY num_stages DESC, trace_id LIMIT 1)
ORDER BY timestamp_start, event_id"""
SQL["sync_new_traces"] = with_(EV, TR) + f"""
SELECT {_TRC} FROM tr WHERE trace_id NOT IN (
  SELECT DISTINCT trace_id FROM ev WHERE timestamp_start < TIMESTAMP '2024-01-20 12:00:00')"""

SQL["scan_events"] = with_(EV) + f"""
SELECT event_id, trace_id, query_id, stage_name, timestamp_start, timestamp_end,
       {R('latency_ms', 'latency_ms')}, status, error, NULL::VARCHAR AS input_summary,
       output_summary, NULL::VARCHAR AS metadata FROM ev"""
SQL["quality_trend"] = with_(*EVAL_BASE) + f"""
SELECT t.turn,
       {R("avg(e.score) FILTER (WHERE e.evaluator_name IN ('heuristic_faithfulness_overlap', 'llm_judge_faithfulness'))", 'avg_faithfulness_score')},
       {R("avg(e.score) FILTER (WHERE e.evaluator_name IN ('heuristic_relevance_keyword', 'llm_judge_relevance'))", 'avg_relevance_score')},
       count(e.score) AS n_scores
FROM all_evals e JOIN turns t ON e.trace_id = t.trace_id GROUP BY t.turn"""


# ---- dense vectors -------------------------------------------------------------
DENSE = """ev64 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v,
                  list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)) AS vv
           FROM embeddings),
dpairs AS (
  SELECT q.vec_id AS qid, c.vec_id,
         round((q.vv + c.vv) - 2.0 * list_inner_product(q.v, c.v), 9) AS distance
  FROM ev64 q JOIN ev64 c ON q.vec_id <> c.vec_id),
dnn AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) - 1 AS INTEGER) AS rank
        FROM dpairs QUALIFY rank < 5)"""
SQL["knn_embeddings"] = with_(DENSE) + "SELECT qid, vec_id, distance, rank FROM dnn"
SQL["label_hit_rate"] = with_(DENSE) + f"""
, per AS (
  SELECT q.vec_id AS qid, q.label,
         bool_or(c.label = q.label) AS hit
  FROM ev64 q LEFT JOIN dnn n ON n.qid = q.vec_id LEFT JOIN ev64 c ON c.vec_id = n.vec_id
  GROUP BY q.vec_id, q.label)
SELECT coalesce(CAST(label AS VARCHAR), 'OVERALL') AS label, count(*) AS n,
       CAST(sum(CAST(coalesce(hit, false) AS BIGINT)) AS BIGINT) AS hits,
       {py_round_ratio_sql('sum(CAST(coalesce(hit, false) AS BIGINT))', 'count(*)')} AS hit_rate_at_5
FROM per GROUP BY ROLLUP (label)"""
