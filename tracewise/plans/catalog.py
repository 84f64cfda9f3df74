"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Every query reads the test tables (or views Spark derives from them) in
full; nothing is filtered to an id subset.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.functions.timefns import floor_to_window
from tracewise.operators import metrics as M
from tracewise.plans.common import Views, finish

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(Views(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---- traces and metrics ---------------------------------------------------

@query("assemble_traces")
def _assemble_traces(v: Views):
    """A1 over the stage-event view."""
    return v.tr


def _window_metrics(v: Views, minutes: int):
    return (M.window_trace_metrics(v.tr, [minutes])
            .select("window_start", F.col("window_minutes").cast("int").alias("window_minutes"),
                    *M.TRACE_METRICS))


@query("window_metrics_5m")
def _wm5(v):
    """A5 / A8 for 5-minute windows."""
    return _window_metrics(v, 5)


@query("window_metrics_1h")
def _wm60(v):
    """A5 / A8 for 60-minute windows."""
    return _window_metrics(v, 60)


@query("window_metrics_1d")
def _wm1440(v):
    """A5 / A8 for 1440-minute windows."""
    return _window_metrics(v, 1440)


@query("stage_window_avg")
def _stage_window_avg(v):
    """Mean stage latency per window and stage."""
    return (M.window_stage_means(v.ev, v.tr)
            .select("window_start", F.col("window_minutes").cast("int").alias("window_minutes"),
                    "metric_name", "value"))


@query("metrics_long")
def _metrics_long(v):
    """All metric points in long form."""
    return v.mts


@query("window_floor")
def _window_floor(v):
    """Tumbling-window floors of every event time, for several sizes."""
    e = v.table("events")
    return e.select(F.col("event_id").cast("string").alias("event_id"), "ts",
                    floor_to_window("ts", 5).alias("window_5m"),
                    floor_to_window("ts", 60).alias("window_1h"),
                    floor_to_window("ts", 1440).alias("window_1d"),
                    floor_to_window("ts", 7).alias("window_7m"))


# ---- detection, root cause ------------------------------------------------
from tracewise.operators import rca as RC  # noqa: E402
from tracewise.operators import regression as RG  # noqa: E402
from tracewise.operators.metrics import metrics_long, replace_windows  # noqa: E402
from tracewise.operators.traces import assemble_traces  # noqa: E402

EARLIER_RUN_CUTOFF = "2024-01-20 12:00:00"


def _earlier_traces(v: Views):
    """Traces an earlier run would have seen: those started before the cutoff."""
    return v.tr.where(F.col("started_at") < F.lit(EARLIER_RUN_CUTOFF).cast("timestamp_ntz"))


def _earlier_mts(v: Views):
    """Metric table stored by the earlier run."""
    def build():
        t = _earlier_traces(v)
        return metrics_long(t, v.ev.join(t.select("trace_id"), "trace_id", "left_semi"))
    return v._stage("mts_earlier", build)


def _earlier_reg(v: Views):
    return v._stage("reg_earlier", lambda: RG.detect_all(_earlier_mts(v), v.cfg, 1440))


def _earlier_rca(v: Views):
    return v._stage("rca_earlier", lambda: RC.rca_reports(_earlier_reg(v)))


@query("metric_series")
def _metric_series(v):
    """Daily series of the configured metrics with positions."""
    return RG.metric_series(v.mts, 1440, v.cfg)


@query("stage_metric_series")
def _stage_metric_series(v):
    """Stage mean series with the stage name stripped from the metric."""
    from tracewise.sources.lookups import STAGE_METRIC_PREFIX
    m = v.mts.where(F.col("metric_name").startswith(STAGE_METRIC_PREFIX))
    return m.select("window_start", "window_minutes",
                    F.expr("substr(metric_name, instr(metric_name, ':') + 1)").alias("stage_name"),
                    "value")


@query("detect_threshold")
def _detect_threshold(v):
    """W3 + W7 text."""
    return RG.detect_threshold(v.mts, v.cfg, 1440).drop("_cfg_pos")


def _stats(v):
    return RG._series_stats(v.mts, v.cfg.select("metric_name").distinct(), 1440, 5)


@query("detect_zscore")
def _detect_zscore(v):
    """W4 + W7 text."""
    return RG.detect_zscore(_stats(v)).drop("_cfg_pos")


@query("detect_trend")
def _detect_trend(v):
    """W5 + W7 text."""
    return RG.detect_trend(_stats(v)).drop("_cfg_pos")


@query("detect_all")
def _detect_all(v):
    """W6 + K3: stored regression rows with ids."""
    return v.reg


@query("regression_dedup")
def _regression_dedup(v):
    """K3: flags of a full run that are not yet stored by an earlier run."""
    earlier = _earlier_reg(v)
    return RG.keep_first(RG.detect_flags(v.mts, v.cfg, 1440), earlier).drop("_cfg_pos")


@query("rca_evidence")
def _rca_evidence(v):
    """Last flag per (window, metric)."""
    return RC.evidence(v.reg).drop("method")


@query("rca_reports")
def _rca_reports(v):
    """One report per regressed window."""
    return v.rca


@query("rca_summary_text")
def _rca_summary_text(v):
    """The summary sentence per window."""
    return v.rca.select("window_start", "root_cause_category", "summary")


@query("rca_bridge")
def _rca_bridge(v):
    """Report x regression bridge rows."""
    return RC.bridge(v.rca)


@query("rca_drilldown")
def _rca_drilldown(v):
    """Report -> bridge -> regression."""
    return RC.drilldown(v.rca, v.reg)


@query("rca_upsert")
def _rca_upsert(v):
    """K5: reports of an earlier run kept, reports of new windows added."""
    return RC.upsert_reports(_earlier_rca(v), v.rca, force=False).drop("regression_ids")


@query("rca_upsert_force")
def _rca_upsert_force(v):
    """K5 with force: fresh reports replace stored ones."""
    return RC.upsert_reports(_earlier_rca(v), v.rca, force=True).drop("regression_ids")


@query("flagged_points")
def _flagged_points(v):
    """Daily points of the configured metrics, flagged when their window
    has any regression."""
    pts = RG.metric_series(v.mts, 1440, v.cfg).drop("series_pos")
    wins = v.reg.select("window_start").distinct().withColumn("flagged", F.lit(True))
    return (pts.join(wins, "window_start", "left")
            .withColumn("flagged", F.coalesce(F.col("flagged"), F.lit(False))))


@query("metrics_replace_window")
def _metrics_replace_window(v):
    """K4: metrics stored by an earlier run, recomputed windows replaced."""
    fresh = v.mts.where(F.col("window_start") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    return replace_windows(_earlier_mts(v), fresh)


@query("open_regressions")
def _open_regressions(v):
    """Newest 50 regressions (window desc, id)."""
    return v.reg.orderBy(F.col("window_start").desc(), F.col("id")).limit(50)


@query("open_rca_reports")
def _open_rca_reports(v):
    """Newest 50 reports."""
    return v.rca.drop("regression_ids").orderBy(F.col("window_start").desc(), F.col("id")).limit(50)


# ---- evaluation ------------------------------------------------------------
from tracewise.functions.text import content_tokens  # noqa: E402
from tracewise.functions.text import faithfulness_overlap as _faith  # noqa: E402
from tracewise.functions.text import relevance_keyword as _rel  # noqa: E402
from tracewise.functions.text import validate_query as _validate  # noqa: E402
from tracewise.operators import evaluate as EVL  # noqa: E402
from tracewise.sources.lookups import EVALUATOR_NAMES  # noqa: E402


def _stored_evals(v: Views):
    """Evaluations an earlier run stored: all four evaluators for the first
    exchange of every conversation, only the heuristics for the second."""
    def build():
        t = v.turns
        first = EVL.evaluate_all(t.where(F.col("turn") == 0))
        second = EVL.evaluate_all(t.where(F.col("turn") == 2)) \
            .where(F.col("evaluator_name").startswith("heuristic_"))
        return first.unionByName(second)
    return v._stage("stored_evals", build)


def _all_evals(v: Views):
    """Every evaluator row of every answered turn (the evaluations table)."""
    return v._stage("all_evals", lambda: EVL.evaluate_all(v.turns))


@query("tokenize")
def _tokenize(v):
    """Content-token sets of query and answer (sorted for display)."""
    return v.turns.select("trace_id",
                          F.sort_array(content_tokens(F.col("query"))).alias("query_tokens"),
                          F.sort_array(content_tokens(F.col("answer"))).alias("answer_tokens"))


@query("faithfulness_overlap")
def _faithfulness(v):
    """Answer tokens found in the context."""
    return v.turns.select("trace_id", _faith(F.col("answer"), F.col("context")).alias("score"))


@query("relevance_keyword")
def _relevance(v):
    """Query tokens found in the answer."""
    return v.turns.select("trace_id", _rel(F.col("query"), F.col("answer")).alias("score"))


@query("evaluate_missing")
def _evaluate_missing(v):
    """Rows a run appends for pairs not stored yet."""
    return EVL.evaluate_missing(v.turns, _stored_evals(v)).drop("attempt")


@query("evaluate_force")
def _evaluate_force(v):
    """X4 with force: every pair again, as the next attempt."""
    return EVL.evaluate_missing(v.turns, _stored_evals(v), force=True)


@query("score_by_evaluator")
def _score_by_evaluator(v):
    """A10: mean non-skipped score per evaluator."""
    return EVL.score_by_evaluator(_all_evals(v))


@query("evaluator_pivot")
def _evaluator_pivot(v):
    """Stored + newly appended evaluations pivoted per trace."""
    allev = _stored_evals(v).unionByName(
        _all_evals(v).join(_stored_evals(v).select("trace_id", "evaluator_name"),
                           ["trace_id", "evaluator_name"], "left_anti"))
    return EVL.evaluator_pivot(allev)


def _turn_traces(v):
    return v.turns.select("trace_id", "conv_id", "turn",
                          F.length("answer").cast("long").alias("answer_chars"))


@query("combined_quality_report")
def _combined_quality_report(v):
    """J2 + A11 + A12: every answered turn with its scores and their mean."""
    return EVL.combined_report(_turn_traces(v), _all_evals(v))


@query("eval_coverage")
def _eval_coverage(v):
    """Per-evaluator means and trace coverage of all evaluations."""
    return EVL.eval_coverage(_all_evals(v))


@query("calibration")
def _calibration(v):
    """Good vs bad separation of the heuristics on labelled documents."""
    return EVL.calibration_summary(v.calib)


@query("parse_responses")
def _parse_responses(v):
    """Normalised assistant replies."""
    c = v.table("conversations").where(F.col("role") == "assistant")
    ans, n, fb = EVL.parse_responses(F.col("text"))
    return c.select("conv_id", "turn", ans.alias("answer"), n.cast("long").alias("char_length"),
                    fb.alias("is_fallback"))


@query("fallback_rate")
def _fallback_rate(v):
    """Share of assistant replies that are fallbacks."""
    c = v.table("conversations").where(F.col("role") == "assistant")
    from tracewise.functions.text import is_fallback_answer
    fb = is_fallback_answer(F.col("text"))
    return c.agg(F.count(F.lit(1)).alias("n_answers"),
                 F.count(F.when(fb, 1)).alias("n_fallback"),
                 (F.count(F.when(fb, 1)) / F.count(F.lit(1))).alias("fallback_rate"))


@query("validate_queries")
def _validate_queries(v):
    """Every user message validated as a query."""
    c = v.table("conversations").where(F.col("role") == "user")
    q, ok, why = _validate(F.col("text"))
    return c.select("conv_id", "turn", q.alias("query"), ok.alias("is_valid"),
                    why.alias("reject_reason"))


@query("render_prompts")
def _render_prompts(v):
    """P10: generation and judge prompts of every answered turn."""
    t = v.turns
    jf, jr = EVL.render_judge_prompts(F.col("query"), F.col("context"), F.col("answer"))
    return t.select("trace_id", EVL.render_rag_prompt(F.col("query"), F.col("context")).alias("prompt"),
                    jf.alias("judge_faithfulness_prompt"), jr.alias("judge_relevance_prompt"))


@query("parse_judge_replies")
def _parse_judge_replies(v):
    """JSON replies (event payloads stand in) parsed into judge results."""
    e = v.table("events")
    r = EVL.parse_judge_reply(F.col("props"))
    return e.select(F.col("event_id").cast("string").alias("event_id"),
                    r["score"].alias("score"), r["reasoning"].alias("reasoning"),
                    r["skipped"].alias("skipped"))


# ---- corpus and retrieval ----------------------------------------------------
from tracewise.operators import retrieval as RT  # noqa: E402

RETRIEVE_K = 3  # answers use the top 3, retrieval over-fetches 2k


def _chunks(v: Views):
    return v._stage("chunks", lambda: v.chunks)


def _expected(v: Views):
    return v._stage("expected", lambda: RT.contained_in(
        v.questions, v.table("documents").select("doc_id", "text")))


def _retrieved(v: Views):
    """Over-fetched neighbours (2k) of every question with chunk texts."""
    def build():
        ch = _chunks(v)
        from tracewise.functions.text import validate_query
        nq, ok, _ = validate_query(F.col("query"))
        qs = v.questions.select("qid", nq.alias("query"), ok.alias("ok")).where("ok")
        nn = RT.knn(ch.select("chunk_id", "text"), ["chunk_id"], qs.select("qid", "query"),
                    2 * RETRIEVE_K, query_text="query")
        return nn.join(ch.select("chunk_id", "doc_id", "text"), "chunk_id")
    return v._stage("retrieved", build)


def _ranked(v: Views):
    return RT.rank_top_k(_retrieved(v), RETRIEVE_K).withColumn(
        "source", F.col("doc_id").cast("string"))


@query("scan_corpus")
def _scan_corpus(v):
    """S3: the corpus as (document, source, text length, paragraphs)."""
    d = v.table("documents")
    return d.select("doc_id", "source", F.length("text").cast("long").alias("n_chars"),
                    F.size(F.filter(F.split("text", "\n", -1), lambda p: F.length(F.trim(p)) > 0))
                     .cast("long").alias("n_lines"))


@query("chunk_documents")
def _chunk_documents(v):
    """V1 + V2: greedy paragraph chunks of every document."""
    return _chunks(v).select("doc_id", "source", "chunk_index", "chunk_id", "text")


@query("hash_embed")
def _hash_embed(v):
    """V3: sparse hashed counts and normalised weights of every chunk."""
    e = RT.hash_embed(_chunks(v), ["chunk_id"])
    return e.select("chunk_id", "bucket", "cnt", "sq", (F.col("cnt") / F.sqrt("sq")).alias("weight"))


@query("knn_topk")
def _knn_topk(v):
    """The 2k nearest chunks of every question."""
    return _retrieved(v).select("qid", "chunk_id", "distance", "rank")


@query("rank_top_k")
def _rank_top_k(v):
    """Text-deduplicated top k."""
    return _ranked(v).select("qid", "chunk_id", "distance", "used_rank")


@query("retrieve_rank")
def _retrieve_rank(v):
    """V6: chunks retrieved (2k) and used (k, after dedup) per question."""
    got = _retrieved(v).groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("num_chunks_retrieved"))
    used = _ranked(v).groupBy("qid").agg(F.count(F.lit(1)).cast("int").alias("num_chunks_used"))
    return got.join(used, "qid", "left")


@query("pack_context")
def _pack_context(v):
    """V7: budgeted context per question."""
    return RT.pack_context(_ranked(v))


@query("sources_per_query")
def _sources_per_query(v):
    """V8: sorted distinct sources of the ranked chunks."""
    return RT.sources_per_query(_ranked(v)).drop("num_chunks_used")


@query("lookup_topic_source")
def _lookup_topic_source(v):
    """Expected source documents of every question (containment)."""
    return _expected(v)


def _hits(v):
    return RT.retrieval_hits(v.questions, _ranked(v), _expected(v))


@query("hit_rate_at_k")
def _hit_rate_at_k(v):
    """Overall hit rate at k."""
    return RT.hit_rate_at_k(_hits(v))


@query("hit_rate_by_group")
def _hit_rate_by_group(v):
    """Hit rate by difficulty plus the overall rollup row."""
    return RT.hit_rate_by_group(_hits(v))


@query("retrieval_rows")
def _retrieval_rows(v):
    """A13 per question: what was retrieved, what of it was expected, and the hit."""
    return _hits(v).select("qid", "query", "difficulty", "is_valid", "retrieved", "expected_retrieved", "hit")


@query("question_bank_report")
def _question_bank_report(v):
    """Hit rate and mean latency by difficulty; a question's latency is the
    mean of the traces of its query id."""
    lat = v.tr.groupBy(F.col("query_id").cast("long").alias("qid")).agg(F.avg("total_latency_ms").alias("latency_ms"))
    return RT.hit_rate_by_group(_hits(v).join(lat, "qid", "left"), latency_col="latency_ms")


@query("retrieve_batch")
def _retrieve_batch(v):
    """V9: validation -> embedding -> kNN -> rank -> pack -> prompt for the
    question table."""
    from tracewise.functions.text import validate_query
    q = v.questions
    nq, ok, why = validate_query(F.col("query"))
    ctx = RT.pack_context(_ranked(v))
    src = RT.sources_per_query(_ranked(v))
    base = q.select("qid", nq.alias("query"), ok.alias("is_valid"), why.alias("reject_reason"))
    out = base.join(ctx, "qid", "left").join(src, "qid", "left")
    return out.select("qid", "is_valid", "reject_reason", "sources", "num_chunks_used", "context",
                      F.when(F.col("is_valid"), EVL.render_rag_prompt(F.col("query"),
                             F.coalesce("context", F.lit("")))).alias("prompt"))


@query("question_slice")
def _question_slice(v):
    """Difficulty filter, then start index 3 (1-based), then limit 5."""
    return (v.questions.where(F.col("difficulty") == "intermediate")
            .orderBy("qid").offset(2).limit(5))


# ---- reports, dashboards, outbox, sync -------------------------------------------
from tracewise.operators import alerts as AL  # noqa: E402
from tracewise.operators import report as RP  # noqa: E402
from tracewise.operators import sinks as SK  # noqa: E402
from tracewise.operators import traces as TR  # noqa: E402
from tracewise.plans.common import FIXTURE_STAGE_ORDER  # noqa: E402


def _alert_log(v: Views):
    """Attempts an earlier run logged: alerts for windows before the cutoff;
    critical regressions and all reports went out, warnings were skipped
    (no webhook), retried ones come back due."""
    def build():
        cut = F.lit(EARLIER_RUN_CUTOFF).cast("timestamp_ntz")
        reg = v.reg.where(F.col("window_start") < cut).select(
            F.lit("regression").alias("alert_type"), F.col("id").cast("string").alias("reference_id"),
            (F.col("severity") == "critical").alias("success"),
            F.when(F.col("severity") != "critical", F.lit(AL.SKIPPED_NO_WEBHOOK)).alias("error"),
            F.timestamp_add("DAY", F.lit(1), F.col("window_start")).alias("sent_at"))
        rca = v.rca.where(F.col("window_start") < cut).select(
            F.lit("rca").alias("alert_type"), F.col("id").cast("string").alias("reference_id"),
            F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"),
            F.timestamp_add("DAY", F.lit(1), F.col("window_start")).alias("sent_at"))
        return reg.unionByName(rca)
    return v._get("alert_log", build)


def _due(v: Views):
    return AL.outbox(AL.candidates(v.reg, v.rca), _alert_log(v))


@query("alert_log_tail")
def _alert_log_tail(v):
    """T4: last 50 alert attempts."""
    return _alert_log(v).orderBy(F.col("sent_at").desc(), "alert_type", "reference_id").limit(50)


@query("alert_outbox")
def _alert_outbox(v):
    """Alerts still due (no successful attempt yet)."""
    return _due(v)


@query("alert_payloads")
def _alert_payloads(v):
    """L2: JSON payload of every due alert."""
    d = _due(v)
    return AL.regression_payloads(d, v.reg).unionByName(AL.rca_payloads(d, v.rca))


@query("daily_digest")
def _daily_digest(v):
    """L3: one digest per day."""
    return AL.daily_digest(v.tr, v.reg, v.rca)


@query("summary_stats")
def _summary_stats(v):
    """Report header counts."""
    return RP.summary_stats(v.tr, _all_evals(v), v.reg, v.rca)


@query("kpi_overview")
def _kpi_overview(v):
    """A3: KPI row of the event dashboard."""
    return RP.kpi_overview(v.ev)


@query("stage_avg_latency")
def _stage_avg_latency(v):
    """A4: mean latency by stage."""
    return RP.stage_avg_latency(v.ev)


@query("bi_measures")
def _bi_measures(v):
    """BI measures."""
    return RP.bi_measures(v.tr, _all_evals(v), v.reg)


@query("stage_status_breakdown")
def _stage_status_breakdown(v):
    """Events by stage and status."""
    return RP.stage_status_breakdown(v.ev)


@query("metric_trend")
def _metric_trend(v):
    """p95 latency and error-rate series of every window size."""
    return v.mts.where(F.col("metric_name").isin("latency_p95_ms", "error_rate_pct"))


@query("recent_traces")
def _recent_traces(v):
    """20 newest traces."""
    return RP.recent_traces(v.tr, 20)


@query("worst_recent_traces")
def _worst_recent_traces(v):
    """Slowest 10 of the 200 newest traces."""
    return RP.worst_recent_traces(v.tr, 200, 10)


@query("recent_traces_display")
def _recent_traces_display(v):
    """Display form of the 20 newest traces."""
    return RP.display_traces(RP.recent_traces(v.tr, 20))


@query("trace_rollup")
def _trace_rollup(v):
    """A2: dashboard rollup per trace."""
    return TR.trace_rollup(v.ev)


@query("stage_order")
def _stage_order(v):
    """The trace_events table: events with their 0-based order."""
    return TR.with_stage_order(v.ev).select(
        "event_id", "trace_id", "stage_name", "stage_order", "timestamp_start", "timestamp_end",
        "latency_ms", "status", "error")


@query("stage_order_violations")
def _stage_order_violations(v):
    """Traces whose stages are not a prefix of the pipeline order."""
    return TR.stage_order_violations(v.ev, FIXTURE_STAGE_ORDER)


@query("trace_waterfall")
def _trace_waterfall(v):
    """Offsets and running latency per trace."""
    return TR.trace_waterfall(v.ev, v.tr)


@query("trace_detail")
def _trace_detail(v):
    """Trace headers with their ordered events and their evaluations.

    The answered turns are traces too: they have evaluations, and no events.
    """
    turns = v.turns.select("trace_id", F.lit(None).cast("timestamp_ntz").alias("started_at"),
                           F.lit(None).cast("double").alias("total_latency_ms"), F.lit(False).alias("has_error"))
    traces = v.tr.select(*turns.columns).unionByName(turns)
    return TR.trace_detail(traces, v.ev, _all_evals(v))


@query("payload_summary")
def _payload_summary(v):
    """Summaries of the output payloads."""
    return RP.payload_summaries(v.ev, "output_summary")


@query("payload_arguments")
def _payload_arguments(v):
    """Typed summaries of the arguments of every call, those that are no JSON left out."""
    e = v.table("events")
    def quoted(c):
        return F.concat(F.lit('"'), c, F.lit('"'))
    failed = F.col("event_type") == "error"
    args = F.array(F.col("props"), F.col("value").cast("string"), quoted(F.col("event_type")), failed.cast("string"),
                   F.when(failed, quoted(F.lit("failed"))).otherwise(F.lit("null")),
                   F.concat(F.lit("["), F.concat_ws(",", "user_id", "event_id"), F.lit("]")),
                   F.col("user_id").cast("string"), F.concat(F.lit("<"), F.col("event_type"), F.lit(" object>")))
    return RP.argument_summaries(e.select(F.col("event_id").cast("string").alias("event_id"), args.alias("args")), "args")


@query("trace_events_of")
def _trace_events_of(v):
    """The events of one trace in start order: the trace of most stages (ties: least id)."""
    top = v.tr.orderBy(F.desc("num_stages"), "trace_id").select("trace_id").limit(1)
    return TR.events_of_trace(v.ev, top.scalar()).select(
        "trace_id", "event_id", "stage_name", "timestamp_start", "timestamp_end", "latency_ms", "status")


@query("sync_new_traces")
def _sync_new_traces(v):
    """Traces a second sync inserts (ids not stored by the first)."""
    cut = F.lit(EARLIER_RUN_CUTOFF).cast("timestamp_ntz")
    stored = v._stage("tr_earlier", lambda: assemble_traces(v.ev.where(F.col("timestamp_start") < cut)))
    return SK.sync_traces(v.ev, stored)


@query("scan_events")
def _scan_events(v):
    """The stage-event view over the events table."""
    return v.ev


@query("quality_trend")
def _quality_trend(v):
    """Quality along the conversation (turn position is the data's only
    ordering axis for evaluations)."""
    e = _all_evals(v).join(v.turns.select("trace_id", "turn"), "trace_id")
    return EVL.quality_trend(e, "turn")


# ---- dense vectors -------------------------------------------------------------

def _dense_nn(v: Views):
    """The 5 nearest other vectors of every vector of the embeddings table."""
    def build():
        e = v.table("embeddings")
        return RT.knn_dense(e.select("vec_id", "embedding"), "vec_id", "embedding",
                            e.select(F.col("vec_id").alias("qid"), "embedding"), 5,
                            exclude_self=True)
    return v._stage("dense_nn", build)


@query("knn_embeddings")
def _knn_embeddings(v):
    """V4 / J8 on the dense embeddings: 5 nearest neighbours, self excluded."""
    return _dense_nn(v).select("qid", "vec_id", "distance", "rank")


@query("label_hit_rate")
def _label_hit_rate(v):
    """A13 on dense vectors: share of vectors with a same-label neighbour in
    their top 5, per label and overall (rollup)."""
    from tracewise.functions.numeric import py_round_ratio
    e = v.table("embeddings").select("vec_id", "label")
    nn = _dense_nn(v).join(e, "vec_id").select("qid", F.col("label").alias("nlabel"))
    q = e.select(F.col("vec_id").alias("qid"), "label")
    per = (q.join(nn, "qid", "left").groupBy("qid", "label")
           .agg(F.max(F.col("nlabel") == F.col("label")).alias("hit")))
    g = per.rollup("label").agg(F.count(F.lit(1)).alias("n"),
                                F.sum(F.coalesce(F.col("hit"), F.lit(False)).cast("long")).alias("hits"))
    return g.select(F.coalesce(F.col("label").cast("string"), F.lit("OVERALL")).alias("label"),
                    "n", "hits", py_round_ratio(F.col("hits"), F.col("n"), 3).alias("hit_rate_at_5"))
