"""Answer evaluation as bulk jobs (X1-X6, P8, P9, P10, P12, A10-A12, A15,
A16).

Scores are native column expressions over token arrays, so a table of
(trace_id, query, context, answer) is scored in one projection; the
evaluators become long rows by ``inline`` of an array -- no UDF.  They are
entries of a registry (name -> what it measures and a column expression): a
further one, native or a vectorised (pandas) function, appears in the scored
rows, the pivot, the combined report and the means of the reports.  Without a
judge, the judge rows are stored as skipped, like the reference without a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions.numeric import py_round
from tracewise.operators.partitioning import spread
from tracewise.functions.text import (content_tokens, faithfulness_overlap, is_fallback_answer,
                                      py_strip, relevance_keyword)
from tracewise.sources.lookups import (EVALUATOR_NAMES, FAITHFULNESS_EVALUATORS,
                                       FAITHFULNESS_REASONING, FALLBACK_PREFIX,
                                       JUDGE_CONTEXT_CHARS, JUDGE_SKIPPED_REASONING,
                                       RELEVANCE_REASONING)

EVAL_COLS = ["trace_id", "evaluator_name", "score", "reasoning", "skipped", "attempt"]

# ---- fixed values: prompt texts (must equal the reference) ---------------
RAG_PROMPT = """You are an ML/DS interview-prep assistant.

If the user's query is a simple greeting, basic conversation, check-in, or general chit-chat (e.g., "hi", "hello", "kaise ho", "how are you", "blaba", etc.), respond politely, warmly, and helpfully. Let them know you are an ML/DS interview-prep assistant and invite them to ask technical questions on topics like:
- Bias-variance tradeoff
- Gradient descent variants
- Classification metrics
- L1/L2 regularization
- Transformer attention

Otherwise, if the user asks a technical or conceptual question, answer it using ONLY the information in the context below. If the context does not contain the answer, say "I don't have enough information in my knowledge base to answer that" instead of guessing.

Context:
{context}

Question: {query}

Answer concisely and accurately. Where relevant, mention which source the information came from.
"""
NO_CONTEXT_PLACEHOLDER = "(No relevant context was retrieved.)"
JUDGE_FAITHFULNESS_PROMPT = """You are a strict evaluator judging whether an AI answer is fully supported by the given context.

Context:
{context}

Answer:
{answer}

Score the answer's faithfulness to the context from 0.0 (unsupported or contradicts the context) to 1.0 (fully supported, no unsupported claims).
Respond ONLY with JSON, no other text: {"score": <float 0-1>, "reasoning": "<one sentence>"}"""
JUDGE_RELEVANCE_PROMPT = """You are a strict evaluator judging whether an AI answer actually addresses the user's question.

Question: {query}
Answer: {answer}

Score relevance from 0.0 (does not address the question) to 1.0 (fully addresses it).
Respond ONLY with JSON, no other text: {"score": <float 0-1>, "reasoning": "<one sentence>"}"""
# ---------------------------------------------------------------------------


def fill(template: str, **cols: Column) -> Column:
    """Concatenate a fixed template with columns in its ``{name}`` slots
    (other braces stay literal)."""
    import re
    names = "|".join(cols)
    pieces, pos = [], 0
    for m in re.finditer(r"\{(" + names + r")\}", template):
        if m.start() > pos:
            pieces.append(F.lit(template[pos:m.start()]))
        pieces.append(cols[m.group(1)])
        pos = m.end()
    if pos < len(template):
        pieces.append(F.lit(template[pos:]))
    return F.concat(*pieces)


def render_rag_prompt(query, context) -> Column:
    """P10: the generation prompt; a blank context becomes the placeholder."""
    ctx = F.when(F.length(py_strip(context)) == 0, F.lit(NO_CONTEXT_PLACEHOLDER)).otherwise(context)
    return fill(RAG_PROMPT, context=ctx, query=query)


def render_judge_prompts(query, context, answer) -> tuple[Column, Column]:
    """P10: judge prompts; the faithfulness prompt cuts the context."""
    faith = fill(JUDGE_FAITHFULNESS_PROMPT,
                 context=F.substring(context, 1, JUDGE_CONTEXT_CHARS), answer=answer)
    rel = fill(JUDGE_RELEVANCE_PROMPT, query=query, answer=answer)
    return faith, rel


def judge_skipped() -> Column:
    return F.struct(F.lit(None).cast("double").alias("score"),
                    F.lit(JUDGE_SKIPPED_REASONING).alias("reasoning"),
                    F.lit(True).alias("skipped"))


class Inputs(NamedTuple):
    """What an evaluator reads: the texts of a turn, and their content words."""
    query: Column
    context: Column
    answer: Column
    query_tokens: Column
    context_tokens: Column
    answer_tokens: Column


@dataclass(frozen=True)
class Evaluator:
    """``score`` returns a struct(score, reasoning, skipped) column; ``measures``
    names the quality that reports average it under (``avg_<measures>_score``)."""
    name: str
    measures: str
    score: Callable[[Inputs], Column]


Registry = dict[str, Evaluator]
JUDGEMENT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("reasoning", T.StringType()),
                          T.StructField("skipped", T.BooleanType())])


def registry(judge: Callable[[Column, Column, Column, str], Column] | None = None,
             more: tuple[Evaluator, ...] = ()) -> Registry:
    """The four evaluators, in the order they are run and pivoted, then ``more``.

    ``judge(query, context, answer, kind)`` may return a struct(score, reasoning,
    skipped) column.
    """
    def heuristic(score: Column, reasoning: str) -> Column:
        return F.struct(score.alias("score"), F.lit(reasoning).alias("reasoning"), F.lit(False).alias("skipped"))

    def judged(kind: str) -> Callable[[Inputs], Column]:
        return lambda i: judge(i.query, i.context, i.answer, kind) if judge else judge_skipped()

    scores = [
        lambda i: heuristic(faithfulness_overlap(i.answer, i.context, i.answer_tokens, i.context_tokens), FAITHFULNESS_REASONING),
        lambda i: heuristic(relevance_keyword(i.query, i.answer, i.query_tokens, i.answer_tokens), RELEVANCE_REASONING),
        judged("faithfulness"), judged("relevance")]
    entries = [Evaluator(name, "faithfulness" if name in FAITHFULNESS_EVALUATORS else "relevance", score)
               for name, score in zip(EVALUATOR_NAMES, scores)]
    found: Registry = {}
    for e in [*entries, *more]:
        if e.name in found:
            raise ValueError(f"evaluator {e.name!r} is registered twice")
        found[e.name] = e
    return found


def pandas_evaluator(name: str, measures: str, fn: Callable) -> Evaluator:
    """An evaluator from ``fn(query, context, answer)`` of pandas series.

    It returns a series of scores or a frame (score, reasoning).  A null score is
    a skipped one; another number of rows than given, or a score outside 0 to 1,
    is an error.
    """
    import pandas as pd

    def score(query, context, answer):
        got = fn(query, context, answer)
        frame = got if isinstance(got, pd.DataFrame) else pd.DataFrame({"score": got})
        if len(frame) != len(query):
            raise ValueError(f"evaluator {name!r} returned {len(frame)} scores for {len(query)} rows")
        value = pd.to_numeric(frame["score"]).astype("float64").reset_index(drop=True)
        if not value.dropna().between(0, 1).all():
            raise ValueError(f"evaluator {name!r} returned a score outside 0 to 1")
        reason = frame["reasoning"].reset_index(drop=True) if "reasoning" in frame else pd.Series([""] * len(frame), dtype=object)
        return pd.DataFrame({"score": value, "reasoning": reason, "skipped": value.isna()})

    score.__annotations__ = {k: pd.Series for k in ("query", "context", "answer")} | {"return": pd.DataFrame}
    run = F.pandas_udf(score, JUDGEMENT)
    return Evaluator(name, measures, lambda i: run(i.query, i.context, i.answer))


def measure_means(evaluators: Registry | None = None) -> list[Column]:
    """Per measured quality the mean score over its evaluators."""
    by: dict[str, list[str]] = {}
    for e in (evaluators or registry()).values():
        by.setdefault(e.measures, []).append(e.name)
    return [F.avg(F.when(F.col("evaluator_name").isin(names), F.col("score"))).alias(f"avg_{m}_score")
            for m, names in by.items()]


def evaluate_all(turns: DataFrame, judge: Callable[[Column, Column, Column, str], Column] | None = None,
                 attempt: int = 0, evaluators: Registry | None = None) -> DataFrame:
    """X4 (scoring part): a row per (trace_id, query, context, answer) row and
    evaluator; ``evaluators`` defaults to the four with ``judge``."""
    evaluators = evaluators or registry(judge)
    q, c, a = F.col("query"), F.col("context"), F.col("answer")
    # token sets once per row (a separate projection keeps them shared);
    # tokenising long contexts is CPU work: use every core
    turns = spread(turns).select("trace_id", "query", "context", "answer",
                         content_tokens(q).alias("_qt"), content_tokens(c).alias("_ct"),
                         content_tokens(a).alias("_at"))
    given = Inputs(q, c, a, F.col("_qt"), F.col("_ct"), F.col("_at"))
    rows = []
    for e in evaluators.values():
        res = e.score(given)
        rows.append(F.struct(F.lit(e.name).alias("evaluator_name"), res["score"].alias("score"),
                             res["reasoning"].alias("reasoning"), res["skipped"].alias("skipped")))
    return (turns.select("trace_id", F.inline(F.array(*rows)))
            .withColumn("attempt", F.lit(attempt)))


def evaluate_missing(turns: DataFrame, stored: DataFrame, force: bool = False,
                     judge=None, evaluators: Registry | None = None) -> DataFrame:
    """Evaluation rows a run appends: only (trace_id, evaluator) pairs not
    stored yet; with ``force`` every pair again (appended as a new attempt)."""
    evaluators = evaluators or registry(judge)
    if force:
        nxt = stored.groupBy("trace_id").agg((F.max("attempt") + 1).alias("_next"))
        return (evaluate_all(turns, evaluators=evaluators).join(nxt, "trace_id", "left")
                .withColumn("attempt", F.coalesce(F.col("_next"), F.lit(0))).drop("_next"))
    # traces with all evaluators stored are not scored at all
    complete = (stored.where(F.col("evaluator_name").isin(list(evaluators))).groupBy("trace_id")
                .agg(F.count_distinct("evaluator_name").alias("_n")).where(F.col("_n") == len(evaluators)))
    fresh = evaluate_all(turns.join(complete, "trace_id", "left_anti"), evaluators=evaluators)
    return fresh.join(stored.select("trace_id", "evaluator_name").distinct(),
                      ["trace_id", "evaluator_name"], "left_anti")


def score_by_evaluator(evals: DataFrame) -> DataFrame:
    """A10: mean score and count per evaluator over non-skipped rows."""
    return (evals.where(~F.col("skipped"))
            .groupBy("evaluator_name")
            .agg(F.avg("score").alias("avg_score"), F.count("score").alias("n_scored")))


def evaluator_pivot(evals: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per trace, one score column per evaluator (first non-null
    score by attempt); every named column exists even when all null."""
    names = names or EVALUATOR_NAMES
    return (evals.groupBy("trace_id").pivot("evaluator_name", names)
            .agg(F.min_by(F.col("score"), F.when(F.col("score").isNotNull(), F.col("attempt")))))


def row_mean(cols: list[str]) -> Column:
    """Mean of the non-null values of ``cols``; null when all are null."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0,
                  F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr))


def combined_report(traces: DataFrame, evals: DataFrame, evaluators: Registry | None = None) -> DataFrame:
    """J2 + A11 + A12: traces left-joined with their evaluator columns and
    the mean quality score."""
    names = list(evaluators or registry())
    return (traces.join(evaluator_pivot(evals, names), "trace_id", "left")
            .withColumn("avg_quality_score", row_mean(names)))


def eval_coverage(evals: DataFrame) -> DataFrame:
    """Per evaluator the mean and count of real scores, with how many
    traces have at least one real score out of all evaluated traces."""
    per = (evals.where(F.col("score").isNotNull()).groupBy("evaluator_name")
           .agg(F.avg("score").alias("avg_score"), F.count("score").alias("n")))
    cov = evals.groupBy("trace_id").agg(F.max(F.col("score").isNotNull()).alias("_scored")) \
        .agg(F.count(F.when(F.col("_scored"), 1)).alias("scored_traces"),
             F.count(F.lit(1)).alias("total_traces"))
    return per.crossJoin(F.broadcast(cov))  # cov is one row


def calibration_summary(calib: DataFrame) -> DataFrame:
    """Mean heuristic scores of good vs bad examples (rounded to 3) and
    whether each heuristic separates them (on the unrounded means)."""
    s = calib.select("label",
                     faithfulness_overlap(F.col("answer"), F.col("context")).alias("f"),
                     relevance_keyword(F.col("query"), F.col("answer")).alias("r"))
    g, b = F.col("label") == "good", F.col("label") == "bad"
    agg = s.agg(F.avg(F.when(g, F.col("f"))).alias("gf"), F.avg(F.when(b, F.col("f"))).alias("bf"),
                F.avg(F.when(g, F.col("r"))).alias("gr"), F.avg(F.when(b, F.col("r"))).alias("br"))
    return agg.select(py_round("gf", 3).alias("avg_good_faithfulness"),
                      py_round("bf", 3).alias("avg_bad_faithfulness"),
                      py_round("gr", 3).alias("avg_good_relevance"),
                      py_round("br", 3).alias("avg_bad_relevance"),
                      (F.col("gf") > F.col("bf")).alias("faithfulness_separates_good_bad"),
                      (F.col("gr") > F.col("br")).alias("relevance_separates_good_bad"))


def quality_trend(evals: DataFrame, axis: str, evaluators: Registry | None = None) -> DataFrame:
    """Mean score per measured quality (faithfulness, relevance) over its
    evaluators along an ordering axis (creation date, or turn position)."""
    return evals.groupBy(axis).agg(*measure_means(evaluators), F.count(F.col("score")).alias("n_scores"))


def parse_responses(raw: Column) -> tuple[Column, Column, Column]:
    """(answer, char_length, is_fallback); a null reply stays null."""
    ans = py_strip(raw)
    return ans, F.length(ans), ans.startswith(FALLBACK_PREFIX)


def parse_judge_reply(reply: Column) -> Column:
    """JSON judge reply -> struct(score, reasoning, skipped).  A score given
    as a string counts as its number.  A reply that is not JSON or has no numeric
    score is skipped with a tagged reason."""
    parsed = F.try_parse_json(reply)
    score = F.try_variant_get(parsed, "$.score", "double")
    reason = F.when(parsed.isNull(), F.lit("[JUDGE ERROR] invalid JSON")) \
              .when(score.isNull(), F.lit("[JUDGE ERROR] 'score'")) \
              .otherwise(F.coalesce(F.try_variant_get(parsed, "$.reasoning", "string"), F.lit("")))
    return F.struct(score.alias("score"), reason.alias("reasoning"),
                    score.isNull().alias("skipped"))
