"""Evaluators beyond the four: native and pandas entries in every output."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracewise.operators import evaluate as E
from tracewise.operators.report import bi_measures

TURNS = [("t1", "what is a norm", "a norm is a length", "a norm is a length"),
         ("t2", "what is a norm", None, "fine"), ("t3", None, "", None)]


@pytest.fixture()
def turns(spark):
    return spark.createDataFrame(TURNS, "trace_id string, query string, context string, answer string")


def brevity(i):
    return F.struct((1.0 / (1.0 + F.size(i.answer_tokens))).alias("score"), F.lit("short is good").alias("reasoning"),
                    F.lit(False).alias("skipped"))


def test_more_evaluators_in_all_outputs(spark, turns):
    def exactness(query, context, answer):
        return pd.Series([None if c is None or a is None else float(c == a) for c, a in zip(context, answer)], dtype="float64")

    found = E.registry(more=(E.Evaluator("brevity", "style", brevity), E.pandas_evaluator("exact", "style", exactness)))
    evals = E.evaluate_all(turns, evaluators=found)
    rows = {(r.trace_id, r.evaluator_name): r for r in evals.collect()}
    assert len(rows) == 18 and evals.columns == E.EVAL_COLS
    assert rows["t1", "exact"].score == 1.0 and not rows["t1", "exact"].skipped
    assert rows["t2", "exact"].score is None and rows["t2", "exact"].skipped
    four = {(r.trace_id, r.evaluator_name): r for r in E.evaluate_all(turns).collect()}
    assert len(four) == 12 and all(rows[k] == r for k, r in four.items())

    piv = {r.trace_id: r for r in E.evaluator_pivot(evals, list(found)).collect()}
    assert piv["t1"].exact == 1.0 and piv["t1"].brevity == rows["t1", "brevity"].score
    own = [r.score for k, r in rows.items() if k[0] == "t1" and r.score is not None]
    rep = {r.trace_id: r for r in E.combined_report(turns.select("trace_id"), evals, found).collect()}
    assert len(own) == 4 and rep["t1"].avg_quality_score == pytest.approx(sum(own) / 4)
    style = [r.score for k, r in rows.items() if k[1] in ("brevity", "exact") and r.score is not None]
    day = E.quality_trend(evals.withColumn("day", F.lit(1)), "day", found).first()
    assert day.avg_style_score == pytest.approx(sum(style) / len(style))
    traces = spark.createDataFrame([("t1", 5.0, False)], "trace_id string, total_latency_ms double, has_error boolean")
    measured = bi_measures(traces, evals, spark.createDataFrame([], "severity string"), found).first()
    assert measured.avg_style_score == day.avg_style_score and measured.avg_faithfulness_score == day.avg_faithfulness_score

    # a run over turns whose four are stored adds the new ones only, and nothing the second time
    stored = E.evaluate_all(turns)
    new = E.evaluate_missing(turns, stored, evaluators=found)
    assert {r.evaluator_name for r in new.collect()} == {"brevity", "exact"} and new.count() == 6
    assert E.evaluate_missing(turns, evals, evaluators=found).count() == 0


def test_registry_refuses(turns):
    with pytest.raises(ValueError, match="twice"):
        E.registry(more=(E.Evaluator("llm_judge_relevance", "relevance", brevity),))
    for bad, what in ((lambda q, c, a: pd.Series([2.0] * len(q)), "outside 0 to 1"),
                      (lambda q, c, a: pd.Series([0.5] * (len(q) + 1)), "scores for")):
        found = E.registry(more=(E.pandas_evaluator("bad", "style", bad),))
        with pytest.raises(Exception, match=what):
            E.evaluate_all(turns, evaluators=found).collect()
