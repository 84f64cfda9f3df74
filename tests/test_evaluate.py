from pyspark.sql import functions as F

from tracewise.functions.numeric import py_round_ratio
from tracewise.functions.text import (content_tokens, faithfulness_overlap, is_fallback_answer,
                                      relevance_keyword, validate_query)
from tracewise.operators.evaluate import (calibration_summary, combined_report, evaluate_all,
                                          evaluate_missing, evaluator_pivot, parse_judge_reply)


def test_python_rounding_of_ratios(spark):
    pairs = [(k, n) for n in range(1, 120) for k in range(0, n + 1)]
    df = spark.createDataFrame(pairs, "k long, n long")
    got = {(r.k, r.n): r.s for r in df.select("k", "n", py_round_ratio(F.col("k"), F.col("n"), 3)
                                               .alias("s")).collect()}
    assert all(got[(k, n)] == round(k / n, 3) for k, n in pairs)


def test_scores_and_edge_cases(spark):
    rows = [("q1", "How does gradient clipping stabilise training?",
             "Gradient clipping caps the norm of gradients so training stays stable.",
             "Clipping the gradient norm keeps training stable."),
            ("q2", "What is it?", "", "It is what it is."),
            ("q3", None, "context words here", None),
            ("q4", "the and of", "the and of", "the and of")]
    df = spark.createDataFrame(rows, "trace_id string, query string, context string, answer string")
    out = {r.trace_id: r for r in df.select(
        "trace_id", faithfulness_overlap(F.col("answer"), F.col("context")).alias("f"),
        relevance_keyword(F.col("query"), F.col("answer")).alias("r"),
        F.sort_array(content_tokens(F.col("answer"))).alias("tok")).collect()}
    assert out["q1"].tok == ["clipping", "gradient", "keeps", "norm", "stable", "training"]
    assert out["q1"].f == round(5 / 6, 3)
    assert out["q1"].r == round(3 / 6, 3)       # how does gradient clipping stabilise training
    assert out["q2"].f == 0.0 and out["q3"].f == 0.0 and out["q3"].r == 0.0
    assert out["q4"].f == 0.0 and out["q4"].r == 0.0


def test_validate_and_fallback(spark):
    df = spark.createDataFrame([(None,), ("   ",), ("x" * 1000,), (" " + "x" * 1001,), ("ok \t",)],
                               "t string")
    q, ok, why = validate_query(F.col("t"))
    r = df.select(q.alias("q"), ok.alias("ok"), why.alias("why")).collect()
    assert [x.ok for x in r] == [False, False, True, False, True]
    assert r[0].why == "Query cannot be None" and r[1].why == "Query cannot be empty"
    assert r[3].why == "Query too long (1001 chars). Max is 1000." and r[4].q == "ok"
    fb = spark.createDataFrame([(" [FALLBACK: x]",), ("I don't have enough information here",),
                                ("fine",)], "a string").select(is_fallback_answer(F.col("a"))).collect()
    assert [x[0] for x in fb] == [True, True, False]


def _turns(spark):
    return spark.createDataFrame(
        [("t1", "what is dropout regularization", "dropout randomly zeroes units", "dropout zeroes units"),
         ("t2", "explain batch norm", "batch norm normalises activations", "it normalises activations")],
        "trace_id string, query string, context string, answer string")


def test_evaluate_missing_force_and_pivot(spark):
    t = _turns(spark)
    stored = evaluate_all(t.where("trace_id = 't1'"))
    missing = evaluate_missing(t, stored)
    assert missing.where("trace_id = 't1'").count() == 0 and missing.count() == 4
    forced = evaluate_missing(t, stored, force=True)
    assert {r.attempt for r in forced.where("trace_id = 't1'").collect()} == {1}
    allev = stored.unionByName(missing)
    piv = evaluator_pivot(allev)
    assert set(piv.columns) == {"trace_id", "heuristic_faithfulness_overlap",
                                "heuristic_relevance_keyword", "llm_judge_faithfulness",
                                "llm_judge_relevance"}
    rep = {r.trace_id: r for r in combined_report(t.select("trace_id"), stored).collect()}
    assert rep["t2"].avg_quality_score is None
    r1 = rep["t1"]
    assert abs(r1.avg_quality_score - (r1.heuristic_faithfulness_overlap +
                                       r1.heuristic_relevance_keyword) / 2) < 1e-12


def test_calibration_and_judge_reply(spark):
    rows = [("a", "what is a tensor", "a tensor is a multi dimensional array", "good"),
            ("b", "what is a tensor", "bananas are yellow fruit", "bad")]
    df = spark.createDataFrame([(q, a, ctx, lab) for _, q, a, lab in rows
                                for ctx in ["tensor multi dimensional array of numbers"]],
                               "query string, answer string, context string, label string")
    r = calibration_summary(df).first()
    assert r.faithfulness_separates_good_bad and r.relevance_separates_good_bad
    j = spark.createDataFrame([('{"score": 0.8, "reasoning": "fine"}',), ("not json",), ('{"k": 1}',)],
                              "reply string").select(parse_judge_reply(F.col("reply")).alias("j")).collect()
    assert j[0].j.score == 0.8 and not j[0].j.skipped
    assert j[1].j.skipped and j[2].j.skipped and j[2].j.reasoning == "[JUDGE ERROR] 'score'"


def test_fixed_formatting_matches_python(spark):
    import random
    from tracewise.functions.fmt import fixed
    random.seed(3)
    vals = [0.125, 0.375, 53.405, 1.005, 1.015, 2.675, -2.675, 0.0, -0.0, 12.5, -0.25, 1273.855]
    vals += [round(random.uniform(-900, 900), random.randint(0, 4)) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for n, plus in [(2, False), (1, True)]:
        spec = ("+" if plus else "") + f".{n}f"
        rows = df.select("x", fixed("x", n, plus=plus, settle_digits=None).alias("s")).collect()
        assert all(r.s == format(r.x, spec) for r in rows)


def test_py_round_matches_python(spark):
    import random
    from tracewise.functions.numeric import py_round
    random.seed(9)
    vals = [0.0625, 0.125, 2.675, 1.0005, -2.5e-4, 1234.5675, 0.0, -0.0, 99999.9995]
    vals += [random.uniform(-5000, 5000) for _ in range(2000)]
    vals += [round(random.uniform(0, 100), 4) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    rows = df.select("x", py_round("x", 3).alias("r")).collect()
    assert all(r.r == round(r.x, 3) for r in rows)
