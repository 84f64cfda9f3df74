"""Dev tool: physical-plan facts of the headline queries (after a run, so
adaptive execution has decided): exchanges, broadcasts, sort/hash aggregates,
Python nodes, and what reaches the Parquet scans.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _once(plan: str) -> str:
    """Keep the nested plan of a cached relation only the first time it is
    printed (every scan of the cache prints it again)."""
    out, seen, skip_indent = [], set(), None
    for line in plan.splitlines():
        indent = len(line) - len(line.lstrip(" :|+-"))
        if skip_indent is not None:
            if indent > skip_indent:
                continue
            skip_indent = None
        out.append(line)
        if "InMemoryRelation" in line:
            key = re.sub(r"#\d+L?", "", line.lstrip(" :|+-"))
            if key in seen:
                skip_indent = indent
            seen.add(key)
    return "\n".join(out)


def builds(v):
    """Stage builds as a pipeline run executes them (inputs = stored tables)."""
    from pyspark.sql import functions as F
    from tracewise.operators import evaluate as EVL, metrics as M, rca as RC
    from tracewise.operators import regression as RG, retrieval as RT, traces as TR
    from tracewise.plans.catalog import _chunks
    return {
        "traces <- events (A1)": lambda: TR.assemble_traces(v.ev),
        "trace metrics <- traces (A5, 3 sizes)": lambda: M.window_trace_metrics(v.tr),
        "stage means <- events, traces (A6)": lambda: M.window_stage_means(v.ev, v.tr),
        "regressions <- metrics (W6+K3)": lambda: RG.detect_all(v.mts, v.cfg, 1440),
        "reports <- regressions (R6)": lambda: RC.rca_reports(v.reg),
        "stage order <- events (W8)": lambda: TR.with_stage_order(v.ev),
        "evaluations <- turns (X4)": lambda: EVL.evaluate_all(v.turns),
        "chunks <- documents (V1)": lambda: RT.chunk_documents(
            v.table("documents").select("doc_id", "source", "text", "n_chars"), "\n", 200,
            length_col="n_chars"),
        "kNN <- chunks, questions (V4)": lambda: RT.knn(
            _chunks(v).select("chunk_id", "text"), ["chunk_id"],
            v.questions.select("qid", "query"), 6, query_text="query"),
        "containment <- documents, questions (J7)": lambda: RT.contained_in(
            v.questions, v.table("documents").select("doc_id", "text")),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from tracewise.plans.common import Views
    from tracewise.session import get_session
    spark = get_session("local[8]", shuffle_partitions=16)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tw-plan-"))
    v = Views(spark, sf)
    print(f"# Physical plans of the stage builds ({sf}, local[8])\n")
    print("Final adaptive plans of each stage build over its stored inputs, as `bench.py` and a "
          "pipeline run execute them.  Exchanges are shuffles; broadcasts are bounded sides; "
          "`sort agg` is a partial + final sort-based aggregate (non-fixed-width buffers such as "
          "`min_by` of a string); `python` counts Arrow-batched Python nodes.  Hot-group ranking "
          "(none at this size) would add a range exchange and a checkpoint.\n")
    print("| stage | exchanges | broadcasts | hash agg | sort/object agg | windows | python | parquet scans: columns read, pushed filters |")
    print("|---|---|---|---|---|---|---|---|")
    for n, build in builds(v).items():
        df = build()
        df.write.format("noop").mode("overwrite").save()
        plan = _once(df._jdf.queryExecution().executedPlan().toString())
        c = lambda pat: len(re.findall(pat, plan))
        scans = []
        for m in re.finditer(r"FileScan parquet [^\n]*", plan):
            line = m.group(0)
            cols = re.search(r"ReadSchema: struct<([^>]*)>", line)
            pf = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            ncols = len(cols.group(1).split(",")) if cols and cols.group(1) else 0
            scans.append(f"{ncols} cols" + (f", {pf.group(1)}" if pf and pf.group(1) else ""))
        ex = len(re.findall(r"(?m)^[\s:|+-]*Exchange (?:hash|range|Single|Round)", plan))
        reused = c("ReusedExchange")
        print(f"| {n} | {ex}" + (f" (+{reused} reused)" if reused else "") + " "
              f"| {len(re.findall(r'(?m)^[\s:|+-]*BroadcastExchange', plan))} | {c('HashAggregate')} | {c('SortAggregate|ObjectHashAggregate')} "
              f"| {c('Window ')} | {c('MapInPandas|ArrowEvalPython|BatchEvalPython')} | {'; '.join(sorted(set(scans))) or '-'} |")


if __name__ == "__main__":
    main()
