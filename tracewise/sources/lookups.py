"""Small fixed lookup sets (bounded by construction, safe to broadcast).

These are values the reference fixes in code; they are stated here as plain
data so the operators can take them as parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewise.schemas import DETECTION_CONFIG

# ---- fixed values (must equal the reference for equal results) ----------
# Stage names of one pipeline run, in the order they fire.
EXPECTED_STAGE_ORDER = [
    "query_validation", "embedding_generation", "chromadb_retrieval",
    "top_k_ranking", "context_builder", "prompt_builder",
    "generation_gemini", "response_parser",
]
# Rolled-up window sizes in minutes.
DEFAULT_WINDOWS_MINUTES = [5, 60, 1440]
# Evaluator names, in the order they are run and pivoted.
EVALUATOR_NAMES = [
    "heuristic_faithfulness_overlap", "heuristic_relevance_keyword",
    "llm_judge_faithfulness", "llm_judge_relevance",
]
FAITHFULNESS_EVALUATORS = ["heuristic_faithfulness_overlap", "llm_judge_faithfulness"]
RELEVANCE_EVALUATORS = ["heuristic_relevance_keyword", "llm_judge_relevance"]
# Reasoning texts stored with the heuristic scores and the skipped judges.
FAITHFULNESS_REASONING = "Fraction of the answer's content words also present in retrieved context."
RELEVANCE_REASONING = "Fraction of the query's content words addressed in the answer."
JUDGE_SKIPPED_REASONING = "[FALLBACK: NO GEMINI_API_KEY SET] judge skipped"
# Reference detection configuration (metric, threshold, direction).
REFERENCE_DETECTION_CONFIG = [
    ("error_rate_pct", 10.0, "above"),
    ("latency_p95_ms", 100.0, "above"),
    ("stage_latency_avg_ms:chromadb_retrieval", 50.0, "above"),
]
# Name prefix of per-stage mean latency metrics.
STAGE_METRIC_PREFIX = "stage_latency_avg_ms:"
# Query length limit of the validation stage.
MAX_QUERY_LENGTH = 1000
# Context budget and chunk separator of context packing.
DEFAULT_MAX_CONTEXT_CHARS = 3000
CONTEXT_SEPARATOR = "\n\n---\n\n"
# Hash-embedding width.
EMBEDDING_DIM = 384
# Judge prompt context cut.
JUDGE_CONTEXT_CHARS = 4000
# Fallback answer markers.
FALLBACK_PREFIX = "[FALLBACK"
NO_INFO_PREFIX = "I don't have enough information"
# --------------------------------------------------------------------------


def detection_config(spark: SparkSession, rows=None) -> DataFrame:
    """Detection config as a DataFrame (metric_name, threshold, direction)."""
    rows = rows if rows is not None else REFERENCE_DETECTION_CONFIG
    return spark.createDataFrame([(m, float(t), d) for m, t, d in rows], DETECTION_CONFIG)


def expected_stage_order(spark: SparkSession, order=None) -> DataFrame:
    order = order or EXPECTED_STAGE_ORDER
    return spark.createDataFrame([(s, i) for i, s in enumerate(order)],
                                 "stage_name string, expected_pos int")
