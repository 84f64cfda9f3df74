"""The registered queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewise.llm import op4_licences, op6_warc, op12_search
from tracewise.llm.common import read
from tracewise.llm.op1_resample import resample
from tracewise.llm.op10_decontaminate import overlaps
from tracewise.llm.op11_runs import periodic_runs
from tracewise.llm.op13_language import identify
from tracewise.llm.op2_repeats import remove_repeats
from tracewise.llm.op3_tokens import token_counts
from tracewise.llm.op5_private import find
from tracewise.llm.op7_rules import quality_rules
from tracewise.llm.op8_pieces import piece_report
from tracewise.llm.op9_jaccard import groups


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_licences.scan(read(spark, sf_dir, "documents"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_warc.warc_round_trip(read(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(read(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(read(spark, sf_dir, "documents"), planted=True)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_search.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_importance_resampling, op2_suffix_array_dedup, op3_token_counts, op4_license_scan, op5_private_data,
    op6_warc_revisits, op7_quality_rules, op8_sentencepiece, op9_jaccard_join, op10_decontamination, op11_periodic_runs,
    op12_ranked_search, op13_language_id)}

SQL = {"op4_license_scan": op4_licences.SQL, "op6_warc_revisits": op6_warc.SQL,
       "op12_ranked_search": op12_search.SQL}
