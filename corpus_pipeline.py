"""A training-corpus pipeline over ``documents``: five stages, each an operator of tracewise.llm.

Every stage is (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.

Defined results: an empty table goes through as one; null texts fail the
quality rules; extra columns of documents are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.llm import op5_private, op7_rules, op8_pieces, op9_jaccard, op10_decontaminate
from tracewise.llm.common import read, store
from tracewise.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects."""
    judged, _ = op7_rules.judge(docs, read(spark, sf_dir, "labels"), prefix="__q_")
    return judged.where("__q_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 80 percent), that of the least doc_id."""
    return op9_jaccard.one_of_each(docs, n=5, similar=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return op10_decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows."""
    masked = op5_private.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) \
        if "n_chars" in docs.columns else masked


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_pieces, ids, round_trip: the texts as SentencePiece ids."""
    path = tokenizer_path("piece_bpe_32k.model")
    ids = op8_pieces.encode(docs.select("doc_id", "source", "lang", "text"), path, decoded="decoded")
    return ids.select(
        "doc_id", "source", "lang", F.size("ids").cast("long").alias("n_pieces"), "ids",
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", decontaminate),
          ("private_data", private_data), ("sentencepiece", pieces)]

#: Learning, span classification and encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is stored and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
