"""Adapters that give the driver's generic tables the reference's shapes.

Every view here is a pure projection / join of the given tables, so its size
grows with them:

* ``stage_events``   events -> one stage call per event row
* ``turns``          conversations -> (trace_id, query, context, answer)
* ``calibration``    documents x labels -> labelled (context, query, answer)
* ``questions``      benchmark -> question table with expected sources
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewise.sources.tables import read_table

DIFFICULTIES = ["basic", "intermediate", "advanced"]


def stage_events(events: DataFrame) -> DataFrame:
    """``ev``: events as stage calls.

    trace = one user's events of one day; a stage's end is its start plus its
    latency; ``error`` events are failed stages.
    """
    is_err = F.col("event_type") == "error"
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("ts", "yyyyMMdd")).alias("trace_id"),
        F.col("user_id").cast("string").alias("query_id"),
        F.col("event_type").alias("stage_name"),
        F.col("ts").alias("timestamp_start"),
        F.expr("timestampadd(MICROSECOND, cast(round(value * 1000) as bigint), ts)")
         .alias("timestamp_end"),
        F.col("value").alias("latency_ms"),
        F.when(is_err, "error").otherwise("success").alias("status"),
        F.when(is_err, F.concat(F.lit("Error: "), F.col("props"))).alias("error"),
        F.lit(None).cast("string").alias("input_summary"),
        F.col("props").alias("output_summary"),
        F.lit(None).cast("string").alias("metadata"),
    )


def load_stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_events(read_table(spark, sf_dir, "events"))


def turns(conversations: DataFrame) -> DataFrame:
    """``turns``: each user row followed by an assistant row is one answered
    question.  trace_id = conv_id:turn of the user row; the context is every
    earlier turn of the conversation plus the question, newline-joined in
    turn order (a running ``collect_list`` bounded by the conversation)."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = (conversations
         .withColumn("next_role", F.lead("role").over(w))
         .withColumn("next_text", F.lead("text").over(w))
         .withColumn("ctx", F.array_join(F.collect_list("text").over(running), "\n")))
    return (c.where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
            .select(F.concat(F.col("conv_id").cast("string"), F.lit(":"),
                             F.col("turn").cast("string")).alias("trace_id"),
                    "conv_id", "turn",
                    F.col("text").alias("query"),
                    F.col("ctx").alias("context"),
                    F.col("next_text").alias("answer")))


def calibration(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``calib``: first line of a document is the query, the rest the answer,
    the whole text the context; quality 1 = good."""
    d = documents.select("doc_id", "text")
    first_nl = F.instr("text", "\n")
    return (d.join(labels.select("doc_id", "quality"), "doc_id")
            .select("doc_id",
                    F.col("text").alias("context"),
                    F.when(first_nl > 0, F.expr("substring(text, 1, instr(text, '\n') - 1)"))
                     .otherwise(F.col("text")).alias("query"),
                    F.when(first_nl > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
                     .otherwise(F.lit("")).alias("answer"),
                    F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label")))


def questions(benchmark: DataFrame) -> DataFrame:
    """``questions``: benchmark passages as questions, difficulty by item_id mod 3."""
    diff = F.element_at(F.array(*[F.lit(x) for x in DIFFICULTIES]),
                        (F.col("item_id") % 3 + 1).cast("int"))
    return benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("query"),
                            diff.alias("difficulty"))
