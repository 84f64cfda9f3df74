"""Readers: the driver's Parquet tables, the JSON-lines stage-event log and
the Markdown corpus.  Column pruning and filter pushdown into the Parquet
scan are left to Catalyst: callers select what they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.schemas import STAGE_EVENT

TEST_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of the test-data folder."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_parquet(spark: SparkSession, path: str, schema=None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.parquet(path)


def scan_stage_events(spark: SparkSession, path: str, with_corrupt: bool = False) -> DataFrame:
    """JSON-lines stage-event log with the declared schema.

    Blank lines are skipped by the JSON source; a malformed line fails the
    job.  With ``with_corrupt`` such lines come back in ``_corrupt_record``
    instead (all other columns null), to be routed to a side table.  A
    missing path gives an empty frame, like the reference.
    """
    schema = STAGE_EVENT
    if with_corrupt:
        # StructType.add mutates: build a new schema
        schema = T.StructType(list(STAGE_EVENT.fields) + [T.StructField("_corrupt_record", T.StringType())])
    try:
        df = (spark.read.schema(schema)
              .option("mode", "PERMISSIVE" if with_corrupt else "FAILFAST")
              .option("columnNameOfCorruptRecord", "_corrupt_record")
              .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX][X]")
              .json(path))
    except Exception as e:  # path does not exist
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise
    return df


def scan_corpus(spark: SparkSession, glob: str) -> DataFrame:
    """S3: one row per Markdown file: (source, text), whole file as text.

    ``source`` is the file's base name, the document key of the chunker.
    """
    return (spark.read.option("wholetext", "true").text(glob)
            .select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text")))
