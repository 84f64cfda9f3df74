"""Sinks and table maintenance (K1, K2, K4 write, K6-K9).

Writes are plain DataFrame writes; "insert if absent" and "replace the
rows of a key" are expressed as anti-joins and unions, so they are
idempotent and safe to re-run after a failed attempt.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewise.schemas import EXPORT_COLUMNS


#: columns that say when a row was stored
STORED_AT = {"created_at", "detected_at"}
#: hash buckets of a table kept for incremental sync
SYNC_BUCKETS = 256


def append_events_jsonl(events: DataFrame, path: str) -> None:
    """K1: append stage events as JSON lines (ISO-8601 UTC times)."""
    (events.write.mode("append")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
     .json(path))


def new_by_key(fresh: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """K2: rows of ``fresh`` whose key is not stored yet (insert if absent;
    stored rows are never updated, late events of a stored trace stay out)."""
    return fresh.join(stored.select(*key).distinct(), key, "left_anti")


def sync_traces(events: DataFrame, stored_traces: DataFrame) -> DataFrame:
    """K2 for traces: assemble the event log, keep traces not stored yet."""
    from tracewise.operators.traces import assemble_traces
    return new_by_key(assemble_traces(events), stored_traces, ["trace_id"])


def append_bucketed(rows: DataFrame, path: str, key: str, buckets: int = SYNC_BUCKETS) -> None:
    """Append rows to a table partitioned by the hash bucket of ``key``."""
    rows = rows.withColumn("bucket", _bucket(key, buckets))
    rows.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def new_traces_bucketed(events: DataFrame, path: str, buckets: int = SYNC_BUCKETS) -> DataFrame:
    """K2 over a table of ``append_bucketed``: traces of ``events`` not stored yet.

    Reads the ids of the buckets that the events' ids fall into, no other
    file of the table, and assembles the events of new ids only.  The touched
    buckets are read first (at most ``buckets`` numbers come to the driver), so
    that they prune the scan as a partition filter.  An absent table
    holds nothing.
    """
    from tracewise.operators.traces import assemble_traces
    spark = events.sparkSession
    ids = events.select("trace_id").distinct().withColumn("bucket", _bucket("trace_id", buckets))
    touched = [r.bucket for r in ids.select("bucket").distinct().collect()]
    stored = stored_rows(spark, path, "trace_id string, bucket int").where(F.col("bucket").isin(touched))
    new = ids.join(stored, (ids["bucket"] == stored["bucket"]) & ids["trace_id"].eqNullSafe(stored["trace_id"]), "left_anti")
    new = new.select(F.col("trace_id").alias("_new"))
    return assemble_traces(events.join(new, F.col("trace_id").eqNullSafe(F.col("_new")), "left_semi"))


def sync_traces_bucketed(events: DataFrame, path: str, buckets: int = SYNC_BUCKETS) -> None:
    """K2 / ST3: append the traces of ``events`` that the bucketed table lacks.  Late events of a
    stored trace stay out; a second run over the same events appends nothing."""
    append_bucketed(new_traces_bucketed(events, path, buckets), path, "trace_id", buckets)


def stored_rows(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet folder, or no rows if nothing has been written there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def delete_then_insert(table: DataFrame, drop_when: Column, rows: DataFrame) -> DataFrame:
    """K6: the table without the rows matching ``drop_when``, plus ``rows``."""
    return table.where(~F.coalesce(drop_when, F.lit(False))).unionByName(rows.select(*table.columns))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """K7 / K4: (re)write a table as Parquet.  With ``partition_by`` and
    dynamic partition overwrite only the partitions present in ``df`` are
    replaced (e.g. recomputed metric windows)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by).option("partitionOverwriteMode", "dynamic")
    w.parquet(path)


def export_tables(tables: dict[str, DataFrame], out_dir: str, single_file: bool = False,
                  strict: bool = True) -> dict:
    """K8: export each table (its export column subset) as CSV with header
    and as Parquet, overwriting.  ``single_file`` coalesces to one file per
    table for BI tools (only for small tables).  If a table lacks export columns,
    time stamps of storing are set to now and any other is an error; without
    ``strict`` they are all left out."""
    written = {}
    for name, df in tables.items():
        cols = EXPORT_COLUMNS.get(name, df.columns)
        missing = set(cols) - set(df.columns)
        if strict and missing - STORED_AT:
            raise ValueError(f"export of {name}: no columns {sorted(missing - STORED_AT)}")
        out = df.select(*[F.current_timestamp().alias(c) if c in missing else c
                          for c in cols if strict or c not in missing])
        if single_file:
            out = out.coalesce(1)
        out.write.mode("overwrite").option("header", "true").csv(f"{out_dir}/{name}.csv")
        out.write.mode("overwrite").parquet(f"{out_dir}/{name}.parquet")
        written[name] = (f"{out_dir}/{name}.csv", f"{out_dir}/{name}.parquet")
    return written


def append_attempts(attempts: DataFrame, log_path: str) -> None:
    """K9: append alert attempt rows to the alert log."""
    attempts.write.mode("append").parquet(log_path)


def export_all(traces: DataFrame, trace_events: DataFrame, metrics: DataFrame,
               evaluations: DataFrame, regressions: DataFrame, reports: DataFrame,
               out_dir: str, single_file: bool = False) -> dict:
    """K8: the seven-table star schema (traces, trace_events,
    metrics_timeseries, evaluations, regressions, rca_reports and the
    report/regression bridge derived from the reports), CSV and Parquet;
    no export column may be missing."""
    from tracewise.operators.rca import bridge
    return export_tables({
        "traces": traces, "trace_events": trace_events, "metrics_timeseries": metrics,
        "evaluations": evaluations, "regressions": regressions, "rca_reports": reports,
        "rca_regression_bridge": bridge(reports),
    }, out_dir, single_file, strict=True)
