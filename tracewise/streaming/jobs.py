"""Structured Streaming forms of the trace and metric jobs (ST1-ST5).

The event log is an unbounded table.  Watermarks bound the state: a trace
closes after ``gap`` of inactivity (session window), a metric window closes
when the watermark passes its end.  Event time must be a ``timestamp``
(not ``timestamp_ntz``) for watermarks, so inputs are cast under the UTC
session zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions.numeric import py_round
from tracewise.operators.sinks import new_by_key, stored_rows, sync_traces_bucketed
from tracewise.schemas import STAGE_EVENT


def event_stream(spark, path: str, fmt: str = "json", schema=STAGE_EVENT,
                 max_files_per_trigger: int | None = None, with_corrupt: bool = False) -> DataFrame:
    """The growing event log as a stream (files appended to ``path``).

    A line that is no event fails the stream.  With ``with_corrupt`` (JSON lines) it
    comes as a row of nulls with the line in ``_corrupt_record``, and every row has its
    file, block start and block length, for ``routed_batches``.
    """
    if with_corrupt:
        schema = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "json":
        r = (r.option("mode", "PERMISSIVE" if with_corrupt else "FAILFAST")
             .option("columnNameOfCorruptRecord", "_corrupt_record")
             .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX][X]"))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    events = r.load(path)
    if with_corrupt:
        events = events.select("*", F.col("_metadata.file_path").alias("_file"),
                               F.col("_metadata.file_block_start").alias("_block_start"),
                               F.col("_metadata.file_block_length").alias("_block_length"))
    return events


def routed_batches(bad_path: str, then: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` body over ``event_stream(..., with_corrupt=True)`` that writes
    corrupt lines (line, file, block) to ``bad_path/epoch=<n>`` and passes the others on.

    An epoch replaces its own folder, so one that runs again after a failure puts no line there twice.
    """
    where = ["_file", "_block_start", "_block_length"]

    def run(batch: DataFrame, epoch: int) -> None:
        bad = batch.where(F.col("_corrupt_record").isNotNull()).select(F.col("_corrupt_record").alias("line"), *where)
        bad.write.mode("overwrite").parquet(f"{bad_path}/epoch={epoch}")
        then(batch.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record", *where), epoch)

    return run


def _as_event_time(df: DataFrame, cols=("timestamp_start", "timestamp_end")) -> DataFrame:
    for c in cols:
        if c in df.columns:
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def dedup_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """ST4: drop repeated deliveries of an event (event_id is the key)
    within the watermark delay."""
    ev = _as_event_time(events).withWatermark("timestamp_start", delay)
    return ev.dropDuplicatesWithinWatermark(["event_id"])


def trace_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """ST1: traces assembled from a stream; a trace closes after ``gap``
    without events and is emitted once (append mode).  Events later than the
    watermark are dropped, like late events of a stored trace;
    ``session_batches`` keeps them."""
    return _assembled(_as_event_time(events).withWatermark("timestamp_start", delay), gap).drop("session", "_last")


def _assembled(ev: DataFrame, gap: str) -> DataFrame:
    """Traces of the sessions of each trace id, with their session window and last start."""
    order = F.struct("timestamp_start", "event_id")
    slow = F.struct((-F.col("latency_ms")).alias("n"), F.col("timestamp_start"), F.col("event_id"))
    is_err = F.col("status") == "error"
    return (ev.groupBy("trace_id", F.session_window("timestamp_start", gap).alias("session"))
            .agg(F.min_by("query_id", order).alias("query_id"),
                 F.min("timestamp_start").alias("started_at"),
                 F.max_by("timestamp_end", order).alias("ended_at"),
                 py_round(F.sum("latency_ms"), 3).alias("total_latency_ms"),
                 F.count(F.lit(1)).cast("int").alias("num_stages"),
                 F.min_by("stage_name", slow).alias("slowest_stage"),
                 F.max("latency_ms").alias("slowest_stage_latency_ms"),
                 F.max(is_err).alias("has_error"),
                 F.min_by(F.when(is_err, F.col("stage_name")), F.when(is_err, order)).alias("error_stage"),
                 F.max("timestamp_start").alias("_last")))


def window_metrics_stream(traces: DataFrame, window_minutes: int, delay: str = "1 day") -> DataFrame:
    """ST2: tumbling-window trace metrics of one window size with exact
    percentiles; a window is emitted once the watermark passes its end.

    Two chained aggregates: the state of the first is a row per (window,
    latency) with its count, so equal values take no more room and a busy
    window is dealt over all tasks; closed windows then flow through the
    second, which weighs each latency with its count."""
    t = _as_event_time(traces, ("started_at",)).withWatermark("started_at", delay)
    size = f"{int(window_minutes)} minutes"
    values = (t.groupBy(F.window("started_at", size).alias("w"), "total_latency_ms")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("has_error").cast("int")).alias("errors")))
    return (values.groupBy(F.window(F.col("w"), size).alias("w"))
            .agg(F.sum("n").cast("double").alias("trace_count"),
                 (F.sum("errors") / F.sum("n") * 100.0).alias("error_rate_pct"),
                 *[F.percentile("total_latency_ms", F.lit(p), F.col("n")).alias(f"latency_p{round(100 * p)}_ms")
                   for p in (0.5, 0.95, 0.99)])
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    F.lit(int(window_minutes)).alias("window_minutes"), "trace_count",
                    "error_rate_pct", "latency_p50_ms", "latency_p95_ms", "latency_p99_ms"))


def session_batches(folder: str, gap_minutes: int = 30, delay_minutes: int = 60) -> Callable[[DataFrame, int], None]:
    """ST1 with every event accounted for: a ``foreachBatch`` body over the raw
    event stream.  Under ``folder``, per epoch:

    ``closed``  traces whose last event lies ``gap_minutes`` behind the watermark,
    ``late``    events that came behind the watermark, with it,
    ``open``    the events of traces that are still open,
    ``mark``    the newest event time so far.

    The watermark is the newest event time of all epochs before, less
    ``delay_minutes``.  At any time: events = events of closed traces + late + open.
    An epoch reads only what earlier epochs wrote and replaces its own folders, so
    one that is run again after a failure changes nothing.
    """
    mark_type = T.StructType([T.StructField("newest", T.TimestampType()), T.StructField("epoch", T.LongType())])

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        events = _as_event_time(batch)
        before = stored_rows(spark, f"{folder}/mark", mark_type).where(F.col("epoch") < epoch)
        last = before.orderBy(F.desc("epoch")).first()                    # one row
        seen = last.newest if last else None
        watermark = F.lit(seen) - F.expr(f"INTERVAL {int(delay_minutes)} MINUTES") if seen else F.lit(None).cast("timestamp")
        events = events.withColumn("_late", F.coalesce(F.col("timestamp_start") < watermark, F.lit(False)))

        def put(df: DataFrame, name: str) -> None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}/epoch={epoch}")

        put(events.where("_late").drop("_late").withColumn("watermark", watermark), "late")
        fresh = events.where(~F.col("_late")).drop("_late")
        if last:
            fresh = stored_rows(spark, f"{folder}/open/epoch={last.epoch}", fresh.schema).unionByName(fresh)
        put(events.agg(F.max("timestamp_start").alias("newest")).select(F.greatest("newest", F.lit(seen).cast("timestamp")).alias("newest")),
            "mark")
        now = spark.read.schema(mark_type).parquet(f"{folder}/mark/epoch={epoch}").first().newest
        sessions = _assembled(fresh, f"{int(gap_minutes)} minutes")
        # not by session.end: a filter on the grouping window would be pushed below the merging of sessions
        quiet = F.expr(f"INTERVAL {int(gap_minutes) + int(delay_minutes)} MINUTES")
        closed = sessions.where(F.col("_last") <= F.lit(now) - quiet).drop("session")
        put(closed.drop("_last"), "closed")
        over = closed.select("trace_id", F.col("started_at").alias("_from"), F.col("_last").alias("_to"))
        put(fresh.alias("e").join(over.alias("s"), F.col("e.trace_id").eqNullSafe(F.col("s.trace_id"))
                                  & F.col("timestamp_start").between(F.col("_from"), F.col("_to")), "left_anti"), "open")

    return run


def sync_batch(table_path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """ST3: ``foreachBatch`` body that appends the rows of a micro-batch
    whose key is not in the table yet.  Re-running an epoch writes nothing
    twice (the anti-join sees the first attempt's rows)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        stored = stored_rows(batch.sparkSession, table_path, batch.schema)
        rows = new_by_key(batch.dropDuplicates(key), stored, key)
        rows.write.mode("append").parquet(table_path)
    return run


def sync_traces_batch(table_path: str, buckets: int) -> Callable[[DataFrame, int], None]:
    """ST3 over raw events: ``foreachBatch`` body that appends the traces whose id the bucketed
    table lacks, reading only the buckets that the batch touches."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        sync_traces_bucketed(batch, table_path, buckets)
    return run


def threshold_alerts_stream(metrics: DataFrame, config: DataFrame) -> DataFrame:
    """ST5: closed metric windows breaching a configured threshold
    (stream-static join with the small config table)."""
    long = metrics.unpivot(["window_start", "window_end", "window_minutes"],
                           ["trace_count", "error_rate_pct", "latency_p50_ms", "latency_p95_ms",
                            "latency_p99_ms"], "metric_name", "value")
    j = long.join(F.broadcast(config), "metric_name")
    above = F.coalesce(F.col("direction"), F.lit("above")) == "above"
    hit = F.when(above, F.col("value") > F.col("threshold")).otherwise(F.col("value") < F.col("threshold"))
    return j.where(hit).select("metric_name", "window_start", "window_minutes",
                               F.col("value").alias("current_value"),
                               F.col("threshold").alias("baseline_value"))


OUTBOX = T.StructType([T.StructField("alert_type", T.StringType()), T.StructField("reference_id", T.StringType()),
                       T.StructField("metric_name", T.StringType()), T.StructField("window_start", T.TimestampType()),
                       T.StructField("window_minutes", T.IntegerType()), T.StructField("current_value", T.DoubleType()),
                       T.StructField("baseline_value", T.DoubleType())])


def outbox_batch(folder: str, query: str, log_path: str | None = None) -> Callable[[DataFrame, int], None]:
    """ST5 + L1: a ``foreachBatch`` sink for the flags of ``threshold_alerts_stream``.

    Alerts of an epoch go to ``folder/query=<query>/epoch=<n>``, less those that any
    other epoch or query holds and those with a successful attempt in the log of
    ``log_path``.  An epoch never reads its own folder and replaces it, so an epoch
    that was written but not committed puts nothing there twice when it runs again.
    """
    from tracewise.operators.alerts import outbox
    from tracewise.schemas import ALERT_LOG
    placed = T.StructType([*OUTBOX.fields, T.StructField("query", T.StringType()), T.StructField("epoch", T.LongType())])
    key = ["alert_type", "reference_id"]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        due = batch.select(
            F.lit("threshold").alias("alert_type"),
            F.concat_ws("|", "metric_name", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss"),
                        F.col("window_minutes").cast("string")).alias("reference_id"),
            "metric_name", F.col("window_start").cast("timestamp").alias("window_start"),
            F.col("window_minutes").cast("int").alias("window_minutes"),
            "current_value", "baseline_value").dropDuplicates(key)
        others = stored_rows(spark, folder, placed).where((F.col("query") != query) | (F.col("epoch") != epoch))
        due = new_by_key(due, others, key)
        if log_path:
            due = outbox(due, stored_rows(spark, log_path, ALERT_LOG))
        due.write.mode("overwrite").parquet(f"{folder}/query={query}/epoch={epoch}")

    return run
