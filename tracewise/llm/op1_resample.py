"""Quality classifier: importance resampling with hashed n-gram models.

Two generative bag-of-n-gram models over hash buckets, one of the target texts
(labelled good) and one of all raw texts, give each document the log ratio of
its likelihoods.  Adding Gumbel noise and taking the k largest draws k
documents without replacement in proportion to that importance weight.

The corpus counts cover every document; the target model is fitted on at most
``max_target`` labelled rows.  The k-th largest key is found by histograms that
narrow down to it (a few hundred counts at a time), so nothing is sorted in one
place.  Noise is a hash of the id and a seed: the draw is repeatable.

Defined results: a null or empty text has weight 0; repeated rows of an id have
the same noise and, at equal keys, stand or fall together; without target rows
all weights are 0 and the draw is uniform; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value, store

BUCKETS = 1 << 17
#: Labelled rows the target model may be fitted on; beyond it, those of smallest id hash.
MAX_TARGET = 100_000
SMOOTH = 1.0                   # pseudo-count on both sides of a bucket's ratio
SURE = 4.0                     # standard deviations from which a bucket's counts differ
SEED = 7


def buckets_of(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every word and word pair, letters lower-cased; ``n`` is a power of two."""
    w = W.words_of(data, offsets, lower=True)
    pair, at = W.ngrams(w.hash, w.row, 2)
    h = np.concatenate([w.hash, pair])
    return (h & np.uint64(n - 1)).astype(np.int64), np.concatenate([w.row, w.row[at]])


def target_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> list[int]:
    """Ids of good documents (quality 1, not toxic), at most ``max_target``."""
    good = labels.where("doc_id is not null and quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    return sorted(r[0] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).collect())


def fit(docs: DataFrame, target: list[int], buckets: int = BUCKETS, smooth: float = SMOOTH,
        sure: float = SURE) -> np.ndarray:
    """Log ratio of target and raw probability of each bucket."""
    ship_by_value()
    spark = docs.sparkSession
    ids = spark.sparkContext.broadcast(np.array(target, dtype=np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                b, row = buckets_of(data, offsets, buckets)
                raw += np.bincount(b, minlength=buckets)
                own = part.column(0).to_numpy(zero_copy_only=False)
                chosen = np.isin(own, ids.value) if len(ids.value) else np.zeros(len(own), dtype=bool)
                good += np.bincount(b[chosen[row]], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(good[some])],
                                         names=["bucket", "raw", "good"])

    counts = (docs.select("doc_id", "text").mapInArrow(run, "bucket long, raw long, good long")
              .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toArrow())
    raw, good = np.zeros(buckets), np.zeros(buckets)
    at = np.asarray(counts.column(0))
    raw[at], good[at] = np.asarray(counts.column(1)), np.asarray(counts.column(2))
    if not good.sum():
        return np.zeros(buckets)
    # the target's counts against those the raw model gives as much text; buckets whose
    # counts could differ by chance have the same probability in both models
    even = raw * (good.sum() / raw.sum())
    ratio = np.log(good + smooth) - np.log(even + smooth)
    return np.where(np.abs(good - even) > sure * np.sqrt(even + smooth), ratio, 0.0)


def score(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight (sum of the log ratios of a document's n-grams)."""
    ship_by_value()
    table, buckets = docs.sparkSession.sparkContext.broadcast(ratio), len(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                b, row = buckets_of(data, offsets, buckets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.bincount(row, minlength=part.num_rows)),
                     pa.array(np.bincount(row, weights=table.value[b], minlength=part.num_rows))],
                    names=["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_grams long, log_weight double")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    h = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 11).cast("double")
    u = (h + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def top_k_cut(scored: DataFrame, k: int, key: str = "gumbel_key", tie: str = "doc_id",
              bins: int = 512, small: int = 10_000) -> tuple[float, int] | None:
    """(key, id) of the k-th row by key descending, then id; None if k takes all rows.

    ``scored`` should be a stored table: each round counts its rows in equal
    bins between two bounds and goes on within the bin of the k-th row, until
    that holds few rows or one single key.
    """
    n, lo, hi = scored.agg(F.count("*"), F.min(key), F.max(key)).first()
    if k >= n:
        return None
    if k <= 0:
        return float("inf"), -(1 << 63)
    rest, top, rows = n, k, scored                # the bounds' rows, and the rank among them
    inside = F.lit(True)
    while rest > small and hi > lo:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        b = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        got = {r["b"]: r for r in rows.where(inside).groupBy(b.alias("b")).agg(
            F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
        for at in sorted(got, reverse=True):
            if top <= got[at]["n"]:
                break
            top -= got[at]["n"]
        if got[at]["n"] == rest and (got[at]["lo"], got[at]["hi"]) == (lo, hi):
            break
        rest, lo, hi = got[at]["n"], got[at]["lo"], got[at]["hi"]
        inside = F.col(key).between(lo, hi)
    if hi == lo and rest > small:                 # one key for all: the id decides
        ids = rows.where(inside).select(F.coalesce(F.col(tie), F.lit(-(1 << 63))).cast("long").alias("t"))
        return lo, _kth_smallest(ids, top, bins, small)
    last = rows.where(inside).select(F.col(key).alias("v"), F.coalesce(F.col(tie), F.lit(-(1 << 63))).alias("t")) \
        .orderBy(F.desc("v"), "t").limit(top).agg(F.min(F.struct("v", (-F.col("t").cast("decimal(20,0)")).alias("t")))).first()[0]
    return last["v"], int(-last["t"])


def _kth_smallest(ids: DataFrame, k: int, bins: int, small: int) -> int:
    n, lo, hi = ids.agg(F.count("*"), F.min("t"), F.max("t")).first()
    while n > small and hi > lo:
        width = max(1, -(-(hi - lo + 1) // bins))
        b = F.floor((F.col("t").cast("decimal(20,0)") - F.lit(lo)) / F.lit(width)).cast("int")
        got = {r["b"]: r for r in ids.where(F.col("t").between(lo, hi)).groupBy(b.alias("b")).agg(
            F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
        for at in sorted(got):
            if k <= got[at]["n"]:
                break
            k -= got[at]["n"]
        n, lo, hi = got[at]["n"], got[at]["lo"], got[at]["hi"]
    if lo == hi:
        return lo
    return ids.where(F.col("t").between(lo, hi)).orderBy("t").limit(k).agg(F.max("t")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, buckets: int = BUCKETS,
             max_target: int = MAX_TARGET, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, gumbel_key, kept (drawn).

    Without ``k`` as many are drawn as the labels let expect to be like the
    target: the share of good rows among the labelled ones, of all documents.
    """
    docs = docs.select("doc_id", "text")
    ratio = fit(docs, target_ids(labels, max_target), buckets)
    scored = store(score(docs, ratio).withColumn("gumbel_key", F.col("log_weight") + gumbel(F.col("doc_id"), seed)), "scores")
    if k is None:
        good, n = labels.where("quality is not null").agg(
            F.count(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1)), F.count("*")).first()
        k = round(scored.count() * good / n) if n else scored.count()
    cut = top_k_cut(scored, k)
    tie = F.coalesce("doc_id", F.lit(-(1 << 63)))
    kept = F.lit(True) if cut is None else (F.col("gumbel_key") > cut[0]) | ((F.col("gumbel_key") == cut[0]) & (tie <= cut[1]))
    return scored.withColumn("kept", kept)
