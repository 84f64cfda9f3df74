"""Corpus and retrieval as batch jobs.

* Chunking is a per-document fold (``aggregate`` over the paragraph array):
  documents are the unit of parallelism and no text is cut.
* The hashed bag-of-words embedding is kept sparse and integer: (item,
  bucket, count).  Scores use the exact integer dot product and
  ``dot / (sqrt(|q|^2) * sqrt(|c|^2))``, a fixed sequence of correctly
  rounded IEEE operations, so every engine ranks identically.
* Exact kNN is a block join in one plan: queries fall into blocks of bounded
  size by hash, items into parts, and each (block, part) is a cell of one
  shuffle.  A task holds a cell's queries, streams its items past them (one
  matrix product a batch) and keeps the top-n of each query.  No (query,
  item) pair becomes a row; a per-query merge of the lists gives the global
  top-n.  The number of blocks is a scalar subquery, so neither queries nor
  items pass the driver and nothing runs while planning.
* Passage containment (expected sources) is an equi-join on the passage's
  rarest gram by the corpus's own counts, verified by ``instr``: no cross join.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.functions.hashing import md5_bucket
from tracewise.operators.partitioning import spread
from tracewise.functions.text import EVAL_STOPWORDS, PY_WHITESPACE_CLASS, py_strip, validate_query
from tracewise.session import checkpoint_dir
from tracewise.sources.lookups import (CONTEXT_SEPARATOR, DEFAULT_MAX_CONTEXT_CHARS,
                                       EMBEDDING_DIM)

def _ship_by_value() -> None:
    """Pickle this module's task functions by value, so Python workers need
    no installed copy of the package (the scorers below run in mapInArrow)."""
    import sys
    from pyspark import cloudpickle
    mod = sys.modules[__name__]
    if mod not in _SHIPPED:
        cloudpickle.register_pickle_by_value(mod)
        _SHIPPED.append(mod)


_SHIPPED: list = []

# token pattern of the hashed vectoriser: runs of 2+ word characters
EMBED_TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# dense float64 vectors of one block of queries, which a task holds
QUERY_BLOCK_BYTES = 64 << 20
# queries of a block, if they fall into several anyway
QUERY_BLOCK_ROWS = 4096
# items scored against a block, and queries of it, at a time
_ITEM_ROWS, _QUERY_ROWS = 2048, 1024
# share of a batch's pairs from which all get their exact distance; rows of a result batch; tokens a task remembers
_MANY, _RESULT_ROWS, _KNOWN_TOKENS = 0.02, 1 << 16, 1 << 20
# bits of the bitmaps that keep rows out of shuffles: 2 ** 20, 128 KB
_BITS = 20
# paragraphs of one part of the chunking fold
_CHUNK_PART = 256


# ---- V1 / V2: chunking -----------------------------------------------------

def chunk_text(text: Column, separator: str = "\n\n", min_len: int = 200) -> Column:
    """Array of chunks: split on ``separator``, strip, drop blank paragraphs,
    merge greedily until the buffer (each paragraph followed by the
    separator) reaches ``min_len`` characters, flush the tail.

    The fold carries the buffer length, so a step costs one concatenation.  Spark
    copies what a fold carries at every step: paragraphs are folded in parts of
    ``_CHUNK_PART``, and the chunks so far are carried from part to part only;
    a flushed buffer is stripped by cutting the trailing separator (the
    paragraphs are stripped already) unless the separator is not blank.
    """
    ws = PY_WHITESPACE_CLASS
    # most paragraphs have no blank at an end: two characters tell
    paras = F.filter(F.transform(F.split(text, re.escape(separator), -1), lambda p: F.when(
                         F.concat(F.substring(p, 1, 1), F.substring(p, -1, 1)).rlike(ws), F.regexp_replace(p, f"^{ws}+|{ws}+$", ""))
                         .otherwise(p)),
                     lambda p: F.length(p) > 0)
    sep_len = len(separator)
    blank_sep = separator.strip() == ""
    none = F.array().cast("array<string>")

    def finished(buf, n):
        return F.substring(buf, 1, n - sep_len) if blank_sep else py_strip(buf)

    def step(acc, p):
        buf = F.concat(acc["buf"], p, F.lit(separator))
        n = acc["n"] + F.length(p) + F.lit(sep_len)
        full = n >= min_len
        return F.struct(
            F.when(full, F.concat(acc["chunks"], F.array(finished(buf, n)))).otherwise(acc["chunks"])
             .alias("chunks"),
            F.when(full, F.lit("")).otherwise(buf).alias("buf"),
            F.when(full, F.lit(0)).otherwise(n).alias("n"))

    def once(value, body):                   # ``body`` of a value that is computed once
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def part(acc, ps):
        inner = F.aggregate(ps, F.struct(none.alias("chunks"), acc["buf"].alias("buf"), acc["n"].alias("n")), step)
        return once(inner, lambda i: F.struct(F.concat(acc["chunks"], i["chunks"]).alias("chunks"), i["buf"].alias("buf"),
                                              i["n"].alias("n")))

    def finish(acc):
        tail = finished(acc["buf"], acc["n"])
        return F.when(acc["n"] > 0, F.concat(acc["chunks"], F.array(tail))).otherwise(acc["chunks"])

    def parts(ps):
        return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(ps) - 1) / _CHUNK_PART), F.lit(0)).cast("int")),
                           lambda k: F.slice(ps, k * _CHUNK_PART + 1, F.lit(_CHUNK_PART)))

    init = F.struct(none.alias("chunks"), F.lit("").alias("buf"), F.lit(0).alias("n"))
    return once(paras, lambda ps: F.when(ps.isNotNull(), F.aggregate(parts(ps), init, part, finish)))


def chunk_documents(docs: DataFrame, separator: str = "\n\n", min_len: int = 200,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """V1 + V2: one row per chunk: id, source, chunk_index, chunk_id
    ``<id>::chunk-<i>`` and the chunk text."""
    keep = [c for c in docs.columns if c != text_col]
    out = spread(docs).select(*keep, F.posexplode(chunk_text(F.col(text_col), separator, min_len))
                              .alias("chunk_index", "text"))
    return out.withColumn("chunk_id", F.concat(F.col(id_col).cast("string"), F.lit("::chunk-"),
                                               F.col("chunk_index").cast("string")))


# ---- V3: hashed embedding ----------------------------------------------------

def token_buckets(text: Column, dim: int = EMBEDDING_DIM, stopwords: list[str] | None = None) -> Column:
    """The bucket of every token of a text that is no stopword, as one array
    (tokens repeat); a null text has none."""
    sw = stopwords if stopwords is not None else EVAL_STOPWORDS
    tokens = F.regexp_extract_all(F.lower(text), F.lit(EMBED_TOKEN_PATTERN), 0)
    kept = F.filter(tokens, lambda t: ~t.isin(sw))
    return F.coalesce(F.transform(kept, lambda t: md5_bucket(t, dim)), F.array().cast("array<int>"))


def _list_array(ends: np.ndarray, values):
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values)


def _summed(keys: list, group: np.ndarray, first: np.ndarray, bucket: np.ndarray, cnt: np.ndarray, names: list[str], dim: int):
    """One row a group that has a token: its keys (those of row ``first``), the buckets in order and their counts."""
    cell, at = np.unique(group * dim + bucket, return_inverse=True)
    total = np.bincount(at, weights=cnt, minlength=len(cell)).astype(np.int64)       # exact below 2 ** 53
    some, size = np.unique(cell // dim, return_counts=True)
    ends, rows = np.cumsum(size), pa.array(first[some])
    return pa.RecordBatch.from_arrays([*(k.take(rows) for k in keys), _list_array(ends, pa.array((cell % dim).astype(np.int32))),
                                       _list_array(ends, pa.array(total))], names=[*names, "bucket", "cnt"])


def hash_embed(df: DataFrame, key: list[str], text_col: str = "text", dim: int = EMBEDDING_DIM,
               stopwords: list[str] | None = None) -> DataFrame:
    """V3: sparse hashed term counts (key..., bucket, cnt) plus the squared
    norm ``sq`` of the count vector of each item (repeated per row).

    Rows of equal keys are one item, null keys too.  Counts are summed by key in every batch; one sparse vector a key
    is shuffled, and the vectors of a key meet in order, one batch after the other.
    """
    keys = df.select(*key).schema.fields
    sparse = T.StructType([*keys, T.StructField("bucket", T.ArrayType(T.IntegerType())),
                           T.StructField("cnt", T.ArrayType(T.LongType()))])

    def by_batch(batches):
        for batch in batches:
            if not len(batch):
                continue
            code = np.zeros(len(batch), np.int64)
            for c in key:
                own = batch.column(c).dictionary_encode(null_encoding="encode")
                code = np.unique(code * len(own.dictionary) + own.indices.to_numpy(), return_inverse=True)[1]
            _, first, group = np.unique(code, return_index=True, return_inverse=True)
            value, size = _lists(batch.column("vec"))
            yield _summed([batch.column(c) for c in key], np.repeat(group, size), first, value.astype(np.int64),
                          np.ones(len(value)), key, dim)

    def rows(batch):
        size = pc.list_value_length(batch.column("cnt")).to_numpy(zero_copy_only=False)
        bucket, cnt = batch.column("bucket").flatten(), batch.column("cnt").flatten()
        of = np.repeat(np.arange(len(size)), size)
        square = np.bincount(of, weights=cnt.to_numpy().astype(np.float64) ** 2, minlength=len(size)).astype(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(of)) for c in key), bucket, cnt, pa.array(square[of])],
                                          names=[*key, "bucket", "cnt", "sq"])

    def by_key(batches):
        held = None                                   # the vector of the last key, which may go on
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            new = np.zeros(len(batch) - 1, bool)
            for c in key:
                a, b = batch.column(c)[:-1], batch.column(c)[1:]
                same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
                new |= ~same.to_numpy(zero_copy_only=False)
            group = np.append(0, np.cumsum(new))
            value, size = _lists(batch.column("bucket"))
            both = _summed([batch.column(c) for c in key], np.repeat(group, size), np.append(0, np.flatnonzero(new) + 1),
                           value.astype(np.int64), batch.column("cnt").flatten().to_numpy(), key, dim)
            held = both.slice(len(both) - 1)
            yield rows(both.slice(0, len(both) - 1))
        if held is not None:
            yield rows(held)

    _ship_by_value()
    vectors = df.select(*key, token_buckets(F.col(text_col), dim, stopwords).alias("vec")).mapInArrow(by_batch, sparse)
    out = T.StructType([*keys, T.StructField("bucket", T.IntegerType()), T.StructField("cnt", T.LongType()),
                        T.StructField("sq", T.LongType())])
    return vectors.repartition(*key).sortWithinPartitions(*key).mapInArrow(by_key, out)


# ---- V4: exact kNN -----------------------------------------------------------

def _lists(col) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column back to back, and the length of each list."""
    values = col.flatten()
    return values.to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)


class _Counts:
    """Vectors given as bucket lists: squared L2 of the normalised count vectors."""

    def __init__(self, dim: int):
        self.dim = dim

    def matrix(self, col) -> np.ndarray:
        values, size = _lists(col)
        cell = np.repeat(np.arange(len(size)), size) * self.dim + values
        return np.bincount(cell, minlength=len(size) * self.dim).reshape(len(size), self.dim).astype(np.float64)

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``own`` and ``unit``: a distance is about own_q + own_i - 2 unit_q . unit_i."""
        sq = (m * m).sum(axis=1)
        return (sq > 0).astype(np.float64), m / np.sqrt(np.where(sq > 0, sq, 1.0))[:, None]

    def settled(self, sq_i: np.ndarray, sq_q: np.ndarray, dot: np.ndarray) -> np.ndarray:
        denom = np.sqrt(sq_q) * np.sqrt(sq_i)                                         # squares are exact: small integers
        with np.errstate(divide="ignore", invalid="ignore"):
            score = np.where(denom > 0, dot / denom, 0.0)
        return ((sq_q > 0).astype(np.float64) + (sq_i > 0).astype(np.float64)) - 2.0 * score


class _Dense:
    """Dense vectors: squared L2 (|q|^2 + |c|^2 - 2 q.c), settled to some decimals."""

    def __init__(self, settle: int):
        self.settle = settle

    def matrix(self, col) -> np.ndarray:
        values, size = _lists(col)
        return values.astype(np.float64).reshape(len(size), -1)

    def split(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (m * m).sum(axis=1), m

    def settled(self, sq_i: np.ndarray, sq_q: np.ndarray, dot: np.ndarray) -> np.ndarray:
        return np.round((sq_q + sq_i) - 2.0 * dot, self.settle)


class _Cell:
    """One block of queries and the best ``n`` of the items that went past it, which come in order of their tie.

    A float32 matrix product with a bound on its error rules out nearly all pairs; the others get their exact distance.
    Of equal distances the earlier item is nearer, so a later one must be strictly nearer than the n-th best.
    """

    def __init__(self, space, n: int, exclude_self: bool):
        self.space, self.n, self.exclude_self = space, n, exclude_self
        self.qid, self.vectors, self.best = [], [], None

    def add_queries(self, batch) -> None:
        if len(batch):
            self.qid.append(batch.column("qid"))
            self.vectors.append(self.space.matrix(batch.column("vec")))

    def _start(self) -> None:
        self.qid, self.vectors = pa.concat_arrays(self.qid), np.concatenate(self.vectors)
        self.ids = self.qid.to_numpy(zero_copy_only=False) if self.exclude_self else None
        self.own, unit = self.space.split(self.vectors)
        self.sq, self.norm = (self.vectors * self.vectors).sum(axis=1), np.sqrt((unit * unit).sum(axis=1))
        self.near = np.hstack([unit, np.ones((len(unit), 1))]).astype(np.float32)
        self.best = np.full((len(unit), self.n), np.inf)              # distances in order
        self.at = np.full((len(unit), self.n), -1, np.int64)          # rows of ``kept``
        self.kept, self.n_kept = [], 0

    def add_items(self, batch) -> None:
        if not len(self.qid):
            return
        if self.best is None:
            self._start()
        for lo in range(0, len(batch), _ITEM_ROWS):
            part = batch.slice(lo, _ITEM_ROWS)
            items = self.space.matrix(part.column("vec"))
            own, unit = self.space.split(items)
            with np.errstate(over="ignore", invalid="ignore"):
                near = np.hstack([unit, own[:, None] / -2.0]).astype(np.float32)
                reach = np.sqrt((unit * unit).sum(axis=1).max()), own.max()
            ids = part.column("tie").to_numpy(zero_copy_only=False) if self.exclude_self else None
            sq, used = (items * items).sum(axis=1), []
            for first in range(0, len(self.vectors), _QUERY_ROWS):
                used += self._score(items, sq, near, reach, ids, slice(first, first + _QUERY_ROWS))
            self._keep(part.column("item"), used)

    def _score(self, items, sq, near, reach, ids, own: slice) -> list:
        """Takes what is nearer than the n-th best of the queries ``own``; the places in ``at`` that refer to the batch."""
        least, vectors = self.best[own, -1], self.vectors[own]
        with np.errstate(over="ignore", invalid="ignore"):
            s = near @ self.near[own].T
            # twice what rounding (unit 2 ** -24) can add up to, and what settling can
            err = (near.shape[1] + 8) * 2.0 ** -23 * (self.norm[own] * reach[0] + reach[1]) \
                + 2.0 ** -22 * (self.own[own] + np.where(np.isfinite(least), least, 0.0)) + 1e-8
            bound = (self.own[own] - least) / 2.0 - err
            if np.isinf(least).any() and len(items) >= self.n:       # so far: the n-th nearest of this batch
                other = s if ids is None else np.where(ids[:, None] == self.ids[own][None, :], -np.inf, s)
                nth = -np.partition(-other, self.n - 1, axis=0)[self.n - 1].astype(np.float64) - 2.0 * err
                bound = np.fmax(bound, np.where(np.isnan(nth), -np.inf, nth))
            r, c = np.nonzero(~(s < bound.astype(np.float32)[None, :]))                # what is no number stays
            if not len(r):
                return []
            if len(r) > _MANY * s.size:                              # many near ones: all pairs of the batch
                dist = self.space.settled(sq[:, None], self.sq[own][None, :], items @ vectors.T)
                if self.exclude_self:
                    dist[ids[:, None] == self.ids[own][None, :]] = np.inf
                dist[~np.isfinite(dist)] = np.inf
                top = np.partition(dist, self.n - 1, axis=0)[self.n - 1] if len(items) >= self.n else np.inf
                r, c = np.nonzero((dist < least[None, :]) & (dist <= top))
                d = dist[r, c]
            else:
                if self.exclude_self:
                    other = ids[r] != self.ids[own][c]
                    r, c = r[other], c[other]
                d = self.space.settled(sq[r], self.sq[own][c], np.einsum("ij,ij->i", items[r], vectors[c]))
                nearer = np.isfinite(d) & (d < least[c])
                r, c, d = r[nearer], c[nearer], d[nearer]
        if not len(r):
            return []
        changed, c = np.unique(c, return_inverse=True)
        rows, m = changed + own.start, len(changed)
        q = np.concatenate([np.repeat(np.arange(m), self.n), c])
        d = np.concatenate([self.best[rows].ravel(), d])
        at = np.concatenate([self.at[rows].ravel(), -2 - r])         # below -1: rows of this batch
        seq = np.concatenate([np.tile(np.arange(self.n), m), self.n + r])
        order = np.lexsort((seq, d, q))
        rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order = order[rank < self.n]
        self.best[rows], self.at[rows] = d[order].reshape(m, self.n), at[order].reshape(m, self.n)
        return [rows]

    def _keep(self, item, used: list) -> None:
        """The batch's items that are among the best go to ``kept``; those no longer among them leave it at times."""
        if not used:
            return
        rows = np.concatenate(used)
        at = self.at[rows]
        mine = at < -1
        taken, place = np.unique(-2 - at[mine], return_inverse=True)
        at[mine] = self.n_kept + place
        self.at[rows] = at
        self.kept.append(item.take(pa.array(taken)))
        self.n_kept += len(taken)
        if self.n_kept > max(1 << 16, 2 * self.at.size):
            some, place = np.unique(self.at[self.at >= 0], return_inverse=True)
            self.at[self.at >= 0] = place
            self.kept, self.n_kept = [pa.concat_arrays(self.kept).take(pa.array(some))], len(some)

    def result(self, keys: list[str]):
        if self.best is None or not self.kept:
            return
        q, rank = np.nonzero(self.at >= 0)
        item = pa.concat_arrays(self.kept)
        self.kept = [item]
        for lo in range(0, len(q), _RESULT_ROWS):
            own = slice(lo, lo + _RESULT_ROWS)
            rows = item.take(pa.array(self.at[q[own], rank[own]]))
            yield pa.RecordBatch.from_arrays(
                [*(rows.field(k) for k in range(len(keys))), self.qid.take(pa.array(q[own])), pa.array(self.best[q[own], rank[own]])],
                names=[*keys, "qid", "distance"])


def _block_topn(items: DataFrame, item_key: list[str], tie: Column, queries: DataFrame, n: int,
                blocks: Column, space, exclude_self: bool = False) -> DataFrame:
    """The ``n`` nearest items of every query: (item_key..., qid, distance, rank).

    ``items`` has item_key and ``vec``, ``queries`` has qid and ``vec``;
    ``blocks`` is the number of query blocks (a scalar subquery).
    """
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = F.greatest(F.ceil(F.lit(tasks) / F.col("_blocks")), F.lit(1)).cast("int")
    vec = items.schema["vec"].dataType
    item_type = T.StructType([T.StructField(c, items.schema[c].dataType, True) for c in item_key])
    it = items.select(F.struct(*item_key).cast(item_type).alias("item"), tie.alias("tie"), "vec")
    q = (queries.select("qid", "vec").withColumn("_blocks", blocks).withColumn("_parts", parts)
         .withColumn("_block", F.pmod(F.xxhash64("qid"), F.col("_blocks")).cast("int"))
         .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
         .select((F.col("_block") * F.col("_parts") + F.col("_part")).alias("cell"), F.lit(0).alias("kind"), "qid",
                 F.col("vec").cast(vec).alias("vec"), F.lit(None).cast(item_type).alias("item"),
                 F.lit(None).cast(it.schema["tie"].dataType).alias("tie")))
    i = (it.withColumn("_blocks", blocks).withColumn("_parts", parts)
         .withColumn("_part", F.pmod(F.xxhash64("tie"), F.col("_parts")).cast("int"))
         .withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
         .select((F.col("_block") * F.col("_parts") + F.col("_part")).alias("cell"), F.lit(1).alias("kind"),
                 F.lit(None).cast(queries.schema["qid"].dataType).alias("qid"), "vec", "item", "tie"))
    cells = (q.unionByName(i).repartitionById(tasks, F.pmod("cell", F.lit(tasks)))
             .sortWithinPartitions("cell", "kind", "tie"))
    _ship_by_value()

    def run(batches):
        cell, at = None, None
        for batch in batches:
            key = batch.column("cell").to_numpy() * 2 + batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)] if len(key) else []
            for lo, hi in zip(edges, edges[1:]):
                if cell is None or key[lo] // 2 != at:
                    if cell is not None:
                        yield from cell.result(item_key)
                    cell, at = _Cell(space, n, exclude_self), key[lo] // 2
                own = batch.slice(lo, hi - lo)
                cell.add_items(own) if key[lo] % 2 else cell.add_queries(own)
        if cell is not None:
            yield from cell.result(item_key)

    schema = T.StructType([*item_type.fields, T.StructField("qid", queries.schema["qid"].dataType),
                           T.StructField("distance", T.DoubleType())])
    local = cells.mapInArrow(run, schema)
    w = Window.partitionBy("qid").orderBy("distance", tie)
    return (local.withColumn("rank", F.row_number().over(w) - 1)
            .where(F.col("rank") < n).withColumn("rank", F.col("rank").cast("int")))


def _blocks_of(queries: DataFrame, row_bytes: Column, block_bytes: int) -> Column:
    """Blocks of at most about ``block_bytes`` that the queries make, one at least.

    Every part of the items gives a list for each query, so many queries make more and smaller blocks, and fewer parts:
    up to the root of the number of tasks, by ``QUERY_BLOCK_ROWS``.
    """
    total = F.coalesce(F.sum(row_bytes), F.lit(0))
    root = math.isqrt(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_rows = F.least(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_BLOCK_ROWS)), F.lit(root))
    return queries.agg(F.greatest(F.ceil(total / F.lit(block_bytes)), by_rows, F.lit(1)).cast("int").alias("n")).scalar()


def knn(items: DataFrame, item_key: list[str], queries: DataFrame, n: int,
        dim: int = EMBEDDING_DIM, batch_bytes: int = QUERY_BLOCK_BYTES,
        item_text: str = "text", query_text: str = "text",
        stopwords: list[str] | None = None) -> DataFrame:
    """For every query (``qid``) the ``n`` nearest items by squared
    L2 distance of the normalised hashed vectors, ties by item id (as text);
    columns item_key..., qid, distance, rank (0-based).  Items and queries
    are given as text (one row per item, unique ids); items or queries
    without tokens still take part.

    Queries form blocks of about ``batch_bytes`` of dense vectors; every block
    meets every item once.
    """
    it = spread(items).select(*item_key, token_buckets(F.col(item_text), dim, stopwords).alias("vec"))
    q = queries.select("qid", token_buckets(F.col(query_text), dim, stopwords).alias("vec"))
    blocks = _blocks_of(queries, F.lit(8 * dim), batch_bytes)
    return _block_topn(it, item_key, F.col(item_key[0]).cast("string"), q, n, blocks, _Counts(dim))


# ---- V5-V8: rank, pack, sources -------------------------------------------

def rank_top_k(retrieved: DataFrame, k: int, text_col: str = "text",
               id_col: str = "chunk_id") -> DataFrame:
    """V5: per query by distance, drop chunks whose text equals a nearer
    one, keep the first ``k``; adds ``used_rank`` (0-based)."""
    first_of_text = Window.partitionBy("qid", text_col).orderBy("distance", id_col)
    order = Window.partitionBy("qid").orderBy("distance", id_col)
    return (retrieved.withColumn("_t", F.row_number().over(first_of_text)).where(F.col("_t") == 1)
            .withColumn("used_rank", F.row_number().over(order) - 1)
            .where(F.col("used_rank") < k).drop("_t")
            .withColumn("used_rank", F.col("used_rank").cast("int")))


def pack_context(ranked: DataFrame, max_chars: int = DEFAULT_MAX_CONTEXT_CHARS,
                 source_col: str = "source", text_col: str = "text") -> DataFrame:
    """V7: per query, ``[Source: s]\\ntext`` pieces in rank order while the
    running length stays within the budget (stops at the first overflow),
    joined by the separator.  Queries with nothing packed get ''."""
    piece = F.concat(F.lit("[Source: "), F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")),
                     F.lit("]\n"), F.col(text_col))
    w = (Window.partitionBy("qid").orderBy("used_rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = ranked.withColumn("_piece", piece).withColumn("_run", F.sum(F.length("_piece")).over(w))
    packed = (p.where(F.col("_run") <= max_chars).groupBy("qid")
              .agg(F.sort_array(F.collect_list(F.struct("used_rank", "_piece"))).alias("_p")))
    all_q = ranked.select("qid").distinct()
    return (all_q.join(packed, "qid", "left")
            .select("qid", F.coalesce(F.array_join(F.transform("_p", lambda s: s["_piece"]),
                                                   CONTEXT_SEPARATOR), F.lit("")).alias("context")))


def sources_per_query(ranked: DataFrame, source_col: str = "source") -> DataFrame:
    """V8: sorted distinct sources of the ranked chunks (budget ignored)."""
    return ranked.groupBy("qid").agg(
        F.sort_array(F.collect_set(F.col(source_col).cast("string"))).alias("sources"),
        F.count(F.lit(1)).cast("int").alias("num_chunks_used"))


# ---- J7: passage containment -------------------------------------------------

def _words(text: Column) -> Column:
    return F.split(text, r"\s+", -1)


def _passage_grams(text: Column) -> Column:
    """[kind, gram, place] of a passage: grams that every text containing it has.

    Five words and more: 3-grams of the interior words (complete words in any
    such text); three or four words: the interior words; one or two: the runs
    of up to three characters of the first word; without a word: one gram that
    every text has.
    """
    w = _words(text)
    n = F.size(w)
    first = F.get(F.array_remove(w, ""), F.lit(0))
    chars = F.least(F.lit(3), F.length(first))

    def grams(kind, values):
        return F.transform(values, lambda g, i: F.struct(kind.alias("kind"), g.alias("gram"), i.alias("place")))

    return (F.when(n >= 5, grams(F.lit("words3"), F.transform(
                F.sequence(F.lit(2), F.greatest(n, F.lit(5)) - 3),
                lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))))
            .when(n >= 3, grams(F.lit("words1"), F.slice(w, 2, F.greatest(n - 2, F.lit(0)))))
            .when(first.isNull(), grams(F.lit("any"), F.array(F.lit(""))))
            .otherwise(grams(F.concat(F.lit("chars"), chars.cast("string")), F.transform(
                F.sequence(F.lit(1), F.length(first) - chars + 1), lambda i: F.substring(first, i, chars)))))


def _text_grams(text: Column, kinds: Column) -> Column:
    """[kind, gram] of a text, distinct, of the kinds asked for but words3."""
    def grams(kind, values):
        return F.when(F.array_contains(kinds, kind), F.transform(
            F.array_distinct(values), lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))) \
            .otherwise(F.array().cast("array<struct<kind: string, gram: string>>"))

    def runs(n):                      # a lookahead takes the n next characters at every place
        return F.regexp_extract_all(text, F.lit(r"(?=(" + r"\S" * n + r"))\S"), 1)

    return F.concat(grams("words1", _words(text)), grams("chars3", runs(3)),
                    grams("chars2", runs(2)), grams("chars1", runs(1)), grams("any", F.array(F.lit(""))))


def _word_triples(df: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep..., _keys: a 64-bit hash of every three words in a row of a text; each distinct word of a batch is hashed once."""
    _ship_by_value()

    class Hashes(dict):
        def __missing__(self, word):
            self[word] = found = int.from_bytes(hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest(), "big")
            return found

    def run(batches):
        known = Hashes()
        for batch in batches:
            if len(known) > _KNOWN_TOKENS:
                known.clear()
            words = pc.ascii_split_whitespace(batch.column(text_col))
            size = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
            flat = words.flatten().dictionary_encode()
            own = np.fromiter((known[w] for w in flat.dictionary.to_pylist()), np.uint64, len(flat.dictionary))
            h = own[flat.indices.to_numpy(zero_copy_only=False)] if len(flat) else own
            key = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
            row = np.repeat(np.arange(len(size)), size)
            inside = row[:-2] == row[2:]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep),
                 _list_array(np.cumsum(np.maximum(size - 2, 0)), pa.array(key[inside].view(np.int64)))], names=[*keep, "_keys"])

    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("_keys", T.ArrayType(T.LongType()))])
    return df.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(run, schema)


def _bits(keys: DataFrame, key: str) -> Column:
    """A bitmap of ``2 ** _BITS`` bits, as an array of longs: that of the low bits of every key is set (scalar subquery)."""
    own = F.pmod(F.col(key), F.lit(1 << _BITS))
    held = keys.groupBy(F.shiftright(own, 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")).alias("w"))
    return (keys.sparkSession.range(1 << (_BITS - 6)).join(held, "id", "left")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0)).alias("w")))),
                             lambda x: x["w"]).alias("bits")).scalar())


def _may_hold(bits: Column, key: str) -> Column:
    own = F.pmod(F.col(key), F.lit(1 << _BITS))
    word = F.get(bits, F.shiftright(own, 6).cast("int"))
    return word.bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))")) != 0


def contained_in(passages: DataFrame, docs: DataFrame, pid: str = "qid", ptext: str = "query",
                 did: str = "doc_id", dtext: str = "text") -> DataFrame:
    """(pid, did) for every document whose text contains the passage, once.

    Each passage has grams that every text containing it must have
    (``_passage_grams``).  Their document counts are taken over the whole
    corpus, and the passage's rarest gram alone is joined with the documents'
    grams; one that no document has ends the passage.  ``instr`` verifies in the
    join that fetches the text.  Grams travel as 64-bit hashes; equal hashes of
    different grams only add candidates.  Bitmaps of fixed size (scalar subqueries)
    keep most grams that no passage has, and most texts that are no candidate,
    out of the shuffles; what they let through is joined all the same.  Which
    kinds of grams the corpus pass has to make is a scalar subquery too.  The grams
    of texts that some passage has are checkpointed (an action).  A null passage or text is contained in nothing and
    contains nothing.
    """
    p = passages.select(pid, ptext).where(F.col(ptext).isNotNull()).withColumn("_grams", _passage_grams(F.col(ptext)))
    kinds = p.agg(F.collect_set(F.get(F.col("_grams"), F.lit(0))["kind"]).alias("kinds")).scalar()      # of six
    grams = p.select(pid, ptext, F.explode("_grams").alias("_g")).select(
        pid, ptext, F.col("_g")["kind"].alias("kind"), F.col("_g")["gram"].alias("gram"), F.col("_g")["place"].alias("_place"))
    three, other = F.col("kind") == "words3", F.xxhash64("kind", "gram").alias("_key")
    asked = (_word_triples(grams.where(three), [pid, ptext, "_place"], "gram")
             .select(pid, ptext, F.get("_keys", F.lit(0)).alias("_key"), "_place")
             .unionByName(grams.where(~three).select(pid, ptext, other, "_place")))
    asked_keys = asked.select("_key").distinct()
    texts = spread(docs.select(did, dtext)).where(F.col(dtext).isNotNull())
    of_texts = (_word_triples(texts.where(F.array_contains(kinds, "words3")), [did], dtext).select(did, F.explode("_keys").alias("_key"))
                .unionByName(texts.where(F.size(F.array_remove(kinds, "words3")) > 0)
                             .select(did, F.explode(_text_grams(F.col(dtext), kinds)).alias("_g"))
                             .select(did, F.xxhash64("_g.kind", "_g.gram").alias("_key"))))
    held = (of_texts.where(_may_hold(_bits(asked_keys, "_key"), "_key"))
            .distinct().join(asked_keys, "_key", "left_semi"))
    checkpoint_dir(held.sparkSession)
    held = held.checkpoint()                  # read for the counts and for the candidates: the corpus is gone through once
    counts = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    rarest = (asked.join(counts, "_key", "left")
              .groupBy(pid, ptext).agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_place").alias("place"),
                                                      F.col("_key").alias("key"))).alias("_a"))
              .where(F.col("_a.n") > 0).select(pid, ptext, F.col("_a.key").alias("_key")))
    candidates = held.join(rarest, "_key").select(pid, ptext, did).withColumn("_hash", F.xxhash64(did))
    texts = (docs.select(F.col(did).alias("_did"), F.col(dtext).alias("_text")).withColumn("_hash_of", F.xxhash64("_did"))
             .where(_may_hold(_bits(candidates.select("_hash"), "_hash"), "_hash_of")))
    return (candidates.join(texts, F.col(did).eqNullSafe(F.col("_did")) & (F.instr(F.col("_text"), F.col(ptext)) > 0))
            .select(pid, did).distinct())


# ---- A13 / A14 ------------------------------------------------------------------

def hit_rate_at_k(hits: DataFrame) -> DataFrame:
    """Overall hit rate (Python-rounded to 3) and the number of queries."""
    from tracewise.functions.numeric import py_round_ratio
    agg = hits.agg(F.sum(F.col("hit").cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return agg.select("hits", "n", F.when(F.col("n") > 0, py_round_ratio(F.col("hits"), F.col("n"), 3))
                      .alias("hit_rate_at_k"))


def retrieval_hits(questions: DataFrame, ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """A13 per question: is_valid, ``hit`` (an expected document is among the
    ranked chunks' documents), the ranked documents and the expected ones among
    them.  ``expected`` (qid, doc_id) is met by a semi-join, never gathered."""
    _, ok, _ = validate_query(F.col("query"))
    got = ranked.select("qid", F.col("doc_id").cast("string").alias("doc_id")).distinct()
    want = expected.select("qid", F.col("doc_id").cast("string").alias("doc_id"))
    met = got.join(want, ["qid", "doc_id"], "left_semi").select("qid", "doc_id", F.lit(True).alias("met"))
    lists = (got.join(met, ["qid", "doc_id"], "left").groupBy("qid")
             .agg(F.sort_array(F.collect_list("doc_id")).alias("retrieved"),              # k at most
                  F.sort_array(F.collect_list(F.when(F.col("met"), F.col("doc_id")))).alias("expected_retrieved")))
    return (questions.withColumn("is_valid", ok).join(lists, "qid", "left")
            .withColumn("hit", F.coalesce(F.size("expected_retrieved") > 0, F.lit(False))))


def hit_rate_by_group(hits: DataFrame, group_col: str = "difficulty", latency_col: str | None = None) -> DataFrame:
    """Per group and overall (rollup): total, hits, errors (rejected
    queries) and hit rate in percent; with ``latency_col`` also the mean latency
    of the accepted queries."""
    more = [] if latency_col is None else [
        F.avg(F.when(F.col("is_valid"), F.col(latency_col))).alias("avg_latency_ms")]
    g = hits.rollup(group_col).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.col("hit").cast("long")).alias("hits"),
        F.sum((~F.col("is_valid")).cast("long")).alias("errors"), *more)
    return g.select(F.coalesce(F.col(group_col), F.lit("OVERALL")).alias(group_col), "total", "hits",
                    "errors", (F.col("hits") / F.col("total") * 100.0).alias("hit_rate_pct"),
                    *(["avg_latency_ms"] if more else []))


# ---- V4 on dense vectors -------------------------------------------------------

def knn_dense(items: DataFrame, id_col: str, vec_col: str, queries: DataFrame, n: int,
              exclude_self: bool = False, settle: int = 9,
              batch_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """V4 / J8 on dense vectors: for every query (``qid``, ``vec_col``) the
    ``n`` nearest items by squared L2 distance, ties by item id; with
    ``exclude_self`` an item never neighbours the query of the same id.
    Rows without a vector are left out.  Queries form blocks of about
    ``batch_bytes`` (dense float64)."""
    it = items.where(F.col(vec_col).isNotNull()).select(id_col, F.col(vec_col).alias("vec"))
    q = queries.where(F.col(vec_col).isNotNull()).select("qid", F.col(vec_col).alias("vec"))
    blocks = _blocks_of(q, F.lit(8) * F.size("vec"), batch_bytes)
    return _block_topn(spread(it), [id_col], F.col(id_col), q, n, blocks, _Dense(settle), exclude_self)


def knn_lsh(items: DataFrame, id_col: str, vec_col: str, queries: DataFrame, n: int, tables: int = 24,
            bits: int = 8, seed: int = 42, exclude_self: bool = False, settle: int = 9) -> DataFrame:
    """Approximate V4 on dense vectors, without comparing every query with every item.

    Each of ``tables`` hash tables gives a vector the signs of its dot products
    with ``bits`` random directions; an item is scored against a query if in
    some table they differ in one sign at most (a query probes the buckets next
    to its own).  Directions come from a seeded generator, all signs from one
    pass over each side.  The equi-join on (table, signs) is dealt by key;
    a bucket that many vectors share is split by the skew join.  Columns as in
    ``knn_dense``; fewer than ``n`` rows if the buckets hold fewer items.
    """
    _ship_by_value()

    def signed(df: DataFrame, key: str, flips: np.ndarray) -> DataFrame:
        kept = df.where(F.col(vec_col).isNotNull()).select(key, F.col(vec_col).alias("vec"))
        schema = T.StructType([*kept.schema.fields, T.StructField("buckets", T.ArrayType(T.LongType()))])

        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                v = _Dense(settle).matrix(batch.column("vec"))
                planes = np.random.default_rng(seed).standard_normal((v.shape[1], tables * bits))
                sign = ((v @ planes) > 0).reshape(len(v), tables, bits)
                code = sign @ (1 << np.arange(bits)) + (np.arange(tables) << bits)[None, :]
                code = code[:, :, None] ^ flips[None, None, :]
                offsets = np.arange(len(v) + 1) * tables * len(flips)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code.ravel(), pa.int64()))],
                    names=[key, "vec", "buckets"])

        return kept.mapInArrow(run, schema)

    it = signed(items, id_col, np.zeros(1, np.int64)).withColumnRenamed("vec", "_item")
    q = signed(queries, "qid", np.append(0, 1 << np.arange(bits))).withColumnRenamed("vec", "_query")
    pairs = (q.select("qid", F.explode("buckets").alias("_bucket"))
             .join(it.select(id_col, F.explode("buckets").alias("_bucket")), "_bucket").select("qid", id_col).distinct())
    if exclude_self:
        pairs = pairs.where(F.col(id_col) != F.col("qid"))
    scored = pairs.join(q.select("qid", "_query"), "qid").join(it.select(id_col, "_item"), id_col)
    square = F.aggregate(F.zip_with("_query", "_item", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)),
                         F.lit(0.0), lambda acc, x: acc + x)
    w = Window.partitionBy("qid").orderBy("distance", id_col)
    return (scored.select(id_col, "qid", F.round(square, settle).alias("distance"))
            .withColumn("rank", (F.row_number().over(w) - 1).cast("int")).where(F.col("rank") < n))
