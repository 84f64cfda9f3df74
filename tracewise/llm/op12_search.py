"""Ranked lexical search over bit-sliced Bloom signatures.

One pass over the documents gives N, L and the document frequencies of the query
terms.  A second pass indexes each task's documents in blocks of alike numbers of
terms: a block is a bit matrix, a row for each signature place, a bit in it for
each document.  A term sets its places at level l if it occurs 2^l times or more,
so the rows of a (term, level), and-ed, give a bitmap of the documents that may
have it as often, never missing one.  The bitmaps, each weighted with what its
level adds to the score at most, sum up to an upper bound for every document.
Documents are then scored exactly (occurrences compared byte by byte) in the
order of their bounds, until all that is left lies below the tenth best score.
Each task sends on its ten best for each item; two windows merge them, so that no
group grows with the corpus but slowly.

The items are taken in blocks of bounded size (bytes of text); each block is
shipped to all tasks and makes its own two passes.

Defined results: a document or item without a term (null and empty texts) is in
no result; every row of the documents and of the benchmark counts, repeated rows
and rows without an id too (a null doc_id comes last among equal scores, a null
item_id is returned as null); other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value

TOP = 10
PLACES = 3                     # signature places of a (term, level)
SPARSE = 12                    # signature rows for each (term, level) of the block's largest document
MATRIX_BYTES = 16 << 20        # largest bit matrix while it is filled (a byte a bit)
BOUND_CELLS = 4 << 20          # bounds (term x document) held at a time
SLICE_BYTES = 4 << 20          # text bytes indexed at a time in a task
QUERY_BYTES = 256 << 10        # item text of a block of queries
MERGE_PARTS = 256              # parts of an item's candidates that are cut to ten before they meet

#: Bytes between terms: ASCII without letters and digits.
APART = np.zeros(256, dtype=bool)
APART[:128] = [not chr(c).isalnum() for c in range(128)]
_ROW_BITS, _KEY_BITS = np.uint64(16), np.uint64(48)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Queries:
    """A block of items: their terms once each, and each item's terms with repeats counted."""
    ids: list
    data: np.ndarray           # folded bytes of the distinct terms
    start: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    terms: list[np.ndarray]    # of each item: indices of its distinct terms, ascending by hash
    times: list[np.ndarray]


def _queries(ids: list, texts: list) -> Queries:
    data, offsets = W.text_buffer(pa.array(texts, pa.large_string()))
    w = W.words_of(data, offsets, lower=True, apart=APART)
    folded = _FOLD[data]
    raw = folded.tobytes()
    names = [raw[a:b] for a, b in zip(w.start, w.end)]
    hash_of = dict(zip(names, w.hash))
    distinct = sorted(hash_of, key=lambda t: (int(hash_of[t]), t))
    at = {t: i for i, t in enumerate(distinct)}
    own = np.array([at[t] for t in names], np.int64)
    size = np.array([len(t) for t in distinct], np.int64)
    counted = [np.unique(own[a:b], return_counts=True) for a, b in zip(w.first[:-1], w.first[1:])]
    return Queries(ids, np.frombuffer(b"".join(distinct), np.uint8), np.cumsum(size) - size, size,
                   np.array([hash_of[t] for t in distinct], np.uint64), [c[0] for c in counted], [c[1] for c in counted])


def _terms(data: np.ndarray, offsets: np.ndarray) -> W.Words:
    return W.words_of(data, offsets, lower=True, apart=APART)


def _frequencies(docs: DataFrame, q: Queries) -> dict[int, int]:
    """Document frequency of each query term by index; N at -1, L at -2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(q.hash), np.int64)
        n = total = 0
        for batch in batches:
            for _, data, offsets in W.text_slices(batch, slice_bytes=SLICE_BYTES):
                w = _terms(data, offsets)
                n += int((np.diff(w.first) > 0).sum())
                total += len(w.hash)
                order = np.argsort(w.hash, kind="stable")
                ordered = w.hash[order]
                lo = np.searchsorted(ordered, q.hash, side="left")
                own = np.searchsorted(ordered, q.hash, side="right") - lo
                term = np.repeat(np.arange(len(own)), own)
                token = order[W.ragged(lo, own)]
                same = W.same_bytes(_FOLD[data], w.start[token], w.end[token] - w.start[token], q.data, q.start[term], q.size[term])
                term, row = term[same], w.row[token[same]]
                fresh = np.append(True, (term[1:] != term[:-1]) | (row[1:] != row[:-1]))[:len(term)]
                df += np.bincount(term[fresh], minlength=len(df))
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, [-1, -2])), pa.array(np.append(df[has], [n, total]))],
                                         names=["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in rows.collect()}           # a row a query term at most


class _Slice:
    """The documents of a slice: terms in the order of (document, hash), counted by the hash's upper 48 bits.

    Terms that share these bits count as one, which makes bounds larger; scores compare the bytes.
    """

    def __init__(self, part, data, offsets, n_docs, n_terms):
        self.ids = part.column(part.schema.get_field_index("doc_id")).to_pylist()
        self.data = _FOLD[data]
        self.words = w = _terms(data, offsets)
        key = _cell_key(w.row, w.hash)
        self.order = np.argsort(key)
        key = key[self.order]
        self.at = np.flatnonzero(np.append(True, key[1:] != key[:-1])[:len(key)])
        self.key = key[self.at]
        self.row = (self.key >> _KEY_BITS).astype(np.int64)
        self.tf = np.diff(np.append(self.at, len(key)))
        self.first = np.searchsorted(self.row, np.arange(len(part) + 1))
        self.n = np.diff(w.first)
        self.m = 25 + (75 * self.n * n_docs) // max(n_terms, 1)

    def blocks(self, most: int) -> Iterator[np.ndarray]:
        """Documents with a term, in blocks of alike numbers of (term, level); fewer of the large ones."""
        level = np.frexp(self.tf.astype(np.float64))[1]    # levels of a term: 1 + log2
        load = np.bincount(self.row, weights=level, minlength=len(self.n)).astype(np.int64)
        rows = np.argsort(load, kind="stable")
        rows = rows[load[rows] > 0]
        while len(rows):
            width = _places(int(load[rows[0]]))
            n = min(most, max(1, MATRIX_BYTES // width))
            n = int(np.searchsorted(load[rows[:n]], width // SPARSE, side="right"))
            yield rows[:max(n, 1)]
            rows = rows[max(n, 1):]

    def scores(self, q: Queries, item: int, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exact scores of documents for an item."""
        terms, times = q.terms[item], q.times[item]
        term = np.tile(np.arange(len(terms)), len(rows))
        doc = np.repeat(np.arange(len(rows)), len(terms))
        key = _cell_key(rows[doc], q.hash[terms[term]])
        cell = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[cell] == key
        cell, term, doc = cell[hit], term[hit], doc[hit]
        out = np.zeros(len(rows), np.int64)
        if not len(cell):
            return out
        n = self.tf[cell]
        token = self.order[W.ragged(self.at[cell], n)]
        own = np.repeat(terms[term], n)
        w = self.words
        same = W.same_bytes(self.data, w.start[token], w.end[token] - w.start[token], q.data, q.start[own], q.size[own])
        tf = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n)
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * self.m[rows[doc]])
        np.add.at(out, doc, weights[terms[term]] * times[term] * gain)
        return out


def _cell_key(row: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    return (row.astype(np.uint64) << _KEY_BITS) | (hashed >> _ROW_BITS)


def _places(load: int) -> int:
    """Signature rows of a block whose largest document has ``load`` (term, level) pairs: a power of two."""
    return 1 << max(6, (load * SPARSE - 1).bit_length())


def _place(hashed: np.ndarray, level: int, i: int, width: int) -> np.ndarray:
    salt = np.array([4 * level + i], np.uint64) * W._STEP
    return (W.mix(hashed + salt) & np.uint64(width - 1)).astype(np.int64)


class _Block:
    """Bit-sliced signatures of some documents of a slice."""

    def __init__(self, part: _Slice, rows: np.ndarray):
        n = part.first[rows + 1] - part.first[rows]
        cell = W.ragged(part.first[rows], n)
        column = np.repeat(np.arange(len(rows)), n)
        hashed, tf = part.key[cell] << _ROW_BITS, part.tf[cell]
        level = np.frexp(tf.astype(np.float64))[1]
        self.levels = int(level.max())
        self.width = _places(int(np.bincount(column, weights=level).max()))
        bits = np.zeros((self.width, len(rows)), dtype=bool)
        for at in range(self.levels):
            own = level > at
            for i in range(PLACES):
                bits[_place(hashed[own], at, i, self.width), column[own]] = True
        self.slices = np.packbits(bits, axis=1)
        tf_of = [np.minimum((2 << at) - 1, part.n[rows]) for at in range(self.levels)]
        gain = [(1_000_000_000 * t) // (1000 * t + 8 * part.m[rows]) for t in tf_of]
        self.adds = np.diff(np.array([np.zeros(len(rows), np.int64), *gain]), axis=0).astype(np.float64)

    def bounds(self, hashed: np.ndarray) -> np.ndarray:
        """What each term adds to a document's score at most, for weight 1: a row a term, a column a document."""
        n = self.adds.shape[1]
        out = np.zeros((len(hashed), n))
        left, seen = np.arange(len(hashed)), None
        for at in range(self.levels):
            own = (hashed[left] >> _ROW_BITS) << _ROW_BITS
            rows = self.slices[_place(own, at, 0, self.width)]
            for i in range(1, PLACES):
                rows &= self.slices[_place(own, at, i, self.width)]
            if seen is not None:
                rows &= seen
            some = rows.any(axis=1)
            left, seen = left[some], rows[some]
            if not len(left):
                break
            out[left] += np.unpackbits(seen, axis=1, count=n) * self.adds[at]
        return out


def _key(pair):
    score, doc_id = pair
    return -score, doc_id is None, doc_id or 0


def _search(q: Queries, weights: np.ndarray, n_docs: int, n_terms: int):
    """The task that ranks its documents: (item, item_id, doc_id, score) of the ten best of each item."""
    most = max(64, BOUND_CELLS // max(1, len(q.hash)))
    asked = [i for i in range(len(q.ids)) if len(q.terms[i])]
    weighted = {i: (weights[q.terms[i]] * q.times[i]).astype(np.float64) for i in asked}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {i: [] for i in asked}
        for batch in batches:
            for part, data, offsets in _slices(batch):
                docs = _Slice(part, data, offsets, n_docs, n_terms)
                for rows in docs.blocks(most):
                    bound = _Block(docs, rows).bounds(q.hash)
                    for i in asked:
                        # doubles hold these sums exactly up to 2^53; the margin covers larger ones
                        top = weighted[i] @ bound[q.terms[i]] * (1 + 1e-9)
                        _take(docs, q, i, weights, rows, top, best[i])
        rows = [(i, q.ids[i], d, s) for i in asked for s, d in best[i]]
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["item", "item_id", "doc_id", "score"])

    return run


def _slices(batch: pa.RecordBatch):
    for lo in range(0, len(batch), 1 << int(_ROW_BITS)):
        yield from W.text_slices(batch.slice(lo, 1 << int(_ROW_BITS)), slice_bytes=SLICE_BYTES)


def _take(docs: _Slice, q: Queries, item: int, weights, rows, top, best: list) -> None:
    """Score the documents that may enter the best ten, highest bound first; the others are proven too low."""
    least = best[-1][0] if len(best) == TOP else 1
    may = np.flatnonzero(top >= least)
    may = may[np.argsort(-top[may], kind="stable")]
    size = 2 * TOP
    while len(may):
        now, may = rows[may[:size]], may[size:]
        scores = docs.scores(q, item, weights, now)
        good = np.flatnonzero(scores >= least)
        if len(good):
            best += [(int(scores[j]), docs.ids[now[j]]) for j in good]
            best.sort(key=_key)
            del best[TOP:]
            least = best[-1][0] if len(best) == TOP else 1
            may = may[top[may] >= least]
        size *= 2


def _query_blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """Items in blocks of about QUERY_BYTES of text (one item at least), by hash."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    total = items.agg(F.sum(size).alias("n")).first().n or 0
    parts = max(1, math.ceil(2 * total / QUERY_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts if total else 0):
        rows = sorted(((r.item_id, r.text) for r in items.where(part == k).select("item_id", "text").collect()),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows]


def ranked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents of each item."""
    ship_by_value()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = None
    for ids, texts in _query_blocks(items):
        q = _queries(ids, texts)
        if not len(q.hash):
            continue
        df = _frequencies(docs, q)
        n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
                            for t in range(len(q.hash))], np.int64)
        found = docs.mapInArrow(_search(q, weights, n_docs, n_terms), "item long, item_id long, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        part = F.pmod(F.hash("doc_id"), F.lit(MERGE_PARTS))
        merged = (found.withColumn("part", part)
                  .withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order)))
                  .where(F.col("rank") <= TOP)
                  .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order)))
                  .where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score"))
        out = merged if out is None else out.unionByName(merged)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return out


#: DuckDB: the scores of all documents, ten of each item.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
i AS (
  SELECT row_number() OVER () AS item, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
all_of AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
      FROM tf, all_of GROUP BY term),
m AS (SELECT k, doc_id, 25 + (75 * len(terms) * n_docs) // n_terms AS m FROM d, all_of),
s AS (
  SELECT item, any_value(i.item_id) AS item_id, m.k, any_value(m.doc_id) AS doc_id,
         CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m))) AS BIGINT) AS score
  FROM i JOIN tf USING (term) JOIN w USING (term) JOIN m ON m.k = tf.k
  GROUP BY item, m.k)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""
