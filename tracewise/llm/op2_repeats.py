"""Suffix-array dedup by prefix-free parsing: remove what repeats for ``LENGTH`` bytes.

A repeat is a string of LENGTH bytes that starts at two places of the corpus, in
one document or two.  Sorting every suffix would move the corpus many times
over; parsed into phrases, it is sorted by phrase, and only where phrases differ
by their bytes:

1. Parse.  A rolling hash of GRAM bytes is taken at every position.  The trigger
   of a string is the place of the least hash among its first REACH ones, so it
   depends on the string alone, equal strings have it at the same place, and no
   phrase is longer than REACH.  A phrase is the run of string starts that have
   one trigger.
2. Dictionary.  All strings of a trigger hold the CORE bytes from it; phrases are
   counted by that core.  A core that occurs once ends it: nothing there repeats.
   Where all phrases of a core have one context (all bytes their strings reach),
   all of their strings repeat.
3. Parse order.  Among cores with several contexts, each context is taken once;
   its phrase suffixes are put in order in blocks of BLOCK starts, by the bytes
   all strings of a block share and then by all that they reach.  As before, a
   block is decided if it is alone or if its neighbours in that order are equal.
4. What is left (ends of repeats) is ordered string by string.

Order is needed only as far as LENGTH bytes, and only to see whether neighbours
are equal, so digests of the compared bytes stand for their ranks.  (A full
suffix array would also rank unequal ones; nothing here asks for that.)

Every step counts by key with partial aggregation and joins back; documents with
open phrases are stored once with their text.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing; a
repeated row is a copy like any other, so it loses all its bytes if it has
LENGTH of them; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value, store

LENGTH = 400
GRAM = 32
REACH = 256                    # a power of two, at most LENGTH - GRAM + 1
CORE = LENGTH - REACH + 1
BLOCK = 16                     # starts that share a key in the third step
_PIECE = 1 << 22               # bytes hashed at a time; longer texts are cut with overlap
_PLACE = np.uint64((1 << 24) - 1)
_INVERSE = np.uint64(pow(int(W._BASE), -1, 1 << 64))


class Rolling:
    """Digests of substrings of a byte array of under 2^24 bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.down = W._geometric(_INVERSE, n + 1)
        self.total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(W._EXACT[data] * W._geometric(W._BASE, n + 1)[:n], out=self.total[1:])

    def __call__(self, start: np.ndarray, size) -> np.ndarray:
        sizes = np.broadcast_to(np.asarray(size, dtype=np.int64), start.shape)
        return W.mix((self.total[start + sizes] - self.total[start]) * self.down[start] + sizes.astype(np.uint64) * W._STEP)


def phrases(data: np.ndarray, bounds: np.ndarray):
    """(rolling, first, last, trigger): the phrases of texts lying back to back."""
    n, roll = len(data), Rolling(data)
    h = roll(np.arange(max(0, n - GRAM + 1)), GRAM)
    low, k = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
    while k < REACH:                           # least of 1, 2, 4 ... REACH hashes from each place on
        low = np.minimum(low[:-k], low[k:]) if len(low) > k else low[:0]
        k *= 2
    change = np.zeros(n + 1, dtype=np.int64)   # places where a string of LENGTH fits
    size = np.diff(bounds)
    fit = size >= LENGTH
    np.add.at(change, bounds[:-1][fit], 1)
    np.add.at(change, bounds[1:][fit] - LENGTH + 1, -1)
    start = np.flatnonzero(np.cumsum(change)[:len(low)])
    if not len(start):
        return roll, start, start, start
    at = (low[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
    # back-to-back texts: a text's first start is a phrase of its own
    new[np.searchsorted(start, bounds[:-1][fit])] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return roll, start[first], start[last], at[first]


def _pieces(data: np.ndarray, offsets: np.ndarray):
    """(bytes, bounds, base): texts, cut with LENGTH - 1 bytes of overlap when one is very long."""
    if len(data) <= _PIECE:
        yield data, offsets, 0
        return
    for at in range(0, max(1, len(data) - LENGTH + 1), _PIECE):   # a long slice holds one text
        part = data[at:at + _PIECE + LENGTH - 1]
        yield part, np.array([0, len(part)]), at


def _parse(docs: DataFrame) -> DataFrame:
    """core, context, key, id, s, n, d: the phrases (starts s to s+n, trigger s+d) of every text."""
    names = ["core", "context", "key", "id", "s", "n", "d"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                key, own = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                for piece, bounds, base in _pieces(data, offsets):
                    roll, s, e, t = phrases(piece, bounds)
                    if not len(s):
                        continue
                    row = np.searchsorted(bounds, s, side="right") - 1
                    shape = (t - s).astype(np.uint64) * np.uint64(REACH) + (e - s).astype(np.uint64)
                    context = W.mix(roll(s, e + LENGTH - s) + shape * W._BASE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.signed(roll(t, CORE))), pa.array(W.signed(context)), pa.array(key[row]), pa.array(own[row]),
                         pa.array(s - bounds[row] + base), pa.array((e - s).astype(np.int32)), pa.array((t - s).astype(np.int32))],
                        names=names)

    return docs.mapInArrow(run, "core long, context long, key long, id long, s long, n int, d int")


def _decided(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` whose key occurs twice or more, with ``open``: whether its values differ."""
    seen = (rows.groupBy(F.col(key).alias("k_key")).agg(F.count("*").alias("k_n"), F.min(value).alias("k_lo"), F.max(value).alias("k_hi"))
            .where("k_n > 1").select("k_key", (F.col("k_lo") < F.col("k_hi")).alias("open")))
    # stored, so that the join below is of its own and a hot key's rows can be split
    seen = store(seen, f"seen-{key}")
    return rows.join(seen, F.col(key) == F.col("k_key")).drop("k_key")


def _marked(rows: DataFrame) -> DataFrame:
    """key, id, marks [s, n, d, full, shown] of the texts with phrases that may repeat.

    full: all strings of the phrase repeat; shown: it stands for its context in
    the next step.
    """
    # stored: read three times, and a hot core's rows are no longer tied to one task
    found = store(_decided(rows, "core", "context"), "phrases")
    same = ["core", "context"]
    own = F.struct("key", "id", "s")
    # stored like the keys above: a hot (core, context) is counted map-side, and its rows can be split in the join
    seen = store(found.where("open").groupBy(*same).agg(F.count("*").alias("c_n"), F.min(own).alias("c_first")), "contexts")
    still = (found.where("open").join(seen, same)
             .select("key", "id", "s", "n", "d", (F.col("c_n") > 1).alias("full"), (own == F.col("c_first")).alias("shown"))
             .where("full or shown"))
    sure = found.where("not open").select("key", "id", "s", "n", "d", F.lit(True).alias("full"), F.lit(False).alias("shown"))
    return sure.unionByName(still).groupBy("key", "id").agg(F.collect_set(F.struct("s", "n", "d", "full", "shown")).alias("marks"))


def _result(text: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[int, int, str]:
    """(removed bytes, spans, digest of the rest) when the strings from lo to hi all repeat."""
    if not len(lo):
        return 0, 0, hashlib.sha256(text.tobytes()).hexdigest()
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + LENGTH, -1)
    gone = np.cumsum(change)[:-1] > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()


def _groups_within(lo: np.ndarray, hi: np.ndarray, limit: int):
    """Runs of sorted byte ranges that reach over at most ``limit`` bytes (one range at least)."""
    a = 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(hi, lo[a] + limit, side="right")))
        yield a, b
        a = b


def _blocks(text: np.ndarray, s: np.ndarray, n: np.ndarray, d: np.ndarray):
    """(inner, outer, lo, hi) of the blocks of phrases in one text."""
    out = []
    order = np.argsort(s, kind="stable")
    s, n, d = s[order], n[order].astype(np.int64), d[order].astype(np.int64)
    top, low = d // BLOCK, (d - n) // BLOCK    # blocks are counted by the distance to the trigger
    for a, b in _groups_within(s, np.maximum.accumulate(s + n + LENGTH), _PIECE):
        base = s[a]
        roll = Rolling(text[base:int((s[a:b] + n[a:b]).max()) + LENGTH])
        many = top[a:b] - low[a:b] + 1
        of = np.repeat(np.arange(a, b), many)
        q = np.repeat(low[a:b], many) + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        far, near = np.minimum(q * BLOCK + BLOCK - 1, d[of]), np.maximum(q * BLOCK, d[of] - n[of])
        t = s[of] + d[of] - base
        inner = W.mix(roll(t - q * BLOCK, LENGTH - BLOCK + 1) + q.astype(np.uint64) * W._BASE)
        shape = far.astype(np.uint64) * np.uint64(REACH) + near.astype(np.uint64)
        outer = W.mix(roll(t - far, far - near + LENGTH) + shape * W._BASE)
        out.append((W.signed(inner), W.signed(outer), t - far + base, t - near + base))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(4))


_RANGE = pa.struct([("lo", pa.int64()), ("hi", pa.int64())])
_KEYED = pa.struct([("inner", pa.int64()), ("outer", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


def _structs(kind: pa.StructType, columns) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))


def _open_texts(marked: DataFrame) -> DataFrame:
    """Results of the texts decided by now; text, full and blocks of the others."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "full", "blocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                out = []
                marks = part.column(2)
                for k in range(part.num_rows):
                    text = data[offsets[k]:offsets[k + 1]]
                    if not marks[k].is_valid:
                        out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest(), None, None, None))
                        continue
                    s, n, d, full, shown = (f.to_numpy(zero_copy_only=False) for f in marks[k].values.flatten())
                    lo, hi = s[full], s[full] + n[full]
                    if shown.any():
                        blocks = _structs(_KEYED, _blocks(text, s[shown], n[shown], d[shown]))
                        out.append((len(text), None, None, None, text.tobytes().decode(), _structs(_RANGE, (lo, hi)), blocks))
                    else:
                        out.append((len(text), *_result(text, lo, hi), None, None, None))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_RANGE), pa.list_(_KEYED)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), *[pa.array([r[c] for r in out], kinds[c]) for c in range(7)]], names=names)

    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, "
                                  "full array<struct<lo: long, hi: long>>, "
                                  "blocks array<struct<inner: long, outer: long, lo: long, hi: long>>")


def _single_strings(open_blocks: DataFrame) -> DataFrame:
    """row, digest, s: the strings of the blocks (lo to hi) still open, from (row, text, ranges)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                rows, digests, starts = [], [], []
                for k in range(part.num_rows):
                    text = data[offsets[k]:offsets[k + 1]]
                    lo, hi = (f.to_numpy(zero_copy_only=False) for f in part.column(2)[k].values.flatten())
                    order = np.argsort(lo, kind="stable")
                    lo, hi = lo[order], hi[order]
                    for a, b in _groups_within(lo, np.maximum.accumulate(hi + LENGTH), _PIECE):
                        size = hi[a:b] - lo[a:b] + 1
                        s = np.repeat(lo[a:b], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        digests.append(Rolling(text[lo[a]:int(hi[a:b].max()) + LENGTH])(s - lo[a], LENGTH))
                        starts.append(s)
                        rows.append(np.full(len(s), part.column(0)[k].as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(rows)), pa.array(W.signed(np.concatenate(digests))), pa.array(np.concatenate(starts))],
                        names=["row", "digest", "s"])

    return open_blocks.mapInArrow(run, "row long, digest long, s long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    ship_by_value()
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    keyed = docs.select(F.xxhash64("text").alias("key"), F.coalesce("doc_id", F.lit(-1)).alias("id"), "doc_id", "text")
    marks = _marked(_parse(keyed.select("key", "id", "text")))
    marked = keyed.join(marks, ["key", "id"], "left").select("doc_id", "text", "marks")
    state = store(_open_texts(marked).select(F.monotonically_increasing_id().alias("row"), "*"), "repeats")

    # blocks: alone, equal, or open
    block = state.where("blocks is not null").select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    block = store(_decided(block, "inner", "outer").select("row", "lo", "hi", "open"), "blocks")
    open_blocks = block.where("open").groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    texts = state.where("text is not null").select("row", "text")
    strings = _single_strings(texts.join(open_blocks, "row").select("row", "text", "ranges"))
    twice = strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest")
    single = strings.join(twice, "digest").select("row", F.col("s").alias("lo"), F.col("s").alias("hi"))
    ranges = (block.where("not open").select("row", "lo", "hi").unionByName(single)
              .groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("more")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                out = []
                for k in range(part.num_rows):
                    both = [part.column(c)[k].values.flatten() for c in (3, 4) if part.column(c)[k].is_valid]
                    lo, hi = (np.concatenate([b[i].to_numpy(zero_copy_only=False) for b in both] or [np.zeros(0, np.int64)])
                              for i in (0, 1))
                    out.append(_result(data[offsets[k]:offsets[k + 1]], lo, hi))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *[pa.array([r[c] for r in out]) for c in range(3)]],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    late = (state.where("text is not null").join(ranges, "row", "left").select("doc_id", "n_bytes", "text", "full", "more")
            .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return state.where("text is null").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").unionByName(late)
