"""Token counts: pieces are counted once per distinct pre-token.

A byte-level BPE never merges across pre-tokens, so a text's token count is
the sum over its pre-tokens.  Three steps:

1. every task cuts its texts into pre-tokens (numpy over code points) and
   emits each distinct one with its frequency; a shuffle leaves the corpus
   vocabulary of pre-tokens;
2. the tokenizer library counts the pieces of each of them, once;
3. per-document pre-token frequencies meet those counts and are summed.  The
   ``hot`` most frequent pre-tokens (a fixed number, so a bounded table) are
   joined inside the tasks; the rest travel as (document, pre-token, n) rows to
   a shuffled join.  Token ids are never made for a document.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted one by one (and a repeated doc_id twice); other columns are dropped.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value, store

#: Pre-tokens joined inside the tasks: 9 bytes each, 9 MB in all.
HOT_PRETOKENS = 1_000_000
_FLUSH = 400_000               # pre-tokens a task holds before it merges, and emits, them

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


def char_classes() -> np.ndarray:
    """The class of every code point (letter, number, white space or other), 1.1 MB."""
    import regex
    out = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for base in range(0, sys.maxunicode + 1, 1 << 14):
        block = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\uFFFF" for c in range(base, base + (1 << 14)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, block):
                out[base + m.start():base + m.end()] = kind
    return out


def pretoken_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in ``points`` (code points of texts back to back).

    ``first`` marks the first code point of each text.  The rules are those of
    the public pattern ``P.PATTERN``: contractions, then runs of letters, numbers
    or others with one blank before them, then white space, of which the last
    character before a word stands alone (or is that blank).
    """
    n = len(points)
    kind = classes[points]
    run = first.copy()
    run[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = points == 0x20
    after = np.zeros(n, dtype=bool)            # a text goes on with a non-space here
    after[1:] = ~space[1:] & space[:-1] & ~first[1:]
    starts = run.copy()
    starts[:-1] |= after[1:]                   # the last white space before it
    starts[1:] &= ~(after[1:] & blank[:-1])    # which, when a blank, belongs to the word
    # contractions: an apostrophe of its own, with no blank before it
    mark = np.flatnonzero(run & (points == 0x27))
    if len(mark):
        lone = mark[(mark == 0) | first[mark] | ~blank[np.maximum(mark - 1, 0)]]
        at = lambda k: np.where(lone + k < n, points[np.minimum(lone + k, n - 1)], 0)
        ends = lambda k: (lone + k >= n) | first[np.minimum(lone + k, n - 1)]
        a, b = np.where(ends(1), 0, at(1)), np.where(ends(1) | ends(2), 0, at(2))
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) \
            | ((a == ord("l")) & (b == ord("l")))
        size = np.where(one, 2, np.where(two, 3, 0))
        cut, size = lone[size > 0], size[size > 0]
        starts[cut + 1] = False                # the letters after it begin no word
        stop = cut + size
        stop = stop[stop < n]
        starts[stop] = True
        # a blank after it is taken by the word behind the blank as before
    return np.flatnonzero(starts)


def _specials(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens", [])]


def _check(path: str) -> None:
    """This module's cutting rules hold for byte-level tokenizers without normaliser."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not t[k] for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
            or not pre.get("use_regex", True) or not plain:
        raise ValueError(f"{path}: not a plain byte-level tokenizer")


class _Cutter:
    """Cuts slices of texts into hashed pre-tokens."""

    def __init__(self, specials: list[str], classes: np.ndarray):
        import re
        self.classes = classes
        self.special = re.compile("|".join(re.escape(s) for s in specials)) if specials else None

    def __call__(self, texts: list[str]):
        """(hash, bytes, text starts, row, n specials) of the pre-tokens of ``texts``."""
        specials = np.zeros(len(texts), dtype=np.int64)
        pieces, rows = texts, np.arange(len(texts))
        if self.special is not None:
            cut = [k for k, t in enumerate(texts) if self.special.search(t)]
            if cut:                            # special strings part the text around them
                parts, rows, hit = [], [], set(cut)
                for k, t in enumerate(texts):
                    own = self.special.split(t) if k in hit else [t]
                    specials[k] = len(own) - 1
                    parts += own
                    rows += [k] * len(own)
                pieces, rows = parts, np.array(rows)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        points = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(points):
            e = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), e, e, e, specials, points
        ends = np.cumsum(sizes)
        first = np.zeros(len(points), dtype=bool)
        first[(ends - sizes)[sizes > 0]] = True
        starts = pretoken_starts(points, first, self.classes)
        size = np.diff(np.append(starts, len(points)))
        h = W.run_hashes(points.astype(np.uint64) + np.uint64(1), starts, size)
        row = np.asarray(rows)[np.searchsorted(ends, starts, side="right")]
        return h, starts, size, row, specials, points


def _strings(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The runs of code points as an Arrow string array."""
    begin = np.concatenate([[0], np.cumsum(sizes)])
    own = points[np.arange(begin[-1]) - np.repeat(begin[:-1] - starts, sizes)]
    width = np.concatenate([[0], np.cumsum(1 + (own > 0x7F) + (own > 0x7FF) + (own > 0xFFFF))])
    data = own.tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(width[begin].astype(np.int64).tobytes()),
                                            pa.py_buffer(data)).cast(pa.string())


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    u, at, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    return u, n, pa.concat_arrays([p[2] for p in parts]).take(pa.array(at))


def _vocabulary_batch(u: np.ndarray, n: np.ndarray, strings: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(W.signed(u)), strings, pa.array(n)], names=["hash", "pretoken", "freq"])


def _slices(batches, text):
    for batch in batches:
        for part, data, _ in W.text_slices(batch, text, 1 << 19):
            yield part, data, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]


def pretoken_vocabulary(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Distinct pre-tokens of the corpus: hash, pretoken, freq."""
    ship_by_value()
    specials, classes = _specials(path), docs.sparkSession.sparkContext.broadcast(char_classes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held = _Cutter(specials, classes.value), []
        for _, _, texts in _slices(batches, text):
            h, starts, size, _, _, points = cutter(texts)
            if not len(h):
                continue
            u, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((u, n, _strings(points, starts[at], size[at])))
            if sum(len(x[0]) for x in held) > _FLUSH:
                held = [_merged(held)]
                if len(held[0][0]) > _FLUSH // 2:
                    yield _vocabulary_batch(*held.pop())
        if held:
            yield _vocabulary_batch(*_merged(held))

    rows = docs.select(F.col(text).alias("text") if text != "text" else F.col(text)).mapInArrow(
        run, "hash long, pretoken string, freq long")
    return rows.groupBy("hash", "pretoken").agg(F.sum("freq").alias("freq"))


def count_pieces(vocabulary: DataFrame, path: str) -> DataFrame:
    """``vocabulary`` with n_pieces, by the tokenizer library."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True     # a pre-token is ordinary text
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                got = tokenizer.encode_batch_fast(part.column(1).to_pylist(), add_special_tokens=False)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(e.ids) for e in got], pa.int64())],
                    names=["hash", "pretoken", "freq", "n_pieces"])

    return vocabulary.mapInArrow(run, "hash long, pretoken string, freq long, n_pieces long")


def token_counts(docs: DataFrame, path: str, limit: int = 512, hot: int = HOT_PRETOKENS,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    _check(path)
    ship_by_value()
    spark, specials = docs.sparkSession, _specials(path)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    pieces = store(count_pieces(pretoken_vocabulary(docs, path), path).select("hash", "freq", "n_pieces"), "pieces")
    floor = _frequency_floor(pieces, hot)
    frequent = F.col("freq") >= floor
    table = (pieces.where(frequent & (F.col("n_pieces") < 256))
             .select("hash", F.col("n_pieces").cast("short")).toArrow())
    keys = np.asarray(table.column(0), dtype=np.int64)
    order = np.argsort(keys)
    classes = spark.sparkContext.broadcast(char_classes())
    known = spark.sparkContext.broadcast((keys[order], np.asarray(table.column(1))[order].astype(np.uint8)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, (key, count) = _Cutter(specials, classes.value), known.value
        row_id = 0
        for part, data, texts in _slices(batches, "text"):
            h, _, _, row, special, _ = cutter(texts)
            u, inverse, n = np.unique(W.signed(h), return_inverse=True, return_counts=True)
            at = np.minimum(np.searchsorted(key, u), max(len(key) - 1, 0))
            found = key[at] == u if len(key) else np.zeros(len(u), dtype=bool)
            each = np.where(found, count[at] if len(key) else 0, 0).astype(np.int64)
            total = special + np.bincount(row, weights=each[inverse], minlength=len(texts)).astype(np.int64)
            rest = ~found[inverse]
            ids = part.column(0).cast(pa.int64()).to_pylist()
            size = np.diff(W.text_buffer(part.column(1))[1])
            serial = np.arange(row_id, row_id + len(texts))
            row_id += len(texts)
            # one row of the document's own, then one for each other pre-token of it
            pair, m = np.unique(np.stack([row[rest], inverse[rest]]), axis=1, return_counts=True) if rest.any() \
                else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(serial), pa.array(size.astype(np.int64)), pa.array(total),
                 pa.array(W.signed(W.mix(serial.astype(np.uint64) + W._N_STEP[3]))), pa.nulls(len(ids), pa.int64())],
                names=_OUT)
            if len(m):
                none = pa.nulls(len(m), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [none, pa.array(serial[pair[0]]), none, none, pa.array(u[pair[1]]), pa.array(m)], names=_OUT)

    # a document's own row has a hash that only spreads it over the join's tasks: its n is null
    rows = docs.mapInArrow(run, "doc_id long, serial long, n_bytes long, known long, hash long, n long")
    rows = rows.withColumn("serial", F.spark_partition_id() * F.lit(1 << 40) + F.col("serial"))
    tail = pieces.where(~frequent | (F.col("n_pieces") >= 256)).select(F.col("hash").alias("t_hash"), "n_pieces")
    summed = (rows.join(tail, F.col("hash") == F.col("t_hash"), "left")
              .groupBy("serial")
              .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                   (F.sum("known") + F.coalesce(F.sum(F.col("n") * F.col("n_pieces")), F.lit(0)))
                   .alias("n_tokens")))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


_OUT = ["doc_id", "serial", "n_bytes", "known", "hash", "n"]


def _frequency_floor(pieces: DataFrame, hot: int) -> int:
    """The least frequency that at most ``hot`` pre-tokens reach.

    Frequencies are counted in half-octave bins, so a few dozen rows come back.
    """
    level = F.floor(F.log2(F.col("freq").cast("double")) * 2).cast("int")
    bins = dict(pieces.groupBy(level.alias("b")).count().collect())
    total, cut = 0, max(bins, default=0) + 1
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > hot:
            break
        cut = b
    return max(1, int(np.ceil(2 ** (cut / 2) - 1e-9)))
