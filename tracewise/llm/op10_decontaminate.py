"""Benchmark decontamination: spaced-seed hashing.

A seed is a mask over consecutive words; its hash ignores the masked positions,
so two passages meet although words were substituted there.  The hashes of
benchmark and corpus are joined; around each hit the words of both sides are
aligned, and an overlap counts if some run of ``window`` aligned words (of all
the item's words, if those are fewer) that holds the hit has at least
``similarity`` equal ones.  The two masks below miss no run of 16 words with up
to three substitutions (all 560 patterns were tried).  An item of fewer words
than ``window`` that may have e unequal ones is cut into e + 1 pieces of equal
length besides: one of them stands in every overlap as it is.

The corpus is scanned once.  A position's seed hash is first asked of a
fixed-size bit table of the benchmark's hashes (2 MB, whatever the benchmark's
size: a full table only lets more through); what passes is joined by hash.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.

Defined results: null and empty texts overlap with nothing; items of fewer
than ``shortest`` words (1: those without words) are not looked for; items of one id are taken apart,
and a pair's figures are those of its best item; a repeated document gives
equal rows once; other columns are dropped (``overlaps``) or kept (``clean``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value, store

#: 1 = the word counts, 0 = any word.
MASKS = ("111011", "110111")
WINDOW = 16
SIMILARITY = 0.8
SHORTEST = 1
_BITS = 24
# words of aligned pairs compared at a time
_CELLS = 1 << 18


def seed_hashes(h: np.ndarray, row: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of the mask at every position where it fits into a row."""
    m = len(h) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:m] == row[len(mask) - 1:])
    acc = np.full(len(at), W._N_STEP[int(mask, 2) % 251], dtype=np.uint64)
    for k, used in enumerate(mask):
        if used == "1":
            acc = acc * W._BASE + h[at + k]
    return W.mix(acc), at


def need(size: int, similarity: float) -> int:
    """Equal words that ``size`` aligned ones must hold."""
    return int(np.ceil(size * similarity - 1e-9))


def may_hold(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indexes of the hashes whose two places in the bit table are both set."""
    low, left = np.uint64((1 << _BITS) - 1), np.arange(len(h))
    for shift in (np.uint64(0), np.uint64(32)):
        x = (h[left] >> shift) & low
        left = left[(table[x >> np.uint64(3)] >> (np.uint64(7) - (x & np.uint64(7))).astype(np.uint8)) & 1 > 0]
    return left


def bit_table(seeds: DataFrame) -> np.ndarray:
    """The packed bit table of all seed hashes; what comes to the driver is places in it."""
    low = (1 << _BITS) - 1
    at = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(low)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(low))))
    table = np.zeros(1 << _BITS, dtype=bool)
    table[np.asarray(seeds.select(at.alias("at")).distinct().toArrow().column(0), dtype=np.int64)] = True
    return np.packbits(table)


def piece_length(size: int, similarity: float) -> int:
    """Words of a piece of which ``size`` words hold one more than words may be unequal."""
    return max(1, size // (size - need(size, similarity) + 1))


def benchmark_items(benchmark: DataFrame, masks=MASKS, shortest: int = SHORTEST, window: int = WINDOW,
                    similarity: float = SIMILARITY) -> DataFrame:
    """item (a number of its own), item_id, words (hashes), seeds [hash, first, span]."""
    ship_by_value()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                w = W.words_of(data, offsets, lower=True)
                ids, words, seeds = [], [], []
                for k in range(part.num_rows):
                    own = w.hash[w.first[k]:w.first[k + 1]]
                    if len(own) < max(1, shortest):
                        continue
                    rows = []
                    length = piece_length(len(own), similarity) if len(own) < window else 0
                    for mask in [*masks, "1" * length] if length else masks:
                        h, at = seed_hashes(own, np.zeros(len(own), np.int64), mask)
                        if mask not in masks:          # side by side
                            h, at = h[::length], at[::length]
                        rows += [{"hash": x, "first": p, "span": len(mask)} for x, p in zip(W.signed(h).tolist(), at.tolist())]
                    ids.append(part.column(0)[k].as_py())
                    words.append(W.signed(own).tolist())
                    seeds.append(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(words, pa.list_(pa.int64())),
                     pa.array(seeds, pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("span", pa.int32())])))],
                    names=["item_id", "words", "seeds"])

    return (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
            .mapInArrow(run, "item_id long, words array<long>, seeds array<struct<hash: long, first: int, span: int>>")
            .select(F.monotonically_increasing_id().alias("item"), "item_id", "words", "seeds"))


def corpus_segments(docs: DataFrame, table: np.ndarray, masks=MASKS, window: int = WINDOW) -> DataFrame:
    """Stretches of documents around positions whose seed may be in the benchmark:
    doc_id, words (hashes), hits [hash, first]."""
    ship_by_value()
    shared = docs.sparkSession.sparkContext.broadcast(table)
    reach = window + max(map(len, masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                w = W.words_of(data, offsets, lower=True)
                found = []
                for mask in masks:
                    h, at = seed_hashes(w.hash, w.row, mask)
                    hit = may_hold(shared.value, h)
                    found.append((h[hit], at[hit]))
                h, at = (np.concatenate(x) for x in zip(*found))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                h, at = h[order], at[order]
                row = w.row[at]
                new = np.ones(len(at), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * reach)
                lo = np.flatnonzero(new)
                hi = np.append(lo[1:], len(at))
                begin = np.maximum(at[lo] - reach, w.first[row[lo]])
                end = np.minimum(at[hi - 1] + reach, w.first[row[lo] + 1])
                words = [W.signed(w.hash[a:b]) for a, b in zip(begin, end)]
                hits = pa.ListArray.from_arrays(
                    pa.array(np.append(lo, len(at)), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(W.signed(h)), pa.array(at - np.repeat(begin, hi - lo), pa.int32())], names=["hash", "first"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()).take(pa.array(row[lo])), pa.array(words, pa.list_(pa.int64())), hits],
                    names=["doc_id", "words", "hits"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, words array<long>, hits array<struct<hash: long, first: int>>")


def best_overlap(words: np.ndarray, item: np.ndarray, hit_hash: np.ndarray, hit_at: np.ndarray,
                 seeds: list[tuple[int, int, int]], window: int, similarity: float) -> tuple[int, int] | None:
    """(covered words, equal ones among them) of the best alignment of two word
    arrays; None if none counts.

    ``hit_hash`` and ``hit_at`` are the hits in ``words`` (ascending places), ``seeds`` those of
    the item (hash, first word, span).  Only diagonals on which a seed meets a hit are
    looked at, each once however many do, some at a time (``_CELLS`` words).
    """
    size = min(window, len(item))
    least, best = need(size, similarity), None
    order = np.argsort(hit_hash, kind="stable")
    hit_hash, hit_at = hit_hash[order], hit_at[order]
    lo = np.searchsorted(hit_hash, [s[0] for s in seeds], "left")
    hi = np.searchsorted(hit_hash, [s[0] for s in seeds], "right")
    met = [(hit_at[a:b] - q, q, span) for a, b, (_, q, span) in zip(lo, hi, seeds) if a < b]
    there = np.zeros(len(words) + len(item) + 1, dtype=bool)
    for own, _, _ in met:
        there[own + len(item)] = True
    diagonals = np.flatnonzero(there) - len(item)
    step = max(1, _CELLS // len(item))
    for k in range(0, len(diagonals), step):
        d = diagonals[k:k + step]
        a, b = max(0, -int(d[-1])), min(len(item), len(words) - int(d[0]))      # item words that meet any word
        if b - a < size:
            continue
        at = d[:, None] + np.arange(a, b)
        inside = (at >= 0) & (at < len(words))
        same = inside & (words[np.clip(at, 0, len(words) - 1)] == item[a:b])
        total = np.zeros((len(d), b - a + 1), dtype=np.int64)
        np.cumsum(same, axis=1, out=total[:, 1:])
        good = inside[:, :b - a - size + 1] & inside[:, size - 1:] & (total[:, size:] - total[:, :-size] >= least)
        held = np.zeros((len(d), good.shape[1] + 1), dtype=np.int64)            # windows that hold a hit
        for own, q, span in met:
            first, last = max(0, q + span - size - a), min(good.shape[1], q - a + 1)
            if first < last:
                row = np.searchsorted(d, own[np.searchsorted(own, d[0]):np.searchsorted(own, d[-1], "right")])
                held[row, first] += 1
                held[row, last] -= 1
        good &= np.cumsum(held, axis=1)[:, :-1] > 0
        some = np.flatnonzero(good.any(axis=1))
        if not len(some):
            continue
        cover = np.zeros((len(some), b - a + 1), dtype=np.int64)
        cover[:, :good.shape[1]] += good[some]
        cover[:, size:] -= good[some]
        covered = np.cumsum(cover, axis=1)[:, :-1] > 0
        got = max(zip(covered.sum(axis=1).tolist(), (covered & same[some]).sum(axis=1).tolist()))
        best = got if best is None else max(best, got)
    return best


def overlaps(docs: DataFrame, benchmark: DataFrame, masks=MASKS, window: int = WINDOW, similarity: float = SIMILARITY,
             shortest: int = SHORTEST) -> DataFrame:
    """Verified overlaps: doc_id, item_id, n_words (covered), n_equal."""
    ship_by_value()
    items = store(benchmark_items(benchmark, masks, shortest, window, similarity), "items")
    seeds = items.select("item", F.explode(F.array_distinct("seeds.hash")).alias("hash"))
    # the masks of pieces run over the corpus only if some item has such pieces: fewer sizes than ``window`` come here
    size = F.size("words")
    short = {piece_length(r.n, similarity) for r in items.where(size < window).select(size.alias("n")).distinct().collect()}
    every = [*masks, *("1" * n for n in sorted(short) if "1" * n not in masks)]
    segments = store(corpus_segments(docs, bit_table(seeds), every, window)
                     .select(F.monotonically_increasing_id().alias("segment"), "*"), "segments")
    # a pair of segment and item goes on once: hashes are distinct on both sides, places are met in the pair's task
    pairs = (segments.select("segment", F.explode(F.array_distinct("hits.hash")).alias("hash"))
             .join(seeds, "hash").select("segment", "item").distinct())
    both = (pairs.join(segments.select("segment", "doc_id", "words", "hits"), "segment")
            .join(items.select("item", "item_id", F.col("words").alias("i_words"), "seeds"), "item")
            .select("doc_id", "item_id", "words", "i_words", "hits", "seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                d, i, words, item, hits, own = (batch.column(c)[k] for c in range(6))
                got = best_overlap(words.values.to_numpy(), item.values.to_numpy(), *(x.to_numpy() for x in hits.values.flatten()),
                                   list(zip(*(x.to_pylist() for x in own.values.flatten()))), window, similarity)
                if got:
                    out.append((d.as_py(), i.as_py(), *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)],
                                             names=["doc_id", "item_id", "n_words", "n_equal"])

    found = both.mapInArrow(run, "doc_id long, item_id long, n_words long, n_equal long")
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_equal")).alias("b")).select(
        "doc_id", "item_id", "b.n_words", "b.n_equal")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose text overlaps with a benchmark item; all columns stay.

    Rows are judged one by one, by doc_id and text: others of the same doc_id, or without one, stay.
    """
    key = F.xxhash64("doc_id", "text")
    leaked = (overlaps(docs.select(key.alias("doc_id"), "text"), benchmark, **how)
              .select(F.col("doc_id").alias("__leaked")).distinct())
    return docs.join(leaked, key == F.col("__leaked"), "left_anti")
