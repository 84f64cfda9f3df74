"""Periodic runs of words: multi-scale minimizers find the periods, direct lag scans the short ones.

A run is a maximal stretch of words with smallest period q and a length of at
least max(24, 3q).  Every task works on whole texts, a slice of texts at a time
as one array of word ids with a unique id between texts, so no run crosses one.

* Periods under 16: the words are compared with themselves at each such lag.
* Periods in [S, 2S), S = 16, 32, ...: at this scale the k-mers (k = S/3) of
  least hash in each window of w = S/4 places are kept, the leftmost of equals.
  Of equal kept k-mers only heads count: those without an equal one up to k/2
  places before.  Heads of one hash at a distance in [S, 2S) give a candidate
  lag; they stand over S/6 apart, so each has at most a dozen partners.
* A candidate is probed at some places, then extended both ways word by word.

No run is missed.  What is kept in a window depends on its k+w-1 words alone, so
inside a run of period p it repeats at distance p.  Some head repeats too: were
there none, equal k-mers at distances of at most k/2 would chain through a whole
period; they overlap by k, so all have one period d <= k/2 over p+k words, and
the run's period would be a proper divisor of p.  The head is found within the
first k/2 + w + p words and its partner ends k+w later, and
3p >= 2p + 1.5k + 2w as p >= S.

Defined results: a null or empty text has no words and no runs (both digests are
of the empty string); repeated rows are judged one by one; a null doc_id plants
nothing; other columns of the documents are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value

LEAST_LENGTH = 24
LEAST_PERIODS = 3
FIRST_SCALE = 16               # periods under it are found by direct lag scans
SLICE_BYTES = 2 << 20          # text bytes worked on at a time in a task

_LOW32 = np.uint64(0xFFFFFFFF)


def word_ids(data: np.ndarray, words: W.Words) -> np.ndarray:
    """An id for each word of a slice, equal if and only if the words are equal."""
    _, first, ids = np.unique(words.hash, return_index=True, return_inverse=True)
    size = words.end - words.start
    like = first[ids]
    if not W.same_bytes(data, words.start, size, data, words.start[like], size[like]).all():
        seen: dict[bytes, int] = {}                    # two words of one hash: number them by their bytes
        raw = data.tobytes()
        ids = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(words.start, words.end)], np.int64)
    return ids


def planted_order(first: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """The index of the word that stands at each place once periodic tails are planted.

    ``first`` has the index of each text's first word, ``crc`` a number for each text (below 0:
    nothing planted).  If it is divisible by 10, g = crc // 10, n words: word i >= a = g % n
    becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).
    """
    order = np.arange(first[-1])
    for t in np.flatnonzero((crc >= 0) & (crc % 10 == 0) & (np.diff(first) > 0)):
        n, g = int(first[t + 1] - first[t]), int(crc[t]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        order[first[t] + a:first[t + 1]] = first[t] + a + np.arange(n - a) % p
    return order


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of True of at least ``least`` places."""
    edge = np.flatnonzero(equal[1:] != equal[:-1]) + 1
    bound = np.concatenate([[0], edge, [len(equal)]])
    if not equal[0]:
        bound = bound[1:]
    start, end = bound[:len(bound) // 2 * 2:2], bound[1::2]
    long = end - start >= least
    return start[long], end[long]


def _short_periods(x: np.ndarray) -> Iterator[tuple[int, int, int]]:
    for p in range(1, min(FIRST_SCALE, len(x))):
        for a, b in zip(*_stretches(x[p:] == x[:-p], max(LEAST_LENGTH, LEAST_PERIODS * p) - p)):
            yield int(a), int(b) + p, p


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """The least key of each window of w (a power of two) places."""
    m, t = key, 1
    while t < w:
        m = np.minimum(m[:-t], m[t:])
        t *= 2
    return m


def _powers(base: int, n: int) -> np.ndarray:
    return W._geometric(np.uint64(base), n)


def _candidates(x: np.ndarray, hashed: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags in [scale, 2 scale) of equal heads; ``hashed`` is a 64-bit value for each word."""
    none = np.zeros(0, np.int64)
    k, w = scale // 3, scale // 4
    if len(x) < scale + k + w:
        return none, none
    base = int(W._BASE)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * _powers(base, len(x)), dtype=np.uint64)])
    # equal k-mers always get equal values; a false equal one is only a candidate in vain
    kmer = W.mix((total[k:] - total[:-k]) * _powers(pow(base, -1, 1 << 64), len(x) - k + 1))
    least = _window_minima((kmer & ~_LOW32) | np.arange(len(kmer), dtype=np.uint64), w)
    kept = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    kept = (least[kept] & _LOW32).astype(np.int64)
    value = kmer[kept]
    order = np.argsort(value, kind="stable")
    value, place = value[order], kept[order]
    head = np.append(True, (value[1:] != value[:-1]) | (place[1:] - place[:-1] > k // 2))
    value, place = value[head], place[head]
    places, lags = [], []
    for step in range(1, len(place)):
        lag = place[step:] - place[:-step]
        near = (value[step:] == value[:-step]) & (lag < 2 * scale)
        if not near.any():
            break
        good = near & (lag >= scale)
        places.append(place[:-step][good])
        lags.append(lag[good])
    return (np.concatenate(places), np.concatenate(lags)) if places else (none, none)


def _probed(x: np.ndarray, place: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Whether each candidate may lie in an equal stretch of two lags: all probes hold in the lag after or before it."""
    ahead = np.ones(len(place), dtype=bool)
    behind = np.ones(len(place), dtype=bool)
    for t in range(9):
        ahead &= _equal_at(x, place + (lag - 1) * t // 8, lag)
        behind &= _equal_at(x, place - (lag - 1) * t // 8, lag)
    return ahead | behind


def _equal_at(x, at, lag):
    inside = (at >= 0) & (at + lag < len(x))
    at = np.where(inside, at, 0)
    return inside & (x[at] == x[np.where(inside, at + lag, 0)])


def _extent(x: np.ndarray, i: int, p: int) -> tuple[int, int]:
    """The maximal stretch [a, b) of places around i that equal the place p later."""
    b, step = i, 64
    while b < len(x) - p:
        n = min(step, len(x) - p - b)
        equal = x[b:b + n] == x[b + p:b + p + n]
        if not equal.all():
            b += int(equal.argmin())
            break
        b, step = b + n, step * 2
    a, step = i, 64
    while a > 0:
        n = min(step, a)
        equal = x[a - n:a] == x[a - n + p:a + p]
        if not equal.all():
            a -= int(equal[::-1].argmin())
            break
        a, step = a - n, step * 2
    return a, b


def _long_periods(x: np.ndarray, longest: int) -> Iterator[tuple[int, int, int]]:
    hashed = W.mix(x.astype(np.uint64) + np.uint64(1))
    scale = FIRST_SCALE
    while LEAST_PERIODS * scale <= longest:
        place, lag = _candidates(x, hashed, scale)
        good = _probed(x, place, lag)
        place, lag = place[good], lag[good]
        done, last = 0, 0                              # lag, and where the last stretch looked at for it ends
        for j in np.lexsort((place, lag)):
            i, p = int(place[j]), int(lag[j])
            if p == done and i < last:
                continue
            a, b = _extent(x, i, p)
            done, last = p, b
            if b - a >= max(LEAST_LENGTH, LEAST_PERIODS * p) - p:
                yield a, b + p, p
        scale *= 2


def runs_of(ids: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
    """All runs of the texts of a slice, as (text, start, length, period) in order of text, start and period.

    ``ids`` are the word ids of all texts back to back, ``first`` the index of each text's first word.
    """
    n = np.diff(first)
    least: dict[tuple[int, int], int] = {}
    longest = int(n.max()) if len(n) else 0
    size = FIRST_SCALE * LEAST_PERIODS
    for finder, shortest in ((lambda x: _short_periods(x), LEAST_LENGTH), (lambda x: _long_periods(x, longest), size)):
        rows = np.flatnonzero(n >= shortest)
        if not len(rows):
            continue
        # the texts' words, each text followed by an id that stands nowhere else
        own = n[rows]
        at = np.cumsum(own + 1) - own - 1
        x = np.empty(int(own.sum()) + len(rows), np.int64)
        x[W.ragged(at, own)] = ids[W.ragged(first[rows], own)]
        x[at + own] = -1 - np.arange(len(rows))
        shift = first[rows] - at
        for a, b, p in finder(x):
            t = int(np.searchsorted(at, a, side="right")) - 1
            key = (a + int(shift[t]), b + int(shift[t]))
            # the same stretch with a smaller period is the run; this period is a multiple of it
            least[key] = min(p, least.get(key, p))
    out = []
    for (a, b), p in least.items():
        t = int(np.searchsorted(first, a, side="right")) - 1
        out.append((t, a - int(first[t]), b - a, p))
    return sorted(out, key=lambda r: (r[0], r[1], r[3]))


def _kept_words(runs, first: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    for t, start, length, period in runs:
        change[first[t] + start + period] += 1
        change[first[t] + start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _joined(data: np.ndarray, words: W.Words, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words in this order, a space after each, and where each begins."""
    size = words.end[order] - words.start[order]
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    out[W.ragged(begin[:-1], size)] = data[W.ragged(words.start[order], size)]
    return out, begin


COLUMNS = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def _rows(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, with_text: bool) -> dict:
    w = W.words_of(data, offsets)
    crc = part.column(part.schema.get_field_index("crc")).fill_null(-1).to_numpy(zero_copy_only=False)
    order = planted_order(w.first, crc)
    runs = runs_of(word_ids(data, w)[order], w.first)
    kept = _kept_words(runs, w.first)
    text, begin = _joined(data, w, order[kept])
    ends = begin[np.concatenate([[0], np.cumsum(kept)])[w.first]]
    n = len(part)
    out = {c.split()[0]: [None] * n for c in COLUMNS.split(", ")[1:]}
    own: list[list] = [[] for _ in range(n)]
    for t, *run in runs:
        own[t].append(run)
    raw = memoryview(text)
    texts = [None] * n
    for t in range(n):
        out["n_runs"][t] = len(own[t])
        if own[t]:
            start, length, period = min(own[t], key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            out["start"][t], out["length"][t], out["period"][t] = start, length, period
            out["exponent_milli"][t] = 1000 * length // period
        out["runs_sha256"][t] = hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in own[t]).encode()).hexdigest()
        a, b = int(ends[t]), max(int(ends[t]), int(ends[t + 1]) - 1)
        out["collapsed_sha256"][t] = hashlib.sha256(raw[a:b]).hexdigest()
        if with_text:
            texts[t] = bytes(raw[a:b]).decode()
    return out | ({"collapsed": texts} if with_text else {})


def periodic_runs(docs: DataFrame, planted: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: its number of runs, the run of greatest length / period, and digests.

    ``planted`` first makes the tails of a tenth of the texts periodic (by the CRC of doc_id), which
    gives runs of all sizes to find.  ``with_text`` adds ``collapsed``, the text without what
    repeats in its runs, words joined by one space.
    """
    ship_by_value()
    schema = COLUMNS + (", collapsed string" if with_text else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "collapsed": pa.string()}
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) if planted else F.lit(None).cast("long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, slice_bytes=SLICE_BYTES):
                out = _rows(part, data, offsets, with_text)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("doc_id"))]
                    + [pa.array(out[c], types.get(c, pa.int64())) for c in names[1:]], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), crc.cast("long").alias("crc"),
                       F.col("text")).mapInArrow(run, schema)
