"""Language identification by prediction by partial matching (PPM).

For each language a variable-order byte model: how often each byte follows each
context of 0 to ORDER bytes.  A text's code length under a language is the sum
over its bytes of -log2 of the byte's probability: the longest known context
gives the byte's share of T + D (T occurrences, D distinct followers), or else
the escape share D of T + D and the next shorter context, without the bytes that
the longer one already excluded; last comes a uniform code over the bytes never
seen.  Statistics are frozen: scoring changes nothing.  The language of the
shortest code wins (of equals the first by name); ``score`` is its share of the
probability, all languages taken as equally likely before.

The context trees hold what follows from the counts of (ORDER + 1)-byte strings
(texts are padded with ORDER zero bytes at the start), since every shorter
context's counts are sums of theirs.  Spark counts these strings over all
training texts; a language keeps its most frequent ones (MODEL_GRAMS for all
languages together, the bound of what is collected and shipped).  As the cost of
a byte depends on its (ORDER + 1)-byte string alone, a task works out each
distinct string once and adds up.

Defined results: a text that is null or has no letter, and every text if nothing
could be learned, is ``und`` with score 0; repeated rows count each; a document
without doc_id is neither held out nor learned from; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value

ORDER = 4
MODEL_GRAMS = 1 << 20          # strings that the models of all languages hold
TASK_GRAMS = 1 << 21           # distinct strings a task holds before it sends them on
SLICE_BYTES = 2 << 20
UNKNOWN = "und"

_BYTE = np.uint64(8)


def _mask(n_bytes: int) -> np.uint64:
    return np.uint64((1 << 8 * n_bytes) - 1)


def _grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, string) of each byte of a slice of texts, in pieces of at most SLICE_BYTES."""
    size = np.diff(offsets)
    padded = np.zeros(len(data) + ORDER * len(size), np.uint8)
    place = W.ragged(offsets[:-1] + ORDER * np.arange(1, len(size) + 1), size)
    padded[place] = data
    row = np.repeat(np.arange(len(size)), size)
    for lo in range(0, len(place), SLICE_BYTES):
        at = place[lo:lo + SLICE_BYTES]
        gram = np.zeros(len(at), np.uint64)
        for back in range(ORDER, -1, -1):
            gram = (gram << _BYTE) | padded[at - back]
        yield row[lo:lo + SLICE_BYTES], gram


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return keys, np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each (ORDER + 1)-byte string stands in the texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        parts: list = []

        def sent():
            keys, n = _merged(parts)
            lang = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(8 * ORDER + 8)).astype(np.int32)),
                                                  pa.array(list(names), pa.string()))
            gram = (keys & _mask(ORDER + 1)).astype(np.int64)
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(gram), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            for part, data, offsets in W.text_slices(batch, slice_bytes=SLICE_BYTES):
                lang = np.array([names.setdefault(x, len(names)) for x in part.column(1).to_pylist()], np.uint64)
                for row, gram in _grams(data, offsets):
                    parts.append(np.unique((lang[row] << np.uint64(8 * ORDER + 8)) | gram, return_counts=True))
                if sum(len(p[0]) for p in parts) > TASK_GRAMS:
                    parts = [_merged(parts)]
                    if len(parts[0][0]) > TASK_GRAMS // 2:
                        yield sent()
                        parts = []
        if parts:
            yield sent()

    return (docs.select("text", "lang").mapInArrow(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


class ByteModel:
    """Context trees of one language, as sorted tables for each order."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        order = np.argsort(grams)
        gram, n = grams[order].astype(np.uint64), counts[order].astype(np.float64)
        self.gram, self.count, self.context, self.total, self.distinct, self.excluded = {}, {}, {}, {}, {}, {}
        for k in range(ORDER, -1, -1):
            own, inverse = np.unique(gram & _mask(k + 1), return_inverse=True)
            self.gram[k], self.count[k] = own, np.bincount(inverse, weights=n)
            self.context[k], inverse, self.distinct[k] = np.unique(own >> _BYTE, return_inverse=True, return_counts=True)
            self.total[k] = np.bincount(inverse, weights=self.count[k])
        for k in range(1, ORDER + 1):
            # what the followers of a context count in the next shorter one
            inverse = np.searchsorted(self.context[k], self.gram[k] >> _BYTE)
            shorter = np.searchsorted(self.gram[k - 1], self.gram[k] & _mask(k))
            self.excluded[k] = np.bincount(inverse, weights=self.count[k - 1][shorter])

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each string after the bytes before it."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))                   # strings whose last byte no context has given yet
        gone = np.zeros(len(grams))                    # occurrences excluded from the next context
        barred = np.zeros(len(grams))                  # and distinct bytes
        for k in range(ORDER, -1, -1):
            g = grams[left] & _mask(k + 1)
            at, known = _find(self.context[k], g >> _BYTE)
            here, g, at = left[known], g[known], at[known]
            fresh = self.distinct[k][at] - barred[here]
            whole = self.total[k][at] - gone[here] + fresh
            cell, seen = _find(self.gram[k], g)
            out[here[seen]] += np.log2(whole[seen] / self.count[k][cell[seen]])
            away = ~seen & (fresh > 0)
            out[here[away]] += np.log2(whole[away] / fresh[away])
            barred[here] = self.distinct[k][at]
            gone[here] = self.excluded[k][at] if k else 0
            done = np.zeros(len(grams), dtype=bool)
            done[here[seen]] = True
            left = left[~done[left]]
        out[left] += np.log2(256 - barred[left])
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class _Scorer:
    """Code lengths of texts under all languages; costs of strings seen before are kept, up to a bound."""

    def __init__(self, models: list[ByteModel]):
        self.models = models
        self._forget()

    def _forget(self):
        self.known, self.cost = np.zeros(0, np.uint64), np.zeros((len(self.models), 0))

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        if len(self.known) > TASK_GRAMS // 4:
            self._forget()
        at, old = _find(self.known, grams) if len(self.known) else (None, np.zeros(len(grams), dtype=bool))
        new = grams[~old]
        if len(new):
            cost = np.array([m.bits(new) for m in self.models])
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.cost = known[order], np.concatenate([self.cost, cost], axis=1)[:, order]
            at, _ = _find(self.known, grams)
        return self.cost[:, at]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text (column) under each language (row)."""
        out = np.zeros((len(self.models), len(offsets) - 1))
        for row, gram in _grams(data, offsets):
            grams, inverse = np.unique(gram, return_inverse=True)
            for total, cost in zip(out, self._costs(grams)):
                total += np.bincount(row, weights=cost[inverse], minlength=len(total))
        return out


def _held_out() -> Column:
    """Documents that nothing is learned from: a third, by the CRC of doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, model_grams: int = MODEL_GRAMS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(lang, strings, counts) of each language, names ascending; ``docs`` has text and lang."""
    ship_by_value()
    counts = gram_counts(docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()))
    counts = counts.withColumn("size", F.floor(8 * F.log2("n")).cast("int")).persist()
    # how many strings there are of each size of count: at most a few hundred rows a language
    sizes = counts.groupBy("lang", "size").count().collect()
    langs = sorted({r.lang for r in sizes})
    least = {}
    for lang in langs:
        held, least[lang] = 0, 1 << 30
        for r in sorted((r for r in sizes if r.lang == lang), key=lambda r: -r.size):
            held += r["count"]
            if held > model_grams // len(langs):
                break
            least[lang] = r.size
    if not langs:
        return []
    keep = F.lit(False)
    for lang in langs:
        keep = keep | ((F.col("lang") == lang) & (F.col("size") >= least[lang]))
    table = counts.where(keep).select("lang", "gram", "n").toArrow()
    counts.unpersist()
    lang, gram, n = table.column(0), table.column(1).to_numpy(), table.column(2).to_numpy()
    own = {x: pc.equal(lang, x).to_numpy() for x in langs}
    return [(x, gram[own[x]], n[own[x]]) for x in langs if own[x].any()]


def predict(docs: DataFrame, learned: list[tuple[str, np.ndarray, np.ndarray]]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_byte; only the text decides."""
    ship_by_value()
    names = [x[0] for x in learned]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer([ByteModel(g, n) for _, g, n in learned])
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, slice_bytes=SLICE_BYTES):
                known = pc.fill_null(pc.match_substring_regex(part.column(2), r"\p{L}"), False).to_numpy(zero_copy_only=False)
                known &= bool(names)
                lang, score, per_byte = [UNKNOWN] * len(part), np.zeros(len(part)), [None] * len(part)
                if names:
                    bits = scorer.lengths(data, offsets)
                    best = bits.argmin(axis=0)
                    shortest = bits.min(axis=0)
                    score = np.where(known, 1 / np.exp2(np.maximum(shortest - bits, -1000)).sum(axis=0), 0.0)
                    for t in np.flatnonzero(known):
                        lang[t] = names[best[t]]
                        per_byte[t] = float(shortest[t] / (offsets[t + 1] - offsets[t]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(lang, pa.string()), pa.array(score),
                     pa.array(per_byte, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, model_grams: int = MODEL_GRAMS) -> DataFrame:
    """The language of every text, learned from the two thirds of the documents that are not held out."""
    return predict(docs, learn(docs.where(F.col("doc_id").isNotNull() & ~_held_out()), model_grams))
