"""Quality rules: a decision list learned by sequential covering.

Text statistics are counted per document with numpy on Arrow batches.  From
labelled statistics the learner grows conjunctions of thresholds by
information gain on two thirds of the rows, prunes each on the other third,
drops what it covers and goes on; the list comes out as one ordered Spark
conditional expression, so applying it is plain DataFrame work.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged one by one; no labels (or one class) give an empty
list, which rejects nothing; documents may carry any other columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm import words as W
from tracewise.llm.common import extended, ship_by_value, store

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: Labelled rows (about) that the learner takes to the driver; of more, a share by id hash.
MAX_LABELLED = 50_000
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
         "n_digits", "n_marks"]

_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", dtype=np.uint8))
_MARK = np.isin(np.arange(256), np.frombuffer(b"!?.,;:", dtype=np.uint8))
_LETTER = np.arange(256) & 0xC0 != 0x80        # first byte of a character


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The STATS of each text of a slice (bytes and row offsets)."""
    rows = len(offsets) - 1
    w = W.words_of(data, offsets)
    solid = ~W.SPACE[data]
    out = {"n_words": np.diff(w.first),
           "word_chars": _per_row(solid & _LETTER[data], offsets),
           "n_symbols": _per_row(_SYMBOL[data], offsets),
           "n_upper": _per_row((data >= 65) & (data <= 90), offsets),
           "n_digits": _per_row((data >= 48) & (data <= 57), offsets),
           "n_marks": _per_row(_MARK[data], offsets)}
    # lines: from a row's first byte or the byte after a newline
    newline = data == 10
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(newline) + 1]))
    begin = begin[begin < len(data)]
    if len(begin):
        size = np.diff(np.append(begin, len(data)))
        value = W._EXACT[data]
        value[newline] = 0
        # the newline counts as nothing, so a last line without one equals the others
        h = W.run_hashes(value, begin, size, size - newline[begin + size - 1])
        row = np.searchsorted(offsets, begin, side="right") - 1
        worded = np.diff(np.searchsorted(w.start, np.append(begin, len(data)))) > 0
        row, h = row[worded], h[worded]
        _, first = np.unique(W.mix(h ^ W.mix(row.astype(np.uint64) + W._N_STEP[1])), return_index=True)
        out["n_lines"] = np.bincount(row, minlength=rows)
        out["n_dup_lines"] = out["n_lines"] - np.bincount(row[first], minlength=rows)
    else:
        out["n_lines"] = out["n_dup_lines"] = np.zeros(rows, np.int64)
    g, at = W.ngrams(w.hash, w.row, 3)
    again = np.zeros(len(w.hash), dtype=bool)
    if len(g):
        key = W.mix(g ^ W.mix(w.row[at].astype(np.uint64) + W._N_STEP[2]))
        _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = at[count[inverse] >= 2]
        for k in range(3):
            again[twice + k] = True
    out["n_repeat_words"] = np.bincount(w.row[again], minlength=rows)
    return out


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the STATS of its text column (each name after ``prefix``)."""
    ship_by_value()
    names = [prefix + s for s in STATS]
    schema = extended(docs, [(n, T.LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch, text):
                got = text_stats(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    list(part.columns) + [pa.array(got[s].astype(np.int64)) for s in STATS],
                    names=part.schema.names + names)

    return docs.mapInArrow(run, schema)


# ---- features: name -> SQL over the statistics ------------------------------
FEATURES = {
    "words": "double({p}n_words)",
    "chars_per_word": "{p}word_chars / greatest({p}n_words, 1)",
    "symbols_per_word": "{p}n_symbols / greatest({p}n_words, 1)",
    "dup_line_share": "{p}n_dup_lines / greatest({p}n_lines, 1)",
    "repeat_share": "{p}n_repeat_words / greatest({p}n_words, 1)",
    "upper_share": "{p}n_upper / greatest({p}word_chars, 1)",
    "digit_share": "{p}n_digits / greatest({p}word_chars, 1)",
    "marks_per_word": "{p}n_marks / greatest({p}n_words, 1)",
}


def feature(name: str, prefix: str = "") -> Column:
    return F.expr(FEATURES[name].format(p=prefix))


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (F.lit(100) * r > F.lit(MAX_REPEAT_PCT) * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        v = x[self.feature]
        return v >= self.value if self.at_least else v < self.value

    def column(self, prefix: str = "") -> Column:
        c = feature(self.feature, prefix)
        return c >= F.lit(self.value) if self.at_least else c < F.lit(self.value)


@dataclass
class DecisionList:
    """Ordered rules; a document that meets one is rejected, the rest are kept."""
    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        out = np.zeros(n, dtype=bool)
        for rule in self.rules:
            out |= np.logical_and.reduce([c.holds(x) for c in rule])
        return out

    def kept(self, prefix: str = "") -> Column:
        """The list as an ordered conditional expression."""
        out = None
        for rule in self.rules:
            test = rule[0].column(prefix)
            for c in rule[1:]:
                test = test & c.column(prefix)
            out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(
            f"{c.feature} {'>=' if c.at_least else '<'} {c.value:.6g}" for c in rule) for rule in self.rules)


def learn(x: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray, max_rules: int = 16,
          max_conditions: int = 4, min_precision: float = 0.95, min_cover: int = 3,
          n_cuts: int = 64) -> DecisionList:
    """Sequential covering: rules for ``bad`` rows, pruned on the ``prune`` rows.

    A rule joins the list only while it is right for ``min_precision`` of the
    rows it still covers, on the growing and on the pruning part alike.
    """
    left, out, barred = np.ones(len(bad), dtype=bool), DecisionList(), set()
    while len(out.rules) < max_rules and (bad & left & ~prune).sum() >= min_cover and len(barred) < len(x):
        grown = _grow({f: v for f, v in x.items() if f not in barred}, bad, left & ~prune, max_conditions, n_cuts)
        if not grown:
            break
        rule = _prune(grown, x, bad, left & prune)
        hit = np.logical_and.reduce([c.holds(x) for c in rule]) & left if rule else np.zeros(len(bad), dtype=bool)
        right = [(bad & hit & part).sum() / max(1, (hit & part).sum()) for part in (prune, ~prune)]
        if (hit & ~prune).sum() < min_cover or min(right) < min_precision:
            barred.add(grown[0].feature)       # no rule starts from it while these rows are left
            continue
        out.rules.append(rule)
        left &= ~hit
        barred = set()
    return out


def _grow(x, bad, rows, max_conditions, n_cuts) -> list[Condition]:
    """Add the condition of the best gain until no good row is covered."""
    rule: list[Condition] = []
    while len(rule) < max_conditions:
        p, n = (bad & rows).sum(), (~bad & rows).sum()
        if p == 0 or n == 0:
            break
        here, best, best_gain = np.log2(p / (p + n)), None, 1e-9
        for name, v in x.items():
            vals, y = v[rows], bad[rows]
            order = np.argsort(vals, kind="stable")
            vals, y = vals[order], y[order]
            below_p = np.concatenate([[0], np.cumsum(y)])
            cuts = np.unique(np.concatenate([np.quantile(vals, np.linspace(0, 1, n_cuts)),
                                             _class_edges(vals, y, n_cuts)]))
            at = np.searchsorted(vals, cuts, side="left")
            for at_least, pos, size in ((True, p - below_p[at], p + n - at), (False, below_p[at], at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / np.maximum(size, 1)) - here), -1)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    best, best_gain = Condition(name, at_least, float(cuts[k])), gain[k]
        if best is None:
            break
        rule.append(best)
        rows = rows & best.holds(x)
    return rule


def _class_edges(vals, y, n_cuts):
    """Middles between neighbours of unlike class, evenly thinned to 4 * n_cuts."""
    at = np.flatnonzero((y[1:] != y[:-1]) & (vals[1:] > vals[:-1]))
    if len(at) > 4 * n_cuts:
        at = at[np.linspace(0, len(at) - 1, 4 * n_cuts).astype(int)]
    return (vals[at] + vals[at + 1]) / 2


def _prune(rule, x, bad, rows) -> list[Condition]:
    """The leading conditions of the best worth (p - n) / (p + n) on the pruning rows."""
    best, best_worth, hit = [], -2.0, rows
    for k, c in enumerate(rule):
        hit = hit & c.holds(x)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth:
            best, best_worth = rule[:k + 1], worth
    return best


def fit(stats: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
        prefix: str = "", max_labelled: int = MAX_LABELLED, **how) -> DecisionList:
    """Learn from about ``max_labelled`` rows of ``stats`` with a label (0 is bad), all if there are fewer.

    Which rows are taken depends on a hash of the id, so it is the same in every run.
    """
    y = (labels.where(F.col(quality).isNotNull() & F.col(doc_id).isNotNull())
         .select(F.col(doc_id).alias("__y_id"), (F.col(quality) == 0).alias("__y_bad")))
    share = min(1.0, max_labelled / max(1, y.count()))
    y = y.where(F.pmod(F.xxhash64("__y_id", F.lit(1)), F.lit(1_000_000)) < F.lit(share * 1_000_000))
    rows = (stats.join(y, F.col(doc_id) == F.col("__y_id"))
            .select(F.xxhash64("__y_id").alias("h"), F.col("__y_id").alias("i"), F.col("__y_bad").alias("bad"),
                    *[feature(f, prefix).alias("f_" + f) for f in FEATURES])
            .toPandas().sort_values(["h", "i", "bad"], kind="stable"))
    if not len(rows):
        return DecisionList()
    x = {f: rows["f_" + f].to_numpy(dtype=float) for f in FEATURES}
    return learn(x, rows["bad"].to_numpy(dtype=bool), rows["h"].to_numpy() % 3 == 0, **how)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", prefix: str = "",
          **how) -> tuple[DataFrame, DecisionList]:
    """``docs`` with their statistics, ``base_failed`` and ``kept``; and the list learned."""
    stats = with_stats(docs, text, prefix)
    rules = fit(store(stats.drop(text), "rules"), labels, prefix=prefix, **how)
    judged = stats.withColumn(prefix + "base_failed", base_failed(prefix))
    return judged.withColumn(prefix + "kept",
                             ~F.col(prefix + "base_failed") & rules.kept(prefix)), rules


def quality_rules(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """One row per document: the base statistics, ``base_failed`` and ``kept``."""
    stats = store(with_stats(docs.select("doc_id", "text")).drop("text"), "stats")
    rules = fit(stats, labels, **how)
    return stats.withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & rules.kept()).alias("kept"))
