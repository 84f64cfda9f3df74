"""Periodic runs, ranked search and language identification against brute force, and hashes of structured words."""
import collections
import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.llm import op3_tokens, op7_rules, op9_jaccard, op11_runs, op12_search, op13_language
from tracewise.llm import words as W
from tracewise.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


# -- periodic runs ------------------------------------------------------------------------------

def brute_runs(x):
    n, found = len(x), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and x[j] == x[j + p]:
                j += 1
            if j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def periodic(rnd, m, letters, depth):
    if depth == 0 or m < 3:
        return [rnd.randrange(letters) for _ in range(m)]
    q = rnd.randrange(1, max(2, m // 2))
    unit = periodic(rnd, q, letters, depth - 1)
    return [unit[i % q] for i in range(m)]


def test_all_runs_of_nested_periods_are_found():
    rnd, n_runs = random.Random(7), 0
    for _ in range(60):
        texts = []
        for _ in range(8):
            n, letters = rnd.choice([0, 5, 30, 100, 400, 900]), rnd.choice([1, 2, 3, 5, 50])
            x = [rnd.randrange(letters) for _ in range(n)]
            if n > 10:
                a = rnd.randrange(n)
                m = rnd.randrange(1, n - a + 1)
                x[a:a + m] = periodic(rnd, m, letters, rnd.choice([1, 2, 3]))
                if rnd.random() < .5:
                    unit = x[:rnd.randrange(1, max(2, n // 3))]
                    x = [unit[i % len(unit)] for i in range(n)]
                    x[rnd.randrange(n)] = 99
            texts.append(x)
        first = np.cumsum([0] + [len(x) for x in texts])
        got = op11_runs.runs_of(np.array([v for x in texts for v in x], np.int64), first)
        for t, x in enumerate(texts):
            want = brute_runs(x)
            n_runs += len(want)
            assert [r[1:] for r in got if r[0] == t] == want
    assert n_runs > 300


def test_periodic_runs(docs, texts):
    n_runs = 0
    for r in op11_runs.periodic_runs(docs, planted=True, with_text=True).collect():
        w = re.findall(WORD, texts[r.doc_id])
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            a, g, own = h // 10 % n, h // 10, list(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs = brute_runs(w)
        n_runs += len(runs)
        gone = {i for s, m, p in runs for i in range(s + p, s + m)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_runs, r.collapsed, r.collapsed_sha256) == (len(runs), text, hashlib.sha256(text.encode()).hexdigest())
        assert r.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest()
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None, None, None))
        assert (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
    assert n_runs > 5


def test_runs_of_edge_rows(spark, edge_docs, no_docs):
    unit = " ".join(f"u{i}" for i in range(4000))
    more = spark.createDataFrame([(100, " ".join([unit] * 3)), (101, "a " * 23), (102, "a " * 24), (103, unit + " " + unit)],
                                 "doc_id long, text string")
    plain = edge_docs.select("doc_id", "text")
    got = {r.doc_id: r for r in op11_runs.periodic_runs(plain.unionByName(more)).collect()}
    assert [got[i].n_runs for i in (0, 1, 2, 100, 101, 102, 103, None)] == [0, 0, 0, 1, 0, 1, 0, 0]
    assert got[0].collapsed_sha256 == got[1].collapsed_sha256 == got[1].runs_sha256 == EMPTY and got[1].start is None
    assert (got[100].start, got[100].length, got[100].period, got[100].exponent_milli) == (0, 12000, 4000, 3000)
    assert got[100].collapsed_sha256 == hashlib.sha256(unit.encode()).hexdigest()
    assert got[8].period == 997 and got[8].length == 30_000 and got[10].length == 30_000
    assert op11_runs.periodic_runs(edge_docs, planted=True).count() == edge_docs.count()
    assert op11_runs.periodic_runs(no_docs).count() == 0


def test_word_ids_of_colliding_hashes():
    data, offsets = np.frombuffer(b"aa bb aa cc", np.uint8), np.array([0, 11])
    w = W.words_of(data, offsets)
    w.hash = np.array([7, 7, 7, 8], np.uint64)
    assert list(op11_runs.word_ids(data, w)) == [0, 1, 0, 2]


# -- ranked search ------------------------------------------------------------------------------

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms(text):
    return re.findall(TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_ranks(docs, items):
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                    for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:10])]
    return sorted(out, key=str)


def ranks(spark, docs, items):
    got = op12_search.ranked(docs, items).collect()
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in got), key=str)


def test_ranked_search(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute_ranks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert ranks(spark, docs, items) == want
    # small slices, blocks of documents and blocks of items give the same
    for name, n in (("SLICE_BYTES", 5000), ("MATRIX_BYTES", 1 << 14), ("QUERY_BYTES", 2000), ("SPARSE", 2)):
        monkeypatch.setattr(op12_search, name, n)
    assert ranks(spark, docs.repartition(5), items) == want


def test_ranked_search_of_edge_rows(spark, edge_docs, no_docs):
    rows = [(1, "One two, THREE three"), (1, "One two, THREE three"), (2, None), (3, ""), (4, ",.;"), (5, "zzz nowhere"), (None, "ten É x"),
            (6, "word1 word2 tail " * 50)]
    items = spark.createDataFrame([(*r, "k") for r in rows], "item_id long, text string, doc_id string")
    want = brute_ranks([(r.doc_id, r.text) for r in edge_docs.collect()], rows)
    assert want and ranks(spark, edge_docs, items) == want
    assert ranks(spark, no_docs, items) == [] == ranks(spark, edge_docs, items.limit(0))


def test_bounds_are_never_under_the_scores(docs):
    part = docs.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]
    q = op12_search._queries([0], [" ".join(part.column(1).to_pylist()[3:9])])
    weights = np.arange(1, len(q.hash) + 1)
    for own, data, offsets in W.text_slices(part):
        s = op12_search._Slice(own, data, offsets, 200, 20_000)
        for rows in s.blocks(64):
            bound = (weights[q.terms[0]] * q.times[0]).astype(float) @ op12_search._Block(s, rows).bounds(q.hash)[q.terms[0]]
            assert (bound >= s.scores(q, 0, weights, rows)).all()


# -- language identification --------------------------------------------------------------------

def brute_bits(training, text):
    """Code length by walking the contexts of each byte, from counts of every order."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(op13_language.ORDER + 1)]
    pad = bytes(op13_language.ORDER)
    for t in training:
        b = pad + t.encode()
        for i in range(len(pad), len(b)):
            for k in range(len(counts)):
                counts[k][b[i - k:i]][b[i]] += 1
    bits, b = 0.0, pad + text.encode()
    for i in range(len(pad), len(b)):
        barred = set()
        for k in range(op13_language.ORDER, -1, -1):
            seen = counts[k].get(b[i - k:i])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in barred}
            whole = sum(left.values()) + len(left)
            if b[i] in left:
                bits += math.log2(whole / left[b[i]])
                break
            if left:
                bits += math.log2(whole / len(left))
            barred |= set(seen)
        else:
            bits += math.log2(256 - len(barred))
    return bits


def test_code_lengths(spark):
    training = ["the cat sat on the mat", "that hat", "é the"]
    learned = op13_language.learn(spark.createDataFrame([(t, "en") for t in training], "text string, lang string"))
    assert [x[0] for x in learned] == ["en"]
    model = op13_language.ByteModel(*learned[0][1:])
    for text in ("the hat", "xyzzy", "cat É", "that that", "t"):
        data = np.frombuffer(text.encode(), np.uint8)
        grams = np.concatenate([g for _, g in op13_language._grams(data, np.array([0, len(data)]))])
        assert abs(model.bits(grams).sum() - brute_bits(training, text)) < 1e-9
    for context in (0, 0x746865, 0x20746861, 0x7A7A7A7A):              # every context's code is complete
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs(np.exp2(-model.bits(every)).sum() - 1) < 1e-9


def test_language_of_held_out_texts(spark, docs):
    got = op13_language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 0.2 < len(held) / len(got) < 0.5
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    # the labels of held-out rows, source and doc_id decide nothing
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, "xx").otherwise(F.col("lang")))
    again = {r.doc_id: (r.lang_pred, r.score) for r in op13_language.identify(other.withColumn("source", F.lit("s"))).collect()}
    assert again == {r.doc_id: (r.lang_pred, r.score) for r in got}


def test_language_of_edge_rows(spark, edge_docs, no_docs):
    docs = edge_docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a")).withColumn("score", F.lit(1))
    rows = op13_language.identify(docs).collect()
    assert len(rows) == edge_docs.count()
    got = {r.doc_id: r for r in rows}
    assert [(got[i].lang_pred, got[i].score) for i in (0, 1)] == [("und", 0.0)] * 2 and got[None].lang_pred in "ab"
    assert not got[None].held_out
    digits = spark.createDataFrame([(1, "12 34", "a"), (2, None, "a"), (3, "x", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in op13_language.identify(digits).where("doc_id < 3").collect()} == {"und"}
    assert op13_language.identify(digits.where("lang is null")).first().lang_pred == "und"
    assert op13_language.identify(no_docs.withColumn("lang", F.lit("a"))).count() == 0


def test_language_models_keep_their_bound(docs):
    learned = op13_language.learn(docs, model_grams=4000)
    assert learned and sum(len(g) for _, g, _ in learned) <= 4000


# -- hashes of structured words -----------------------------------------------------------------

def test_structured_words_do_not_collide(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    pair = spark.createDataFrame([(1, one), (2, two), (3, f"{one} x y {two} x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in op9_jaccard.groups(pair).collect()} == {1: 1, 2: 2, 3: 3}
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.n_repeat_words for r in op7_rules.quality_rules(pair, labels).collect()] == [0, 0, 0]
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in op3_tokens.token_counts(pair, path).collect():
        text = {1: one, 2: two, 3: f"{one} x y {two} x y"}[r.doc_id]
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
