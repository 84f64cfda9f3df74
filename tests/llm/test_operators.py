"""Each operator against a brute-force form, and on edge rows and empty tables."""
import collections
import hashlib
import itertools
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewise.llm import (op1_resample, op2_repeats, op3_tokens, op4_licences, op5_private, op6_warc, op7_rules,
                           op8_pieces, op9_jaccard, op10_decontaminate)
from tracewise.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_repeats(spark, docs, texts, edge_docs, no_docs):
    seen = collections.Counter(t.encode()[k:k + 400] for t in texts.values() for k in range(len(t.encode()) - 399))
    for r in op2_repeats.remove_repeats(docs).collect():
        b = texts[r.doc_id].encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == \
            (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: r for r in op2_repeats.remove_repeats(edge_docs).collect() if r.doc_id != 3}
    assert got[8].n_removed == got[8].n_bytes and got[0].n_bytes == got[1].n_bytes == 0
    assert got[5].n_removed == 50_000                    # one letter repeats itself
    assert op2_repeats.remove_repeats(no_docs).count() == 0


def test_repeats_long_passages(spark):
    """Passages of over 50 words in two documents each: removed whole from 400 bytes on, left whole below."""
    rnd = random.Random(11)

    def words(n):
        return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 5))) for _ in range(n))

    rows, want = [], {}
    for size in (300, 394, 399, 400, 401, 520) * 3:
        passage = words(200)[:size]
        assert len(passage.split()) > 50
        for copy in "12":                                # the bytes beside the passage differ
            before, after = f"{words(60)} {copy}", f"{copy} {words(60)}"
            text = before + passage + after
            kept = before + after if size >= 400 else text
            want[len(rows)] = (len(text), len(text) - len(kept), int(size >= 400), hashlib.sha256(kept.encode()).hexdigest())
            rows.append((len(rows), text))
    for _ in range(20):
        text = words(180)
        want[len(rows)] = (len(text), 0, 0, hashlib.sha256(text.encode()).hexdigest())
        rows.append((len(rows), text))
    got = op2_repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want and len(got) == len(want)


def test_token_counts(docs, texts, edge_docs, no_docs):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for hot in (1_000_000, 50):                          # all counts in the tasks, and most by the join
        for r in op3_tokens.token_counts(docs, path, hot=hot).collect():
            n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    assert op3_tokens.token_counts(edge_docs, path).count() == edge_docs.count()
    assert op3_tokens.token_counts(no_docs, path).count() == 0


def test_licences(spark, edge_docs, no_docs):
    got = {r.doc_id: r for r in op4_licences.scan(edge_docs).collect()}
    assert got[7].license == "Apache-2.0" and got[7].line_licenses == "Apache-2.0" and got[0].license is None
    mit = next(t for n, t in op4_licences.NOTICES if t.startswith("MIT License"))
    spoilt = spark.createDataFrame([(1, "Copyright (c) 2020 A. Person\n" + mit.upper().replace(",", ";"))], "doc_id long, text string")
    assert op4_licences.scan(spoilt).first().license == "MIT"
    assert op4_licences.scan(no_docs).count() == 0


ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_whole_licences(spark):
    mit = next(t for n, t in op4_licences.NOTICES if t.startswith("MIT License"))
    cases = [("ISC", "ISC License\n\nCopyright (c) 2021, A. Person\n\n" + ISC), ("MIT", "(c) 2020 A. Person\n" + mit[len("MIT License"):])]
    cases += [("MIT", "\n".join(mark + line for line in ["Copyright (c) 2020 A. Person", "", *mit.split("\n")]))
              for mark in ("# ", "// ", " * ")]
    kept = "/usr/share/common-licenses/"
    for file, name in (("Apache-2.0", "Apache-2.0"), ("BSD", "BSD-3-Clause"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"),
                       ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")):
        if os.path.exists(kept + file):
            with open(kept + file, encoding="utf-8") as f:
                cases.append((name, f.read()))
    rows = [(i, t) for i, (_, t) in enumerate(cases)] + [(len(cases), ISC[:-9])]
    got = {r.doc_id: r.license for r in op4_licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(rows))] == [n for n, _ in cases] + [None]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def luhn(x):
        return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(x)))) % 10 == 0
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m[0].split(".")),
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                yield f"{kind}:{m.start()}:{m.end()}"


def test_private_data(spark, docs, texts, edge_docs, no_docs):
    odd = ["a@b.c@d.e x.@y.z.", "a@b.com_x@y.org", "1.2.3.4.5.6.7.8 999.1.1.1", "é +12 (345) 678-90 1.1.1.300", "1 2 " * 3000]
    odd = spark.createDataFrame(list(enumerate(odd, 1_000_000)), "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    plain = texts | {r.doc_id: r.text for r in odd.collect()}
    for r in op5_private.find(every).collect():
        want = list(base_spans(plain[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, r.spans.split(",")))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in BASE)
    masked = {r.doc_id: r.text for r in op5_private.mask(edge_docs).collect()}
    assert masked[6] == "mail <EMAIL> or <PHONE>, ip <IP>, card <CARD>" and masked[1] is None
    assert op5_private.find(no_docs).count() == 0


def test_warc(spark, tmpdir_path):
    body = "<p>\r\n\r\nWARC/1.1\r\n</p>" + "é" * 100
    pages = spark.createDataFrame([(3, "u 3\n", body), (1, "u1", body), (2, None, None), (4, "u4", "short"), (5, "u5", "short"),
                                   (1, "u1", body)], "page_id long, url string, html string")
    path = tmpdir_path + "/warc"
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in op6_warc.warc_round_trip(pages, path).collect())
    n = len(body.encode())
    assert got == [(1, n, "response", None), (1, n, "response", None), (2, 0, "response", None), (3, n, "revisit", 1),
                   (4, 5, "response", None), (5, 5, "response", None)]
    back = {r.page_id: r for r in op6_warc.read_archives(spark, path).collect()}
    assert bytes(back[1].block).decode() == body and back[3].url == "u 3\n" and back[3].block == b""
    assert op6_warc.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_copies_and_odd_rows(spark, tmpdir_path):
    """A large group of copies, null ids, all control characters in a url, a very long payload, other columns."""
    copy, null, long = "c" * 150, "n" * 150, "long \r\n\r\n " * 200_000
    url = "u" + "".join(map(chr, [*range(0x21), 0x25, 0x7F])) + "%41"
    rows = [(i, url, copy, "x") for i in range(5, 900)] + [(None, "u", copy, "x"), (None, "u", null, None), (None, "u", null, "y")]
    rows += [(1000, "u", long, "x"), (1001, "u", "single" * 40, "x"), (1002, "u", None, "x"), (None, "u", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(7)
    path = tmpdir_path + "/warc-odd"
    got = op6_warc.warc_round_trip(pages, path).collect()
    want = []
    for page, _, html, _ in rows:
        html = html or ""
        kind = ("revisit", 5) if html == copy and page != 5 else ("response", None)
        want.append((page, len(html), hashlib.sha256(html.encode()).hexdigest(), *kind))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    back = op6_warc.read_archives(spark, path).collect()
    assert {r.url for r in back if r.page_id and r.page_id < 900} == {url}
    assert sum(len(r.block) for r in back) == 150 * 3 + len(long) + 240
    every = {r.page_id: r.payload for r in op6_warc.resolved_records(pages).collect()}
    assert every[5] == copy and every[6] == "" and every[1000] == long


def test_quality_rules(spark, docs, texts, edge_docs, no_docs, labels):
    own = spark.read.parquet(f"{SF}/labels.parquet")
    for r in op7_rules.quality_rules(docs, own).collect():
        t = texts[r.doc_id]
        w = re.findall(WORD, t)
        windows = collections.Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(WORD, x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
            (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)
    assert op7_rules.quality_rules(edge_docs, labels).count() == edge_docs.count()
    assert op7_rules.quality_rules(no_docs, labels.limit(0)).count() == 0


def all_paths(unit, scores):
    """The best sum of scores over every segmentation of ``unit``."""
    best = [0.0] + [float("-inf")] * len(unit)
    for end in range(1, len(unit) + 1):
        for start in range(end):
            if unit[start:end] in scores:
                best[end] = max(best[end], best[start] + scores[unit[start:end]])
    return best[-1]


def test_best_path_of_a_unigram_model(monkeypatch):
    import random

    import sentencepiece
    rnd = random.Random(3)
    letters = "ab" + op8_pieces.MARK
    names = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 6))) for _ in range(60)} | set(letters))
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), *names]
    scores = {p: (-20.0 if p[:1] == "<" else -rnd.randrange(1, 40) / 4) for p in pieces}

    class Small:
        def __init__(self, model_file):
            self.id_to_piece, self.get_score = pieces.__getitem__, lambda i: scores[pieces[i]]
            self.is_byte, self.is_unknown = (lambda i: 0 < i <= 256), (lambda i: i == 0)
            self.is_control = self.is_unused = lambda i: False
            self.get_piece_size = lambda: len(pieces)

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Small)
    model = op8_pieces.PieceModel("none")
    for _ in range(400):
        text = "".join(rnd.choice("ab c") for _ in range(rnd.randrange(1, 14)))
        ids = model.encode(text)
        spelt = scores | {"c": scores["<0x63>"]}
        assert abs(sum(scores[pieces[i]] for i in ids) - all_paths((op8_pieces.MARK + text.replace(" ", op8_pieces.MARK)), spelt)) < 1e-9
        assert model.decode(ids) == text
        assert op8_pieces._Encoder(model)([text])[0].tolist() == ids       # by units, as tasks do


def test_pieces(docs, texts, edge_docs, no_docs):
    path = tokenizer_path("piece_bpe_32k.model")
    model = op8_pieces.PieceModel(path)
    for r in op8_pieces.encode(docs.select("doc_id", "text").limit(40), path).collect():
        assert r.ids == model.encode(texts[r.doc_id])    # the units' paths are the whole text's
        assert model.decode(r.ids) == texts[r.doc_id]
    both = op8_pieces.decode(op8_pieces.encode(edge_docs, path), path)
    assert both.where("not decoded <=> text").count() == 0
    one_pass = op8_pieces.encode(edge_docs, path, decoded="decoded").collect()
    assert sorted(one_pass, key=str) == sorted(both.collect(), key=str)
    assert op8_pieces.piece_report(no_docs, path).count() == 0


def test_jaccard(spark, docs, texts, edge_docs, no_docs):
    sets = {}
    for i, t in texts.items():
        w = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    for _ in range(6):
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                    least[i] = least[j] = min(least[i], least[j])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op9_jaccard.groups(docs).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    edge = {r.doc_id: r.component_id for r in op9_jaccard.groups(edge_docs).collect()}
    assert edge[8] == edge[9] == edge[10] == 8 and edge[0] == 0 and edge[None] is None
    assert op9_jaccard.groups(no_docs).count() == 0


def test_jaccard_block_of_several_sizes(spark):
    """Sets of 105 and 106 shingles, J = 97/114, share 7 leading ones; the block of the latter spans sizes 104 to 107."""
    def group(k):
        def new(kind, n):
            return [f"{kind}{k}x{i}" for i in range(n)]
        p, q, s, a, b, d = (new(kind, n) for kind, n in zip("pqsabd", (100, 90, 94, 8, 9, 10)))
        return [p + a, p + b, p + d, p[-3:] + a + q, p[-3:] + d + s] + [p + new("f", 300)] * 4 + [q] * 4 + [s] * 4
    names = (39, 67, 87, 98, 116, 123, 162, 245, 288, 297, 319, 348)      # hashes that deal the pair to two blocks
    rows = [(100 * k + i, " ".join(t)) for k in names for i, t in enumerate(group(k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in op9_jaccard.groups(docs).collect()}
    assert [k for k in names if got[100 * k] != got[100 * k + 1]] == []


def test_jaccard_bound(spark):
    def least(a, b, s):
        return max(1, -(-s * (a + b) // (100 + s)) - max(-(-s * a // 100), -(-s * b // 100)) + 1)
    rows = [(a, lo, lo + w) for a in (1, 5, 20, 105, 106, 397, 1000) for lo in range(max(1, a * 3 // 4), a * 4 // 3)
            for w in (0, 1, 3, 17)]
    ranges = spark.createDataFrame(rows, "size long, lo long, hi long")
    for s in (80, 85):
        bound = op9_jaccard._least_met_in(*(F.col(c) for c in ("size", "lo", "hi")), s)
        for r in ranges.select("*", bound.alias("bound")).collect():
            sizes = [b for b in range(r.lo, r.hi + 1) if 100 * min(r.size, b) >= s * max(r.size, b)]
            exact = min((least(r.size, b, s) for b in sizes), default=r.bound)
            assert max(1, exact - 1) <= r.bound <= exact


def test_decontamination(spark, edge_docs, no_docs):
    item = [f"w{i}" for i in range(30)]
    spoilt = [("x" if i % 6 == 5 else w) for i, w in enumerate(item)]
    rows = [(1, "before it " + " ".join(item) + " and after"), (2, " ".join(spoilt)), (3, " ".join(item[::2])),
            (4, " ".join(item[:9])), (5, None), (6, " ".join(item[:16]).upper())]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    found = op10_decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in found.collect()}
    assert got == {(1, 7): (30, 30), (2, 7): (30, 25), (6, 7): (16, 16)}
    assert op10_decontaminate.clean(edge_docs, bench).columns == edge_docs.columns
    assert op10_decontaminate.overlaps(no_docs, bench).count() == 0


def test_clean_judges_rows(spark):
    """Of two rows without doc_id, and of two texts of one doc_id, only the leaked one goes."""
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(None, "see " + item), (None, "clean text"), (4, item), (4, "other text"), (5, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    kept = [tuple(r) for r in op10_decontaminate.clean(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([rows[1], rows[3], rows[4], rows[5]], key=str)


def test_decontamination_short_items(spark):
    """Items of 1 to 15 words are found with every pattern of as many substitutions as 80 percent allow, not with more."""
    bench, rows, want = [], [], set()
    for n in range(1, 16):
        words, most = [f"i{n}w{k}" for k in range(n)], n // 5
        bench.append((n, " ".join(words)))
        for count in range(most + 2):
            for gone in list(itertools.combinations(range(n), count))[:600 if count <= most else 20]:
                text = ["x" if k in gone else w for k, w in enumerate(words)]
                rows.append((len(rows), " ".join(["before", *text, "after it"])))
                want |= {(len(rows) - 1, n, n, n - count)} if count <= most else set()
    bench = spark.createDataFrame(bench, "item_id long, text string")
    found = op10_decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {tuple(r) for r in found.collect()} ^ want == set()


def _plain_overlaps(words, item):
    """Best (covered, equal) of two word lists over all diagonals, every window of 16 words compared."""
    best = None
    a, b = np.array(words, dtype=object), np.array(item, dtype=object)
    for d in range(16 - len(b), len(a) - 15):
        lo, hi = max(0, -d), min(len(b), len(a) - d)
        same = a[lo + d:hi + d] == b[lo:hi]
        cover = np.zeros(len(same), dtype=bool)
        for k in np.flatnonzero(np.convolve(same.astype(int), np.ones(16, dtype=int), "valid") >= 13):
            cover[k:k + 16] = True
        if cover.any():
            got = int(cover.sum()), int((cover & same).sum())
            best = got if best is None else max(best, got)
    return best


def test_decontamination_brute_force(spark):
    """Items of 16 to 40 words, small vocabularies and substitutions: every pair and figure of the plain count."""
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(60)]
    items = {n: [rnd.choice(vocab) for _ in range(n)] for n in range(16, 41, 4)}
    items[100], items[101] = ["la"] * 20, ["la", "li"] * 12
    rows = {}
    for i in range(90):
        text = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        item = items[rnd.choice(list(items))]
        cut = item[rnd.randrange(0, 6):][:rnd.randrange(10, 41)]
        at = rnd.randrange(0, len(text) + 1)
        rows[i] = text[:at] + [w if rnd.random() > 0.15 else rnd.choice(vocab) for w in cut] + text[at:]
    rows[90], rows[91] = ["la"] * 50, ["li"] * 15
    found = op10_decontaminate.overlaps(
        spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string"),
        spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.n_words, r.n_equal) for r in found.collect()}
    want = {(i, j): o for i, a in rows.items() for j, b in items.items() if (o := _plain_overlaps(a, b))}
    assert len(want) > 40 and got == want


def test_decontamination_of_one_repeated_word():
    """20,000 equal words against an item of 300: each diagonal once, no row for each pair of hit and seed."""
    words, item = np.full(20000, 7), np.full(300, 7)
    hits = np.full(19995, 3), np.arange(19995)
    start = time.monotonic()
    assert op10_decontaminate.best_overlap(words, item, *hits, [(3, q, 6) for q in range(295)], 16, 0.8) == (300, 300)
    assert time.monotonic() - start < 30


def test_resampling(spark, docs, labels, edge_docs, no_docs):
    own = spark.read.parquet(f"{SF}/labels.parquet")
    got = op1_resample.resample(docs, own, k=50).collect()
    top = sorted(got, key=lambda r: (-r.gumbel_key, r.doc_id))[:50]
    assert {r.doc_id for r in got if r.kept} == {r.doc_id for r in top}
    keyed = spark.createDataFrame([(i, float(i % 7)) for i in range(500)], "doc_id long, gumbel_key double")
    want = sorted(keyed.collect(), key=lambda r: (-r.gumbel_key, r.doc_id))[99]
    assert op1_resample.top_k_cut(keyed, 100, small=5) == (want.gumbel_key, want.doc_id)
    assert op1_resample.resample(edge_docs, labels).count() == edge_docs.count()
    assert op1_resample.resample(no_docs, labels.limit(0)).count() == 0
