"""PII by weak supervision: labelers vote, EM weighs them, a span classifier decides.

1. Candidates: the four base patterns, and undecided ones: phones without "+",
   spelt-out mail addresses, and strings that may be secrets (keys, tokens).  A
   text is split at the matches of a pattern; the pieces' lengths give the
   offsets, in code points.
2. Labelers vote for (1), against (-1) or not at all (0) on each candidate:
   checks of the match itself (digit counts, hexadecimal or mixed characters), a
   gazetteer (domain endings, prefixes of keys), cue words before it, and what
   it touches.
3. Expectation-maximisation over the counts of the undecided candidates' vote
   patterns (a few hundred rows at most, whatever the input) estimates each
   labeler's reliability and gives every pattern a probability.  Base matches
   take no part: a rule has decided on them.
4. With those as soft labels a naive Bayes span classifier over shape and
   context features is fitted by one aggregation; its log-odds are a Spark
   expression that decides which undecided candidates become spans.

Base spans always stay; an added span never overlaps a base span.
Everything on the rows is DataFrame functions; only the small tables of counts
come to the driver.

What look-alikes (digests, order numbers) are is learned from the texts: on a
handful of candidates there is nothing to learn from, and some are accepted.

Defined results: a null or empty text has no spans; repeated rows are scanned
one by one; other columns are dropped (``find``) or kept (``mask``).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewise.llm.common import store

KINDS = ["email", "ip", "card", "phone"]
#: Secrets have no base pattern: labelers and classifier decide on all of them.
ALL_KINDS = [*KINDS, "secret"]
CONTEXT = 40                   # code points on either side that labelers see
ACCEPT = 0.95                  # probability from which a looser candidate is a span
EM_ROUNDS = 50
TRUST = 4.0                    # pseudo-count of a labeler's right votes; its wrong ones and abstentions have 1

# ---- fixed values: patterns (possessive where nothing that follows could need a
# shorter match, so long runs stay linear and off the stack) ------------------
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}+"
             r"(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{2,63}+){1,8}",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "secret": r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}+"
              r"(?![A-Za-z0-9@=]|\.[A-Za-z0-9])",
}
HAS = {"email": r"@|[\[(]at[\])]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]", "secret": "[0-9]"}
ENDINGS = "com org net edu gov io info biz de fr es it uk eu us ca ch at nl be pl ru cn jp br in au mx se no fi dk"
CUES = {
    "email": r"(?i)e-?mail|contact|write|mail",
    "ip": r"(?i)\bip\b|server|host|address|login|client",
    "card": r"(?i)card|visa|master|amex|credit|payment|iban",
    "phone": r"(?i)tel|phone|call|fax|mobile|cell|contact",
    "secret": r"(?i)token|secret|passw|pwd|api.?key|access.?key|private.?key|bearer|credential|authorization",
}
DENIALS = r"(?i)(?:version|isbn|issn|order|token|hash|sha|serial|page|release|build|sku|invoice)\W{0,6}$"
NO_SECRETS = r"(?i)(?:sha-?[0-9]*|hash|commit|digest|checksum|md5|etag|revision|blob|integrity|uuid|serial|build|order)\W{0,6}$"
PREFIXES = r"^(?:AKIA|ASIA|AIza|eyJ|gh[pousr]_|github_pat_|glpat-|sk[-_]|xox[abeprs]-|npm_|pypi-|hf_)"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
HEX = r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"
# -----------------------------------------------------------------------------


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c: c.try_cast("int"))
    worth = F.transform(at, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(worth, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    """The base checks of a match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    octet = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return (F.when(kind == "email", F.lit(True))
            .when(kind == "ip", match.rlike(rf"^{octet}\.{octet}\.{octet}\.(?:{octet})$"))
            .when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(F.lit(False)))
            .when(kind == "secret", F.lit(True))
            .otherwise(n.between(8, 15)))


def candidates(docs: DataFrame, row: str, text: str) -> DataFrame:
    """All matches: row, kind, base, s, e (code points), match, left, right."""
    t = F.coalesce(F.col(text), F.lit(""))
    found, at = [], []
    for patterns, base in ((BASE, True), (LOOSE, False)):
        for kind, pattern in patterns.items():
            name = f"{kind}_{int(base)}"
            asked = t.rlike(HAS[kind])
            found += [F.when(asked, F.split(t, pattern, -1)).alias("p_" + name),
                      F.when(asked, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).alias("m_" + name)]
            ends = F.transform(F.col("p_" + name), lambda p: F.struct(
                F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("left"), F.left(p, F.lit(CONTEXT)).alias("right")))
            at.append(F.when(F.size("m_" + name) > 0, F.struct(
                F.lit(kind).alias("kind"), F.lit(base).alias("base"),
                F.arrays_zip(ends.alias("piece"), F.col("m_" + name).alias("match")).alias("parts"))))
    cut = docs.where(t.rlike("[0-9]|@|[\\[(]at[\\])]")).select(F.col(row).alias("row"), *found)
    part = (cut.select("row", F.explode(F.array_compact(F.array(*at))).alias("k"))
            .select("row", "k.kind", "k.base", F.posexplode("k.parts").alias("i", "part"))
            .select("row", "kind", "base", "i", F.col("part")["piece"].alias("piece"), F.col("part")["match"].alias("match")))
    w = Window.partitionBy("row", "kind", "base").orderBy("i")
    end = F.sum(F.col("piece.gap") + F.coalesce(F.length("match"), F.lit(0))).over(w)
    return (part.select("row", "kind", "base", "match", F.col("piece.left").alias("left"),
                        F.lead("piece.right").over(w).alias("right"), end.cast("long").alias("e"))
            .where("match is not null")
            .withColumn("s", F.col("e") - F.length("match"))
            .withColumn("valid", _valid(F.col("kind"), F.col("match")))
            # a base match that fails its check is dropped, unless a looser pattern finds more in it
            .where("valid"))


def _cue() -> Column:
    """What stands before a candidate: cue (a word that names its kind), denial (one that names another thing), none."""
    kind, left = F.col("kind"), F.col("left")
    denied = F.when(kind == "secret", left.rlike(NO_SECRETS)).otherwise(left.rlike(DENIALS))
    return reduce(lambda c, k: c.when((kind == k) & left.rlike(CUES[k]), "cue"), ALL_KINDS,
                  F.when(denied, "denial")).otherwise("none")


def _shape() -> Column:
    """Of a secret: hex, word (runs of small letters), mixed (three classes of characters), other; else empty."""
    m = F.col("match")
    return (F.when(F.col("kind") != "secret", "").when(m.rlike(HEX), "hex").when(m.rlike("[a-z]{6}"), "word")
            .when(m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]"), "mixed").otherwise("other"))


def votes(found: DataFrame) -> DataFrame:
    """Candidates with the labelers' votes v_check, v_gazetteer, v_context, v_edges."""
    kind, m, left, right, shape = F.col("kind"), F.col("match"), F.col("left"), F.col("right"), _shape()
    digits = F.regexp_replace(m, "[^0-9]", "")
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z]+)$", 1))
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    check = (F.when(kind == "email", F.when(F.regexp_extract(m, r"([A-Za-z]{2,})$", 1) != "", yes).otherwise(no))
             .when(kind == "phone", F.when(digits.rlike("^[2-9][0-9]{2}[2-9]"), yes).otherwise(no))
             .when(kind == "secret", F.when((F.length(m) > 256) | (shape == "word"), no)
                   .when(shape.isin("hex", "mixed"), yes).otherwise(none)).otherwise(none))
    gazetteer = (F.when(kind == "email", F.when(ending.isin(*ENDINGS.split()), yes).otherwise(none))
                 .when(kind == "secret", F.when(m.rlike(PREFIXES), yes).when(m.rlike(UUID), no).otherwise(none))
                 .otherwise(none))
    cue = F.when(_cue() == "cue", yes).when(_cue() == "denial", no).otherwise(none)
    edges = (F.when(kind == "secret", F.when(left.rlike(r"(?i)https?:\S*$"), no)
                    .when(left.rlike(r"[=:]\s*[\"'`]?$") | left.rlike(r"(?i)bearer\s+$"), yes).otherwise(none))
             .when(left.rlike(r"[A-Za-z0-9_=/#\"-]$") | right.rlike(r"^[A-Za-z0-9_=/\"]"), no).otherwise(yes))
    return found.withColumns({"v_check": check, "v_gazetteer": gazetteer, "v_context": cue, "v_edges": edges})


LABELERS = ["v_check", "v_gazetteer", "v_context", "v_edges"]


def em(counts: dict[tuple[int, ...], float], rounds: int = EM_ROUNDS) -> tuple[float, list[dict[int, list[float]]], dict]:
    """Two-class EM over vote patterns: (prior, per labeler P(vote | class), P(1 | pattern)).

    Starts from the share of votes for; every estimate is smoothed, so empty
    classes and labelers that never vote leave the sums finite.
    """
    k = len(next(iter(counts))) if counts else 0
    belief = {p: (1 + sum(v > 0 for v in p)) / (2 + sum(v != 0 for v in p)) for p in counts}
    prior, rates = 0.5, []
    for _ in range(rounds):
        mass = [sum(n * (belief[p] if c else 1 - belief[p]) for p, n in counts.items()) for c in (0, 1)]
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        rates = []
        for j in range(k):
            rates.append({v: [(sum(n * (belief[p] if c else 1 - belief[p]) for p, n in counts.items() if p[j] == v)
                               + (TRUST if (v > 0) == bool(c) and v else 1.0)) / (mass[c] + TRUST + 2) for c in (0, 1)]
                          for v in (-1, 0, 1)})
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rates[j][v][1] / rates[j][v][0]) for j, v in enumerate(p))
            belief[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return prior, rates, belief


def _features() -> dict[str, Column]:
    """Categorical features of a candidate, each of a few dozen values at most."""
    m, left, right = F.col("match"), F.col("left"), F.col("right")
    n_digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    sort = lambda c: (F.when(c == "", "end").when(c.rlike("^[A-Za-z]"), "letter").when(c.rlike("^[0-9]"), "digit")
                      .when(c.rlike(r"^\s"), "space").otherwise("mark"))
    return {
        "f_length": F.least(F.floor(F.length(m) / 4), F.lit(16)).cast("string"),
        "f_digits": F.least(n_digits, F.lit(20)).cast("string"),
        "f_before": sort(F.right(left, F.lit(1))), "f_after": sort(F.left(right, F.lit(1))),
        "f_cue": _cue(),
        "f_parts": F.least(F.size(F.split(m, r"[\x20().-]+")), F.lit(8)).cast("string"),
        "f_shape": _shape(),
    }


FEATURES = ["f_length", "f_digits", "f_before", "f_after", "f_cue", "f_parts", "f_shape"]


class SpanClassifier:
    """Naive Bayes per kind over FEATURES: P(personal data) of a candidate as a Spark expression.

    A candidate whose votes EM holds for less than even (``belief``) does not rise
    above that: on a handful of candidates the features alone tell little.
    """

    def __init__(self, prior: dict[str, list[float]], seen: dict[tuple[str, str, str], list[float]],
                 belief: dict[tuple, float]):
        self.prior, self.seen, self.belief = prior, seen, belief

    def voted(self) -> Column:
        """EM's probability of a candidate's votes; 0.5 for a pattern that was not seen."""
        if not self.belief:
            return F.lit(0.5)
        table = F.create_map(*[F.lit(x) for p, b in sorted(self.belief.items()) for x in ("|".join(map(str, p)), b)])
        return F.coalesce(table[F.concat_ws("|", "kind", *LABELERS)], F.lit(0.5))

    def probability(self) -> Column:
        odds = []
        start = F.lit(0.0)
        for kind, (no, yes) in sorted(self.prior.items()):
            start = F.when(F.col("kind") == kind, F.lit(math.log((yes + 1) / (no + 1)))).otherwise(start)
        odds.append(start)
        for f in FEATURES:
            table = {}
            for (kind, name, value), (no, yes) in sorted(self.seen.items()):
                if name == f:
                    n, y = self.prior[kind]
                    table[f"{kind}:{value}"] = math.log((yes + 1) / (y + 20)) - math.log((no + 1) / (n + 20))
            if table:
                known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
                odds.append(F.coalesce(known[F.concat(F.col("kind"), F.lit(":"), F.col(f))], F.lit(0.0)))
        total = reduce(lambda a, b: a + b, odds)
        own = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
        return F.when(self.voted() < 0.5, F.least(own, self.voted())).otherwise(own)


def fit(voted: DataFrame, rounds: int = EM_ROUNDS) -> tuple[SpanClassifier, dict]:
    """The span classifier trained on the EM beliefs of the undecided candidates, and the reliabilities by kind."""
    voted = voted.where("not base")
    patterns = voted.groupBy("kind", *LABELERS).count().collect()      # at most 3 * 3^4 rows
    belief, reliability = {}, {}
    for kind in sorted({r["kind"] for r in patterns}):
        counts = {tuple(r[v] for v in LABELERS): float(r["count"]) for r in patterns if r["kind"] == kind}
        prior, rates, own = em(counts, rounds)
        reliability[kind] = {"prior": prior, **dict(zip(LABELERS, rates))}
        belief.update({(kind, *p): b for p, b in own.items()})
    tall = voted.withColumn("p", SpanClassifier({}, {}, belief).voted()).select("kind", "p", F.explode(F.array(
        F.struct(F.lit("").alias("f"), F.lit("").alias("v")),
        *[F.struct(F.lit(f).alias("f"), F.col(f).alias("v")) for f in FEATURES])).alias("x"))
    sums = tall.groupBy("kind", "x.f", "x.v").agg(F.sum(1 - F.col("p")).alias("no"), F.sum("p").alias("yes")).collect()
    prior = {r["kind"]: [r["no"], r["yes"]] for r in sums if r["f"] == ""}
    return SpanClassifier(prior, {(r["kind"], r["f"], r["v"]): [r["no"], r["yes"]] for r in sums if r["f"]}, belief), reliability


def voted(docs: DataFrame, row: str = "row", text: str = "text") -> DataFrame:
    """All candidates with votes and features, stored: what ``fit`` learns from and ``spans`` decides on."""
    return store(votes(candidates(docs, row, text)).withColumns(_features()).drop("match", "left", "right"), "private")


def spans(docs: DataFrame, row: str = "row", text: str = "text", accept: float = ACCEPT,
          classifier: SpanClassifier | None = None) -> DataFrame:
    """The spans of all texts: row, kind, base, s, e.  ``row`` must name a row and no other.

    Without ``classifier`` one is fitted on the same texts.
    """
    found = voted(docs, row, text)
    classifier = classifier or fit(found)[0]
    scored = found.withColumn("probability", F.when(F.col("base"), F.lit(1.0)).otherwise(classifier.probability()))
    kept = scored.where(F.col("base") | (F.col("probability") >= accept)).select("row", "kind", "base", "s", "e")
    # an added span gives way to a base span, or an earlier span, that it would overlap
    w = Window.partitionBy("row").orderBy("s", F.desc("base"), "e", "kind").rowsBetween(Window.unboundedPreceding, -1)
    v = Window.partitionBy("row").orderBy("s", F.desc("base"), "e", "kind").rowsBetween(1, Window.unboundedFollowing)
    free = (F.coalesce(F.max("e").over(w), F.lit(0)) <= F.col("s")) & \
        (F.coalesce(F.min(F.when(F.col("base"), F.col("s"))).over(v), F.col("e")) >= F.col("e"))
    return kept.withColumn("free", free).where("base or free").drop("free")


def _listed(order: Column) -> Column:
    """kind:start:end of collected (order, s, e, name) structs, sorted and comma-joined."""
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base spans by kind, base_sha256, all spans, their number, that of secrets."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    got = spans(docs)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, F.lit(ALL_KINDS.index(k))), ALL_KINDS[1:],
                  F.when(F.col("kind") == ALL_KINDS[0], F.lit(0)))
    item = F.struct(rank.alias("k"), F.col("s"), F.col("e"), F.col("kind"))
    by_row = got.groupBy("row").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias("n_" + k) for k in KINDS],
        F.count("*").alias("n_spans"), F.count(F.when(F.col("kind") == "secret", 1)).alias("n_secret"),
        F.collect_list(F.when(F.col("base"), item)).alias("b"), F.collect_list(item).alias("a"))
    out = docs.select("row", "doc_id").join(by_row, "row", "left")
    none = F.coalesce(_listed(F.col("b")), F.lit(""))
    return out.select("doc_id", *[F.coalesce("n_" + k, F.lit(0)).cast("long").alias("n_" + k) for k in KINDS],
                      F.sha2(none, 256).alias("base_sha256"), F.coalesce(_listed(F.col("a")), F.lit("")).alias("spans"),
                      *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("n_spans", "n_secret")])


def mask(docs: DataFrame, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``docs`` with every span of its text replaced by <KIND>; all columns stay."""
    row = "__private_row"
    docs = docs.withColumn(row, F.monotonically_increasing_id())
    got = spans(docs, row, text, accept)
    marks = got.groupBy(F.col("row").alias("__private_r")).agg(
        F.array_sort(F.collect_list(F.struct("s", "e", F.upper("kind").alias("kind")))).alias("__private_s"))
    clear = F.aggregate(
        F.col("__private_s"), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(
            F.substring(F.col(text), (a["at"] + 1).cast("int"), (x["s"] - a["at"]).cast("int")),
            F.concat(F.lit("<"), x["kind"], F.lit(">")))).alias("out"))).otherwise(
                F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col(text), (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return (docs.join(marks, F.col(row) == F.col("__private_r"), "left")
            .withColumn(text, F.when(F.col("__private_s").isNotNull(), clear).otherwise(F.col(text)))
            .drop(row, "__private_r", "__private_s"))
