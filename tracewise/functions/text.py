"""Column-level text functions (all built-in Spark expressions, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewise.sources.lookups import (FALLBACK_PREFIX, MAX_QUERY_LENGTH,
                                       NO_INFO_PREFIX)

# ---- fixed values: the evaluator's stopword list (30 words) --------------
EVAL_STOPWORDS = [
    "the", "is", "a", "an", "of", "to", "and", "in", "on", "for", "that",
    "this", "it", "as", "are", "was", "were", "be", "by", "with", "at",
    "from", "or", "not", "but", "can", "will", "which", "into", "than",
]
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_tokens(text, stopwords=None, min_len: int = 3) -> Column:
    """Distinct lower-case ``[a-z0-9]+`` words, minus stopwords, of at
    least ``min_len`` characters.  Null text gives an empty set.

    A maximal ``[a-z0-9]`` run of ``min_len`` or more characters is exactly a
    match of ``[a-z0-9]{min_len,}`` (shorter runs have no such match), so the
    length filter lives in the pattern and the stopwords go by
    ``array_except`` (which also de-duplicates): no per-element lambda.
    """
    sw = F.array(*[F.lit(w) for w in (stopwords or EVAL_STOPWORDS)])
    words = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))),
                                 F.lit(f"([a-z0-9]{{{int(min_len)},}})"), 1)
    return F.array_except(words, sw)


def overlap_counts(a_text, b_text) -> tuple[Column, Column]:
    """(|A ∩ B|, |A|) over content tokens."""
    a = content_tokens(a_text)
    b = content_tokens(b_text)
    return F.size(F.array_intersect(a, b)), F.size(a)


def _blank(c: Column) -> Column:
    # Python truthiness of a str: None and "" are false
    return c.isNull() | (c == "")


def overlap_score(a_text, b_text, digits: int = 3, a_tokens=None, b_tokens=None) -> Column:
    """|A ∩ B| / |A| rounded like Python's ``round``; 0.0 when either text is
    empty or A has no content tokens.  Pass precomputed token columns to
    avoid re-deriving them inside every branch."""
    from tracewise.functions.numeric import py_round_ratio
    a, b = _col(a_text), _col(b_text)
    at = a_tokens if a_tokens is not None else content_tokens(a)
    bt = b_tokens if b_tokens is not None else content_tokens(b)
    k, n = F.size(F.array_intersect(at, bt)), F.size(at)
    return (F.when(_blank(a) | _blank(b), F.lit(0.0))
            .when(n == 0, F.lit(0.0))
            .otherwise(py_round_ratio(k, n, digits)))


def faithfulness_overlap(answer, context, answer_tokens=None, context_tokens=None) -> Column:
    """Share of the answer's content words found in the context."""
    return overlap_score(answer, context, 3, answer_tokens, context_tokens)


def relevance_keyword(query, answer, query_tokens=None, answer_tokens=None) -> Column:
    """Share of the query's content words found in the answer."""
    return overlap_score(query, answer, 3, query_tokens, answer_tokens)


def is_fallback_answer(answer) -> Column:
    """Answer starts with the fallback tag or the no-information phrase."""
    t = py_strip(_col(answer))
    return t.startswith(FALLBACK_PREFIX) | t.startswith(NO_INFO_PREFIX)


# Characters Python's str.strip() removes (str.isspace() is true).
PY_WHITESPACE_CLASS = (r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                       r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def py_strip(c) -> Column:
    """Python ``str.strip()``: drop leading/trailing Unicode whitespace."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def validate_query(raw) -> tuple[Column, Column, Column]:
    """(normalised query, is_valid, reject_reason)."""
    r = _col(raw)
    q = py_strip(r)
    reason = (F.when(r.isNull(), F.lit("Query cannot be None"))
              .when(F.length(q) == 0, F.lit("Query cannot be empty"))
              .when(F.length(q) > MAX_QUERY_LENGTH,
                    F.format_string(f"Query too long (%d chars). Max is {MAX_QUERY_LENGTH}.",
                                    F.length(q))))
    return q, reason.isNull(), reason


def payload_summary(value, max_preview: int = 200) -> Column:
    """Privacy-preserving summary of a string payload: type, length and a
    ``max_preview``-character preview."""
    v = _col(value)
    return F.when(v.isNull(), F.lit(None)).otherwise(
        F.struct(F.lit("str").alias("type"), F.length(v).alias("length"),
                 F.substring(v, 1, max_preview).alias("preview")))


def typed_summary(payload, max_preview: int = 200, max_keys: int = 10) -> Column:
    """Summary of a JSON payload by its type, never the payload itself: struct of
    ``type`` (NoneType, str, int, float, bool, list, dict), ``length`` (str: characters, list: elements),
    ``preview`` (str), ``keys`` (dict: the first ``max_keys``), ``number`` (int, float) and ``flag`` (bool).
    Null for a null payload, type ``unknown`` for a text that is no JSON."""
    c = _col(payload)

    def once(value, body):                   # ``body`` of a value that is computed once
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def named(v, kind):
        return (F.when(v.isNull(), "unknown").when(kind == "VOID", "NoneType").when(kind == "STRING", "str")
                .when(kind == "BOOLEAN", "bool").when(kind.startswith("ARRAY"), "list")
                .when(kind.startswith("OBJECT"), "dict").when(F.trim(c).rlike("^-?[0-9]+$"), "int").otherwise("float"))

    def summary(v, name):
        text = F.try_variant_get(v, "$", "string")
        return F.struct(
            name.alias("type"),
            F.when(name == "str", F.length(text)).when(name == "list", F.json_array_length(c)).cast("long").alias("length"),
            F.when(name == "str", F.substring(text, 1, max_preview)).alias("preview"),
            F.when(name == "dict", F.slice(F.json_object_keys(c), 1, max_keys)).alias("keys"),
            F.when(name.isin("int", "float"), F.try_variant_get(v, "$", "double")).alias("number"),
            F.when(name == "bool", F.try_variant_get(v, "$", "boolean")).alias("flag"))

    parsed = once(F.try_parse_json(c), lambda v: once(
        F.schema_of_variant(v), lambda kind: once(named(v, kind), lambda name: summary(v, name))))
    return F.when(c.isNotNull(), parsed)
