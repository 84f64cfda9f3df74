"""N-gram Jaccard join over a token-group matrix.

Two documents link when the Jaccard similarity of their word-shingle sets is at
least ``similar`` percent.  Documents of equal sets form one node.

1. One scan gives each document its set's size and digest, and finds the
   shingles that are frequent within a task; those go last in the global order
   of shingles (frequent ones behind the others, each part by hash).  The order
   is kept as a fixed-size bit table; any order gives the same links.
2. Sets that link share one of their first n - ceil(t n) + 1 shingles in that
   order.  These are shuffled once; buckets with a single node fall away.
3. Partition: each node names the node that most of its buckets have first; naming
   joins alike nodes to groups, linked or not, and the pairs named are compared.
4. Token-group matrix: for every group (cut into blocks of bounded size) the
   union of its members' leading shingles is stored as rows (shingle, block).
   A node meets blocks on these rows, unless their members there are all linked
   with it already; the number of shingles met bounds the overlap from above, and
   only (node, block) pairs whose bound allows a link go on.
5. Open: in a block, the number of a node's shingles in the union of the
   members' whole sets is a bound again; if it allows a link, the exact overlaps
   with all members come from one pass over the node's rows of the matrix.
6. Groups and new links give the components.

Nothing is capped: two nodes that link meet in step 4 unless links of step 3 join them.

Defined results: a document without words has no shingles and links with
nothing; one with fewer words than a shingle has its whole word sequence as its
only one; rows of one doc_id are one document with several texts, and join what
these link with; rows without doc_id are left out of the links of others and have
no component; other columns are dropped (``groups``) or kept (``one_of_each``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm import words as W
from tracewise.llm.common import ship_by_value, store
from tracewise.llm.components import components

SHINGLE = 4
SIMILAR = 85                   # percent
_BITS = 22                     # the table of frequent shingles has 2^22 bits: 512 KB
_CHUNK = 4_000_000             # shingles whose frequencies a task counts at a time
_FREQUENT = 4                  # times a frequent shingle occurs in a chunk
_SALTS = 16                    # parts of a frequent shingle's bucket
BLOCK_NODES = 128              # nodes of a group that one block holds,
BLOCK_SHINGLES = 500_000       # and shingles
_QUERIES = 2_000               # nodes that meet a block in one task
_SIEVE = 25                    # a sieve of doc_ids has 2^25 bits in 2^19 rows: 8 MB


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by hash, back to back; and their bounds."""
    w = W.words_of(data, offsets, lower=True)
    g, at = W.ngrams(w.hash, w.row, n)
    bounds = np.searchsorted(at, w.first)      # shingles by row: a row's begin at its words
    sets, sizes = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    for k in range(len(sizes)):
        own = g[bounds[k]:bounds[k + 1]]
        if not len(own):
            own = w.hash[w.first[k]:w.first[k + 1]]
            if not len(own):
                continue
            own, _ = W.ngrams(own, np.zeros(len(own), np.int64), len(own))
        else:
            own = np.sort(own)
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        sets.append(own)
        sizes[k] = len(own)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def set_digest(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set (0 if empty), the same in any order."""
    out = np.zeros(len(bounds) - 1, dtype=np.uint64)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = W.mix(np.add.reduceat(W.mix(sets ^ W._STEP), bounds[some]))
    return out


def leading(size: int, similar: int) -> int:
    """How many shingles of a set are looked at: sets that link share one of them."""
    return size - (similar * size + 99) // 100 + 1


def _is_frequent(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64((1 << _BITS) - 1)
    return (table[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 > 0


def _scan(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, size, node for each document; then token, times for frequent shingles of chunks."""
    def frequent(held):
        u, times = np.unique(np.concatenate(held), return_counts=True)
        u, times = u[times >= _FREQUENT], times[times >= _FREQUENT]
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, pa.array(W.signed(u)), pa.array(times)], names=names)

    names = ["doc_id", "size", "node", "token", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                sets, bounds = shingle_sets(data, offsets, n)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(W.signed(set_digest(sets, bounds))),
                     none, none], names=names)
                held.append(sets)
                total += len(sets)
                if total >= _CHUNK:
                    yield frequent(held)
                    held, total = [], 0
        if total:
            yield frequent(held)

    return docs.mapInArrow(run, "doc_id long, size long, node long, token long, times long")


def _leading_rows(docs: DataFrame, table: np.ndarray, n: int, similar: int) -> DataFrame:
    """token, salt (-1, or a part of a frequent shingle's bucket), node, size: leading shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                sets, bounds = shingle_sets(data, offsets, n)
                late = _is_frequent(shared.value, sets)
                tokens, salted, count = [], [], []
                for a, b in zip(bounds, bounds[1:]):
                    if a == b:
                        count.append(0)
                        continue
                    p = leading(b - a, similar)
                    own = np.concatenate([a + np.flatnonzero(~late[a:b])[:p], a + np.flatnonzero(late[a:b])])[:p]
                    tokens.append(sets[own])
                    salted.append(late[own])
                    count.append(p)
                if not tokens:
                    continue
                node = np.repeat(set_digest(sets, bounds), count)
                salt = np.where(np.concatenate(salted), (node % np.uint64(_SALTS)).astype(np.int32), np.int32(-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(np.concatenate(tokens))), pa.array(salt), pa.array(W.signed(node)),
                     pa.array(np.repeat(np.diff(bounds), count), pa.int32())], names=["token", "salt", "node", "size"])

    return docs.mapInArrow(run, "token long, salt int, node long, size int")


def _frequent_table(scan: DataFrame) -> np.ndarray:
    """The packed bit table of frequent shingles (bits of the table come to the driver)."""
    at = scan.where("token is not null").select(F.col("token").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("at")).distinct()
    table = np.zeros(1 << _BITS, dtype=bool)
    table[np.asarray(at.toArrow().column(0), dtype=np.int64)] = True
    return np.packbits(table)


def _live_rows(rows: DataFrame) -> DataFrame:
    """token, node, size, pivot: rows of buckets with two nodes or more; pivot is the bucket's least node."""
    # read three times, shuffled once; copies of a set go within their task
    # (columns without nulls: else each reader filters them before the shuffle in its own way)
    rows = rows.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns])
    dealt = rows.repartition("token", "salt").dropDuplicates(["token", "salt", "node"])
    # all columns, and filters on aggregates only: so the shuffle is the same one for both readers
    part = dealt.groupBy("token", "salt").agg(F.min("node").alias("lo"), F.max("node").alias("hi"),
                                              F.max("salt").alias("s"), F.max("size").alias("size"))
    part = part.where("size > 0 and (s >= 0 or lo < hi)")
    whole = part.where("s < 0").select("token", "salt", "lo")
    # the parts of a frequent shingle's bucket meet in one row each
    parted = (part.where("s >= 0").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
              .select("token", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), "lo"))
    return dealt.join(whole.unionByName(parted), ["token", "salt"]).select("token", "node", "size", F.col("lo").alias("pivot"))


def _sieved(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be one of ``ids``: all that are, and few others.

    The sieve's size has a bound, so it is broadcast; texts that it holds back are not shuffled.
    """
    at = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << _SIEVE) - 1))
    bits = (ids.select(at.alias("__at")).groupBy(F.shiftright("__at", 6).alias("__word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(__at & 63 as int))")).alias("__bits")))
    return (docs.withColumn("__at", at).join(F.broadcast(bits), F.shiftright("__at", 6) == F.col("__word"))
            .where("getbit(__bits, cast(__at & 63 as int)) = 1").select(*docs.columns))


def _texts(docs: DataFrame, home: DataFrame, *asking: DataFrame) -> DataFrame:
    """node, text of the nodes in ``asking``; the text is that of the node's ``home``."""
    ids = asking[0].select("node")
    for more in asking[1:]:
        ids = ids.unionByName(more.select("node"))
    need = store(ids.distinct().join(home, "node").select("node", F.col("home").alias("doc_id")), "need")
    return store(_sieved(docs, need).join(need, "doc_id").select("node", "text"), "texts")


def _open(asked: DataFrame, members: DataFrame, texts: DataFrame, n: int, similar: int) -> DataFrame:
    """Compare nodes with blocks: ``asked`` and ``members`` (node, root, block), ``texts`` (node, text).

    Returns node, other: for each (node, block) a member that links of every root
    but the node's own.
    """
    parts = asked.groupBy("block").agg(F.ceil(F.count("*") / _QUERIES).cast("int").alias("parts"))
    query = (asked.join(parts, "block").join(texts, "node")
             .select("block", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"),
                     "node", "root", "text"))
    held = (members.join(parts, "block").join(texts, "node")
            .select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"),
                    "node", "root", "text"))
    rows = query.unionByName(held).repartition("block", "part").sortWithinPartitions("block", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, roots, sets, matrix = None, [], [], [], None
        for batch in batches:
            for part, data, offsets in W.text_slices(batch):
                flat, bounds = shingle_sets(data, offsets, n)
                mine = W.signed(set_digest(flat, bounds))
                block, sub, kind, node, root = (part.column(c).to_pylist() for c in range(5))
                found = []
                for k in range(part.num_rows):
                    if (block[k], sub[k]) != key:
                        key, nodes, roots, sets, matrix = (block[k], sub[k]), [], [], [], None
                    if mine[k] != node[k]:             # another text of the same doc_id
                        continue
                    own = flat[bounds[k]:bounds[k + 1]]
                    if kind[k] == 0:
                        nodes.append(node[k])
                        roots.append(root[k])
                        sets.append(own.copy())
                    elif nodes:
                        matrix = matrix or _Matrix(sets)
                        new = {roots[m]: nodes[m] for m in matrix.linked(own, similar) if roots[m] != root[k]}
                        found += [(node[k], other) for other in new.values()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)],
                                                     names=["node", "other"])

    return rows.mapInArrow(run, "node long, other long")


class _Matrix:
    """A block's token-group matrix: its shingles, sorted, each with the member it is of."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        token = np.concatenate(sets)
        order = np.argsort(token, kind="stable")
        self.token, self.member = token[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def linked(self, own: np.ndarray, similar: int) -> list[int]:
        """The members that link with the set ``own``."""
        lo = np.searchsorted(self.token, own, side="left")
        count = np.searchsorted(self.token, own, side="right") - lo
        if 100 * np.count_nonzero(count) < similar * len(own):
            return []                                  # not even the union holds enough of it
        at = np.arange(count.sum()) + np.repeat(lo - np.cumsum(count) + count, count)
        both = np.bincount(self.member[at], minlength=len(self.sizes))
        return np.flatnonzero(100 * both >= similar * (len(own) + self.sizes - both)).tolist()


def _least_met(size: Column, other: Column, similar: int) -> Column:
    """Leading shingles that sets of these sizes share at least if they link.

    They share s (a + b) / (100 + s) shingles; all of these but those behind the
    leading part of one of the two sets are met among the leading ones.
    """
    need = F.ceil(F.lit(similar) * (size + other) / F.lit(100 + similar) - 1e-6)
    behind = lambda n: F.ceil(F.lit(similar) * n / F.lit(100) - 1e-6) - 1
    return F.greatest(F.lit(1), need - F.greatest(behind(size), behind(other)))


def _least_met_in(size: Column, lo: Column, hi: Column, similar: int) -> Column:
    """A lower bound of ``_least_met`` for all other sizes from ``lo`` to ``hi`` that can link.

    Its ceilings make ``_least_met`` rise and fall between the ends.  Without those of the
    other size (ceil(x / 100) <= (x + 99) / 100) it is concave in that size, hence least at an end.
    """
    lo, hi = F.greatest(lo, F.ceil(size * similar / 100 - 1e-6)), F.least(hi, F.floor(size * 100 / similar + 1e-6))
    own = F.ceil(F.lit(similar) * size / F.lit(100) - 1e-6) - 1
    plain = lambda n: F.lit(similar) * (size + n) / F.lit(100 + similar) - F.greatest(own, (F.lit(similar) * n - 1) / F.lit(100))
    return F.when(lo == hi, _least_met(size, lo, similar)).otherwise(
        F.greatest(F.lit(1), F.ceil(F.least(plain(lo), plain(hi)) - 1e-6)))


def link_rows(docs: DataFrame, n: int = SHINGLE, similar: int = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """(doc_id, size, node of every document; links node, other between nodes).

    The links join every two nodes that are linked, directly or through others.
    """
    ship_by_value()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scan = store(_scan(docs, n), "scan")
    sizes = scan.where("token is null").select("doc_id", "size", "node")
    live = store(_live_rows(_leading_rows(docs.where("doc_id is not null"), _frequent_table(scan), n, similar)), "live")
    nodes = live.groupBy("node").agg(F.max("size").alias("size"))
    home = sizes.where("doc_id is not null and size > 0").groupBy("node").agg(F.min("doc_id").alias("home"))

    # partition: the node most named by a node's buckets, if it is named often enough
    named = (live.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("c"), F.max("size").alias("size"))
             .where(F.col("c") * 500 >= F.col("size") * (100 - similar)))
    best = store(named.groupBy("node").agg(F.max(F.struct("c", "pivot")).alias("b"))
                 .select("node", F.col("node").alias("root"), F.col("b.pivot").alias("block")), "best")
    pivots = best.select(F.col("block").alias("node")).distinct().select("node", F.col("node").alias("root"), F.col("node").alias("block"))
    first = store(_open(best, pivots, _texts(docs, home, best, pivots), n, similar), "first")
    root = components(first, "node", "other")
    alike = components(best, "node", "block").withColumnsRenamed({"node": "a_node", "root": "alike"})

    # token-group matrix: groups of nodes that are alike, cut into blocks
    group = (nodes.join(root, "node", "left").join(alike, F.col("node") == F.col("a_node"), "left")
             .select("node", "size", F.coalesce("root", "node").alias("root"), F.coalesce("alike", "node").alias("alike"))
             # nodes of a block are of nearly one size, which makes its bound sharp
             .withColumn("band", F.floor(F.log(F.col("size").cast("double")) * 25).cast("int")))
    per = group.groupBy("alike", "band").agg(F.count("*").alias("g_nodes"), F.sum("size").alias("g_size"))
    blocks = F.ceil(F.greatest(F.col("g_nodes") / BLOCK_NODES, F.col("g_size") / BLOCK_SHINGLES)).cast("int")
    group = store(group.join(per.withColumn("blocks", blocks), ["alike", "band"]).select(
        "node", "size", "root", F.xxhash64("alike", "band", F.pmod(F.xxhash64("node"), "blocks")).alias("block")), "blocks")
    span = group.groupBy(F.col("block").alias("s_block")).agg(F.min("size").alias("b_min"), F.max("size").alias("b_max"))
    rows = store(live.select("token", "node").join(group, "node"), "rows")
    rows = rows.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns]).repartition("token")
    matrix = rows.groupBy("token", F.col("block").alias("m_block")).agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    mixed = rows.groupBy("token").agg(F.min("root").alias("t_lo"), F.max("root").alias("t_hi")).where("t_lo < t_hi").select("token")
    # a node asks its own block and those of greater number, unless a block has its root alone
    met = (rows.join(mixed, "token").join(matrix, "token").where("block <= m_block and (lo < hi or lo <> root)")
           .groupBy("node", "root", "m_block").agg(F.count("*").alias("met"), F.max("size").alias("size"))
           .join(span, F.col("m_block") == F.col("s_block")))
    size, lo, hi = F.col("size"), F.col("b_min"), F.col("b_max")
    least = _least_met_in(size, lo, hi, similar)
    asked = store(met.where((size * 100 >= lo * similar) & (hi * 100 >= size * similar) & (F.col("met") >= least))
                  .select("node", "root", F.col("m_block").alias("block")), "asked")
    held = group.join(asked.select("block").distinct(), "block", "left_semi").select("node", "root", "block")
    return sizes, first.unionByName(_open(asked, held, _texts(docs, home, asked, held), n, similar))


def groups(docs: DataFrame, n: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable by links)."""
    sizes, links = link_rows(docs, n, similar)
    worded = sizes.where("doc_id is not null and size > 0")
    twice = worded.groupBy("doc_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    same = worded.join(twice, "doc_id").select("node", F.col("lo").alias("other")).where("node <> other")
    root = components(links.unionByName(same), "node", "other")
    placed = sizes.join(root, "node", "left").select(
        "doc_id", "size", F.when((F.col("size") > 0) & F.col("doc_id").isNotNull(), F.coalesce("root", "node")).alias("root"))
    least = placed.where("root is not null").groupBy(F.col("root").alias("l_root")).agg(F.min("doc_id").alias("least"))
    # those without words or id would all meet in one task: they need no join
    alone = placed.where("root is null").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    joined = placed.where("root is not null").join(least, F.col("root") == F.col("l_root")).select("doc_id", "size", "least")
    return joined.unionAll(alone).select("doc_id", F.col("size").alias("n_shingles"), F.col("least").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """``docs`` with the document of least doc_id of each component; all columns stay.

    Documents without doc_id stay; of repeated rows of a doc_id, all stay.
    """
    gone = (groups(docs, n, similar).where("doc_id <> component_id")
            .select(F.col("doc_id").alias("__gone")).distinct())
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
