"""SentencePiece encoding and decoding: Aho-Corasick matches drive a Viterbi pass.

The pieces of a model sit in one Aho-Corasick automaton.  A text is read
once: at each character the automaton's state and its output links name every
piece that ends there, and each of them relaxes the best score of that
position.  A character that no piece covers goes to its byte pieces.

A blank is the mark U+2581 in pieces, with one mark put before a text.  Where
no piece joins two neighbours, the best path is the best path of what comes
before and that of what comes after; texts are cut into units at such places
(before blanks, around newlines, behind letters) and tasks keep the paths of
units they have seen.  A text with a pair that some piece does join is read whole.  Of paths of equal score, the one whose
last piece is longest wins, at every position.

The segmentation maximises the sum of the model's piece scores.  For a BPE
model it need not be the library's own merge order; decoding always gives the
text back (a raw U+2581 in a text is spelt in bytes, so it comes back too).

Defined results: a null text has null ids and decodes to null, an empty one no
ids; other columns pass through; the new column's name must be free.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm import words as W
from tracewise.llm.common import extended, ship_by_value

MARK = "▁"
#: A unit: blanks, then letters, or others and the letters behind them; a newline alone.
_UNIT = re.compile(r" *[^\W\d_]+| *(?:[^\w \n]|[\d_])+[^\W\d_]*| +|\n")
_KEPT_UNITS = 100_000          # units whose paths a task keeps
_KEPT_CHARS = 48               # longer units are not kept


def _surface(sp) -> list[bytes]:
    """The bytes that each piece stands for."""
    return [bytes([int(p[1:-1], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(map(sp.id_to_piece, range(sp.get_piece_size())))]


def _texts(surface: list[bytes], ids: np.ndarray, ends: list[int]) -> list[str]:
    """The texts of id lists that lie back to back."""
    flat = list(map(surface.__getitem__, ids.tolist()))
    out = [b"".join(flat[a:b]) for a, b in zip(ends, ends[1:])]
    return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "surrogatepass") for t in out]


class PieceModel:
    """The pieces of a .model file, their automaton and scores."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.byte_id = np.zeros(256, dtype=np.int64)
        self.byte_score = np.zeros(256)
        self.automaton = ahocorasick.Automaton()
        plain = []
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                b = int(piece[1:-1], 16)
                self.byte_id[b], self.byte_score[b] = i, sp.get_score(i)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and piece:
                self.automaton.add_word(piece, (len(piece), sp.get_score(i), i))
                plain.append(piece)
        self.automaton.make_automaton()
        self.single = {p for p in plain if len(p) == 1}
        # pairs of characters that a piece joins across the end of a unit
        self.joined = sorted({p[k:k + 2].replace(MARK, " ") for p in plain for k in range(len(p) - 1)
                              if _UNIT.match(p[k]) and _UNIT.match(p[k:k + 2].replace(MARK, " ")).end() < 2})
        if any("\n" in p for p in plain):
            self.joined.append("\n")
        self.surface = _surface(sp)

    def best(self, unit: str, raw_marks: frozenset[int] = frozenset()) -> list[int]:
        """Ids of the best path over ``unit``; positions in ``raw_marks`` are spelt in bytes."""
        n, single = len(unit), self.single
        score = [0.0] + [float("-inf")] * n
        size, piece = [0] * (n + 1), [0] * (n + 1)
        # characters that only bytes can spell, in order
        if not raw_marks and single.issuperset(unit):
            for end, (m, s, i) in self.automaton.iter(unit):
                end += 1
                s += score[end - m]
                if s > score[end] or s == score[end] and m > size[end]:
                    score[end], size[end], piece[end] = s, m, i
            return self._path(unit, size, piece)
        odd = [k for k, c in enumerate(unit) if c not in single or k in raw_marks]
        turn = 0
        for end, (m, s, i) in self.automaton.iter(unit):
            while turn < len(odd) and odd[turn] < end:     # all that ends before them is final
                self._spell(unit, odd[turn], score, size, piece)
                turn += 1
            start = end + 1 - m
            if raw_marks and any(start <= r <= end for r in raw_marks):
                continue
            s += score[start]
            end += 1
            if s > score[end] or s == score[end] and m > size[end]:
                score[end], size[end], piece[end] = s, m, i
        for k in odd[turn:]:
            self._spell(unit, k, score, size, piece)
        return self._path(unit, size, piece)

    def _path(self, unit, size, piece) -> list[int]:
        out, k = [], len(unit)
        while k:
            if piece[k] < 0:
                out.extend(int(self.byte_id[b]) for b in reversed(unit[k - 1].encode()))
            else:
                out.append(piece[k])
            k -= size[k]
        out.reverse()
        return out

    def _spell(self, unit, k, score, size, piece):
        """Reach position k+1 through the bytes of character k, if that is better."""
        s = score[k] + sum(self.byte_score[b] for b in unit[k].encode())
        if s > score[k + 1]:
            score[k + 1], size[k + 1], piece[k + 1] = s, 1, -1

    def encode(self, text: str) -> list[int]:
        """Ids of one text, without units (the plain form of the operator)."""
        if not text:
            return []
        raw = frozenset(k + 1 for k, c in enumerate(text) if c == MARK)
        return self.best(MARK + text.replace(" ", MARK), raw)

    def decode(self, ids) -> str:
        return _texts(self.surface, np.asarray(ids, np.int64), [0, len(ids)])[0]


class _Encoder:
    """Encodes texts by units, keeping the paths of those it has seen."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.whole = re.compile("|".join(map(re.escape, [MARK, *model.joined])))
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}                # unit -> number of its path
        self.flat = np.zeros(1 << 16, dtype=np.int32)  # the paths, back to back
        self.at = np.zeros(1 << 14, dtype=np.int64)    # where each begins
        self.paths = 0

    def _keep(self, paths: list[list[int]]) -> None:
        size = np.fromiter(map(len, paths), dtype=np.int64, count=len(paths))
        used, n = self.at[self.paths], self.paths + len(paths)
        while len(self.at) <= n:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.at[self.paths + 1:n + 1] = used + np.cumsum(size)
        while len(self.flat) < self.at[n]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[used:self.at[n]] = np.fromiter((i for p in paths for i in p), dtype=np.int32, count=int(size.sum()))
        self.paths = n

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        if self.paths > _KEPT_UNITS or self.at[self.paths] > 16 * _KEPT_UNITS:
            self._clear()
        units, count, known, model = [], [], self.known, self.model
        for t in texts:
            if not t:
                own = []
            elif self.whole.search(t):
                own = [(t,)]                           # a piece may cross the units of this text
            else:
                own = _UNIT.findall(" " + t)
            units += own
            count.append(len(own))
        fresh = list(dict.fromkeys(u for u in units if u not in known))
        known.update(zip(fresh, range(self.paths, self.paths + len(fresh))))
        self._keep([model.encode(u[0]) if isinstance(u, tuple) else model.best(u.replace(" ", MARK)) for u in fresh])
        which = np.fromiter(map(known.__getitem__, units), dtype=np.int64, count=len(units))
        for u in fresh:
            if isinstance(u, tuple) or len(u) > _KEPT_CHARS:
                del known[u]
        size = self.at[which + 1] - self.at[which]
        total = np.concatenate([[0], np.cumsum(size)])
        take = np.arange(total[-1]) - np.repeat(total[:-1] - self.at[which], size)
        return self.flat[take], total[np.concatenate([[0], np.cumsum(count)]).astype(np.int64)]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of its text column as array<int>.

    ``decoded`` names a further column for the text that decoding these ids gives, made in the same pass.
    """
    ship_by_value()
    schema = extended(docs, [(ids, T.ArrayType(T.IntegerType()))] + ([(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder(PieceModel(path))
        for batch in batches:
            for part, _, _ in W.text_slices(batch, text, 1 << 19):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                got, ends = encoder(texts)
                null = pa.array([t is None for t in texts])
                new = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(got, pa.int32()), mask=null)]
                if decoded:
                    back = _texts(encoder.model.surface, got, ends.tolist())
                    new.append(pa.array([None if t is None else b for t, b in zip(texts, back)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], schema=pa.schema(
                    [*part.schema, pa.field(ids, new[0].type), *([pa.field(decoded, pa.string())] if decoded else [])]))
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids column; a task holds the pieces' bytes alone."""
    ship_by_value()
    schema = extended(df, [(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        surface = _surface(sentencepiece.SentencePieceProcessor(model_file=path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                col = part.column(part.schema.get_field_index(ids))
                size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                out = _texts(surface, col.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(size)]).tolist())
                texts = pa.array([t if ok else None for t, ok in zip(out, col.is_valid().to_pylist())], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, text])

    return df.mapInArrow(run, schema)


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_pieces, ids_sha256, round_trip.

    ids_sha256 is over the comma-joined ids (null text: empty, like ""); round_trip
    says whether decoding gave the text back.
    """
    both = encode(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), path, decoded="decoded")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.col("text")).alias("round_trip"))
