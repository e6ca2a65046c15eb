"""SentencePiece encoding and decoding with the pieces and scores of a model file.

Spaces become U+2581 and one stands before every text that isn't empty. An Aho-Corasick automaton over the pieces
runs once over a text and reports, at each position, all pieces that end there (the state's own and, along the
output links, its suffixes', longest first); each relaxes the best score of a segmentation up to there. The best
score is the largest sum of piece scores; on a tie the longer last piece stays. A character that no piece covers
becomes the byte pieces of its UTF-8 form, at a score below all pieces, and so does U+2581 itself in a text;
decoding restores every text exactly.

Where no piece has a space mark after another character, no segmentation crosses such a place, and what lies
between is encoded on its own and kept, up to a bound, for the next time; the result is that of the whole text.

Nulls: a null text has null pieces, an empty one none. Repeated rows get equal results; all columns are kept as they are.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, named, prepared

MARK = "▁"
#: Stands for U+2581 in a text; no valid text has it.
LITERAL = "\udc81"
#: Texts between marks are kept in memory up to this length and number.
KEEP_CHARS, KEEP = 40, 200_000
#: What a byte piece costs more than the worst piece.
PENALTY = 10.0


@dataclass
class Pieces:
    """Pieces by id with their scores; byte_ids: the ids of the 256 byte pieces; special: ids that never occur."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: set[int]


#: At or below this a score only says that a piece comes after all others.
LAST = -1e8


def is_ranked(scores: list[float]) -> bool:
    """Whether scores are ranks of merges (whole numbers that fall) and no log probabilities."""
    some = [s for s in scores if s > LAST]
    return len(some) > 1 and all(a > b and b == int(b) for a, b in zip(some, some[1:]))


def zipf(scores: list[float]) -> list[float]:
    """Log probabilities by Zipf's law of pieces with these ranks; those of one rank share its probability."""
    order = sorted(set(scores), reverse=True)
    place = {s: i + 1 for i, s in enumerate(order)}
    norm = math.log(sum(1 / place[s] for s in scores))
    return [-math.log(place[s]) - norm for s in scores]


def load(path: str) -> Pieces:
    """A model's pieces. Scores that are ranks of merges can't be added up along a segmentation; they are taken for ranks
    of frequency. The segmentation is then the likeliest by these, not the one that merging would give."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = [-1] * 256
    for i in range(n):
        if model.is_byte(i):
            byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
    special = {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    scores = [model.get_score(i) for i in range(n)]
    usual = [i for i in range(n) if i not in special and not model.is_byte(i)]
    if is_ranked([scores[i] for i in usual]):
        for i, score in zip(usual, zipf([scores[i] for i in usual])):
            scores[i] = score
    return Pieces([model.id_to_piece(i) for i in range(n)], scores, byte_ids, special)


class Coder:
    def __init__(self, vocabulary: Pieces):
        import ahocorasick

        v = self.vocabulary = vocabulary
        never = v.special | set(v.byte_ids)
        self.automaton = ahocorasick.Automaton()
        usable = [i for i in range(len(v.pieces)) if i not in never and v.pieces[i]]
        for i in usable:
            self.automaton.add_word(v.pieces[i], (len(v.pieces[i]), v.scores[i], i))
        self.automaton.make_automaton()
        self.singles = {v.pieces[i] for i in usable if len(v.pieces[i]) == 1}
        self.unknown = min((v.scores[i] for i in usable if v.pieces[i].strip(MARK)), default=0.0) - PENALTY
        alphabet = {c for i in usable for c in v.pieces[i]}
        alone = "".join(re.escape(c) for c in "\n\r\t" + LITERAL if c not in alphabet)
        apart = not any(MARK in v.pieces[i].lstrip(MARK) for i in usable)
        own = f"[{alone}]|" if alone else ""
        self.split = re.compile(f"{own}{MARK}*[^{MARK}{alone}]+|{MARK}+").findall if apart else lambda text: [text]
        self.bytes = [b"" if i in v.special else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        for b, i in enumerate(v.byte_ids):
            self.bytes[i] = bytes([b])
        # A fallback character costs once, so only the bytes that begin one have its score.
        self.costs = np.array(v.scores)
        self.costs[v.byte_ids] = [0.0 if 0x80 <= b < 0xC0 else self.unknown for b in range(256)]
        self.kept: dict[str, bytes] = {}

    def _fallback(self, c: str) -> list[int]:
        return [self.vocabulary.byte_ids[b] for b in (MARK if c == LITERAL else c).encode("utf-8", "surrogatepass")]

    def best(self, text: str) -> bytes:
        """Piece ids (32-bit) of the best segmentation of a text in which marks stand for spaces."""
        n = len(text)
        score, last = [0.0] + [float("-inf")] * n, [None] * (n + 1)
        found: list[int] = []
        if self.singles.issuperset(text):
            for end, piece in self.automaton.iter(text):
                end += 1
                total = score[end - piece[0]] + piece[1]
                if total > score[end]:
                    score[end], last[end] = total, piece
            k = n
            while k:
                width, _, i = last[k]
                found.append(i)
                k -= width
        else:
            at = 0  # positions up to here are final
            for end, piece in self.automaton.iter(text):
                while at < end:  # a character without a piece of its own may become bytes
                    self._relax_bytes(text, at, score, last)
                    at += 1
                total = score[end + 1 - piece[0]] + piece[1]
                if total > score[end + 1]:
                    score[end + 1], last[end + 1] = total, piece
            for k in range(at, n):
                self._relax_bytes(text, k, score, last)
            k = n
            while k:
                width, _, i = last[k]
                found += (i,) if i >= 0 else self._fallback(text[k - 1])[::-1]
                k -= width
        return array("i", found[::-1]).tobytes()

    def _relax_bytes(self, text: str, k: int, score: list, last: list) -> None:
        if text[k] not in self.singles and score[k] + self.unknown > score[k + 1]:
            score[k + 1], last[k + 1] = score[k] + self.unknown, (1, self.unknown, -1)

    def encode(self, text: str) -> np.ndarray:
        """Piece ids of a text."""
        if not text:
            return np.zeros(0, np.int32)
        kept = self.kept
        if len(kept) > KEEP:
            kept.clear()
        if MARK in text:
            text = text.replace(MARK, LITERAL)
        parts = self.split(MARK + text.replace(" ", MARK))
        try:
            blob = b"".join(map(kept.__getitem__, parts))
        except KeyError:
            new = {part: self.best(part) for part in set(parts) if part not in kept}
            kept.update(new)
            blob = b"".join(map(kept.__getitem__, parts))
            for part in new:
                if len(part) > KEEP_CHARS:
                    del kept[part]
        return np.frombuffer(blob, np.int32)

    def score(self, ids: np.ndarray) -> float:
        return float(self.costs[ids].sum())

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


_last: list = [None, None]


def _coder(vocabulary: Pieces) -> Coder:
    """The worker process's coder: what it keeps lasts beyond a task."""
    if _last[0] is not vocabulary:
        _last[:] = [vocabulary, Coder(vocabulary)]
    return _last[1]


ENCODED = T.StructType([T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("score", T.DoubleType()), T.StructField("exact", T.BooleanType())])


def encoded(documents: DataFrame, vocabulary: Pieces, text: str = "text", into: str = "coded") -> DataFrame:
    """documents with one more column, fresh(into): a struct of pieces (ids), score, and exact: whether decoding them
    gives the text again."""
    prepared(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    @F.arrow_udf(ENCODED)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(shared.value)
        for texts in batches:
            found = [None if t is None else coder.encode(t) for t in texts.to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([0 if ids is None else len(ids) for ids in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int32), *(ids for ids in found if ids is not None)])
            scores = [None if ids is None else coder.score(ids) for ids in found]
            exact = [None if ids is None else coder.decode(ids.tolist()) == t.as_py() for ids, t in zip(found, texts)]
            nulls = pa.array([ids is None for ids in found], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=nulls)
            yield pa.StructArray.from_arrays([lists, pa.array(scores, pa.float64()), pa.array(exact, pa.bool_())], ["pieces", "score", "exact"])

    return documents.select("*", encode(named(text)).alias(fresh(into, documents.columns)))


def decoded(rows: DataFrame, vocabulary: Pieces, pieces: Column | str = "pieces", into: str = "text") -> DataFrame:
    """rows with one more column, fresh(into): the text, decoded from their piece ids; null where those are null."""
    prepared(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(shared.value)
        for lists in batches:
            yield pa.array([None if ids is None else coder.decode(ids) for ids in lists.to_pylist()], pa.string())

    return rows.select("*", decode(named(pieces) if isinstance(pieces, str) else pieces).alias(fresh(into, rows.columns)))
