"""Context-tree weighting over bytes, binary-decomposed, trained and applied as tables.

A text is lower-cased (A-Z), its tokens (runs of other than ASCII white space) are joined by single spaces and a
newline ends it; a text without tokens is the newline alone. Every byte is eight binary decisions, most significant
first; a decision has as contexts the bits of its byte so far together with the last 0 to DEPTH bytes (newlines
before the text). In each node of each of these context trees the Krichevsky-Trofimov estimate
(n1 + 1/2) / (n0 + n1 + 1) is mixed with the next deeper node's probability. The weight of a node's own estimate is
what context-tree weighting gives after the whole training text: half its block probability over its weighted one,
P_w = (P_e + product of the deeper nodes' P_w) / 2, P_w = P_e at full depth. A node that training never visited adds
nothing, so the mixture ends at the deepest visited one (one half if even the shallowest is new). The two
probabilities of a decision sum to one, so those of all bytes and of all texts do.

Layout: texts are dealt into chunks, and each chunk gathers its distinct words and its distinct (DEPTH + 1)-byte
strings with their counts in training texts. These lists, never the texts' positions, meet the corpus: by word they
give the corpus' word counts, by string the corpus' string counts, and every string gets the code length of its
last byte. Lists travel packed, a row for each chunk and bucket. Strings are bucketed by the last TOP bytes of
their context, so a bucket holds whole subtrees, which are built and evaluated bit by bit and level by level as
arrays, at most PIECE strings at once: a frequent context is split by its next byte, and again. What is above TOP is
a table, joined by level. Lists are unpacked one at a time and merged as they come. In a second pass each chunk looks the answers up. Nothing is broadcast, no model
has to fit anywhere, and what is gathered grows with the number of distinct strings and words.

Nulls: a null text is empty, a null id is never held out. Repeated rows get equal results. An empty table gives no
rows. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import written

DEPTH, TOP = 6, 3
#: Bytes of text that a bucket of strings or words stands for on average, and that are indexed at once.
BUCKET_BYTES, SPAN = 12 << 20, 1 << 19
#: Numbers that a task gathers before it hands its lists on, and strings whose nodes are held at once.
HELD, PIECE = 4_000_000, 250_000
NEWLINE, BLANK = 10, 32
#: The number that stands for the end of a text among the numbers of words.
END = -1


def text_bytes(x: np.ndarray, start: np.ndarray, stop: np.ndarray, first: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts as the model sees them, depth newlines before each, and where each begins."""
    long = stop - start
    upto = np.concatenate([[0], np.cumsum(long + 1)])
    length = np.maximum(upto[first[1:]] - upto[first[:-1]], 1)
    begin = np.concatenate([[0], np.cumsum(length + depth)]) + depth
    out = np.full(begin[-1] - depth, NEWLINE, np.uint8)
    n_words = np.diff(first)
    to = np.repeat(begin[:-1] - upto[first[:-1]], n_words) + upto[:-1]
    from_ = np.repeat(start - to, long)
    at = np.arange(len(from_)) + np.repeat(to - (upto[:-1] - np.arange(len(long))), long)
    out[at] = words.LOWER[x[at + from_]]
    ends = to + long
    out[ends] = BLANK
    out[ends[first[1:][n_words > 0] - 1]] = NEWLINE
    return out, begin


def strings(out: np.ndarray, begin: np.ndarray, depth: int) -> np.ndarray:
    """For each byte of each text, the number made of the depth bytes before it and itself."""
    inside = np.ones(len(out), bool)
    inside[(begin[:-1, None] - 1 - np.arange(depth)[None, :]).ravel()] = False
    x = out.astype(np.int64)
    key = np.zeros(len(x) - depth, np.int64)
    for j in range(depth + 1):
        key |= x[depth - j : len(x) - j] << (8 * j)
    return key[inside[depth:]]


def indexed(texts: pa.Array, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """By spans of texts: numbers of the words, how many each text has, strings, how many each text has, and whether the
    first text is the last one of the span before, continued: texts longer than a span come in parts."""
    for _, x, at in words.spans(texts, SPAN):
        if len(at) == 2 and len(x) > SPAN:
            yield from _parts(x, depth)
            continue
        start, stop, hashes, first = words.found(x, at)
        out, begin = text_bytes(x, start, stop, first, depth)
        yield (hashes >> np.uint64(1)).astype(np.int64), np.diff(first), strings(out, begin, depth), np.diff(begin) - depth, False


def _parts(x: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """indexed() of one long text, piece by piece; each knows the last bytes of what came before."""
    end = len(x)
    while end and words.SPACE[x[end - 1]]:
        end -= 1
    before, lo, begun = np.full(depth, NEWLINE, np.uint8), 0, False
    while lo < end or not begun:
        hi = words.cut(x[:end], lo)
        start, stop, hashes, first = words.found(x[lo:hi], np.array([0, hi - lo]))
        if len(start) or hi == end:
            out, begin = text_bytes(x[lo:hi], start, stop, first, depth)
            out[:depth] = before
            if hi < end:
                out[-1] = BLANK  # more words follow
            yield (hashes >> np.uint64(1)).astype(np.int64), np.diff(first), strings(out, begin, depth), np.diff(begin) - depth, begun
            before, begun = out[len(out) - depth :].copy(), True
        lo = hi


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as compressed bytes, the first (sorted) as differences."""
    planes = [np.diff(columns[0], prepend=0), *columns[1:]]
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(-1, 8).T).tobytes() for c in planes)
    return len(columns[0]).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(blob: bytes, *kinds: type) -> list[np.ndarray]:
    blob = memoryview(blob)
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=8 * n * len(kinds) + 1), np.uint8)
    out = [np.ascontiguousarray(raw[8 * n * i : 8 * n * (i + 1)].reshape(8, n).T).view(kind).reshape(n) for i, kind in enumerate(kinds)]
    out[0] = np.cumsum(out[0])
    return out


# Krichevsky-Trofimov

_SMALL = 4096
_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_WHOLE = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the estimator's probability of n0 zeros and n1 ones."""

    def half(n: np.ndarray) -> np.ndarray:
        return np.where(n < _SMALL, _HALF[np.minimum(n, _SMALL - 1)], _log_gamma(n + 0.5))

    n = n0 + n1
    whole = np.where(n < _SMALL, _WHOLE[np.minimum(n, _SMALL - 1)], _log_gamma(n + 1.0))
    return half(n0) + half(n1) - whole - math.log(math.pi)


def _weighted(n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted block probability, and the share of the node's own estimate in it."""
    own = log_block(n0, n1)
    if below is None:
        return own, np.ones(len(own))
    both = np.logaddexp(own, below) - math.log(2)
    return both, np.exp(own - math.log(2) - both)


def _leaves(keys: np.ndarray, counts: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The deepest nodes that decide bit j: their numbers, zeros, ones, and each string's node. Keys are sorted.

    A node's number is its context times 256 plus the bits of the byte so far, after a leading one."""
    node = (keys >> 8 << 8) | (1 << j) | ((keys & 255) >> (8 - j))
    new = np.concatenate([[True], node[1:] != node[:-1]])
    first = np.flatnonzero(new)
    n1 = np.add.reduceat(counts * _bit(keys, j), first)
    return node[first], np.add.reduceat(counts, first) - n1, n1, np.cumsum(new) - 1


def _bit(keys: np.ndarray, j: int) -> np.ndarray:
    return (keys >> (7 - j)) & 1


def _up(nodes: tuple[np.ndarray, ...], d: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """From nodes(number, zeros, ones, log weighted probability) of depth d those of depth d - 1, without their own
    weighting yet, and each node's parent."""
    number, n0, n1, weighted = nodes
    above, parent = np.unique(((number >> 8) & ((1 << (8 * (d - 1))) - 1)) << 8 | (number & 255), return_inverse=True)
    return (above, np.bincount(parent, n0).astype(np.int64), np.bincount(parent, n1).astype(np.int64), np.bincount(parent, weighted)), parent


def _pieces(keys: np.ndarray, d: int, size: int) -> Iterator[np.ndarray]:
    """Places of strings by whole contexts of d bytes, about `size` strings at once; a larger context is by itself."""
    context = (keys >> 8) & ((1 << (8 * d)) - 1)
    order = np.argsort(context, kind="stable")
    edge = np.concatenate([np.flatnonzero(np.diff(context[order])) + 1, [len(keys)]])
    lo = 0
    while lo < len(keys):
        hi = int(edge[max(np.searchsorted(edge, lo + size, side="right") - 1, np.searchsorted(edge, lo, side="right"))])
        yield order[lo:hi]
        lo = hi


class Tree:
    """The nodes that decide bit j, of depths `depth` down to `top`, over some sorted (string, count) rows that hold
    whole contexts of top bytes. Up to `size` strings are worked on as one; more are split by a further byte of
    context, so a frequent context needs no more memory than others, but for its strings and the nodes below its root."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, top: int, j: int, size: int):
        self.keys, self.counts, self.depth, self.top, self.j, self.size = keys, counts, depth, top, j, size
        self.split = len(keys) > size and top < depth
        self.levels = []
        if self.split:
            parts = [self._part(i).nodes for i in _pieces(keys, top + 1, size)]
            nodes, d = tuple(np.concatenate(c) for c in zip(*parts)), top + 1
            share = np.zeros(0)
            below = nodes[3]
        else:
            number, n0, n1, self.of = _leaves(keys, counts, j)
            below, share = _weighted(n0, n1, None)
            nodes, d = (number, n0, n1, below), depth
        while d > top:
            above, parent = _up(nodes, d)
            self.levels.append((nodes, share, parent))
            weighted, share = _weighted(above[1], above[2], above[3])
            nodes, d = (*above[:3], weighted), d - 1
        self.nodes, self.share = nodes, share

    def _part(self, i: np.ndarray) -> Tree:
        i = np.sort(i)
        return Tree(self.keys[i], self.counts[i], self.depth, self.top + 1, self.j, self.size)

    def log10(self, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Log probability of bit j of each string, from the states above the nodes of depth top: probability of a
        one so far, the weight that is left, and the last estimate."""
        state = _step(*above, self.nodes[1], self.nodes[2], self.share)
        for nodes, share, parent in reversed(self.levels):
            state = tuple(s[parent] for s in state)
            if not self.split:
                state = _step(*state, nodes[1], nodes[2], share)
        if self.split:
            # states above the pieces' roots, which stand in the order of the pieces
            out, at = np.empty(len(self.keys)), 0
            for i in _pieces(self.keys, self.top + 1, self.size):
                part = self._part(i)
                n = len(part.nodes[0])
                out[np.sort(i)] = part.log10(tuple(s[at : at + n] for s in state))
                at += n
            return out
        one = (state[0] + state[1] * state[2])[self.of]
        return np.log10(np.where(_bit(self.keys, self.j) == 1, one, 1 - one))


def _step(so_far: np.ndarray, left: np.ndarray, last: np.ndarray, n0: np.ndarray, n1: np.ndarray, share: np.ndarray):
    """A node's state from the one above it."""
    seen = n0 + n1 > 0
    own = (n1 + 0.5) / (n0 + n1 + 1)
    return np.where(seen, so_far + left * share * own, so_far), np.where(seen, left * (1 - share), left), np.where(seen, own, last)


# Tables


@F.arrow_udf(T.DoubleType())
def _log_block(n0: pa.Array, n1: pa.Array) -> pa.Array:
    return pa.array(log_block(n0.to_numpy(zero_copy_only=False), n1.to_numpy(zero_copy_only=False)))


NODE = "node long, n0 long, n1 long, weighted double"


def _upper(nodes: DataFrame, top: int) -> DataFrame:
    """node, so_far, left, last: the state above each node of depth top, by levels of the whole corpus' tree."""
    levels = [nodes]
    for d in range(top - 1, -1, -1):
        up = (F.col("node").bitwiseAND(((1 << (8 * d)) - 1) << 8)).bitwiseOR(F.col("node").bitwiseAND(255))
        sums = levels[-1].groupBy(up.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        own = sums.withColumn("own", _log_block("n0", "n1"))
        most = F.greatest("own", "below")
        both = most + F.log(F.exp(F.col("own") - most) + F.exp(F.col("below") - most)) - F.lit(math.log(2))
        level = own.withColumn("weighted", both).withColumn("share", F.exp(F.col("own") - F.lit(math.log(2)) - F.col("weighted"))).drop("own", "below")
        levels.append(written(level, "ctw-level"))
    state: DataFrame | None = None
    for d, level in enumerate(reversed(levels[1:])):
        if state is None:
            before = level.withColumns({"so_far": F.lit(0.0), "left": F.lit(1.0), "last": F.lit(0.5)})
        else:
            before = _joined(level, state, d - 1)
        seen = (F.col("n0") + F.col("n1")) > 0
        own = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
        state = before.select(
            "node",
            F.when(seen, F.col("so_far") + F.col("left") * F.col("share") * own).otherwise(F.col("so_far")).alias("so_far"),
            F.when(seen, F.col("left") * (1 - F.col("share"))).otherwise(F.col("left")).alias("left"),
            F.when(seen, own).otherwise(F.col("last")).alias("last"),
        )
    return _joined(nodes.select("node"), state, top - 1).select("node", "so_far", "left", "last")


def _joined(level: DataFrame, state: DataFrame, depth: int) -> DataFrame:
    """level with the state of its nodes' parents, which have so many bytes of context."""
    up = (F.col("node").bitwiseAND(((1 << (8 * depth)) - 1) << 8)).bitwiseOR(F.col("node").bitwiseAND(255))
    return level.withColumn("_up", up).join(state.withColumnRenamed("node", "_node"), F.col("_up") == F.col("_node")).drop("_up", "_node")


def _top(keys: np.ndarray, top: int) -> np.ndarray:
    return (keys >> 8) & ((1 << (8 * top)) - 1)


def _bucket(context: np.ndarray, n: int) -> np.ndarray:
    return ((context * 2654435761) & 0xFFFFFFFF) % n


def _bucket_column(context: Column, n: int) -> Column:
    return F.pmod((context * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.lit(n)).cast("int")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    order = np.argsort(keys, kind="stable")  # quick, as the parts are sorted
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n, first) if len(n) else n


class _Counts:
    """Distinct numbers by bucket, and how often they were learned from."""

    def __init__(self, bucket):
        self.bucket = bucket
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = self.folded = 0

    def add(self, keys: np.ndarray, learn: bool) -> None:
        some, n = np.unique(keys, return_counts=True)
        if not learn:
            n = np.zeros(len(n), np.int64)
        for b, i in _split(self.bucket(some)):
            self.parts.setdefault(b, []).append((some[i], n[i]))
        self.size += len(some)
        if self.size > 1_000_000 + self.folded:
            self.parts = {b: [_merged(parts)] for b, parts in self.parts.items()}
            self.size, self.folded = 0, sum(len(p[0][0]) for p in self.parts.values())

    def packed(self) -> Iterator[tuple[int, bytes]]:
        for b, parts in self.parts.items():
            yield b, packed(*_merged(parts))


ASKED = "kind int, bucket int, chunk long, blob binary"
STRING, WORD = 0, 1


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its numbers, in order."""
    order = np.argsort(bucket.astype(np.int32), kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        if len(some):
            yield int(bucket[some[0]]), some


def _buckets(kind: int, top: int, n: int):
    """The function from numbers to their buckets."""
    return (lambda keys: _bucket(_top(keys, top), n)) if kind == STRING else (lambda keys: keys % n)


def _ask(depth: int, top: int, n_buckets: int):
    """The lists of the chunks that a task reads; they are handed on whenever HELD numbers have been gathered."""

    def rows(seen: dict[int, tuple[_Counts, _Counts]]) -> Iterator[pa.RecordBatch]:
        for chunk, counts in seen.items():
            for kind, some in ((STRING, counts[0]), (WORD, counts[1])):
                found = [(kind, b, chunk, blob) for b, blob in some.packed()]
                columns = zip(zip(*found), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["kind", "bucket", "chunk", "blob"])
        seen.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[_Counts, _Counts]] = {}
        for batch in batches:
            chunks, held = batch.column("chunk").to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False)
            for chunk in np.unique(chunks).tolist():
                of_strings, of_words = seen.setdefault(chunk, tuple(_Counts(_buckets(k, top, n_buckets)) for k in (STRING, WORD)))
                for learn in (True, False):
                    mask = (chunks == chunk) & (held != learn)
                    if not mask.any():
                        continue
                    of_words.add(np.full(int(mask.sum()), END, np.int64), learn)
                    for hashes, _, keys, _, _ in indexed(batch.column("text").filter(pa.array(mask)), depth):
                        of_words.add(hashes, learn)
                        of_strings.add(keys, learn)
            if sum(c.size + c.folded for pair in seen.values() for c in pair) > HELD:
                yield from rows(seen)
        yield from rows(seen)

    return run


def _totals(blobs: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of a bucket's lists and their counts. Lists are unpacked one by one, and merged once they
    are as long together as what has been merged, or half of HELD."""
    parts, size, merged = [], 0, 0
    for blob in blobs:
        parts.append(tuple(unpacked(blob.as_buffer(), np.int64, np.int64)))
        size += len(parts[-1][0])
        if size > HELD // 2 + 2 * merged:
            parts = [_merged(parts)]
            size = merged = len(parts[0][0])
    return _merged(parts)


ANSWERS = "kind int, bucket int, chunk long, blob binary, n long, v long"


def _answers(t: pa.Table, kind: int, keys: np.ndarray, values: np.ndarray, n: int = 0, v: int = 0) -> pa.Table:
    """A row for each chunk with the values of all its numbers, whether it asked once or, read in parts, several
    times; the sums n and v stand in the first row."""
    asking: dict[int, list] = {}
    for chunk, blob in zip(t["chunk"].to_pylist(), t["blob"]):
        asking.setdefault(chunk, []).append(blob)

    def answer(blobs: list) -> bytes:
        asked = _totals(blobs)[0]
        return packed(asked, values[np.searchsorted(keys, asked)])

    rows = len(asking)
    return pa.table(
        {
            "kind": np.full(rows, kind, np.int32),
            "bucket": np.full(rows, t["bucket"][0].as_py(), np.int32),
            "chunk": pa.array(list(asking), pa.int64()),
            "blob": pa.array([answer(blobs) for blobs in asking.values()], pa.binary()),
            "n": np.array([n] + [0] * (rows - 1)),
            "v": np.array([v] + [0] * (rows - 1)),
        }
    )


def _word_answers(t: pa.Table) -> pa.Table:
    keys, n = _totals(t["blob"])
    return _answers(t, WORD, keys, n.astype(np.float64), int(n.sum()), int((n > 0).sum()))


def string_answers(asked: DataFrame, depth: int, top: int, n_buckets: int, piece: int = PIECE) -> DataFrame:
    """asked(bucket, chunk, blob) with strings and their counts -> ANSWERS, the log probabilities of their last bytes."""

    def nodes(t: pa.Table) -> pa.Table:
        keys, n = _totals(t["blob"])
        out = []
        for j in range(8):
            number, n0, n1, weighted = Tree(keys, n, depth, top, j, piece).nodes
            out.append(pa.table({"node": number, "n0": n0, "n1": n1, "weighted": weighted}))
        return pa.concat_tables(out)

    def evaluated(t: pa.Table, states: pa.Table) -> pa.Table:
        keys, n = _totals(t["blob"])
        order = np.argsort(states["node"].to_numpy())
        node, *state = (states[c].to_numpy()[order] for c in ("node", "so_far", "left", "last"))
        total = np.zeros(len(keys))
        for j in range(8):
            tree = Tree(keys, n, depth, top, j, piece)
            at = np.searchsorted(node, tree.nodes[0])
            total += tree.log10(tuple(s[at] for s in state))
        return _answers(t, STRING, keys, total)

    at_top = written(asked.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(nodes, NODE), "ctw-nodes")
    state = _upper(at_top, top).withColumn("bucket", _bucket_column(F.shiftright("node", 8), n_buckets))
    asked, state = (df.repartition(n_buckets, "bucket") for df in (asked, state))
    return asked.groupBy("bucket").cogroup(state.groupBy("bucket")).applyInArrow(evaluated, ANSWERS)


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """chunk, and a compressed batch of its rows."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        chunks = batch.column("chunk").to_numpy()
        found = np.unique(chunks)
        blobs = []
        for chunk in found:
            some = batch.select(["doc_id", "held_out", "text"]).filter(pa.array(chunks == chunk))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                out.write_batch(some)
            blobs.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "blob"])


def _lookup(answers: pa.Table, kind: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By bucket, the numbers that were asked for, sorted, and their values."""
    some = answers.filter(pc.equal(answers["kind"], kind))
    return {b: tuple(unpacked(blob.as_buffer(), np.int64, np.float64)) for b, blob in zip(some["bucket"].to_pylist(), some["blob"])}


def _values(asked: np.ndarray, table: dict[int, tuple[np.ndarray, np.ndarray]], bucket) -> np.ndarray:
    """Values of numbers that are all in the table."""
    some, at = np.unique(asked, return_inverse=True)
    out = np.empty(len(some))
    for b, i in _split(bucket(some)):
        keys, values = table[b]
        out[i] = values[np.searchsorted(keys, some[i])]
    return out[at]


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of successive runs of so many values, each run by itself."""
    out = np.zeros(len(counts))
    there = counts > 0
    if there.any():
        out[there] = np.add.reduceat(values, (np.cumsum(counts) - counts)[there])
    return out


def _score(depth: int, top: int, n_buckets: int, n: int, v: int):
    by_string, by_word = (_buckets(kind, top, n_buckets) for kind in (STRING, WORD))
    norm = math.log10(n + (v + 1))

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        of_words, of_strings = _lookup(answers, WORD), _lookup(answers, STRING)
        end = float(_values(np.array([END]), of_words, by_word)[0])
        tables = []
        for blob in docs["blob"]:
            batch = pa.ipc.open_stream(blob.as_buffer()).read_all().combine_chunks()
            if not batch.num_rows:
                continue
            rows: list[tuple[np.ndarray, ...]] = []
            for hashes, n_words, keys, n_bytes, more in indexed(batch["text"].combine_chunks(), depth):
                counts = _values(hashes, of_words, by_word)
                known = _sums((counts > 0).astype(np.float64), n_words)
                some = n_words.astype(np.int64), known, _sums(np.log10(counts + 1), n_words), _sums(_values(keys, of_strings, by_string), n_bytes), n_bytes
                if more:
                    for last, next_ in zip(rows[-1], some):
                        last[-1] += next_[0]
                else:
                    rows.append(some)
            n_words, known, base, score, n_bytes = (np.concatenate(c) for c in zip(*rows))
            n_tokens, known = n_words + 1, known.astype(np.int64) + (end > 0)
            base += math.log10(end + 1) - n_tokens * norm
            tables.append(
                pa.table(
                    {
                        "doc_id": batch["doc_id"],
                        "held_out": batch["held_out"],
                        "n_tokens": n_tokens.astype(np.int64),
                        "n_known": known,
                        "train_tokens": np.full(len(known), n, np.int64),
                        "base_score": base,
                        "score": score,
                        "n_bytes": n_bytes.astype(np.int64),
                        "bits_per_byte": -score / math.log10(2) / n_bytes,
                    }
                )
            )
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(tables)

    return run


def scored(documents: DataFrame, held_out: Column, chunk: Column | None = None, depth: int = DEPTH, top: int = TOP, bucket_bytes: int = BUCKET_BYTES, piece: int = PIECE) -> DataFrame:
    """documents(doc_id, text) scored by a model of those that aren't held out; see RESULT. base_score is that of
    add-one word frequencies.

    chunk: a number, the same whenever a row is read, of which one has a moderate amount of text; best one that
    rows that are read together share. Without it, rows are dealt by the hash of their id."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(4, math.ceil(size / bucket_bytes))
    if chunk is None:
        chunk = F.pmod(F.xxhash64("doc_id"), F.lit(n_buckets))
    docs = documents.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"), chunk.cast("long").alias("chunk"))
    asked = written(docs.select("text", "held_out", "chunk").mapInArrow(_ask(depth, top, n_buckets), ASKED), "asked")
    of_words = asked.filter(F.col("kind") == WORD).repartition(n_buckets, "bucket")
    of_words = written(of_words.groupBy("bucket").applyInArrow(_word_answers, ANSWERS), "words")
    n, v = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    of_strings = string_answers(asked.filter(F.col("kind") == STRING), depth, top, n_buckets, piece)
    answers = of_words.unionByName(of_strings).select("kind", "bucket", "chunk", "blob")
    texts = docs.mapInArrow(_packed_texts, "chunk long, blob binary")
    # As many partitions as the size asks for, so that no task's share grows with the input.
    texts, answers = (df.repartition(n_buckets, "chunk") for df in (texts, answers))
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(depth, top, n_buckets, n, v), RESULT)
