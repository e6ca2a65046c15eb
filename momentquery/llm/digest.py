"""Improbable-feature digests: rare byte windows in chained Bloom filters.

A feature is a window of FEATURE bytes. Windows are ranked by how rare their Shannon entropy is in the corpus: a
histogram of quantised entropies over all windows of all texts (a few hundred counts) orders the levels, rarest
first; windows of less than FLOOR bits come after all others. In every run of RUN successive windows the first one
of the best rank gains a point, and windows with POINTS points or more are the digest's features. They go, in the
order of the text, into Bloom filters of BITS bits with HASHES bits a feature; a filter takes PER_FILTER features,
then the next one begins.

Likeness of two filters is (overlap - least) / (most - least), clipped to 0 and 1: overlap counts shared bits, most
is the bit count of the sparser filter, and least is what chance would share plus a CUT part of the rest. Likeness
of two digests is the mean, over the filters of the one with fewer, of the best filter of the other.

Texts of fewer than SHORT * RUN windows have runs of 1 / SHORT of their windows, and need as much of a run for a
feature; texts shorter than FEATURE bytes are one feature themselves. Nulls: a null text is empty; an empty text has a digest
without filters, which is like another one such (1) and unlike all else (0). Equal texts have equal digests.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURE, RUN, POINTS = 16, 64, 16
#: Texts of fewer runs than this have shorter runs, so that they have as many features as that.
SHORT = 8
BITS, HASHES, PER_FILTER = 2048, 5, 160
#: Entropy levels a bit; entropies below FLOOR bits rank last.
LEVELS, FLOOR = 64, 1.0
N_LEVELS = int(LEVELS * np.log2(FEATURE)) + 2
CUT = 0.3
#: Bytes of texts that are worked on together, and windows that are looked at together.
CHUNK, PIECE = 1 << 20, 1 << 19
#: Bytes of texts that a bucket of in_sequence() holds on average.
BUCKET_BYTES = 16 << 20

#: n log2 n in units of 2^-32, so that sliding sums are exact and equal windows get equal entropies.
_PART = np.array([0] + [round(c * np.log2(c) * 2**32) for c in range(1, FEATURE + 1)], dtype=np.int64)
_STEP = np.concatenate([[0], np.diff(_PART)])
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWER = np.array([pow(int(_ODD), -k, 2**64) for k in range(FEATURE)], np.uint64)


def _levels(x: np.ndarray) -> np.ndarray:
    """The entropy level of the window that begins at each place (the last FEATURE - 1 places have none)."""
    n = len(x)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for lag in range(1, FEATURE):
        same = (x[lag:] == x[:-lag]).view(np.uint8)
        before[lag:] += same
        after[:-lag] += same
    # Moving on by one, the byte that leaves was one of after + 1 equal ones, the one that enters is one of before + 1.
    moves = _STEP[before[FEATURE:].astype(np.int64) + 1] - _STEP[after[: n - FEATURE].astype(np.int64) + 1]
    first = int(_PART[np.bincount(x[:FEATURE], minlength=256)].sum())
    total = np.concatenate([[first], first + np.cumsum(moves)])
    bits = np.log2(FEATURE) - total / (2.0**32 * FEATURE)
    return np.clip((bits * LEVELS + 1e-9).astype(np.int32), 0, N_LEVELS - 1)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, and where each begins (and the end)."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), at


def _inside(at: np.ndarray, lo: int, hi: int, width: int) -> np.ndarray:
    """Whether the `width` places from each of the places lo to hi on lie in one text."""
    place = np.arange(lo, hi)
    return place + width <= at[np.searchsorted(at, place, side="right")]


def histogram(texts: list[bytes]) -> np.ndarray:
    """How many windows have each entropy level."""
    counts = np.zeros(N_LEVELS, np.int64)
    for some in _chunks(texts):
        x, at = _joined(some)
        for lo in range(0, len(x) - FEATURE + 1, PIECE):
            levels = _levels(x[lo : lo + PIECE + FEATURE - 1])
            counts += np.bincount(levels[_inside(at, lo, lo + len(levels), FEATURE)], minlength=N_LEVELS)
    return counts


def ranks(counts: np.ndarray) -> np.ndarray:
    """Each level's rank, 0 the rarest that occurs; levels below FLOOR rank last, commonest of them at the end."""
    low = np.arange(N_LEVELS) < FLOOR * LEVELS
    order = np.lexsort((np.arange(N_LEVELS), counts, low))
    out = np.empty(N_LEVELS, np.int64)
    out[order] = np.arange(N_LEVELS)
    return out


def _chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    some: list[bytes] = []
    size = 0
    for t in texts:
        if some and size + len(t) > CHUNK:
            yield some
            some, size = [], 0
        some.append(t)
        size += len(t)
    if some:
        yield some


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return key


def _selected(x: np.ndarray, rank: np.ndarray, run: int) -> np.ndarray:
    """Places of a text's windows with points enough. Runs are looked at PIECE at once."""
    n_runs = len(x) - FEATURE + 1 - run + 1
    places, points = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, n_runs, PIECE):
        hi = min(n_runs, lo + PIECE)
        levels = _levels(x[lo : hi + run - 1 + FEATURE - 1])
        key = (rank[levels] << 40) | np.arange(lo, lo + len(levels))
        best = _sliding_min(key, run) & ((1 << 40) - 1)
        # The first best place of a sliding run never moves back, so its points are a run of equal places.
        starts = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
        won = np.diff(np.concatenate([starts, [len(best)]]))
        if len(places[-1]) and places[-1][-1] == best[0]:
            points[-1][-1] += won[0]
            starts, won = starts[1:], won[1:]
        if len(starts):
            places.append(best[starts])
            points.append(won)
    place = np.concatenate(places)
    enough = np.concatenate(points) >= max(1, run * POINTS // RUN)
    return place[enough] if enough.any() else place[:1]


def _hashed(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the windows at some places."""
    h = np.zeros(len(places), np.uint64)
    for k in range(FEATURE):
        h += _BYTE[x[places + k]] * _POWER[k]
    return _mixed(h)


def features(texts: list[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The hashed features of each text, in its order. No window reaches beyond its text."""
    return [_features(np.frombuffer(t, np.uint8), rank) for t in texts]


def _features(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    windows = len(x) - FEATURE + 1
    if not len(x):
        return np.zeros(0, np.uint64)
    if windows < 1:
        return np.array([int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little")], np.uint64)
    return _hashed(x, _selected(x, rank, RUN if windows >= SHORT * RUN else max(1, windows // SHORT)))


def filters(hashes: np.ndarray) -> np.ndarray:
    """Chained Bloom filters as rows of 0 and 1; a feature that is there already is not counted again."""
    if not len(hashes):
        return np.zeros((0, BITS), np.uint8)
    _, first = np.unique(hashes, return_index=True)
    hashes = hashes[np.sort(first)]
    out = np.zeros((-(-len(hashes) // PER_FILTER), BITS), np.uint8)
    row = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        out[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of two chains of filters, 0 to 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b) and np.array_equal(a, b):
        return 1.0
    fa, fb = a.astype(np.float32), b.astype(np.float32)
    na, nb = fa.sum(1)[:, None], fb.sum(1)[None, :]
    shared = fa @ fb.T
    most = np.minimum(na, nb)
    chance = na * nb / BITS
    least = chance + CUT * (most - chance)
    like = np.clip((shared - least) / np.maximum(most - least, 1e-9), 0.0, 1.0)
    # Chains of equal length are compared either way, so that likeness doesn't depend on the order.
    down = like.max(1).mean()
    return float((down + like.max(0).mean()) / 2 if len(a) == len(b) else down)


def packed(chain: np.ndarray) -> str:
    """Number of filters, then their bits in base 64."""
    return f"{len(chain)}:" + base64.b64encode(np.packbits(chain, axis=1).tobytes()).decode() if len(chain) else "0:"


def unpacked(text: str) -> np.ndarray:
    n, _, bits = text.partition(":")
    raw = np.frombuffer(base64.b64decode(bits), np.uint8)
    return np.unpackbits(raw.reshape(int(n), -1), axis=1) if int(n) else np.zeros((0, BITS), np.uint8)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def entropy_counts(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Window counts by entropy level over all texts: N_LEVELS numbers come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_LEVELS, np.int64)
        for batch in batches:
            total += histogram(_texts(batch.column(0)))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], ["level", "n"])

    rows = documents.select(text).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n"))
    out = np.zeros(N_LEVELS, np.int64)
    for r in rows.collect():
        out[r.level] = r.n
    return out


def in_sequence(documents: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, text, bucket, halo: partitions hold whole buckets, each sorted by descending id, and after a bucket's
    rows comes a halo row, the first row of the next bucket that has any (after the last: of the first).

    Buckets are successive and of about the same number of rows, as many as the bytes of all texts ask for; their
    bounds are those of a range partitioning of ids and text hashes, so neither an outlying id nor one that many rows
    share makes a large bucket. What is gathered are two bounds a bucket. Null ids count as the smallest; ties in id
    are ordered by the text's hash, then by the text.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // bucket_bytes))
    # Ascending: the complement of the id turns the order round without overflow.
    a, b = F.bitwise_not(F.coalesce("doc_id", F.lit(-(2**63)))).alias("a"), F.xxhash64("text").alias("b")

    def gathered(keys: DataFrame, of: Column, pick) -> tuple[np.ndarray, ...]:
        found = keys.groupBy(of.alias("_of")).agg(pick(F.struct("a", "b")).alias("_at")).select("_of", "_at.a", "_at.b").toArrow()
        found = tuple(found[c].to_numpy() for c in ("a", "b", "_of"))
        order = np.lexsort(found[1::-1])
        return tuple(c[order] for c in found)

    last_a, last_b, _ = gathered(rows.select(a, b).repartitionByRange(n, "a", "b"), F.spark_partition_id(), F.max)

    @F.arrow_udf(T.LongType())
    def bucket(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array(_rank_of(last_a[:-1], last_b[:-1], a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)))

    dealt = rows.select("doc_id", "text", a, b).withColumn("bucket", bucket("a", "b"))
    head_a, head_b, order = gathered(dealt.select("a", "b", "bucket"), F.col("bucket"), F.min)
    heads = pa.table({"_bucket": order, "_before": np.roll(order, 1), "_a": head_a, "_b": head_b})
    heads = documents.sparkSession.createDataFrame(heads)  # a row a bucket
    marked = dealt.join(F.broadcast(heads), F.col("bucket") == F.col("_bucket"))
    head = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
    ahead = F.struct(F.col("_before").alias("bucket"), F.lit(True).alias("halo"))
    spread = marked.select("doc_id", "text", "a", "b", F.explode(F.when(head, F.array(own, ahead)).otherwise(F.array(own))).alias("_at"))
    spread = spread.select("doc_id", "text", "a", "b", "_at.bucket", "_at.halo")
    return spread.repartition(n, "bucket").sortWithinPartitions("bucket", "halo", "a", "b", "text").drop("a", "b")


def _rank_of(edge_a: np.ndarray, edge_b: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the sorted edges (edge_a, edge_b) come before each (a, b)."""
    low, high = np.searchsorted(edge_a, a, side="left"), np.searchsorted(edge_a, a, side="right")
    for i in np.flatnonzero(low < high):
        low[i] += np.searchsorted(edge_b[low[i] : high[i]], b[i], side="left")
    return low


def edited(text: str, following: str) -> str:
    """The last third of text replaced by the beginning of the following one, as long or shorter."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(sequence: DataFrame, rank: np.ndarray) -> DataFrame:
    """For each text of in_sequence(): its digest, that of the edited text, and the likeness to that and the next."""

    def run(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
        """All rows but the last, which only follows."""
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own = [filters(h) for h in features([t.encode() for t in texts], rank)]
        new = [filters(h) for h in features([t.encode() for t in changed], rank)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([i for i, _ in rows[:-1]], pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
                pa.array([packed(c) for c in own[:-1]]),
                pa.array([packed(c) for c in new]),
                pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, met_halo = 0, False
        for batch in batches:
            for i, t, halo in zip(batch.column("doc_id"), batch.column("text"), batch.column("halo")):
                halo = halo.as_py()
                if halo and met_halo:
                    continue  # ties of the next bucket's first id: only the first of them follows
                text = t.as_py()
                held.append((i.as_py(), text))
                size += len(text)
                if halo or size > CHUNK:
                    if len(held) > 1:
                        yield run(held)
                    held = [] if halo else held[-1:]
                    size = 0
                met_halo = halo

    return sequence.select("doc_id", "text", "halo").mapInArrow(walk, RESULT)
