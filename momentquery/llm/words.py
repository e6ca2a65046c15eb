"""Words of many texts at once: places and hashes, as array operations on one run of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M1, _M2, ODD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(ODD), -1, 2**64))
#: A-Z to a-z; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240311).integers(0, 2**64, 256, dtype=np.uint64)[LOWER]
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Bytes that are looked at together.
PIECE = 1 << 19
#: Powers of the multiplier's inverse and of itself, as far as they were needed.
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_INVERSE, ODD)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def spans(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Successive texts of about `size` bytes together: the number of the first, their bytes, and where each text
    begins in these (and the end). Null texts are empty."""
    texts = texts.cast(pa.binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    x = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
        yield lo, x[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def found(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words (runs of other than ASCII white space) of the texts x[at[i]:at[i + 1]]: where each begins and
    ends, its hash with A-Z in lower case, and the number of each text's first word (and the end).

    A word's hash sums byte values times powers that make it independent of the word's place. Long texts are looked
    at in pieces that end with white space."""
    parts, lo = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))], 0
    while lo < len(x):
        hi = cut(x, lo)
        edges = at[np.searchsorted(at, lo) : np.searchsorted(at, hi, side="right")] - lo
        start, stop, hashes = _found(x[lo:hi], edges)
        parts.append((start + lo, stop + lo, hashes))
        lo = hi
    start, stop, hashes = (np.concatenate(c) for c in zip(*parts))
    return start, stop, hashes, np.searchsorted(start, at)


def cut(x: np.ndarray, lo: int) -> int:
    """Where a piece of about PIECE bytes from lo on ends, behind white space or with x."""
    hi = lo + PIECE
    if hi >= len(x):
        return len(x)
    spaces = np.flatnonzero(SPACE[x[lo:hi]])
    if len(spaces):
        return lo + int(spaces[-1]) + 1
    while hi < len(x):  # a very long word
        spaces = np.flatnonzero(SPACE[x[hi : hi + PIECE]])
        if len(spaces):
            return hi + int(spaces[0]) + 1
        hi += PIECE
    return len(x)


def _found(x: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """found() in a piece, where words end; edges: where texts begin or end in it."""
    n = len(x)
    inverse, power = (p[:n] for p in _up_to(n))
    word = ~SPACE[x]
    edge = np.zeros(n + 1, bool)
    edge[edges] = edge[0] = edge[n] = True
    start = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    stop = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[x] * inverse, dtype=np.uint64)])
    return start, stop, mixed((total[stop] - total[start]) * power[start] + (stop - start).astype(np.uint64))
