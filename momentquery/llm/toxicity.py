"""Toxic spans and document scores from a linear-chain conditional random field.

Tokens are runs of other than ASCII white space; a token's word is its lower-case form without punctuation at the
ends. A two-state chain (clean, toxic) has weights for features of a token: its word, the word's beginnings and end,
its shape (runs of letters, digits and each other character), the words before and after, and an offset, besides
transitions and starts. It is fitted by its exact gradient on whole texts.

Documents carry the labels, so token labels are made, twice. First, in a toxic document, tokens are toxic whose word,
or its beginning, documents labelled toxic hold so much more often than others that chance among all candidates would
not give it. A chain fitted to these labels then tags the toxic documents itself, by all of its features, and what it
tags is toxic too: the second fit has tokens that the list of words doesn't have, and keeps those of the list. Tokens of
other documents are never toxic. A document's score is a logistic function of its largest toxic marginal's log odds and
of the expected number and share of toxic tokens; spans are runs of tokens with a marginal of one half or more.

Forward and backward sums run over all tokens of many texts as one chain, whose matrix at the beginning of a text
forgets what was before: blocks of the chain are multiplied side by side, and joined.

Nulls: a null or empty text has no tokens, and the score of a text of clean tokens. Without labels of both kinds no
text is toxic. Repeated rows get equal scores; score() keeps all columns as they are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import fresh, named, prepared
from .labelled import learned, sample

#: Documents of each class that the fit looks at, at most.
SAMPLE = 1000
#: A word of the first labels is in toxic documents at least so many times as often as in others, and in so many.
LIFT, SUPPORT = 8.0, 4
#: Documents that hold a feature of the chain, at least.
HELD = 3
#: Standard deviation of the normal prior of features' weights and of the offset's, transitions' and start's, and steps
#: of the two fits.
SPREAD, FREE, ROUNDS = 0.6, 4.0, (30, 20)
#: Clean tokens that are added to a text when its share of toxic ones is taken.
FEW = 20
#: Weights less than this are left out.
LEAST = 0.01
#: Lengths of the beginnings of words that are features beside the words themselves, and of their ends.
PREFIXES, SUFFIX = (3, 4, 5, 6, 7), 3
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
CACHE = 400_000
#: Bytes of text that are tagged together, tokens that the fit works on together, and the bounds of a token's log weight.
SPAN, BLOCK, MOST = 1 << 19, 1 << 16, 30.0
RUNS = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "9"))


def word(token: str) -> str:
    return token.lower().strip(EDGES)


def beginnings(w: str) -> list[str]:
    """A word and its beginnings, the widest last; a star ends a beginning."""
    return [w, *(f"{w[:k]}*" for k in PREFIXES[::-1] if len(w) > k)]


def features(token: str) -> list[str]:
    """What a token's own weights are of."""
    return _features(token, word(token))


def _features(token: str, w: str) -> list[str]:
    shape = "a" if token.isalpha() else token
    if shape is token:
        for run, mark in RUNS:
            shape = run.sub(mark, shape)
    return [*beginnings(w), *([f"*{w[-SUFFIX:]}"] if len(w) > SUFFIX else []), f"#{shape}"]


Steps = tuple[tuple[float, float], tuple[float, float]]


def _grid(x: np.ndarray, rest: float, wide: int) -> np.ndarray:
    """x in columns of `wide`, what is missing filled up."""
    out = np.full(-(-len(x) // wide) * wide, rest)
    out[: len(x)] = x
    return np.ascontiguousarray(out.reshape(-1, wide).T)


def chances(emit: np.ndarray, begins: np.ndarray, steps, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of successive texts: the toxic state's probability, and the four of the step that leads to it
    (from clean to clean, clean to toxic, toxic to clean, toxic to toxic; nothing where a text begins).

    emit: log weight of the toxic state; begins: whether a text begins; steps: log weights [from][to]; start: log weight
    of beginning toxic."""
    n = len(emit)
    if not n:
        return np.zeros(0), np.zeros((4, 0))
    odds = np.exp(np.clip(emit, -MOST, MOST))
    (s00, s01), (s10, s11) = np.exp(np.clip(steps, -MOST, MOST))
    first = math.exp(min(MOST, max(-MOST, start)))
    m00, m01 = np.where(begins, 1.0, s00), np.where(begins, first, s01) * odds
    m10, m11 = np.where(begins, 1.0, s10), np.where(begins, first, s11) * odds
    wide = max(1, math.isqrt(n))
    g00, g01, g10, g11 = _grid(m00, 1.0, wide), _grid(m01, 0.0, wide), _grid(m10, 0.0, wide), _grid(m11, 1.0, wide)
    blocks = g00.shape[1]
    # Each block's product.
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for i in range(wide):
        p00, p01, p10, p11 = p00 * g00[i] + p01 * g10[i], p00 * g01[i] + p01 * g11[i], p10 * g00[i] + p11 * g10[i], p10 * g01[i] + p11 * g11[i]
        norm = 1 / (p00 + p01 + p10 + p11)
        p00, p01, p10, p11 = p00 * norm, p01 * norm, p10 * norm, p11 * norm
    # What reaches each block from before, and from behind.
    into, back = np.empty(blocks), np.empty(blocks)
    f = b = 0.5
    for k, (a, c, d, e) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist())):
        into[k] = f
        zero, one = (1 - f) * a + f * d, (1 - f) * c + f * e
        f = one / (zero + one)
    for k, (a, c, d, e) in zip(range(blocks - 1, -1, -1), zip(p00[::-1].tolist(), p01[::-1].tolist(), p10[::-1].tolist(), p11[::-1].tolist())):
        back[k] = b
        zero, one = a * (1 - b) + c * b, d * (1 - b) + e * b
        b = one / (zero + one)
    forward, behind = np.empty_like(g00), np.empty_like(g00)
    f, b = into, back
    for i in range(wide):
        one, zero = (1 - f) * g01[i] + f * g11[i], (1 - f) * g00[i] + f * g10[i]
        f = forward[i] = one / (zero + one)
    for i in range(wide - 1, -1, -1):
        behind[i] = b
        zero, one = g00[i] * (1 - b) + g01[i] * b, g10[i] * (1 - b) + g11[i] * b
        b = one / (zero + one)
    f, b = forward.T.reshape(-1)[:n], behind.T.reshape(-1)[:n]
    p = f * b / (f * b + (1 - f) * (1 - b))
    before = np.concatenate([[0.5], f[:-1]])
    pair = np.stack([(1 - before) * m00 * (1 - b), (1 - before) * m01 * b, before * m10 * (1 - b), before * m11 * b])
    pair *= np.where(begins, 0.0, 1 / pair.sum(0))
    return p, pair


@dataclass
class Chain:
    """Log weights for the toxic state: of features, of the word before and after, of every token; of transitions
    [from][to], and of starts."""

    words: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    steps: Steps = ((0.0, -4.0), (0.0, 0.0))
    starts: tuple[float, float] = (0.0, -4.0)
    mix: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0)
    before: dict[str, float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)

    def weights(self, token: str) -> tuple[float, float, float]:
        """What a token adds to its own log weight, to the next token's and to the one's before."""
        own, w, total = self.words, word(token), self.other
        for f in _features(token, w):
            if f in own:
                total += own[f]
        return total, self.before.get(w, 0.0), self.after.get(w, 0.0)

    def marginals(self, emit: np.ndarray, begins: np.ndarray) -> np.ndarray:
        return chances(emit, begins, self.steps, self.starts[1] - self.starts[0])[0]

    def scores(self, summary: np.ndarray) -> np.ndarray:
        z = summary @ np.array(self.mix[:-1]) + self.mix[-1]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def emissions(own: np.ndarray, before: np.ndarray, after: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Log weights of tokens from what each adds to its own, the next one's and the one's before."""
    emit = own.copy()
    if len(emit) > 1:
        inner = ~begins[1:]
        emit[1:] += before[:-1] * inner
        emit[:-1] += after[1:] * inner
    return emit


def summaries(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of texts whose tokens are p[first[i]:first[i + 1]]: log odds of the largest marginal, log expected number of toxic
    tokens, log expected share of them, as if FEW clean ones more were there."""
    n = np.diff(first)
    out = np.tile([-12.0, math.log(1e-3), math.log(1e-4)], (len(n), 1))
    there = n > 0
    if there.any():
        most, total = np.maximum.reduceat(p, first[:-1][there]), np.add.reduceat(p, first[:-1][there])
        odds = np.log(np.maximum(most, 1e-12)) - np.log(np.maximum(1 - most, 1e-12))
        out[there] = np.stack([np.clip(odds, -12, 12), np.log(total + 1e-3), np.log(total / (n[there] + FEW) + 1e-4)], 1)
    return out


class Tagger:
    """Scores texts with a chain; keeps the weights of tokens that it has met, up to a bound."""

    def __init__(self, chain: Chain):
        self.chain = chain
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros((0, 3))

    def _weights(self, some: np.ndarray, token) -> np.ndarray:
        """Chain.weights() of sorted distinct hashes; token(i) is the token of the i-th."""
        at = np.minimum(np.searchsorted(self.keys, some), max(0, len(self.keys) - 1))
        known = self.keys[at] == some if len(self.keys) else np.zeros(len(some), bool)
        out = np.empty((len(some), 3))
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = [self.chain.weights(token(i)) for i in new.tolist()]
            if len(self.keys) + len(new) > CACHE:
                self.keys, self.values = some, out
            else:
                keys = np.concatenate([self.keys, some[new]])
                order = np.argsort(keys)
                self.keys, self.values = keys[order], np.concatenate([self.values, out[new]])[order]
        return out

    def _emissions(self, x: np.ndarray, start: np.ndarray, stop: np.ndarray, hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        some, at, of = np.unique(hashes, return_index=True, return_inverse=True)
        table = self._weights(some, lambda i: x[start[at[i]] : stop[at[i]]].tobytes().decode("utf-8", "replace"))[of]
        return emissions(table[:, 0], table[:, 1], table[:, 2], begins)

    def tagged(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, list[list[tuple[int, int, float]]]]]:
        """By spans of texts: scores, and start, end (code points) and largest marginal of each text's toxic spans."""
        for _, x, at in words.spans(texts, SPAN):
            start, stop, hashes, first = words.found(x, at)
            begins = np.zeros(len(start), bool)
            begins[first[:-1][np.diff(first) > 0]] = True
            p = self.chain.marginals(self._emissions(x, start, stop, hashes, begins), begins)
            spans: list[list[tuple[int, int, float]]] = [[] for _ in range(len(at) - 1)]
            toxic = np.flatnonzero(p >= 0.5)
            if len(toxic):
                of = np.searchsorted(first, toxic, side="right") - 1
                for i in np.unique(of).tolist():
                    spans[i] = _spans(x[at[i] : at[i + 1]], start - at[i], stop - at[i], p, toxic[of == i])
            yield self.chain.scores(summaries(p, first)), spans


def _spans(x: np.ndarray, start: np.ndarray, stop: np.ndarray, p: np.ndarray, toxic: np.ndarray) -> list[tuple[int, int, float]]:
    """Runs of the toxic tokens of a text x of bytes."""
    points = np.cumsum((x & 0xC0) != 0x80)  # code points that begin up to each byte
    out = []
    for run in np.split(toxic, np.flatnonzero(np.diff(toxic) > 1) + 1):
        out.append((int(points[start[run[0]]]) - 1, int(points[stop[run[-1]] - 1]), float(p[run].max())))
    return out


def distinct(docs: list[list[str]], labels: list[int]) -> list[int]:
    """Places of docs, without those that share one of three smallest hashes of their word triples with an earlier one
    of their label: near copies, whose words would pass for words that many documents have."""
    kept, met = [], set()
    for i, (ws, label) in enumerate(zip(docs, labels)):
        hashes = np.fromiter((zlib.crc32(" ".join(ws[j : j + 3]).encode()) for j in range(max(1, len(ws) - 2))), np.uint64)
        marks = {(label, k, int(((hashes * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((1, 2654435761, 2246822519))}
        if not marks & met:
            kept.append(i)
        met |= marks
    return kept


def lexicon(docs: list[tuple[set[str], int]]) -> set[str]:
    """Of (words, label): words and beginnings of words that toxic documents hold LIFT times as often as others, and so often that none of
    all candidates would by chance (the likelihood ratio's probability times their number is below one).

    Copies of one toxic document would make toxic words of all its words. So they are first chosen by how many toxic
    documents they newly cover; a further one needs half the weight of the weakest that was chosen so.
    """
    toxic, clean = ([set(ws) for ws, label in docs if label == k] for k in (1, 0))
    if not toxic or not clean:
        return set()
    held = Counter(f for ws in toxic for f in {f for w in ws if w for f in beginnings(w)})
    held = {f: n for f, n in held.items() if n >= min(SUPPORT, len(toxic))}
    # Of other documents only those that may be chosen are counted.
    others = Counter(f for ws in clean for f in {f for w in ws for f in beginnings(w) if f in held})
    lift = {f: math.log((n + 0.5) / (len(toxic) + 1)) - math.log((others[f] + 0.5) / (len(clean) + 1)) for f, n in held.items()}

    def ratio(f: str) -> float:
        n, m = held[f], others[f]
        share = len(toxic) / (len(toxic) + len(clean))
        return 2 * (n * math.log(n / ((n + m) * share)) + (m * math.log(m / ((n + m) * (1 - share))) if m else 0.0))

    lift = {f: x for f, x in lift.items() if x >= math.log(LIFT) and ratio(f) >= 2 * math.log(len(held))}
    weight = {w: held[w] * x for w, x in lift.items()}
    cover: list[str] = []
    left = [s for s in ({f for w in ws for f in beginnings(w) if f in lift} for ws in toxic) if s]
    while left:
        gain = Counter(w for own in left for w in own)
        best = max(gain, key=lambda w: (gain[w] * lift[w], not w.endswith("*"), w))
        if gain[best] < max(SUPPORT, 0.015 * len(toxic)) and cover:
            break
        cover.append(best)
        left = [own for own in left if best not in own]
    least = 0.5 * min((weight[w] for w in cover), default=0.0)
    chosen = {w for w in weight if weight[w] >= least}
    # A beginning that is little but one of the chosen words says nothing of its own.
    told = {f for w in chosen if not w.endswith("*") for f in beginnings(w)[1:] if held[w] >= 0.8 * held.get(f, 0)}
    return chosen - told


@dataclass
class Corpus:
    """Tokens of texts by number, with what they are made of: features (rows of a token's number and a feature's), and
    the words that count as neighbours (-1: one that doesn't)."""

    tokens: np.ndarray
    first: np.ndarray
    begins: np.ndarray
    of: np.ndarray
    feature: np.ndarray
    features: list[str]
    neighbour: np.ndarray
    neighbours: list[str]


def numbered(texts: Iterable[str]) -> tuple[list[np.ndarray], list[str]]:
    """Each text's tokens (A-Z in lower case) as numbers, and the tokens by number."""
    number: dict[bytes, int] = {}
    numbers = [np.array([number.setdefault(t, len(number)) for t in text.encode("utf-8", "replace").lower().split()], np.int32) for text in texts]
    return numbers, [t.decode("utf-8", "replace") for t in number]


def corpus(numbers: list[np.ndarray], types: list[str]) -> Corpus:
    """Of features and neighbours, those that HELD documents have."""
    of, names = [], []
    for i, t in enumerate(types):
        mine = features(t)
        of += [i] * len(mine)
        names += mine
    ids = {f: i for i, f in enumerate(dict.fromkeys(names))}
    of, feature = np.array(of, np.int32), np.array([ids[f] for f in names], np.int32)
    del names
    # How many documents have each feature, by their distinct tokens.
    span = np.searchsorted(of, np.arange(len(types) + 1))
    seen = np.zeros(len(ids), np.int64)
    words_of = [word(t) for t in types]
    known = {w: i for i, w in enumerate(dict.fromkeys(words_of))}
    word_of = np.array([known[w] for w in words_of], np.int32)
    seen_word = np.zeros(len(known), np.int64)
    for own in numbers:
        own = np.unique(own)
        width = span[own + 1] - span[own]
        rows = np.repeat(span[own] - np.cumsum(width) + width, width) + np.arange(width.sum())
        seen[np.unique(feature[rows])] += 1
        seen_word[np.unique(word_of[own])] += 1
    keep, keep_word = seen >= HELD, seen_word >= HELD
    place, rows = np.cumsum(keep) - 1, keep[feature]
    place_word = np.where(keep_word, np.cumsum(keep_word) - 1, -1)
    first = np.concatenate([[0], np.cumsum([len(x) for x in numbers])]).astype(np.int64)
    begins = np.zeros(first[-1], bool)
    begins[first[:-1][np.diff(first) > 0]] = True
    return Corpus(
        np.concatenate([np.zeros(0, np.int32), *numbers]), first, begins, of[rows], place[feature[rows]],
        [f for f, k in zip(ids, keep) if k], place_word[word_of], [w for w, k in zip(known, keep_word) if k],
    )


def blocks(c: Corpus) -> Iterator[slice]:
    """Tokens of successive whole texts, about BLOCK at once."""
    lo = 0
    while lo < len(c.tokens):
        hi = int(c.first[max(np.searchsorted(c.first, lo + BLOCK, side="right") - 1, np.searchsorted(c.first, lo, side="right"))])
        yield slice(lo, hi)
        lo = hi


def _split(theta: np.ndarray, c: Corpus) -> tuple[np.ndarray, ...]:
    """Weights of features, of the word before, of the word after, of every token, of steps, of the start."""
    f, w = len(c.features), len(c.neighbours)
    return theta[:f], theta[f : f + w], theta[f + w : f + 2 * w], theta[f + 2 * w], theta[f + 2 * w + 1 : f + 2 * w + 5].reshape(2, 2), theta[-1]


def _adds(theta: np.ndarray, c: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each kind of token adds to its own log weight, to the next token's, and to the one's before."""
    own, before, after, other, _, _ = _split(theta, c)
    there = c.neighbour >= 0
    b, a = (np.where(there, np.concatenate([x, [0.0]])[c.neighbour], 0.0) for x in (before, after))
    return np.bincount(c.of, own[c.feature], minlength=len(c.neighbour)) + other, b, a


def corpus_emissions(theta: np.ndarray, c: Corpus, at: slice = slice(None)) -> np.ndarray:
    return emissions(*(x[c.tokens[at]] for x in _adds(theta, c)), c.begins[at])


def corpus_chances(theta: np.ndarray, c: Corpus) -> np.ndarray:
    """The toxic state's probability of each token."""
    _, _, _, _, steps, start = _split(theta, c)
    return np.concatenate([np.zeros(0), *(chances(corpus_emissions(theta, c, at), c.begins[at], steps, start)[0] for at in blocks(c))])


def gradient(theta: np.ndarray, c: Corpus, y: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Of the labels' negative log likelihood, added up over blocks of texts. seen: how often each of the four steps is
    in the labels."""
    _, _, _, _, steps, start = _split(theta, c)
    adds, n = _adds(theta, c), len(c.neighbour)
    own, to_next, to_last, pairs, starts = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(4), 0.0
    for at in blocks(c):
        tokens, begins = c.tokens[at], c.begins[at]
        p, pair = chances(emissions(*(x[tokens] for x in adds), begins), begins, steps, start)
        diff = p - y[at]
        own += np.bincount(tokens, diff, minlength=n)
        inner = ~begins[1:]
        # A token's word is the word before of the next token, and the word after of the one before.
        to_next += np.bincount(tokens[:-1], diff[1:] * inner, minlength=n)
        to_last += np.bincount(tokens[1:], diff[:-1] * inner, minlength=n)
        pairs += pair.sum(1)
        starts += diff[begins].sum()
    there = c.neighbour >= 0
    beside = [np.bincount(c.neighbour[there], d[there], minlength=len(c.neighbours)) for d in (to_next, to_last)]
    return np.concatenate([np.bincount(c.feature, own[c.of], minlength=len(c.features)), *beside, [own.sum()], pairs - seen, [starts]])


def _steps_of(y: np.ndarray, begins: np.ndarray) -> np.ndarray:
    step = (2 * y[:-1].astype(int) + y[1:])[~begins[1:]]
    return np.bincount(step, minlength=4).astype(float)


def _descended(theta: np.ndarray, c: Corpus, y: np.ndarray, rounds: int, n_docs: int) -> np.ndarray:
    """Adam's steps on the likelihood and the prior, a document's share of either."""
    seen = _steps_of(y, c.begins)
    m = v = np.zeros_like(theta)
    prior = np.full(len(theta), SPREAD**-2)
    prior[-6:] = FREE**-2
    for k in range(1, rounds + 1):
        g = (gradient(theta, c, y, seen) + prior * theta) / n_docs
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.25 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return theta


def fitted(texts: list[tuple[str, int]]) -> Chain:
    """A chain from (text, 0 or 1)."""
    numbers, types = numbered(text for text, _ in texts)
    words_of, labels = [word(t) for t in types], [label for _, label in texts]
    kept = distinct([[words_of[i] for i in own.tolist()] for own in numbers], labels)
    numbers, labels = [numbers[i] for i in kept], [labels[i] for i in kept]
    lex = lexicon([({words_of[i] for i in own.tolist()}, label) for own, label in zip(numbers, labels)])
    if not lex:
        return Chain()
    c = corpus(numbers, types)
    label = np.repeat(labels, np.diff(c.first)).astype(bool)
    listed = np.array([not lex.isdisjoint(beginnings(w)) for w in words_of], bool)[c.tokens] & label
    at = len(c.features) + 2 * len(c.neighbours)
    theta = np.zeros(at + 6)
    theta[: len(c.features)] = [4.0 if f in lex else 0.0 for f in c.features]
    theta[at:] = [-4.0, 0.0, -3.0, 0.0, 0.0, -3.0]
    theta = _descended(theta, c, listed, ROUNDS[0], len(labels))
    found = label & (corpus_chances(theta, c) >= 0.5)
    theta = _descended(theta, c, listed | found, ROUNDS[1], len(labels))
    own, before, after, other, steps, start = _split(theta, c)
    pick = lambda names, values: {f: float(x) for f, x in zip(names, values) if abs(x) >= LEAST}
    chain = Chain(
        pick(c.features, own), float(other), ((float(steps[0, 0]), float(steps[0, 1])), (float(steps[1, 0]), float(steps[1, 1]))),
        (0.0, float(start)), before=pick(c.neighbours, before), after=pick(c.neighbours, after),
    )
    chain.mix = _calibrated(summaries(corpus_chances(theta, c), c.first), np.array(labels, float))
    return chain


def _calibrated(summary: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Weights of the summary and an offset, by Newton's method with halved steps; classes weigh the same."""
    x = np.concatenate([summary, np.ones((len(y), 1))], 1)
    weight = len(y) * np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    at = np.array([1.0, 0.0, 0.0, 0.0])

    def loss(c: np.ndarray) -> float:
        z = x @ c
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ridge * (c @ c) / 2)

    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        g = x.T @ (weight * (p - y)) + ridge * at
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(at))
        step, size = np.linalg.solve(hess, g), 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    return tuple(float(c) for c in at)


def fit(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> Chain:
    return learned(sample(documents, labels, F.col("toxic"), per_class, [0, 1]), fitted)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())]))


def score(documents: DataFrame, chain: Chain, text: str = "text", into: str = "toxicity") -> DataFrame:
    """documents with one more column, fresh(into): a struct of score (0 to 1) and spans, arrays of start, end and
    largest marginal."""
    result = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)])
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))])

    prepared(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(chain)  # features that HELD of the sample's documents have

    @F.arrow_udf(result)
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tagger = Tagger(shared.value)
        for texts in batches:
            rows = []
            for scores, spans in tagger.tagged(texts):
                rows += [{"score": s, "spans": [{"start": a, "end": b, "marginal": p} for a, b, p in own]} for s, own in zip(scores.tolist(), spans)]
            yield pa.array(rows, kind)

    return documents.select("*", tag(named(text)).alias(fresh(into, documents.columns)))
