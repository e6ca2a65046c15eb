"""Document quality as an ordinal regression on graded ratings, with one weight vector for all grades.

A cumulative-link model: P(grade >= k) = sigmoid(s - t_k) with t_1 < t_2 < ..., where s is the mean over tokens of
hashed weights, of the word and of its shape (runs of letters, capitals, digits and single other characters), plus
hashed marks of the whole text (how much it repeats itself, how long its words are). The thresholds keep their
order because all but the first are sums of positive steps. Expected grade is the sum of the tail probabilities.

Nulls: a null or empty text has no tokens and only the marks of an empty text. Without ratings of two grades all
tails are one, so nothing is rejected. Repeated rows get equal results; graded() keeps all columns as they
are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, named, prepared
from .labelled import learned, sample

#: Rated documents of each grade that the fit looks at, at most.
SAMPLE = 800
N_WEIGHTS = 1 << 18
CACHE = 150_000
RUNS = ((re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[0-9]+"), "9"))


def shape(token: str) -> str:
    for runs, mark in RUNS:
        token = runs.sub(mark, token)
    return token


def slot(kind: str, value: str) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "surrogatepass")) % N_WEIGHTS


def marks(tokens: list[str]) -> list[str]:
    """Marks of a whole text, in steps of a tenth or so."""
    n = len(tokens)
    if not n:
        return ["empty"]
    distinct = len(set(tokens)) / n
    again = sum(map(str.__eq__, tokens, tokens[1:])) / n
    wide = sum(map(len, tokens)) / n
    return [f"distinct{min(n, 200) // 50}.{int(distinct * 10)}", f"again{math.ceil(again * 10)}", f"wide{min(20, int(wide))}", f"length{n.bit_length()}"]


@dataclass
class Grades:
    """Weights by slot, thresholds in order. No thresholds: nothing is known."""

    weights: np.ndarray
    thresholds: tuple[float, ...]


class Grader:
    def __init__(self, model: Grades):
        self.model, self.seen = model, {}

    def latent(self, text: str | None) -> float:
        weights, seen = self.model.weights, self.seen
        tokens = text.split() if text else []
        if len(seen) > CACHE:
            seen.clear()
        total = 0.0
        for t in tokens:
            w = seen.get(t)
            if w is None:
                w = seen[t] = float(weights[slot("word", t.lower())] + weights[slot("shape", shape(t))])
            total += w
        return (total / len(tokens) if tokens else 0.0) + sum(float(weights[slot("mark", m)]) for m in marks(tokens)) / 4

    def tails(self, text: str | None) -> list[float]:
        """P(grade >= k) for k from 1."""
        s = self.latent(text)
        return [1 / (1 + math.exp(-max(-700.0, min(700.0, s - t)))) for t in self.model.thresholds]


def _rows(docs: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every feature."""
    known: dict[str, tuple[int, int]] = {}
    rows, slots, values = [], [], []
    for i, (text, _) in enumerate(docs):
        tokens = text.split()
        own: dict[int, float] = {}
        for t in tokens:
            if t not in known:
                known[t] = (slot("word", t.lower()), slot("shape", shape(t)))
            for j in known[t]:
                own[j] = own.get(j, 0.0) + 1 / len(tokens)
        for m in marks(tokens):
            own[slot("mark", m)] = own.get(slot("mark", m), 0.0) + 0.25
        rows += [i] * len(own)
        slots += own.keys()
        values += own.values()
    return np.array(rows, np.int64), np.array(slots, np.int64), np.array(values)


@dataclass
class Sample:
    """Features of rated documents, as row, place among the used slots, and value; grades; each document's share."""

    rows: np.ndarray
    places: np.ndarray
    values: np.ndarray
    used: np.ndarray
    grades: np.ndarray
    share: np.ndarray
    n_grades: int


def rated(docs: list[tuple[str, int]], n_grades: int) -> Sample:
    """Grades weigh the same, whatever their numbers."""
    grades = np.array([g for _, g in docs], int)
    rows, slots, values = _rows(docs)
    used, places = np.unique(slots, return_inverse=True)
    n = np.bincount(grades, minlength=n_grades)
    return Sample(rows, places, values, used, grades, 1 / (np.count_nonzero(n) * n.clip(1)[grades]), n_grades)


def _thresholds(cut: np.ndarray) -> np.ndarray:
    """The first one, and the others as sums of positive steps."""
    return np.cumsum(np.concatenate([cut[:1], np.exp(cut[1:])]))


def gradient(theta: np.ndarray, s: Sample) -> np.ndarray:
    """Of the shares' negative log likelihood, by weights and thresholds' parameters."""
    w, cut = theta[: len(s.used)], theta[len(s.used) :]
    n, at = len(s.grades), np.arange(len(s.grades))
    t = _thresholds(cut)
    latent = np.bincount(s.rows, w[s.places] * s.values, minlength=n)
    tail = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(-np.clip(latent[:, None] - t, -40, 40))), np.zeros((n, 1))], axis=1)
    upper, lower = tail[at, s.grades], tail[at, s.grades + 1]
    p = np.maximum(upper - lower, 1e-9)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    gs = -s.share * (du - dl)
    gt = np.zeros(len(t))
    np.add.at(gt, np.maximum(s.grades - 1, 0), np.where(s.grades > 0, s.share * du, 0))
    np.add.at(gt, np.minimum(s.grades, len(t) - 1), np.where(s.grades < s.n_grades - 1, -s.share * dl, 0))
    gc = [gt.sum(), *(math.exp(c) * gt[i + 1 :].sum() for i, c in enumerate(cut[1:]))]
    return np.concatenate([np.bincount(s.places, gs[s.rows] * s.values, minlength=len(s.used)), gc])


def fitted(docs: list[tuple[str, int]], n_grades: int, rounds: int = 120, ridge: float = 3e-5) -> Grades:
    """A model from (text, grade) with grades 0 to n_grades - 1, by gradient steps on all documents."""
    if len({g for _, g in docs}) < 2:
        return Grades(np.zeros(N_WEIGHTS), ())
    sample = rated(docs, n_grades)
    theta = np.concatenate([np.zeros(len(sample.used)), [-1.0], np.zeros(n_grades - 2)])
    m = v = np.zeros_like(theta)
    for k in range(1, rounds + 1):
        g = gradient(theta, sample) + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.3 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    weights = np.zeros(N_WEIGHTS)
    weights[sample.used] = theta[: len(sample.used)]
    return Grades(weights, tuple(float(x) for x in _thresholds(theta[len(sample.used) :])))


def fit(documents: DataFrame, ratings: DataFrame, grade: str, n_grades: int, per_class: int = SAMPLE) -> Grades:
    """ratings(doc_id, and the SQL expression grade: 0 to n_grades - 1, or null)."""
    return learned(sample(documents, ratings, F.expr(grade), per_class, list(range(n_grades))), lambda docs: fitted(docs, n_grades))


def graded(documents: DataFrame, model: Grades, n_grades: int, text: str = "text", into: str = "grade") -> DataFrame:
    """documents with one more column, fresh(into): a struct of expected, the expected grade, and tails, the array of
    P(grade >= k) for k from 1."""
    spark = documents.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(model)  # N_WEIGHTS doubles

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def tails(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grader = Grader(shared.value)
        known = bool(shared.value.thresholds)
        for texts in batches:
            yield pa.array([grader.tails(t) if known else [1.0] * (n_grades - 1) for t in texts.to_pylist()], pa.list_(pa.float64()))

    name = fresh(into, documents.columns)
    rated = documents.select("*", tails(named(text)).alias(name))
    expected = F.aggregate(F.col(name), F.lit(0.0), lambda a, x: a + x)
    return rated.withColumn(name, F.struct(expected.alias("expected"), F.col(name).alias("tails")))
