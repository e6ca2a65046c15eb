"""Largest-inner-product search with one vantage-point tree per shard of candidates.

Inner products become a metric by one more coordinate: with M the largest norm in a shard, x' = (x, sqrt(M^2 - |x|^2))
and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so nearest is largest inner product, and the triangle
inequality prunes. A child is left out when factor * (distance to its shell) exceeds the distance of the current
k-th best; factor 1 is exact, larger factors look at less and may miss some.

The search is a join in blocks of a stated query set with all rows: candidates are dealt into shards of bounded size
by the hash of id and vector, so a task that runs again deals them alike. Each shard's rows come first to the task
that has it, which builds its one tree, then all queries, block by block; each query keeps k rows per shard, of which
the k best remain. A task holds one shard and one block, whatever the size of the input.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or as
candidates; vectors meet only vectors of their length. Repeated vectors and equal scores are all candidates, with
ties to the smaller id; rows that repeat an id are candidates of their own, except that a query never meets rows of
its own id; queries that share an id share one list. Null ids take no part. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_ROWS = 16384
BLOCK_ROWS = 4096
LEAF = 256
#: Kinds of rows of a shard, in the order in which they come.
ROW, QUERY = 0, 1
PAIRS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Relative slack for rounding in distances, so that factor 1 never loses a tie.
SLACK = 1e-9


class Best:
    """The k best (score descending, id ascending) of each of n queries."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = queries, ids, k
        self.score = np.full((len(ids), k), -np.inf)
        self.vec = np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, x: np.ndarray, x_ids: np.ndarray) -> None:
        """Offers the vectors x to the queries in rows. A fast product finds what may enter; what does enter is
        summed component by component, so equal vectors get equal scores."""
        fast = self.q[rows] @ x.T
        kth = self.score[rows, -1]
        slack = SLACK * (1 + np.abs(fast).max(initial=0.0))
        at, of = np.nonzero((fast >= kth[:, None] - slack) & (x_ids[None, :] != self.ids[rows][:, None]))
        if not len(at):
            return
        a, b = self.q[rows[at]], x[of]
        exact = np.zeros(len(at))
        for j in range(a.shape[1]):
            exact += a[:, j] * b[:, j]
        touched, slot = np.unique(at, return_inverse=True)
        mine = rows[touched]
        n, k = len(mine), self.k
        owner = np.concatenate([np.repeat(np.arange(n), k), slot])
        score = np.concatenate([self.score[mine].ravel(), exact])
        vec = np.concatenate([self.vec[mine].ravel(), x_ids[of]])
        order = np.lexsort((vec, -score, owner))
        first = np.searchsorted(owner[order], np.arange(n))
        keep = order[(first[:, None] + np.arange(k)[None, :]).ravel()]
        self.score[mine] = score[keep].reshape(n, k)
        self.vec[mine] = vec[keep].reshape(n, k)


    def pairs(self) -> pa.Table:
        found = np.isfinite(self.score)
        return pa.table({"query_id": self.ids[np.nonzero(found)[0]], "vec_id": self.vec[found], "score": self.score[found]}, schema=PAIRS)


class Tree:
    """A vantage-point tree over the rows of x (already with the extra coordinate apart, in `up`)."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.x, self.ids, self.leaf = x, ids, leaf
        norms = np.einsum("ij,ij->i", x, x)
        self.m2 = norms.max(initial=0.0)
        self.up = np.sqrt(np.maximum(self.m2 - norms, 0.0))
        self.rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(ids)))

    def _between(self, i: int, rows: np.ndarray) -> np.ndarray:
        d2 = ((self.x[rows] - self.x[i]) ** 2).sum(1) + (self.up[rows] - self.up[i]) ** 2
        return np.sqrt(d2)

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        vantage = rows[self.rng.integers(len(rows))]
        d = self._between(vantage, rows)
        cut = np.median(d)
        near = d <= cut
        if near.all():  # all at one distance, such as copies of one vector: halves by place, with no shell to prune
            half = len(rows) // 2
            return (vantage, 0.0, np.inf, self._build(rows[:half]), 0.0, np.inf, self._build(rows[half:]))
        inside, outside = rows[near], rows[~near]
        return (vantage, 0.0, d[near].max(), self._build(inside), d[~near].min(), d.max(), self._build(outside))

    def search(self, best: Best, factor: float = 1.0) -> None:
        q2 = np.einsum("ij,ij->i", best.q, best.q)
        scale = np.sqrt(q2 + self.m2) + 1e-30

        def visit(node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                best.add(rows, self.x[node], self.ids[node])
                return
            vantage, *shells = node
            to = np.sqrt(np.maximum(q2[rows] + self.m2 - 2 * (best.q[rows] @ self.x[vantage]), 0.0))
            nearer_in = to - shells[1] <= shells[3] - to
            for mask, order in ((nearer_in, (0, 1)), (~nearer_in, (1, 0))):
                some, d = rows[mask], to[mask]
                for side in order:
                    low, high, child = shells[3 * side : 3 * side + 3]
                    gap = np.maximum(np.maximum(low - d, d - high), 0.0)
                    reach = np.sqrt(np.maximum(q2[some] + self.m2 - 2 * best.score[some, -1], 0.0))
                    # |d - shell| bounds the true distance from below; the slack covers rounding in the roots.
                    visit(child, some[factor * gap <= reach + 1e-7 * scale[some]])

        visit(self.root, np.arange(len(best.ids)))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks()
    flat = flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    n = len(vectors)
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def searched(queries: pa.Table, rows: pa.Table, k: int, factor: float, leaf: int = LEAF) -> pa.Table:
    """One block of queries against one shard: at most k rows a query."""
    if not queries.num_rows or not rows.num_rows:
        return PAIRS.empty_table()
    best = Best(_matrix(queries["embedding"]), queries["vec_id"].to_numpy(), k)
    Tree(_matrix(rows["embedding"]), rows["vec_id"].to_numpy(), leaf).search(best, factor)
    return best.pairs()


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that has a direction; single-precision vectors travel as such."""
    kind = vectors.schema["embedding"].dataType
    numbers = "array<float>" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "array<double>"
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf)))
    return vectors.select("vec_id", F.col("embedding").cast(numbers).alias("embedding")).filter(
        F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    )


def _walk(k: int, factor: float, block_rows: int, leaf: int = LEAF):
    """Sorted rows (width, shard, kind, ...) of whole shards, candidates before queries -> PAIRS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree = None, None
        rows: list[pa.RecordBatch] = []
        queries: list[pa.RecordBatch] = []

        def searched() -> Iterator[pa.RecordBatch]:
            if queries and tree is not None:
                block = pa.Table.from_batches(queries)
                best = Best(_matrix(block["embedding"]), block["vec_id"].to_numpy(), k)
                tree.search(best, factor)
                yield from best.pairs().to_batches()
            queries.clear()

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("width", "shard", "kind")]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in keys])) + 1
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                shard, kind = (keys[0][lo], keys[1][lo]), keys[2][lo]
                if shard != at:
                    yield from searched()
                    at, tree, rows = shard, None, []
                some = batch.slice(lo, hi - lo)
                if kind == ROW:
                    rows.append(some)
                    continue
                if rows:
                    table = pa.Table.from_batches(rows)
                    tree, rows = Tree(_matrix(table["embedding"]), table["vec_id"].to_numpy(), leaf), []
                queries.append(some)
                if sum(q.num_rows for q in queries) >= block_rows:
                    yield from searched()
        yield from searched()

    return run


def nearest(
    queries: DataFrame, rows: DataFrame, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of each query with the largest inner product."""
    queries, rows = usable(queries).dropDuplicates(), usable(rows)
    n_shards = max(1, math.ceil(rows.count() / shard_rows))
    width = F.size("embedding").alias("width")
    shards = F.sequence(F.lit(0).cast("bigint"), F.lit(n_shards - 1).cast("bigint"))
    candidates = rows.select(width, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_shards)).alias("shard"), F.lit(ROW).alias("kind"), "vec_id", "embedding")
    asking = queries.select(width, F.explode(shards).alias("shard"), F.lit(QUERY).alias("kind"), "vec_id", "embedding")
    met = candidates.unionByName(asking).repartition(n_shards, "width", "shard").sortWithinPartitions("width", "shard", "kind")
    pairs = met.mapInArrow(_walk(k, factor, block_rows), "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
