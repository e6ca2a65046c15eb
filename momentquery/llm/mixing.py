"""Temperature mixing of sources, realised as permutations of blocks under a token budget.

A source's weight is its token share to the power a, normalised. The exponent a in [0, 1] is bisected: for a target
entropy, to the a whose weights have it (entropy falls as a grows); for a repetition limit, to the smallest a at
which no source is repeated more often than that (repetition falls as a grows). A source then gets its weight of
the budget: whole epochs over all of its documents, and a last one that stops where the budget does.

Each epoch of a source is a permutation by hash: documents fall into blocks, as many as the square root of the
source's tokens, blocks stand in an order of their own, and documents in a block too. So the last epoch is decided
by the sizes of whole blocks, and only in the one block where the budget ends are documents ordered and summed: either
is about a square root of the source, and no source is ever gathered in one task.

Nulls: a null source is a source of its own; null and empty texts have no tokens, share nothing, and come with
every whole epoch. Sources without tokens come once. Repeated rows have places of their own, in no defined order
among themselves. An empty table gives no rows. All columns are kept as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, named, written

#: Steps of the bisection; the exponent is then exact to 2^-STEPS.
STEPS = 60


@dataclass(frozen=True)
class Share:
    source: str | None
    tokens: int
    weight: float
    budget: float

    @property
    def epochs(self) -> float:
        return self.budget / self.tokens if self.tokens else 1.0


def weights(tokens: dict[str | None, int], exponent: float) -> dict[str | None, float]:
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()}
    norm = math.fsum(raw.values())
    return {s: x / norm for s, x in raw.items()}


def entropy(w: dict[str | None, float]) -> float:
    return -math.fsum(x * math.log(x) for x in w.values() if x > 0)


def repeats(tokens: dict[str | None, int], exponent: float, budget: float | None) -> float:
    """The most epochs of a source; without a budget, one in which the least repeated source is seen once."""
    w = weights(tokens, exponent)
    per = [w[s] / n for s, n in tokens.items() if n]
    return max(per) * (budget if budget is not None else 1 / min(per))


def bisected(tokens: dict[str | None, int], *, target_entropy: float | None = None, limit: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1]: the largest with the target entropy or more, or the smallest within the limit."""
    if target_entropy is not None:
        enough = lambda a: entropy(weights(tokens, a)) < target_entropy - 1e-12  # noqa: E731  flattened too little
    else:
        enough = lambda a: repeats(tokens, a, budget) <= limit
    low, high = 0.0, 1.0
    if target_entropy is None and enough(low):
        return low
    if target_entropy is not None and (enough(low) or not enough(high)):
        return low if enough(low) else high
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if enough(middle) else (middle, high)
    return low if target_entropy is not None else high


def shares(tokens: dict[str | None, int], budget: float | None = None, **target) -> list[Share]:
    """Weights and budgets of all sources. budget None: the least repeated source is seen exactly once."""
    if not sum(tokens.values()):
        return [Share(s, 0, 0.0, 0.0) for s in tokens]
    w = weights(tokens, bisected(tokens, budget=budget, **target))
    total = budget if budget is not None else 1 / min(w[s] / n for s, n in tokens.items() if n)
    return [Share(s, n, w[s], w[s] * total) for s, n in sorted(tokens.items(), key=lambda x: (x[0] is not None, x[0] or ""))]


def n_tokens(text: Column) -> Column:
    """Runs of other than ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_tokens(documents: DataFrame, source: str = "source", tokens: str = "n_tokens") -> dict[str | None, int]:
    """Tokens by source; one row a source comes to the driver, and sources are names, not data."""
    return {r[0]: int(r[1]) for r in documents.groupBy(source).agg(F.coalesce(F.sum(tokens), F.lit(0))).collect()}


def realised(documents: DataFrame, mix: list[Share], source: str = "source", tokens: str = "n_tokens", key: str = "doc_id", seed: int = 0, blocks: int | None = None, into: str = "taken") -> DataFrame:
    """documents once for each time that the mix takes them, with one more column, fresh(into): a struct of epoch, block
    and place. blocks: of each source, if not as many as its tokens ask for.

    (source, epoch, block order, place) is the order of training: block is the block's place in its epoch's
    permutation of blocks, place orders documents in the block.
    """
    spark = documents.sparkSession
    # The rows travel as one struct, so no name of theirs can clash with one of ours.
    rows = documents.select(
        F.struct(*[named(c) for c in documents.columns]).alias("row"), named(key).alias("key"), named(source).alias("source"), named(tokens).alias("n")
    )
    whole = {s.source: math.floor(s.epochs + 1e-9) for s in mix}
    plan = spark.createDataFrame(
        [(s.source, whole[s.source], max(0.0, s.budget - whole[s.source] * s.tokens) if s.tokens else 0.0, blocks or math.isqrt(s.tokens) + 1) for s in mix],
        "_source string, _whole long, _rest double, _blocks long",
    )
    epoch, n = F.col("_epoch"), F.col("n")
    part = F.pmod(F.xxhash64(F.lit(seed), epoch, F.col("key"), F.lit("block")), F.col("_blocks"))
    place = F.xxhash64(F.lit(seed), epoch, F.col("key"), F.lit("place"))
    block = F.xxhash64(F.lit(seed), F.col("_source"), epoch, F.col("_part"), F.lit("order"))

    def by_source(rows: DataFrame, per_source: DataFrame) -> DataFrame:
        """Joins one row a source."""
        return rows.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("_source")))

    # Where the last epoch ends: the block by the sizes of all blocks, then the document by the sizes in that block.
    narrow = by_source(rows.select("key", "source", "n"), plan.filter("_rest > 0")).withColumn("_epoch", F.col("_whole"))
    narrow = written(narrow.filter(n > 0).withColumn("_part", part).withColumn("_block", block).withColumn("_place", place), "mixing")
    blocks_of = narrow.groupBy("_source", "_rest", "_block", "_part").agg(F.sum(n).alias("_size"))
    running = W.partitionBy("_source").orderBy("_block", "_part")
    ends = (
        blocks_of.withColumn("_upto", F.sum("_size").over(running))
        .filter((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_size") <= F.col("_rest")))
        .select(F.col("_source").alias("_of"), F.col("_block").alias("_cut"), F.col("_part").alias("_cut_part"), (F.col("_upto") - F.col("_size")).alias("_before"))
    )
    inside = narrow.join(F.broadcast(ends), F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_part") == F.col("_cut_part")))
    fits = F.col("_before") + F.sum(n).over(W.partitionBy("_of").orderBy("_place", "key")) <= F.col("_rest")
    last = inside.withColumn("_fits", fits).filter("_fits").groupBy("_of").agg(F.max(F.struct(F.col("_place"), F.col("key").alias("_key"))).alias("_last"))
    stops = ends.join(last.withColumnRenamed("_of", "_of2"), F.col("_of").eqNullSafe(F.col("_of2")), "left").drop("_of2")
    full = plan.join(F.broadcast(stops), F.col("_source").eqNullSafe(F.col("_of")), "left")

    taken = (
        by_source(rows, full)
        .withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole"))))
        .withColumn("_part", part)
        .withColumn("_block", block)
        .withColumn("_place", place)
    )
    at, stop = F.struct("_block", "_part"), F.struct(F.col("_cut").alias("_block"), F.col("_cut_part").alias("_part"))
    doc = F.struct(F.col("_place"), F.col("key").alias("_key"))
    before_stop = F.when(F.col("_cut").isNull(), F.lit(True)).otherwise((at < stop) | ((at == stop) & F.coalesce(doc <= F.col("_last"), F.lit(False))))
    taken = taken.filter((epoch < F.col("_whole")) | ((F.col("_rest") > 0) & (n > 0) & before_stop))
    at = F.struct(epoch.alias("epoch"), F.col("_block").alias("block"), F.col("_place").alias("place"))
    return taken.select("row.*", at.alias(fresh(into, documents.columns)))
