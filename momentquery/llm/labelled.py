"""Bounded samples of labelled documents, from which the classifiers learn."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import prepared

#: Bytes of text of a class that are learned from, at most.
BYTES = 8 << 20


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether a document belongs to the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, target: Column, per_class: int, classes: list[int], bytes_per_class: int = BYTES) -> DataFrame:
    """doc_id, text, target of at most per_class documents of each class, from the folds that may be learned from, as many
    as have bytes_per_class together at most; a longer text than that is never learned from.

    Chosen by the smallest hash of doc_id, so the choice doesn't depend on partitions or order. A document with
    several labels counts as the largest, an id with several texts as the smallest of them; null labels, ids and
    texts are left out.
    """
    known = (
        labels.filter(~held_out(F.col("doc_id")))
        .select("doc_id", target.cast("int").alias("target"))
        .na.drop()
        .groupBy("doc_id")
        .agg(F.max("target").alias("target"))
    )
    picked = None
    for c in classes:
        some = known.filter(F.col("target") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    size = F.octet_length("text")
    texts = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (size <= bytes_per_class))
    # At most per_class rows a class are broadcast, and as many texts are grouped.
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "target").agg(F.min("text").alias("text"))
    before = F.sum(size).over(W.partitionBy("target").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return found.withColumn("before", before).filter(F.col("before") <= bytes_per_class).select("doc_id", "text", "target")


def learned(rows: DataFrame, fit: Callable[[list[tuple[str, int]]], object]) -> object:
    """What fit makes of (text, class) in order of doc_id. It runs as one task of an executor, which a lost executor costs
    no more than that; the driver gets the model only. rows: of sample(), whose bounds are also this task's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "target")))]
        model = fit([(text, target) for _, text, target in sorted(docs, key=lambda row: row[0])])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    prepared(rows.sparkSession)
    found = rows.repartition(1).mapInArrow(run, "model binary").first()
    return fit([]) if found is None else pickle.loads(found.model)
