"""Query op6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table
from .labelled import held_out


def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = toxicity.fit(documents, labels)
    scored = toxicity.score(documents.select("doc_id", "text"), chain)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.spans").alias("n_spans"),
        F.transform("toxicity.spans", lambda s: F.concat_ws("-", s["start"], s["end"])).alias("offsets"),
    )


QUERIES = {"op6_toxic_spans": op6_toxic_spans}
ORACLE: dict[str, str] = {}
