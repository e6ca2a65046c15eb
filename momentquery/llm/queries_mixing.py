"""Query op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing
from .common import table, written

#: As many tokens as there are, no source more than twice.
LIMIT = 2.0


def op7_temperature_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_tokens(F.col("text")).alias("n_tokens"))
    documents = written(counted, "token-counts")
    tokens = mixing.source_tokens(documents)
    mix = mixing.shares(tokens, budget=float(sum(tokens.values())), limit=LIMIT)
    return mixing.realised(documents, mix).select(*documents.columns, "taken.*")


QUERIES = {"op7_temperature_mixture": op7_temperature_mixture}
ORACLE: dict[str, str] = {}
