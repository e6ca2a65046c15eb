"""Query op9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import digest
from .common import table


def op9_improbable_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rank = digest.ranks(digest.entropy_counts(documents))
    return digest.compared(digest.in_sequence(documents), rank)


QUERIES = {"op9_improbable_features": op9_improbable_features}
ORACLE: dict[str, str] = {}
