"""Query op1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw
from .common import table
from .labelled import held_out

#: Rows of a file that are indexed and scored together.
CHUNK_ROWS = 8192


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    # Rows that lie together in a file are a chunk, so each task gathers the lists of few chunks.
    chunk = F.xxhash64("_metadata.file_path", F.floor(F.col("_metadata.row_index") / CHUNK_ROWS))
    return ctw.scored(documents, held_out(F.col("doc_id"), 7, 2), chunk)


QUERIES = {"op1_context_tree_weighting": op1_context_tree_weighting}
ORACLE: dict[str, str] = {}
