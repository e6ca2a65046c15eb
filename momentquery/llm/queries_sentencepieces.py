"""Query op4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sentencepieces
from .common import table


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = sentencepieces.encoded(documents, sentencepieces.load(model_path()))
    return out.select("doc_id", F.coalesce(F.size("coded.pieces"), F.lit(0)).alias("n_pieces"), "coded.pieces", F.col("coded.score").alias("piece_score"), "coded.exact")


QUERIES = {"op4_sentencepieces": op4_sentencepieces}
ORACLE: dict[str, str] = {}
