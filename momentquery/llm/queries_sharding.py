"""Query op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sharding as sh
from .common import fresh_path, table, written

N_SHARDS = 16


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    records = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    # The checksum spreads rows without an id, or with the same one.
    records = records.withColumn("virtual_slot", sh.virtual_slot(F.col("doc_id"), F.col("text_crc32")))
    path = fresh_path(spark, "slot-map")
    sizes = written(sh.slot_sizes(records), "slot-sizes")
    first = sh.stored_map(sh.first_map(spark, N_SHARDS), path, 0)
    second = sh.stored_map(sh.edited_map(sizes, first, N_SHARDS), path, 1)
    out = sh.sharded(records, ["doc_id", "size", "text_crc32"], second.drop("moved"), sizes)
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("placed.shard").cast("int").alias("shard"),
        "placed.slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "placed.map_version",
    )


QUERIES = {"op10_virtual_slots": op10_virtual_slots}
ORACLE: dict[str, str] = {}
