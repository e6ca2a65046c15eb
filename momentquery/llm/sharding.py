"""Fixed virtual slots: records hash into thousands of slots, and a versioned map says which shard owns a slot.

A record's slot never changes. Only the map does: it is stored as one folder per version, and rebalancing reads
the latest version, edits as few rows as the bytes per slot ask for, and writes the next one. Everything runs as
DataFrame and SQL functions; what is folded in one row is the map, whose length is the number of slots.

Nulls: a null key is left out of the hash, so rows without a key are spread by the other columns that are hashed;
a null text weighs one byte and has the checksum of the empty string. Repeated rows share a slot and get places of
their own in it. An empty table gives an empty result and a map of empty slots. sharded() keeps all columns as they
are; what it adds is one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh

N_SLOTS = 8192


def virtual_slot(*key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n_slots)).cast("int")


def slot_sizes(records: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """records(virtual_slot, size) -> every slot's bytes and rows, empty slots included."""
    spark = records.sparkSession
    found = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))
    every = spark.range(n_slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "n_rows"])


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt out evenly, without a look at any data."""
    slot = F.col("id").cast("int")
    return spark.range(n_slots).select(slot.alias("virtual_slot"), (slot % n_shards).alias("shard"))


def edited_map(sizes: DataFrame, current: DataFrame, n_shards: int, into: int | None = None) -> DataFrame:
    """The current map after one pass of moves, heaviest slot first.

    A slot leaves its shard for the lightest one (or for shard `into`, which is how a new shard is filled) when
    that leaves the receiver lighter than the giver was. Returns virtual_slot, shard, moved. What is folded are the
    shards' loads; only slots that move are gathered.
    """
    rows = sizes.join(F.broadcast(current), "virtual_slot").select("virtual_slot", "bytes", "shard")
    packed = rows.agg(F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "virtual_slot", "shard"))).alias("s"))
    target = f"{into}" if into is not None else "cast(array_position(acc.load, array_min(acc.load)) - 1 as int)"
    # The new shard starts empty, so it takes slots only until it holds an equal share.
    better = "element_at(acc.load, to + 1) - x.minus < element_at(acc.load, x.shard + 1)"
    if into is not None:
        better += f" and element_at(acc.load, to + 1) - x.minus <= acc.total / {n_shards}"
    moves = packed.selectExpr(
        f"""aggregate(
            s,
            named_struct(
                'load', transform(sequence(0, {n_shards - 1}), i -> aggregate(s, 0L, (t, x) -> t - if(x.shard = i, x.minus, 0L))),
                'total', aggregate(s, 0L, (t, x) -> t - x.minus),
                'plan', cast(array() as array<struct<virtual_slot: int, to: int>>)),
            (acc, x) -> aggregate(
                array({target}), acc,
                (a, to) -> if({better},
                    named_struct(
                        'load', transform(acc.load, (l, i) -> l + if(i = x.shard, x.minus, 0L) - if(i = to, x.minus, 0L)),
                        'total', acc.total,
                        'plan', concat(acc.plan, array(named_struct('virtual_slot', x.virtual_slot, 'to', to)))),
                    acc))
        ).plan as plan"""
    ).select(F.inline("plan"))
    kept = current.select("virtual_slot", "shard").join(F.broadcast(moves), "virtual_slot", "left")
    return kept.select("virtual_slot", F.coalesce("to", "shard").alias("shard"), F.col("to").isNotNull().alias("moved"))


def stored_map(map_rows: DataFrame, path: str, version: int) -> DataFrame:
    """Writes one version of the map and reads it back, with its version as a column."""
    spark = map_rows.sparkSession
    map_rows.coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")
    return read_map(spark, path, version)


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}").withColumn("map_version", F.lit(version))


def sharded(records: DataFrame, order: list[str], slot_map: DataFrame, sizes: DataFrame, into: str = "placed") -> DataFrame:
    """records(virtual_slot, ...) with one more column, fresh(into): a struct of shard, map_version and slot, the row's
    place in its shard.

    Places are gapless from 0: slots of a shard follow each other by number, and rows in a slot by `order`.
    Only the rows of one virtual slot are ever ordered together.
    """
    placed = sizes.join(F.broadcast(slot_map), "virtual_slot").select(
        F.col("virtual_slot").alias("_slot"),
        "shard",
        "map_version",
        (F.sum("n_rows").over(W.partitionBy("shard").orderBy("virtual_slot")) - F.col("n_rows")).alias("before"),
    )
    name = fresh(into, records.columns)
    at = F.struct(F.col("_slot").alias("virtual_slot"), F.struct("shard", "map_version", "before").alias("of"))
    key = fresh("_virtual_slot", records.columns)
    found = records.join(F.broadcast(placed.select(at.alias(key))), F.col("virtual_slot") == F.col(f"{key}.virtual_slot"))
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy(*order))
    of = F.col(f"{key}.of")
    slot = (of["before"] + within - 1).cast("long")
    return found.withColumn(name, F.struct(of["shard"].alias("shard"), of["map_version"].alias("map_version"), slot.alias("slot"))).drop(key)
