"""Streams: merging of near events, superseding feedback, and smoothing per key.

Event times must be TIMESTAMP (not TIMESTAMP_NTZ, which watermarks reject). State is per key and time-bounded where
a watermark allows; every stream is written with a checkpoint location of the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..config import OneEuro
from ..operators.camera import euro_step


def merged_events(events: DataFrame, key: str, ts: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """Events of a key at most `gap` apart are one session: key, start, end, n. Works on streams and on tables."""
    w = F.session_window(ts, gap)
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end")).select(key, "start", "end", "n")


#: Buckets of keys of the feedback table; a batch rewrites those that it touches.
BUCKETS = 64


def latest_feedback(feedback: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Keeps the last row by ord of each (job_id, clip_id) in a table that read_feedback() reads.

    A batch reads and writes the buckets of its own keys only, as folders bucket=B/version=N, N being the batch. So one
    that is run again writes the same folders again, and readers of an older version are not disturbed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        from ..operators.profile import latest

        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64("job_id", "clip_id"), F.lit(BUCKETS)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        there = {b: v for b, v in _versions(spark, table_path, batch_id).items() if b in touched}
        if there:
            rows = rows.unionByName(_read(spark, table_path, there, rows.schema))
        merged = latest(rows).drop("first_ord").withColumn("version", F.lit(batch_id))
        if touched:
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(table_path)

    return feedback.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The last version of each bucket, of those before a batch."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket=*/version=*")
    found: dict[int, int] = {}
    for status in at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at) or []:
        bucket, version = (int(x.partition("=")[2]) for x in status.getPath().toString().rstrip("/").split("/")[-2:])
        if before is None or version < before:
            found[bucket] = max(found.get(bucket, -1), version)
    return found


def _read(spark: SparkSession, path: str, versions: dict[int, int], schema: StructType) -> DataFrame:
    folders = [f"{path}/bucket={b}/version={v}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*schema.names)


def read_feedback(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of a table of latest_feedback(), whose rows have this schema."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    versions = _versions(spark, path)
    return _read(spark, path, versions, kind) if versions else spark.createDataFrame([], kind)


SMOOTHED = "key string, idx int, t double, value double, smoothed double"


def smoothed(series: DataFrame, config: OneEuro = OneEuro()) -> DataFrame:
    """The one-euro filter over a stream of (key, idx, t, value): the state of a key is its last time, value and
    speed. Rows of a key are taken by idx within a batch; a time that doesn't advance starts the value afresh."""
    forward = euro_step(config)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("idx")
        rows = rows[rows["value"].notna()]
        out = []
        for t, v in zip(rows["t"].tolist(), rows["value"].tolist()):
            at = forward(at, t, v)
            out.append(at[1])
        if at is not None:
            state.update(at)
        yield pd.DataFrame({"key": rows["key"], "idx": rows["idx"], "t": rows["t"], "value": rows["value"], "smoothed": out})

    return series.groupBy("key").applyInPandasWithState(step, SMOOTHED, "t double, y double, speed double", "append", GroupStateTimeout.NoTimeout)
