"""Stream queries, run to the end of their input."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..streaming import streams


def _place(spark: SparkSession) -> str:
    """A folder that driver and executors share; one of our own only on a single machine where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    place = f"{(root or '/tmp/checkpoints').rstrip('/')}/stream-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append(place)
    return place


#: Folders made so far; they go when the driver's process ends, as results may be read until then.
_made: list[str] = []


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _made:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events at most half an hour apart, read as a stream and written as a table. An event of
    no user, an hour after the last one, moves the watermark past all sessions; its own is never closed."""
    ship(spark)
    place, path = _place(spark), f"{sf_dir}/events.parquet"
    rows = spark.read.parquet(path).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit(None).cast(rows.schema["user_id"].dataType).alias("user_id"), F.expr("ts + interval 1 hour").alias("ts"))
    rows.unionByName(end).write.parquet(f"{place}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in")
    found = streams.merged_events(stream, "user_id", "ts", "30 minutes")
    sink = found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state")
    sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema(found.schema).parquet(f"{place}/out")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sessions from the table."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = streams.merged_events(rows, "user_id", "ts", "30 minutes")
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


QUERIES = {"merged_sessions": merged_sessions, "event_sessions": event_sessions}
ORACLE = {
    "event_sessions": """
with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 30 minutes then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e)
select user_id, min(ts) as start, max(ts) as "end", count(*) as n from s group by user_id, k
"""
}
ORACLE["merged_sessions"] = ORACLE["event_sessions"]
