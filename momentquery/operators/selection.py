"""Choice of windows: greedy removal of overlaps, a window for every block, and a least number of clips.

The choice among a job's windows depends on each choice before it, so it is a fold over the job's array of windows,
best first; jobs are independent. Arrays hold a window's times, score and place, not its texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Mining

_WINDOW = "struct<start_idx:int,end_idx:int,start_seconds:double,end_seconds:double,score:double>"
_RATIO = "if(least(a.end_seconds - a.start_seconds, b.end_seconds - b.start_seconds) > 0, greatest(0d, least(a.end_seconds, b.end_seconds) - greatest(a.start_seconds, b.start_seconds)) / least(a.end_seconds - a.start_seconds, b.end_seconds - b.start_seconds), 0d)"


def _clashes(x: str, kept: str, overlap: float) -> str:
    return f"exists({kept}, b -> {_RATIO.replace('a.', x + '.')} > {overlap})"


def _greedy(source: str, start: str, overlap: float) -> str:
    return f"aggregate({source}, {start}, (acc, x) -> if({_clashes('x', 'acc', overlap)}, acc, concat(acc, array(x))))"


def ranked(scored: DataFrame) -> DataFrame:
    """job_id and its windows as an array: by score, best first, then by place."""
    fields = F.struct(
        (-F.col("score")).alias("_minus"), F.col("start_idx").cast("int").alias("start_idx"), F.col("end_idx").cast("int").alias("end_idx"),
        F.col("start_seconds").cast("double").alias("start_seconds"), F.col("end_seconds").cast("double").alias("end_seconds"), F.col("score").cast("double").alias("score"),
    )
    packed = scored.groupBy("job_id").agg(F.array_sort(F.collect_list(fields)).alias("w"))
    return packed.selectExpr("job_id", f"cast(transform(w, x -> named_struct('start_idx', x.start_idx, 'end_idx', x.end_idx, 'start_seconds', x.start_seconds, 'end_seconds', x.end_seconds, 'score', x.score)) as array<{_WINDOW}>) as windows")


def deduplicated(jobs: DataFrame, config: Mining = Mining()) -> DataFrame:
    """jobs with kept: of the windows at or above the floor, each that overlaps no better kept one too much."""
    above = f"filter(windows, x -> x.score >= {config.floor})"
    return jobs.withColumn("kept", F.expr(_greedy(above, f"cast(array() as array<{_WINDOW}>)", config.overlap)))


def with_blocks(jobs: DataFrame, blocks: DataFrame, config: Mining = Mining()) -> DataFrame:
    """For each of a job's blocks without a kept window, in time order: the best window that overlaps it and no kept
    one too much, first among those at or above the blocks' floor, then among all."""
    by_job = blocks.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("block_idx", "start_seconds", "end_seconds"))).alias("blocks"))
    touches = "least({0}.end_seconds, k.end_seconds) - greatest({0}.start_seconds, k.start_seconds) > 0"
    fits = f"filter(windows, x -> {touches.format('x')} and not {_clashes('x', 'acc', config.overlap)})"
    good = f"filter({fits}, y -> y.score >= {config.block_floor})"
    choice = f"if(size({good}) > 0, {good}[0], {fits}[0])"
    step = f"if(exists(acc, x -> {touches.format('x')}) or size({fits}) = 0, acc, concat(acc, array({choice})))"
    joined = jobs.join(by_job, "job_id", "left")
    return joined.withColumn("kept", F.expr(f"if(blocks is null, kept, aggregate(blocks, kept, (acc, k) -> {step}))")).drop("blocks")


def filled(jobs: DataFrame, config: Mining = Mining()) -> DataFrame:
    """At least least_clips windows where there are any: next best ones without too much overlap, then any others."""
    least = min(config.most_clips, max(config.least_clips, 0))
    same = "exists(acc, b -> b.start_seconds = x.start_seconds and b.end_seconds = x.end_seconds)"
    full = f"size(acc) >= {least}"
    apart = f"aggregate(windows, kept, (acc, x) -> if({full} or {same} or {_clashes('x', 'acc', config.overlap)}, acc, concat(acc, array(x))))"
    out = jobs.withColumn("kept", F.expr(apart))
    return out.withColumn("kept", F.expr(f"aggregate(windows, kept, (acc, x) -> if({full} or {same}, acc, concat(acc, array(x))))"))


def selected(scored: DataFrame, blocks: DataFrame, config: Mining = Mining()) -> DataFrame:
    """job_id, rank, clip_id and the chosen windows, in order of choice; at most most_clips a job."""
    jobs = filled(with_blocks(deduplicated(ranked(scored), config), blocks, config), config)
    chosen = jobs.select("job_id", F.posexplode(F.slice("kept", 1, max(config.most_clips, 0)) if config.most_clips > 0 else F.filter("kept", lambda x: F.lit(False))).alias("rank", "w"))
    return chosen.select("job_id", "rank", F.format_string("clip-%03d", "rank").alias("clip_id"), "w.*")
