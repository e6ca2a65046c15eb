"""Windows of successive transcript segments, and blocks of many-voiced talk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..config import Durations, Mining


def by_job() -> WindowSpec:
    return W.partitionBy("job_id").orderBy("seg_idx")


def enumerated(segments: DataFrame, durations: Durations = Durations()) -> DataFrame:
    """job_id, start_idx, end_idx, start_seconds, end_seconds and members, the window's segments in order.

    For each first segment, windows grow until one is longer than the longest; later ones are not looked at, even
    if segments' ends go back. What a window can reach lies, by the latest start so far, within the longest length,
    so each segment gathers a range frame of bounded length and no job is joined with itself.
    """
    # Members hold what segments have of these; leave out texts where only bounds are wanted. The frame is in SQL
    # because its bound is a double.
    fields = ", ".join(c for c in ("seg_idx", "speaker", "start_seconds", "end_seconds", "text", "tokens", "numbers", "pauses") if c in segments.columns)
    ahead = f"""collect_list(struct({fields})) over (
        partition by job_id order by _latest range between current row and {durations.most}D following)"""
    grown = segments.withColumn("_latest", F.max("start_seconds").over(by_job())).withColumn("_ahead", F.expr(ahead))
    ordered = F.filter(F.array_sort("_ahead"), lambda m: m["seg_idx"] >= F.col("seg_idx"))
    over = F.transform(ordered, lambda m: m["end_seconds"] - F.col("start_seconds") > durations.most)
    first_over = F.array_position(over, True)
    kept = F.when(first_over > 0, F.slice(ordered, F.lit(1), (first_over - 1).cast("int"))).otherwise(ordered)
    sizes = F.filter(
        F.sequence(F.lit(1), F.size("_kept")),
        lambda n: F.element_at("_kept", n)["end_seconds"] - F.col("start_seconds") >= durations.least,
    )
    return (
        grown.withColumn("_kept", kept)
        .filter(F.size("_kept") > 0)
        .select("job_id", F.col("seg_idx").alias("start_idx"), "start_seconds", "_kept", F.explode(sizes).alias("_n"))
        .select("job_id", "start_idx", "start_seconds", F.slice("_kept", F.lit(1), F.col("_n")).alias("members"))
        .select("job_id", "start_idx", F.element_at("members", -1)["seg_idx"].alias("end_idx"), "start_seconds", F.element_at("members", -1)["end_seconds"].alias("end_seconds"), "members")
    )


def transitions(segments: DataFrame) -> Column:
    """Whether a segment's speaker differs from the one before in its job; not for the first."""
    return F.coalesce(F.col("speaker") != F.lag("speaker").over(by_job()), F.lit(False))


def interview_blocks(segments: DataFrame, config: Mining = Mining()) -> DataFrame:
    """job_id, block_idx, start_seconds, end_seconds, speakers, transition_count.

    Transitions whose segment begins at most merge_gap after the end of the one before belong together; neighbours
    at most bookend_gap away are taken in; blocks need enough transitions, seconds and named speakers."""
    around = segments.withColumns(
        {
            "_turn": transitions(segments),
            "_prev_start": F.lag("start_seconds").over(by_job()),
            "_prev_end": F.lag("end_seconds").over(by_job()),
            "_prev_speaker": F.lag("speaker").over(by_job()),
            "_next_start": F.lead("start_seconds").over(by_job()),
            "_next_end": F.lead("end_seconds").over(by_job()),
            "_next_speaker": F.lead("speaker").over(by_job()),
        }
    )
    turns = around.filter("_turn").withColumn("_gap", F.col("start_seconds") - F.lag("end_seconds").over(by_job()))
    turns = turns.withColumn("_run", F.sum((F.col("_gap") > config.merge_gap).cast("int")).over(by_job())).withColumn("_run", F.coalesce("_run", F.lit(0)))
    first, last = (lambda c: F.min_by(c, "seg_idx")), (lambda c: F.max_by(c, "seg_idx"))
    runs = turns.groupBy("job_id", "_run").agg(
        F.count("*").alias("transition_count"),
        F.min("seg_idx").alias("_from"),
        F.max("seg_idx").alias("_to"),
        first(F.struct("start_seconds", "_prev_start", "_prev_end")).alias("f"),
        last(F.struct("end_seconds", "_next_start", "_next_end")).alias("l"),
    )
    before = F.coalesce(F.col("f.start_seconds") - F.col("f._prev_end") <= config.bookend_gap, F.lit(False))
    after = F.coalesce(F.col("l._next_start") - F.col("l.end_seconds") <= config.bookend_gap, F.lit(False))
    bounds = runs.filter(F.col("transition_count") >= config.block_transitions).select(
        "job_id",
        "_run",
        "transition_count",
        (F.col("_from") - before.cast("int")).alias("_from"),
        (F.col("_to") + after.cast("int")).alias("_to"),
        F.when(before, F.col("f._prev_start")).otherwise(F.col("f.start_seconds")).alias("start_seconds"),
        F.when(after, F.col("l._next_end")).otherwise(F.col("l.end_seconds")).alias("end_seconds"),
    )
    long_enough = bounds.filter(F.col("end_seconds") - F.col("start_seconds") >= config.block_seconds)
    voices = segments.select(F.col("job_id").alias("_job"), F.col("seg_idx").alias("_seg"), F.nullif(F.col("speaker"), F.lit("")).alias("_speaker"))
    # An equality on the job keeps this a hash join; a segment is in at most two blocks.
    inside = (F.col("job_id") == F.col("_job")) & F.col("_seg").between(F.col("_from"), F.col("_to"))
    blocks = (
        long_enough.join(voices, inside)
        .groupBy("job_id", "_run", "start_seconds", "end_seconds", "transition_count")
        .agg(F.array_sort(F.collect_set("_speaker")).alias("speakers"))
        .filter(F.size("speakers") >= 2)
    )
    return blocks.withColumn("block_idx", F.row_number().over(W.partitionBy("job_id").orderBy("_run")) - 1).select(
        "job_id", "block_idx", "start_seconds", "end_seconds", "speakers", "transition_count"
    )
