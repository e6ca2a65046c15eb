"""Keyed joins with what outside models return: scores, reviews, packages, feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class HandoffError(ValueError):
    """A response breaks its contract."""


class ScoringError(HandoffError):
    pass


class PackagingError(HandoffError):
    pass


def in_given_order(response: DataFrame) -> DataFrame:
    """Answers with ord, their place in the answer: as read_response() of documents gives it, else the order of rows."""
    return response if "ord" in response.columns else response.withColumn("ord", F.monotonically_increasing_id())


def review(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Candidates (job_id, clip_id, score, title, hook) with a model's score, title and hook where it has them.

    scores(job_id, clip_id, ord, final_score, title, hook): of rows with one key the last counts, rows without a key
    don't; null fields fall back. rank: by score, best first, then by clip_id."""
    latest = (
        scores.filter("clip_id is not null")
        .groupBy("job_id", "clip_id")
        .agg(F.max_by(F.struct("final_score", F.col("title").alias("t"), F.col("hook").alias("h")), "ord").alias("m"))
    )
    joined = candidates.join(latest, ["job_id", "clip_id"], "left")
    out = joined.withColumns({"score": F.coalesce("m.final_score", "score"), "title": F.coalesce("m.t", "title"), "hook": F.coalesce("m.h", "hook")}).drop("m")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("score"), "clip_id")))


def resolved_scores(briefs: DataFrame, response: DataFrame, cache: DataFrame) -> DataFrame:
    """One row a brief (job_id, clip_id, clip_hash, rank): its score from the response, else the cache, and whether
    all briefs of its job have one. A response with an unknown hash or another clip's id marks an error."""
    r = response.select("job_id", F.col("clip_id").alias("r_clip"), "clip_hash", F.col("final_score").alias("r_score"))
    c = cache.select("job_id", "clip_hash", F.col("final_score").alias("c_score"))
    key = ["job_id", "clip_hash"]
    both = briefs.join(r, key, "full_outer").join(c, key, "left")
    error = F.when(F.col("clip_id").isNull(), "unexpected clip_hash").when(F.col("r_clip") != F.col("clip_id"), "clip_id does not match")
    score = F.coalesce("r_score", "c_score")
    job = W.partitionBy("job_id")
    return both.select(
        "job_id", "clip_id", "clip_hash", "rank", score.alias("final_score"),
        F.when(F.col("r_score").isNotNull(), "response").when(F.col("c_score").isNotNull(), "cache").alias("source"),
        error.alias("error"),
        F.every(F.col("clip_id").isNull() | score.isNotNull()).over(job).alias("complete"),
    )


def checked(resolved: DataFrame, error: type[HandoffError] = HandoffError) -> DataFrame:
    """The rows, after raising for the first error among them."""
    first = resolved.filter("error is not null").select("error", "clip_hash").first()
    if first is not None:
        raise error(f"{first.error}: {first.clip_hash}")
    return resolved


def approved(candidates: DataFrame, k: int, threshold: float) -> DataFrame:
    """candidates with approved, the k best of each job by score and clip_id, and how many of those reach the
    threshold; the threshold itself does not change which are approved."""
    if k <= 0 or not 0 <= threshold <= 1:
        raise ValueError("k must be positive and the threshold a share")
    place = F.row_number().over(W.partitionBy("job_id").orderBy(F.desc("score"), "clip_id"))
    marked = candidates.withColumn("approved", place <= k)
    met = F.count_if(F.col("approved") & (F.col("score") >= threshold)).over(W.partitionBy("job_id"))
    return marked.withColumn("threshold_met_count", met)


def package_briefs(candidates: DataFrame, briefs: DataFrame) -> DataFrame:
    """Approved candidates with their briefs; an approved one without a brief has the error set."""
    b = briefs.select("job_id", "clip_id", "clip_hash", "transcript", F.col("score").alias("mining_score"))
    out = candidates.filter("approved").drop("clip_hash", "transcript", "mining_score").join(b, ["job_id", "clip_id"], "left")
    return out.withColumns({"score": F.coalesce("score", "mining_score"), "error": F.when(F.col("clip_hash").isNull(), "no brief for an approved clip")})


def resolved_packs(request: DataFrame, response: DataFrame) -> DataFrame:
    """Both sides by clip_hash: status is ok, missing, unexpected or mismatch (another clip's id)."""
    a = request.select("job_id", "clip_hash", "clip_id", "ord")
    b = response.select("job_id", "clip_hash", F.col("clip_id").alias("pack_clip_id"), "title")
    status = (
        F.when(F.col("clip_id").isNull(), "unexpected")
        .when(F.col("pack_clip_id").isNull(), "missing")
        .when(F.col("pack_clip_id") != F.col("clip_id"), "mismatch")
        .otherwise("ok")
    )
    return a.join(b, ["job_id", "clip_hash"], "full_outer").withColumn("status", status)


def merged_feedback(stdin: DataFrame, kept: DataFrame, skipped: DataFrame, notes: DataFrame) -> DataFrame:
    """clip_id, posted, notes from four sources; later ones win: stdin, kept, skipped; a note alone means skipped."""
    none = lambda t: F.lit(None).cast(t)
    every = (
        stdin.select("clip_id", "posted", "notes", F.lit(0).alias("o"))
        .unionByName(kept.select("clip_id", F.lit(True).alias("posted"), none("string").alias("notes"), F.lit(1).alias("o")))
        .unionByName(skipped.select("clip_id", F.lit(False).alias("posted"), none("string").alias("notes"), F.lit(2).alias("o")))
        .unionByName(notes.select("clip_id", none("boolean").alias("posted"), "notes", F.lit(3).alias("o")))
    )
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("o")))
    return every.groupBy("clip_id").agg(F.coalesce(last("posted"), F.lit(False)).alias("posted"), last("notes").alias("notes"))


def feedback_rows(feedback: DataFrame, candidates: DataFrame) -> DataFrame:
    """Feedback joined with its clips; status unknown where there is no such clip."""
    c = candidates.select("clip_id", "score", "title", (F.col("end_seconds") - F.col("start_seconds")).alias("duration_seconds"))
    return feedback.join(c, "clip_id", "left").withColumn("status", F.when(F.col("duration_seconds").isNull(), "unknown").otherwise("ok"))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys of a job that occur more than once, and how often."""
    return rows.groupBy("job_id", key).count().filter("count > 1").withColumnRenamed("count", "n")


def existing_state(flags: dict[str, Column]) -> Column:
    """The next stage of a workspace, from which of its artifacts exist; the furthest one counts."""
    order = (
        ("package_report", "done"), ("package_response", "package_save"), ("package_request", "package_handoff"), ("render_report", "package_prompt"),
        ("approved", "render"), ("review", "approve"), ("scoring_response", "review"), ("brief_response", "score_handoff"),
        ("brief_request", "brief_handoff"), ("scoring_request", "score_handoff"), ("job", "mine"),
    )
    out = F.lit("prepare")
    for name, state in reversed(order):
        out = F.when(flags[name], state).otherwise(out)
    return out
