"""The engine's stages as one object, with the parts that outside models play passed in.

A provider is a function from a DataFrame of requests to a DataFrame of responses. None stands for one whose answers
are not there yet; the stage then gives its requests and stops.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Mining
from .lexicon import Lexicon
from .operators import camera, captions, handoff, identity, profile, render, selection, signals, windows

Provider = Callable[[DataFrame], DataFrame]
STAGES = ("mine", "brief", "review", "render", "auto")


class RenderStageError(ValueError):
    """Nothing was approved."""


@dataclass
class Engine:
    spark: SparkSession
    config: Mining = field(default_factory=Mining)
    lexicon: Lexicon = field(default_factory=Lexicon)
    #: From briefs to scores (job_id, clip_id, clip_hash, final_score, title, hook).
    scorer: Provider | None = None
    #: From package briefs to packs (job_id, clip_hash, clip_id, title).
    packager: Provider | None = None

    def mine(self, segments: DataFrame, frames: DataFrame, words: DataFrame) -> DataFrame:
        """Briefs of the chosen clips: times, score, reasons, transcript, speakers and hash."""
        found = windows.enumerated(segments, self.config.durations)
        told = windows.enumerated(signals.prepared(segments, words), self.config.durations)
        bounds = windows.enumerated(segments.drop("text", "speaker"), self.config.durations)
        scored = signals.scored(told, frames, self.lexicon, self.config, bounds)
        chosen = selection.selected(scored, windows.interview_blocks(segments, self.config), self.config)
        why = scored.select("job_id", "start_idx", "end_idx", "reasons", "spike_categories")
        return identity.briefs(chosen, found).join(why, ["job_id", "start_idx", "end_idx"])

    def review(self, briefs: DataFrame, cache: DataFrame | None = None) -> DataFrame | None:
        """The review order of a job's clips; None while the scorer has not answered for all."""
        if self.scorer is None:
            return None
        response = self.scorer(briefs)
        known = cache if cache is not None else response.limit(0)
        resolved = handoff.resolved_scores(briefs.select("job_id", "clip_id", "clip_hash", "rank"), response, known)
        handoff.checked(resolved, handoff.ScoringError)
        if resolved.filter("not complete").take(1):
            return None
        candidates = briefs.withColumns({"title": F.lit(""), "hook": F.lit("")}).drop("rank")
        scores = handoff.in_given_order(response)
        return handoff.review(candidates, scores)

    def approve(self, reviewed: DataFrame, k: int = 3, threshold: float = 0.0) -> DataFrame:
        return handoff.approved(reviewed, k, threshold)

    def render(self, approved: DataFrame, segments: DataFrame, frames: DataFrame, words: DataFrame, sources: DataFrame, preset: str = "bottom-creator") -> dict[str, DataFrame]:
        """Tables of a render plan for approved clips: captions, anchors, modes, targets, styles. sources: job_id,
        source_width, source_height."""
        clips = approved.filter("approved").select("job_id", "clip_id", "start_seconds", "end_seconds")
        if not clips.take(1):
            raise RenderStageError("no clip is approved")
        said = captions.clip_words(clips, segments, words)
        return {
            "captions": captions.dialogue(captions.lines(said)),
            "anchors": camera.anchors(clips, frames),
            "modes": camera.modes(clips, frames),
            "targets": camera.targets(clips.join(sources, "job_id")),
            "styles": render.styled(clips.withColumn("caption_preset", F.lit(preset))),
        }

    def package(self, approved: DataFrame, briefs: DataFrame) -> DataFrame | None:
        """Packs of approved clips by hash; None while the packager has not answered."""
        wanted = handoff.checked(handoff.package_briefs(approved, briefs), handoff.PackagingError)
        if not wanted.take(1):
            raise handoff.PackagingError("nothing to package")
        if self.packager is None:
            return None
        request = wanted.select("job_id", "clip_hash", "clip_id", F.expr("row_number() over (partition by job_id order by clip_id)").alias("ord"))
        packs = handoff.resolved_packs(request, self.packager(wanted))
        bad = packs.withColumn("error", F.when(F.col("status") != "ok", F.col("status")))
        return handoff.checked(bad, handoff.PackagingError).drop("error")

    def history(self, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(summary, patterns) of a feedback log."""
        last = profile.latest(entries)
        return profile.summary(last), profile.patterns(last)


def register_sql(spark: SparkSession) -> None:
    """SQL functions of a session: clamp01, overlap_ratio, clip_hash, safe_rate."""
    spark.sql("create or replace temporary function clamp01(x double) returns double return if(isnan(x), 0d, least(greatest(x, 0d), 1d))")
    spark.sql(
        "create or replace temporary function overlap_ratio(a0 double, a1 double, b0 double, b1 double) returns double return "
        "if(least(a1 - a0, b1 - b0) > 0, greatest(0d, least(a1, b1) - greatest(a0, b0)) / least(a1 - a0, b1 - b0), 0d)"
    )
    spark.sql("create or replace temporary function safe_rate(n bigint, d bigint) returns double return if(d > 0, round(n / d, 4), 0d)")
    spark.sql(
        "create or replace temporary function clip_hash(version string, s double, e double, t string) returns string return "
        "substring(sha1(concat_ws('|', version, format_string('%.3f', s), format_string('%.3f', e), trim(t))), 1, 16)"
    )
