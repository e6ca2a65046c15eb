"""Requests to outside models and what is made of their answers: a row a job or a clip, documents as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import identity

# Names of a workspace's documents.
ARTIFACTS = {
    "brief_request": "brief-request.json",
    "brief_response": "brief-response.json",
    "brief_cache": "brief-cache.json",
    "scoring_request": "scoring-request.json",
    "scoring_response": "scoring-response.json",
    "review": "review-manifest.json",
    "render_report": "render-report.json",
    "package_request": "package-request.json",
    "package_response": "package-response.json",
    "package_report": "package-report.json",
    "resume": "resume.json",
}
SIGNALS = (
    "hook", "keyword", "numeric", "interjection", "payoff", "question_to_answer", "motion", "shot_change", "face_presence", "speaker_interaction",
    "delivery_variance", "buried_lead", "dangling_question", "rambling_middle", "reasons", "spike_categories",
)
SUMMARY = (
    "frame_count", "face_presence_ratio", "avg_motion", "peak_motion", "shot_change_count", "shot_change_rate_per_minute", "avg_face_center_x", "avg_face_center_y",
    "description",
)
#: Fields of a video brief, as they stand in its digest.
BRIEF = ("anti_patterns", "audience", "expected_viral_patterns", "job_id", "notes", "rubric_version", "theme", "tone", "video_format")
#: Patterns of a creator's feedback that go into a request.
PATTERNS = 5


def artifact(workspace: Column, name: str) -> Column:
    return F.concat_ws("/", workspace, F.lit(ARTIFACTS[name]))


def speakers(rows: str = "members") -> Column:
    """Speakers of an array of segments in order of appearance."""
    return F.array_distinct(F.transform(rows, lambda m: m["speaker"]))


def brief_requests(jobs: DataFrame, segments: DataFrame, version: str = "v1") -> DataFrame:
    """jobs(job_id, video_path) with rubric_version, transcript_excerpt, transcript_truncated, duration_seconds (the end
    of the last segment) and speakers; a job without segments has an empty excerpt and no seconds."""
    told = identity.excerpts(segments).select("job_id", F.col("excerpt").alias("_excerpt"), F.col("truncated").alias("_truncated"))
    order = F.array_sort(F.collect_list(F.struct("seg_idx", "speaker")))
    heard = segments.groupBy("job_id").agg(F.max_by("end_seconds", "seg_idx").alias("_end"), speakers(order).alias("_speakers"))
    found = jobs.join(told, "job_id", "left").join(heard, "job_id", "left")
    return found.select(
        *jobs.columns,
        F.lit(version).alias("rubric_version"),
        F.coalesce("_excerpt", F.lit("")).alias("transcript_excerpt"),
        F.coalesce("_truncated", F.lit(False)).alias("transcript_truncated"),
        F.coalesce("_end", F.lit(0.0)).alias("duration_seconds"),
        F.coalesce("_speakers", F.array().cast("array<string>")).alias("speakers"),
    )


def ascii_json(text: Column) -> Column:
    r"""JSON with all but printable ASCII characters as \uXXXX, two of them beyond the first 65536."""
    four = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))
    code = lambda c: F.ascii(c)
    high = lambda c: F.lit(0xD800) + F.floor((code(c) - 0x10000) / 0x400).cast("int")
    low = lambda c: F.lit(0xDC00) + (code(c) - 0x10000) % 0x400
    each = lambda c: F.when(code(c) <= 126, c).when(code(c) < 0x10000, four(code(c))).otherwise(F.concat(four(high(c)), four(low(c))))
    # Most texts are plain; the others are taken apart.
    return F.when(F.rlike(text, F.lit(r"^[\x00-\x7E]*$")), text).otherwise(F.array_join(F.transform(F.split(text, ""), each), ""))


def context_hash(brief: dict[str, Column]) -> Column:
    """Sixteen hex digits of SHA-1 over a video brief as JSON: keys in order, no blanks, nulls written out."""
    fields = F.struct(*[brief[name].alias(name) for name in BRIEF])
    text = ascii_json(F.to_json(fields, {"ignoreNullFields": "false"}))
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16)


def full_briefs(chosen: DataFrame, scored: DataFrame, windows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chosen windows as the scorer is to see them: transcript, speakers, hash, duration, mining_score, mining_signals
    and visual_summary (null where no frame was looked at). summaries: rows of signals.visual_summary()."""
    key = ["job_id", "start_idx", "end_idx"]
    marked = scored.select(*key, F.col("score").alias("mining_score"), F.struct(*SIGNALS).alias("mining_signals"))
    seen = summaries.select(*key, F.struct(*SUMMARY).alias("visual_summary"))
    told = identity.briefs(chosen, windows).withColumn("duration_seconds", F.col("end_seconds") - F.col("start_seconds"))
    return told.join(marked, key, "left").join(seen, key, "left")


def rehashed(briefs: DataFrame, contexts: DataFrame, version: str = "v1") -> DataFrame:
    """briefs with clip_hash over their job's context, contexts(job_id, context_hash), too; the hash of a job without
    one stays."""
    found = briefs.join(contexts.select("job_id", F.col("context_hash").alias("_context")), "job_id", "left")
    again = identity.clip_hash(F.col("start_seconds"), F.col("end_seconds"), F.col("transcript"), version, F.concat(F.lit("context:"), F.col("_context")))
    return found.withColumn("clip_hash", F.when(F.col("_context").isNull(), F.col("clip_hash")).otherwise(again)).drop("_context")


def candidates(briefs: DataFrame) -> DataFrame:
    """Rows of full_briefs() as candidates of a review."""
    return briefs.select(
        "job_id", "clip_id", "start_seconds", "end_seconds", F.col("mining_score").alias("score"), F.col("mining_signals.reasons").alias("reasons"),
        F.col("mining_signals.spike_categories").alias("spike_categories"), F.lit("").alias("title"), F.lit("").alias("hook"), F.lit(False).alias("approved"),
    )


def payload(scores: DataFrame) -> DataFrame:
    """What a review takes from scores."""
    return scores.select("job_id", "clip_id", "title", "hook", "reasons", "final_score")


def scoring_requests(jobs: DataFrame, briefs: DataFrame, prompt: str, version: str = "v1", video_briefs: DataFrame | None = None) -> DataFrame:
    """job_id and request: one JSON document a job, with its briefs by rank and its video brief, if it has one. Every
    job has a document, also one without briefs."""
    clips = briefs.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*[c for c in briefs.columns if c not in ("job_id", "rank")]).alias("b")))).alias("c"))
    rows = jobs.join(clips.select("job_id", F.transform("c", lambda x: x["b"]).alias("clips")), "job_id", "left")
    if video_briefs is None:
        rows = rows.withColumn("video_brief", F.lit(None).cast("string"))
    else:
        whole = F.struct(*[c for c in video_briefs.columns])
        rows = rows.join(video_briefs.select(F.col("job_id"), whole.alias("video_brief")), "job_id", "left")
    document = F.struct(
        F.lit(version).alias("rubric_version"), "job_id", "video_path", F.lit(prompt).alias("rubric_prompt"), F.coalesce("clips", F.array()).alias("clips"), "video_brief"
    )
    return rows.select("job_id", F.to_json(document, {"ignoreNullFields": "false"}).alias("request"))


def package_requests(jobs: DataFrame, wanted: DataFrame, version: str = "v1") -> DataFrame:
    """jobs(job_id, video_path) with clips, the briefs of handoff.package_briefs() by clip, prompt_version, and error for
    a job without any, or with an approved clip that has no brief."""
    entries = F.array_sort(F.collect_list(F.struct("clip_id", "clip_hash", "score", "error")))
    rows = jobs.join(wanted.groupBy("job_id").agg(entries.alias("clips")), "job_id", "left")
    lacking = F.try_element_at(F.filter("clips", lambda c: c["error"].isNotNull()), F.lit(1))
    return rows.select(
        *jobs.columns,
        F.lit(version).alias("prompt_version"),
        F.transform("clips", lambda c: c.dropFields("error")).alias("clips"),
        F.when(F.col("clips").isNull(), "nothing to package").when(lacking.isNotNull(), F.concat_ws(": ", lacking["error"], lacking["clip_id"])).alias("error"),
    )


def package_reports(jobs: DataFrame, packs: DataFrame) -> DataFrame:
    """job_id and report, a JSON document: the job, its video, and the path of each pack, by clip; paths below the job's
    workspace are told from there. packs: job_id, clip_id, path."""
    below = F.concat(F.col("workspace"), F.lit("/"))
    path = F.when(F.startswith("path", below), F.substring("path", F.length(below) + 1, F.length("path"))).otherwise(F.col("path"))
    entries = packs.join(jobs.select("job_id", "workspace"), "job_id").select("job_id", F.struct("clip_id", path.alias("pack_path")).alias("p"))
    listed = entries.groupBy("job_id").agg(F.array_sort(F.collect_list("p")).alias("packs"))
    return jobs.join(listed, "job_id", "left").select(
        "job_id", F.to_json(F.struct("job_id", "video_path", F.coalesce("packs", F.array().cast("array<struct<clip_id:string,pack_path:string>>")).alias("packs"))).alias("report")
    )


def with_patterns(requests: DataFrame, summary: DataFrame, patterns: DataFrame, most: int = PATTERNS) -> DataFrame:
    """requests with creator_patterns: the number of clips that feedback knows and its first patterns, the same for all
    (one row, of bounded length); null without feedback. patterns: rows of profile.patterns()."""
    names = [c for c in patterns.columns if c != "position"]
    first = patterns.filter(F.col("position") <= most)
    best = first.agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*names).alias("p")))).alias("found"))
    known = summary.filter("dimension = 'all'").agg(F.max("total").alias("n"))
    one = best.crossJoin(known).select(F.when(F.col("n") > 0, F.transform("found", lambda x: x["p"])).alias("creator_patterns"))
    return requests.crossJoin(F.broadcast(one))  # one row


# Documents that tell the form of an answer


def json_schema(kind: T.DataType, limits: dict[str, dict] | None = None, path: str = "") -> dict:
    """The JSON schema of a Spark type: all fields are required and no others allowed. limits: by dotted path (lists
    add []), what else holds there."""
    more = (limits or {}).get(path, {})
    if isinstance(kind, T.StructType):
        inner = {f.name: json_schema(f.dataType, limits, f"{path}.{f.name}".lstrip(".")) for f in kind}
        return {"type": "object", "additionalProperties": False, "required": list(inner), "properties": inner, **more}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType, limits, f"{path}[]"), **more}
    names = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.FloatType: "number"}
    return {"type": next((n for t, n in names.items() if isinstance(kind, t)), "integer"), **more}

