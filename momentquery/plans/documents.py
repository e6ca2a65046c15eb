"""Queries over requests, documents, workspaces and voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..operators import captions, handoff, identity, profile, render, requests, signals, voices, windows, workspaces
from ..sources import testdata as td
from . import analytics, mining
from . import oracle as o
from .mining import rounded

_JOBS = "select distinct concat('job-', conv_id) as job_id, concat('/in/', conv_id, '.mp4') as video_path, concat('/out/jobs/', conv_id) as workspace from {conversations}"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.statement(_JOBS, spark, sf_dir)


def brief_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = td.segments(spark, sf_dir).filter("cast(substring(job_id, 5) as int) % 3 <> 0")
    out = requests.brief_requests(_jobs(spark, sf_dir).drop("workspace"), said)
    return rounded(out.select("job_id", "video_path", "rubric_version", F.length("transcript_excerpt").alias("n_chars"), "transcript_truncated", "duration_seconds", F.array_join("speakers", "|").alias("speakers")))


_BRIEFS = """
select concat('job-', c_custkey) as job_id, case when c_custkey % 4 = 0 then null else concat('künftig – ', c_mktsegment) end as audience, case when c_custkey % 3 = 0 then null else 'dry "wit"' end as tone,
    concat(c_name, ' / 日本', chr(127)) as theme, cast(c_custkey % 3 as varchar(9)) as a
from {customer}
"""


def _brief_fields() -> dict:
    a = F.col("a")
    return {
        "anti_patterns": F.when(a == "0", F.array().cast("array<string>")).otherwise(F.array(a)), "audience": F.col("audience"), "expected_viral_patterns": F.array(F.lit("x"), F.concat(F.lit("é"), a), F.lit("z")),
        "job_id": F.col("job_id"), "notes": F.lit(None).cast("string"), "rubric_version": F.lit("v1"), "theme": F.col("theme"), "tone": F.col("tone"), "video_format": F.lit("talk"),
    }


def context_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.statement(_BRIEFS, spark, sf_dir).select("job_id", requests.context_hash(_brief_fields()).alias("context_hash"))


def rehashed_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three jobs have a context."""
    briefs = td.clips(spark, sf_dir).select("job_id", "clip_id", "start_seconds", "end_seconds", F.concat(F.lit(" "), "title").alias("transcript"), F.lit("as it was").alias("clip_hash"))
    contexts = _jobs(spark, sf_dir).select("job_id", F.substring(F.sha1("job_id"), 1, 16).alias("context_hash")).filter("cast(substring(job_id, 5) as int) % 3 <> 0")
    return requests.rehashed(briefs, contexts).select("job_id", "clip_id", "clip_hash")


def full_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all windows that could be chosen."""
    segments, frames = td.segments(spark, sf_dir), td.frames(spark, sf_dir)
    told = windows.enumerated(signals.prepared(segments, td.words(spark, sf_dir)))
    bounds = windows.enumerated(segments.drop("text", "speaker"))
    scored = signals.scored(told, frames, bounds=bounds)
    seen = signals.visual_summary(signals.visual(bounds.drop("members").withColumn("row_id", F.struct("job_id", "start_idx", "end_idx")), frames))
    out = requests.full_briefs(bounds.drop("members"), scored, windows.enumerated(segments), seen)
    signal, summary = F.col("mining_signals"), F.col("visual_summary")
    return rounded(
        out.select(
            "job_id", "start_idx", "end_idx", "clip_hash", "duration_seconds", "mining_score", *[signal[c].alias(c) for c in requests.SIGNALS if c not in ("reasons", "spike_categories")],
            F.size(signal["reasons"]).alias("n_reasons"), F.size(signal["spike_categories"]).alias("n_spikes"), summary["frame_count"].alias("frame_count"), summary["face_presence_ratio"].alias("face_presence_ratio"),
        )
    )


def package_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the jobs have approved clips; some of these have no brief."""
    clips = td.clips(spark, sf_dir).filter("cast(substring(job_id, 5) as int) % 2 = 0")
    briefs = analytics._briefs(spark, sf_dir).filter("substring(clip_hash, 1, 1) <> '0'")
    wanted = handoff.package_briefs(handoff.approved(clips, 3, 0.0), briefs)
    out = requests.package_requests(_jobs(spark, sf_dir).drop("workspace"), wanted)
    return out.select("job_id", "video_path", "prompt_version", F.array_join(F.transform("clips", lambda c: c["clip_id"]), "|").alias("clips"), "error")


def package_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    packs = td.clips(spark, sf_dir).filter("score > 0.3").select("job_id", "clip_id", F.concat(F.when(F.col("score") > 0.6, F.lit("/out/jobs/")).otherwise(F.lit("/elsewhere/")), F.substring("job_id", 5, 9), F.lit("/renders/"), F.col("clip_id"), F.lit("/package.json")).alias("path"))
    return requests.package_reports(jobs, packs)


def request_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = profile.latest(td.history(spark, sf_dir))
    out = requests.with_patterns(_jobs(spark, sf_dir).select("job_id"), profile.summary(last), profile.patterns(last))
    return out.select("job_id", F.posexplode("creator_patterns").alias("place", "p")).select("job_id", "place", "p.kind", "p.key", "p.confidence", "p.rule")


_SPANS = """
select concat('job-', l_suppkey % 60) as job_id, case when l_partkey % 17 = 0 then 'soon' when l_partkey % 19 = 0 then null else cast(cast(l_partkey % 500 as double) / 8 as varchar(20)) end as a,
    cast(cast(l_partkey % 500 + l_linenumber * 4 - 5 as double) / 8 as varchar(20)) as b
from {lineitem} where l_orderkey % 16 = 0
"""


def _raw_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.statement(_SPANS, spark, sf_dir).select("job_id", F.col("a").alias("start"), F.col("b").alias("end"))


def speech_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voices.speech_spans(_raw_spans(spark, sf_dir)).drop("span_idx").distinct())


def embeddable_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio of 40 seconds; spans of which no more than a second is taken."""
    spans = voices.speech_spans(_raw_spans(spark, sf_dir)).drop("span_idx").distinct()
    audio = spans.select("job_id").distinct().withColumn("n_samples", F.lit(640000).cast("long"))
    return rounded(voices.embeddable(spans, audio, most=1.0))


SPOKEN = """
select concat('job-', c_custkey % 100) as job_id, cast((c_custkey * 17) % 60 as double) as start, cast((c_custkey * 17) % 60 + 2 + c_custkey % 9 as double) as {end}, concat('SPEAKER_0', c_custkey % 4) as speaker
from {customer} where c_custkey % 100 < 60
"""


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from 60 on have no spans; every fifth word knows its speaker."""
    words = td.words(spark, sf_dir).withColumn("speaker", F.when(F.col("word_idx") % 5 == 0, "SPEAKER_07"))
    spans = td.statement(SPOKEN.replace("{end}", "`end`"), spark, sf_dir)
    return voices.spoken(words, spans, "pyannote").select("job_id", "seg_idx", "word_idx", "speaker")


def flow_magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors whose halves stand for the two components of a field."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding is not null")
    half = F.floor(F.size("embedding") / 2).cast("int")
    e = F.col("embedding").cast("array<double>")
    flow = rows.select(F.concat(F.lit("job-"), F.floor(F.col("vec_id") / 10)).alias("job_id"), (F.col("vec_id") % 10).cast("int").alias("frame_idx"), F.slice(e, F.lit(1), half).alias("dx"), F.slice(e, half + 1, half).alias("dy"))
    return rounded(voices.magnitudes(flow))


_SCENES = "select concat('job-', c_custkey % 50) as job_id, cast(c_custkey as double) * 7 / 16 as start from {customer}"


def scene_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(voices.scene_starts(td.statement(_SCENES, spark, sf_dir)))


_SETTINGS = """
select concat('file-', c_custkey % 49) as path, concat('KEY_', c_custkey % 7) as key, max(case when c_custkey % 5 = 0 then '' when c_custkey % 3 = 0 then concat('a "b" ', c_custkey) else concat('v', c_custkey) end) as value
from {customer} where c_custkey % 2 = REST group by c_custkey % 49, c_custkey % 7
"""


def settings_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = (td.statement(_SETTINGS.replace("REST", str(k)), spark, sf_dir) for k in (0, 1))
    return identity.settings_text(identity.updated_settings(old, new, "path"), "path")


_SIDECARS = "select concat('/out', '/jobs/', s_suppkey) as workspace, concat('/skill/', s_suppkey % 40, '/job.json') as job_path from {supplier} where s_suppkey % 3 = 0"
_JOB_FILES = "select concat('/skill/', s_suppkey, '/job.json') as job_path, '/out/' as output_dir, cast(s_suppkey as varchar(20)) as job_id, case when s_suppkey % 4 = 0 then null when s_suppkey % 4 = 1 then '1:1' else '9:16|16:9' end as r from {supplier} where s_suppkey % 5 <> 0"
_WORKSPACES = "select concat('/out/jobs/', s_suppkey) as workspace from {supplier}"


def _workspaces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    found, side, jobs = (td.statement(x, spark, sf_dir) for x in (_WORKSPACES, _SIDECARS, _JOB_FILES))
    return found, side, jobs.withColumn("ratios", F.split("r", "[|]")).drop("r")


def resumed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.resumed(*_workspaces(spark, sf_dir))


def workspace_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspaces.ratios(*_workspaces(spark, sf_dir)).withColumn("ratios", F.array_join("ratios", "|"))


def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = spark.createDataFrame([(s, p) for s in (*workspaces.STEPS, *workspaces.HANDOFFS, "done", "prepare") for p in (True, False)], "state string, package boolean")
    return states.withColumn("step", workspaces.next_step(F.col("state"), F.col("package")))


def score_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = td.clips(spark, sf_dir).withColumns({"final_score": F.col("score"), "reasons": F.array("hook", "title"), "penalties": F.lit("none")})
    return rounded(requests.payload(scores).withColumn("reasons", F.array_join("reasons", "|")))


def render_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest a clip with its errors; some plans have another ratio than their key, some are missing."""
    clips = td.clips(spark, sf_dir).withColumns({"approved": F.col("score") > 0.5, "source_video": F.concat(F.lit("/in/"), "job_id"), "mode": F.when(F.col("score") > 0.9, "DRIFT").otherwise("TRACK"), "caption_preset": F.lit("top-clean")}).drop("score", "title", "hook")
    number = F.crc32(F.concat("job_id", "clip_id"))
    ratios = F.array(*[F.lit(r) for r in contracts.RATIOS])
    each = clips.select("job_id", "clip_id", F.explode(ratios).alias("aspect_ratio"))
    outputs = each.withColumn("output", render.output_path(F.lit("/out"), F.col("clip_id"), F.col("aspect_ratio")))
    other = F.when((number % 7 == 0) & (F.col("aspect_ratio") == "1:1"), F.lit("9:16")).otherwise(F.col("aspect_ratio"))
    crops = each.filter(~((number % 5 == 0) & (F.col("aspect_ratio") == "16:9"))).withColumn("plan", F.struct(other.alias("aspect_ratio"), F.lit(1920).alias("source_width")))
    said = captions.lines(rounded(captions.clip_words(clips, td.segments(spark, sf_dir), td.words(spark, sf_dir))))
    found = contracts.render_manifests(render.manifests(clips, outputs, crops, said.select("job_id", "clip_id", "line_idx", F.struct("text").alias("line"))))
    return found.select("job_id", "clip_id", "approved", F.size("outputs").alias("n_outputs"), F.size("crop_plans").alias("n_plans"), F.size("caption_plan").alias("n_lines"), F.array_join("errors", "|").alias("errors"))


QUERIES = {
    f.__name__: f
    for f in (
        brief_requests, context_hashes, rehashed_briefs, full_briefs, package_requests, package_reports, request_patterns, speech_spans, embeddable_spans, spoken_words,
        flow_magnitudes, scene_starts, settings_written, resumed_jobs, workspace_ratios, next_steps, score_payloads, render_manifests,
    )
}

_DUCK_JOBS = td.duck(_JOBS)
_ASCII = "array_to_string(list_transform(string_split({t}, ''), lambda c: case when unicode(c) > 126 then printf('\\u%04x', unicode(c)) else c end), '')"
_QUOTED = "case when {t} is null then 'null' else concat('\"', replace({t}, '\"', '\\\"'), '\"') end"
_NUMBER = "cast(substr(job_id, 5) as int)"
_SPAN = f"(select distinct job_id, try_cast(a as double) as start, try_cast(b as double) as e from {td.duck(_SPANS)} x where try_cast(b as double) > try_cast(a as double))"

ORACLE = {
    "brief_requests": f"""
with p as (select job_id, list({mining._LINE} order by seg_idx) as p, arg_max(end_seconds, seg_idx) as d, list(speaker order by seg_idx) as sp from {o.SEGMENTS} s where {_NUMBER} % 3 <> 0 group by job_id),
e as ({mining.ORACLE['brief_excerpts']})
select j.job_id as job_id, j.video_path as video_path, 'v1' as rubric_version, coalesce(case when p.d is not null then e.n_chars end, 0)::int as n_chars, coalesce(case when p.d is not null then e.truncated end, false) as transcript_truncated,
    coalesce(round(p.d, 6), 0.0) as duration_seconds, coalesce(array_to_string(list_filter(p.sp, lambda x, i: list_position(p.sp, x) = i), '|'), '') as speakers
from {_DUCK_JOBS} j left join p on p.job_id = j.job_id left join e on e.job_id = j.job_id""",
    "context_hashes": f"""
with b as (select *, {_QUOTED.format(t='audience')} as qa, {_QUOTED.format(t='tone')} as qt, {_QUOTED.format(t='theme')} as qh from {td.duck(_BRIEFS).replace('varchar(9)', 'varchar')} x),
j as (select job_id, concat('{{"anti_patterns":', case when a = '0' then '[]' else concat('["', a, '"]') end, ',"audience":', qa, ',"expected_viral_patterns":["x","é', a, '","z"],"job_id":"', job_id,
    '","notes":null,"rubric_version":"v1","theme":', qh, ',"tone":', qt, ',"video_format":"talk"}}') as t from b)
select job_id, substr(sha1({_ASCII.format(t='t')}), 1, 16) as context_hash from j""",
    "rehashed_briefs": f"""select job_id, clip_id, case when {_NUMBER} % 3 <> 0 and job_id in (select job_id from {_DUCK_JOBS} j)
        then substr(sha1(concat_ws('|', 'v1', printf('%.3f', start_seconds), printf('%.3f', end_seconds), trim(title), concat('context:', substr(sha1(job_id), 1, 16)))), 1, 16) else 'as it was' end as clip_hash
        from {o.CLIPS} c""",
    "full_briefs": mining._SCORED
    + f""",
said2 as (
    select w.job_id, w.start_idx, w.end_idx, substr(sha1(concat_ws('|', 'v1', printf('%.3f', w.start_seconds), printf('%.3f', w.end_seconds), trim(string_agg(m.text, ' ' order by m.seg_idx), {o.BLANKS}))), 1, 16) as clip_hash
    from win w join seg m on m.job_id = w.job_id and m.seg_idx between w.start_idx and w.end_idx group by w.job_id, w.start_idx, w.end_idx, w.start_seconds, w.end_seconds
)
select s.job_id as job_id, s.start_idx as start_idx, s.end_idx as end_idx, h.clip_hash as clip_hash, round(s.end_seconds - s.start_seconds, 6) as duration_seconds, round(s.score, 6) as mining_score, """
    + ", ".join(f"round(s.{c}, 6) as {c}" for c in requests.SIGNALS[:11])
    + """, s.buried_lead as buried_lead, s.dangling_question as dangling_question, s.rambling_middle as rambling_middle,
    greatest(1, (hook >= 0.45)::int + (keyword >= 0.16)::int + (payoff >= 0.35)::int + (motion >= 0.55 or shot_change >= 0.5)::int + (speaker_interaction >= 0.1)::int + (numeric >= 0.2)::int + (question_to_answer >= 1.0)::int) as n_reasons,
    (keyword >= 0.16)::int + (keyword >= 0.16 and payoff <= 0.1)::int + (motion >= 0.55 or shot_change >= 0.5)::int + (payoff >= 0.45 and numeric >= 0.12)::int + (interview_keyword >= 0.2)::int
        + (interview_keyword >= 0.1 and numeric >= 0.1)::int + (numeric >= 0.4)::int as n_spikes,
    v.frame_count as frame_count, case when v.frame_count > 0 then round(v.face_count / v.frame_count, 4) else 0.0 end as face_presence_ratio
from scored s join said2 h using (job_id, start_idx, end_idx) join seen v using (job_id, start_idx, end_idx)""",
    "package_requests": f"""
with a as (select * from {o.CLIPS} c where {_NUMBER} % 2 = 0 qualify row_number() over (partition by job_id order by score desc, clip_id) <= 3),
b as (select a.job_id, a.clip_id, k.clip_hash from a left join (select * from {analytics._DUCK_BRIEFS} x where substr(clip_hash, 1, 1) <> '0') k on k.job_id = a.job_id and k.clip_id = a.clip_id),
g as (select job_id, string_agg(clip_id, '|' order by clip_id) as clips, min(case when clip_hash is null then clip_id end) as lacking from b group by job_id)
select j.job_id as job_id, j.video_path as video_path, 'v1' as prompt_version, g.clips as clips, case when g.clips is null then 'nothing to package' when g.lacking is not null then concat('no brief for an approved clip: ', g.lacking) end as error
from {_DUCK_JOBS} j left join g on g.job_id = j.job_id""",
    "package_reports": f"""
with p as (select job_id, list(concat('{{"clip_id":"', clip_id, '","pack_path":"', case when score > 0.6 then '' else concat('/elsewhere/', substr(job_id, 5, 9), '/') end, 'renders/', clip_id, '/package.json"}}') order by clip_id) as l from {o.CLIPS} c where score > 0.3 group by job_id)
select j.job_id as job_id, concat('{{"job_id":"', j.job_id, '","video_path":"', j.video_path, '","packs":[', coalesce(array_to_string(p.l, ','), ''), ']}}') as report from {_DUCK_JOBS} j left join p on p.job_id = j.job_id""",
    "request_patterns": f"with p as ({analytics.ORACLE['feedback_patterns']}) select j.job_id as job_id, (p.position - 1)::int as place, p.kind as kind, p.key as key, p.confidence as confidence, p.rule as rule from {_DUCK_JOBS} j cross join p where p.position <= 5",
    "speech_spans": f'select job_id, round(start, 6) as start, round(e, 6) as "end" from {_SPAN} s',
    "embeddable_spans": f"""select job_id, round(start, 6) as start, round(e, 6) as "end", floor(start * 16000)::bigint as first_sample, least(least(640000, floor(e * 16000)::bigint) - floor(start * 16000)::bigint, 16000) as n_samples
        from {_SPAN} s where least(640000, floor(e * 16000)::bigint) - floor(start * 16000)::bigint >= 8000""",
    "spoken_words": f"""with w as (select *, case when word_idx % 5 = 0 then 'SPEAKER_07' end as own from {o.WORDS} x), s as (select * from {td.duck(SPOKEN.replace('{end}', 'stop'))} x),
        p as (select w.job_id, w.seg_idx, w.word_idx, s.speaker, round(sum(least(w.end_seconds, s.stop) - greatest(w.start_seconds, s.start)), 6) as ov
            from w join s on s.job_id = w.job_id and least(w.end_seconds, s.stop) - greatest(w.start_seconds, s.start) > 0 group by all),
        best as (select * from p qualify row_number() over (partition by job_id, seg_idx, word_idx order by ov desc, speaker) = 1)
        select w.job_id as job_id, w.seg_idx as seg_idx, w.word_idx as word_idx, case when w.job_id in (select job_id from s) then coalesce(best.speaker, 'SPEAKER_00') else coalesce(w.own, 'SPEAKER_00') end as speaker
        from w left join best on best.job_id = w.job_id and best.seg_idx = w.seg_idx and best.word_idx = w.word_idx""",
    "flow_magnitudes": """with e as (select concat('job-', vec_id // 10) as job_id, (vec_id % 10)::int as frame_idx, embedding::double[] as e, len(embedding) // 2 as h from embeddings where embedding is not null)
        select job_id, frame_idx, round(case when row_number() over (partition by job_id order by frame_idx) = 1 then 0.0 else coalesce(list_sum(list_transform(range(1, h + 1), lambda i: sqrt(e[i] * e[i] + e[i + h] * e[i + h]))) / nullif(h, 0), 0.0) end, 6) as magnitude from e""",
    "scene_starts": f"select job_id, round(start, 6) as shot_seconds from {td.duck(_SCENES)} s qualify row_number() over (partition by job_id order by start) > 1",
    "settings_written": f"""with o as (select * from {td.duck(_SETTINGS.replace('REST', '0'))} x), n as (select * from {td.duck(_SETTINGS.replace('REST', '1'))} x),
        a as (select * from n union all select * from o where not exists (select 1 from n where n.path = o.path and n.key = o.key))
        select path, concat(string_agg(concat(key, '=', case when value = '' or regexp_matches(value, '\\s') then concat('"', replace(value, '"', '\\"'), '"') else value end), chr(10) order by key), chr(10)) as text from a group by path""",
    "resumed_jobs": f"""with w as (select * from {td.duck(_WORKSPACES)} x), s as (select * from {td.duck(_SIDECARS)} x), j as (select * from {td.duck(_JOB_FILES)} x),
        f as (select w.workspace, coalesce((select min(s.job_path) from s join j on j.job_path = s.job_path where s.workspace = w.workspace), (select min(job_path) from j where concat('/out/jobs/', j.job_id) = w.workspace)) as job_path from w)
        select workspace, job_path, case when job_path is null then 'no job for the workspace' end as error from f""",
    "workspace_ratios": f"""select w.workspace as workspace, coalesce(j.r, '') as ratios from {td.duck(_WORKSPACES)} w left join {td.duck(_SIDECARS)} s on s.workspace = w.workspace left join {td.duck(_JOB_FILES)} j on j.job_path = s.job_path""",
    "next_steps": "select s.state as state, p.package as package, case when s.state = 'package_prompt' and not p.package then 'done' else s.step end as step from (values "
    + ", ".join(f"('{a}', '{b}')" for a, b in [*workspaces.STEPS.items(), *((k, f"{v}-handoff") for k, v in workspaces.HANDOFFS.items()), ("done", "done"), ("prepare", "prepare")])
    + ") s(state, step) cross join (values (true), (false)) p(package)",
    "score_payloads": f"select job_id, clip_id, title, hook, concat(hook, '|', title) as reasons, round(score, 6) as final_score from {o.CLIPS} c",
}
