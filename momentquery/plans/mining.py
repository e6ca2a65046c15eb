"""Mining queries: windows, signals, blocks, choice, captions and camera."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BASE, PENALTIES, WEIGHTS, Camera, Captions, OneEuro
from ..functions import text as fx
from ..lexicon import Lexicon
from ..operators import camera, captions, identity, selection, signals, windows
from ..sources import testdata as td
from . import oracle as o

SIX = [n for n in WEIGHTS]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[fx.rounded(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def windows_enumerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.enumerated(td.segments(spark, sf_dir).drop("text", "speaker")).select("job_id", "start_idx", "end_idx", "start_seconds", "end_seconds", F.size("members").alias("n_segments")))


def text_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lex = Lexicon()
    s = td.segments(spark, sf_dir).withColumn("w", fx.tokens(F.col("text")))
    t, w = F.col("text"), F.col("w")
    return rounded(
        s.select(
            "job_id", "seg_idx", F.size("w").alias("n_tokens"), fx.hook(t, w, lex).alias("hook"), fx.keyword(w, lex).alias("keyword"), fx.numeric(t, w).alias("numeric"),
            fx.interjection(w, lex).alias("interjection"), fx.payoff(t, w, lex).alias("payoff"), fx.interview(t, w, lex).alias("interview"), fx.buried_lead(t, lex).alias("buried_lead"),
        )
    )


def window_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = signals.delivery(signals.lexical(windows.enumerated(signals.prepared(td.segments(spark, sf_dir), td.words(spark, sf_dir)))))
    return rounded(found.drop("members", "start_seconds", "end_seconds"))


def visual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.enumerated(td.segments(spark, sf_dir).drop("text", "speaker")).drop("members").withColumn("row_id", F.struct("job_id", "start_idx", "end_idx"))
    return rounded(signals.visual_summary(signals.visual(w, td.frames(spark, sf_dir))).drop("row_id", "face_count", "start_seconds", "end_seconds"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = td.segments(spark, sf_dir)
    found = windows.enumerated(signals.prepared(segments, td.words(spark, sf_dir)))
    return signals.scored(found, td.frames(spark, sf_dir), bounds=windows.enumerated(segments.drop("text", "speaker")))


def scored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _scored(spark, sf_dir)
    return rounded(s.select("job_id", "start_idx", "end_idx", "score", "motion", "shot_change", "face_presence", "rambling_middle", F.array_join("spike_categories", "|").alias("spikes"), F.array_join("reasons", "|").alias("why")))


def interview_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.interview_blocks(td.segments(spark, sf_dir)).withColumn("speakers", F.array_join("speakers", "|")))


def deduplicated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = selection.deduplicated(selection.ranked(_scored(spark, sf_dir)))
    return rounded(kept.select("job_id", F.posexplode("kept").alias("rank", "w")).select("job_id", "rank", "w.*"))


def selected_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.selected(_scored(spark, sf_dir), windows.interview_blocks(td.segments(spark, sf_dir))))


def clip_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs of all windows that could be chosen."""
    w = windows.enumerated(td.segments(spark, sf_dir))
    out = identity.briefs(w.drop("members"), w)
    return out.select("job_id", "start_idx", "end_idx", "clip_hash", F.array_join("speakers", "|").alias("speakers"), F.length("transcript").alias("n_chars"))


def caption_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(captions.clip_words(td.clips(spark, sf_dir), td.segments(spark, sf_dir), td.words(spark, sf_dir)))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = captions.clip_words(td.clips(spark, sf_dir), td.segments(spark, sf_dir), td.words(spark, sf_dir))
    return rounded(captions.dialogue(captions.lines(rounded(w))).withColumn("n_words", F.size("words")).drop("words"))


def clip_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(camera.modes(td.clips(spark, sf_dir), td.frames(spark, sf_dir)).select("job_id", "clip_id", "face_ratio", "mode"))


def crop_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey as job_id", "cast(320 + p_partkey % 1601 as int) as source_width", "cast(240 + p_partkey % 841 as int) as source_height")
    return camera.targets(sources)


def camera_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(camera.anchors(td.clips(spark, sf_dir), td.frames(spark, sf_dir)))


def crop_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = camera.anchors(td.clips(spark, sf_dir), td.frames(spark, sf_dir))
    size = spark.sql("select 1920 as source_width, 1080 as source_height")
    at = camera.origins(a, camera.targets(a.select("job_id").distinct().crossJoin(F.broadcast(size))))  # one row of sizes
    return camera.piecewise(at, ["job_id", "clip_id", "aspect_ratio"], "origin_x")


def crop_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = camera.anchors(td.clips(spark, sf_dir), td.frames(spark, sf_dir))
    size = spark.sql("select 1920 as source_width, 1080 as source_height")
    at = camera.origins(a, camera.targets(a.select("job_id").distinct().crossJoin(F.broadcast(size))))  # one row of sizes
    return at.select("job_id", "clip_id", "anchor_idx", "aspect_ratio", "origin_x", "origin_y")


def smoothed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = td.frames(spark, sf_dir).select(F.col("job_id").alias("key"), F.col("frame_idx").alias("idx"), F.when(F.col("frame_idx") % 23 == 22, F.col("timestamp_seconds") - 6).otherwise(F.col("timestamp_seconds")).alias("t"), F.col("face_x").alias("value"))
    return rounded(camera.one_euro(series, OneEuro(beta=0.3)))


def _digests(e: DataFrame) -> DataFrame:
    return e.select("job_id", "truncated", F.length("excerpt").alias("n_chars"), F.md5("excerpt").alias("digest"))


def brief_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the operator's own limits."""
    return _digests(identity.excerpts(td.segments(spark, sf_dir)))


QUERIES = {
    f.__name__: f
    for f in (
        windows_enumerated, text_signals, window_signals, visual_summary, scored_windows, interview_blocks, deduplicated_windows, selected_clips, clip_briefs,
        caption_words, caption_lines, clip_modes, crop_targets, camera_anchors, crop_origins, crop_expressions, smoothed_faces, brief_excerpts,
    )
}

_SCORED = f"with recursive {o.WINDOWS}, {o.SAID}, {o.DELIVERY}, {o.SEEN}, {o.scored(WEIGHTS, PENALTIES, BASE)}"
_CAP = Captions()
_CAPTION_WORDS = f"""
cw as (
    select job_id, clip_id, cast(row_number() over (partition by job_id, clip_id order by s, seg_idx, word_idx) - 1 as int) as word_ord, text, round(s, 6) as start_seconds, round(e, 6) as end_seconds,
        len(bare) > 0 and (regexp_matches(bare, '\\p{{Nd}}') or (upper(bare) = bare and lower(bare) <> bare and len(bare) > 1)
            or (not list_contains({o.quoted(captions.CAPTION_STOPWORDS)}, lower(bare)) and len(bare) >= {_CAP.emphasis_length})) as emphasis
    from (
        select c.job_id, c.clip_id, w.text, w.seg_idx, w.word_idx, greatest(w.start_seconds, c.start_seconds) - c.start_seconds as s, least(w.end_seconds, c.end_seconds) - c.start_seconds as e,
            trim(trim(w.text), '.,!?;:"''()[]{{}}') as bare
        from {o.CLIPS} c join {o.SEGMENTS} g on g.job_id = c.job_id and g.end_seconds > c.start_seconds and g.start_seconds < c.end_seconds
            join {o.WORDS} w on w.job_id = g.job_id and w.seg_idx = g.seg_idx and w.end_seconds > c.start_seconds and w.start_seconds < c.end_seconds
    ) x where e > s
)
"""
_CAM = Camera()
_MOVE = f"""case when abs({{t}} - {{c}}) <= {_CAM.safe_zone} then {{c}}
    when (case when abs({{t}} - {{c}}) > {_CAM.fast_from} then {_CAM.fast} else {_CAM.slow} end)::double * greatest(a.t - p.t, 0) >= abs({{t}} - {{c}}) then {{t}}
    else {{c}} + sign({{t}} - {{c}}) * (case when abs({{t}} - {{c}}) > {_CAM.fast_from} then {_CAM.fast} else {_CAM.slow} end)::double * greatest(a.t - p.t, 0) end"""
_ANCHORS = f"""
aimed as (
    select *, count(*) over (partition by job_id, clip_id) as m, max(face_x) over (partition by job_id, clip_id) as any_face from (
        select c.job_id, c.clip_id, f.timestamp_seconds - c.start_seconds as t, f.shot_change, f.face_x,
            row_number() over w as n,
            coalesce(last_value(f.face_x ignore nulls) over (w rows between unbounded preceding and current row), first_value(f.face_x ignore nulls) over (w rows between unbounded preceding and unbounded following)) as tx,
            coalesce(last_value(f.face_y ignore nulls) over (w rows between unbounded preceding and current row), first_value(f.face_y ignore nulls) over (w rows between unbounded preceding and unbounded following)) as ty
        from {o.CLIPS} c join {o.FRAMES} f on f.job_id = c.job_id and f.timestamp_seconds between c.start_seconds and c.end_seconds
        window w as (partition by c.job_id, c.clip_id order by f.timestamp_seconds - c.start_seconds, f.frame_idx)
    ) z
),
path as (
    select job_id, clip_id, n, m, t, tx as x, ty as y from aimed where n = 1 and any_face is not null
    union all
    select a.job_id, a.clip_id, a.n, a.m, a.t, case when a.shot_change then a.tx else {_MOVE.format(t='a.tx', c='p.x')} end, case when a.shot_change then a.ty else {_MOVE.format(t='a.ty', c='p.y')} end
    from path p join aimed a on a.job_id = p.job_id and a.clip_id = p.clip_id and a.n = p.n + 1
),
thin as (
    select job_id, clip_id, n, m, t, x, y, x as kx, y as ky, true as keep from path where n = 1
    union all
    select a.job_id, a.clip_id, a.n, a.m, a.t, a.x, a.y,
        case when a.n < a.m and a.m > 2 and abs(a.x - p.kx) < {_CAM.epsilon} and abs(a.y - p.ky) < {_CAM.epsilon} then p.kx else a.x end,
        case when a.n < a.m and a.m > 2 and abs(a.x - p.kx) < {_CAM.epsilon} and abs(a.y - p.ky) < {_CAM.epsilon} then p.ky else a.y end,
        not (a.n < a.m and a.m > 2 and abs(a.x - p.kx) < {_CAM.epsilon} and abs(a.y - p.ky) < {_CAM.epsilon})
    from thin p join path a on a.job_id = p.job_id and a.clip_id = p.clip_id and a.n = p.n + 1
),
anchors as (
    select job_id, clip_id, cast(row_number() over (partition by job_id, clip_id order by n) - 1 as int) as anchor_idx, t, x, y from thin where keep
    union all
    select c.job_id, c.clip_id, i.i, case i.i when 0 then 0.0 else c.end_seconds - c.start_seconds end, 0.5, 0.5
    from {o.CLIPS} c cross join (values (0), (1)) i(i) where not exists (select 1 from path p where p.job_id = c.job_id and p.clip_id = c.clip_id)
)
"""
_TARGETS = """
    case when {w} * sh >= {h} * sw then sw - sw % 2 else cast(floor(sh * {w} / {h}) as int) - cast(floor(sh * {w} / {h}) as int) % 2 end as target_width,
    case when {w} * sh >= {h} * sw then cast(floor(sw * {h} / {w}) as int) - cast(floor(sw * {h} / {w}) as int) % 2 else sh - sh % 2 end as target_height
"""


def _alpha(cut: str, dt: str) -> str:
    return f"(1 / (1 + (1 / (2 * pi() * ({cut}))) / {dt}))"


_DT, _SPEED = "(a.t - p.t)", "((a.v - p.y) / (a.t - p.t))"
_SMOOTH_SPEED = f"(case when p.d is null then {_SPEED} else {_alpha('1.0', _DT)} * {_SPEED} + (1 - {_alpha('1.0', _DT)}) * p.d end)"
_CUT = f"1.0 + 0.3::double * abs({_SMOOTH_SPEED})"
_LINE = f"concat('[', case when speaker = '' then 'SPEAKER' else coalesce(speaker, 'SPEAKER') end, ' ', printf('%.1f', round(start_seconds, 1)), 's] ', trim(text, {o.BLANKS}))"

ORACLE = {
    "windows_enumerated": f"with {o.WINDOWS} select job_id, start_idx, end_idx, round(start_seconds, 6) as start_seconds, round(end_seconds, 6) as end_seconds, end_idx - start_idx + 1 as n_segments from win",
    "text_signals": f"""select job_id, seg_idx, len(w)::int as n_tokens, round({o.hook('text', 'w')}, 6) as hook, round({o.keyword('w')}, 6) as keyword, round({o.numeric('text', 'w')}, 6) as numeric,
        round({o.interjection('w')}, 6) as interjection, round({o.payoff('text', 'w')}, 6) as payoff, round({o.interview('text', 'w')}, 6) as interview, {o.phrases('text', o.LEX.buried_leads)} > 0 as buried_lead
        from (select *, {o.tokens('text')} as w from {o.SEGMENTS} s) x""",
    "window_signals": f"with {o.WINDOWS}, {o.SAID}, {o.DELIVERY} select job_id, start_idx, end_idx, "
    + ", ".join(f"round({c}, 6) as {c}" for c in ("speaker_interaction", "hook", "keyword", "numeric", "interjection", "payoff", "question_to_answer", "interview_keyword", "middle_keyword", "delivery_variance"))
    + ", buried_lead, dangling_question from lexical join delivery using (job_id, start_idx, end_idx)",
    "visual_summary": f"""with {o.WINDOWS}, {o.SEEN} select job_id, start_idx, end_idx, frame_count, shot_change_count, round(avg_motion, 4) as avg_motion, round(peak_motion, 4) as peak_motion,
        case when frame_count > 0 then round(face_count / frame_count, 4) else 0.0 end as face_presence_ratio,
        case when frame_count > 0 then round(shot_change_count / (greatest(end_seconds - start_seconds, 1e-6) / 60), 4) else 0.0 end as shot_change_rate_per_minute,
        round(fx, 4) as avg_face_center_x, round(fy, 4) as avg_face_center_y,
        case when frame_count > 0 then concat('faces in ', round(face_count / frame_count * 100)::int, '% of sampled frames; avg motion ', printf('%.2f', round(avg_motion, 2)), ', peak motion ', printf('%.2f', round(peak_motion, 2)), '; ', shot_change_count, ' shot change(s)')
            else 'No sampled vision frames landed inside this clip window.' end as description from seen""",
    "scored_windows": _SCORED
    + """ select job_id, start_idx, end_idx, round(score, 6) as score, round(motion, 6) as motion, round(shot_change, 6) as shot_change, round(face_presence, 6) as face_presence, rambling_middle,
        concat_ws('|', case when keyword >= 0.16 then case when speaker_interaction >= 0.1 then 'emotional_confrontation' else 'controversy' end end,
            case when keyword >= 0.16 and payoff <= 0.1 then 'absurdity' end, case when motion >= 0.55 or shot_change >= 0.5 then 'action' end,
            case when payoff >= 0.45 and numeric >= 0.12 then 'unusually_useful_claim' end, case when interview_keyword >= 0.2 then 'expert_endorsement' end,
            case when interview_keyword >= 0.1 and numeric >= 0.1 then 'specific_pick' end, case when numeric >= 0.4 then 'big_number' end) as spikes,
        coalesce(nullif(concat_ws('|', case when hook >= 0.45 then 'strong hook' end, case when keyword >= 0.16 then 'shareability' end, case when payoff >= 0.35 then 'payoff' end,
            case when motion >= 0.55 or shot_change >= 0.5 then 'visual momentum' end, case when speaker_interaction >= 0.1 then 'back-and-forth' end,
            case when numeric >= 0.2 then 'numeric detail' end, case when question_to_answer >= 1.0 then 'question answered' end), ''), 'clarity') as why from scored""",
    "interview_blocks": f"""
with seg as (select *, lag(speaker) over w as ps, lag(end_seconds) over w as pe, lead(start_seconds) over w as ns, max(seg_idx) over (partition by job_id) as top from {o.SEGMENTS} s window w as (partition by job_id order by seg_idx)),
turns as (select *, start_seconds - lag(end_seconds) over (partition by job_id order by seg_idx) as gap from seg where speaker <> ps),
runs as (select *, sum(case when gap > 10 then 1 else 0 end) over (partition by job_id order by seg_idx) as run from turns),
bounds as (
    select job_id, run, count(*) as transition_count,
        min(seg_idx) - case when arg_min(start_seconds - pe, seg_idx) <= 5 then 1 else 0 end as lo,
        max(seg_idx) + case when coalesce(arg_max(ns - end_seconds, case when ns is not null then seg_idx end) <= 5 and arg_max(seg_idx < top, seg_idx), false) then 1 else 0 end as hi
    from runs group by job_id, run having count(*) >= 2
),
blocks as (
    select b.job_id, b.run, b.transition_count, arg_min(s.start_seconds, s.seg_idx) as start_seconds, arg_max(s.end_seconds, s.seg_idx) as end_seconds,
        list_sort(list(distinct s.speaker) filter (where s.speaker <> '')) as speakers
    from bounds b join seg s on s.job_id = b.job_id and s.seg_idx between b.lo and b.hi group by all
)
select job_id, cast(row_number() over (partition by job_id order by run) - 1 as int) as block_idx, round(start_seconds, 6) as start_seconds, round(end_seconds, 6) as end_seconds,
    array_to_string(speakers, '|') as speakers, transition_count
from blocks where end_seconds - start_seconds >= 30 and len(speakers) >= 2
""",
    "deduplicated_windows": _SCORED
    + """,
good as (select * exclude (n), row_number() over (partition by job_id order by score desc, start_idx, end_idx) as n from scored where score >= 0.35),
fold as (
    select job_id, n, [{'n': n, 's': start_seconds, 'e': end_seconds}] as kept from good where n = 1
    union all
    select g.job_id, g.n, case when len(list_filter(f.kept, lambda k: greatest(least(k.e, g.end_seconds) - greatest(k.s, g.start_seconds), 0) / least(k.e - k.s, g.end_seconds - g.start_seconds) > 0.5)) > 0
        then f.kept else list_append(f.kept, {'n': g.n, 's': g.start_seconds, 'e': g.end_seconds}) end
    from fold f join good g on g.job_id = f.job_id and g.n = f.n + 1
),
final as (select job_id, arg_max(kept, n) as kept from fold group by job_id),
each as (select job_id, unnest(kept) as k, generate_subscripts(kept, 1) - 1 as rank from final)
select e.job_id, e.rank::int as rank, g.start_idx, g.end_idx, round(g.start_seconds, 6) as start_seconds, round(g.end_seconds, 6) as end_seconds, round(g.score, 6) as score
from each e join good g on g.job_id = e.job_id and g.n = e.k.n
""",
    "clip_briefs": f"""with {o.WINDOWS},
texts as (
    select w.job_id, w.start_idx, w.end_idx, w.start_seconds, w.end_seconds, trim(string_agg(m.text, ' ' order by m.seg_idx), {o.BLANKS}) as t, list(m.speaker order by m.seg_idx) as sp
    from win w join seg m on m.job_id = w.job_id and m.seg_idx between w.start_idx and w.end_idx group by all
)
select job_id, start_idx, end_idx, substr(sha1(concat_ws('|', 'v1', printf('%.3f', start_seconds), printf('%.3f', end_seconds), t)), 1, 16) as clip_hash,
    array_to_string(list_filter(sp, lambda x, i: list_position(sp, x) = i), '|') as speakers, len(t)::int as n_chars from texts""",
    "caption_words": f"with {_CAPTION_WORDS} select * from cw",
    "caption_lines": f"""with recursive {_CAPTION_WORDS},
fold as (
    select job_id, clip_id, word_ord, 0 as line_idx, 1 as size, start_seconds as line_start, end_seconds as last_end from cw where word_ord = 0
    union all
    select w.job_id, w.clip_id, w.word_ord,
        case when f.size >= {_CAP.words} or w.end_seconds - f.line_start > {_CAP.seconds}::double or w.start_seconds - f.last_end > {_CAP.gap}::double then f.line_idx + 1 else f.line_idx end,
        case when f.size >= {_CAP.words} or w.end_seconds - f.line_start > {_CAP.seconds}::double or w.start_seconds - f.last_end > {_CAP.gap}::double then 1 else f.size + 1 end,
        case when f.size >= {_CAP.words} or w.end_seconds - f.line_start > {_CAP.seconds}::double or w.start_seconds - f.last_end > {_CAP.gap}::double then w.start_seconds else f.line_start end, w.end_seconds
    from fold f join cw w on w.job_id = f.job_id and w.clip_id = f.clip_id and w.word_ord = f.word_ord + 1
),
lines as (
    select f.job_id, f.clip_id, f.line_idx, min(w.start_seconds) as start_seconds, arg_max(w.end_seconds, w.word_ord) as end_seconds, string_agg(w.text, ' ' order by w.word_ord) as text,
        count(*)::int as n_words, string_agg(case when w.emphasis then concat('{{\\c&H0000F0FF&}}', e.t, '{{\\c&H00FFFFFF&}}') else e.t end, ' ' order by w.word_ord) as body
    from fold f join cw w using (job_id, clip_id, word_ord), lateral (select replace(replace(replace(w.text, '\\', '\\\\'), '{{', '\\{{'), '}}', '\\}}') as t) e group by all
),
timed as (select *, round(start_seconds * 100)::bigint as a, round(end_seconds * 100)::bigint as b from lines)
select job_id, clip_id, line_idx, start_seconds, end_seconds, text, n_words,
    concat('Dialogue: 0,', printf('%d:%02d:%02d.%02d', a // 360000, (a // 6000) % 60, (a // 100) % 60, a % 100), ',', printf('%d:%02d:%02d.%02d', b // 360000, (b // 6000) % 60, (b // 100) % 60, b % 100), ',Default,,0,0,0,,', body) as dialogue
from timed""",
    "clip_modes": f"""select c.job_id, c.clip_id, round(case when count(f.frame_idx) > 0 then count(f.face_x) / count(f.frame_idx) end, 6) as face_ratio,
        case when count(f.frame_idx) > 0 and count(f.face_x) / count(f.frame_idx) >= 0.5 then 'TRACK' else 'GENERAL' end as mode
        from {o.CLIPS} c left join {o.FRAMES} f on f.job_id = c.job_id and f.timestamp_seconds between c.start_seconds and c.end_seconds group by c.job_id, c.clip_id""",
    "crop_targets": "with s as (select p_partkey as job_id, (320 + p_partkey % 1601)::int as sw, (240 + p_partkey % 841)::int as sh from part) "
    + " union all ".join(f"select job_id, sw as source_width, sh as source_height, '{r}' as aspect_ratio, {_TARGETS.format(w=w, h=h)} from s" for r, (w, h) in camera.RATIOS.items()),
    "camera_anchors": f"with recursive {_ANCHORS} select job_id, clip_id, anchor_idx, round(t, 6) as t, round(x, 6) as x, round(y, 6) as y from anchors",
    "crop_origins": f"with recursive {_ANCHORS}, s as (select 1920 as sw, 1080 as sh), sizes as ("
    + " union all ".join(f"select '{r}' as aspect_ratio, sw, sh, {_TARGETS.format(w=w, h=h)} from s" for r, (w, h) in camera.RATIOS.items())
    + """) select job_id, clip_id, anchor_idx, aspect_ratio, least(greatest(round(x * sw - target_width / 2)::int, 0), greatest(sw - target_width, 0)) as origin_x,
        least(greatest(round(y * sh - target_height / 2)::int, 0), greatest(sh - target_height, 0)) as origin_y from anchors cross join sizes""",
    "smoothed_faces": f"""with recursive s as (
    select job_id as key, frame_idx as idx, case when frame_idx % 23 = 22 then timestamp_seconds - 6 else timestamp_seconds end as t, face_x as v, row_number() over (partition by job_id order by frame_idx) as n
    from {o.FRAMES} f where face_x is not null
),
fold as (
    select key, idx, n, t, v, v as y, null::double as d from s where n = 1
    union all
    select a.key, a.idx, a.n, a.t, a.v, case when a.t <= p.t then a.v else {_alpha(_CUT, _DT)} * a.v + (1 - {_alpha(_CUT, _DT)}) * p.y end, case when a.t <= p.t then p.d else {_SMOOTH_SPEED} end
    from fold p join s a on a.key = p.key and a.n = p.n + 1
)
select key, idx, round(t, 6) as t, round(v, 6) as value, round(y, 6) as smoothed from fold""",
}
#: Excerpts with limits of 1200 characters in all, 500 at the beginning and 300 at the end.
_EXCERPTS = f"""
with p as (select job_id, list({_LINE} order by seg_idx) as p from {o.SEGMENTS} s group by job_id),
f as (select *, array_to_string(p, chr(10)) as whole, len(p) - 1 as last from p),
q as (select *, list_filter(list_transform([1, 2, 3, 4, 5], lambda i: round(last * i / 6)::int), lambda i: i > 0 and i < last) as raw from f),
d as (select *, list_filter(raw, lambda x, i: list_position(raw, x) = i) as places from q),
m as (select *, greatest(400 // greatest(len(places), 1), 1) as per from d),
x as (select *, case when len(places) > 0 then rtrim(substr(array_to_string(list_transform(places, lambda i: case when len(p[i + 1]) > per then concat(rtrim(substr(p[i + 1], 1, greatest(per - 1, 1))), '…') else p[i + 1] end), chr(10)), 1, 400)) else '' end as middle from m),
e as (select job_id, len(whole) > 1200 as truncated, case when len(whole) <= 1200 then whole else concat(rtrim(substr(whole, 1, 500)), chr(10), chr(10), '[transcript truncated for brief — kept first 500 chars, 5 representative middle sample(s), and last 300 chars]', chr(10), chr(10),
    case when middle <> '' then concat('[representative middle excerpts]', chr(10), middle, chr(10)) else '' end, chr(10), chr(10), '[ending excerpt]', chr(10), chr(10), ltrim(right(whole, 300))) end as t from x)
select job_id, truncated, len(t)::int as n_chars, md5(t) as digest from e
"""
#: The small limits, and the operator's own: all, head, tail, and what is left for the middle.
_LIMITS = {"1200": "30000", "500": "18000", "300": "10000", "400": "2000"}
ORACLE["brief_excerpts"] = o.SEGMENTS.join(re.sub(rf"\b({'|'.join(_LIMITS)})\b", lambda m: _LIMITS[m[0]], part) for part in _EXCERPTS.split(o.SEGMENTS))

_TOUCH = "least({x}.e, b.be) - greatest({x}.s, b.bs) > 0"
_CLASH = "len(list_filter(f.kept, lambda k: greatest(least(k.e, {x}.e) - greatest(k.s, {x}.s), 0) / least(k.e - k.s, {x}.e - {x}.s) > 0.5)) > 0"
_FITS = f"list_filter(f.w, lambda x: {_TOUCH.format(x='x')} and not ({_CLASH.format(x='x')}))"
_SAME = "len(list_filter(f.kept, lambda k: k.s = a.s and k.e = a.e)) > 0"
_ADDED = "list_append(f.kept, {'n': a.n, 's': a.s, 'e': a.e})"
ORACLE["selected_clips"] = (
    ORACLE["deduplicated_windows"].rsplit("each as (", 1)[0]
    + f"""
allw as (select job_id, row_number() over (partition by job_id order by score desc, start_idx, end_idx) as n, start_idx, end_idx, start_seconds as s, end_seconds as e, score from scored),
wl as (select job_id, list({{'n': n, 's': s, 'e': e, 'score': score}} order by n) as w from allw group by job_id),
blk as ({ORACLE['interview_blocks']}),
bl as (select job_id, row_number() over (partition by job_id order by block_idx) as i, start_seconds as bs, end_seconds as be from blk),
f1 as (
    select wl.job_id, 0::bigint as i, wl.w, coalesce(final.kept, list_filter([{{'n': 0::bigint, 's': 0.0::double, 'e': 0.0::double}}], lambda x: false)) as kept from wl left join final on final.job_id = wl.job_id
    union all
    select f.job_id, b.i, f.w, case when len(list_filter(f.kept, lambda x: {_TOUCH.format(x='x')})) > 0 or len({_FITS}) = 0 then f.kept
        else list_append(f.kept, list_transform(list_concat(list_filter({_FITS}, lambda y: y.score >= 0.2), {_FITS})[1:1], lambda z: {{'n': z.n, 's': z.s, 'e': z.e}})[1]) end
    from f1 f join bl b on b.job_id = f.job_id and b.i = f.i + 1
),
f2 as (
    select job_id, 0::bigint as n, arg_max(kept, i) as kept from f1 group by job_id
    union all
    select f.job_id, a.n, case when {_SAME} or {_CLASH.format(x='a')} then f.kept else {_ADDED} end from f2 f join allw a on a.job_id = f.job_id and a.n = f.n + 1 where len(f.kept) < 5
),
f3 as (
    select job_id, 0::bigint as n, arg_max(kept, n) as kept from f2 group by job_id
    union all
    select f.job_id, a.n, case when {_SAME} then f.kept else {_ADDED} end from f3 f join allw a on a.job_id = f.job_id and a.n = f.n + 1 where len(f.kept) < 5
),
f4 as (select job_id, arg_max(kept, n)[1:12] as kept from f3 group by job_id),
each as (select job_id, unnest(kept) as k, generate_subscripts(kept, 1) - 1 as rank from f4)
select e.job_id, e.rank::int as rank, printf('clip-%03d', e.rank) as clip_id, g.start_idx, g.end_idx, round(g.s, 6) as start_seconds, round(g.e, 6) as end_seconds, round(g.score, 6) as score
from each e join allw g on g.job_id = e.job_id and g.n = e.k.n
"""
)
_TRIMMED = "regexp_replace(printf('%.6f', {x}), '[.]?0+$', '')"
ORACLE["crop_expressions"] = (
    f"with recursive {_ANCHORS}, s as (select 1920 as sw, 1080 as sh), sizes as ("
    + " union all ".join(f"select '{r}' as aspect_ratio, sw, sh, {_TARGETS.format(w=w, h=h)} from s" for r, (w, h) in camera.RATIOS.items())
    + f"""),
o as (select job_id, clip_id, aspect_ratio, anchor_idx as i, t, least(greatest(round(x * sw - target_width / 2)::int, 0), greatest(sw - target_width, 0)) as v from anchors cross join sizes),
k as (select *, lead(t) over w as t1, lead(v) over w as v1 from o window w as (partition by job_id, clip_id, aspect_ratio order by i))
select job_id, clip_id, aspect_ratio, case when min(v) = max(v) then min(v)::varchar else concat(
    string_agg(concat('if(lt(t\\,', {_TRIMMED.format(x='t1')}, ')\\,',
        case when t1 - t <= 0 or v = v1 then v::varchar else concat('(', v, '+(', v1 - v, ')*(t-', {_TRIMMED.format(x='t')}, ')/', {_TRIMMED.format(x='t1 - t')}, ')') end, '\\,'), '' order by i) filter (where t1 is not null),
    arg_max(v, i)::varchar, repeat(')', count(*)::int - 1)) end as expression
from k group by job_id, clip_id, aspect_ratio
"""
)
