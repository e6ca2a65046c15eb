"""Pieces of the DuckDB statements that hold the engine's results to account."""

from __future__ import annotations

from ..lexicon import Lexicon
from ..sources import testdata as td

SEGMENTS, FRAMES, WORDS, HISTORY, CLIPS = (td.duck(x) for x in (td.SEGMENTS, td.FRAMES, td.WORDS, td.HISTORY, td.CLIPS))
LEX = Lexicon()
#: The white space that stripping takes off.
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def tokens(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}_](?:[\\p{{L}}\\p{{N}}_'']*[\\p{{L}}\\p{{N}}_])?')"


def phrases(t: str, values) -> str:
    return "(" + " + ".join("contains(lower({}), '{}')::int".format(t, v.replace("'", "''")) for v in values) + ")"


def distinct(w: str, values) -> str:
    return f"len(list_distinct(list_filter({w}, lambda z: list_contains({quoted(values)}, z))))"


def every(w: str, values) -> str:
    return f"len(list_filter({w}, lambda z: list_contains({quoted(values)}, z)))"


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def keyword(w: str) -> str:
    return "(" + " + ".join(f"({distinct(w, b)} > 0)::int" for b in LEX.buckets) + f") / {float(len(LEX.buckets))}"


def hook(t: str, w: str) -> str:
    return clamp(f"0.35::double * least({phrases(t, LEX.hook_phrases)}, 2) + 0.2::double * least({every(w + '[1:4]', LEX.hook_words)}, 2) + 0.5::double * ({keyword(w)})")


def payoff(t: str, w: str) -> str:
    return clamp(f"0.6::double * least({phrases(t, LEX.payoff_phrases)}, 2) + 0.25::double * least({distinct(w, LEX.payoff_words)}, 3)")


def interview(t: str, w: str) -> str:
    return clamp(f"0.45::double * least({phrases(t, LEX.interview_phrases)}, 2) + 0.2::double * least({distinct(w, LEX.interview_words)}, 3)")


def numeric(t: str, w: str) -> str:
    hits = f"len(regexp_extract_all({t}, '\\b\\d+(?:[\\.,]\\d+)?\\b|\\b\\d+(?:st|nd|rd|th)\\b'))"
    return f"case when len({w}) = 0 then 0.0 else {clamp(f'{hits}::double / len({w}) * 5')} end"


def interjection(w: str) -> str:
    return f"case when len({w}) = 0 then 0.0 else {clamp(f'{every(w, LEX.interjections)} / greatest(len({w}) / 20.0::double, 1.0)')} end"


#: Windows of segments: starts grow until one is longer than 45 s; those of 15 s or more count.
WINDOWS = """
seg as (select * from {segments} s),
win as (
    select job_id, start_idx, end_idx, start_seconds, end_seconds from (
        select a.job_id, a.seg_idx as start_idx, b.seg_idx as end_idx, a.start_seconds, b.end_seconds,
            max(b.end_seconds) over (partition by a.job_id, a.seg_idx order by b.seg_idx) - a.start_seconds as longest
        from seg a join seg b on a.job_id = b.job_id and b.seg_idx >= a.seg_idx
    ) g where longest <= 45 and end_seconds - start_seconds >= 15
)
""".replace("{segments}", SEGMENTS)

_N = "(w.end_idx - w.start_idx + 1)"
_HALF = f"greatest(cast(floor({_N} / 2) as int), 1)"
_POS = "(m.seg_idx - w.start_idx)"


def _text(where: str) -> str:
    return f"coalesce(string_agg(m.text, ' ' order by m.seg_idx) filter (where {where}), '')"


#: What the members of a window say, and how often the speaker changes.
SAID = f"""
said as (
    select w.job_id, w.start_idx, w.end_idx, w.start_seconds, w.end_seconds, any_value({_N}) as n,
        {_text('true')} as t, {_text(f'{_POS} = 0')} as first, trim({_text('m.seg_idx = w.end_idx')}, {BLANKS}) as last,
        {_text('m.seg_idx < w.end_idx')} as rest, {_text(f'{_POS} < {_HALF}')} as head, {_text(f'{_POS} >= {_HALF}')} as tail,
        {_text(f'{_POS} > 0 and m.seg_idx < w.end_idx')} as middle,
        count(*) filter (where {_POS} > 0 and m.speaker <> m.before) as turns
    from win w join (select *, lag(speaker) over (partition by job_id order by seg_idx) as before from seg) m
        on m.job_id = w.job_id and m.seg_idx between w.start_idx and w.end_idx
    group by all
),
spoken as (select *, {tokens('t')} as tw, {tokens('first')} as fw, {tokens('rest')} as rw, {tokens('tail')} as lw, {tokens('middle')} as mw,
    case when n < 2 then 0.0 else {clamp('turns / (greatest(end_seconds - start_seconds, 1e-6) / 10)')} end as speaker_interaction from said),
lexical as (
    select job_id, start_idx, end_idx, start_seconds, end_seconds, n, speaker_interaction, {hook('first', 'fw')} as hook, {keyword('tw')} as keyword,
        {numeric('t', 'tw')} as numeric, {interjection('tw')} as interjection, {payoff('t', 'tw')} as payoff,
        cast(case when n < 2 or not contains(head, '?') then 0.0 when {distinct('lw', LEX.answer_words)} > 0 or {payoff('tail', 'lw')} > 0 then 1.0 else 0.35 end as double) as question_to_answer,
        case when speaker_interaction >= 0.1 then {interview('t', 'tw')} else 0.0 end as interview_keyword,
        {phrases('first', LEX.buried_leads)} > 0 as buried_lead, suffix(last, '?') and {payoff('rest', 'rw')} = 0 as dangling_question,
        case when n > 2 then {keyword('mw')} end as middle_keyword
    from spoken
)
"""
DELIVERY = f"""
pauses as (
    select *, start_seconds - lag(end_seconds) over (partition by job_id order by seg_idx, word_idx) as gap, lag(seg_idx) over (partition by job_id order by seg_idx, word_idx) as was
    from {WORDS} w
),
delivery as (
    select w.job_id, w.start_idx, w.end_idx,
        case when count(p.gap) >= 3 then {clamp('stddev_pop(p.gap) / 0.35')} else 0.0 end as delivery_variance
    from win w left join pauses p on p.job_id = w.job_id and p.seg_idx between w.start_idx and w.end_idx and p.was >= w.start_idx and p.gap >= 0
    group by all
)
"""
SEEN = f"""
frame as (select * from {FRAMES} f),
seen as (
    select w.job_id, w.start_idx, w.end_idx, w.start_seconds, w.end_seconds, count(f.frame_idx) as frame_count, count(f.face_x) as face_count,
        count(*) filter (where f.shot_change) as shot_change_count, coalesce(avg(f.motion_score), 0) as avg_motion, coalesce(max(f.motion_score), 0) as peak_motion,
        avg(f.face_x) as fx, avg(f.face_y) as fy
    from win w left join frame f on f.job_id = w.job_id and f.timestamp_seconds >= w.start_seconds and f.timestamp_seconds < w.end_seconds
    group by all
)
"""
_MIDDLE = """
middle as (
    select w.job_id, w.start_idx, w.end_idx, coalesce(avg(f.motion_score), 0) as middle_motion
    from win w join seg a on a.job_id = w.job_id and a.seg_idx = w.start_idx + 1 join seg b on b.job_id = w.job_id and b.seg_idx = w.end_idx - 1
        left join frame f on f.job_id = w.job_id and f.timestamp_seconds >= a.start_seconds and f.timestamp_seconds < b.end_seconds
    where w.end_idx - w.start_idx >= 2 group by all
)
"""


def scored(weights: dict[str, float], penalties: dict[str, float], base: float) -> str:
    plus = " + ".join([f"{base}::double"] + [f"{w}::double * {n}" for n, w in weights.items()])
    minus = " + ".join(f"case when {n} then {p}::double else 0.0 end" for n, p in penalties.items())
    return f"""
{_MIDDLE},
signals as (
    select l.*, d.delivery_variance, {clamp('s.avg_motion')} as motion, {clamp('s.shot_change_count / (greatest(s.end_seconds - s.start_seconds, 1e-6) / 5)')} as shot_change,
        case when s.frame_count > 0 then s.face_count / s.frame_count else 0.0 end as face_presence,
        coalesce(m.middle_motion <= 0.25 and l.middle_keyword <= 0.05, false) as rambling_middle
    from lexical l join delivery d using (job_id, start_idx, end_idx) join seen s using (job_id, start_idx, end_idx) left join middle m using (job_id, start_idx, end_idx)
),
scored as (select *, round({clamp(f'{plus} - ({minus})')}, 9) as score from signals)
"""
