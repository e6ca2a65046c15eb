"""Transcripts, frames, words and feedback derived from the benchmark tables by integer arithmetic.

The statements run in Spark and in DuckDB alike; only table names differ, and the one expression that splits a text
into its words. Times are whole milliseconds until the last division.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Openings that a transcript line may get, so that lexical signals have something to find.
PHRASES = (
    "Here's the thing: this crazy secret blew up.",
    "and the outcome was amazing",
    "he ran 5 miles in 30 minutes",
    "wait, listen, honestly this is wild",
    "if you watched the first part",
    "why did they ban it?",
    "so it turns out the rule was absurd, because we finally won $1,200.50",
    "what's your take on my biggest position?",
    "i'm long the ticker, hands down a high conviction thesis",
    "the 2nd lesson: learn the framework",
    "nobody talks about the lawsuit",
    "okay, right, so imagine 100 people",
    "they screamed and argued",
    "really?",
    "plainly nothing",
    "let me tell you the truth, actually",
)


def _case(values: tuple[str, ...], number: str) -> str:
    rows = " ".join("when {} then '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values))
    return f"case ({number}) % {len(values)} {rows} end"


SEGMENTS = f"""
select concat('job-', conv_id) as job_id, cast(turn as int) as seg_idx,
    case when conv_id % 4 = 0 and turn % 3 = 2 then 'guest' when conv_id % 9 = 5 and turn % 4 = 3 then '' else role end as speaker,
    cast((upto - dur) / 1000.0 as double) as start_seconds, cast(upto / 1000.0 as double) as end_seconds,
    cast(upto - dur as bigint) as start_ms, cast(dur as bigint) as dur_ms,
    case when (conv_id + turn) % 3 = 1 then concat({_case(PHRASES, "conv_id * 31 + turn * 7")}, ' ', text)
         when (conv_id + turn) % 3 = 2 then concat(text, ' ', {_case(PHRASES, "conv_id * 11 + turn * 5")})
         else {_case(PHRASES, "conv_id * 17 + turn * 3")} end as text
from (
    select conv_id, turn, role, text, dur, sum(dur + gap) over (partition by conv_id order by turn rows between unbounded preceding and current row) as upto
    from (
        select conv_id, turn, role, text, 3000 + (length(text) * 25) % 6000 as dur,
            case when (conv_id * 7 + turn * 3) % 5 = 0 then 6500 when (conv_id + turn) % 17 = 0 then 11000 else 400 end as gap
        from {{conversations}}
    ) a
) b
"""
FRAMES = """
select concat('job-', user_id) as job_id, cast(n - 1 as int) as frame_idx, cast((n - 1) * 1500 / 1000.0 as double) as timestamp_seconds,
    cast((event_id * 37 + user_id) % 101 as double) / 101 as motion_score, event_type = 'signup' as shot_change,
    case when event_type <> 'error' then cast((event_id * 13) % 97 as double) / 97 end as face_x,
    case when event_type <> 'error' then cast((event_id * 29) % 89 as double) / 89 end as face_y
from (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as n from {events}) e
"""
#: Words of a segment share its time; every seventh one ends early.
WORDS = """
select job_id, seg_idx, word_idx, text,
    cast((start_ms + word_idx * step) / 1000.0 as double) as start_seconds,
    cast((start_ms + word_idx * step + step - case when (word_idx + seg_idx) % 7 = 6 then cast(floor(step * 3 / 4) as bigint) else step % 3 end) / 1000.0 as double) as end_seconds
from (select job_id, seg_idx, start_ms, word_idx, text, cast(floor(dur_ms / n_words) as bigint) as step from {split_segments}) w
"""
HISTORY = """
select k as ord, concat('job-', o_custkey % 50) as job_id, concat('clip-', k % 40) as clip_id,
    cast((k * 13) % 95 + 0.5 as double) as duration_seconds, cast((k * 7) % 100 / 100.0 as double) as score,
    case when k % 5 = 0 then '' when k % 5 = 1 then 'absurdity' when k % 5 = 2 then 'action|big_number' when k % 5 = 3 then 'controversy|absurdity' else 'specific_pick' end as spikes,
    case when k % 3 = 0 then '9:16|1:1|16:9' when k % 3 = 1 then '9:16' else '' end as ratio_list,
    (k * 37) % 101 < 30 + case when (k * 13) % 95 < 20 then 45 else 0 end + case when k % 5 = 2 then 40 else 0 end
        + case when k % 3 = 1 then 20 else 0 end - case when (k * 7) % 100 >= 85 then 60 else 0 end as posted
from (select o_orderkey as k, o_custkey from {orders}) o
"""
#: Clips of jobs: some time ranges, and the scores an outside model gave some of them. Every customer is a clip; each
#: 1,500 of them are 15 clips of each of 100 jobs, about as many jobs as there are conversations.
CLIPS = """
select concat('job-', c_custkey % 100 + cast((c_custkey - c_custkey % 1500) / 15 as bigint)) as job_id,
    concat('clip-', lpad(cast((c_custkey % 1500 - c_custkey % 100) / 100 as bigint) || '', 3, '0')) as clip_id,
    cast((c_custkey * 7) % 23 as double) as start_seconds, cast((c_custkey * 7) % 23 + 12 + (c_custkey * 3) % 19 as double) as end_seconds,
    cast((c_custkey * 53) % 97 / 100.0 as double) as score, c_name as title, c_mktsegment as hook
from (select c_custkey - c_custkey % 100 + (c_custkey * 37) % 100 as c_custkey, c_name, c_mktsegment from {customer}) c
"""


def statement(sql: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    names = ("conversations", "events", "orders", "customer", "part", "lineitem", "embeddings", "supplier", "nation")
    return spark.sql(sql.format(**{n: f"parquet.`{sf_dir}/{n}.parquet`" for n in names}))


def duck(sql: str) -> str:
    """The statement as a DuckDB subquery over views."""
    names = ("conversations", "events", "orders", "customer", "part", "lineitem", "embeddings", "supplier", "nation")
    return f"({sql.format(**{n: n for n in names}, split_segments=DUCK_SPLIT)})"


SPARK_SPLIT = "(select job_id, seg_idx, start_ms, dur_ms, size(split(text, ' ')) as n_words, word_idx, word as text from ({segments}) s lateral view posexplode(split(text, ' ')) p as word_idx, word)"
DUCK_SPLIT = (
    "(select job_id, seg_idx, start_ms, dur_ms, len(string_split(text, ' ')) as n_words, "
    "cast(unnest(range(len(string_split(text, ' ')))) as int) as word_idx, unnest(string_split(text, ' ')) as text from ("
    + SEGMENTS.format(conversations="conversations")
    + ") s)"
)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement(SEGMENTS, spark, sf_dir)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement(WORDS.replace("{split_segments}", SPARK_SPLIT.replace("{segments}", SEGMENTS)), spark, sf_dir)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement(FRAMES, spark, sf_dir)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, job_id, clip_id, duration_seconds, score, posted, and arrays spike_categories and ratios."""
    rows = statement(HISTORY, spark, sf_dir)
    return rows.selectExpr(
        "ord", "job_id", "clip_id", "duration_seconds", "score", "posted",
        "filter(split(spikes, '[|]'), x -> x <> '') as spike_categories",
        "filter(split(ratio_list, '[|]'), x -> x <> '') as ratios",
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement(CLIPS, spark, sf_dir)
