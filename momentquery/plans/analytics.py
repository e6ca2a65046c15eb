"""Feedback queries: the history's cohorts, and what comes back from outside models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts
from ..operators import handoff, identity, profile
from ..sources import testdata as td
from . import oracle as o
from .mining import rounded


def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.latest(td.history(spark, sf_dir)).select("job_id", "clip_id", "ord", "first_ord", "posted", "duration_seconds", "score"))


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.summary(profile.latest(td.history(spark, sf_dir)))


def feedback_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.patterns(profile.latest(td.history(spark, sf_dir)))


def feedback_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profile.recent(td.history(spark, sf_dir), 20).select("ord", "job_id", "clip_id", "score"))


def _model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the clips, some twice, some fields null, some rows without a key."""
    return spark.sql(
        f"""
        select job_id, if(ord % 31 = 30, null, clip_id) as clip_id, ord, if(ord % 7 = 0, null, cast((ord * 29) % 101 as double) / 101) as final_score,
            if(ord % 5 = 0, null, concat('model ', title)) as title, if(ord % 4 = 0, null, concat('model ', hook)) as hook
        from (
            select c.job_id, c.clip_id, c.title, c.hook, c.n * 2 + r as ord
            from (select *, row_number() over (order by job_id, clip_id) as n from ({td.CLIPS.format(customer=f"parquet.`{sf_dir}/customer.parquet`")}) x) c lateral view explode(array(0, 1)) t as r
        ) y where ord % 3 <> 0
        """
    )


_DUCK_SCORES = f"""
(select job_id, case when ord % 31 = 30 then null else clip_id end as clip_id, ord, case when ord % 7 = 0 then null else cast((ord * 29) % 101 as double) / 101 end as final_score,
    case when ord % 5 = 0 then null else concat('model ', title) end as title, case when ord % 4 = 0 then null else concat('model ', hook) end as hook
from (
    select c.job_id, c.clip_id, c.title, c.hook, c.n * 2 + r as ord
    from (select *, row_number() over (order by job_id, clip_id) as n from {o.CLIPS} x) c cross join (values (0), (1)) t(r)
) y where ord % 3 <> 0)
"""


def review_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = handoff.review(td.clips(spark, sf_dir), _model_scores(spark, sf_dir))
    return rounded(out.select("job_id", "rank", "clip_id", "score", "title", "hook"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(handoff.approved(td.clips(spark, sf_dir), 3, 0.75).select("job_id", "clip_id", "score", "approved", "threshold_met_count"))


def _briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = td.clips(spark, sf_dir)
    return c.select("job_id", "clip_id", "score", F.col("title").alias("transcript"), identity.clip_hash(F.col("start_seconds"), F.col("end_seconds"), F.concat("title", "clip_id", "job_id")).alias("clip_hash"))


_DUCK_BRIEFS = f"(select job_id, clip_id, score, title as transcript, substr(sha1(concat_ws('|', 'v1', printf('%.3f', start_seconds), printf('%.3f', end_seconds), concat(title, clip_id, job_id))), 1, 16) as clip_hash from {o.CLIPS} x)"


def resolved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose number is even get an answer for all clips, others for some; the cache knows some more; some
    answers are for another clip or for none."""
    b = _briefs(spark, sf_dir).withColumn("rank", F.expr("row_number() over (partition by job_id order by score desc, clip_id)"))
    number = F.regexp_extract("job_id", r"\d+", 0).cast("int")
    full = b.withColumn("number", number)
    response = full.filter("number % 2 = 0 or rank % 3 <> 0").select(
        "job_id",
        F.when((F.col("number") % 11 == 3) & (F.col("rank") == 1), "clip-999").otherwise(F.col("clip_id")).alias("clip_id"),
        F.when((F.col("number") % 13 == 5) & (F.col("rank") == 2), F.concat(F.lit("x"), "clip_hash")).otherwise(F.col("clip_hash")).alias("clip_hash"),
        F.round("score", 6).alias("final_score"),
    )
    cache = full.filter("rank % 3 = 0 and number % 5 <> 0").select("job_id", "clip_hash", F.lit(0.5).alias("final_score"))
    return rounded(handoff.resolved_scores(b.select("job_id", "clip_id", "clip_hash", "rank"), response, cache))


def package_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    approved = handoff.approved(td.clips(spark, sf_dir), 3, 0.75).select("job_id", "clip_id", F.when(F.col("score") > 0.5, F.col("score")).alias("score"), "approved")
    known = _briefs(spark, sf_dir).filter("substring(clip_hash, 1, 1) <> '0'")
    return rounded(handoff.package_briefs(approved, known).select("job_id", "clip_id", "clip_hash", "score", "error"))


def resolved_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _briefs(spark, sf_dir)
    request = b.filter("substring(clip_hash, 1, 1) < 'c'").withColumn("ord", F.expr("row_number() over (partition by job_id order by clip_id)"))
    other = F.when(F.substring("clip_hash", 2, 1) == "7", F.lit("clip-999")).otherwise(F.col("clip_id"))
    response = b.filter("substring(clip_hash, 1, 1) > '2'").select("job_id", "clip_hash", other.alias("clip_id"), F.col("transcript").alias("title"))
    return handoff.resolved_packs(request, response).select("job_id", "clip_hash", "clip_id", "ord", "status", "title")


def merged_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("clip-"), F.col("c_custkey")).alias("clip_id"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("m"))
    stdin = n.filter("k % 2 = 0").select("clip_id", (F.col("k") % 4 == 0).alias("posted"), F.when(F.col("k") % 6 == 0, F.col("m")).alias("notes"))
    return handoff.merged_feedback(stdin, n.filter("k % 3 = 0").select("clip_id"), n.filter("k % 5 = 0").select("clip_id"), n.filter("k % 7 = 0").select("clip_id", F.concat(F.lit("note "), "m").alias("notes")))


def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = td.clips(spark, sf_dir).withColumn("clip_id", F.concat_ws("/", "job_id", "clip_id"))
    feedback = c.select("clip_id", (F.col("score") > 0.4).alias("posted")).unionByName(c.filter("score > 0.9").select(F.concat("clip_id", F.lit("-gone")).alias("clip_id"), F.lit(True).alias("posted")))
    return rounded(handoff.feedback_rows(feedback, c))


def duplicate_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handoff.duplicates(td.history(spark, sf_dir), "clip_id")


ARTIFACTS = ("job", "scoring_request", "brief_request", "brief_response", "scoring_response", "review", "approved", "render_report", "package_request", "package_response", "package_report")


def workspace_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    flags = {name: ((F.col("o_orderkey") * (i + 3) + i) % (i + 2) == 0) & (F.col("o_orderkey") % 12 > i) for i, name in enumerate(ARTIFACTS)}
    return rows.select("o_orderkey", handoff.existing_state(flags).alias("state"))


def publish_pack_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr(
        "p_partkey",
        "transform(sequence(1, 4 + p_partkey % 3), i -> concat(p_name, repeat('!', 60 + cast(p_partkey * i % 30 as int)))) as titles",
        "transform(sequence(1, 2 + p_partkey % 4), i -> if(p_partkey % 9 = i, ' ', p_brand)) as thumbnail_texts",
        "repeat('c', cast(p_partkey % 520 as int)) as social_caption",
        "transform(sequence(1, 4 + p_partkey % 8), i -> concat(if(p_partkey % 17 = i, '', '#'), if(p_partkey % 13 = i, 'Tag1', concat('tag', i)))) as hashtags",
        "transform(sequence(1, 1 + p_partkey % 4), i -> p_type) as hooks",
    )
    return contracts.publish_packs(rows).select("p_partkey", F.array_join("errors", "|").alias("errors"))


def span_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "cast(l_quantity - 10 as double) as start_seconds", "cast(l_linenumber * 7 as double) as end_seconds")
    found = contracts.spans(rows, zero_length=False)
    return found.groupBy("l_linenumber", F.array_join("errors", "|").alias("errors")).agg(F.count("*").alias("n"))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/orders.parquet")
    size = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") * 100)
    path = F.concat(F.lit("/videos/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey"), F.lit(".mp4"))
    return c.select("o_orderkey", identity.job_fingerprint(path, "1.0", size, F.col("o_orderkey") * 1000 + 7).alias("job_id"))


def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    raw = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey",
        F.when(k % 6 == 0, " All ").when(k % 6 == 1, "9:16, 1:1,,").when(k % 6 == 2, "4:3,16:9").when(k % 6 == 3, "").otherwise("16:9").alias("ratios"),
        F.when(k % 4 == 0, "x").otherwise((k % 9 - 3).cast("string")).alias("count"),
        F.when(k % 7 == 0, "high").otherwise(((k % 15) / 10).cast("string")).alias("score"),
    )
    ratios, bad = identity.chosen_ratios(F.col("ratios"), contracts.RATIOS)
    return raw.select("c_custkey", F.array_join(ratios, "|").alias("ratios"), bad.alias("bad_ratio"), identity.positive_int(F.col("count")).alias("n"), identity.share(F.col("score")).alias("score"))


def settings_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    lines = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.when(k % 6 == 0, F.concat(F.lit("# KEY"), k))
        .when(k % 6 == 1, F.concat(F.lit("  KEY"), k, F.lit(' = "quoted value" ')))
        .when(k % 6 == 2, F.concat(F.lit("KEY"), k, F.lit("=a=b")))
        .when(k % 6 == 3, F.lit("no equals"))
        .when(k % 6 == 4, F.concat(F.lit("KEY"), k, F.lit("='single'")))
        .otherwise(F.lit("   "))
        .alias("value")
    )
    return identity.settings(lines)


QUERIES = {
    f.__name__: f
    for f in (
        feedback_latest, feedback_summary, feedback_patterns, feedback_recent, review_manifest, approvals, resolved_scores, package_briefs, resolved_packs,
        merged_feedback, feedback_rows, duplicate_clips, workspace_states, publish_pack_errors, span_errors, identities, parsed_options, settings_read,
    )
}

_LATEST = f"""
h as (select * from {o.HISTORY} x),
l as (select *, min(ord) over (partition by job_id, clip_id) as first_ord from h qualify row_number() over (partition by job_id, clip_id order by ord desc) = 1)
"""
_RATE = "case when {d} > 0 then round({n} / {d}, 4) else 0.0 end"
_FLAGS = {name: f"((o_orderkey * {i + 3} + {i}) % {i + 2} = 0 and o_orderkey % 12 > {i})" for i, name in enumerate(ARTIFACTS)}
_TRUE_PACKS = """
with p as (select *, p_partkey as k from part),
x as (
    select k, list_transform(range(1, 5 + k % 3), lambda i: length(concat(p_name, repeat('!', (60 + k * i % 30)::int)))) as titles,
        list_transform(range(1, 3 + k % 4), lambda i: length(trim(case when k % 9 = i then ' ' else p_brand end))) as thumbs, k % 520 as cap,
        list_transform(range(1, 5 + k % 8), lambda i: concat(case when k % 17 = i then '' else '#' end, case when k % 13 = i then 'Tag1' else concat('tag', i) end)) as tags,
        list_transform(range(1, 2 + k % 4), lambda i: length(trim(p_type))) as hooks
    from p
)
select k as p_partkey, concat_ws('|',
    case when not (len(titles) >= 5 and len(list_filter(titles, lambda n: n not between 1 and 80)) = 0) then 'titles' end,
    case when not (len(thumbs) >= 3 and len(list_filter(thumbs, lambda n: n not between 1 and 28)) = 0) then 'thumbnail_texts' end,
    case when not (cap between 1 and 500) then 'social_caption' end,
    case when not (len(tags) between 5 and 10 and len(list_filter(tags, lambda t: not starts_with(t, '#'))) = 0 and len(list_distinct(list_transform(tags, lambda t: lower(t)))) = len(tags)) then 'hashtags' end,
    case when not (len(hooks) between 2 and 3 and len(list_filter(hooks, lambda n: n not between 1 and 140)) = 0) then 'hooks' end) as errors
from x
"""
ORACLE = {
    "feedback_latest": f"with {_LATEST} select job_id, clip_id, ord, first_ord, posted, round(duration_seconds, 6) as duration_seconds, round(score, 6) as score from l",
    "feedback_summary": f"""with {_LATEST},
        d as (select 'all' as dimension, '' as key, posted from l union all select 'ratio', unnest(list_filter(string_split(ratio_list, '|'), lambda z: z <> '')), posted from l
            union all select 'spike', unnest(list_filter(string_split(spikes, '|'), lambda z: z <> '')), posted from l)
        select dimension, key, count(*) as total, count(*) filter (where posted) as kept, count(*) filter (where not posted) as skipped, {_RATE.format(n='count(*) filter (where posted)', d='count(*)')} as keep_rate from d group by dimension, key""",
    "feedback_patterns": f"""with {_LATEST},
        d as (
            select 0 as ko, 'length' as kind, case when duration_seconds < 20 then 'under_20s' when duration_seconds < 30 then '20_to_30s' when duration_seconds < 45 then '30_to_45s' when duration_seconds < 60 then '45_to_60s' else 'over_60s' end as key,
                case when duration_seconds < 20 then '0' when duration_seconds < 30 then '1' when duration_seconds < 45 then '2' when duration_seconds < 60 then '3' else '4' end as key_ord, posted from l
            union all select 1, 'spike', s, s, posted from (select unnest(list_filter(string_split(spikes, '|'), lambda z: z <> '')) as s, posted from l) x
            union all select 2, 'score', '0.85', '0', posted from l where score >= 0.85
            union all select 3, 'ratio', s, s, posted from (select unnest(list_filter(string_split(ratio_list, '|'), lambda z: z <> '')) as s, posted from l) x
        ),
        overall as (select count(*) as n, round(count(*) filter (where posted) / count(*), 4) as r from l),
        c as (select ko, kind, key, key_ord, count(*) as n, round(count(*) filter (where posted) / count(*), 4) as r from d group by all),
        g as (select c.*, o.r as all_r, case when kind = 'score' then o.r - c.r else abs(c.r - o.r) end as dev from c, overall o where o.n >= 5),
        t as (select *, case when n >= 15 and dev >= 0.30 then 2 when n >= 8 and dev >= 0.25 then 1 when n >= 5 and dev >= 0.20 and kind <> 'score' then 0 end as rank from g)
        select cast(row_number() over (order by rank desc, n, ko, key_ord) as int) as position, kind, key, case when r > all_r then 'keeps' else 'skips' end as direction,
            case rank when 2 then 'high' when 1 then 'medium' else 'low' end as confidence, n as sample_size, r as keep_rate, all_r as overall_keep_rate,
            case kind when 'length' then concat('User ', does, ' clips ', label, tail) when 'spike' then concat('User ', does, ' ''', key, ''' clips', tail)
                when 'score' then concat('User skips many high-scoring clips (', floor(r * 100)::int, '% keep rate at score >= 0.85 vs. ', floor(all_r * 100)::int, '% overall).') else concat('User ', does, ' ', key, ' renders', tail) end as rule,
            case kind when 'length' then concat('Clip creator ', does, ' clips ', label, '; bias candidate scoring accordingly.')
                when 'spike' then concat('Clip creator ', does, ' ''', key, ''' spike clips; weight that signal accordingly when scoring.')
                when 'score' then 'Rubric score alone is not a reliable signal for this creator; weight spike categories, pacing, and concrete payoff over raw score.'
                else concat('Clip creator mostly ', does, ' the ', key, ' ratio; consider adjusting default ratios accordingly.') end as suggested_memory
        from (select *, case when r > all_r then 'keeps' else 'skips' end as does, concat(' (', floor(r * 100)::int, '% keep rate vs. ', floor(all_r * 100)::int, '% overall).') as tail,
            case key when 'under_20s' then 'under 20s' when '20_to_30s' then 'between 20 and 30s' when '30_to_45s' then 'between 30 and 45s' when '45_to_60s' then 'between 45 and 60s' when 'over_60s' then 'over 60s' else key end as label from t) t where rank is not null""",
    "feedback_recent": f"select ord, job_id, clip_id, round(score, 6) as score from {o.HISTORY} x order by ord desc limit 20",
    "review_manifest": f"""with m as (select * from {_DUCK_SCORES} z where clip_id is not null qualify row_number() over (partition by job_id, clip_id order by ord desc) = 1),
        j as (select c.job_id, c.clip_id, coalesce(m.final_score, c.score) as s, coalesce(m.title, c.title) as title, coalesce(m.hook, c.hook) as hook from {o.CLIPS} c left join m on m.job_id = c.job_id and m.clip_id = c.clip_id)
        select job_id, cast(row_number() over (partition by job_id order by s desc, clip_id) as int) as rank, clip_id, round(s, 6) as score, title, hook from j""",
    "approvals": f"""with r as (select *, row_number() over (partition by job_id order by score desc, clip_id) as n from {o.CLIPS} c)
        select job_id, clip_id, round(score, 6) as score, n <= 3 as approved, count(*) filter (where n <= 3 and score >= 0.75) over (partition by job_id) as threshold_met_count from r""",
    "resolved_scores": f"""with b as (select *, cast(row_number() over (partition by job_id order by score desc, clip_id) as int) as rank, regexp_extract(job_id, '\\d+')::int as number from {_DUCK_BRIEFS} x),
        r as (select job_id, case when number % 11 = 3 and rank = 1 then 'clip-999' else clip_id end as r_clip, case when number % 13 = 5 and rank = 2 then concat('x', clip_hash) else clip_hash end as clip_hash, round(score, 6) as r_score from b where number % 2 = 0 or rank % 3 <> 0),
        c as (select job_id, clip_hash, 0.5::double as c_score from b where rank % 3 = 0 and number % 5 <> 0),
        j as (select coalesce(b.job_id, r.job_id) as job_id, b.clip_id, coalesce(b.clip_hash, r.clip_hash) as clip_hash, b.rank, r.r_clip, r.r_score from b full join r on r.job_id = b.job_id and r.clip_hash = b.clip_hash)
        select j.job_id as job_id, j.clip_id as clip_id, j.clip_hash as clip_hash, rank, round(coalesce(r_score, c_score), 6) as final_score, case when r_score is not null then 'response' when c_score is not null then 'cache' end as source,
            case when j.clip_id is null then 'unexpected clip_hash' when r_clip <> j.clip_id then 'clip_id does not match' end as error,
            bool_and(j.clip_id is null or coalesce(r_score, c_score) is not null) over (partition by j.job_id) as complete
        from j left join c on c.job_id = j.job_id and c.clip_hash = j.clip_hash""",
    "package_briefs": f"""with a as (select * from {o.CLIPS} c qualify row_number() over (partition by job_id order by score desc, clip_id) <= 3), b as (select * from {_DUCK_BRIEFS} x where substr(clip_hash, 1, 1) <> '0')
        select a.job_id as job_id, a.clip_id as clip_id, clip_hash, round(coalesce(case when a.score > 0.5 then a.score end, b.score), 6) as score, case when clip_hash is null then 'no brief for an approved clip' end as error
        from a left join b on b.job_id = a.job_id and b.clip_id = a.clip_id""",
    "resolved_packs": f"""with b as (select * from {_DUCK_BRIEFS} x), q as (select *, cast(row_number() over (partition by job_id order by clip_id) as int) as ord from b where substr(clip_hash, 1, 1) < 'c'),
        r as (select job_id, clip_hash, case when substr(clip_hash, 2, 1) = '7' then 'clip-999' else clip_id end as pack, transcript as title from b where substr(clip_hash, 1, 1) > '2')
        select coalesce(q.job_id, r.job_id) as job_id, coalesce(q.clip_hash, r.clip_hash) as clip_hash, q.clip_id as clip_id, ord,
            case when q.clip_id is null then 'unexpected' when pack is null then 'missing' when pack <> q.clip_id then 'mismatch' else 'ok' end as status, title
        from q full join r on r.job_id = q.job_id and r.clip_hash = q.clip_hash""",
    "merged_feedback": """with n as (select concat('clip-', c_custkey) as clip_id, c_custkey as k, c_mktsegment as m from customer)
        select clip_id, case when k % 5 = 0 then false when k % 3 = 0 then true when k % 2 = 0 then k % 4 = 0 else false end as posted,
            case when k % 7 = 0 then concat('note ', m) when k % 6 = 0 then m end as notes
        from n where k % 2 = 0 or k % 3 = 0 or k % 5 = 0 or k % 7 = 0""",
    "feedback_rows": f"""with c as (select concat(job_id, '/', clip_id) as clip_id, score, title, end_seconds - start_seconds as d from {o.CLIPS} x),
        f as (select clip_id, score > 0.4 as posted from c union all select concat(clip_id, '-gone'), true from c where score > 0.9)
        select f.clip_id as clip_id, posted, round(score, 6) as score, title, round(d, 6) as duration_seconds, case when d is null then 'unknown' else 'ok' end as status from f left join c on c.clip_id = f.clip_id""",
    "duplicate_clips": f"select job_id, clip_id, count(*) as n from {o.HISTORY} x group by job_id, clip_id having count(*) > 1",
    "workspace_states": "select o_orderkey, case "
    + " ".join(
        f"when {_FLAGS[a]} then '{s}'"
        for a, s in (
            ("package_report", "done"), ("package_response", "package_save"), ("package_request", "package_handoff"), ("render_report", "package_prompt"), ("approved", "render"), ("review", "approve"),
            ("scoring_response", "review"), ("brief_response", "score_handoff"), ("brief_request", "brief_handoff"), ("scoring_request", "score_handoff"), ("job", "mine"),
        )
    )
    + " else 'prepare' end as state from orders",
    "publish_pack_errors": _TRUE_PACKS,
    "span_errors": """select l_linenumber, concat_ws('|', case when not l_quantity - 10 >= 0 then 'negative start' end, case when not l_linenumber * 7 > l_quantity - 10 then 'ends before it starts' end) as errors, count(*) as n
        from lineitem group by all""",
    "identities": """select o_orderkey, substr(sha1(case when o_orderkey % 5 <> 0 then concat_ws(chr(0), concat('/videos/', o_orderpriority, '/', o_orderkey, '.mp4'), '1.0', (o_orderkey * 100)::varchar, (o_orderkey * 1000 + 7)::varchar)
        else concat_ws(chr(0), concat('/videos/', o_orderpriority, '/', o_orderkey, '.mp4'), '1.0') end), 1, 12) as job_id from orders""",
    "parsed_options": """select c_custkey, case c_custkey % 6 when 0 then '9:16|1:1|16:9' when 1 then '9:16|1:1' when 2 then '4:3|16:9' when 3 then '' else '16:9' end as ratios, case when c_custkey % 6 = 2 then '4:3' end as bad_ratio,
        case when c_custkey % 4 <> 0 and c_custkey % 9 - 3 > 0 then (c_custkey % 9 - 3)::int end as n, case when c_custkey % 7 <> 0 and c_custkey % 15 <= 10 then (c_custkey % 15) / 10::double end as score from customer""",
    "settings_read": """select concat('KEY', s_suppkey) as key, case s_suppkey % 6 when 1 then 'quoted value' when 2 then 'a=b' else 'single' end as value from supplier where s_suppkey % 6 in (1, 2, 4)""",
}
