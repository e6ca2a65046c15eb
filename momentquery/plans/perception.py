"""Queries over raw visual measurements, speakers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vision
from ..sources import testdata as td
from . import oracle as o
from .mining import rounded

RAW = """
select concat('job-', l_suppkey % 40) as job_id, cast(l_orderkey % 50 as int) as frame_idx, cast(row_number() over (partition by l_suppkey % 40, l_orderkey % 50 order by l_orderkey, l_linenumber, l_partkey) as int) as face_ord,
    cast(l_partkey % 600 as double) as x0, cast(l_partkey % 300 as double) as y0,
    cast(l_partkey % 600 + l_quantity * 3 - 9 as double) as x1, cast(l_partkey % 300 + l_linenumber * 20 - 20 as double) as y1,
    cast(1 + l_partkey % 7 as double) / 7 as score, 617 as frame_width, 353 as frame_height
from {lineitem}
"""
_DUCK_RAW = td.duck(RAW)


def _raw_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return td.statement(RAW, spark, sf_dir)


def primary_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vision.primary_faces(vision.faces(_raw_faces(spark, sf_dir)))
    return found.select("job_id", "frame_idx", *[F.round(F.col(f"face.{c}"), 5).alias(c) for c in ("center_x", "center_y", "width", "height", "confidence")])


def normalised_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = td.frames(spark, sf_dir).select(
        "job_id", "frame_idx",
        F.when(F.col("frame_idx") % 19 == 0, F.lit(float("nan"))).when(F.col("frame_idx") % 23 == 0, F.lit(float("inf"))).when(F.col("frame_idx") % 17 == 0, -F.col("motion_score")).otherwise(F.col("motion_score") * 7).alias("magnitude"),
    )
    return rounded(vision.normalised_motion(m).drop("magnitude"))


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("concat('job-', c_custkey % 150) as job_id", "cast((c_custkey * 731) % 100000 as double) / 1000 as shot_seconds")


def shot_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.shot_frames(td.frames(spark, sf_dir), _shots(spark, sf_dir))


def assembled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = td.frames(spark, sf_dir).select("job_id", "frame_idx", "timestamp_seconds")
    motion = vision.normalised_motion(td.frames(spark, sf_dir).select("job_id", "frame_idx", F.col("motion_score").alias("magnitude")))
    faces = vision.primary_faces(vision.faces(_raw_faces(spark, sf_dir)))
    out = vision.assembled(samples, motion, faces, _shots(spark, sf_dir))
    return out.groupBy("job_id").agg(F.count("*").alias("n_frames"), F.count("face_center_x").alias("n_faces"), F.count_if("shot_change").alias("n_shots"), F.round(F.sum(F.col("motion_score").cast("decimal(18,4)")), 3).cast("double").alias("motion"))


SPANS = """
select concat('job-', c_custkey % 100) as job_id, cast((c_custkey * 17) % 60 as double) as start, cast((c_custkey * 17) % 60 + 2 + c_custkey % 9 as double) as "end", concat('SPEAKER_0', c_custkey % 4) as speaker from {customer}
"""


def word_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = td.statement(SPANS.replace('"end"', "`end`"), spark, sf_dir)
    return vision.word_speakers(td.words(spark, sf_dir), spans).select("job_id", "seg_idx", "word_idx", "speaker")


def renumbered_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = td.segments(spark, sf_dir).select("job_id", F.col("seg_idx").alias("idx"), F.col("speaker").alias("label"))
    return vision.renumbered(s)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.concat(F.lit("job-"), F.floor(F.col("vec_id") / 10)).alias("job_id"), (F.col("vec_id") % 10).cast("int").alias("span_idx"), F.col("embedding").alias("vec"))


def speaker_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vision.cosine(_vectors(spark, sf_dir)))


def speaker_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vision.clustered(_vectors(spark, sf_dir))


def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = td.frames(spark, sf_dir).selectExpr("job_id", "frame_idx as frame_index", "cast(4 + substring(job_id, 5) % 7 as double) as fps")
    return vision.sampled_every(raw, "fps", 2.0)


QUERIES = {f.__name__: f for f in (primary_faces, normalised_motion, shot_frames, assembled_frames, word_speakers, renumbered_speakers, speaker_similarity, speaker_clusters, sampled_frames)}

_FACES = f"""
boxes as (
    select job_id, frame_idx, face_ord, least(greatest((x0 + x1) / 2 / 617, 0.0), 1.0) as center_x, least(greatest((y0 + y1) / 2 / 353, 0.0), 1.0) as center_y, least(greatest((x1 - x0) / 617, 0.0), 1.0) as width,
        least(greatest((y1 - y0) / 353, 0.0), 1.0) as height, least(greatest(score, 0.0), 1.0) as confidence
    from {_DUCK_RAW} r where x1 > x0 and y1 > y0
),
best as (select * from boxes qualify row_number() over (partition by job_id, frame_idx order by width * height * confidence desc, face_ord) = 1)
"""
_DUCK_SHOTS = "(select concat('job-', c_custkey % 150) as job_id, cast((c_custkey * 731) % 100000 as double) / 1000 as shot_seconds from customer)"
_SHOT_FRAMES = f"""
shot as (select *, row_number() over () as id from {_DUCK_SHOTS} z),
hit as (
    select distinct job_id, frame_idx from (
        select s.job_id, f.frame_idx from shot s join {o.FRAMES} f on f.job_id = s.job_id
        qualify row_number() over (partition by s.id order by abs(f.timestamp_seconds - s.shot_seconds), f.frame_idx) = 1
    ) y
)
"""
ORACLE = {
    "primary_faces": f"with {_FACES} select job_id, frame_idx, round(center_x, 5) as center_x, round(center_y, 5) as center_y, round(width, 5) as width, round(height, 5) as height, round(confidence, 5) as confidence from best",
    "normalised_motion": f"""with m as (select job_id, frame_idx, case when frame_idx % 19 = 0 or frame_idx % 23 = 0 then null when frame_idx % 17 = 0 then nullif(-motion_score, -abs(nullif(motion_score, 0))) else motion_score * 7 end as u from {o.FRAMES} f)
        select job_id, frame_idx, round(case when u > 0 and max(u) over (partition by job_id) > 0 then u / max(u) over (partition by job_id) else 0.0 end, 6) as motion_score from m""",
    "shot_frames": f"with {_SHOT_FRAMES} select job_id, frame_idx from hit",
    "assembled_frames": f"""with {_FACES}, {_SHOT_FRAMES}, f as (select *, case when max(motion_score) over (partition by job_id) > 0 then motion_score / max(motion_score) over (partition by job_id) else 0.0 end as m from {o.FRAMES} z)
        select f.job_id as job_id, count(*) as n_frames, count(b.center_x) as n_faces, count(h.frame_idx) as n_shots, round(sum(cast(round(m, 4) as decimal(18, 4))), 3)::double as motion
        from f left join best b on b.job_id = f.job_id and b.frame_idx = f.frame_idx left join hit h on h.job_id = f.job_id and h.frame_idx = f.frame_idx group by f.job_id""",
    "word_speakers": f"""with w as (select * from {o.WORDS} x), s as (select * from {td.duck(SPANS)} x),
        p as (select w.job_id, w.seg_idx, w.word_idx, s.speaker, round(sum(least(w.end_seconds, s."end") - greatest(w.start_seconds, s.start)), 6) as ov
            from w join s on s.job_id = w.job_id and least(w.end_seconds, s."end") - greatest(w.start_seconds, s.start) > 0 group by all),
        best as (select * from p qualify row_number() over (partition by job_id, seg_idx, word_idx order by ov desc, speaker) = 1)
        select w.job_id as job_id, w.seg_idx as seg_idx, w.word_idx as word_idx, coalesce(best.speaker, 'SPEAKER_00') as speaker from w left join best on best.job_id = w.job_id and best.seg_idx = w.seg_idx and best.word_idx = w.word_idx""",
    "renumbered_speakers": f"""with s as (select job_id, seg_idx as idx, speaker as label, min(seg_idx) over (partition by job_id, speaker) as f from {o.SEGMENTS} x)
        select job_id, idx, label, cast(dense_rank() over (partition by job_id order by f) - 1 as int) as number, printf('SPEAKER_%02d', dense_rank() over (partition by job_id order by f) - 1) as speaker from s""",
    "speaker_similarity": """with v as (select concat('job-', vec_id // 10) as job_id, (vec_id % 10)::int as i, embedding::double[] as e from embeddings),
        n as (select *, coalesce(nullif(sqrt(list_inner_product(e, e)), 0), 1) as l from v)
        select a.job_id as job_id, a.i as i, b.i as j, round(list_inner_product(a.e, b.e) / a.l / b.l, 6) as similarity from n a join n b on a.job_id = b.job_id and a.i < b.i""",
    "sampled_frames": f"""with r as (select job_id, frame_idx as frame_index, cast(4 + substr(job_id, 5)::int % 7 as double) as fps from {o.FRAMES} f)
        select * from r where frame_index % greatest(round(fps / 2.0)::int, 1) = 0""",
}
