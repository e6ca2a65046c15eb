"""Typed documents of a workspace: requests are read leniently, answers strictly, each kind with an error of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import contracts
from ..operators.handoff import HandoffError, PackagingError, ScoringError
from .files import _exists


class BriefError(HandoffError):
    """A video brief that breaks its contract."""


class JobError(ValueError):
    """A job document that is missing or can't be read."""


class JobSyntaxError(JobError):
    """A job document that is not JSON."""


class JobContractError(JobError):
    """A job document that is JSON, but no job."""


VIDEO_BRIEF = (
    "rubric_version string, job_id string, theme string, video_format string, expected_viral_patterns array<string>, anti_patterns array<string>, "
    "audience string, tone string, notes string"
)
CLIP_SCORE = (
    "clip_id string, clip_hash string, rubric struct<hook:double,shareability:double,standalone_clarity:double,payoff:double,delivery_energy:double,quotability:double>, "
    "spike_categories array<string>, penalties array<string>, final_score double, title string, hook string, reasons array<string>"
)
PACK = "clip_id string, clip_hash string, titles array<string>, thumbnail_texts array<string>, social_caption string, hashtags array<string>, hooks array<string>"
JOB = "video_path string, output_dir string, review_required boolean, output_profile struct<ratios:array<string>,caption_preset:string,video_brief:boolean>, max_candidates int"
#: Fields that may be null or absent.
OPTIONAL = ("audience", "tone", "notes", "anti_patterns")


def _struct(fields: str) -> str:
    """DDL of columns as that of a struct's fields."""
    return T.StructType.fromDDL(fields).simpleString()


@dataclass(frozen=True)
class Kind:
    """A kind of answer: its file, its header fields, the list (or the one document) that it carries, and its error."""

    file: str
    version: str
    field: str
    item: str
    many: bool
    error: type[HandoffError]
    checks: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    @property
    def schema(self) -> str:
        item = _struct(self.item)
        return f"{self.version} string, job_id string, {self.field} {f'array<{item}>' if self.many else item}"


def _shares(rows: DataFrame) -> DataFrame:
    flat = rows.select("*", F.col("rubric.*"), F.col("final_score").alias("_final")) if "rubric" in rows.columns else rows
    names = [f.name for f in rows.schema["rubric"].dataType]
    return contracts.unit_fields(flat.select(*[F.col(f"rubric.{n}").alias(n) for n in names], "final_score"), [*names, "final_score"])


SCORES = Kind(
    "scoring-response.json", "rubric_version", "scores", CLIP_SCORE, True, ScoringError,
    (_shares, lambda r: contracts.enums(r, "spike_categories", contracts.SPIKES), lambda r: contracts.enums(r, "penalties", contracts.PENALTIES)),
)
BRIEFS = Kind("brief-response.json", "rubric_version", "brief", VIDEO_BRIEF, False, BriefError, (contracts.video_briefs,))
PACKS = Kind("package-response.json", "prompt_version", "packs", PACK, True, PackagingError, (contracts.publish_packs,))


def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """value and its parse: v is null where it is no JSON, r where it is no object of that kind."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))


def _lacking(kind: T.StructType, value, unknown, path: str = "") -> list:
    """Conditions under which a struct column lacks a field, or its JSON object has one that the contract doesn't."""
    out = []
    for f in kind:
        at = value[f.name]
        if f.name not in OPTIONAL:
            out.append(F.when(at.isNull(), F.lit(f"{path}{f.name} is missing")))
    names = F.array(*[F.lit(f.name) for f in kind])
    extra = F.array_except(F.json_object_keys(unknown), names)
    out.append(F.when(F.size(extra) > 0, F.concat(F.lit(f"unknown field {path}"), extra[0])))
    return out


def read_answer(spark: SparkSession, workspace: str, kind: Kind, required: bool = False) -> DataFrame:
    """The items of a workspace's answer with job_id, version and ord, their place; no rows if there is none (an error
    if it is required). Anything but a sound document raises the kind's error."""
    path = f"{workspace}/{kind.file}"
    item = T.StructType.fromDDL(kind.item)
    own = [f for f in item if f.name != "job_id"]
    empty = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("version", T.StringType()), T.StructField("ord", T.IntegerType()), *own])
    if not _exists(spark, path):
        if required:
            raise kind.error(f"{kind.file} is not in the workspace")
        return spark.createDataFrame([], empty)
    whole = _whole(spark, path, kind.schema)
    if whole.filter(F.col("v").isNull()).take(1):
        raise kind.error(f"{kind.file} is not valid JSON")
    top = T.StructType.fromDDL(kind.schema)
    errors = F.array_compact(F.array(*_lacking(top, F.col("r"), F.col("value"))))
    items = F.col(f"r.{kind.field}") if kind.many else F.array(f"r.{kind.field}")
    raw = F.get_json_object("value", f"$.{kind.field}")
    raws = F.from_json(raw, "array<string>") if kind.many else F.array(raw)
    each = whole.select(
        F.col("r.job_id").alias("job_id"), F.col(f"r.{kind.version}").alias("version"), errors.alias("_errors"),
        F.posexplode_outer(F.arrays_zip(items.alias("item"), raws.alias("raw"))).alias("ord", "at"),
    )
    wrong = _lacking(item, F.col("at.item"), F.col("at.raw"), f"{kind.field}: ")
    if len(own) < len(item):
        wrong.append(F.when(F.col("at.item.job_id") != F.col("job_id"), F.lit(f"{kind.field} is of another job")))
    wrong = F.array_compact(F.array(*wrong))
    told = each.withColumn("_errors", F.concat("_errors", F.when(F.col("ord").isNotNull(), wrong).otherwise(F.array().cast("array<string>"))))
    first = told.filter(F.size("_errors") > 0).select(F.element_at("_errors", 1)).first()
    if first is not None:
        raise kind.error(f"{kind.file} does not match its contract: {first[0]}")
    rows = told.filter("ord is not null").select("job_id", "version", "ord", *[F.col(f"at.item.{f.name}").alias(f.name) for f in own])
    for check in kind.checks:
        bad = check(rows).filter(F.size("errors") > 0).select(F.element_at("errors", 1)).first()
        if bad is not None:
            raise kind.error(f"{kind.file} does not match its contract: {bad[0]}")
    if kind.many:
        for key in ("clip_id", "clip_hash"):
            twice = rows.groupBy(key).count().filter("count > 1").select(key).orderBy(key).first()
            if twice is not None and kind is SCORES:
                raise kind.error(f"{kind.file} has {key} {twice[0]!r} more than once")
    return rows


def matching(answers: DataFrame, kind: Kind, version: str, job_id: str) -> DataFrame:
    """answers, after raising if one is of another version or job than was asked for."""
    other = answers.filter((F.col("version") != version) | (F.col("job_id") != job_id)).select("version", "job_id").first()
    if other is not None:
        raise kind.error(f"{kind.file} is of version {other[0]!r} and job {other[1]!r}; asked were {version!r} and {job_id!r}")
    return answers


def read_request(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A request as one row; none if it is missing, malformed, or lacks a field of the schema."""
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        return empty
    kind = T.StructType.fromDDL(schema)
    sound = F.lit(True)
    for f in kind:
        if f.name not in OPTIONAL:
            sound = sound & F.col(f"r.{f.name}").isNotNull()
    return _whole(spark, path, schema).filter(F.col("v").isNotNull() & sound).select("r.*")


def read_job(spark: SparkSession, path: str) -> DataFrame:
    """A job as one row, with the defaults of what it doesn't say."""
    if not _exists(spark, path):
        raise JobError(f"{path} is missing")
    whole = _whole(spark, path, JOB)
    row = whole.select(F.col("v").isNull().alias("malformed"), "r", F.json_object_keys("value").alias("names")).first()
    if row is None or row.malformed:
        raise JobSyntaxError(f"{path} is not JSON")
    known = [f.name for f in T.StructType.fromDDL(JOB)]
    extra = [n for n in row.names or [] if n not in known]
    if row.names is None or row.r is None or row.r.video_path is None or row.r.output_dir is None or extra:
        raise JobContractError(f"{path} is no job" + (f": unknown field {extra[0]}" if extra else ""))
    found = whole.select("r.*")
    ratios = F.array(*[F.lit(x) for x in contracts.RATIOS])
    out = found.select(
        "video_path", "output_dir", F.coalesce("review_required", F.lit(True)).alias("review_required"), F.coalesce("output_profile.ratios", ratios).alias("ratios"),
        F.coalesce("output_profile.caption_preset", F.lit(contracts.PRESETS[0])).alias("caption_preset"), F.coalesce("output_profile.video_brief", F.lit(True)).alias("video_brief"),
        F.coalesce("max_candidates", F.lit(12)).alias("max_candidates"),
    )
    checked = [contracts.positive(out, ["max_candidates"]), contracts.enums(out, "ratios", contracts.RATIOS), contracts.one_of(out, "caption_preset", contracts.PRESETS)]
    for rows in checked:
        bad = rows.filter(F.size("errors") > 0).select(F.element_at("errors", 1)).first()
        if bad is not None:
            raise JobContractError(f"{path}: {bad[0]}")
    return out


def cached_answers(spark: SparkSession, path: str, new: DataFrame, keys: list[str], version: int) -> DataFrame:
    """The keyed cache at path/version=N with new rows in place of old ones; version N is read, N + 1 written."""
    from .files import upserted

    at = f"{path}/version={version}"
    old = spark.read.schema(new.schema).parquet(at) if _exists(spark, at) else spark.createDataFrame([], new.schema)
    upserted(old, new, keys).write.mode("errorifexists").parquet(f"{path}/version={version + 1}")
    return spark.read.schema(new.schema).parquet(f"{path}/version={version + 1}")
