"""Readers and writers of the engine's file contracts; all schemas are explicit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = "struct<text:string,start_seconds:double,end_seconds:double,confidence:double>"
TRANSCRIPT = f"segments array<struct<speaker:string,start_seconds:double,end_seconds:double,text:string,words:array<{WORD}>>>, model string, source_fingerprint string"
FRAMES = "frames array<struct<timestamp_seconds:double,motion_score:double,shot_change:boolean,primary_face:struct<center_x:double,center_y:double,width:double,height:double,confidence:double>>>"
HISTORY = (
    "job_id string, clip_id string, recorded_at string, duration_seconds double, score double, spike_categories array<string>, "
    "ratios array<string>, title string, posted boolean, notes string, history_version int"
)
HISTORY_VERSION = 1
PROBE = "duration_seconds double, width int, height int, fps double, audio_sample_rate int, format struct<duration:string>, streams array<struct<codec_type:string,width:int,height:int,avg_frame_rate:string,sample_rate:string>>"


class ContractReadError(ValueError):
    """A document that must be there and sound is not."""


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_document(spark: SparkSession, path: str, schema: str | StructType, strict: bool = False) -> DataFrame:
    """Whole JSON documents. Strict: missing or malformed ones raise; else they give no rows."""
    empty = spark.createDataFrame([], schema)
    if not _exists(spark, path):
        if strict:
            raise ContractReadError(f"{path} is missing")
        return empty
    found = spark.read.text(path, wholetext=True).select(F.from_json("value", F.lit(_ddl(spark, schema)), {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    if strict and found.filter(F.col("v").isNull()).count():
        raise ContractReadError(f"{path} is not JSON")
    return found.filter(F.col("v").isNotNull() & F.col("r").isNotNull()).select("r.*")


def _ddl(spark: SparkSession, schema: str | StructType) -> str:
    return schema if isinstance(schema, str) else spark.createDataFrame([], schema).schema.simpleString().removeprefix("struct<").removesuffix(">")


def write_document(df: DataFrame, path: str) -> None:
    """A result of one row (a request, a report) as one JSON document, over what was there."""
    rows = df.toJSON().take(2)
    if len(rows) != 1:
        raise ContractReadError(f"{path} would hold {'no' if not rows else 'more than one'} document")
    write_text(df.sparkSession, path, json.dumps(json.loads(rows[0]), indent=2, ensure_ascii=False))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all: it is written beside its place and then takes it."""
    at, beside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.{uuid.uuid4().hex}"))
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    system.delete(at, False)
    if not system.rename(beside, at):
        raise OSError(f"{path} could not be written")


def listed(spark: SparkSession, root: str, patterns: Sequence[str]) -> DataFrame:
    """root, path and mtime_ns of the folders below root that a pattern names; as many rows as folders."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = []
    for pattern in patterns:
        for status in system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{pattern}")) or []:
            if status.isDirectory():
                rows.append((root, spark._jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(status.getPath()).toString(), status.getModificationTime() * 1_000_000))
    return spark.createDataFrame(rows, "root string, path string, mtime_ns long")


def segments(transcripts: DataFrame) -> DataFrame:
    """job_id, seg_idx and the fields of each segment; list order is the index."""
    return transcripts.select("job_id", F.posexplode("segments").alias("seg_idx", "s")).select("job_id", "seg_idx", "s.*")


def frames(payloads: DataFrame) -> DataFrame:
    return payloads.select("job_id", F.posexplode("frames").alias("frame_idx", "f")).select("job_id", "frame_idx", "f.*")


def words(segment_rows: DataFrame) -> DataFrame:
    return segment_rows.select("job_id", "seg_idx", F.posexplode("words").alias("word_idx", "w")).select("job_id", "seg_idx", "word_idx", "w.*")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Feedback rows of a JSON-lines log with ord, their order in it. A missing file gives no rows; blank, malformed
    and incomplete lines are left out; absent lists are empty, an absent note is null."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"ord long, {HISTORY}")
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))
    parsed = lines.withColumn("r", F.from_json("value", HISTORY)).filter((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    need = ("job_id", "clip_id", "recorded_at", "duration_seconds", "score", "posted")
    whole = parsed.select("ord", "r.*").filter(" and ".join(f"{c} is not null" for c in need))
    none = F.array().cast("array<string>")
    return whole.withColumns({"spike_categories": F.coalesce("spike_categories", none), "ratios": F.coalesce("ratios", none), "title": F.coalesce("title", F.lit(""))})


def append_history(entries: DataFrame, path: str) -> int:
    """Appends rows as JSON lines, with the log's version, and returns how many they are; counted as they are written."""
    seen = Observation()
    entries.drop("ord").withColumn("history_version", F.lit(HISTORY_VERSION)).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").json(path)
    return seen.get["n"]


def cached(spark: SparkSession, path: str, keys: dict[str, str], schema: str) -> DataFrame:
    """Rows of a keyed cache table whose key columns have these values; none if there is no such table."""
    try:
        found = spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    for name, value in keys.items():
        found = found.filter(F.col(name) == value)
    return found


def upserted(current: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of both, those of new where a key is in both."""
    return new.unionByName(current.join(new.select(*keys).distinct(), list(keys), "left_anti"))


def probe(raw: DataFrame) -> DataFrame:
    """Rows of PROBE as duration_seconds, width, height, fps, audio_sample_rate: as they are where they are given,
    else from the first video and audio stream; the frame rate is a fraction in words."""
    first = lambda kind: F.try_element_at(F.filter("streams", lambda s: s["codec_type"] == kind), F.lit(1))
    rate = F.split(first("video")["avg_frame_rate"], "/")
    over = F.coalesce(F.get(rate, F.lit(1)).try_cast("double"), F.lit(1.0))
    fps = F.when(over != 0, F.get(rate, F.lit(0)).try_cast("double") / over)
    return raw.select(
        *[c for c in raw.columns if c not in ("duration_seconds", "width", "height", "fps", "audio_sample_rate", "format", "streams")],
        F.coalesce("duration_seconds", F.col("format.duration").try_cast("double")).alias("duration_seconds"),
        F.coalesce("width", first("video")["width"]).alias("width"),
        F.coalesce("height", first("video")["height"]).alias("height"),
        F.coalesce("fps", fps).alias("fps"),
        F.coalesce("audio_sample_rate", first("audio")["sample_rate"].try_cast("int")).alias("audio_sample_rate"),
    )


def normalised_segments(raw: DataFrame) -> DataFrame:
    """raw(job_id, seg_idx, start, end, text, speaker, words array<struct<word,start,end,score,speaker>>) made sound:
    words need text and usable times, confidences are shares, segments without words go, and a segment's missing
    times and speaker come from its words."""
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    seconds = lambda x: F.greatest(x, F.lit(0.0))
    share = lambda x: F.when(usable(x), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    good = F.filter("words", lambda w: (F.trim(w["word"]) != "") & usable(w["start"]) & usable(w["end"]))
    clean = F.transform(
        good,
        lambda w: F.struct(
            F.trim(w["word"]).alias("text"), seconds(w["start"]).alias("start_seconds"), F.greatest(seconds(w["start"]), seconds(w["end"])).alias("end_seconds"),
            share(w["score"]).alias("confidence"), w["speaker"].alias("speaker"),
        ),
    )
    rows = raw.withColumn("words", clean).filter(F.size("words") > 0)
    first, last = F.element_at("words", 1), F.element_at("words", -1)
    start = F.when(usable(F.col("start")), seconds(F.col("start"))).otherwise(first["start_seconds"])
    end = F.when(usable(F.col("end")), seconds(F.col("end"))).otherwise(last["end_seconds"])
    voice = F.coalesce("speaker", F.try_element_at(F.filter(F.transform("words", lambda w: w["speaker"]), lambda s: s.isNotNull()), F.lit(1)), F.lit("unknown"))
    return rows.select("job_id", "seg_idx", voice.alias("speaker"), start.alias("start_seconds"), F.greatest(start, end).alias("end_seconds"), F.trim("text").alias("text"), "words")


def public(rows: DataFrame) -> DataFrame:
    """rows without the columns whose names begin with an underscore, and without such fields of their words."""
    kept = rows.drop(*[c for c in rows.columns if c.startswith("_")])
    if "words" not in kept.columns:
        return kept
    names = [f.name for f in kept.schema["words"].dataType.elementType if f.name.startswith("_")]
    return kept.withColumn("words", F.transform("words", lambda w: w.dropFields(*names))) if names else kept


def read_through(wanted: DataFrame, cache: DataFrame, keys: Sequence[str], produce: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows for all that is wanted, those that are new): what the cache has by its keys, and what is made of the rest."""
    made = produce(wanted.join(cache.select(*keys).distinct(), list(keys), "left_anti"))
    known = cache.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    return known.unionByName(made.select(*known.columns)), made


def write_packs(packs: DataFrame, path: str) -> None:
    """One folder of JSON a clip."""
    packs.write.mode("overwrite").partitionBy("clip_id").json(path)


def write_subtitles(dialogue: DataFrame, header: str, path: str) -> None:
    """One folder a clip with its subtitle text: the header, then the events in order."""
    events = dialogue.groupBy("clip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "dialogue"))), lambda x: x["dialogue"]), "\n").alias("e"))
    events.select("clip_id", F.concat(F.lit(header), F.col("e")).alias("value")).write.mode("overwrite").partitionBy("clip_id").text(path)
