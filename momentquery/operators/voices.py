"""From speech spans to speakers: clean-up, what can be embedded, and which speaker a word gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vision import word_speakers

#: Ways to tell speakers apart; the first is taken where none is named.
DIARIZERS = ("speechbrain", "pyannote", "off")
FALLBACK = "SPEAKER_00"
RATE, LEAST_SECONDS, MOST_SECONDS = 16000, 0.5, 30.0


class DiarizerError(ValueError):
    """A diarizer that isn't known."""


def diarizer(explicit: str | None = None, environment: str | None = None) -> str:
    """The one that is asked for, else the environment's, else the first of DIARIZERS."""
    name = (explicit or environment or DIARIZERS[0]).strip().lower()
    if name not in DIARIZERS:
        raise DiarizerError(f"unknown diarizer {name!r}; known are {', '.join(DIARIZERS)}")
    return name


def speech_spans(raw: DataFrame) -> DataFrame:
    """raw(job_id, start, end), as texts or numbers: job_id, span_idx, start, end of those that are spans, by start."""
    rows = raw.select("job_id", F.col("start").try_cast("double").alias("start"), F.col("end").try_cast("double").alias("end"))
    good = rows.filter(F.col("end") > F.col("start"))
    return good.withColumn("span_idx", F.row_number().over(W.partitionBy("job_id").orderBy("start", "end")) - 1).select("job_id", "span_idx", "start", "end")


def embeddable(spans: DataFrame, audio: DataFrame, rate: int = RATE, least: float = LEAST_SECONDS, most: float = MOST_SECONDS) -> DataFrame:
    """spans with first_sample and n_samples, where their part of the audio, audio(job_id, n_samples), is long enough to
    be embedded; no more than the first `most` seconds are."""
    first = F.greatest(F.lit(0), F.floor(F.col("start") * rate)).cast("long")
    last = F.least(F.col("_all"), F.floor(F.col("end") * rate).cast("long"))
    found = spans.join(audio.select("job_id", F.col("n_samples").alias("_all")), "job_id").withColumns({"first_sample": first, "_long": last - first})
    return found.filter(F.col("_long") >= int(rate * least)).withColumn("n_samples", F.least("_long", F.lit(int(rate * most)).cast("long"))).drop("_all", "_long")


def stamped(rows: DataFrame, speaker: str = FALLBACK) -> DataFrame:
    """rows whose missing speaker is the fallback."""
    return rows.withColumn("speaker", F.coalesce("speaker", F.lit(speaker)))


def spoken(words: DataFrame, spans: DataFrame, choice: str) -> DataFrame:
    """words with speaker: of the spans that overlap longest; the words' own or the fallback where no speakers are told
    apart, or the job has no spans."""
    if diarizer(choice) == "off":
        return stamped(words)
    heard = spans.select("job_id").distinct().withColumn("_heard", F.lit(True))
    both = words.join(heard, "job_id", "left")
    silent = stamped(both.filter("_heard is null").drop("_heard"))
    return word_speakers(both.filter("_heard").drop("_heard"), spans).unionByName(silent)


def magnitudes(flow: DataFrame) -> DataFrame:
    """flow(job_id, frame_idx, dx, dy), arrays of a field's components, as magnitude: the mean length of its vectors; the
    first frame of a job, which no other one precedes, has none."""
    length: Column = F.transform(F.arrays_zip("dx", "dy"), lambda v: F.sqrt(v["dx"] * v["dx"] + v["dy"] * v["dy"]))
    mean = F.aggregate(length, F.lit(0.0), lambda t, x: t + x) / F.nullif(F.size("dx"), F.lit(0))
    first = F.row_number().over(W.partitionBy("job_id").orderBy("frame_idx")) == 1
    return flow.select("job_id", "frame_idx", F.when(first, F.lit(0.0)).otherwise(F.coalesce(mean, F.lit(0.0))).alias("magnitude"))


def scene_starts(scenes: DataFrame) -> DataFrame:
    """scenes(job_id, start) as shots: job_id, shot_seconds of all but each job's first."""
    place = F.row_number().over(W.partitionBy("job_id").orderBy("start"))
    return scenes.withColumn("_place", place).filter("_place > 1").select("job_id", F.col("start").alias("shot_seconds"))
