"""Frames from raw visual measurements, and speakers from spans and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clamp01_finite

FACE = "struct<center_x:double,center_y:double,width:double,height:double,confidence:double>"


def faces(raw: DataFrame) -> DataFrame:
    """raw(job_id, frame_idx, face_ord, x0, y0, x1, y1, score, frame_width, frame_height) as boxes in shares of the
    frame; boxes without area or with unusable numbers are left out."""
    w, h = F.col("frame_width"), F.col("frame_height")
    ok = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")) & (w > 0) & (h > 0)
    return raw.filter(ok).select(
        "job_id", "frame_idx", "face_ord",
        F.struct(
            clamp01_finite((F.col("x0") + F.col("x1")) / 2 / w).alias("center_x"),
            clamp01_finite((F.col("y0") + F.col("y1")) / 2 / h).alias("center_y"),
            clamp01_finite((F.col("x1") - F.col("x0")) / w).alias("width"),
            clamp01_finite((F.col("y1") - F.col("y0")) / h).alias("height"),
            clamp01_finite(F.coalesce(F.col("score"), F.lit(0.0))).alias("confidence"),
        ).alias("face"),
    )


def primary_faces(boxes: DataFrame) -> DataFrame:
    """job_id, frame_idx, face: the largest area times confidence; the first of equals."""
    weight = F.col("face.width") * F.col("face.height") * F.col("face.confidence")
    return boxes.groupBy("job_id", "frame_idx").agg(F.max_by("face", F.struct(weight, -F.col("face_ord"))).alias("face"))


def normalised_motion(raw: DataFrame) -> DataFrame:
    """raw(job_id, frame_idx, magnitude) with motion_score, the share of the job's largest usable magnitude."""
    m = F.col("magnitude")
    usable = F.when(m.isNotNull() & ~F.isnan(m) & (m >= 0) & (m < float("inf")), m)
    most = F.max("_m").over(W.partitionBy("job_id"))
    return raw.withColumn("_m", usable).withColumn("motion_score", F.when((F.col("_m") > 0) & (most > 0), F.col("_m") / most).otherwise(F.lit(0.0))).drop("_m")


def shot_frames(samples: DataFrame, shots: DataFrame) -> DataFrame:
    """job_id, frame_idx of the sample nearest to each shot, the earlier of two as near.

    Samples and shots of a job are merged in time order; each shot then has its neighbours on both sides."""
    at = samples.select("job_id", F.col("timestamp_seconds").alias("t"), "frame_idx", F.lit(0).alias("is_shot"))
    of = shots.select("job_id", F.col("shot_seconds").alias("t"), F.lit(None).cast("int").alias("frame_idx"), F.lit(1).alias("is_shot"))
    both = at.unionByName(of).withColumn("s", F.when(F.col("is_shot") == 0, F.struct("t", "frame_idx")))
    order = W.partitionBy("job_id").orderBy("t", "is_shot", "frame_idx")
    before = F.last("s", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    after = F.first("s", ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    found = both.withColumns({"b": before, "a": after}).filter("is_shot = 1")
    nearer = F.when(F.col("b").isNull(), F.col("a")).when(F.col("a").isNull() | (F.col("t") - F.col("b.t") <= F.col("a.t") - F.col("t")), F.col("b")).otherwise(F.col("a"))
    return found.select("job_id", nearer["frame_idx"].alias("frame_idx")).filter("frame_idx is not null").distinct()


def assembled(samples: DataFrame, motion: DataFrame, face_rows: DataFrame, shots: DataFrame) -> DataFrame:
    """Frames: samples with motion, primary face (rounded) and shot flags, by position in their job."""
    face = face_rows.select("job_id", "frame_idx", *[F.round(F.col(f"face.{c}"), 4).alias(f"face_{c}") for c in ("center_x", "center_y", "width", "height", "confidence")])
    flags = shot_frames(samples, shots).withColumn("shot_change", F.lit(True))
    key = ["job_id", "frame_idx"]
    return (
        samples.join(motion.select(*key, F.round("motion_score", 4).alias("motion_score")), key, "left")
        .join(face, key, "left")
        .join(flags, key, "left")
        .withColumns({"shot_change": F.coalesce("shot_change", F.lit(False)), "motion_score": F.coalesce("motion_score", F.lit(0.0))})
    )


def word_speakers(words: DataFrame, spans: DataFrame, fallback: str = "SPEAKER_00") -> DataFrame:
    """words with speaker: whose spans overlap the word longest (ties: the smaller name), else the fallback.

    This rule is the engine's own; spans and words are taken to be much shorter than a job, so they meet by slices
    of ten seconds."""
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / 10), F.greatest(F.floor(F.col(a) / 10), F.floor(F.col(b) / 10))))
    w = words.withColumn("_slice", cut("start_seconds", "end_seconds"))
    s = spans.select(F.col("job_id").alias("_job"), F.col("start").alias("s0"), F.col("end").alias("s1"), F.col("speaker").alias("_speaker")).withColumn("_sslice", cut("s0", "s1"))
    overlap = F.least("end_seconds", "s1") - F.greatest("start_seconds", "s0")
    # A pair that shares several slices counts in the first of them only.
    first = F.greatest(F.floor(F.col("start_seconds") / 10), F.floor(F.col("s0") / 10))
    inside = (F.col("job_id") == F.col("_job")) & (F.col("_slice") == F.col("_sslice")) & (F.col("_slice") == first) & (overlap > 0)
    key = ["job_id", "seg_idx", "word_idx"]
    by_speaker = w.join(s, inside).groupBy(*key, "_speaker").agg(F.round(F.sum(overlap), 6).alias("_o"))
    best = by_speaker.groupBy(*key).agg(F.min_by("_speaker", F.struct(-F.col("_o"), F.col("_speaker"))).alias("speaker"))
    return words.drop("speaker").join(best, key, "left").withColumn("speaker", F.coalesce("speaker", F.lit(fallback)))


def renumbered(labels: DataFrame) -> DataFrame:
    """labels(job_id, idx, label) with number, from 0 by first appearance, and its name."""
    seen = labels.withColumn("_first", F.min("idx").over(W.partitionBy("job_id", "label")))
    number = F.dense_rank().over(W.partitionBy("job_id").orderBy("_first")) - 1
    return seen.withColumn("number", number).withColumn("speaker", F.format_string("SPEAKER_%02d", "number")).drop("_first")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(vectors: DataFrame) -> DataFrame:
    """job_id, i, j (i < j), similarity of the vectors of a job; a vector without length counts as length one."""
    norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
    v = vectors.withColumn("norm", F.when(norm == 0, F.lit(1.0)).otherwise(norm))
    a = v.select("job_id", F.col("span_idx").alias("i"), F.col("vec").alias("a"), F.col("norm").alias("na"))
    b = v.select(F.col("job_id").alias("_job"), F.col("span_idx").alias("j"), F.col("vec").alias("b"), F.col("norm").alias("nb"))
    return a.join(b, (F.col("job_id") == F.col("_job")) & (F.col("i") < F.col("j"))).select("job_id", "i", "j", (dot(F.col("a"), F.col("b")) / F.col("na") / F.col("nb")).alias("similarity"))


def clustered(vectors: DataFrame, threshold: float = 0.5, most: int = 8, seed: int = 42) -> DataFrame:
    """job_id, span_idx, label: spectral clusters of a job's vectors, numbered by first appearance.

    One vector is one speaker; two are one if their similarity reaches the threshold. Else the number of speakers is
    where the eigenvalues of the normalised Laplacian leave the largest gap, at most `most`, and rows of the first
    eigenvectors are grouped around as many centres. A job's spans are one group: they come from one recording."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("span_idx")
        x = np.stack(pdf["vec"].to_list()).astype(float)
        n = len(x)
        length = np.linalg.norm(x, axis=1)
        x = x / np.where(length == 0, 1, length)[:, None]
        like = np.clip(x @ x.T, 0, 1)
        np.fill_diagonal(like, 1)
        if n == 1:
            label = np.zeros(1, int)
        elif n == 2:
            label = np.array([0, 0 if like[0, 1] >= threshold else 1])
        else:
            degree = like.sum(1)
            laplacian = np.eye(n) - like / np.sqrt(degree[:, None] * degree[None, :])
            values, rows = np.linalg.eigh(laplacian)
            k = int(np.argmax(np.diff(values[: min(most, n - 1) + 1]))) + 1
            label = _centres(rows[:, :k], k, np.random.default_rng(seed))
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        number = np.argsort(np.argsort(first))
        return pd.DataFrame({"job_id": pdf["job_id"], "span_idx": pdf["span_idx"], "label": number[inverse]})

    return vectors.groupBy("job_id").applyInPandas(run, "job_id string, span_idx int, label int")


def _centres(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> np.ndarray:
    """Labels after moving k centres, the first ones far from each other, until nothing changes."""
    at = [int(rng.integers(len(x)))]
    while len(at) < k:
        at.append(int(np.min([((x - x[i]) ** 2).sum(1) for i in at], axis=0).argmax()))
    centres = x[at]
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        new = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.array([x[new == j].mean(0) if (new == j).any() else centres[j] for j in range(k)])
        if (new == label).all():
            break
        label = new
    return label


def sampled_every(frames: DataFrame, fps: str, sample_fps: float) -> DataFrame:
    """Every stride-th raw frame, the stride being round(fps / sample_fps), at least 1."""
    stride = F.greatest(F.round(F.col(fps) / sample_fps).cast("int"), F.lit(1))
    return frames.filter(F.col("frame_index") % stride == 0)


