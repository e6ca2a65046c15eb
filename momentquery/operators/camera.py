"""Crop sizes and camera paths of clips, and smoothing of noisy series."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import RATIOS, Camera, OneEuro
from ..session import ship

#: Seconds of the slices by which frames meet clips.
SLICE = 15.0


def target_size(width: Column, height: Column, ratio: tuple[int, int]) -> tuple[Column, Column]:
    """The largest even crop of that ratio; ratios are compared as whole numbers."""
    w, h = ratio
    even = lambda x: F.when(x <= 0, F.lit(2)).otherwise(x - x % 2).cast("int")
    wide = F.lit(w) * height >= F.lit(h) * width
    return (
        even(F.when(wide, width).otherwise(F.floor(height * w / h))),
        even(F.when(wide, F.floor(width * h / w)).otherwise(height)),
    )


def targets(sources: DataFrame, ratios: dict[str, tuple[int, int]] = RATIOS) -> DataFrame:
    """sources(…, source_width, source_height) once for each ratio, with target_width and target_height."""
    rows = []
    for name, ratio in ratios.items():
        width, height = target_size(F.col("source_width"), F.col("source_height"), ratio)
        rows.append(F.struct(F.lit(name).alias("aspect_ratio"), width.alias("target_width"), height.alias("target_height")))
    return sources.withColumn("_r", F.explode(F.array(*rows))).select(*[F.col(f"`{c}`") for c in sources.columns], "_r.*")


def clip_frames(clips: DataFrame, frames: DataFrame) -> DataFrame:
    """Frames of each clip, both ends included, counted from its start."""
    # Each frame is in one slice of SLICE seconds, a clip in a few.
    low, high = F.floor(F.col("start_seconds") / SLICE), F.floor(F.col("end_seconds") / SLICE)
    cut = clips.withColumn("_cut", F.explode(F.sequence(low, F.greatest(low, high))))
    seen = frames.select(F.col("job_id").alias("_job"), F.floor(F.col("timestamp_seconds") / SLICE).alias("_slice"), "frame_idx", "timestamp_seconds", "shot_change", "face_x", "face_y")
    inside = (F.col("job_id") == F.col("_job")) & (F.col("_cut") == F.col("_slice")) & F.col("timestamp_seconds").between(F.col("start_seconds"), F.col("end_seconds"))
    return cut.join(seen, inside).drop("_job", "_cut", "_slice").withColumn("t", F.col("timestamp_seconds") - F.col("start_seconds"))


def modes(clips: DataFrame, frames: DataFrame, threshold: float = 0.5) -> DataFrame:
    """clips with face_ratio and mode: TRACK where at least that share of frames has a face, else GENERAL."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold is a share")
    shares = clip_frames(clips, frames).groupBy("job_id", "clip_id").agg((F.count("face_x") / F.count("*")).alias("face_ratio"))
    return clips.join(shares, ["job_id", "clip_id"], "left").withColumn("mode", F.when(F.col("face_ratio") >= threshold, "TRACK").otherwise("GENERAL"))


_ANCHOR = "struct<t:double,x:double,y:double>"


def anchors(clips: DataFrame, frames: DataFrame, camera: Camera = Camera()) -> DataFrame:
    """job_id, clip_id, anchor_idx, t, x, y: a camera that holds still while its target is near and pans when not.

    The target is the last face seen (the first one before any); the path snaps to it at the first frame and at shot
    changes. Clips without faces get the centre at both ends. Runs of anchors that hardly move are one anchor."""
    seen = clip_frames(clips, frames)
    order = W.partitionBy("job_id", "clip_id").orderBy("t", "frame_idx")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))

    def target(c: str) -> Column:
        return clamp(F.coalesce(F.last(c, ignorenulls=True).over(upto), F.first(c, ignorenulls=True).over(every)))

    aimed = seen.withColumns({"tx": target("face_x"), "ty": target("face_y")}).withColumn("_n", F.row_number().over(order))
    fields = F.struct(F.col("_n").cast("int").alias("n"), F.col("t").cast("double").alias("t"), "tx", "ty", F.col("shot_change").alias("snap"))
    packed = aimed.groupBy("job_id", "clip_id").agg(F.array_sort(F.collect_list(fields)).alias("f"), F.max("face_x").alias("_face"))

    def moved(cur: str, aim: str, dt: str) -> str:
        d = f"({aim} - {cur})"
        step = f"(if(abs({d}) > {camera.fast_from}, {camera.fast}, {camera.slow}) * {dt})"
        return f"if(abs({d}) <= {camera.safe_zone}, {cur}, if({step} >= abs({d}), {aim}, {cur} + if({d} > 0, {step}, -{step})))"

    last, dt = "element_at(acc, -1)", "greatest(f.t - element_at(acc, -1).t, 0d)"
    path = f"""aggregate(f, cast(array() as array<{_ANCHOR}>), (acc, f) -> concat(acc, array(
        if(size(acc) = 0 or f.snap, named_struct('t', f.t, 'x', f.tx, 'y', f.ty),
            named_struct('t', f.t, 'x', {moved(f"{last}.x", "f.tx", dt)}, 'y', {moved(f"{last}.y", "f.ty", dt)})))))"""
    near = f"abs(p.x - element_at(acc, -1).x) < {camera.epsilon} and abs(p.y - element_at(acc, -1).y) < {camera.epsilon}"
    thin = f"""if(size(path) <= 2, path, concat(
        aggregate(slice(path, 2, size(path) - 2), array(path[0]), (acc, p) -> if({near}, acc, concat(acc, array(p)))),
        array(element_at(path, -1))))"""
    tracked = packed.filter("_face is not null").withColumn("path", F.expr(path)).select("job_id", "clip_id", F.expr(thin).alias("path"))
    centre = f"cast(array(named_struct('t', 0d, 'x', 0.5d, 'y', 0.5d), named_struct('t', cast(end_seconds - start_seconds as double), 'x', 0.5d, 'y', 0.5d)) as array<{_ANCHOR}>)"
    paths = clips.select("job_id", "clip_id", "start_seconds", "end_seconds").join(tracked, ["job_id", "clip_id"], "left")
    return paths.select("job_id", "clip_id", F.posexplode(F.coalesce("path", F.expr(centre))).alias("anchor_idx", "a")).select("job_id", "clip_id", "anchor_idx", "a.*")


def number_text(x: Column, digits: int) -> Column:
    """Fixed digits without trailing zeros."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", x), r"\.?0+$", "")


def origins(anchor_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Anchors joined with target sizes (job_id, aspect_ratio, …): the crop's upper left corner, kept in the frame."""
    both = anchor_rows.join(sizes, "job_id")

    def origin(c: str, source: str, target: str) -> Column:
        at = F.round(F.col(c) * F.col(source) - F.col(target) / 2).cast("int")
        return F.least(F.greatest(at, F.lit(0)), F.greatest(F.col(source) - F.col(target), F.lit(0)))

    return both.withColumns({"origin_x": origin("x", "source_width", "target_width"), "origin_y": origin("y", "source_height", "target_height")})


def piecewise(keyframes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and expression: nested conditions on t that run straight from one (t, value) to the next, in anchor order;
    a plain number where all values are equal. Commas are escaped, as the expression stands inside an argument."""
    packed = keyframes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("anchor_idx", F.col("t").cast("double").alias("t"), F.col(value).alias("v")))).alias("_frames"))
    text = lambda c: f"coalesce(nullif(regexp_replace(format_string('%.6f', {c}), '[.]?0+$', ''), ''), '0')"
    piece = f"if(_frames[i + 1].t - _frames[i].t <= 0 or _frames[i].v = _frames[i + 1].v, cast(_frames[i].v as string), concat('(', _frames[i].v, '+(', _frames[i + 1].v - _frames[i].v, ')*(t-', {text('_frames[i].t')}, ')/', {text('_frames[i + 1].t - _frames[i].t')}, ')'))"
    fold = f"""aggregate(if(size(_frames) > 1, reverse(sequence(0, size(_frames) - 2)), cast(array() as array<int>)), cast(element_at(_frames, -1).v as string),
        (tail, i) -> concat('if(lt(t\\\\,', {text('_frames[i + 1].t')}, ')\\\\,', {piece}, '\\\\,', tail, ')'))"""
    same = "forall(_frames, x -> x.v = _frames[0].v)"
    return packed.select(*keys, F.expr(f"if({same}, cast(_frames[0].v as string), {fold})").alias("expression"))


#: Last time, value and speed of a filtered series; None before its first row.
State = tuple[float, float, float | None] | None


def euro_step(config: OneEuro) -> Callable[[State, float, float], State]:
    """The filter's state after one more (t, value). A time that doesn't advance starts the value afresh, while the
    speed's own filter goes on."""

    def alpha(cutoff: float, dt: float) -> float:
        return 1 / (1 + 1 / (2 * math.pi * cutoff) / dt)

    def step(state: State, t: float, v: float) -> State:
        if state is None:
            return t, v, None
        last, y, speed = state
        dt = t - last
        if dt <= 0:
            return t, v, speed
        raw = (v - y) / dt
        a = alpha(config.derivative_cutoff, dt)
        speed = raw if speed is None else a * raw + (1 - a) * speed
        a = alpha(config.min_cutoff + config.beta * abs(speed), dt)
        return t, a * v + (1 - a) * y, speed

    return step


def one_euro(series: DataFrame, config: OneEuro = OneEuro()) -> DataFrame:
    """series(key, idx, t, value) with smoothed. Rows without a value are left out and change nothing.

    Each value depends on the one before, so a task goes through its keys' rows in order; it holds one state and one
    batch of rows, however long a series is."""
    ship(series.sparkSession)
    step = euro_step(config)
    rows = series.filter("value is not null").select("key", F.col("idx").cast("int").alias("idx"), F.col("t").cast("double").alias("t"), F.col("value").cast("double").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            out = []
            for key, t, v in zip(*(batch.column(c).to_pylist() for c in ("key", "t", "value"))):
                if key != at or not begun:
                    at, state, begun = key, None, True
                state = step(state, t, v)
                out.append(state[1])
            yield batch.append_column("smoothed", pa.array(out, pa.float64()))

    schema = T.StructType([*rows.schema, T.StructField("smoothed", T.DoubleType())])
    return rows.repartition("key").sortWithinPartitions("key", "idx", "t", "value").mapInArrow(run, schema)
