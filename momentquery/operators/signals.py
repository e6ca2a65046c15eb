"""Signals of windows, from their words and from frames, and the score they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Mining
from ..functions import text as fx
from ..lexicon import Lexicon

#: Frames meet windows by slices of this many seconds.
SLICE = 15.0
# The sentences that describe what was seen.
DESCRIPTION = "faces in %d%% of sampled frames; avg motion %.2f, peak motion %.2f; %d shot change(s)"
NO_FRAMES = "No sampled vision frames landed inside this clip window."


def prepared(segments: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """segments with what windows add up: tokens and numbers of the text, and, from words, pauses. A window has a
    segment's part from here, so no text is looked at once for each window that has it, and no window meets words.

    A pause belongs to the later of two successive words; pauses: count, sum and squared deviations from their mean,
    of all and of those whose earlier word is in the segment too."""
    out = segments.withColumns({"tokens": fx.tokens(F.col("text")), "numbers": fx.numbers(F.col("text"))})
    if words is None:
        return out
    order = W.partitionBy("job_id").orderBy("seg_idx", "word_idx")
    pauses = words.withColumns({"gap": F.col("start_seconds") - F.lag("end_seconds").over(order), "_from": F.lag("seg_idx").over(order)})
    part = lambda x: F.struct(F.count(x).alias("n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("s"), F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"))
    inner = F.when(F.col("_from") == F.col("seg_idx"), F.col("gap"))
    sums = pauses.filter("gap >= 0").groupBy("job_id", "seg_idx").agg(F.struct(part(F.col("gap")).alias("all"), part(inner).alias("inside")).alias("pauses"))
    return out.join(sums, ["job_id", "seg_idx"], "left")


def _joined_text(members: Column) -> Column:
    return F.array_join(F.transform(members, lambda m: m["text"]), " ")


def _tokens(members: Column) -> Column:
    """Of the members' joined text: no token has a blank, so they are the members' own."""
    return F.flatten(F.transform(members, lambda m: m["tokens"]))


def lexical(windows: DataFrame, lexicon: Lexicon = Lexicon(), config: Mining = Mining()) -> DataFrame:
    """windows of prepared() segments with the signals that their members' texts and speakers give."""
    n = F.size("members")
    half = F.greatest(F.floor(n / 2), F.lit(1)).cast("int")
    members = F.col("members")
    head, tail = F.slice(members, F.lit(1), half), F.slice(members, half + 1, F.greatest(n - half, F.lit(0)))
    rest = F.slice(members, F.lit(1), F.greatest(n - 1, F.lit(0)))
    spoken = windows.withColumns(
        {
            "_text": _joined_text(members),
            "_words": _tokens(members),
            "_numbers": F.aggregate(members, F.lit(0), lambda t, m: t + m["numbers"]),
            "_first": F.element_at(members, 1)["text"],
            "_first_words": F.element_at(members, 1)["tokens"],
            "_last": fx.strip(F.element_at(members, -1)["text"]),
            "_rest": _joined_text(rest),
            "_rest_words": _tokens(rest),
            "_head": _joined_text(head),
            "_tail": _joined_text(tail),
            "_tail_words": _tokens(tail),
            "_middle_words": F.when(n > 2, _tokens(F.slice(members, F.lit(2), F.greatest(n - 2, F.lit(0))))),
            "_turns": F.size(F.filter(F.zip_with(F.slice(members, F.lit(2), F.greatest(n - 1, F.lit(0))), rest, lambda b, a: b["speaker"] != a["speaker"]), lambda x: x)),
        }
    )
    seconds = F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(1e-6))
    answered = F.arrays_overlap("_tail_words", fx.literal_array(lexicon.answer_words)) | (fx.payoff(F.col("_tail"), F.col("_tail_words"), lexicon) > 0)
    spoken = spoken.withColumn("speaker_interaction", F.when(n < 2, F.lit(0.0)).otherwise(fx.clamp01(F.col("_turns") / (seconds / 10))))
    text, text_words = F.col("_text"), F.col("_words")
    out = spoken.withColumns(
        {
            "hook": fx.hook(F.col("_first"), F.col("_first_words"), lexicon),
            "keyword": fx.keyword(text_words, lexicon),
            "numeric": fx.number_share(F.col("_numbers"), text_words),
            "interjection": fx.interjection(text_words, lexicon),
            "payoff": fx.payoff(text, text_words, lexicon),
            "question_to_answer": F.when((n < 2) | ~F.contains("_head", F.lit("?")), F.lit(0.0)).when(answered, F.lit(1.0)).otherwise(F.lit(0.35)),
            "interview_keyword": F.when(F.col("speaker_interaction") >= config.interview_gate, fx.interview(text, text_words, lexicon)).otherwise(F.lit(0.0)),
            "buried_lead": fx.buried_lead(F.col("_first"), lexicon),
            "dangling_question": F.endswith("_last", F.lit("?")) & (fx.payoff(F.col("_rest"), F.col("_rest_words"), lexicon) == 0),
            "middle_keyword": F.when(n > 2, fx.keyword(F.col("_middle_words"), lexicon)),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def delivery(windows: DataFrame) -> DataFrame:
    """windows of prepared() segments with delivery_variance, from the pauses between successive words of their members;
    that between a window's first word and the one before it is not in the window. Deviations are added about the
    window's own mean, so long jobs lose no digits."""
    parts = F.filter(
        F.transform("members", lambda m, i: F.when(i == 0, m["pauses"]["inside"]).otherwise(m["pauses"]["all"])), lambda p: p["n"] > 0
    )
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s"))
    sums = F.aggregate("_parts", zero, lambda t, p: F.struct((t["n"] + p["n"]).alias("n"), (t["s"] + p["s"]).alias("s")))
    mean = F.col("_sums.s") / F.col("_sums.n")
    m2 = F.aggregate("_parts", F.lit(0.0), lambda t, p: t + p["m2"] + p["n"] * F.pow(p["s"] / p["n"] - F.col("_mean"), 2))
    out = windows.withColumn("_parts", parts).withColumn("_sums", sums).withColumn("_mean", mean)
    spread = F.sqrt(m2 / F.col("_sums.n"))
    return out.withColumn("delivery_variance", F.when(F.col("_sums.n") >= 3, fx.clamp01(spread / 0.35)).otherwise(F.lit(0.0))).drop("_parts", "_sums", "_mean")


def frame_sums(windows: DataFrame, frames: DataFrame, **more: Column) -> DataFrame:
    """For rows with row_id, job_id, start_seconds and end_seconds, the sums of their frames, those from the start up
    to, not including, the end; rows without frames are left out. more: columns from _frames, a row's frames in order.

    Windows are cut into slices of SLICE seconds and frames meet them by slice, each frame in one. Averages add up a
    window's frames in order of time: sums in the order of their arrival differ in the last place from run to run, and
    a window whose average is a half or a threshold with them."""
    low, high = F.floor(F.col("start_seconds") / SLICE), F.floor(F.col("end_seconds") / SLICE)
    cut = windows.select("row_id", "job_id", "start_seconds", "end_seconds", F.explode(F.sequence(low, F.greatest(low, high))).alias("slice"))
    seen = frames.select(F.col("job_id").alias("_job"), F.floor(F.col("timestamp_seconds") / SLICE).alias("_slice"), "timestamp_seconds", "motion_score", "shot_change", "face_x", "face_y")
    t = F.col("timestamp_seconds")
    inside = (F.col("job_id") == F.col("_job")) & (F.col("slice") == F.col("_slice")) & (t >= F.col("start_seconds")) & (t < F.col("end_seconds"))
    sums = cut.join(seen, inside).groupBy("row_id").agg(
        F.count("*").alias("frame_count"),
        F.count("face_x").alias("face_count"),
        F.count_if("shot_change").alias("shot_change_count"),
        F.max("motion_score").alias("peak_motion"),
        F.array_sort(F.collect_list(F.struct("timestamp_seconds", "motion_score", "face_x", "face_y"))).alias("_frames"),
    )
    means = {"avg_motion": _mean("motion_score"), "avg_face_center_x": _mean("face_x"), "avg_face_center_y": _mean("face_y")}
    return sums.withColumns(means | more).drop("_frames")


def _mean(name: str) -> Column:
    """Of a field of _frames, from the first one on; null without values."""
    values = _values(name)
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda t, v: t + v) / F.size(values))


def _exact_mean(name: str) -> Column:
    """As _mean(), but what each addition loses is added at the end: no order of frames moves it off a threshold that it
    meets."""
    values = _values(name)

    def plus(t: Column, v: Column) -> Column:
        s, both = t["s"], t["s"] + v
        lost = F.when(F.abs(s) >= F.abs(v), (s - both) + v).otherwise((v - both) + s)
        return F.struct(both.alias("s"), (t["lost"] + lost).alias("lost"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lost"))
    return F.when(F.size(values) > 0, F.aggregate(values, zero, plus, lambda t: t["s"] + t["lost"]) / F.size(values))


def _values(name: str) -> Column:
    return F.filter(F.transform("_frames", lambda f: f[name]), lambda v: v.isNotNull())


COUNTS = ("frame_count", "face_count", "shot_change_count", "avg_motion", "peak_motion")


def visual(windows: DataFrame, frames: DataFrame) -> DataFrame:
    """windows with their frame_sums(); those without frames count none."""
    return windows.join(frame_sums(windows, frames), "row_id", "left").fillna(0, list(COUNTS))


def visual_signals(seen: DataFrame) -> DataFrame:
    """Rows of visual() with motion, shot_change and face_presence, each 0 to 1."""
    seconds = F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(1e-6))
    ratio = F.when(F.col("frame_count") > 0, F.col("face_count") / F.col("frame_count")).otherwise(F.lit(0.0))
    return seen.withColumns(
        {"motion": fx.clamp01(F.col("avg_motion")), "shot_change": fx.clamp01(F.col("shot_change_count") / (seconds / 5)), "face_presence": fx.clamp01(ratio)}
    )


def visual_summary(seen: DataFrame) -> DataFrame:
    """Rows of visual() as they are reported: rounded, with a rate a minute and a sentence."""
    seconds = F.greatest(F.col("end_seconds") - F.col("start_seconds"), F.lit(1e-6))
    n = F.col("frame_count")
    ratio = F.when(n > 0, F.col("face_count") / n).otherwise(F.lit(0.0))
    described = F.format_string(DESCRIPTION, F.round(ratio * 100).cast("int"), fx.rounded(F.col("avg_motion"), 2), fx.rounded(F.col("peak_motion"), 2), F.col("shot_change_count"))
    return seen.withColumns(
        {
            "face_presence_ratio": fx.rounded(ratio, 4),
            "avg_motion": fx.rounded(F.col("avg_motion"), 4),
            "peak_motion": fx.rounded(F.col("peak_motion"), 4),
            "shot_change_rate_per_minute": F.when(n > 0, fx.rounded(F.col("shot_change_count") / (seconds / 60), 4)).otherwise(F.lit(0.0)),
            "avg_face_center_x": fx.rounded(F.col("avg_face_center_x"), 4),
            "avg_face_center_y": fx.rounded(F.col("avg_face_center_y"), 4),
            "description": F.when(n > 0, described).otherwise(F.lit(NO_FRAMES)),
        }
    )


CATEGORIES = ("hook", "keyword", "numeric", "interjection", "payoff", "question_to_answer", "motion", "shot_change", "face_presence", "speaker_interaction", "delivery_variance", "interview_keyword")


def total(config: Mining = Mining()) -> Column:
    """The weighted sum of the signals less penalties, 0 to 1; rounded, so that sums in another order compare alike."""
    plus = sum((F.lit(w) * F.col(name) for name, w in config.weights.items()), F.lit(config.base))
    minus = sum((F.when(F.col(name), F.lit(p)).otherwise(F.lit(0.0)) for name, p in config.penalties.items()), F.lit(0.0))
    return fx.rounded(fx.clamp01(plus - minus), 9)


def spike_categories() -> Column:
    s = F.col
    loud = s("keyword") >= 0.16
    rules = [
        F.when(loud, F.when(s("speaker_interaction") >= 0.1, "emotional_confrontation").otherwise("controversy")),
        F.when(loud & (s("payoff") <= 0.1), "absurdity"),
        F.when((s("motion") >= 0.55) | (s("shot_change") >= 0.5), "action"),
        F.when((s("payoff") >= 0.45) & (s("numeric") >= 0.12), "unusually_useful_claim"),
        F.when(s("interview_keyword") >= 0.2, "expert_endorsement"),
        F.when((s("interview_keyword") >= 0.1) & (s("numeric") >= 0.1), "specific_pick"),
        F.when(s("numeric") >= 0.4, "big_number"),
    ]
    return F.array_distinct(F.array_compact(F.array(*rules)))


def reasons() -> Column:
    s = F.col
    rules = [
        F.when(s("hook") >= 0.45, "strong hook"),
        F.when(s("keyword") >= 0.16, "shareability"),
        F.when(s("payoff") >= 0.35, "payoff"),
        F.when((s("motion") >= 0.55) | (s("shot_change") >= 0.5), "visual momentum"),
        F.when(s("speaker_interaction") >= 0.1, "back-and-forth"),
        F.when(s("numeric") >= 0.2, "numeric detail"),
        F.when(s("question_to_answer") >= 1.0, "question answered"),
    ]
    found = F.array_compact(F.array(*rules))
    return F.when(F.size(found) == 0, F.array(F.lit("clarity"))).otherwise(found)


def scored(windows: DataFrame, frames: DataFrame, lexicon: Lexicon = Lexicon(), config: Mining = Mining(), bounds: DataFrame | None = None) -> DataFrame:
    """windows of prepared() segments with all signals, penalties, score, spike_categories and reasons. bounds: the same
    windows with members of bounds only, if they are at hand."""
    marked = delivery(lexical(windows, lexicon, config))
    # Frames are summed for the window and for the part between its first and last segment. Only bounds take part,
    # so neither texts nor what was computed from them is shuffled for it.
    windows = windows if bounds is None else bounds
    key = ["job_id", "start_idx", "end_idx"]
    part = lambda name, start, end: F.struct(F.lit(name).alias("part"), start.alias("start_seconds"), end.alias("end_seconds"))
    whole = part("whole", F.col("start_seconds"), F.col("end_seconds"))
    middle = part("middle", F.try_element_at("members", F.lit(2))["start_seconds"], F.try_element_at("members", F.lit(-2))["end_seconds"])
    parts = windows.select(*key, F.explode(F.when(F.size("members") > 2, F.array(whole, middle)).otherwise(F.array(whole))).alias("p"))
    bounds = parts.select(F.struct(*key, F.col("p.part").alias("part")).alias("row_id"), "job_id", "p.start_seconds", "p.end_seconds")
    # SQL adds the middle's frames in another order than the window's, so the middle's average must not depend on it.
    sums = frame_sums(bounds, frames, exact_motion=_exact_mean("motion_score")).select("row_id.*", *COUNTS, "exact_motion")
    of_window = F.col("part") == "whole"
    by_window = sums.groupBy(*key).agg(
        *[F.max(F.when(of_window, F.col(c))).alias(c) for c in COUNTS], F.max(F.when(~of_window, F.col("exact_motion"))).alias("middle_motion")
    )
    seen = visual_signals(marked.join(by_window, key, "left").fillna(0, [*COUNTS, "middle_motion"])).drop(*COUNTS)
    rambling = (F.size("members") > 2) & (F.col("middle_motion") <= config.still_motion) & (F.col("middle_keyword") <= config.still_keyword)
    out = seen.withColumn("rambling_middle", F.coalesce(rambling, F.lit(False)))
    return out.withColumn("score", total(config)).withColumns({"spike_categories": spike_categories(), "reasons": reasons()})
