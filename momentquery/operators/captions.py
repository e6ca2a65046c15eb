"""Caption words and lines of clips, and their subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Captions
from ..lexicon import CAPTION_STOPWORDS

#: Seconds of the slices by which words meet clips.
SLICE = 15.0
EDGES = ".,!?;:\"'()[]{}"


def emphasised(text: Column, config: Captions = Captions()) -> Column:
    """Words with a digit, in capitals, or long and no stopword."""
    bare = F.trim(F.trim(text), F.lit(EDGES))
    capitals = (F.upper(bare) == bare) & (F.lower(bare) != bare) & (F.length(bare) > 1)
    long = ~F.lower(bare).isin(list(CAPTION_STOPWORDS)) & (F.length(bare) >= config.emphasis_length)
    return (F.length(bare) > 0) & (F.rlike(bare, F.lit(r"\p{Nd}")) | capitals | long)


def clip_words(clips: DataFrame, segments: DataFrame, words: DataFrame, config: Captions = Captions()) -> DataFrame:
    """job_id, clip_id, word_ord, text, start_seconds, end_seconds, emphasis: the words that overlap a clip, cut to
    it and counted from its start."""
    # Words bring the bounds of their segment, and meet clips by slices of SLICE seconds.
    s = segments.select("job_id", "seg_idx", F.col("start_seconds").alias("_s"), F.col("end_seconds").alias("_e"))
    w = words.select("job_id", "seg_idx", "word_idx", "text", F.col("start_seconds").alias("w0"), F.col("end_seconds").alias("w1")).join(s, ["job_id", "seg_idx"])
    w = w.withColumnsRenamed({"job_id": "_job", "seg_idx": "_seg"}).withColumn("_slice", _slices("w0", "w1"))
    c = clips.select("job_id", "clip_id", F.col("start_seconds").alias("c0"), F.col("end_seconds").alias("c1")).withColumn("slice", _slices("c0", "c1"))
    # A pair that shares several slices counts in the first of them only.
    first = F.greatest(F.floor(F.col("c0") / SLICE), F.floor(F.col("w0") / SLICE))
    inside = (F.col("_e") > F.col("c0")) & (F.col("_s") < F.col("c1")) & (F.col("w1") > F.col("c0")) & (F.col("w0") < F.col("c1"))
    cut = c.join(w, (F.col("job_id") == F.col("_job")) & (F.col("slice") == F.col("_slice")) & (F.col("slice") == first) & inside).withColumns(
        {"start_seconds": F.greatest("w0", "c0") - F.col("c0"), "end_seconds": F.least("w1", "c1") - F.col("c0"), "emphasis": emphasised(F.col("text"), config)}
    )
    order = W.partitionBy("job_id", "clip_id").orderBy("start_seconds", "_seg", "word_idx")
    kept = cut.filter(F.col("end_seconds") > F.col("start_seconds"))
    return kept.select("job_id", "clip_id", (F.row_number().over(order) - 1).alias("word_ord"), "text", "start_seconds", "end_seconds", "emphasis")


def _slices(start: str, end: str) -> Column:
    low, high = F.floor(F.col(start) / SLICE), F.floor(F.col(end) / SLICE)
    return F.explode(F.sequence(low, F.greatest(low, high)))


def lines(clip_word_rows: DataFrame, config: Captions = Captions()) -> DataFrame:
    """job_id, clip_id, line_idx, start_seconds, end_seconds, text, words.

    A line ends before a word that would be one too many, would make it too long, or comes after too long a pause;
    each line's start depends on where the one before ended, so this is a fold over a clip's words. What is folded are
    the places where lines begin; words are cut there afterwards."""
    fields = F.struct(F.col("word_ord").cast("int"), "text", F.col("start_seconds").cast("double").alias("start_seconds"), F.col("end_seconds").cast("double").alias("end_seconds"), "emphasis")
    packed = clip_word_rows.groupBy("job_id", "clip_id").agg(F.array_sort(F.collect_list(fields)).alias("w"))
    bounds = "transform(w, (x, i) -> struct(i as i, x.start_seconds as s, x.end_seconds as e))"
    breaks = f"x.i - acc.at >= {config.words} or x.e - acc.s > {config.seconds} or x.s - acc.e > {config.gap}"
    first = "named_struct('starts', array(0), 'at', 0, 's', w[0].start_seconds, 'e', w[0].end_seconds)"
    fold = f"""aggregate(slice({bounds}, 2, size(w)), {first},
        (acc, x) -> if({breaks},
            named_struct('starts', concat(acc.starts, array(x.i)), 'at', x.i, 's', x.s, 'e', x.e),
            named_struct('starts', acc.starts, 'at', acc.at, 's', acc.s, 'e', x.e)),
        acc -> acc.starts)"""
    starts = packed.withColumn("starts", F.expr(fold))
    cut = "transform(starts, (s, i) -> slice(w, s + 1, coalesce(get(starts, i + 1), size(w)) - s))"
    each = starts.select("job_id", "clip_id", F.posexplode(F.expr(cut)).alias("line_idx", "words"))
    return each.select(
        "job_id", "clip_id", "line_idx",
        F.element_at("words", 1)["start_seconds"].alias("start_seconds"), F.element_at("words", -1)["end_seconds"].alias("end_seconds"),
        F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"), "words",
    )


# Fixed values of the subtitle format.
EMPHASIS_COLOUR, PLAIN_COLOUR = "0000F0FF", "00FFFFFF"


def ass_time(seconds: Column) -> Column:
    """H:MM:SS.cc"""
    centi = F.round(F.greatest(seconds, F.lit(0.0)) * 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(centi / 360000), F.floor(centi / 6000) % 60, F.floor(centi / 100) % 60, centi % 100)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))


def dialogue(caption_lines: DataFrame) -> DataFrame:
    """Lines of lines() with dialogue, the subtitle event; emphasised words have a colour of their own."""
    mark = lambda colour: F.lit("{\\c&H" + colour + "&}")
    body = F.array_join(
        F.transform("words", lambda w: F.when(w["emphasis"], F.concat(mark(EMPHASIS_COLOUR), escaped(w["text"]), mark(PLAIN_COLOUR))).otherwise(escaped(w["text"]))), " "
    )
    event = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_seconds")), F.lit(","), ass_time(F.col("end_seconds")), F.lit(",Default,,0,0,0,,"), body)
    return caption_lines.withColumn("dialogue", event)
