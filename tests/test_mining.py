"""Small cases with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from momentquery.config import Durations, Mining
from momentquery.functions import text as fx
from momentquery.lexicon import Lexicon
from momentquery.operators import camera, captions, requests, selection, signals, windows

LEX = Lexicon()
SEGMENT = "job_id string, seg_idx int, speaker string, start_seconds double, end_seconds double, text string"


def segments(spark, rows):
    return spark.createDataFrame([("j", i, s, float(a), float(b), t) for i, (s, a, b, t) in enumerate(rows)], SEGMENT)


def test_windows_of_five_segments(spark):
    w = windows.enumerated(segments(spark, [("a", 6 * i, 6 * i + 6, "x") for i in range(5)]))
    assert {(r.start_idx, r.end_idx) for r in w.collect()} == {(0, 2), (0, 3), (0, 4), (1, 3), (1, 4), (2, 4)}


def test_a_window_never_grows_past_one_that_is_too_long(spark):
    w = windows.enumerated(segments(spark, [("a", 0, 20, ""), ("a", 20, 60, ""), ("a", 21, 40, "")]))
    assert {(r.start_idx, r.end_idx) for r in w.collect()} == {(0, 0), (1, 1), (1, 2), (2, 2)}


def test_windows_without_segments(spark):
    assert windows.enumerated(spark.createDataFrame([], SEGMENT)).count() == 0


def test_durations_are_checked():
    for bad in ((0, 10), (10, 5)):
        with pytest.raises(ValueError):
            Durations(*bad)


@pytest.mark.parametrize(
    ("text", "signal", "value"),
    [
        ("the ban on this secret was wild", "keyword", 0.5),
        ("Here's the thing: this crazy secret blew up.", "hook", 0.35 + 0.5 * 2 / 6),
        ("he ran 5 miles in 30 minutes", "numeric", 1.0),
        ("and the outcome was amazing", "payoff", 0.25),
        ("wait, listen, honestly", "interjection", 1.0),
        ("", "numeric", 0.0),
        ("", "interjection", 0.0),
        (None, "keyword", None),
        ("i'm long, hands down", "interview", 1.0),
    ],
)
def test_text_signals(spark, text, signal, value):
    df = spark.createDataFrame([(text,)], "t string").withColumn("w", fx.tokens(F.col("t")))
    t, w = F.col("t"), F.col("w")
    columns = {"keyword": fx.keyword(w, LEX), "hook": fx.hook(t, w, LEX), "numeric": fx.numeric(t, w), "payoff": fx.payoff(t, w, LEX), "interjection": fx.interjection(w, LEX), "interview": fx.interview(t, w, LEX)}
    got = df.select(columns[signal].alias("x")).first().x
    assert got is None if value is None else got == pytest.approx(value)


def test_block_takes_in_both_neighbours(spark):
    rows = [("host", 0, 20, ""), ("host", 30, 60, ""), ("guest", 60, 90, ""), ("host", 90, 110, ""), ("guest", 110, 140, ""), ("host", 140, 150, ""), ("host", 150, 180, "")]
    b = windows.interview_blocks(segments(spark, rows)).collect()
    assert [(r.start_seconds, r.end_seconds, r.transition_count, r.speakers) for r in b] == [(30.0, 180.0, 4, ["guest", "host"])]


def _scored(spark, rows):
    return spark.createDataFrame([("j", i, i, float(a), float(b), float(s)) for i, (a, b, s) in enumerate(rows)], "job_id string, start_idx int, end_idx int, start_seconds double, end_seconds double, score double")


BLOCK = "job_id string, block_idx int, start_seconds double, end_seconds double"


def brute(scored, blocks, cfg):
    """The choice as loops over one job."""
    def ratio(a, b):
        over = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
        short = min(a[1] - a[0], b[1] - b[0])
        return over / short if short > 0 else 0.0

    def clash(x, kept):
        return any(ratio(x, k) > cfg.overlap for k in kept)

    ranked = sorted(scored, key=lambda x: (-x[2], x[3]))
    kept = []
    for x in ranked:
        if x[2] >= cfg.floor and not clash(x, kept):
            kept.append(x)
    for k in blocks:
        touch = lambda x: min(x[1], k[1]) - max(x[0], k[0]) > 0
        if any(map(touch, kept)):
            continue
        fits = [x for x in ranked if touch(x) and not clash(x, kept)]
        good = [x for x in fits if x[2] >= cfg.block_floor]
        kept += (good or fits)[:1]
    least = min(cfg.most_clips, max(cfg.least_clips, 0))
    for check in (True, False):
        for x in ranked:
            if len(kept) >= least:
                break
            if all(x[:2] != k[:2] for k in kept) and not (check and clash(x, kept)):
                kept.append(x)
    return [x[3] for x in kept[: cfg.most_clips]]


@pytest.mark.parametrize("seed", range(6))
def test_choice_matches_loops(spark, seed):
    import random

    rnd = random.Random(seed)
    rows = [(a := rnd.randint(0, 200), a + rnd.randint(15, 45), rnd.randint(0, 60) / 100) for _ in range(25)]
    blocks = sorted((a := rnd.randint(0, 200), a + 40) for _ in range(3))
    cfg = Mining(least_clips=rnd.choice([0, 5, 9]), most_clips=rnd.choice([6, 12]))
    b = spark.createDataFrame([("j", i, float(x), float(y)) for i, (x, y) in enumerate(blocks)], BLOCK)
    got = [r.start_idx for r in selection.selected(_scored(spark, rows), b, cfg).orderBy("rank").collect()]
    assert got == brute([(*map(float, r), i) for i, r in enumerate(rows)], [tuple(map(float, x)) for x in blocks], cfg)


def test_equal_overlap_survives(spark):
    kept = selection.deduplicated(selection.ranked(_scored(spark, [(0, 20, 0.9), (10, 30, 0.8), (9, 29, 0.7)]))).first().kept
    assert [k.start_idx for k in kept] == [0, 1]


WORDS = "job_id string, seg_idx int, word_idx int, text string, start_seconds double, end_seconds double"


def test_caption_lines_of_at_most_four_words(spark):
    from momentquery.config import Captions

    rows = [("j", "c", i, f"w{i}", i * 0.2, i * 0.2 + 0.15, False) for i in range(12)]
    df = spark.createDataFrame(rows, "job_id string, clip_id string, word_ord int, text string, start_seconds double, end_seconds double, emphasis boolean")
    assert [len(r.words) for r in captions.lines(df, Captions(words=4)).orderBy("line_idx").collect()] == [4, 4, 4]


def test_caption_words_are_cut_to_the_clip(spark):
    clips = spark.createDataFrame([("j", "c", 1.0, 2.2)], "job_id string, clip_id string, start_seconds double, end_seconds double")
    words = spark.createDataFrame([("j", 0, 0, "hi", 0.8, 1.5), ("j", 0, 1, "out", 2.2, 3.0)], WORDS)
    got = captions.clip_words(clips, segments(spark, [("a", 0, 3, "hi out")]), words).collect()
    assert [(r.start_seconds, r.end_seconds) for r in got] == [(0.0, 0.5)]


@pytest.mark.parametrize(("word", "is_loud"), [("42nd", True), ("NASA", True), ("A", False), ("because", False), ("amazing!", True), ("cat", False), ("...", False), ("", False)])
def test_emphasis(spark, word, is_loud):
    assert spark.createDataFrame([(word,)], "w string").select(captions.emphasised(F.col("w")).alias("e")).first().e is is_loud


def test_crop_targets(spark):
    df = spark.createDataFrame([(1920, 1080)], "source_width int, source_height int")
    got = {r.aspect_ratio: (r.target_width, r.target_height) for r in camera.targets(df).collect()}
    assert got == {"9:16": (606, 1080), "1:1": (1080, 1080), "16:9": (1920, 1080)}


@pytest.mark.parametrize(("seconds", "text"), [(0.0, "0:00:00.00"), (59.999, "0:01:00.00"), (3661.5, "1:01:01.50"), (-1.0, "0:00:00.00")])
def test_ass_time(spark, seconds, text):
    assert spark.createDataFrame([(seconds,)], "s double").select(captions.ass_time(F.col("s")).alias("t")).first().t == text


def test_piecewise_expressions(spark):
    rows = [("a", 0, 0.0, 5), ("a", 1, 1.0, 5), ("b", 0, 0.0, 5), ("b", 1, 2.0, 9), ("b", 2, 3.0, 9)]
    df = spark.createDataFrame(rows, "k string, anchor_idx int, t double, v int")
    got = {r.k: r.expression for r in camera.piecewise(df, ["k"], "v").collect()}
    assert got == {"a": "5", "b": r"if(lt(t\,2)\,(5+(4)*(t-0)/2)\,if(lt(t\,3)\,9\,9))"}


def test_settings_and_numbers(spark):
    from momentquery.operators import identity

    df = spark.createDataFrame([('A="x y"',), ("# no",), ("",), ("B = 1=2",), ("plain",)], "value string")
    assert {(r.key, r.value) for r in identity.settings(df).collect()} == {("A", "x y"), ("B", "1=2")}
    n = spark.createDataFrame([("3",), ("0",), ("x",), (None,)], "s string").select(identity.positive_int(F.col("s")).alias("n"))
    assert [r.n for r in n.collect()] == [3, None, None, None]


FRAME = "job_id string, timestamp_seconds double, motion_score double, shot_change boolean, face_x double, face_y double"


def frames(spark, motion, start, turn):
    rows = [("j", start + 1.5 * i, m / 101, False, None, None) for i, m in enumerate(motion)]
    return spark.createDataFrame(rows[::turn], FRAME).coalesce(1)


@pytest.mark.parametrize("turn", (1, -1))
def test_averages_add_frames_in_order_of_time(spark, turn):
    """505 / 101 / 8 is 0.625; added backwards it falls short of that."""
    w = spark.createDataFrame([(1, "j", 3.0, 16.5)], "row_id int, job_id string, start_seconds double, end_seconds double")
    seen = signals.visual_summary(signals.visual(w, frames(spark, [78, 100, 94, 29, 27, 91, 16, 70], 3.0, turn))).first()
    assert seen.frame_count == 8 and "avg motion 0.63," in seen.description and seen.avg_face_center_x is None


def test_rounding_is_that_of_sql(spark):
    import duckdb

    values = [0.0001245, 0.5193625, 0.2615625, 0.5108845, 1.0000005, -0.0001245, 2.5e-7, 0.0]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(fx.rounded(F.col("x"), 6).alias("r")).collect()
    assert [r.r for r in got] == [duckdb.connect().execute(f"select round({x!r}::double, 6)").fetchone()[0] for x in values]
    assert spark.range(1).select(fx.rounded(F.lit(float("nan")), 6).alias("r")).filter("isnan(r)").count() == 1


@pytest.mark.parametrize("turn", (1, -1))
def test_still_middle_whatever_the_order_of_frames(spark, turn):
    """The middle's average is the threshold itself; added backwards it exceeds it."""
    raw = segments(spark, [("a", 0, 6, "x"), ("a", 6, 18, "x"), ("a", 18, 24, "x")])
    said = [("j", i, k, "x", 6.0 * i + 2 * k, 6.0 * i + 2 * k + 1) for i in range(3) for k in range(2)]
    words = spark.createDataFrame(said, "job_id string, seg_idx int, word_idx int, text string, start_seconds double, end_seconds double")
    whole = windows.enumerated(signals.prepared(raw, words)).filter("start_idx = 0 and end_idx = 2")
    f = frames(spark, [16, 13, 8, 31, 56, 27, 49, 2], 6.0, turn)
    scored = signals.scored(whole, f)
    plain = windows.enumerated(raw).filter("start_idx = 0 and end_idx = 2")
    seen = signals.visual_summary(signals.visual(plain.drop("members").withColumn("row_id", F.struct("job_id", "start_idx", "end_idx")), f))
    assert [r.mining_signals.rambling_middle for r in requests.full_briefs(plain.drop("members"), scored, plain, seen).collect()] == [True]


@pytest.mark.parametrize("motion", ([55, 6, 31, 9], [9, 31, 6, 55], [16, 13, 8, 31, 56, 27, 49, 2]))
def test_still_middle_at_the_threshold(spark, motion):
    """101 / 101 / 4 is the threshold; added one after another in order of time, the first exceeds it."""
    raw = segments(spark, [("a", 0, 6, "x"), ("a", 6, 18, "x"), ("a", 18, 24, "x")])
    said = [("j", i, k, "x", 6.0 * i + 2 * k, 6.0 * i + 2 * k + 1) for i in range(3) for k in range(2)]
    words = spark.createDataFrame(said, "job_id string, seg_idx int, word_idx int, text string, start_seconds double, end_seconds double")
    whole = windows.enumerated(signals.prepared(raw, words)).filter("start_idx = 0 and end_idx = 2")
    assert [r.rambling_middle for r in signals.scored(whole, frames(spark, motion, 6.0, 1)).collect()] == [True]


def test_full_briefs_at_the_threshold(spark):
    raw = segments(spark, [("a", 0, 6, "x"), ("a", 6, 18, "x"), ("a", 18, 24, "x")])
    said = [("j", i, k, "x", 6.0 * i + 2 * k, 6.0 * i + 2 * k + 1) for i in range(3) for k in range(2)]
    words = spark.createDataFrame(said, "job_id string, seg_idx int, word_idx int, text string, start_seconds double, end_seconds double")
    whole = windows.enumerated(signals.prepared(raw, words)).filter("start_idx = 0 and end_idx = 2")
    f = frames(spark, [55, 6, 31, 9], 6.0, 1)
    scored = signals.scored(whole, f)
    plain = windows.enumerated(raw).filter("start_idx = 0 and end_idx = 2")
    seen = signals.visual_summary(signals.visual(plain.drop("members").withColumn("row_id", F.struct("job_id", "start_idx", "end_idx")), f))
    brief = requests.full_briefs(plain.drop("members"), scored, plain, seen).first()
    assert brief.mining_signals.rambling_middle and brief.mining_score == scored.first().score
