"""Readers, writers, contracts, handoffs and streams."""

import json

import pytest
from pyspark.sql import functions as F

from momentquery import contracts
from momentquery.operators import handoff, profile, vision
from momentquery.sources import files
from momentquery.streaming import streams

ENTRY = dict(job_id="j", clip_id="c", recorded_at="2024-01-01", duration_seconds=10.0, score=0.5, posted=True)


def test_history_reads_what_is_sound(spark, tmp_path):
    at = tmp_path / "h.jsonl"
    lines = [json.dumps(ENTRY), "", "{bad", json.dumps({**ENTRY, "clip_id": "d", "ratios": ["1:1"]}), json.dumps({"job_id": "only"}), "[1]"]
    at.write_text("\n".join(lines))
    rows = files.read_history(spark, str(at)).orderBy("ord").collect()
    assert [(r.clip_id, r.ratios, r.notes) for r in rows] == [("c", [], None), ("d", ["1:1"], None)]
    assert files.read_history(spark, str(tmp_path / "none")).count() == 0


def test_history_appends(spark, tmp_path):
    at = str(tmp_path / "log")
    df = spark.createDataFrame([(1, "j", "c", "t", 1.0, 0.5, ["x"], [], "", True, None)], "ord long, job_id string, clip_id string, recorded_at string, duration_seconds double, score double, spike_categories array<string>, ratios array<string>, title string, posted boolean, notes string")
    assert files.append_history(df, at) == 1 and files.append_history(df, at) == 1
    assert files.read_history(spark, at).count() == 2


def test_documents(spark, tmp_path):
    at = tmp_path / "t.json"
    at.write_text(json.dumps({"segments": [{"speaker": "a", "start_seconds": 0, "end_seconds": 1, "text": "hi", "words": [{"text": "hi", "start_seconds": 0, "end_seconds": 1, "confidence": 1}]}]}))
    doc = files.read_document(spark, str(at), files.TRANSCRIPT).withColumn("job_id", F.lit("j"))
    segs = files.segments(doc)
    assert segs.count() == 1 and files.words(segs).first().text == "hi"
    at.write_text("{nope")
    assert files.read_document(spark, str(at), files.TRANSCRIPT).count() == 0
    for path in (str(at), str(tmp_path / "none")):
        with pytest.raises(files.ContractReadError):
            files.read_document(spark, path, files.TRANSCRIPT, strict=True)


def test_raw_segments_are_made_sound(spark):
    nan = float("nan")
    words = [("a", 1.0, 0.5, 2.0, None), ("  ", 0.0, 1.0, 1.0, None), ("b", None, 1.0, 1.0, None), ("c", 2.0, 3.0, nan, "S")]
    df = spark.createDataFrame([("j", 0, None, None, " t ", None, words), ("j", 1, 0.0, 1.0, "x", "s", [])], "job_id string, seg_idx int, start double, end double, text string, speaker string, words array<struct<word:string,start:double,end:double,score:double,speaker:string>>")
    r = files.normalised_segments(df).collect()
    assert len(r) == 1 and (r[0].start_seconds, r[0].end_seconds, r[0].speaker, r[0].text) == (1.0, 3.0, "S", "t")
    assert [(w.text, w.start_seconds, w.end_seconds, w.confidence) for w in r[0].words] == [("a", 1.0, 1.0, 1.0), ("c", 2.0, 3.0, 0.0)]


def test_probe(spark, tmp_path):
    at = tmp_path / "p.json"
    at.write_text(json.dumps({"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "30000/1001"}, {"codec_type": "audio", "sample_rate": "48000"}]}))
    r = files.probe(files.read_document(spark, str(at), files.PROBE)).first()
    assert (r.duration_seconds, r.width, r.height, r.audio_sample_rate) == (12.5, 4, 2, 48000) and r.fps == pytest.approx(29.97, abs=0.01)


def test_cache_and_upsert(spark, tmp_path):
    at, schema = str(tmp_path / "c"), "k string, model string, v int"
    assert files.cached(spark, at, {"model": "m"}, schema).count() == 0
    spark.createDataFrame([("a", "m", 1), ("b", "n", 2)], schema).write.parquet(at)
    hit = files.cached(spark, at, {"model": "m"}, schema)
    assert [tuple(r) for r in hit.collect()] == [("a", "m", 1)]
    both = files.upserted(hit, spark.createDataFrame([("a", "m", 9), ("z", "m", 3)], schema), ["k"])
    assert {(r.k, r.v) for r in both.collect()} == {("a", 9), ("z", 3)}


def test_subtitles_and_packs(spark, tmp_path):
    d = spark.createDataFrame([("c1", 1, "two"), ("c1", 0, "one")], "clip_id string, line_idx int, dialogue string")
    files.write_subtitles(d, "[Events]\n", str(tmp_path / "s"))
    assert next((tmp_path / "s" / "clip_id=c1").glob("*.txt")).read_text().strip() == "[Events]\none\ntwo"
    files.write_packs(d, str(tmp_path / "p"))
    assert (tmp_path / "p" / "clip_id=c1").exists()


def test_contracts(spark):
    good = spark.createDataFrame([(1.0, 1.0)], "start_seconds double, end_seconds double")
    assert contracts.strict(contracts.spans(good)).count() == 1
    with pytest.raises(contracts.ContractError):
        contracts.strict(contracts.spans(good, zero_length=False))
    nulls = spark.createDataFrame([(None, 1.0)], "start_seconds double, end_seconds double")
    assert len(contracts.spans(nulls).first().errors) == 2
    j = spark.createDataFrame([('{"a": 1, "b": 2}',), ("x",), (None,)], "j string")
    assert [r.errors for r in contracts.unknown_fields(j, "j", ["a"]).collect()] == [["unknown field b"], ["no object"], ["no object"]]
    plan = spark.createDataFrame([([], 10, 10, 20, 5)], "anchors array<int>, source_width int, source_height int, target_width int, target_height int")
    assert contracts.crop_plans(plan).first().errors == ["no anchors", "wider than its source"]
    e = spark.createDataFrame([(["action", "no"],)], "spikes array<string>")
    assert contracts.enums(e, "spikes", contracts.SPIKES).first().errors == ["unknown spikes"]
    brief = spark.createDataFrame([("t", ["a", "b"], [])], "theme string, expected_viral_patterns array<string>, anti_patterns array<string>")
    assert contracts.video_briefs(brief).first().errors == ["expected_viral_patterns"]


def test_approval_is_plain_top_k(spark):
    df = spark.createDataFrame([("j", c, s) for c, s in zip("abcd", (0.92, 0.8, 0.5, 0.4))], "job_id string, clip_id string, score double")
    got = handoff.approved(df, 3, 0.75).orderBy("clip_id").collect()
    assert [r.approved for r in got] == [True, True, True, False] and got[0].threshold_met_count == 2
    with pytest.raises(ValueError):
        handoff.approved(df, 0, 0.5)


def test_first_error_is_raised(spark):
    with pytest.raises(handoff.ScoringError):
        handoff.checked(spark.createDataFrame([("h", "bad")], "clip_hash string, error string"), handoff.ScoringError)


def test_patterns_of_short_clips(spark):
    rows = [(i, "j", f"c{i}", 25.0, 0.5, True, [], []) for i in range(10)] + [(10 + i, "j", f"d{i}", 75.0, 0.5, False, [], []) for i in range(8)]
    df = spark.createDataFrame(rows, "ord long, job_id string, clip_id string, duration_seconds double, score double, posted boolean, spike_categories array<string>, ratios array<string>")
    got = {r.key: (r.direction, r.confidence, r.sample_size, r.overall_keep_rate) for r in profile.patterns(profile.latest(df)).collect()}
    assert got == {"over_60s": ("skips", "medium", 8, 0.5556), "20_to_30s": ("keeps", "medium", 10, 0.5556)}
    assert profile.patterns(df.limit(0)).count() == 0 and profile.summary(df.limit(0)).first().keep_rate == 0.0


def test_motion_and_shots(spark):
    m = spark.createDataFrame([("j", 0, float("nan")), ("j", 1, -1.0), ("j", 2, 3.0)], "job_id string, frame_idx int, magnitude double")
    assert [r.motion_score for r in vision.normalised_motion(m).orderBy("frame_idx").collect()] == [0.0, 0.0, 1.0]
    samples = spark.createDataFrame([("j", i, t) for i, t in enumerate((0.0, 0.5, 1.0))], "job_id string, frame_idx int, timestamp_seconds double")
    shots = spark.createDataFrame([("j", 0.51)], "job_id string, shot_seconds double")
    assert [r.frame_idx for r in vision.shot_frames(samples, shots).collect()] == [1]
    tie = spark.createDataFrame([("j", 0.25)], "job_id string, shot_seconds double")
    assert [r.frame_idx for r in vision.shot_frames(samples, tie).collect()] == [0]


def test_two_voices_are_told_apart(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=16), rng.normal(size=16)
    rows = [("j", i, [float(x) for x in (a if i % 2 else b) + rng.normal(size=16) * 0.05]) for i in range(12)]
    got = vision.clustered(spark.createDataFrame(rows, "job_id string, span_idx int, vec array<double>")).orderBy("span_idx").collect()
    assert [r.label for r in got] == [0, 1] * 6


def test_sessions_and_feedback_streams(spark, tmp_path):
    rows = [("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 00:00:10"), ("k", "2024-01-01 00:00:21")]
    df = spark.createDataFrame(rows, "key string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert sorted(r.n for r in streams.merged_events(df, "key", "ts").collect()) == [1, 2]
    f = spark.createDataFrame([("j", "c", 1, True), ("j", "c", 2, False)], "job_id string, clip_id string, ord int, posted boolean")
    f.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f.schema).parquet(str(tmp_path / "in"))
    streams.latest_feedback(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    read = lambda: {tuple(r) for r in streams.read_feedback(spark, str(tmp_path / "out"), f.schema).collect()}
    assert read() == {("j", "c", 2, False)}
    more = spark.createDataFrame([("j", "c", 1, True), *(("j", f"d{i}", 1, True) for i in range(300))], f.schema)
    for rows in (more, spark.createDataFrame([("j", "d7", 2, False), ("j", "c", 3, True)], f.schema)):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        before = streams._versions(spark, str(tmp_path / "out"))
        streams.latest_feedback(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    after = streams._versions(spark, str(tmp_path / "out"))
    assert sum(after[b] != before[b] for b in before) <= 2 and len(after) > 50
    assert read() == {("j", "c", 3, True), ("j", "d7", 2, False), *(("j", f"d{i}", 1, True) for i in range(300) if i != 7)}


def test_smoothing_stream_equals_batch(spark, tmp_path):
    from momentquery.config import OneEuro
    from momentquery.operators import camera
    from momentquery.session import ship

    ship(spark)
    rows = [("k", i, t, v) for i, (t, v) in enumerate(((0.0, 1.0), (1.0, 2.0), (2.0, None), (1.5, 4.0), (2.5, 3.0)))]
    df = spark.createDataFrame(rows, "key string, idx int, t double, value double")
    want = {r.idx: r.smoothed for r in camera.one_euro(df, OneEuro(beta=0.5)).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.smoothed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), OneEuro(beta=0.5))
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.idx: r.smoothed for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == pytest.approx(want) and set(got) == {0, 1, 3, 4}


def test_clusters_of_vectors(spark):
    """Labels count from 0 by first appearance, are no more than eight, and don't depend on how rows are dealt."""
    import numpy as np

    from momentquery.operators import vision

    rng = np.random.default_rng(4)
    centres = np.linalg.qr(rng.normal(size=(12, 12)))[0]
    rows, true = [], {}
    for job, k, n in (("a", 3, 24), ("b", 1, 10), ("c", 10, 40), ("d", 2, 7)):
        for i in range(n):
            c = i % k if i < k else int(rng.integers(k))
            rows.append((job, i, (centres[c] + rng.normal(size=12) * 0.02).tolist()))
            true[job, i] = c
    df = spark.createDataFrame(rows, "job_id string, span_idx int, vec array<double>")
    got = {(r.job_id, r.span_idx): r.label for r in vision.clustered(df).collect()}
    again = {(r.job_id, r.span_idx): r.label for r in vision.clustered(df.repartition(5).orderBy(F.rand(3))).collect()}
    assert got == again and got.keys() == true.keys()
    for job in "abcd":
        labels = [got[key] for key in sorted(got) if key[0] == job]
        assert list(dict.fromkeys(labels)) == list(range(max(labels) + 1)) and max(labels) < 8
    for job in "ad":
        pairs = {(true[key], got[key]) for key in got if key[0] == job}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_caches_are_read_through(spark):
    wanted = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "m")], "source string, model string")
    cache = spark.createDataFrame([("a", "m", 1), ("b", "other", 2), ("z", "m", 3)], "source string, model string, n int")
    every, made = files.read_through(wanted, cache, ["source", "model"], lambda missing: missing.withColumn("n", F.lit(9)))
    assert {tuple(r) for r in every.collect()} == {("a", "m", 1), ("b", "m", 9), ("c", "m", 9)} and {r.source for r in made.collect()} == {"b", "c"}


def test_internal_fields_go(spark):
    rows = spark.createDataFrame([(1, 2, [("w", 3)])], "a int, _b int, words array<struct<text:string,_id:int>>")
    assert files.public(rows).columns == ["a", "words"] and [tuple(w) for w in files.public(rows).first().words] == [("w",)]
