"""Typed documents, digests, voices, settings and the steps of a workspace."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from momentquery import contracts
from momentquery.operators import identity, render, requests, voices, workspaces
from momentquery.operators.handoff import PackagingError, ScoringError
from momentquery.sources import documents as docs

RUBRIC = dict.fromkeys(("hook", "shareability", "standalone_clarity", "payoff", "delivery_energy", "quotability"), 0.5)


def score(n, **more):
    return {"clip_id": f"clip-{n}", "clip_hash": f"h{n}", "rubric": RUBRIC, "spike_categories": ["action"], "penalties": [], "final_score": 0.5, "title": "t", "hook": "", "reasons": []} | more


def brief(**more):
    return {"rubric_version": "v1", "job_id": "j", "theme": "th", "video_format": "talk", "expected_viral_patterns": ["a", "b", "c"], "anti_patterns": [], "audience": None, "tone": None, "notes": None} | more


def write(place, name, value):
    (place / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_answers(spark, tmp_path):
    at, name = str(tmp_path), docs.SCORES.file
    assert docs.read_answer(spark, at, docs.SCORES).count() == 0
    write(tmp_path, name, {"rubric_version": "v1", "job_id": "j", "scores": [score(2), score(1)]})
    got = docs.read_answer(spark, at, docs.SCORES).orderBy("ord").collect()
    assert [(r.clip_id, r.ord, r.version, r.job_id, r.rubric.hook) for r in got] == [("clip-2", 0, "v1", "j", 0.5), ("clip-1", 1, "v1", "j", 0.5)]
    answers = docs.read_answer(spark, at, docs.SCORES)
    assert docs.matching(answers, docs.SCORES, "v1", "j").count() == 2
    for version, job in (("v2", "j"), ("v1", "k")):
        with pytest.raises(ScoringError, match="asked were"):
            docs.matching(answers, docs.SCORES, version, job)
    lacking = score(1)
    del lacking["title"]
    bad = [
        ("{", "not valid JSON"), ([1], "does not match"), ({"job_id": "j", "scores": []}, "rubric_version is missing"), ({"rubric_version": "v1", "job_id": "j", "scores": [], "x": 1}, "unknown field x"),
        *(({"rubric_version": "v1", "job_id": "j", "scores": [s]}, m) for s, m in (
            (lacking, "title is missing"), (score(1, extra=1), "unknown field scores: extra"), (score(1, final_score=1.5), "final_score is not a share"), (score(1, rubric=RUBRIC | {"hook": -1}), "hook is not a share"),
            (score(1, spike_categories=["dull"]), "unknown spike_categories"), (score(1, penalties=["dull"]), "unknown penalties"))),
        ({"rubric_version": "v1", "job_id": "j", "scores": [score(1), score(2, clip_id="clip-1")]}, "clip_id 'clip-1' more than once"),
        ({"rubric_version": "v1", "job_id": "j", "scores": [score(1), score(2, clip_hash="h1")]}, "clip_hash 'h1' more than once"),
    ]
    for value, message in bad:
        write(tmp_path, name, value)
        with pytest.raises(ScoringError, match=message):
            docs.read_answer(spark, at, docs.SCORES).collect()


def test_brief_and_pack_answers(spark, tmp_path):
    at = str(tmp_path)
    write(tmp_path, docs.BRIEFS.file, {"rubric_version": "v1", "job_id": "j", "brief": {k: v for k, v in brief().items() if k != "notes"}})
    assert [(r.theme, r.ord, r.notes) for r in docs.read_answer(spark, at, docs.BRIEFS).collect()] == [("th", 0, None)]
    write(tmp_path, docs.BRIEFS.file, {"rubric_version": "v1", "job_id": "j", "brief": brief(expected_viral_patterns=["a"])})
    with pytest.raises(docs.BriefError, match="expected_viral_patterns"):
        docs.read_answer(spark, at, docs.BRIEFS).collect()
    with pytest.raises(PackagingError, match="not in the workspace"):
        docs.read_answer(spark, at, docs.PACKS, required=True)


def test_jobs_and_requests(spark, tmp_path):
    path = str(tmp_path / "job.json")
    with pytest.raises(docs.JobError, match="missing"):
        docs.read_job(spark, path)
    job = {"video_path": "v.mp4", "output_dir": "out"}
    for value, kind in (("{", docs.JobSyntaxError), ({"video_path": "v"}, docs.JobContractError), (job | {"x": 1}, docs.JobContractError), (job | {"max_candidates": 0}, docs.JobContractError), (job | {"output_profile": {"ratios": ["2:1"]}}, docs.JobContractError), ([], docs.JobContractError)):
        write(tmp_path, "job.json", value)
        with pytest.raises(kind):
            docs.read_job(spark, path)
    write(tmp_path, "job.json", job)
    row = docs.read_job(spark, path).first()
    assert (row.review_required, row.max_candidates, row.ratios, row.caption_preset, row.video_brief) == (True, 12, ["9:16", "1:1", "16:9"], "hook-default", True)
    schema = "rubric_version string, job_id string"
    assert docs.read_request(spark, str(tmp_path / "none.json"), schema).count() == 0
    for value, n in (("{", 0), ({"job_id": "j"}, 0), ({"job_id": "j", "rubric_version": "v1"}, 1)):
        write(tmp_path, "r.json", value)
        assert docs.read_request(spark, str(tmp_path / "r.json"), schema).count() == n


def test_caches(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "clip_hash string, final_score double")
    at = str(tmp_path / "c")
    docs.cached_answers(spark, at, rows(("a", 0.1), ("b", 0.2)), ["clip_hash"], 0)
    got = docs.cached_answers(spark, at, rows(("b", 0.9), ("c", 0.3)), ["clip_hash"], 1)
    assert {tuple(r) for r in got.collect()} == {("a", 0.1), ("b", 0.9), ("c", 0.3)}


def test_digests_of_briefs(spark):
    some = [brief(), brief(theme='q "x" \\ / \t\u007f é 日本 \U0001f600  ', notes="n", anti_patterns=["ü"])]
    schema = docs.VIDEO_BRIEF
    df = spark.createDataFrame([tuple(b[f.name] for f in spark.createDataFrame([], schema).schema) for b in some], schema)
    got = [r.h for r in df.select(requests.context_hash({c: F.col(c) for c in requests.BRIEF}).alias("h")).collect()]
    assert got == [hashlib.sha1(json.dumps(b, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16] for b in some]


def test_requests_of_jobs(spark):
    jobs = spark.createDataFrame([("a", "/v"), ("b", "/w")], "job_id string, video_path string")
    briefs = spark.createDataFrame([("a", 2, "c2"), ("a", 1, "c1")], "job_id string, rank int, clip_id string")
    out = {r.job_id: json.loads(r.request) for r in requests.scoring_requests(jobs, briefs, "rate them", video_briefs=spark.createDataFrame([("b", "th")], "job_id string, theme string")).collect()}
    assert [c["clip_id"] for c in out["a"]["clips"]] == ["c1", "c2"] and out["a"]["video_brief"] is None and out["b"]["clips"] == [] and out["b"]["video_brief"]["theme"] == "th"
    empty = requests.brief_requests(jobs, spark.createDataFrame([], "job_id string, seg_idx int, speaker string, start_seconds double, end_seconds double, text string")).collect()
    assert [(r.transcript_excerpt, r.duration_seconds, r.speakers) for r in empty] == [("", 0.0, [])] * 2
    none = spark.createDataFrame([], "job_id string, clip_id string, clip_hash string, score double, error string")
    assert {r.error for r in requests.package_requests(jobs, none).collect()} == {"nothing to package"}


def test_schemas_come_from_types(spark):
    kind = spark.createDataFrame([], "titles array<string>, n int, s struct<x:double>").schema
    got = requests.json_schema(kind, {"titles": {"minItems": 5}, "titles[]": {"maxLength": 80}})
    assert got["required"] == ["titles", "n", "s"] and not got["additionalProperties"]
    assert got["properties"]["titles"] == {"type": "array", "items": {"type": "string", "maxLength": 80}, "minItems": 5}
    assert got["properties"]["n"] == {"type": "integer"} and got["properties"]["s"]["properties"]["x"] == {"type": "number"}


def test_voices(spark):
    assert voices.diarizer() == "speechbrain" and voices.diarizer(None, " PyAnnote ") == "pyannote" and voices.diarizer("off", "pyannote") == "off"
    with pytest.raises(voices.DiarizerError):
        voices.diarizer("best")
    raw = spark.createDataFrame([("a", "2", "3"), ("a", "x", "3"), ("a", "1.5", "1.5"), ("a", "0", "40"), ("a", None, "1")], "job_id string, start string, end string")
    spans = voices.speech_spans(raw)
    assert [(r.span_idx, r.start, r.end) for r in spans.orderBy("span_idx").collect()] == [(0, 0.0, 40.0), (1, 2.0, 3.0)]
    audio = spark.createDataFrame([("a", 40000)], "job_id string, n_samples long")
    assert [(r.first_sample, r.n_samples) for r in voices.embeddable(spans, audio).collect()] == [(0, 40000), (32000, 8000)]
    assert [r.n_samples for r in voices.embeddable(spans.filter("span_idx = 0"), audio, most=1.0).collect()] == [16000]
    words = spark.createDataFrame([("a", 0, 0, 0.0, 1.0, None), ("b", 0, 0, 0.0, 1.0, None), ("b", 0, 1, 1.0, 2.0, "X")], "job_id string, seg_idx int, word_idx int, start_seconds double, end_seconds double, speaker string")
    heard = spark.createDataFrame([("a", 0.0, 1.0, "S")], "job_id string, start double, end double, speaker string")
    said = lambda choice: {(r.job_id, r.word_idx): r.speaker for r in voices.spoken(words, heard, choice).collect()}
    assert said("speechbrain") == {("a", 0): "S", ("b", 0): "SPEAKER_00", ("b", 1): "X"} and said("off") == {("a", 0): "SPEAKER_00", ("b", 0): "SPEAKER_00", ("b", 1): "X"}


def test_settings_are_read_as_written(spark):
    rows = [("f", "B", "plain"), ("f", "A", ""), ("f", "C", "two words")]
    text = identity.settings_text(spark.createDataFrame(rows, "path string, key string, value string"), "path").first().text
    assert text == 'A=""\nB=plain\nC="two words"\n'
    back = identity.settings(spark.createDataFrame([(x,) for x in text.splitlines()], "value string"))
    assert {(r.key, r.value) for r in back.collect()} == {(k, v) for _, k, v in rows}


def test_manifests_are_checked(spark):
    clip = spark.createDataFrame([("j", "c", True, 0.0, 5.0, "TRACK", "top-clean")], "job_id string, clip_id string, approved boolean, start_seconds double, end_seconds double, mode string, caption_preset string")
    key = "job_id string, clip_id string, aspect_ratio string"
    outputs = spark.createDataFrame([("j", "c", "1:1", "a.mp4"), ("j", "c", "9:16", "b.mp4")], f"{key}, output string")
    crops = spark.createDataFrame([("j", "c", "1:1", ("1:1",)), ("j", "c", "9:16", ("9:16",))], f"{key}, plan struct<aspect_ratio:string>")
    lines = spark.createDataFrame([("j", "c", 1, ("b",)), ("j", "c", 0, ("a",))], "job_id string, clip_id string, line_idx int, line struct<text:string>")
    row = contracts.render_manifests(render.manifests(clip, outputs, crops, lines)).first()
    assert row.errors == [] and [x.text for x in row.caption_plan] == ["a", "b"] and row.outputs == {"1:1": "a.mp4", "9:16": "b.mp4"}
    errors = lambda c, o, p: contracts.render_manifests(render.manifests(c, o, p, lines)).first().errors
    assert errors(clip, outputs.limit(1), crops) == ["outputs and crop plans cover other ratios"]
    swapped = crops.withColumn("plan", F.struct(F.lit("1:1").alias("aspect_ratio")))
    assert errors(clip, outputs, swapped) == ["a crop plan has another ratio than its key"]
    assert errors(clip.withColumn("end_seconds", F.lit(0.0)).withColumn("mode", F.lit("X")), outputs, crops) == ["ends before it starts", "unknown mode"]


def test_steps_of_a_workspace(spark, tmp_path):
    place = workspaces.Workspace(spark, str(tmp_path))
    put = lambda *names: [write(tmp_path, requests.ARTIFACTS[n], {"candidates": []}) for n in names]
    with pytest.raises(workspaces.WorkspaceError):
        workspaces.advance(place, {})
    put("resume")
    ran = []

    def step(name, *makes):
        def run(workspace):
            ran.append(name)
            put(*makes)
            if name == "approve":
                write(tmp_path, requests.ARTIFACTS["review"], {"candidates": [{"approved": True}]})

        return run

    steps = {"mine": step("mine", "scoring_request", "brief_request"), "review": step("review", "review"), "approve": step("approve"), "render": step("render", "render_report"), "package-prompt": step("package-prompt", "package_request"), "package-save": step("package-save", "package_report")}
    assert workspaces.advance(place, steps)["next_action"] == "brief-handoff" and ran == ["mine"]
    put("brief_response")
    assert workspaces.advance(place, steps)["next_action"] == "scoring-handoff"
    put("scoring_response")
    assert workspaces.advance(place, steps)["state"] == "package_prompt" and ran == ["mine", "review", "approve", "render"]
    assert workspaces.advance(place, steps, package=True)["next_action"] == "packaging-handoff"
    with pytest.raises(workspaces.WorkspaceError):
        workspaces.finalized(place, steps)
    put("package_response")
    assert workspaces.finalized(place, steps)["state"] == "done" and ran[-2:] == ["package-prompt", "package-save"]
    with pytest.raises(workspaces.WorkspaceError, match="changed nothing"):
        (tmp_path / requests.ARTIFACTS["package_report"]).unlink()
        workspaces.advance(place, steps | {"package-save": lambda w: None}, package=True)


def run(spark, capsys, *argv):
    from momentquery.__main__ import main

    code = main([str(a) for a in argv], spark)
    out = capsys.readouterr()
    return code, json.loads(out.out or out.err.strip().splitlines()[-1])


def test_settings_commands(spark, tmp_path, capsys, monkeypatch):
    config = tmp_path / "settings"
    assert run(spark, capsys, "config-write", "--config", config, "ratios=1:1", "note=two words") == (0, {"config": str(config), "keys": ["note", "ratios"]})
    assert config.read_text() == 'note="two words"\nratios=1:1\n'
    assert run(spark, capsys, "config-write", "--config", config, "approve_top=2")[0] == 0
    monkeypatch.setenv("MOMENTQUERY_MIN_SCORE", "0.5")
    got = run(spark, capsys, "config-check", "--config", config)[1]
    assert got["resolved"] == {"ratios": ["1:1"], "max_candidates": 12, "approve_top": 2, "min_score": 0.5} and got["settings"]["note"] == "two words"
    for bad in ("ratios=2:1", "max_candidates=0", "min_score=2"):
        assert run(spark, capsys, "config-write", "--config", config, bad)[0] == 1


def test_workspace_commands(spark, tmp_path, capsys):
    assert run(spark, capsys, "latest-workspace", "--root", tmp_path)[0] == 1
    work = tmp_path / "jobs" / "j"
    work.mkdir(parents=True)
    assert run(spark, capsys, "latest-workspace", "--root", tmp_path) == (0, {"workspace": str(work)})
    write(work, requests.ARTIFACTS["render_report"], {"clips": [{"clip_id": "c", "outputs": {"1:1": "renders/c/a.mp4", "9:16": "/x/b.mp4"}}]})
    got = run(spark, capsys, "outputs", "--workspace", work)[1]
    assert [o["path"] for o in got["outputs"]] == [f"{work}/renders/c/a.mp4", "/x/b.mp4"]
    pack = {"clip_id": "c", "clip_hash": "h", "titles": [f"t{i}" for i in range(5)], "thumbnail_texts": ["a", "b", "c"], "social_caption": "s", "hashtags": [f"#t{i}" for i in range(5)], "hooks": ["x", "y"]}
    save = ("package-save", "--workspace", work, "--job", "j", "--version", "v1")
    assert run(spark, capsys, *save)[0] == 1
    write(work, requests.ARTIFACTS["package_request"], {"job_id": "j", "video_path": "/v", "clips": [{"clip_id": "c", "clip_hash": "h"}]})
    write(work, requests.ARTIFACTS["package_response"], {"prompt_version": "v1", "job_id": "j", "packs": [pack | {"clip_hash": "other"}]})
    assert run(spark, capsys, *save)[0] == 1
    write(work, requests.ARTIFACTS["package_response"], {"prompt_version": "v1", "job_id": "j", "packs": [pack]})
    assert run(spark, capsys, "state", "--workspace", work)[1]["state"] == "package_save"
    assert run(spark, capsys, *save) == (0, {"workspace": str(work), "packs": 1})
    assert json.loads((work / "renders/c/package.json").read_text()) == pack
    assert json.loads((work / requests.ARTIFACTS["package_report"]).read_text()) == {"job_id": "j", "video_path": "/v", "packs": [{"clip_id": "c", "pack_path": "renders/c/package.json"}]}
    assert run(spark, capsys, "state", "--workspace", work)[1]["state"] == "done"
    assert run(spark, capsys, "finalize", *save[1:])[1]["next_action"] == "done"


def test_jobs_are_prepared(spark, tmp_path, capsys):
    assert run(spark, capsys, "preflight")[1]["ready"]
    code, got = run(spark, capsys, "prepare", "--source", "https://cdn.discordapp.com/a.mp4", "--output-dir", tmp_path, "--ratios", "1:1, 9:16", "--max-candidates", "4")
    assert code == 0 and got["route"] == "direct" and got["ratios"] == ["1:1", "9:16"]
    row = docs.read_job(spark, got["job_path"]).first()
    assert (row.video_path, row.output_dir, row.ratios, row.max_candidates) == ("https://cdn.discordapp.com/a.mp4", str(tmp_path), ["1:1", "9:16"], 4)
    assert run(spark, capsys, "prepare", "--source", "a", "--output-dir", tmp_path, "--max-candidates", "0")[0] == 1


def test_a_job_from_transcript_to_packs(spark, tmp_path, capsys):
    write(tmp_path, "job.json", {"video_path": str(tmp_path / "v.mp4"), "output_dir": str(tmp_path / "out"), "max_candidates": 3, "output_profile": {"ratios": ["9:16", "1:1"]}})
    (tmp_path / "v.mp4").write_bytes(b"video")
    step = ("run", "--job", tmp_path / "job.json", "--package")
    assert run(spark, capsys, *step)[0] == 1  # nothing was transcribed
    work = next((tmp_path / "out" / "jobs").iterdir())
    line = "here is why nobody tells you the secret about 5 numbers ?"
    word = lambda i, k, w: {"text": w, "start_seconds": 6.0 * i + k * 0.4, "end_seconds": 6.0 * i + k * 0.4 + 0.3, "confidence": 0.9}
    segments = [{"speaker": f"S{i % 2}", "start_seconds": 6.0 * i, "end_seconds": 6.0 * i + 6, "text": line, "words": [word(i, k, w) for k, w in enumerate(line.split())]} for i in range(14)]
    write(work, "transcript.json", {"segments": segments, "model": "m", "source_fingerprint": work.name})
    face = {"center_x": 0.4, "center_y": 0.5, "width": 0.1, "height": 0.1, "confidence": 0.9}
    write(work, "vision.json", {"frames": [{"timestamp_seconds": k / 2, "motion_score": 0.5, "shot_change": k % 20 == 0, "primary_face": face if k % 3 else None} for k in range(160)]})
    write(work, "probe.json", {"duration_seconds": 84.0, "width": 1920, "height": 1080, "fps": 30.0, "audio_sample_rate": 48000})
    read = lambda name: json.loads((work / requests.ARTIFACTS.get(name, name)).read_text())
    assert run(spark, capsys, *step)[1]["next_action"] == "brief-handoff"
    asked = read("scoring_request")
    assert 1 <= len(asked["clips"]) <= 3 and {"transcript", "mining_signals", "visual_summary", "clip_hash", "duration_seconds", "mining_score", "speakers"} <= set(asked["clips"][0])
    assert asked["clips"][0]["visual_summary"]["frame_count"] > 0 and asked["response_schema"]["required"] == ["rubric_version", "job_id", "scores"]
    assert read("brief_request")["speakers"] == ["S0", "S1"] and read("brief_request")["duration_seconds"] == 84.0
    write(work, docs.BRIEFS.file, {"rubric_version": "v1", "job_id": work.name, "brief": brief(job_id=work.name, theme="Zahlen – 日本")})
    assert run(spark, capsys, *step)[1]["next_action"] == "scoring-handoff"
    again = read("scoring_request")
    assert again["video_brief"]["theme"] == "Zahlen – 日本" and all(a["clip_hash"] != b["clip_hash"] for a, b in zip(asked["clips"], again["clips"]))
    digest = hashlib.sha1(json.dumps(again["video_brief"], sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:16]
    first = again["clips"][0]
    key = f"v1|{first['start_seconds']:.3f}|{first['end_seconds']:.3f}|{first['transcript'].strip()}|context:{digest}"
    assert first["clip_hash"] == hashlib.sha1(key.encode()).hexdigest()[:16]
    scores = [score(0, clip_id=c["clip_id"], clip_hash=c["clip_hash"], final_score=0.9 - 0.1 * i, title=f"T{i}") for i, c in enumerate(again["clips"])]
    write(work, docs.SCORES.file, {"rubric_version": "v1", "job_id": work.name, "scores": scores[:-1]})
    if len(scores) > 1:
        assert run(spark, capsys, *step)[0] == 1  # one clip has no score
    write(work, docs.SCORES.file, {"rubric_version": "v1", "job_id": work.name, "scores": scores})
    assert run(spark, capsys, *step, "--top", "1")[1]["next_action"] == "packaging-handoff"
    review = read("review")["candidates"]
    assert [c["approved"] for c in review] == [True] + [False] * (len(scores) - 1) and review[0]["title"] == "T0" and review[0]["score"] == 0.9
    clip = review[0]["clip_id"]
    manifest = read(f"renders/{clip}/render-manifest.json")
    assert set(manifest["crop_plans"]) == set(manifest["outputs"]) == {"9:16", "1:1"} and manifest["caption_plan"] and manifest["mode"] == "TRACK"
    assert read("render_report")["clips"] == [{"clip_id": clip, "outputs": {r: f"renders/{clip}/{clip}-{r.replace(':', 'x')}.mp4" for r in ("1:1", "9:16")}}]
    wanted = read("package_request")["clips"]
    pack = {"clip_id": clip, "clip_hash": wanted[0]["clip_hash"], "titles": [f"t{i}" for i in range(5)], "thumbnail_texts": ["a", "b", "c"], "social_caption": "s", "hashtags": [f"#t{i}" for i in range(5)], "hooks": ["x", "y"]}
    write(work, docs.PACKS.file, {"prompt_version": "v1", "job_id": work.name, "packs": [pack]})
    assert run(spark, capsys, "package-save", "--workspace", work, "--job", work.name, "--version", "v1")[1]["packs"] == 1
    assert run(spark, capsys, *step)[1]["next_action"] == "done"
