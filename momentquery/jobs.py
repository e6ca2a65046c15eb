"""Stages of one job over the documents of its workspace: mine, brief, review, approve, render.

What outside models say of the video stands in the workspace as transcript.json, vision.json and probe.json; their
answers are read as documents.py says. Everything between is a plan over DataFrames; what is collected are the documents
of one job, whose size is that of its chosen clips.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import contracts
from .api import Engine, RenderStageError
from .config import RATIOS
from .operators import camera, handoff, identity, render, requests, selection, signals, windows, workspaces
from .sources import documents, files

VERSION = "v1"
SCORING_PROMPT = "Score each clip by the rubric, from 0 to 1 in each of its parts, and give a title and a hook. Answer in the form of response_schema."
BRIEF_PROMPT = "Say what the video is about, what form it has, and which patterns of it clips should look for. Answer in the form of response_schema."


def response_schema(kind: documents.Kind, limits: dict | None = None) -> dict:
    """The JSON schema of an answer, from the type that it is read as."""
    return requests.json_schema(T.StructType.fromDDL(kind.schema), limits)


@dataclass
class Job:
    """A job document, its workspace, and its stages."""

    spark: SparkSession
    path: str
    top: int = 3
    threshold: float = 0.0

    def __post_init__(self) -> None:
        self.row = documents.read_job(self.spark, self.path).first()
        self.job_id = self._fingerprint()
        self.workspace = workspaces.Workspace(self.spark, f"{self.row.output_dir.rstrip('/')}/jobs/{self.job_id}")

    def _fingerprint(self) -> str:
        """Of path, version, and size and time where the video can be seen."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.row.video_path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        size = mtime = None
        if system.exists(at):
            status = system.getFileStatus(at)
            size, mtime = status.getLen(), status.getModificationTime() * 1_000_000
        seen = self.spark.createDataFrame([(self.row.video_path, size, mtime)], "path string, size long, mtime long")
        return seen.select(identity.job_fingerprint(F.col("path"), VERSION, F.col("size"), F.col("mtime"))).first()[0]

    def _at(self, name: str) -> str:
        return f"{self.workspace.path}/{requests.ARTIFACTS.get(name, name)}"

    def _write(self, name: str, document: dict) -> None:
        files.write_text(self.spark, self._at(name), json.dumps(document, indent=2, ensure_ascii=False))

    def _jobs(self) -> DataFrame:
        return self.spark.createDataFrame([(self.job_id, self.row.video_path, self.workspace.path)], "job_id string, video_path string, workspace string")

    def start(self) -> str:
        """Makes the workspace, with what it resumes from; the job's id."""
        self._write("resume", {"job_path": self.path, "ratios": list(self.row.ratios), "max_candidates": self.row.max_candidates, "approve_top": self.top, "min_score": self.threshold})
        return self.job_id

    def _tables(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """segments, words, frames."""
        named = lambda df: df.withColumn("job_id", F.lit(self.job_id))
        said = files.segments(named(files.read_document(self.spark, self._at("transcript.json"), files.TRANSCRIPT, strict=True)))
        seen = files.frames(named(files.read_document(self.spark, self._at("vision.json"), files.FRAMES, strict=True)))
        face = F.col("primary_face")
        frames = seen.select("job_id", "frame_idx", "timestamp_seconds", "motion_score", "shot_change", face["center_x"].alias("face_x"), face["center_y"].alias("face_y"))
        return said.drop("words"), files.words(said), frames

    def _briefs(self) -> DataFrame:
        engine = Engine(self.spark)
        config = replace(engine.config, most_clips=self.row.max_candidates)
        segments, words, frames = self._tables()
        told = windows.enumerated(signals.prepared(segments, words), config.durations)
        plain, bounds = windows.enumerated(segments, config.durations), windows.enumerated(segments.drop("text", "speaker"), config.durations)
        scored = signals.scored(told, frames, engine.lexicon, config, bounds)
        chosen = selection.selected(scored, windows.interview_blocks(segments, config), config)
        rows = bounds.drop("members").join(chosen.select("job_id", "start_idx", "end_idx"), ["job_id", "start_idx", "end_idx"])
        seen = signals.visual_summary(signals.visual(rows.withColumn("row_id", F.struct("job_id", "start_idx", "end_idx")), frames))
        return requests.full_briefs(chosen, scored, plain, seen).drop("start_idx", "end_idx", "score")

    def mine(self, workspace: workspaces.Workspace | None = None) -> None:
        """Writes the scoring request and, if the job wants one, the request for a video brief."""
        row = requests.scoring_requests(self._jobs(), self._briefs(), SCORING_PROMPT, VERSION).first()
        self._write("scoring_request", json.loads(row.request) | {"response_schema": response_schema(documents.SCORES)})
        if self.row.video_brief:
            asked = requests.brief_requests(self._jobs().drop("workspace"), self._tables()[0], VERSION)
            self._write("brief_request", json.loads(asked.toJSON().first()) | {"brief_prompt": BRIEF_PROMPT, "response_schema": response_schema(documents.BRIEFS)})

    def _asked(self) -> dict:
        """The scoring request as it stands."""
        if not self.workspace.has("scoring_request"):
            raise handoff.ScoringError("there is no scoring request; mine first")
        return json.loads(self.spark.read.text(self._at("scoring_request"), wholetext=True).first()[0])

    def brief(self, workspace: workspaces.Workspace | None = None) -> None:
        """Puts the video brief, from the answer or the last one that was answered, into the scoring request, and its
        digest into the clips' hashes."""
        found = documents.matching(documents.read_answer(self.spark, self.workspace.path, documents.BRIEFS), documents.BRIEFS, VERSION, self.job_id).first()
        known = found.asDict() if found else self._cached_brief()
        if known is None:
            raise documents.BriefError("neither an answer nor a cached brief is there")
        brief = {f.name: known[f.name] for f in T.StructType.fromDDL(documents.VIDEO_BRIEF)}
        brief["rubric_version"], brief["job_id"] = VERSION, self.job_id
        self._write("brief_cache", brief)
        asked = self._asked()
        one = self.spark.createDataFrame([tuple(brief.values())], documents.VIDEO_BRIEF)
        contexts = one.select("job_id", requests.context_hash({c: F.col(c) for c in requests.BRIEF}).alias("context_hash"))
        clips = [(self.job_id, c["clip_id"], c["clip_hash"], c["start_seconds"], c["end_seconds"], c["transcript"]) for c in asked["clips"]]
        rows = self.spark.createDataFrame(clips, "job_id string, clip_id string, clip_hash string, start_seconds double, end_seconds double, transcript string")
        hashes = {r.clip_id: r.clip_hash for r in requests.rehashed(rows, contexts, VERSION).collect()}
        self._write("scoring_request", asked | {"clips": [c | {"clip_hash": hashes[c["clip_id"]]} for c in asked["clips"]], "video_brief": brief})

    def _cached_brief(self) -> dict | None:
        row = documents.read_request(self.spark, self._at("brief_cache"), documents.VIDEO_BRIEF).first()
        return row.asDict() if row and (row.rubric_version, row.job_id) == (VERSION, self.job_id) else None

    def review(self, workspace: workspaces.Workspace | None = None) -> None:
        """Writes the review manifest: candidates by score, with the model's score, title and hook."""
        asked = self._asked()
        fields = "job_id string, clip_id string, clip_hash string, rank int, start_seconds double, end_seconds double, score double, reasons array<string>, spike_categories array<string>"
        clips = [(self.job_id, c["clip_id"], c["clip_hash"], i, c["start_seconds"], c["end_seconds"], c["mining_score"], c["mining_signals"]["reasons"], c["mining_signals"]["spike_categories"]) for i, c in enumerate(asked["clips"])]
        briefs = self.spark.createDataFrame(clips, fields)
        scores = documents.matching(documents.read_answer(self.spark, self.workspace.path, documents.SCORES), documents.SCORES, VERSION, self.job_id)
        cache = f"{self.workspace.path}/scoring-cache"
        versions = [int(p.rpartition("=")[2]) for p in (r.path for r in files.listed(self.spark, cache, ("version=*",)).collect())]
        last = max(versions, default=0)
        known = documents.cached_answers(self.spark, cache, scores.drop("version", "ord"), ["clip_hash"], last)
        resolved = handoff.checked(handoff.resolved_scores(briefs.select("job_id", "clip_id", "clip_hash", "rank"), scores, known), handoff.ScoringError)
        if resolved.filter("not complete").take(1):
            raise handoff.ScoringError("not every clip has a score")
        told = scores.select("job_id", "clip_id", "clip_hash", "final_score", "title", "hook").unionByName(
            known.join(scores.select("clip_hash"), "clip_hash", "left_anti").select("job_id", "clip_hash", "final_score", "title", "hook").join(briefs.select("clip_hash", "clip_id"), "clip_hash").select("job_id", "clip_id", "clip_hash", "final_score", "title", "hook")
        )
        candidates = briefs.withColumns({"title": F.lit(""), "hook": F.lit("")}).drop("rank")
        reviewed = handoff.review(candidates, handoff.in_given_order(told)).drop("job_id", "clip_hash").withColumn("approved", F.lit(False))
        self._write("review", {"job_id": self.job_id, "video_path": self.row.video_path, "candidates": [json.loads(x) for x in reviewed.orderBy("rank").drop("rank").toJSON().collect()]})

    def _review(self) -> dict:
        if not self.workspace.has("review"):
            raise ValueError("there is no review manifest; review first")
        return json.loads(self.spark.read.text(self._at("review"), wholetext=True).first()[0])

    def approve(self, workspace: workspaces.Workspace | None = None) -> None:
        """Marks the best candidates of the review manifest."""
        review = self._review()
        rows = self.spark.createDataFrame([(self.job_id, c["clip_id"], float(c["score"])) for c in review["candidates"]], "job_id string, clip_id string, score double")
        chosen = {r.clip_id for r in handoff.approved(rows, self.top, self.threshold).filter("approved").collect()}
        self._write("review", review | {"candidates": [c | {"approved": c["clip_id"] in chosen} for c in review["candidates"]]})

    def render(self, workspace: workspaces.Workspace | None = None) -> None:
        """Writes a render manifest for each approved clip, and the report of their outputs. Nothing is encoded here."""
        review = self._review()
        approved = [(self.job_id, c["clip_id"], float(c["start_seconds"]), float(c["end_seconds"]), True) for c in review["candidates"] if c["approved"]]
        if not approved:
            raise RenderStageError("no clip is approved")
        clips = self.spark.createDataFrame(approved, "job_id string, clip_id string, start_seconds double, end_seconds double, approved boolean")
        segments, words, frames = self._tables()
        probe = files.probe(files.read_document(self.spark, self._at("probe.json"), files.PROBE, strict=True))
        sources = probe.select(F.lit(self.job_id).alias("job_id"), F.col("width").alias("source_width"), F.col("height").alias("source_height"))
        plan = Engine(self.spark).render(clips, segments, frames, words, sources, self.row.caption_preset)
        ratios = {r: RATIOS[r] for r in self.row.ratios}
        key = ["job_id", "clip_id"]
        anchors = plan["anchors"].groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("anchor_idx", F.struct(F.col("t").alias("timestamp_seconds"), F.col("x").alias("center_x"), F.col("y").alias("center_y")).alias("a")))).alias("a"))
        sized = camera.targets(clips.select(*key).join(sources, "job_id"), ratios).join(anchors, key)
        crops = sized.select(*key, "aspect_ratio", F.struct("aspect_ratio", "source_width", "source_height", "target_width", "target_height", F.transform("a", lambda x: x["a"]).alias("anchors")).alias("plan"))
        outputs = sized.select(*key, "aspect_ratio", render.output_path(F.lit(self.workspace.path), F.col("clip_id"), F.col("aspect_ratio")).alias("output"))
        word = lambda w: F.struct(w["text"].alias("text"), w["start_seconds"].alias("start_seconds"), w["end_seconds"].alias("end_seconds"), w["emphasis"].alias("emphasis"))
        lines = plan["captions"].select(*key, "line_idx", F.struct("start_seconds", "end_seconds", "text", F.transform("words", word).alias("words")).alias("line"))
        base = clips.join(plan["modes"].select(*key, "mode"), key).withColumns({"source_video": F.lit(self.row.video_path), "caption_preset": F.lit(self.row.caption_preset)})
        manifests = contracts.strict(contracts.render_manifests(render.manifests(base, outputs, crops, lines))).drop("errors", "job_id")
        report = []
        for text in manifests.orderBy("clip_id").toJSON().collect():  # a job's approved clips
            manifest = json.loads(text)
            report.append({"clip_id": manifest["clip_id"], "outputs": {r: p.removeprefix(f"{self.workspace.path}/") for r, p in sorted(manifest["outputs"].items())}})
            self._write(f"renders/{manifest['clip_id']}/render-manifest.json", manifest)
        self._write("render_report", {"job_id": self.job_id, "clips": report})

    def package_prompt(self, workspace: workspaces.Workspace | None = None) -> None:
        """Writes the request for packs of the approved clips."""
        briefs = {c["clip_id"]: c for c in self._asked()["clips"]}
        approved = [c for c in self._review()["candidates"] if c["approved"]]
        if not approved:
            raise handoff.PackagingError("nothing to package")
        missing = [c["clip_id"] for c in approved if c["clip_id"] not in briefs]
        if missing:
            raise handoff.PackagingError(f"no brief for an approved clip: {missing[0]}")
        clips = [{"clip_id": c["clip_id"], "clip_hash": briefs[c["clip_id"]]["clip_hash"], "transcript": briefs[c["clip_id"]]["transcript"], "title_hint": c["title"], "hook_hint": c["hook"], "final_score": c["score"]} for c in approved]
        self._write("package_request", {"prompt_version": VERSION, "job_id": self.job_id, "video_path": self.row.video_path, "clips": clips, "response_schema": response_schema(documents.PACKS)})

    def run(self, stage: str, package: bool = False) -> dict:
        """One stage, or auto: as far as the workspace's documents go."""
        if stage == "auto":
            steps = {"mine": self.mine, "review": self.review, "approve": self.approve, "render": self.render, "package-prompt": self.package_prompt}
            if self.workspace.state() == "score_handoff" and self.workspace.has("brief_response"):
                self.brief()
            return workspaces.advance(self.workspace, steps, package)
        {"mine": self.mine, "brief": self.brief, "review": self.review, "approve": self.approve, "render": self.render}[stage]()
        return {"stage": stage, "state": self.workspace.state(), "workspace": self.workspace.path}
