"""Workspaces of jobs: what they resume from, and which step comes next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .handoff import HandoffError
from .requests import ARTIFACTS

#: What is done in each state; a name in HANDOFFS waits for an outside model.
STEPS = {"mine": "mine", "review": "review", "approve": "approve", "render": "render", "package_prompt": "package-prompt", "package_save": "package-save"}
HANDOFFS = {"brief_handoff": "brief", "score_handoff": "scoring", "package_handoff": "packaging"}


class WorkspaceError(HandoffError):
    """A workspace that cannot go on."""


def workspace_of(output_dir: Column, job_id: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(output_dir, "/+$", ""), F.lit("jobs"), job_id)


def resumed(workspaces: DataFrame, sidecars: DataFrame, jobs: DataFrame) -> DataFrame:
    """workspaces(workspace) with job_path: the sidecar's, sidecars(workspace, job_path), if that job is there, else
    the first job whose own workspace it is, jobs(job_path, output_dir, job_id); else error is set."""
    there = jobs.select(F.col("job_path").alias("_there")).distinct()
    kept = sidecars.join(there, F.col("job_path") == F.col("_there")).groupBy("workspace").agg(F.min("job_path").alias("_kept"))
    derived = jobs.groupBy(workspace_of(F.col("output_dir"), F.col("job_id")).alias("workspace")).agg(F.min("job_path").alias("_derived"))
    found = workspaces.join(kept, "workspace", "left").join(derived, "workspace", "left")
    path = F.coalesce("_kept", "_derived")
    return found.withColumns({"job_path": path, "error": F.when(path.isNull(), "no job for the workspace")}).drop("_kept", "_derived")


def ratios(workspaces: DataFrame, sidecars: DataFrame, jobs: DataFrame) -> DataFrame:
    """workspaces with the ratios of the job that their sidecar names, none where either is not there. jobs(job_path,
    ratios)."""
    named = sidecars.groupBy("workspace").agg(F.min("job_path").alias("_path"))
    known = jobs.groupBy(F.col("job_path").alias("_path")).agg(F.first("ratios", ignorenulls=True).alias("ratios"))
    found = workspaces.join(named, "workspace", "left").join(known, "_path", "left").drop("_path")
    return found.withColumn("ratios", F.coalesce("ratios", F.array().cast("array<string>")))


def next_step(state: Column, package: Column) -> Column:
    """What is done in a state: the name of a step or of a handoff, or done. Without packaging, rendered is done."""
    out = F.when((state == "package_prompt") & ~package, "done").when(state == "done", "done")
    for name, step in {**STEPS, **{k: f"{v}-handoff" for k, v in HANDOFFS.items()}}.items():
        out = out.when(state == name, step)
    return out.otherwise(F.lit("prepare"))


@dataclass
class Workspace:
    """One folder of a job's documents, on any file system that Spark reaches."""

    spark: SparkSession
    path: str

    def has(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{ARTIFACTS[name]}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def state(self) -> str:
        """The next step, by the documents that are there: the furthest one counts."""
        from .handoff import existing_state

        flags = {name: F.lit(self.has(name)) for name in ARTIFACTS if name not in ("resume", "brief_cache")}
        flags["job"] = F.lit(self.has("resume"))
        flags["approved"] = F.lit(self.has("review") and self.approved())
        return self.spark.range(1).select(existing_state(flags)).first()[0]

    def approved(self) -> bool:
        from ..sources.files import read_document

        review = read_document(self.spark, f"{self.path}/{ARTIFACTS['review']}", "candidates array<struct<approved:boolean>>")
        return bool(review.filter(F.exists("candidates", lambda c: c["approved"])).take(1))


def advance(workspace: Workspace, steps: dict[str, Callable[[Workspace], None]], package: bool = False) -> dict:
    """Runs steps, by the names in STEPS, as far as they go: to a handoff, or to the end. A step that leaves the
    workspace in the state in which it found it is an error."""
    state = workspace.state()
    while True:
        if state == "done" or (state == "package_prompt" and not package):
            return {"next_action": "done", "state": state, "workspace": workspace.path}
        if state in HANDOFFS:
            return {"next_action": f"{HANDOFFS[state]}-handoff", "state": state, "workspace": workspace.path}
        if state not in STEPS or STEPS[state] not in steps:
            raise WorkspaceError(f"nothing leads on from {state}")
        steps[STEPS[state]](workspace)
        after = workspace.state()
        if after == state:
            raise WorkspaceError(f"{STEPS[state]} changed nothing")
        state = after


def finalized(workspace: Workspace, steps: dict[str, Callable[[Workspace], None]]) -> dict:
    """Saves packs whose response is there; any state but the last one is an error after that."""
    if workspace.state() == "package_save":
        steps["package-save"](workspace)
    state = workspace.state()
    if state != "done":
        raise WorkspaceError(f"packs are not saved; the next step is {state}")
    return {"next_action": "done", "state": state, "workspace": workspace.path}
