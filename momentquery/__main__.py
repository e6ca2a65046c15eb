"""Command line: each command reads tables or documents, writes tables, and prints one JSON object.

    python -m momentquery version
    python -m momentquery mine --segments P --frames P --words P --out P
    python -m momentquery approve --review P --top 3 --min-score 0.75 --out P
    python -m momentquery feedback --review P --kept a,b --skipped c --history P --job J
    python -m momentquery history --history P [--summary] [--patterns] [--limit N]
    python -m momentquery run --job P --stage mine|brief|review|approve|render|auto [--package] [--top N] [--min-score X]
    python -m momentquery prepare --source P --output-dir P [--ratios R] [--max-candidates N]
    python -m momentquery package-prompt --job P
    python -m momentquery finalize --workspace P --job J --version V
    python -m momentquery preflight
    python -m momentquery config-write --config P KEY=VALUE ...
    python -m momentquery config-check --config P
    python -m momentquery latest-workspace --root P
    python -m momentquery outputs --workspace P
    python -m momentquery state --workspace P
    python -m momentquery package-save --workspace P --job J --version V
    python -m momentquery query NAME --data FOLDER [--out P]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

VERSION = "0.1.0"
#: Settings with what counts where neither a file nor the environment says anything.
DEFAULTS = {"ratios": "all", "max_candidates": "12", "approve_top": "5", "min_score": "0.0"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="momentquery")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    mine = sub.add_parser("mine")
    for name in ("segments", "frames", "words", "out"):
        mine.add_argument(f"--{name}", required=True)
    approve = sub.add_parser("approve")
    approve.add_argument("--review", required=True)
    approve.add_argument("--out", required=True)
    approve.add_argument("--top", type=int, default=3)
    approve.add_argument("--min-score", type=float, default=0.0)
    feedback = sub.add_parser("feedback")
    for name in ("review", "history", "job"):
        feedback.add_argument(f"--{name}", required=True)
    feedback.add_argument("--kept", default="")
    feedback.add_argument("--skipped", default="")
    feedback.add_argument("--log")
    history = sub.add_parser("history")
    history.add_argument("--history", required=True)
    history.add_argument("--summary", action="store_true")
    history.add_argument("--patterns", action="store_true")
    history.add_argument("--limit", type=int, default=20)
    job = sub.add_parser("run")
    job.add_argument("--job", required=True)
    job.add_argument("--stage", default="auto", choices=("mine", "brief", "review", "approve", "render", "auto"))
    job.add_argument("--package", action="store_true")
    job.add_argument("--top", type=int, default=3)
    job.add_argument("--min-score", type=float, default=0.0)
    write = sub.add_parser("config-write")
    write.add_argument("--config", required=True)
    write.add_argument("settings", nargs="+")
    sub.add_parser("config-check").add_argument("--config", required=True)
    sub.add_parser("latest-workspace").add_argument("--root", required=True)
    sub.add_parser("preflight")
    prepare = sub.add_parser("prepare")
    prepare.add_argument("--source", required=True)
    prepare.add_argument("--output-dir", required=True)
    prepare.add_argument("--ratios", default=DEFAULTS["ratios"])
    prepare.add_argument("--max-candidates", default=DEFAULTS["max_candidates"])
    sub.add_parser("package-prompt").add_argument("--job", required=True)
    for name in ("outputs", "state", "package-save", "finalize"):
        command = sub.add_parser(name)
        command.add_argument("--workspace", required=True)
        if name in ("package-save", "finalize"):
            command.add_argument("--job", required=True)
            command.add_argument("--version", required=True)
    query = sub.add_parser("query")
    query.add_argument("name")
    query.add_argument("--data", required=True)
    query.add_argument("--out")
    return p


def _rows(df) -> list[dict]:
    """Small results: reports, patterns, and as many rows as were asked for."""
    return [json.loads(x) for x in df.toJSON().collect()]


def _now(spark: SparkSession) -> str:
    """UTC, to the second."""
    return spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")).first()[0]


def _preflight(spark: SparkSession) -> dict:
    """Whether what queries need is there: modules, and on a cluster a folder that all executors share."""
    import importlib.util

    missing = [m for m in ("numpy", "pandas", "pyarrow") if importlib.util.find_spec(m) is None]
    if not spark.sparkContext.master.startswith("local") and not spark.conf.get("spark.checkpoint.dir", None):
        missing.append("spark.checkpoint.dir")
    return {"ready": not missing, "missing": missing, "defaults": _checked(DEFAULTS, spark)}


def _prepared(args: argparse.Namespace, spark: SparkSession) -> dict:
    """Writes a job document for a source; a link is told how to get it."""
    import hashlib

    from .operators import render
    from .sources import files

    got = _checked(DEFAULTS | {"ratios": args.ratios, "max_candidates": args.max_candidates}, spark)
    route = spark.createDataFrame([(args.source,)], "source string").select(render.route(F.col("source"))).first()[0]
    root = args.output_dir.rstrip("/")
    path = f"{root}/skill-jobs/{hashlib.sha1(args.source.encode()).hexdigest()[:12]}/job.json"
    job = {"video_path": args.source, "output_dir": root, "output_profile": {"ratios": got["ratios"]}, "max_candidates": got["max_candidates"]}
    files.write_text(spark, path, json.dumps(job, indent=2, ensure_ascii=False))
    return {"job_path": path, "route": route, **got}


def _settings(spark: SparkSession, path: str):
    from .operators import identity
    from .sources import files

    lines = spark.read.text(path) if files._exists(spark, path) else spark.createDataFrame([], "value string")
    return identity.settings(lines)


def _checked(values: dict[str, str], spark: SparkSession) -> dict:
    """Settings with their values as what they stand for; one that can't be is an error."""
    from .contracts import RATIOS
    from .operators import identity

    row = spark.createDataFrame([tuple(values[k] for k in DEFAULTS)], ", ".join(f"{k} string" for k in DEFAULTS))
    found, wrong = identity.chosen_ratios(F.col("ratios"), RATIOS)
    got = row.select(found.alias("ratios"), wrong.alias("wrong"), *[identity.positive_int(F.col(c)).alias(c) for c in ("max_candidates", "approve_top")], identity.share(F.col("min_score")).alias("min_score")).first().asDict()
    if got.pop("wrong") is not None:
        raise ValueError(f"unknown ratio in {values['ratios']!r}")
    for name, value in got.items():
        if value is None:
            raise ValueError(f"{name} can't be {values[name]!r}")
    return got


def _settings_command(args: argparse.Namespace, spark: SparkSession) -> dict:
    import os

    from .operators import identity, render
    from .sources import files

    none = spark.createDataFrame([], "key string, value string")
    defaults = spark.createDataFrame(list(DEFAULTS.items()), "key string, value string")
    old = _settings(spark, args.config)
    if args.command == "config-write":
        new = dict(x.partition("=")[::2] for x in args.settings)
        _checked(DEFAULTS | {k: v for k, v in new.items() if k in DEFAULTS}, spark)
        rows = spark.createDataFrame([(args.config, k, v) for k, v in new.items()], "path string, key string, value string")
        text = identity.settings_text(identity.updated_settings(old.withColumn("path", F.lit(args.config)), rows, "path"), "path").first().text
        files.write_text(spark, args.config, text)
        return {"config": args.config, "keys": sorted(new)}
    given = [(k, os.environ[f"MOMENTQUERY_{k.upper()}"]) for k in DEFAULTS if f"MOMENTQUERY_{k.upper()}" in os.environ]
    environment = spark.createDataFrame(given, "key string, value string") if given else none
    merged = {r.key: r.value for r in render.merged_settings(old, environment, defaults).collect()}
    return {"config": args.config, "settings": merged, "resolved": _checked(merged, spark)}


def _workspace_command(args: argparse.Namespace, spark: SparkSession) -> dict:
    from .operators import handoff, requests, workspaces
    from .sources import documents, files

    place = workspaces.Workspace(spark, args.workspace.rstrip("/"))
    if args.command == "state":
        return {"workspace": place.path, "state": place.state()}
    if args.command == "outputs":
        report = files.read_document(spark, f"{place.path}/{requests.ARTIFACTS['render_report']}", "clips array<struct<clip_id:string,outputs:map<string,string>>>", strict=True)
        each = report.select(F.explode("clips").alias("c")).select("c.clip_id", F.explode("c.outputs").alias("aspect_ratio", "path"))
        full = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.lit(f"{place.path}/"), "path"))
        return {"workspace": place.path, "outputs": _rows(each.withColumn("path", full).orderBy("clip_id", "aspect_ratio"))}
    asked = documents.read_request(spark, f"{place.path}/{requests.ARTIFACTS['package_request']}", "job_id string, video_path string, clips array<struct<clip_id:string,clip_hash:string>>")
    if not asked.take(1):
        raise handoff.PackagingError("there is no package request")
    packs = documents.matching(documents.read_answer(spark, place.path, documents.PACKS, required=True), documents.PACKS, args.version, args.job)
    wanted = asked.select("job_id", F.posexplode("clips").alias("ord", "c")).select("job_id", "ord", "c.*")
    resolved = handoff.resolved_packs(wanted, packs.withColumn("title", packs.titles[0]))
    handoff.checked(resolved.withColumn("error", F.when(F.col("status") != "ok", F.col("status"))), handoff.PackagingError)
    # One small document a clip: clips are what one job has chosen.
    paths = []
    for row in packs.drop("version", "ord", "job_id").toJSON().collect():
        pack = json.loads(row)
        paths.append((args.job, pack["clip_id"], f"{place.path}/renders/{pack['clip_id']}/package.json"))
        files.write_text(spark, paths[-1][2], json.dumps(pack, indent=2, ensure_ascii=False))
    jobs = asked.select("job_id", "video_path").withColumn("workspace", F.lit(place.path))
    report = requests.package_reports(jobs, spark.createDataFrame(paths, "job_id string, clip_id string, path string")).first().report
    files.write_text(spark, f"{place.path}/{requests.ARTIFACTS['package_report']}", json.dumps(json.loads(report), indent=2, ensure_ascii=False))
    return {"workspace": place.path, "packs": len(paths)}


def run(args: argparse.Namespace, spark: SparkSession) -> dict:
    from .api import Engine
    from .operators import handoff, profile
    from .registry import QUERIES
    from .sources import files

    if args.command == "mine":
        read = spark.read.parquet
        out = Engine(spark).mine(read(args.segments), read(args.frames), read(args.words))
        out.write.mode("overwrite").parquet(args.out)
        return {"out": args.out, "clips": spark.read.parquet(args.out).count()}
    if args.command == "approve":
        out = handoff.approved(spark.read.parquet(args.review), args.top, args.min_score)
        out.write.mode("overwrite").parquet(args.out)
        done = spark.read.parquet(args.out).filter("approved")
        return {"approved_count": done.count(), "threshold_met_count": done.filter(F.col("score") >= args.min_score).count()}
    if args.command == "feedback":
        one = lambda text: spark.createDataFrame([(x.strip(),) for x in text.split(",") if x.strip()], "clip_id string")
        none = spark.createDataFrame([], "clip_id string, posted boolean, notes string")
        given = handoff.merged_feedback(none, one(args.kept), one(args.skipped), none)
        rows = handoff.feedback_rows(given, spark.read.parquet(args.review))
        unknown = [r.clip_id for r in rows.filter("status = 'unknown'").select("clip_id").orderBy("clip_id").limit(20).collect()]
        if unknown:
            raise handoff.HandoffError(f"unknown clips: {', '.join(unknown)}")
        entries = rows.select(
            F.lit(args.job).alias("job_id"), "clip_id", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("recorded_at"), "duration_seconds", "score",
            F.array().cast("array<string>").alias("spike_categories"), F.array().cast("array<string>").alias("ratios"), "title", "posted", "notes",
        )
        recorded = files.append_history(entries, args.history)
        if args.log:  # what was said of this job's clips last
            said = rows.select("clip_id", "posted", "notes").orderBy("clip_id")
            document = {"job_id": args.job, "recorded_at": _now(spark), "entries": _rows(said)}
            files.write_text(spark, args.log, json.dumps(document, indent=2, ensure_ascii=False))
        return {"recorded": recorded}
    if args.command == "history":
        log = files.read_history(spark, args.history)
        last = profile.latest(log)
        out = {"entries": _rows(profile.recent(log, args.limit))}
        if args.summary:
            out["summary"] = _rows(profile.summary(last).orderBy("dimension", "key"))
        if args.patterns:
            out["patterns"] = _rows(profile.patterns(last).orderBy("position"))
        return out
    if args.command == "run":
        from .jobs import Job

        job = Job(spark, args.job, args.top, args.min_score)
        if not job.workspace.has("resume"):
            job.start()
        return job.run(args.stage, args.package)
    if args.command in ("config-write", "config-check"):
        return _settings_command(args, spark)
    if args.command == "latest-workspace":
        from .operators import render

        found = render.latest_workspace(files.listed(spark, args.root.rstrip("/"), ("jobs/*", "skill-jobs/*/jobs/*"))).first()
        if found is None:
            raise ValueError(f"no workspace below {args.root}")
        return {"workspace": found.workspace}
    if args.command == "preflight":
        return _preflight(spark)
    if args.command == "prepare":
        return _prepared(args, spark)
    if args.command == "package-prompt":
        from .jobs import Job

        job = Job(spark, args.job)
        job.package_prompt()
        return {"workspace": job.workspace.path, "state": job.workspace.state()}
    if args.command == "finalize":
        from .operators import workspaces

        save = lambda w: _workspace_command(argparse.Namespace(**vars(args) | {"command": "package-save"}), spark)
        return workspaces.finalized(workspaces.Workspace(spark, args.workspace.rstrip("/")), {"package-save": save})
    if args.command in ("outputs", "state", "package-save"):
        return _workspace_command(args, spark)
    if args.name not in QUERIES:
        raise ValueError(f"unknown query: {args.name}")
    found = QUERIES[args.name](spark, args.data)
    if args.out:
        found.write.mode("overwrite").parquet(args.out)
        return {"out": args.out, "rows": spark.read.parquet(args.out).count()}
    return {"rows": found.count()}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    session = spark or SparkSession.builder.appName("momentquery").getOrCreate()
    try:
        print(json.dumps(run(args, session)))
    except ValueError as error:
        print(json.dumps({"error": str(error)}), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
