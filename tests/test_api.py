"""The engine from transcript to packages, its SQL functions, and the command line."""

import json

import pytest
from oracle import DATA
from pyspark.sql import functions as F

from momentquery.__main__ import main
from momentquery.api import Engine, RenderStageError, register_sql
from momentquery.operators import handoff
from momentquery.sources import testdata as td


@pytest.fixture(scope="module")
def tables(spark):
    return td.segments(spark, DATA), td.frames(spark, DATA), td.words(spark, DATA)


@pytest.fixture(scope="module")
def briefs(spark, tables, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("b") / "briefs")
    Engine(spark).mine(*tables).write.parquet(at)
    return spark.read.parquet(at)


def test_all_stages(spark, tables, briefs):
    def scorer(b):
        return b.select("job_id", "clip_id", "clip_hash", (1 - F.col("score")).alias("final_score"), F.lit("T").alias("title"), F.lit(None).cast("string").alias("hook"))

    def packager(b):
        return b.select("job_id", "clip_hash", "clip_id", F.lit("pack").alias("title"))

    assert Engine(spark).review(briefs) is None
    engine = Engine(spark, scorer=scorer, packager=packager)
    reviewed = engine.review(briefs)
    assert reviewed.count() == briefs.count() and reviewed.filter("title <> 'T'").count() == 0
    approved = engine.approve(reviewed, 2)
    plan = engine.render(approved, *tables, tables[0].select("job_id").distinct().withColumns({"source_width": F.lit(1920), "source_height": F.lit(1080)}))
    n = approved.filter("approved").count()
    assert plan["targets"].count() == 3 * n == plan["styles"].count() and plan["modes"].count() == n and plan["captions"].count() > 0
    assert engine.package(approved, briefs).filter("status = 'ok'").count() == n
    with pytest.raises(RenderStageError):
        engine.render(approved.withColumn("approved", F.lit(False)), *tables, tables[0])
    some = Engine(spark, scorer=lambda b: scorer(b).filter("clip_id = 'clip-000'"))
    assert some.review(briefs) is None
    wrong = Engine(spark, scorer=lambda b: scorer(b).withColumn("clip_hash", F.lit("x")))
    with pytest.raises(handoff.ScoringError):
        wrong.review(briefs)


def test_sql_functions(spark):
    register_sql(spark)
    r = spark.sql("select clamp01(double('nan')) a, overlap_ratio(0, 10, 5, 10) b, safe_rate(1, 0) c, safe_rate(1, 3) d, clip_hash('v1', 1, 2, ' t ') e").first()
    assert (r.a, r.b, r.c, r.d) == (0.0, 1.0, 0.0, 0.3333) and len(r.e) == 16


def test_command_line(spark, tables, briefs, tmp_path, capsys):
    at = {n: str(tmp_path / n) for n in ("segments", "frames", "words", "clips", "review", "approved", "log")}
    for n, t in zip(("segments", "frames", "words"), tables):
        t.write.parquet(at[n])
    assert main(["version"]) == 0
    capsys.readouterr()
    assert main(["mine", "--segments", at["segments"], "--frames", at["frames"], "--words", at["words"], "--out", at["clips"]], spark) == 0
    assert json.loads(capsys.readouterr().out)["clips"] == briefs.count()
    job = briefs.first().job_id
    briefs.filter(F.col("job_id") == job).withColumn("title", F.lit("t")).write.parquet(at["review"])
    assert main(["approve", "--review", at["review"], "--top", "1", "--out", at["approved"]], spark) == 0
    assert json.loads(capsys.readouterr().out)["approved_count"] == 1
    common = ["feedback", "--review", at["review"], "--history", at["log"], "--job", job]
    assert main([*common, "--kept", "clip-000"], spark) == 0
    assert main([*common, "--kept", "clip-777"], spark) == 1
    capsys.readouterr()
    assert main(["history", "--history", at["log"], "--summary", "--patterns"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["summary"][0]["total"] == 1 and out["patterns"] == [] and out["entries"][0]["clip_id"] == "clip-000"
    assert main(["query", "no_such", "--data", DATA], spark) == 1
    assert main(["approve", "--review", at["review"], "--top", "0", "--out", at["approved"]], spark) == 1
