"""Query op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .common import table
from .labelled import held_out

#: Grades of the ratings: 0 poor, 1 sound but toxic, 2 sound.
GRADE = "if(quality = 1, if(toxic = 1, 1, 2), 0)"
N_GRADES = 3


def op8_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(documents, labels, GRADE, N_GRADES)
    out = quality.graded(documents.select("doc_id", "text"), model, N_GRADES)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("grade.expected").alias("expected_grade"),
        F.element_at("grade.tails", 1).alias("p_sound"),
        F.element_at("grade.tails", 2).alias("p_clean"),
        (F.element_at("grade.tails", 1) >= 0.5).alias("selected"),
    )


QUERIES = {"op8_quality_grades": op8_quality_grades}
ORACLE: dict[str, str] = {}
