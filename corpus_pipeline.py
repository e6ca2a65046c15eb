"""The corpus pipeline: documents through five operators, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes and reads again as the next
one's docs. All but the last return the columns of docs. Models are fitted on labelled rows of sf_dir's own tables,
so that a stage's decisions don't depend on what came before. Stages keep rows with null or empty texts unless
their own rule rejects them; the near-duplicate stage keeps one of repeated rows, unless they have no id, the other
stages treat them alike. Operators add one column under a name that docs doesn't have, which is dropped again, so
columns of any name come out as they went in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from momentquery.llm import jaccard, mixing, quality, sentencepieces, toxicity
from momentquery.llm.common import fresh, named, table, written
from momentquery.llm.queries_quality import GRADE, N_GRADES
from momentquery.llm.queries_sentencepieces import model_path

#: Near-duplicate stage: words in a shingle, and the least similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: Mixing stage: the most epochs of a source, where the least repeated one is seen once. No document is left out.
REPEATS = 1.25


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic score is below one half."""
    chain = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = fresh("toxicity", docs.columns)
    return toxicity.score(docs, chain, into=name).filter(named(name)["score"] < 0.5).drop(name)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are sound (grade 1 or better) more likely than not."""
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), GRADE, N_GRADES)
    name = fresh("grade", docs.columns)
    return quality.graded(docs, model, N_GRADES, into=name).filter(F.element_at(named(name)["tails"], 1) >= 0.5).drop(name)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near duplicates, once, and all rows without an id.

    Of texts that share that id, the one with the smallest key stays; of repeated rows, the one with the smallest
    hash."""
    found = jaccard.components(docs, WIDTH, PERCENT).filter("doc_id = component_id")
    kept = found.groupBy("component_id").agg(F.min("text_key").alias("key"), F.count("*").alias("n")).withColumnRenamed("component_id", "id")
    kept = written(kept, "kept")
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), jaccard.text_key(F.col("text")).alias("key"))
    first = rows.join(kept, ["id", "key"])
    once = first.filter("n = 1").select("row")
    again = first.filter("n > 1").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return once.unionByName(again).unionByName(rows.filter("id is null").select("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: all once, and those of small sources again up to the limit."""
    name = fresh("n_tokens", docs.columns)
    counted = docs.withColumn(name, mixing.n_tokens(F.col("text")))
    tokens = mixing.source_tokens(counted, tokens=name)
    taken = fresh("taken", counted.columns)
    return mixing.realised(counted, mixing.shares(tokens, limit=REPEATS), tokens=name, into=taken).drop(name, taken)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, piece ids and their number; every text decodes to itself."""
    name = fresh("coded", docs.columns)
    pieces = named(name)["pieces"]
    out = sentencepieces.encoded(docs, sentencepieces.load(model_path()), into=name)
    return out.select("doc_id", "source", F.coalesce(F.size(pieces), F.lit(0)).alias("n_pieces"), pieces.alias("pieces"), named(name)["exact"].alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("near duplicates", one_of_each),
    ("mixing", mixed),
    ("sentencepieces", encoded),
]
#: Fitted models and tokenizers have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name.replace(' ', '-')}")
    return docs
