"""Cohorts of a feedback history: what its owner keeps and skips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Length cohorts, and the sizes and deviations that a confidence needs.
LENGTHS = (("under_20s", 0.0, 20.0), ("20_to_30s", 20.0, 30.0), ("30_to_45s", 30.0, 45.0), ("45_to_60s", 45.0, 60.0), ("over_60s", 60.0, None))
LENGTH_LABELS = {"under_20s": "under 20s", "20_to_30s": "between 20 and 30s", "30_to_45s": "between 30 and 45s", "45_to_60s": "between 45 and 60s", "over_60s": "over 60s"}
TIERS = (("high", 2, 15, 0.30), ("medium", 1, 8, 0.25), ("low", 0, 5, 0.20))
# How a cohort is put into words, by kind.
RULES = {
    "length": "User {does} clips {label} ({rate}% keep rate vs. {all}% overall).",
    "spike": "User {does} '{key}' clips ({rate}% keep rate vs. {all}% overall).",
    "score": "User skips many high-scoring clips ({rate}% keep rate at score >= 0.85 vs. {all}% overall).",
    "ratio": "User {does} {key} renders ({rate}% keep rate vs. {all}% overall).",
}
MEMORIES = {
    "length": "Clip creator {does} clips {label}; bias candidate scoring accordingly.",
    "spike": "Clip creator {does} '{key}' spike clips; weight that signal accordingly when scoring.",
    "score": "Rubric score alone is not a reliable signal for this creator; weight spike categories, pacing, and concrete payoff over raw score.",
    "ratio": "Clip creator mostly {does} the {key} ratio; consider adjusting default ratios accordingly.",
}
LEAST_ROWS = 5
HIGH_SCORE = 0.85


def latest(history: DataFrame) -> DataFrame:
    """The row of each (job_id, clip_id) that comes last by ord, with first_ord, where the key was first seen."""
    rest = [c for c in history.columns if c not in ("job_id", "clip_id")]
    found = history.groupBy("job_id", "clip_id").agg(F.max_by(F.struct(*rest), "ord").alias("r"), F.min("ord").alias("first_ord"))
    return found.select("job_id", "clip_id", *[F.col(f"r.{c}").alias(c) for c in rest], "first_ord")


def rate(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.round(n / d, 4)).otherwise(F.lit(0.0))


def _kept() -> Column:
    return F.count_if("posted")


def summary(entries: DataFrame) -> DataFrame:
    """dimension (all, ratio, spike), key, total, kept, skipped, keep_rate; the row of all comes even without rows."""
    stats = (F.count("*").alias("total"), _kept().alias("kept"))
    everything = entries.agg(*stats).select(F.lit("all").alias("dimension"), F.lit("").alias("key"), "total", "kept")
    cohorts = entries.select(
        "posted",
        F.explode(
            F.concat(
                F.transform("ratios", lambda x: F.struct(F.lit("ratio").alias("dimension"), x.alias("key"))),
                F.transform("spike_categories", lambda x: F.struct(F.lit("spike").alias("dimension"), x.alias("key"))),
            )
        ).alias("c"),
    )
    by_key = cohorts.groupBy("c.dimension", "c.key").agg(*stats)
    return everything.unionByName(by_key).withColumns({"skipped": F.col("total") - F.col("kept"), "keep_rate": rate(F.col("kept"), F.col("total"))})


def _tier(n: Column, deviation: Column, value: int) -> Column:
    out = F.lit(None)
    for tier in reversed(TIERS):
        out = F.when((n >= tier[2]) & (deviation >= tier[3]), F.lit(tier[value])).otherwise(out)
    return out


def patterns(entries: DataFrame) -> DataFrame:
    """Cohorts that are kept much more or less often than all clips.

    kind, key, direction, confidence, sample_size, keep_rate, overall_keep_rate, rule, suggested_memory and position: more confident
    first, smaller samples first within a confidence, then by kind (length, spike, score, ratio) and key. Positions are
    given in one task: its rows are cohorts, as many as there are kinds of lengths, spikes and ratios.
    """
    length = F.lit(None)
    order = F.lit(None)
    for i, (label, low, high) in reversed(list(enumerate(LENGTHS))):
        inside = (F.col("duration_seconds") >= low) & (F.lit(True) if high is None else F.col("duration_seconds") < high)
        length, order = F.when(inside, F.lit(label)).otherwise(length), F.when(inside, F.lit(str(i))).otherwise(order)

    def key(kind: int, name: str, k: Column, o: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind_ord"), F.lit(name).alias("kind"), k.alias("key"), o.alias("key_ord"))

    none = F.array().cast("array<struct<kind_ord:int,kind:string,key:string,key_ord:string>>")
    cohorts = F.concat(
        F.when(length.isNotNull(), F.array(key(0, "length", length, order))).otherwise(none),
        F.transform("spike_categories", lambda x: key(1, "spike", x, x)),
        F.when(F.col("score") >= HIGH_SCORE, F.array(key(2, "score", F.lit(str(HIGH_SCORE)), F.lit("0")))).otherwise(none),
        F.transform("ratios", lambda x: key(3, "ratio", x, x)),
        F.array(key(4, "all", F.lit(""), F.lit(""))),
    )
    counted = entries.select("posted", F.explode(cohorts).alias("c")).groupBy("c").agg(F.count("*").alias("sample_size"), _kept().alias("kept"))
    counted = counted.select("c.*", "sample_size", rate(F.col("kept"), F.col("sample_size")).alias("keep_rate"))
    overall = counted.filter("kind = 'all'").select(F.col("sample_size").alias("_all"), F.col("keep_rate").alias("overall_keep_rate"))
    joined = counted.filter("kind <> 'all'").join(F.broadcast(overall), F.col("_all") >= LEAST_ROWS)  # one row
    gap = F.col("keep_rate") - F.col("overall_keep_rate")
    n, scored = F.col("sample_size"), F.col("kind") == "score"
    # High scores matter only where they are skipped, and a small cohort of them says nothing.
    deviation = F.when(scored, -gap).otherwise(F.abs(gap))
    shaky = scored & ((n < TIERS[1][2]) | (deviation < TIERS[1][3]))
    more = F.when(gap > 0, "keeps").otherwise("skips")
    percent = lambda c: F.floor(F.col(c) * 100).cast("int").cast("string")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in LENGTH_LABELS.items() for x in kv]), F.col("key"))
    kind = F.col("kind")

    def worded(formats: dict[str, str]) -> Column:
        out = F.lit(None)
        for name, text in formats.items():
            filled = F.lit(text)
            for mark, value in (("{does}", more), ("{label}", label), ("{key}", F.col("key")), ("{rate}", percent("keep_rate")), ("{all}", percent("overall_keep_rate"))):
                if mark in text:
                    filled = F.replace(filled, F.lit(mark), value)
            out = F.when(kind == name, filled).otherwise(out)
        return out

    return (
        joined.withColumns({"confidence": _tier(n, deviation, 0), "rank": _tier(n, deviation, 1)})
        .filter(F.col("confidence").isNotNull() & ~shaky)
        .withColumns({"direction": more, "rule": worded(RULES), "suggested_memory": worded(MEMORIES)})
        .withColumn("position", F.expr("row_number() over (order by rank desc, sample_size, kind_ord, key_ord)"))
        .select("position", "kind", "key", "direction", "confidence", "sample_size", "keep_rate", "overall_keep_rate", "rule", "suggested_memory")
    )


def recent(history: DataFrame, n: int) -> DataFrame:
    """The n rows with the largest ord, oldest first."""
    return history.orderBy(F.desc("ord")).limit(n).orderBy("ord")
