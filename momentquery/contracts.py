"""Contract checks: each gives a column of error messages, empty where a row is sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the contracts.
SPIKES = ("absurdity", "controversy", "taboo", "action", "emotional_confrontation", "unusually_useful_claim", "expert_endorsement", "specific_pick", "big_number")
RATIOS = ("9:16", "1:1", "16:9")


class ContractError(ValueError):
    """Rows that break a contract, in strict mode."""


def _errors(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def strict(checked: DataFrame) -> DataFrame:
    bad = checked.filter(F.size("errors") > 0).select("errors").first()
    if bad is not None:
        raise ContractError(", ".join(bad.errors))
    return checked


def spans(rows: DataFrame, zero_length: bool = True) -> DataFrame:
    """start_seconds and end_seconds: not negative, in order; equal ones only where zero_length."""
    start, end = F.col("start_seconds"), F.col("end_seconds")
    return rows.withColumn("errors", _errors({"negative start": start >= 0, "ends before it starts": (end >= start) if zero_length else (end > start)}))


def unit_fields(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.withColumn("errors", _errors({f"{f} is not a share": F.col(f).between(0, 1) for f in fields}))


def enums(rows: DataFrame, field: str, values: tuple[str, ...]) -> DataFrame:
    known = F.array(*[F.lit(v) for v in values])
    return rows.withColumn("errors", _errors({f"unknown {field}": F.size(F.array_except(field, known)) == 0}))


PENALTIES = ("buried_lead", "dangling_question", "rambling_middle", "context_dependent", "low_delivery")
PRESETS = ("hook-default", "bottom-creator", "bottom-compact", "lower-third-clean", "center-punch", "top-clean")
MODES = ("TRACK", "GENERAL")


def one_of(rows: DataFrame, field: str, values: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("errors", _errors({f"unknown {field}": F.col(field).isin(*values)}))


def positive(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.withColumn("errors", _errors({f"{f} is not positive": F.col(f) > 0 for f in fields}))


def render_manifests(rows: DataFrame) -> DataFrame:
    """outputs and crop_plans, maps by ratio: the same ratios in both, and each plan's own is its key's."""
    same = F.array_sort(F.map_keys("outputs")) == F.array_sort(F.map_keys("crop_plans"))
    own = F.forall(F.map_entries("crop_plans"), lambda e: e["value"]["aspect_ratio"] == e["key"])
    return rows.withColumn(
        "errors",
        _errors(
            {
                "negative start": F.col("start_seconds") >= 0,
                "ends before it starts": F.col("end_seconds") > F.col("start_seconds"),
                "outputs and crop plans cover other ratios": same,
                "a crop plan has another ratio than its key": own,
                "unknown mode": F.col("mode").isin(*MODES),
                "unknown caption_preset": F.col("caption_preset").isin(*PRESETS),
            }
        ),
    )


def crop_plans(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "errors",
        _errors(
            {
                "no anchors": F.size("anchors") > 0,
                "wider than its source": F.col("target_width") <= F.col("source_width"),
                "higher than its source": F.col("target_height") <= F.col("source_height"),
            }
        ),
    )


def _texts(field: str, least: int, most: int | None, chars: int) -> Column:
    n = F.size(field)
    enough = (n >= least) if most is None else n.between(least, most)
    return enough & F.forall(field, lambda x: F.length(F.trim(x)).between(1, chars))


def video_briefs(rows: DataFrame) -> DataFrame:
    full = lambda f: F.forall(f, lambda x: F.length(x) >= 1)
    return rows.withColumn(
        "errors",
        _errors(
            {
                "theme": F.length("theme") >= 1,
                "expected_viral_patterns": F.size("expected_viral_patterns").between(3, 5) & full("expected_viral_patterns"),
                "anti_patterns": (F.size("anti_patterns") <= 3) & full("anti_patterns"),
            }
        ),
    )


def publish_packs(rows: DataFrame) -> DataFrame:
    tags = F.col("hashtags")
    good_tags = (
        F.size(tags).between(5, 10)
        & F.forall(tags, lambda x: F.startswith(F.trim(x), F.lit("#")) & ~F.contains(F.trim(x), F.lit(" ")) & (F.length(F.trim(x)) > 1))
        & (F.size(F.array_distinct(F.transform(tags, lambda x: F.lower(F.trim(x))))) == F.size(tags))
    )
    return rows.withColumn(
        "errors",
        _errors(
            {
                "titles": _texts("titles", 5, None, 80),
                "thumbnail_texts": _texts("thumbnail_texts", 3, None, 28),
                "social_caption": F.length(F.trim("social_caption")).between(1, 500),
                "hashtags": good_tags,
                "hooks": _texts("hooks", 2, 3, 140),
            }
        ),
    )


def unknown_fields(rows: DataFrame, field: str, known: list[str]) -> DataFrame:
    """JSON objects: names of fields that the contract doesn't have; null or no object is an error itself."""
    names = F.json_object_keys(field)
    extra = F.array_except(names, F.array(*[F.lit(k) for k in known]))
    return rows.withColumn("errors", F.when(names.isNull(), F.array(F.lit("no object"))).otherwise(F.transform(extra, lambda x: F.concat(F.lit("unknown field "), x))))
