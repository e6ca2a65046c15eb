"""Stable keys, excerpts, and parsing of settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


# What stands where a transcript was cut.
TRUNCATED = "\n\n[transcript truncated for brief — kept first {head} chars, {samples} representative middle sample(s), and last {tail} chars]\n\n"
MIDDLE = "[representative middle excerpts]\n"
ENDING = "\n\n[ending excerpt]\n\n"


def clip_hash(start: Column, end: Column, transcript: Column, version: str = "v1", context: Column | None = None) -> Column:
    """Sixteen hex digits of SHA-1 over version, times to a millisecond, and the trimmed transcript."""
    parts = [F.lit(version), F.format_string("%.3f", start), F.format_string("%.3f", end), strip(transcript)]
    text = F.concat_ws("|", *parts)
    if context is not None:
        text = F.when(context.isNotNull(), F.concat(text, F.lit("|"), context)).otherwise(text)
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 16)


def job_fingerprint(path: Column, version: str, size: Column, mtime_ns: Column) -> Column:
    """Twelve hex digits over path, version, size and time; over path and version where the file can't be seen."""
    seen = F.concat_ws("\0", path, F.lit(version), size.cast("string"), mtime_ns.cast("string"))
    text = F.when(size.isNotNull() & mtime_ns.isNotNull(), seen).otherwise(F.concat_ws("\0", path, F.lit(version)))
    return F.substring(F.sha1(F.encode(text, "UTF-8")), 1, 12)


def briefs(selected: DataFrame, windows: DataFrame) -> DataFrame:
    """Chosen windows with speakers in order of appearance, transcript and clip_hash."""
    members = windows.select("job_id", "start_idx", "end_idx", "members")
    out = selected.join(members, ["job_id", "start_idx", "end_idx"])
    transcript = strip(F.array_join(F.transform("members", lambda m: m["text"]), " "))
    return out.withColumns(
        {
            "transcript": transcript,
            "speakers": F.array_distinct(F.transform("members", lambda m: m["speaker"])),
            "clip_hash": clip_hash(F.col("start_seconds"), F.col("end_seconds"), transcript),
        }
    ).drop("members")


def excerpts(segments: DataFrame, most: int = 30000, head: int = 18000, tail: int = 10000, samples: int = 5) -> DataFrame:
    """job_id, excerpt, truncated: a transcript as lines; a long one keeps its beginning and end, and as many lines
    from evenly spaced places between."""
    line = F.concat(F.lit("["), F.when(F.col("speaker") == "", "SPEAKER").otherwise(F.coalesce("speaker", F.lit("SPEAKER"))), F.lit(" "), F.format_string("%.1f", "start_seconds"), F.lit("s] "), strip(F.col("text")))
    packed = segments.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l")))), lambda x: x["l"]).alias("p"))
    full = packed.withColumn("full", F.array_join("p", "\n")).withColumn("last", F.size("p") - 1)
    places = F.array_distinct(
        F.filter(F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda i: F.round(F.col("last") * i / (samples + 1)).cast("int")), lambda i: (i > 0) & (i < F.col("last")))
    )
    budget = max(most - head - tail, 0)
    per = F.greatest(F.floor(F.lit(budget) / F.size("places")), F.lit(1)).cast("int")
    chosen = F.transform(
        "places",
        lambda i: F.when(F.length(F.element_at("p", i + 1)) > per, F.concat(F.rtrim(F.substring(F.element_at("p", i + 1), F.lit(1), F.greatest(per - 1, F.lit(1)))), F.lit("…"))).otherwise(F.element_at("p", i + 1)),
    )
    middle = F.when((F.size("places") > 0) & F.lit(budget > 0), F.rtrim(F.substring(F.array_join(chosen, "\n"), F.lit(1), F.lit(budget)))).otherwise(F.lit(""))
    short = F.length("full") <= most
    lead = F.when(F.col("middle") != "", F.concat(F.lit(MIDDLE), F.col("middle"), F.lit("\n"))).otherwise(F.lit(""))
    end = F.ltrim(F.expr(f"right(full, {tail})")) if tail > 0 else F.lit("")
    ending = F.when(end != "", F.concat(F.lit(ENDING), end)).otherwise(F.lit(""))
    cut = F.concat(F.rtrim(F.substring("full", 1, head)), F.lit(TRUNCATED.format(head=head, samples=samples, tail=tail)), lead, ending)
    return (
        full.withColumn("places", places)
        .withColumn("middle", middle)
        .select("job_id", F.when(short, F.col("full")).otherwise(cut).alias("excerpt"), (~short).alias("truncated"))
    )


def listed(text: Column) -> Column:
    """Comma-separated values, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def chosen_ratios(text: Column, valid: Sequence[str]) -> tuple[Column, Column]:
    """The ratios that a setting names (all of them for 'all'), and the first that is not valid."""
    every = F.array(*[F.lit(v) for v in valid])
    found = F.when(F.lower(F.trim(text)) == "all", every).otherwise(listed(text))
    return found, F.try_element_at(F.filter(found, lambda x: ~F.array_contains(every, x)), F.lit(1))


def positive_int(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(n > 0, n)


def share(text: Column) -> Column:
    x = text.try_cast("double")
    return F.when(x.between(0, 1), x)


def settings(lines: DataFrame, line: str = "value") -> DataFrame:
    """key, value of KEY=VALUE lines; blank lines, comments and others are left out, quotes around values dropped."""
    text = F.trim(line)
    pair = F.split(text, "=", 2)
    kept = lines.filter((text != "") & ~F.startswith(text, F.lit("#")) & F.contains(text, F.lit("=")))
    value = F.trim(F.get(pair, F.lit(1)))
    quoted = F.rlike(value, F.lit("^(\".*\"|'.*')$")) & (F.length(value) >= 2)
    bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return kept.select(F.trim(F.get(pair, F.lit(0))).alias("key"), bare.alias("value"))


def quoted(value: Column) -> Column:
    """A value as it is written after KEY=: in quotes where it is empty or has white space."""
    return F.when((value == "") | F.rlike(value, F.lit(r"(?U)\s")), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(value)


def settings_text(rows: DataFrame, by: str) -> DataFrame:
    """rows(by, key, value) as one text a file: KEY=VALUE lines in order of key."""
    line = F.concat(F.col("key"), F.lit("="), quoted(F.col("value")))
    lines = F.array_sort(F.collect_list(F.struct("key", line.alias("line"))))
    return rows.groupBy(by).agg(F.concat(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), F.lit("\n")).alias("text"))


def updated_settings(old: DataFrame, new: DataFrame, by: str) -> DataFrame:
    """key, value of both, those of new where both have a key."""
    kept = old.join(new.select(by, "key"), [by, "key"], "left_anti")
    return kept.select(by, "key", "value").unionByName(new.select(by, "key", "value"))
