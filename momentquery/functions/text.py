"""Column builders over text and numbers; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicon import Lexicon

#: A word: letters, digits and underscores of any script, with apostrophes inside.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
NUMBER = r"(?U)\b\d+(?:[\.,]\d+)?\b|\b\d+(?:st|nd|rd|th)\b"


def literal_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.trim(text, F.lit(" \t\n\r\f\v"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def rounded(x: Column, digits: int) -> Column:
    """To so many decimal digits as SQL has it: the scaled binary number, half away from zero. Spark's own round works on
    the shortest decimal form, which differs where that looks like a half and the scaled number falls short of it."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale) / scale


def clamp01(x: Column) -> Column:
    """NaN becomes 0; infinities clamp."""
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def clamp01_finite(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases are substrings of the lower-case text."""
    lowered = F.lower(text)
    return sum((F.contains(lowered, F.lit(p)).cast("int") for p in phrases), F.lit(0))


def distinct_hits(words: Column, lexicon: Sequence[str]) -> Column:
    return F.size(F.array_intersect(words, literal_array(lexicon)))


def all_hits(words: Column, lexicon: Sequence[str]) -> Column:
    """Occurrences, not distinct words: the array's length less that without them."""
    return F.size(words) - F.size(F.filter(words, lambda w: ~w.isin(list(lexicon))))


def keyword(words: Column, lexicon: Lexicon) -> Column:
    """Share of the lexicon's buckets that the words hit."""
    hits = sum((F.arrays_overlap(words, literal_array(b)).cast("int") for b in lexicon.buckets), F.lit(0))
    return hits / F.lit(float(len(lexicon.buckets)))


def hook(text: Column, words: Column, lexicon: Lexicon) -> Column:
    opening = F.slice(words, 1, 4)
    return clamp01(
        0.35 * F.least(phrase_hits(text, lexicon.hook_phrases), F.lit(2))
        + 0.2 * F.least(all_hits(opening, lexicon.hook_words), F.lit(2))
        + 0.5 * keyword(words, lexicon)
    )


def payoff(text: Column, words: Column, lexicon: Lexicon) -> Column:
    return clamp01(
        0.6 * F.least(phrase_hits(text, lexicon.payoff_phrases), F.lit(2))
        + 0.25 * F.least(distinct_hits(words, lexicon.payoff_words), F.lit(3))
    )


def interview(text: Column, words: Column, lexicon: Lexicon) -> Column:
    return clamp01(
        0.45 * F.least(phrase_hits(text, lexicon.interview_phrases), F.lit(2))
        + 0.2 * F.least(distinct_hits(words, lexicon.interview_words), F.lit(3))
    )


def numbers(text: Column) -> Column:
    """How many numbers a text has."""
    return F.size(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)))


def numeric(text: Column, words: Column) -> Column:
    return number_share(numbers(text), words)


def number_share(hits: Column, words: Column) -> Column:
    n = F.size(words)
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp01(hits / n * 5))


def interjection(words: Column, lexicon: Lexicon) -> Column:
    n = F.size(words)
    return F.when(n == 0, F.lit(0.0)).otherwise(clamp01(all_hits(words, lexicon.interjections) / F.greatest(n / 20, F.lit(1.0))))


def buried_lead(text: Column, lexicon: Lexicon) -> Column:
    return phrase_hits(text, lexicon.buried_leads) > 0


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap over the shorter length; 0 where that isn't positive."""
    shorter = F.least(a_end - a_start, b_end - b_start)
    overlap = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    return F.when(shorter > 0, overlap / shorter).otherwise(F.lit(0.0))
