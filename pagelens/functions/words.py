"""Word columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords whose mentions count as noise.
NOISE_KEYWORDS = ("cookie", "subscribe", "newsletter", "follow us", "related products", "talk to sales", "accept all", "privacy policy", "sign up", "get a demo", "share this", "careers")


def words(text: Column) -> Column:
    """Unicode words of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def terms(text: Column) -> Column:
    """ASCII words, for retrieval."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def tokens(text: Column) -> Column:
    """ASCII words of three characters or more, for n-grams."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0))


def grams(tokens_: Column, n: int = 5) -> Column:
    """Distinct n-grams as strings; fewer tokens than n are one gram."""
    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(F.size(t) == 0, F.array().cast("array<string>")).when(F.size(t) < n, F.array(F.array_join(t, " "))).otherwise(F.array_distinct(many))

    return F.get(F.transform(F.array(tokens_), of), F.lit(0))  # binds the tokens, which are else computed anew for every gram


def gram_hashes(tokens_: Column, n: int = 5) -> Column:
    """Hashes of the distinct n-grams, straight from slices of the tokens; fewer tokens than n are one gram."""
    def of(t: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.xxhash64(F.slice(t, i, n)))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).when(F.size(t) < n, F.array(F.xxhash64(t))).otherwise(F.array_distinct(many))

    return F.get(F.transform(F.array(tokens_), of), F.lit(0))


def mentions(text: Column, phrase: str) -> Column:
    """Non-overlapping occurrences of phrase in the lower-cased text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def sentences(text: Column, least: int = 40) -> Column:
    """Sentences of at least `least` characters, blanks collapsed."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+")
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(clean, lambda s: F.length(s) >= least)
