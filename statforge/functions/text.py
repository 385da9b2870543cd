"""Names and tags: normalising, comparing, resolving noisy readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_tag(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def prefix_key(c: Column, n: int = 4) -> Column:
    """First n letters, for blocking."""
    return F.substring(F.regexp_replace(F.lower(c), "[^a-z]", ""), 1, n)


def snapshot_name(c: Column) -> Column:
    """A name as shown: ornaments in front, anything from a bracket on and punctuation at
    the end are dropped."""
    c = F.regexp_replace(c, r"^[\s.\-]+", "")
    c = F.regexp_replace(c, r"[(\[].*$", "")
    return F.trim(F.regexp_replace(c, r"[\s.,;:!\-]+$", ""))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 1 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def fuzzy_contains(text: Column, part: Column, most: int) -> Column:
    """Some stretch of ``text`` as long as ``part`` is at most ``most`` edits from it."""
    last = F.greatest(F.lit(1), F.length(text) - F.length(part) + 1)
    return F.exists(F.sequence(F.lit(1), last), lambda i: F.levenshtein(F.substr(text, i, F.length(part)), part) <= most)


def record_text(w: Column, losses: Column, o: Column) -> Column:
    return F.concat_ws("-", w.cast("string"), losses.cast("string"), o.cast("string"))


def one_letter_keys(c: Column) -> Column:
    """A text and all of it with one letter left out. Two texts at most one edit apart
    share one of these, so they meet in a join on equality."""
    gone = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, gone).otherwise(F.array().cast("array<string>"))))


def grams(c: Column, n: int) -> Column:
    """All distinct stretches of n letters of a text."""
    last = F.length(c) - n + 1
    return F.array_distinct(F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
