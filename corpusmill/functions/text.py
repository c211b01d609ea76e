"""Text expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's White_Space property: no-break, em, ideographic spaces and line separators included.
WS = r"(?U)\s"
TOKEN = r"([A-Za-z][A-Za-z0-9_-]+)"
WORDS_PER_TOKEN = 0.75


def strip(c) -> Column:
    """Outer white space of any kind removed."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def word_count(c) -> Column:
    """Runs of characters free of Unicode white space; null for null."""
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def token_estimate(c) -> Column:
    """floor(words / 0.75), at least 1, as the chunker counts."""
    return F.greatest(F.lit(1), F.floor(word_count(c) / F.lit(WORDS_PER_TOKEN)).cast("int"))


def raw_tokens(c) -> Column:
    """Lower-case word tokens: an ASCII letter followed by one or more letters, digits, _ or -."""
    return F.transform(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1)), lambda x: F.lower(x))


def normal_term(c) -> Column:
    """A facet term: outer white space removed, lower case; null if blank."""
    t = F.lower(strip(c))
    return F.when(t != "", t)


def split_cell(c) -> Column:
    """Values of a one-cell list separated by , or |, trimmed, blanks dropped; empty for null."""
    parts = F.transform(F.split(c, r"[,|]"), lambda x: strip(x))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))
