"""Hand-entered cells: placeholders for missing values, and lists in one cell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of what people enter for "no value", in lower case.
PLACEHOLDERS = ["", "na", "nan", "nil", "none", "null", "tba", "tbd", "todo", "unknown", "undefined", "missing", "empty", "notavailable", "notapplicable", "notgiven", "notset", "novalue", "nodata", "blank"]
OUTER = r"""(?U)^[\s\[\]'"]+|[\s\[\]'"]+$"""


def is_placeholder(c) -> Column:
    """True for null, blank and placeholder cells in any spelling."""
    return c.isNull() | F.lower(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]+", "")).isin(PLACEHOLDERS)


def entered_values(c) -> Column:
    """Distinct values of a list cell split at , and |, without outer white space, square brackets and quotes; empty for null, blank and placeholder cells."""
    parts = F.filter(F.transform(F.split(c, r"[,|]"), lambda x: F.regexp_replace(x, OUTER, "")), lambda x: x != "")
    return F.when(is_placeholder(c), F.array().cast("array<string>")).otherwise(F.array_distinct(parts))
