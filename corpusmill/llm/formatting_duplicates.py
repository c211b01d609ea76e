"""Problem 7: records that differ only in how they are written.

Method: byte-identical raw rows are collapsed first, with counts; only the distinct survivors are
canonicalised; then rows are grouped again on the full canonical text, summing the counts.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table

_SCHEME = re.compile(r"[\W_]*[a-z][a-z0-9+.\-]*://")
_DROPPED: dict[int, None] = {}


def _dropped() -> dict[int, None]:
    """Code points without letters, marks or digits: white space, controls, invisible characters, punctuation, symbols; variation selectors too."""
    if not _DROPPED:
        for cp in range(sys.maxunicode + 1):
            ch = chr(cp)
            if unicodedata.category(ch)[0] not in "LNM" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0):
                _DROPPED[cp] = None
    return _DROPPED


def canonical_value(value: str) -> str:
    """The letters, marks and digits of a value in compatibility form and one case; a url's parameters in one order."""
    if value.isascii():
        folded = value.lower()
    else:
        shown = "".join(ch for ch in value if unicodedata.category(ch) != "Cf")
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", shown).casefold())
    drop = _dropped()
    if "?" in folded and _SCHEME.match(folded):
        head, _, query = folded.partition("?")
        params = sorted(p for p in (x.translate(drop) for x in re.split("[&;]", query)) if p)
        return "\x01".join([head.translate(drop), *params])
    return folded.translate(drop)


def canonical_record(values: tuple[str, ...]) -> str:
    """One text for all ways of writing the record: its canonical values in one order of columns."""
    return "\x02".join(sorted(canonical_value(v) for v in values))


def formatting_groups(records: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, first_key (smallest key of the group), copies (size of the group) of every record.

    Records with a null among the columns, and those without a copy, are groups of one. Empty tables give
    no rows; other columns are ignored. The number of records of one group is not limited: the raw rows
    shrink map-side to distinct ones, and first_key goes back to the rows by a salted join.
    """
    total = records.count()
    raw = F.sha2(F.concat_ws("\x00", *[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns]), 256)
    complete = records.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns)).select(F.col(key).alias("id"), raw.alias("raw"), *columns)
    distinct = complete.groupBy("raw", *columns).agg(F.min("id").alias("first"), F.count("*").alias("n"))

    def canonicalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["canon"] = [canonical_record(v) for v in zip(*(b[c] for c in columns))]
            yield b[["raw", "first", "n", "canon"]]

    written = distinct.mapInPandas(canonicalise, f"raw string, first {dict(complete.dtypes)['id']}, n bigint, canon string")
    survivors = cut_lineage(written.select("raw", "first", "n", F.sha2("canon", 256).alias("canon")))  # read twice below
    groups = survivors.groupBy("canon").agg(F.min("first").alias("first_key"), F.sum("n").alias("copies"))
    threshold = hot_threshold(total)
    by_raw = salted_lookup(survivors.select("canon", "raw", "n"), groups.withColumn("rows", F.col("copies")), "canon", "rows", hot_rows=threshold)
    found = salted_lookup(complete.select("id", "raw"), by_raw.select("raw", "n", "first_key", "copies"), "raw", "n", hot_rows=threshold)
    rest = records.where(" OR ".join(f"`{c}` IS NULL" for c in columns)).select(F.col(key).alias("id"), F.col(key).alias("first_key"), F.lit(1).cast("bigint").alias("copies"))
    return found.select("id", "first_key", "copies").unionByName(rest).withColumnRenamed("id", key)


def p7_copies(spark, sf_dir):
    return formatting_groups(table(spark, sf_dir, "notion_sources"), "row_id", ["url", "title", "filename"])


def p7_found(spark, sf_dir):
    return p7_copies(spark, sf_dir).where("row_id <> first_key").select(F.col("first_key").alias("first_row_id"), "row_id")


QUERIES = {"p7_found": p7_found, "p7_copies": p7_copies}
SQL: dict[str, str] = {}
