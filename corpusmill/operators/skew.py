"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

#: Rows up to which a side of a join is broadcast; a row of keys and a number is some 100 bytes.
BROADCAST_ROWS = 200_000
HOT_ROWS = 50_000
HOT_KEYS = 10_000
SALTS = 32


def hot_threshold(rows: int) -> int:
    """Rows from which a key counts as hot, so that at most HOT_KEYS keys of a table of `rows` rows can be."""
    return max(HOT_ROWS, -(-rows // HOT_KEYS))


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, computed once and counted: to be broadcast if there are at most `most` of them, else joined by a shuffle."""
    kept = cut_lineage(rows)
    return F.broadcast(kept) if kept.count() <= most else kept


def salted_lookup(rows: DataFrame, lookup: DataFrame, key: str, count: str, how: str = "inner", hot_rows: int = HOT_ROWS, salts: int = SALTS) -> DataFrame:
    """Join rows to lookup on key, spreading hot keys over several tasks.

    lookup has one row per key and holds in `count` how many rows carry the key. Keys with more than
    hot_rows rows are hot: their lookup row is written once per salt, and the rows pick a salt by a hash
    of their other columns. Rows of other keys use salt 0. The list of hot keys is broadcast: it has at
    most rows / hot_rows entries, so pass hot_threshold(rows) for it to stay within HOT_KEYS.
    """
    hot = F.broadcast(lookup.where(F.col(count) > hot_rows).select(F.col(key).alias("_hot_key")))
    others = [c for c in rows.columns if c != key] or [key]
    picked = rows.join(hot, F.col(key) == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(F.lit(0).cast("bigint"))
    ).drop("_hot_key")
    spread = lookup.withColumn(
        "_salt", F.explode(F.when(F.col(count) > hot_rows, F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).otherwise(F.array(F.lit(0).cast("bigint"))))
    )
    return picked.join(spread, [key, "_salt"], how).drop("_salt")
