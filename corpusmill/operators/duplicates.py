"""Duplicate sources: four keys, subset suppression, richness and winners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.urls import canonical_title, canonical_url, hash_suffix, host_of
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import cut_lineage

KEY_TYPES = 4


def filled(c: Column) -> Column:
    """True for a text that isn't null, blank or a mark for a missing value."""
    return F.coalesce(~F.lower(F.trim(c)).isin("", "null", "~", "[]", "[ ]"), F.lit(False))


def richness(scalars: list[str], lists: list[str], url: str) -> Column:
    """How many fields are filled, plus one for a well-formed URL."""
    one = lambda x: F.when(x, 1).otherwise(0)
    parts = [one(filled(F.col(c))) for c in scalars] + [one(filled(F.col(c)) & (F.length(c) > 2)) for c in lists]
    return reduce(lambda a, b: a + b, parts, one(F.coalesce(F.col(url).contains("://"), F.lit(False))))


def keyed(sources: DataFrame, key: str = "row_id", url: str | None = "url", title: str | None = "title", filename: str | None = "filename", content: str | None = None) -> DataFrame:
    """key, group_type, group_key of every duplicate key a row has. Columns given as None give no keys; content gives those of byte-identical texts."""
    option = lambda t, k: F.struct(F.lit(t).alias("t"), k.alias("k"))
    options = []
    if url:
        cu = canonical_url(F.col(url))
        options.append(option("canonical_url", F.when(cu != "", cu)))
    if url and title:
        ct, host = canonical_title(F.col(title)), host_of(F.col(url))
        options.append(option("title_host", F.when((ct != "") & (host != ""), F.concat(ct, F.lit("@"), host))))
    if content:
        options.append(option("content_hash", F.concat(F.lit("sha1:"), F.substring(F.sha1(F.col(content).cast("binary")), 1, 12))))
    if filename:
        options.append(option("hash_suffix", F.concat(F.lit("suffix:"), hash_suffix(F.col(filename)))))
    return sources.select(key, F.explode(F.array(*options)).alias("o")).where("o.k IS NOT NULL").select(key, F.col("o.t").alias("group_type"), F.col("o.k").alias("group_key"))


def _group(df: DataFrame) -> DataFrame:
    return df.withColumn("g", F.concat_ws("\x00", "group_type", "group_key"))


def duplicate_groups(keys: DataFrame, key: str = "row_id") -> DataFrame:
    """group_type, group_key, key, size of groups of two or more that say something new.

    Groups by address, and by content, all count. A group by title and host counts if a member is in no group by
    address. A group by suffix counts unless it lies inside one group of those that count.

    A member is in at most one group of each type, so a group lies inside another exactly if they have as many
    members in common as it has: members are matched by key, and groups without a common member are never
    compared. Sizes go to the members by salted joins, so a group may hold any share of the rows.
    """
    rows = cut_lineage(_group(keys))  # read several times below
    hot = hot_threshold(rows.count())
    sizes = cut_lineage(rows.groupBy("g", "group_type").agg(F.count("*").alias("size")).where("size > 1"))
    ranked = cut_lineage(salted_lookup(rows.select(key, "g"), sizes.select("g", "size", F.col("group_type").alias("t")), "g", "size", hot_rows=hot))
    of = lambda t: ranked.where(F.col("t") == t)
    new = of("title_host").join(of("canonical_url").select(key), key, "left_anti").select("g").distinct()
    first = sizes.where("group_type IN ('canonical_url', 'content_hash')").select("g").unionByName(new)
    counted = cut_lineage(first)
    earlier = ranked.join(counted, "g", "left_semi")
    inside = of("hash_suffix").alias("x").join(earlier.alias("y"), key).groupBy(F.col("x.g").alias("g"), F.col("x.size").alias("size"), F.col("y.g").alias("other")).agg(F.count("*").alias("common"))
    last = sizes.where("group_type = 'hash_suffix'").select("g").join(inside.where("common = size").select("g").distinct(), "g", "left_anti")
    left = sizes.select("g", "size").join(counted.unionByName(last), "g", "left_semi")
    return salted_lookup(rows, left, "g", "size", hot_rows=hot).select("group_type", "group_key", key, "size")


def winners(groups: DataFrame, scored: DataFrame, key: str = "row_id") -> DataFrame:
    """groups with richness and winner: the richest member, ties to the smaller key. The winner goes to the members by a salted join."""
    rows = _group(groups.join(scored.select(key, "richness"), key))
    best = rows.groupBy("g").agg(F.max_by(F.col(key), F.struct("richness", (-F.col(key)).alias("n"))).alias("best"), F.count("*").alias("members"))
    found = salted_lookup(rows, best, "g", "members", hot_rows=hot_threshold(KEY_TYPES * scored.count()))
    return found.select("group_type", "group_key", key, "size", "richness", (F.col(key) == F.col("best")).alias("winner"))
