"""Retrieval metrics and comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import config as C


def hash_bucket(c: Column, buckets: int = 100) -> Column:
    """The sha1 of a text as a whole number, modulo buckets: a fold over its hex digits."""
    digits = F.transform(F.split(F.sha1(c), ""), lambda x: F.conv(x, 16, 10).cast("int"))
    return F.aggregate(F.filter(digits, lambda x: x.isNotNull()), F.lit(0), lambda acc, d: ((acc * 16 + d) % buckets).cast("int"))


def split_of(c: Column) -> Column:
    """holdout for buckets below 30, else dev."""
    return F.when(hash_bucket(c) < 30, "holdout").otherwise("dev")


def first_hits(hits: DataFrame) -> DataFrame:
    """qid, file_id, rank: each file at its first hit, ranks closed up."""
    first = hits.groupBy("qid", "file_id").agg(F.min("rank").alias("r"))
    return first.select("qid", "file_id", F.row_number().over(Window.partitionBy("qid").orderBy("r", "file_id")).alias("rank"))


def per_query(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """qid, n_relevant, recall, ndcg, rr, first_hit of every query with a relevant file. hits: qid, file_id, rank; relevant: qid, file_id."""
    known = relevant.select("qid", "file_id").distinct()
    joined = known.join(first_hits(hits), ["qid", "file_id"], "left")
    ideal = F.aggregate(F.transform(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(C.NDCG_AT)).cast("int")), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, x: a + x)
    g = joined.groupBy("qid").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("rank") <= C.RECALL_AT, 1).otherwise(0)).alias("found"),
        F.sum(F.when(F.col("rank") <= C.NDCG_AT, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"), F.min("rank").alias("first_hit"),
    )
    return g.select(
        "qid", F.col("n").alias("n_relevant"), F.round(F.col("found") / F.col("n"), 6).alias("recall"), F.round(F.col("gain") / ideal, 6).alias("ndcg"),
        F.round(F.when(F.col("first_hit") <= C.MRR_AT, 1 / F.col("first_hit")).otherwise(0.0), 6).alias("rr"), "first_hit",
    )


def aggregate(rows: DataFrame, source: str) -> DataFrame:
    """split, source, n and mean metrics: per split and per split and source, in one pass."""
    g = rows.groupingSets([["split"], ["split", source]], "split", source)
    means = [F.round(F.avg(m), 6).alias(m) for m in ("recall", "ndcg", "rr")]
    return g.agg(F.count("*").alias("n"), *means)


def compare(a: DataFrame, b: DataFrame, metric: str = "ndcg") -> DataFrame:
    """qid, state (only_a, only_b, better, worse, same) and delta of two runs."""
    x, y = a.select("qid", F.col(metric).alias("a")), b.select("qid", F.col(metric).alias("b"))
    d = F.col("b") - F.col("a")
    state = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").when(d > 1e-9, "better").when(d < -1e-9, "worse").otherwise("same")
    return x.join(y, "qid", "full_outer").select("qid", state.alias("state"), F.round(d, 6).alias("delta"))
