"""Reciprocal-rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import config as C


def rrf(lists: list[DataFrame], keys: list[str], k: int) -> DataFrame:
    """qid, keys, rank, score: sum of 1 / (60 + rank) over any number of lists of (qid, keys, rank); ties to the smaller key."""
    every = reduce(DataFrame.unionByName, [x.select("qid", *keys, "rank") for x in lists])
    fused = every.groupBy("qid", *keys).agg(F.sum(F.lit(1.0) / (C.RRF_K + F.col("rank"))).alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), *keys)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", *keys, "rank", F.round("score", 6).alias("score"))
