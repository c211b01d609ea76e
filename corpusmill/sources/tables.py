"""Reading the project's Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events embeddings files chunks emb_matrix emb_ids "
    "notion_sources dedup_report vocab_terms log_entries documents subject_areas subject_labels"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the scan stays lazy so that column pruning and filters reach Parquet."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    """Temporary views of the named tables, for spark.sql."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
