"""Facet counts, rollups and related terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import normal_term
from corpusmill.operators.ranking import within_pairs
from corpusmill.session import cut_lineage


def memberships(chunks: DataFrame, columns: dict[str, str], key: str = "file_id") -> DataFrame:
    """Distinct key, kind, item of every array element, normalised; columns maps kind to array column."""
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.transform(F.col(c), normal_term).alias("items")) for k, c in columns.items()])
    rows = chunks.select(key, F.explode(parts).alias("p")).select(key, "p.kind", F.explode("p.items").alias("item"))
    return rows.where(F.col("item").isNotNull() & F.col(key).isNotNull()).distinct()


def count_files(chunks: DataFrame, column: str, name: str, min_files: int = 1) -> DataFrame:
    """name and n_files: distinct files per element of an array column, at least min_files."""
    m = memberships(chunks, {"k": column})
    return m.groupBy(F.col("item").alias(name)).agg(F.count("*").alias("n_files")).where(F.col("n_files") >= min_files)


def categories(files: DataFrame) -> DataFrame:
    """level, category, subcategory, n_files: one rollup for both levels; null categories count as blank."""
    c = lambda x: F.coalesce(F.col(x), F.lit("")).alias(x)
    f = files.select("file_id", c("category"), c("subcategory")).distinct()
    g = f.rollup("category", "subcategory").agg(F.count_distinct("file_id").alias("n_files"), F.grouping_id().alias("g"))
    return g.where("g < 3").select((2 - F.col("g")).cast("int").alias("level"), "category", "subcategory", "n_files")


def related_terms(chunks: DataFrame, column: str, top_k: int = 5) -> DataFrame:
    """term, rank, other, shared, jaccard: for each term the top_k others by Jaccard of their file sets.

    Each pair of a file's distinct terms is counted once, map-side, and mirrored after counting; a file with any
    number of terms is spread over blocks (within_pairs).
    """
    m = cut_lineage(memberships(chunks, {"k": column}).select("file_id", "item"))
    n = m.groupBy("item").agg(F.count("*").alias("n"))
    once = cut_lineage(within_pairs(m, "file_id", "item").groupBy("a", "b").agg(F.count("*").alias("shared")))
    pairs = once.select(F.col("a").alias("term"), F.col("b").alias("other"), "shared").unionByName(once.select(F.col("b").alias("term"), F.col("a").alias("other"), "shared"))
    size = lambda c: n.select(F.col("item").alias(c), F.col("n").alias(f"n_{c}"))
    j = F.round(F.col("shared") / (F.col("n_term") + F.col("n_other") - F.col("shared")), 4)
    scored = pairs.join(size("term"), "term").join(size("other"), "other").withColumn("jaccard", j)
    order = Window.partitionBy("term").orderBy(F.desc("jaccard"), F.desc("shared"), "other")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("term", "rank", "other", "shared", "jaccard")


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row of totals over chunks."""
    path = F.lower("relpath")
    files = lambda ext: F.count_distinct(F.when(path.endswith(ext), F.col("file_id")))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_distinct("file_id").alias("n_files"), files(".md").alias("n_md"), files(".pdf").alias("n_pdf"),
        F.count_distinct(F.when(F.col("category") != "", F.col("category"))).alias("n_categories"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"),
    )
