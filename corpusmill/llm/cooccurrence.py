"""Problem 3: pairs of items that appear together, and how much more often than chance.

Method: items are made distinct per basket, ordered pairs are emitted and counted with map-side combine,
and lift and pointwise mutual information follow from the marginals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.frequencies import TERMS_SQL, chunk_terms
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table

MIN_TOGETHER = 5
MIN_LIFT = 3
BLOCK = 256


def cooccurring_pairs(items: DataFrame, n_baskets: int, basket: str = "basket", item: str = "item", min_together: int = MIN_TOGETHER, min_lift: float = MIN_LIFT) -> DataFrame:
    """item_a < item_b, n_ab, n_a, n_b, lift, pmi of all pairs with n_ab >= min_together and lift >= min_lift.

    items: one row per basket and item; repeated rows count once, null baskets and items never. n_baskets
    is the number of all baskets, those without items included. Empty tables give no rows.

    Items that cannot be in any result are left out before pairs are made, which changes no count: n_ab is
    at most the smaller marginal, so n_a < min_together can't reach the count, and n_a > n_baskets / min_lift
    can't reach the lift. The items of a basket are spread by a hash over blocks of about BLOCK items, as many
    as its size asks for, and each pair of blocks is a group of its own: no basket, however large, is ever
    collected in one place, and no task makes all its pairs. Sizes go to the items by a salted join.
    """
    once = items.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).select(F.col(basket).alias("b"), F.col(item).alias("i")).distinct()
    marginal = once.groupBy("i").agg(F.count("*").alias("n"))
    able = marginal.where((F.col("n") >= min_together) & (F.col("n") * F.lit(min_lift) <= F.lit(n_baskets)))
    rows = cut_lineage(once.join(able.select("i"), "i").select("b", "i"))  # read four times below
    kept = rows.groupBy("i").agg(F.count("*").alias("n"))
    sizes = rows.groupBy("b").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = salted_lookup(rows, sizes, "b", "m", hot_rows=hot_threshold(rows.count())).select("b", "i", F.pmod(F.xxhash64("i"), blocks).cast("int").alias("k"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
    of = lambda k: F.collect_list(F.when(F.col("k") == F.col(k), F.col("i")))
    cells = placed.withColumn("x", F.least("k", "j")).withColumn("y", F.greatest("k", "j")).groupBy("b", "x", "y").agg(of("x").alias("left"), of("y").alias("right"))
    pairs = cells.select("x", "y", F.explode("left").alias("l"), "right").select("x", "y", "l", F.explode("right").alias("r")).where("x < y OR l < r")
    counted = pairs.groupBy(F.least("l", "r").alias("item_a"), F.greatest("l", "r").alias("item_b")).agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_together)
    side = lambda s: kept.select(F.col("i").alias(f"item_{s}"), F.col("n").alias(f"n_{s}"))
    lift = F.col("n_ab") * F.lit(float(n_baskets)) / (F.col("n_a") * F.col("n_b"))
    return (
        counted.join(side("a"), "item_a").join(side("b"), "item_b")
        .where(F.col("n_ab") * F.lit(n_baskets) >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))
        .select("item_a", "item_b", "n_ab", "n_a", "n_b", F.round(lift, 6).alias("lift"), F.round(F.log2(lift), 6).alias("pmi"))
    )


def file_items(chunks: DataFrame) -> DataFrame:
    """basket (file_id) and item (kind:term) of every term on a chunk row."""
    return chunk_terms(chunks).select(F.col("file_id").alias("basket"), "kind", F.explode("terms").alias("term")).where("term IS NOT NULL").select("basket", F.concat_ws(":", "kind", "term").alias("item"))


def p3_pairs(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    return cooccurring_pairs(file_items(chunks), chunks.where("file_id IS NOT NULL").select("file_id").distinct().count())


def p3_found(spark, sf_dir):
    return p3_pairs(spark, sf_dir).select("item_a", "item_b")


_PAIRS = f"""WITH {TERMS_SQL},
m AS (SELECT DISTINCT file_id, kind || ':' || term AS item FROM t WHERE term <> ''),
n AS (SELECT count(DISTINCT file_id) AS n_all FROM chunks),
c AS (SELECT item, count(*) AS n FROM m GROUP BY item),
p AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM m a JOIN m b ON a.file_id = b.file_id AND a.item < b.item GROUP BY ALL),
f AS (SELECT item_a, item_b, n_ab, ca.n AS n_a, cb.n AS n_b, n_ab * n_all::DOUBLE / (ca.n * cb.n) AS l
  FROM p JOIN c ca ON ca.item = item_a JOIN c cb ON cb.item = item_b, n WHERE n_ab >= 5 AND n_ab * n_all >= 3 * ca.n * cb.n)
"""
QUERIES = {"p3_found": p3_found, "p3_pairs": p3_pairs}
SQL = {
    "p3_found": _PAIRS + "SELECT item_a, item_b FROM f",
    "p3_pairs": _PAIRS + "SELECT item_a, item_b, n_ab, n_a, n_b, round(l, 6) AS lift, round(log2(l), 6) AS pmi FROM f",
}
