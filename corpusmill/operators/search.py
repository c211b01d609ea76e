"""The whole search as one plan: filters, mode, fusion, expansion over the graph, reranking, projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.operators.delta import KEYS, current_chunks
from corpusmill.operators.dense import dense_topk
from corpusmill.operators.fusion import rrf
from corpusmill.operators.graph import both_ways, seed_files
from corpusmill.operators.lexical import RAW, Lexicon, bm25, bm25_pairs, rerank
from corpusmill.operators.skew import small_side
from corpusmill.session import cut_lineage

#: The columns a filter can ask for.
FILTERED = ["category", "tags", "concepts", "relpath"]
#: What a hit carries besides its score.
RESULT = ["relpath", "title", "heading_path", "tokens", "category", "subcategory", "tags", "concepts"]


@dataclass(frozen=True)
class Filters:
    """What the current row of a chunk must be; None asks for nothing. Names are compared as they are, file_type by the end of the path."""

    category: str | None = None
    concept: str | None = None
    tag: str | None = None
    file_type: str | None = None

    def condition(self) -> Column:
        out = F.lit(True)
        for asked, test in (
            (self.category, lambda v: F.col("category") == v), (self.concept, lambda v: F.array_contains("concepts", v)),
            (self.tag, lambda v: F.array_contains("tags", v)), (self.file_type, lambda v: F.col("relpath").endswith(f".{v}")),
        ):
            out = out & (F.coalesce(test(asked), F.lit(False)) if asked is not None else F.lit(True))
        return out


@dataclass(frozen=True)
class Expansion:
    """How neighbours of the first files come in: seeds per query, neighbours per seed, least weight, hops, and what a further hop leaves of a weight."""

    seeds: int = C.SEED_FILES
    per_seed: int = C.PER_HOP
    floor: float = C.EXPAND_FLOOR
    hops: int = 1
    decay: float = C.HOP_DECAY


def neighbours_of(hits: DataFrame, edges: DataFrame, pool_files: DataFrame, how: Expansion = Expansion()) -> DataFrame:
    """qid, file_id: the files that each query's first files bring in. hits: qid, file_id, rank; edges: a, b, weight.

    A seed brings in its strongest neighbours with a chunk in the pool that the query hasn't hit, per_seed at most in each hop, with at
    least `floor` of what decay leaves of the weight. A file reached from several seeds comes in once.
    """
    seen = hits.select("qid", "file_id").distinct()
    front, found = seed_files(hits, how.seeds).select("qid", F.col("file_id").alias("seed"), "file_id"), []
    out = both_ways(edges, "weight").join(pool_files.select(F.col("file_id").alias("nbr")), "nbr", "left_semi")
    for hop in range(max(1, how.hops)):
        near = front.join(out, front["file_id"] == out["node"]).where(F.col("weight") * F.lit(how.decay**hop) >= how.floor)
        fresh = near.select("qid", "seed", F.col("nbr").alias("file_id"), "weight").join(seen, ["qid", "file_id"], "left_anti")
        best = fresh.groupBy("qid", "seed", "file_id").agg(F.max("weight").alias("weight"))
        order = Window.partitionBy("qid", "seed").orderBy(F.desc("weight"), "file_id")
        kept = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= how.per_seed)
        new = cut_lineage(kept.groupBy("qid", "file_id").agg(F.min("seed").alias("seed")))
        found.append(new.select("qid", "file_id"))
        front, seen = new.select("qid", "seed", "file_id"), seen.unionByName(new.select("qid", "file_id"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def representatives(files: DataFrame, queries: DataFrame, chunks: DataFrame, current: DataFrame, lexicon: Lexicon = RAW, keep: Column | None = None) -> DataFrame:
    """qid, file_id, chunk_id, score: of each file brought in, the pool's chunk that ranks first for the query; its first chunk with score 0 if none does.

    Terms are weighed by all files brought in, not file by file. A query's terms are only held against the chunks of its own files.
    current: the keys of the current chunks that meet keep.
    """
    brought = small_side(files.select("file_id").distinct())
    scored = bm25_pairs(files, queries, chunks.join(brought, "file_id", "left_semi"), KEYS, lexicon, keep)
    best = scored.groupBy("qid", "file_id").agg(F.min_by(F.struct("chunk_id", F.round("score", 4).alias("score")), F.struct((-F.round("score", 9)).alias("s"), "chunk_id")).alias("w"))
    first = current.join(brought, "file_id", "left_semi").groupBy("file_id").agg(F.min("chunk_id").alias("first"))
    joined = files.join(first, "file_id").join(best, ["qid", "file_id"], "left")
    return joined.select("qid", "file_id", F.coalesce("w.chunk_id", "first").alias("chunk_id"), F.coalesce("w.score", F.lit(0.0)).alias("score"))


def search(
    queries: DataFrame, chunks: DataFrame, k: int = 8, mode: str = "bm25", filters: Filters | None = None, vectors: DataFrame | None = None, edges: DataFrame | None = None,
    expansion: Expansion = Expansion(), reranked: bool = False, scorer=None, lexicon: Lexicon = RAW, columns: list[str] | None = None,
) -> DataFrame:
    """qid, rank, score, file_id, chunk_id, source and the columns asked for (RESULT by default; text too, if named).

    queries: qid, query, and for the modes semantic and hybrid `vector`, unit vectors as in vectors (file_id, chunk_id, vector).
    chunks: all deliveries; the current row of each chunk counts, filters first, statistics over what they leave.
    hybrid fuses both lists, each oversampled. With edges (a, b, weight), hybrid brings in neighbours where a reranker will sort them
    in, or where a query has fewer hits than it asks for; source is graph_expansion for those, and null otherwise. reranked scores a longer list of candidates again (rerank) and keeps k.
    Ties go to the smaller key. Queries without hits, and empty tables, give no rows.
    """
    if mode not in ("bm25", "semantic", "hybrid"):
        raise ValueError(f"unknown mode: {mode!r}")
    wanted = C.RERANK_POOL if reranked else k
    over = max(wanted * C.OVERSAMPLE, 20) if mode == "hybrid" else wanted
    keep = filters.condition() if filters else None
    current = current_chunks(chunks, *FILTERED)
    current = cut_lineage((current if keep is None else current.where(keep)).select(*KEYS))
    lists = []
    if mode != "semantic":
        lists.append(bm25(queries.where("query IS NOT NULL"), chunks, KEYS, k=over, lexicon=lexicon, latest=True, keep=keep))
    if mode != "bm25":
        inside = vectors.where(F.col("vector").isNotNull()).join(current.select(*KEYS), KEYS, "left_semi").groupBy(*KEYS).agg(F.min("vector").alias("vector"))
        near = dense_topk(queries.where("vector IS NOT NULL").select("qid", "vector"), inside.select(F.struct(*KEYS).alias("at"), "vector"), "at", "vector", over)
        lists.append(near.select("qid", "at.*", "rank", "score"))
    hits = rrf(lists, KEYS, wanted) if mode == "hybrid" else lists[0]
    hits = cut_lineage(hits.select("qid", *KEYS, "rank", "score", F.lit(None).cast("string").alias("source")))
    if mode == "hybrid" and edges is not None:
        asking = hits if reranked else hits.join(hits.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") < wanted).select("qid"), "qid", "left_semi")
        files = neighbours_of(asking, edges, current.select("file_id").distinct(), expansion)
        more = representatives(files, queries, chunks, current, lexicon, keep)
        last = hits.groupBy("qid").agg(F.max("rank").alias("last"))
        place = Window.partitionBy("qid").orderBy(F.desc("score"), *KEYS)
        more = more.join(last, "qid").select("qid", *KEYS, (F.col("last") + F.row_number().over(place)).cast("int").alias("rank"), (F.col("score") if reranked else F.lit(0.0)).alias("score"), F.lit("graph_expansion").alias("source"))
        hits = cut_lineage(hits.unionByName(more))
    if reranked:
        texts = current_chunks(chunks.join(small_side(hits.select(*KEYS).distinct()), KEYS, "left_semi"), "text")  # else all texts are shuffled
        scored = rerank(hits, queries, texts, KEYS, k, scorer=scorer)
        hits = cut_lineage(scored.join(hits.select("qid", *KEYS, "source"), ["qid", *KEYS]))
    else:
        hits = hits.where(F.col("rank") <= k)
    asked = RESULT if columns is None else columns
    rows = current_chunks(chunks.join(small_side(hits.select(*KEYS).distinct()), KEYS, "left_semi"), *asked)
    return hits.join(rows, KEYS).select("qid", "rank", F.round("score", 6).alias("score"), *KEYS, "source", *asked)
