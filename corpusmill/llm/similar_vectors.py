"""Problem 1: the k most similar vectors of every vector, at a small loss of accuracy.

Method: a hierarchical navigable small-world graph per shard, in flat neighbour arrays (hnsw.py), with the
shards' results merged. A shard is a cell of a coarse k-means, in two levels where there are many; a vector is
indexed in its nearest cell and looks for neighbours there and in the other cells that are nearly as near.
Similarities of what the graph returns are computed again exactly, in double precision.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.hnsw import BEAM_SEARCH, FlatHnsw
from corpusmill.operators.dense import unit
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table

DIMENSION = 128
#: Rows of a cell: more of them, not more cells, as tables grow, for neighbours are lost between cells. Beyond FEW_CELLS of LARGE_SHARD rows there are more cells.
SHARD_ROWS, LARGE_SHARD, FEW_CELLS = 8192, 65_536, 8
#: A cell over PART_ROWS is cut into parts, so that a graph fits into a task's memory.
PART_ROWS = 131_072
SAMPLE_ROWS = 32_768
LEVEL_CELLS = 256
#: PROBES up to FEW_CELLS, and one more for each doubling. Coarse cells whose fine ones are compared.
PROBES, MARGIN, COARSE_PROBES = 4, 0.13, 16
ASK_BATCH = 1024
#: Grids of by_direction, the numbers that place a vector in one, their step, and the largest difference of any component within a class.
GRIDS, GRID_AXES, GRID_STEP, SAME_DIRECTION = 3, 3, 4e-6, 2e-7


def _unit(values: np.ndarray) -> np.ndarray:
    v = values.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # tiny and huge vectors keep a finite norm
    return v / np.sqrt(np.einsum("nd,nd->n", v, v))[:, None]


def _matrix(column, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _lists(values: np.ndarray, width: int, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel(), kind))


def usable_vectors(matrix: DataFrame, key: str, embedding: str, dimension: int, seed: int = 23) -> DataFrame:
    """id, h, grids, v: rows with a key and `dimension` finite elements that aren't all zero, one per row of the matrix.

    h digests the vector's bits (0 and -0 alike), grids holds the cells of by_direction's grids. One pass over
    the scan; what a plan doesn't select after it is not shuffled.
    """
    rng = np.random.default_rng(seed)
    axes = rng.standard_normal((dimension, GRIDS * GRID_AXES))
    axes /= np.linalg.norm(axes, axis=0) * GRID_STEP
    shift, mix = rng.random(GRIDS * GRID_AXES), rng.integers(1 << 62, size=GRID_AXES) | 1

    def run(batches):
        for b in batches:
            b = b.filter(pc.and_(pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dimension), False), pc.is_valid(b.column(0))))
            if not b.num_rows:
                continue
            v = _matrix(b.column(1), dimension).astype(np.float32) + np.float32(0)
            good = np.nonzero(np.isfinite(v).all(1) & (v != 0).any(1))[0]
            if not len(good):
                continue
            v = v[good]
            code = (np.floor(_unit(v) @ axes + shift).astype(np.int64).reshape(-1, GRIDS, GRID_AXES) * mix).sum(2)
            digests = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in v], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(good)), digests, _lists(code, GRIDS, pa.int64()), _lists(v, dimension, pa.float32())], names=["id", "h", "grids", "v"])

    return matrix.select(F.col(key).cast("bigint"), F.col(embedding).cast("array<float>")).mapInArrow(run, "id bigint, h binary, grids array<bigint>, v array<float>")


def coarse_cells(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centroids of a spherical k-means over the sample."""
    rng = np.random.default_rng(seed)
    x = _unit(sample).astype(np.float32)
    c = x[rng.permutation(len(x))[:cells]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        by = np.argsort(near, kind="stable")
        here, first = np.unique(near[by], return_index=True)
        total = np.add.reduceat(x[by].astype(np.float64), first, axis=0)
        norm = np.linalg.norm(total, axis=1)
        c[here] = np.where(norm[:, None] > 1e-9, total / np.maximum(norm, 1e-9)[:, None], c[here]).astype(np.float32)
    return c


def cell_rows(n: int) -> int:
    return min(LARGE_SHARD, max(SHARD_ROWS, -(-n // FEW_CELLS)))


def cell_probes(cells: int) -> int:
    return PROBES + max(0, round(np.log2(cells / FEW_CELLS)))


@dataclass
class Cells:
    """Centroids of the cells, and where there are two levels the coarse ones and the first cell of each."""

    fine: np.ndarray
    coarse: np.ndarray | None = None
    first: np.ndarray | None = None  # len(coarse) + 1

    def nearest(self, x: np.ndarray, probes: int, margin: float) -> np.ndarray:
        """Numbers of the nearest cells of each row, best first; -1 beyond the margin behind the best. The best doesn't depend on the number of probes."""
        if self.coarse is None:
            s, cell = x @ self.fine.T, np.broadcast_to(np.arange(len(self.fine)), (len(x), len(self.fine)))
        else:
            s, cell = np.full((len(x), 0), -np.inf, np.float32), np.zeros((len(x), 0), np.int64)
            near = np.argsort(-(x @ self.coarse.T), axis=1)[:, : max(COARSE_PROBES, probes)]
            for p in range(near.shape[1]):
                width = int(np.diff(self.first)[near[:, p]].max(initial=1))
                ps, pn = np.full((len(x), width), -np.inf, np.float32), np.full((len(x), width), -1, np.int64)
                for c in np.unique(near[:, p]):
                    rows, lo, hi = np.nonzero(near[:, p] == c)[0], self.first[c], self.first[c + 1]
                    ps[rows, : hi - lo], pn[rows, : hi - lo] = x[rows] @ self.fine[lo:hi].T, np.arange(lo, hi)
                s, cell = np.hstack([s, ps]), np.hstack([cell, pn])
                keep = np.argsort(-s, axis=1)[:, :probes]
                s, cell = np.take_along_axis(s, keep, 1), np.take_along_axis(cell, keep, 1)
        best = np.argsort(-s, axis=1)[:, :probes]
        s, cell = np.take_along_axis(s, best, 1), np.take_along_axis(cell, best, 1)
        return np.where(s >= s[:, :1] - margin, cell, -1).astype(np.int32)


def fit_cells(vectors: DataFrame, n: int, dimension: int, shard_rows: int, level_cells: int = LEVEL_CELLS) -> Cells:
    """Cells of about shard_rows of the n vectors (rep, v); at most level_cells squared.

    Up to level_cells of them come from one k-means over at most SAMPLE_ROWS vectors. More come in two levels:
    every coarse cell is split by a k-means over at most SAMPLE_ROWS of its own vectors, on the executors.
    Samples are taken by a hash of the key, and every vector is indexed.
    """
    order = F.xxhash64("rep")
    sample = _matrix(vectors.orderBy(order, "rep").limit(SAMPLE_ROWS).select("v").toArrow().column(0), dimension)
    wanted = min(level_cells**2, max(1, -(-n // shard_rows)), max(1, n // 4))
    if wanted <= level_cells:
        return Cells(coarse_cells(sample, min(wanted, max(1, len(sample) // 4))))
    top = min(level_cells, int(np.ceil(np.sqrt(wanted))), max(1, len(sample) // 4))
    coarse = coarse_cells(sample, top)
    shared = vectors.sparkSession.sparkContext.broadcast(Cells(coarse))

    def place(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shared.value.nearest(_unit(_matrix(b.column(1), dimension)).astype(np.float32), 1, 9)[:, 0])], names=["rep", "v", "c"])

    placed = vectors.select("rep", "v").mapInArrow(place, "rep bigint, v array<float>, c int")
    sizes = {r.c: r["count"] for r in placed.groupBy("c").count().collect()}  # at most level_cells
    share = min(1.0, 64.0 / shard_rows)
    picked = placed.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    few = picked.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(order, "rep"))).where(F.col("r") <= SAMPLE_ROWS)

    def split(t: pa.Table) -> pa.Table:
        c = t.column("c")[0].as_py()
        own = coarse_cells(_matrix(t.column("v"), dimension), min(level_cells, max(1, round(sizes[c] / shard_rows)), t.num_rows))
        return pa.table({"c": pa.array([c] * len(own), pa.int32()), "v": _lists(own, dimension, pa.float32())})

    found: dict[int, list] = {}
    for r in few.select("c", "v").groupBy("c").applyInArrow(split, "c int, v array<float>").toLocalIterator():  # at most level_cells squared centroids
        found.setdefault(r.c, []).append(r.v)
    parts = [np.array(found[c], np.float32) if c in found else coarse[c : c + 1] for c in range(len(coarse))]
    return Cells(np.vstack(parts), coarse, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))


def by_direction(members: DataFrame, vectors: DataFrame) -> DataFrame | None:
    """h, first: for vectors with the direction of another (scaled copies), the h of the class's smallest id; null if there are none.

    members: id, h, grids, one row per id; vectors: id, h, v. Scaled single-precision vectors differ by rounding, so no one way of rounding brings all
    of them together. Each distinct vector lies in a cell of three shifted grids over a few projections of its unit
    vector, and the smallest id goes from cell to cell; a group that lies on the edge of one grid is joined by
    another. Only vectors that share a cell with another one take part. Each is then compared with its smallest,
    and keeps its own h unless they agree.
    """
    bits = members.groupBy("h").agg(F.min("id").alias("rep"), F.min_by("grids", "id").alias("grids"))
    cells = bits.select("h", "rep", F.posexplode("grids").alias("grid", "code"))
    crowded = cells.groupBy("grid", "code").agg(F.count("*").alias("n")).where("n > 1").withColumn("gc", F.struct("grid", "code"))
    if crowded.limit(1).count() == 0:
        return None
    hot = hot_threshold(GRIDS * members.count())
    busy = salted_lookup(cells.select(F.struct("grid", "code").alias("gc"), "h"), crowded.select("gc", "n"), "gc", "n", hot_rows=hot).select("h").distinct()
    keys = cut_lineage(bits.join(busy, "h").withColumn("low", F.col("rep")))
    for g in range(GRIDS):
        at = keys.select("h", "rep", "grids", "low", F.get("grids", F.lit(g)).alias("code"))
        shared = at.groupBy("code").agg(F.min("low").alias("least"), F.count("*").alias("n")).where("n > 1")
        keys = cut_lineage(salted_lookup(at, shared, "code", "n", "left", hot).select("h", "rep", "grids", F.coalesce("least", "low").alias("low")))
    moved = cut_lineage(keys.where("low <> rep").select("h", "rep", "low"))
    firsts = moved.groupBy("low").agg(F.count("*").alias("n"))
    firsts = firsts.join(keys.select(F.col("rep").alias("low"), F.col("h").alias("first")), "low")
    once = lambda keys, h, name: vectors.join(keys, (F.col("id") == F.col(name)) & (vectors["h"] == keys[h])).dropDuplicates([name])
    own = once(moved.withColumnRenamed("h", "mh"), "mh", "rep").select(F.col("mh").alias("h"), "low", "v")
    other = once(firsts, "first", "low").select("low", "first", "n", F.col("v").alias("w"))
    pairs = salted_lookup(own, other, "low", "n", hot_rows=hot)
    apart = F.array_max(F.zip_with(unit(F.col("v")), unit(F.col("w")), lambda x, y: F.abs(x - y)))
    return cut_lineage(pairs.where(apart <= SAME_DIRECTION).select("h", "first"))


def most_similar(
    vectors: DataFrame, key: str, embedding: str, k: int, dimension: int, min_similarity: float = -1.0, among: DataFrame | None = None,
    shard_rows: int | None = None, probes: int | None = None, margin: float = MARGIN, beam: int = BEAM_SEARCH, part_rows: int = PART_ROWS, level_cells: int = LEVEL_CELLS,
) -> DataFrame:
    """key, rank, neighbour, similarity: for every usable vector its k most similar others, best first, ties to the smaller key.

    A row is usable if its key isn't null, its vector has `dimension` finite elements and isn't all zero, and its key
    is in `among` (a table with a column of that name), if given. A key delivered several times counts once. Neighbours below min_similarity are left out. Similarity is the
    cosine rounded to 6 decimals. The result is approximate; the README gives its measured recall. Empty tables give no rows.

    Vectors of one direction, equal or scaled, are indexed once (by_direction), with their k + 1 smallest keys; each
    copy then gets its own list, so a vector with a million copies costs one search. Cells are fitted by fit_cells.
    A vector searches the cells whose centroids are at most `margin` less similar than its nearest one, `probes` at most. By default cell_rows and cell_probes give their size and
    the probes. A cell over part_rows is cut into several
    shards by a hash, and its queries search all of them. Every shard is one task: it builds its graph once, and
    the queries stream past it.
    """
    spark = vectors.sparkSession
    scan = usable_vectors(vectors, key, embedding, dimension)
    members = scan.groupBy("id").agg(F.min("h").alias("h"), F.min_by("grids", "h").alias("grids"))
    if among is not None:
        members = members.join(among.select(F.col(key).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    members = cut_lineage(members)  # narrow: vectors stay where they are
    same = by_direction(members, scan.select("id", "h", "v"))
    hot = hot_threshold(members.count())
    if same is not None:
        weight = members.groupBy("h").agg(F.count("*").alias("m"))
        members = salted_lookup(members.select("id", "h"), same.join(weight, "h"), "h", "m", "left", hot).select("id", F.coalesce("first", "h").alias("h"))
    members = cut_lineage(members.select("id", "h")) if same is not None else members.select("id", "h")
    classes = members.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    lead = Window.partitionBy("h").orderBy("id")
    several = salted_lookup(members, classes.where("copies > 1").select("h", "copies"), "h", "copies", hot_rows=hot)
    lists = several.withColumn("r", F.row_number().over(lead)).where(F.col("r") <= k + 1).groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = classes.join(lists, "h", "left").select("h", "rep", "copies", F.coalesce("ids", F.array("rep")).alias("ids"))
    firsts = classes.select("rep", "ids", "copies", F.col("h").alias("ch"))
    distinct = scan.select("id", "h", "v").join(firsts, (F.col("id") == F.col("rep")) & (F.col("h") == F.col("ch"))).dropDuplicates(["rep"]).select("rep", "ids", "copies", "ch", "v")
    distinct = cut_lineage(distinct)
    n = distinct.count()
    if n == 0:
        return spark.createDataFrame([], f"`{key}` bigint, rank int, neighbour bigint, similarity double")
    cells = spark.sparkContext.broadcast(fit_cells(distinct.select("rep", "v"), n, dimension, shard_rows or cell_rows(n), level_cells))
    probes = probes or cell_probes(len(cells.value.fine))

    def homes(batches):
        count = np.zeros(len(cells.value.fine), np.int64)
        for b in batches:
            if b.num_rows:
                count += np.bincount(cells.value.nearest(_unit(_matrix(b.column(0), dimension)).astype(np.float32), 1, margin)[:, 0], minlength=len(count))
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["cell", "n"])

    sizes = distinct.select("v").mapInArrow(homes, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # one row per cell
    parts = np.zeros(len(cells.value.fine), np.int64)
    for r in sizes:
        parts[r.cell] = -(-r.n // part_rows)
    first = np.concatenate([[0], np.cumsum(parts)])
    shards = spark.sparkContext.broadcast((parts, first))

    def spread(batches):
        parts, first = shards.value
        for b in batches:
            if not b.num_rows:
                continue
            near = cells.value.nearest(_unit(_matrix(b.column("v"), dimension)).astype(np.float32), probes, margin)
            row, rank = np.nonzero(near >= 0)
            cell = near[row, rank]
            row, rank, cell = np.repeat(row, parts[cell]), np.repeat(rank, parts[cell]), np.repeat(cell, parts[cell])
            part = _runs(row, rank)
            key = (b.column("rep").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = (rank == 0) & (part == key[row].astype(np.int64) % np.maximum(parts[cell], 1))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array((first[cell] + part).astype(np.int32)), pa.array(own), *[b.column(c).take(take) for c in ("rep", "ids", "v")]], names=["shard", "own", "rep", "ids", "v"])

    def search(batches):
        graph, waiting = None, []
        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("own").to_numpy(zero_copy_only=False)
            if own.any():  # sorted: the shard's own rows come first
                waiting.append(b.filter(b.column("own")))
            if own.all():
                continue
            if graph is None:
                graph = _Shard(waiting, dimension, k, max(k + 2, beam), min_similarity)
                yield from graph.own()
            yield from graph.ask(b.filter(pc.invert(b.column("own"))))
        if graph is None and waiting:
            yield from _Shard(waiting, dimension, k, max(k + 2, beam), min_similarity).own()

    near = "array<struct<d:double,id:bigint>>"
    rows = distinct.select("rep", "ids", "v").mapInArrow(spread, "shard int, own boolean, rep bigint, ids array<bigint>, v array<float>")
    hits = rows.repartitionById(int(first[-1]), "shard").sortWithinPartitions(F.desc("own")).mapInArrow(search, f"rep bigint, near {near}")
    # a vector's own copies are neighbours too, found or not
    alike = distinct.where("copies > 1").select("rep", F.transform("ids", lambda x: F.struct(F.lit(-1.0).alias("d"), x.alias("id"))).alias("near"))
    merged = hits.unionByName(alike).groupBy("rep").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k + 1).alias("near"))
    lists = distinct.select("rep", "ch", "copies").join(cut_lineage(merged), "rep")  # else both uses below search
    single = lists.where("copies = 1").select(F.col("rep").alias("id"), "near")
    copied = salted_lookup(members.withColumnRenamed("h", "ch"), lists.where("copies > 1").select("ch", "near", "copies"), "ch", "copies", hot_rows=hot).select("id", "near")
    others = single.unionByName(copied).select("id", F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))
    return others.select(F.col("id").alias(key), F.posexplode("near").alias("p", "x")).select(
        key, (F.col("p") + 1).cast("int").alias("rank"), F.col("x.id").alias("neighbour"), (-F.col("x.d")).alias("similarity")
    )


def _runs(row: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... within each run of equal (row, rank)."""
    new = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(rank) != 0)])
    at = np.arange(len(row))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class _Shard:
    """The graph over a shard's rows, and the keys each row stands for."""

    def __init__(self, batches: list, dimension: int, k: int, beam: int, least: float):
        t = pa.Table.from_batches(batches)
        self.k, self.beam, self.least, self.dimension = k, beam, least, dimension
        self.reps, self.unit = t.column("rep").to_numpy(), _unit(_matrix(t.column("v"), dimension))
        lists = t.column("ids").combine_chunks()
        self.starts, self.flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
        self.sizes = np.diff(self.starts)
        self.graph = FlatHnsw(self.unit.astype(np.float32))

    def own(self):
        """The answers to the shard's own rows: the walk begins where each one lies in the graph."""
        for lo in range(0, len(self.unit), ASK_BATCH):
            at = np.arange(lo, min(lo + ASK_BATCH, len(self.unit)))
            yield self._answers(self.reps[at], self.unit[at], at)

    def ask(self, b: pa.RecordBatch):
        reps, unit = b.column("rep").to_numpy(), _unit(_matrix(b.column("v"), self.dimension))
        for lo in range(0, len(reps), ASK_BATCH):
            yield self._answers(reps[lo : lo + ASK_BATCH], unit[lo : lo + ASK_BATCH], None)

    def _answers(self, reps, q, nodes) -> pa.RecordBatch:
        got, _ = self.graph.search(q.astype(np.float32), self.beam, self.beam, nodes)
        a, b = np.nonzero(got >= 0)
        node = got[a, b]
        exact = np.round(np.einsum("nd,nd->n", q[a], self.unit[node]), 6)
        keep = exact >= self.least
        a, node, exact = a[keep], node[keep], exact[keep]
        m = self.sizes[node]  # each row stands for its smallest keys
        at = np.repeat(self.starts[node] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum()) if len(m) else np.zeros(0, np.int64)
        who, sim, ident = np.repeat(a, m), np.repeat(exact, m), self.flat[at]
        by = np.lexsort((ident, -sim, who))
        who, sim, ident = who[by], sim[by], ident[by]
        top = np.arange(len(who)) - np.searchsorted(who, who, side="left") <= self.k
        who, sim, ident = who[top], sim[top], ident[top]
        found = np.unique(who)
        offsets = np.concatenate([np.searchsorted(who, found), [len(who)]]).astype(np.int32)
        near = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(-sim), pa.array(ident.astype(np.int64))], names=["d", "id"]))
        return pa.RecordBatch.from_arrays([pa.array(reps[found]), near], names=["rep", "near"])


def p1_neighbours(spark, sf_dir, min_similarity: float = -1.0):
    return most_similar(table(spark, sf_dir, "emb_matrix"), "row_ix", "embedding", 10, DIMENSION, min_similarity, among=table(spark, sf_dir, "emb_ids"))


def p1_found(spark, sf_dir):
    near = p1_neighbours(spark, sf_dir, 0.70)
    return near.select(F.least("row_ix", "neighbour").alias("row_ix_a"), F.greatest("row_ix", "neighbour").alias("row_ix_b")).distinct()


QUERIES = {"p1_found": p1_found}
SQL = {
    "p1_found": """WITH u AS (SELECT row_ix, first(embedding::DOUBLE[]) AS v FROM emb_matrix
      WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        AND row_ix IN (SELECT row_ix FROM emb_ids) GROUP BY row_ix),
    s AS (SELECT a.row_ix AS a, b.row_ix AS b, round(list_cosine_similarity(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.row_ix <> b.row_ix),
    r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s)
    SELECT DISTINCT least(a, b) AS row_ix_a, greatest(a, b) AS row_ix_b FROM r WHERE r <= 10 AND s >= 0.70""",
}
