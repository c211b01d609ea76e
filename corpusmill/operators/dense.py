"""Dense vectors: means per group, exact top-k for a stated query set, and cosine joins above a threshold."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.ranking import within_pairs
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import cut_lineage

#: Queries of a tile, and scores that are held at once.
TILE, SCORES = 8192, 1 << 22
LEAST_BITS, MISS = 12, 2e-4
SKETCH_BITS = 128
#: Bands that meet in one pass, whose rows take about as much disk as the vectors; rows of all bands up to which one pass is enough.
PASS_BANDS, PASS_ROWS = 24, 1 << 22


def usable(embedding: str, dimension: int) -> Column:
    """True for arrays of `dimension` finite numbers, not all zero."""
    c = F.col(embedding)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(c) == dimension) & finite & F.exists(c, lambda x: x != 0), F.lit(False))


def unit(c: Column) -> Column:
    """The vector divided by its length, in double precision; zero vectors stay as they are."""
    d = F.transform(c, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    once = F.array_repeat(F.when(norm > 0, norm).otherwise(1.0), F.size(c))  # inside the lambda it would be summed per element
    return F.zip_with(d, once, lambda x, n: x / n)


def mean_vectors(rows: DataFrame, group: str, embedding: str) -> DataFrame:
    """group and the unit mean of its vectors' units. Sums are combined map-side, so a group of any size costs one vector per task."""
    mean = Summarizer.mean(array_to_vector(unit(F.col(embedding))))
    return rows.where(F.col(group).isNotNull()).groupBy(group).agg(vector_to_array(mean).alias("m")).select(group, unit(F.col("m")).alias("vector"))


def row_tiles(n: int, tile: int, cores: int) -> int:
    """How many tiles n rows are spread over: one per core from `tile` rows each on, more only beyond 4 * tile. Every tile gives k rows to each query, and takes all queries."""
    return max(1, -(-n // (4 * tile)), min(-(-n // tile), cores))


def dense_topk(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, tile: int = TILE) -> DataFrame:
    """qid, key, rank, score (cosine, 4 decimals): exact, for every query against every row.

    queries (qid, vector) is a stated set. Queries are spread by hash over tiles of about `tile`, rows over row_tiles, and
    every tile of rows meets every tile of queries in a group of its own: nothing goes through the driver, and a
    task holds two tiles. Ties go to the smaller key. Vectors are unit vectors of one length.
    """
    kind, qkind = corpus.schema[key].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    rows, asked = corpus.select(F.col(key).alias("id"), F.col(vector).alias("v")), queries.select(F.col("qid").alias("id"), F.col(vector).alias("v"))
    across, down = row_tiles(rows.count(), tile, rows.sparkSession.sparkContext.defaultParallelism), max(1, -(-asked.count() // tile))
    place = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.select(place(across).alias("x"), each(down).alias("y"), "id", "v")
    left = asked.select(each(across).alias("x"), place(down).alias("y"), F.col("id").alias("qid"), "v")

    def best(here: pa.Table, there: pa.Table) -> pa.Table:
        ids, names = there.column("id"), here.column("qid")
        found = {"qid": names.slice(0, 0), key: ids.slice(0, 0), "s": pa.array([], pa.float64())}
        if here.num_rows and there.num_rows:
            by = _sorted(ids)  # so that the place in the tile breaks ties
            ids, v = ids.take(by), _matrix(there.column("v"))[by.to_numpy()]
            parts, some = [], max(1, SCORES // len(v))
            for lo in range(0, here.num_rows, some):
                s = np.round(_matrix(here.column("v").slice(lo, some)) @ v.T, 9)
                if s.shape[1] > k:
                    row, col = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
                else:
                    row, col = np.divmod(np.arange(s.size), s.shape[1])
                order = np.lexsort((col, -s[row, col], row))
                row, col = row[order], col[order]
                top = np.arange(len(row)) - np.searchsorted(row, row) < k
                parts.append((row[top] + lo, col[top], s[row[top], col[top]]))
            row, col, sim = (np.concatenate(x) for x in zip(*parts))
            found = {"qid": names.take(pa.array(row)), key: ids.take(pa.array(col)), "s": pa.array(sim)}
        return pa.table(found)

    parts = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(best, f"qid {qkind}, `{key}` {kind}, s double")
    order = Window.partitionBy("qid").orderBy(F.desc("s"), key)
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", key, "rank", F.round("s", 4).alias("score"))


def _sorted(keys: pa.ChunkedArray) -> pa.Array:
    """Places of the keys in ascending order; of structs field by field."""
    keys = keys.combine_chunks()
    if not pa.types.is_struct(keys.type):
        return pc.sort_indices(keys)
    fields = pa.table(keys.flatten(), names=[f.name for f in keys.type])
    return pc.sort_indices(fields, sort_keys=[(c, "ascending") for c in fields.column_names])


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def vector_classes(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, rep, copies: for each row the smallest key among the rows whose vectors agree to 6 decimals, and their number."""
    rows = vectors.select(F.col(key).alias("id"), F.xxhash64(F.transform(vector, lambda x: F.round(x, 6) + F.lit(0.0))).alias("h"))
    rows = cut_lineage(rows)
    reps = rows.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    return salted_lookup(rows, reps, "h", "copies", hot_rows=hot_threshold(rows.count())).select("id", "rep", "copies")


def sign_bands(n: int, floor: float, miss: float = MISS) -> tuple[int, int]:
    """Bits per band and number of bands for n vectors, so that a band's buckets hold a vector or two at any n and a pair at the floor shares no band with probability `miss`."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, n))) - 1)
    together = (1 - math.acos(floor) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-together))


def band_passes(n: int, bands: int) -> list[tuple[int, int]]:
    """The bands of each pass, as from and to."""
    passes = max(1, min(-(-bands // PASS_BANDS), n * bands // PASS_ROWS))
    return [(i * bands // passes, (i + 1) * bands // passes) for i in range(passes)]


def most_apart(floor: float) -> int:
    """Of SKETCH_BITS signs, how many of a pair at the floor differ at most, but for one pair in ten million."""
    share = math.acos(floor) / math.pi
    return math.ceil(SKETCH_BITS * share + 5.2 * math.sqrt(SKETCH_BITS * share * (1 - share)))


def cosine_pairs(vectors: DataFrame, key: str, vector: str, floor: float, classes: DataFrame | None = None, miss: float = MISS, seed: int = 17) -> DataFrame:
    """a < b and cosine of pairs of class representatives with cosine >= floor; classes (vector_classes) gives the members of each.

    Vectors that agree to 6 decimals form a class and are compared once, through the one with the smallest key: its pairs
    stand for those of its members, and members of one class have cosine 1. So no class is multiplied out.

    Candidates share a band of random-hyperplane signs. Those whose sketches of SKETCH_BITS further signs lie too far
    apart (most_apart) are dropped where they meet, and only the rest is joined to its vectors and checked exactly. Bands get longer and more
    as the table grows (sign_bands), so candidates grow with n ** 1.3 or less where vectors are spread, and a
    pair at the floor is missed with probability `miss`, nearer pairs with less. Buckets are split into blocks (within_pairs).
    In large tables bands meet in passes (band_passes), of which only the pairs are kept, so their rows aren't on disk all at once.
    """
    classes = vector_classes(vectors, key, vector) if classes is None else classes
    reps = cut_lineage(vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).join(classes.where("id = rep").select("id"), "id"))
    kind = dict(reps.dtypes)["id"]
    n = reps.count()
    bits, bands = sign_bands(n, floor, miss)

    def sign(batches, lo, hi):
        planes = None
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(1))
            if planes is None:
                planes = np.random.default_rng(seed).standard_normal((v.shape[1], bands * bits + SKETCH_BITS)).astype(np.float32)
                planes = planes[:, np.r_[:SKETCH_BITS, SKETCH_BITS + lo * bits : SKETCH_BITS + hi * bits]]
            for at in range(0, len(v), 2048):
                on = v[at : at + 2048].astype(np.float32) @ planes > 0
                code = (on[:, SKETCH_BITS:].reshape(-1, hi - lo, bits) * (1 << np.arange(bits, dtype=np.int64))).sum(2) * bands + np.arange(lo, hi)
                sketch = np.packbits(on[:, :SKETCH_BITS], axis=1).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, code.size + 1, hi - lo, dtype=np.int32)), pa.array(code.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(code)), pa.array(sketch[:, 0]), pa.array(sketch[:, 1]), lists], names=["id", "s0", "s1", "codes"])

    apart = lambda s: F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}")))
    found = []
    for lo, hi in band_passes(n, bands):
        codes = reps.select("id", "v").mapInArrow(lambda batches, lo=lo, hi=hi: sign(batches, lo, hi), f"id {kind}, s0 bigint, s1 bigint, codes array<bigint>").select(F.struct("id", "s0", "s1").alias("x"), F.explode("codes").alias("code"))
        met = within_pairs(codes, "code", "x").where(apart("s0") + apart("s1") <= most_apart(floor))
        found.append(cut_lineage(met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()))
    near = reduce(DataFrame.unionByName, found).distinct()
    side = lambda s: reps.select(F.col("id").alias(s), F.col("v").alias(f"v{s}"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return near.join(side("a"), "a").join(side("b"), "b").select("a", "b", dot.alias("cosine")).where(F.col("cosine") >= floor)
