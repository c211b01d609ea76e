"""Problem 9: filling containers of fixed capacity with items of varying length.

Method: best-two-fit. A container is filled greedily, largest fitting item first; then its smallest item
is replaced by two unpacked items that fit the expanded gap more tightly.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.bpe import encode_texts
from corpusmill.sources.tables import table

CAPACITY = 2048
SHARD_ITEMS = 20_000


class _Stock:
    """Unpacked items by size: a stack per size, and a bit per size that is in stock."""

    def __init__(self, sizes: list[int], capacity: int):
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        for item in range(len(sizes) - 1, -1, -1):
            self.put(sizes[item], item)

    def put(self, size: int, item: int) -> None:
        self.stacks[size].append(item)
        self.bits |= 1 << size

    def take(self, size: int) -> int:
        item = self.stacks[size].pop()
        if not self.stacks[size]:
            self.bits &= ~(1 << size)
        return item

    def largest(self, room: int) -> int:
        """The largest size in stock of at most room; 0 if none."""
        return (self.bits & ((1 << (room + 1)) - 1)).bit_length() - 1 if room > 0 and self.bits & ((1 << (room + 1)) - 1) else 0

    def best_two(self, room: int, above: int) -> tuple[int, int] | None:
        """Two sizes in stock with the largest sum in (above, room]."""
        found, a = None, self.largest(room - 1)
        while a and 2 * a > above:
            b = self.largest(min(room - a, a))
            if b == a and len(self.stacks[a]) < 2:
                b = self.largest(min(room - a, a - 1))
            if b and a + b > above:
                found, above = (a, b), a + b
                if above == room:
                    break
            a = self.largest(a - 1)
        return found


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """Container number of each item; sizes are from 1 to capacity."""
    stock, place, container = _Stock(sizes, capacity), [0] * len(sizes), 0
    while stock.bits:
        room, inside = capacity, []
        while size := stock.largest(room):
            inside.append((size, stock.take(size)))
            room -= size
        while room and len(inside) > 1:
            size, item = inside[-1]  # filled by descending size: the last is the smallest
            pair = stock.best_two(size + room, size)
            if not pair:
                break
            inside.pop()
            stock.put(size, item)
            for s in pair:
                inside.append((s, stock.take(s)))
            room += size - sum(pair)
            inside.sort(reverse=True)
        for _, item in inside:
            place[item] = container
        container += 1
    return place


def pack_documents(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """container, key, piece, start, length: every item's place; pieces > 0 only for items over the capacity.

    Items of null size or of 0 take no space and have no row. An item over the capacity is cut into full
    containers and a rest, and the rest is packed as any item; no other item is cut. Repeated keys are
    items of their own. Items are spread over shards of about shard_items by a hash of the key and the row's
    size; each shard is packed on its own, which leaves at most a few loose containers per shard, so no
    task sees more than its shard at any data size. An empty table gives no rows.
    """
    items = sizes.where(F.col(size) > 0).select(F.col(key).alias("key"), F.col(size).cast("bigint").alias("size"))
    full = F.floor(F.col("size") / capacity).cast("bigint")
    big = items.where(F.col("size") >= capacity).groupBy("key", "size").agg(F.count("*").alias("copies"))  # equal rows get containers of their own
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    wholes = big.select("key", "size", seq(F.col("copies")).alias("copy")).select("key", "size", "copy", seq(full).alias("piece"))
    name = F.concat_ws("-", F.lit("w"), F.coalesce(F.col("key").cast("string"), F.lit("null")), "size", "copy", "piece")
    wholes = wholes.select(name.alias("container"), "key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.lit(capacity)).alias("start"), F.lit(capacity).alias("length"))
    shards = max(1, -(-sizes.count() // shard_items))
    rests = items.withColumn("full", full).select("key", F.col("full").cast("int").alias("piece"), (F.col("full") * capacity).alias("start"), (F.col("size") - F.col("full") * capacity).cast("int").alias("length")).where("length > 0")
    rests = rests.withColumn("shard", F.pmod(F.xxhash64("key", "start", "length"), F.lit(shards)).cast("int"))

    def place(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["key", "length"], kind="stable")
        shard["container"] = [f"s{s}-{c}" for s, c in zip(shard["shard"], pack(shard["length"].tolist(), capacity))]
        return shard[["container", "key", "piece", "start", "length"]]

    kind = dict(sizes.dtypes)[key]
    packed = rests.groupBy("shard").applyInPandas(place, f"container string, key {kind}, piece int, start bigint, length int")
    return packed.unionByName(wholes).withColumnRenamed("key", key)


def document_sizes(spark, sf_dir) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True)


def p9_packed(spark, sf_dir):
    from corpusmill.session import cut_lineage

    return pack_documents(cut_lineage(document_sizes(spark, sf_dir)), "doc_id", "n_tokens")


QUERIES = {"p9_packed": p9_packed}
SQL: dict[str, str] = {}
