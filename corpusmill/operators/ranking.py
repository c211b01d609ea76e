"""Numbering and weighted overlap without a single task or all pairs of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.skew import salted_lookup
from corpusmill.session import cut_lineage


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their number from 0 in the given order.

    Rows are range-sorted over the cluster; each one's place in its partition is added to the sum of the
    partitions before, so the only small step is one row per partition.
    """
    mask = (1 << 33) - 1
    placed = cut_lineage(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_m", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_p")).agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.withColumn("_p", part).join(F.broadcast(starts.drop("_n")), "_p").withColumn(name, F.col("_s") + F.col("_m").bitwiseAND(F.lit(mask))).drop("_p", "_m", "_s")


def overlapping_pairs(lists: DataFrame, node: str, items: str, least: Column) -> DataFrame:
    """a < b and shared: pairs of nodes whose common items weigh at least what either node asks for.

    lists: node and items, an array of structs beginning with w (the item's weight, the same in every list).
    least gives what a node's pairs must share. Pairs are found by their heaviest items only: in descending
    order of weight, the last items of a node that together stay below `least` can't make a pair on their
    own, and the heaviest common item of a pair comes before them in both lists. So light items, which many
    nodes have, are never joined with themselves, and no pair is lost. Where two nodes meet, those that can't share
    enough items are left out (meeting_pairs). Candidates are then weighed on all their items. Items are told apart by 64-bit hashes.
    """
    sums = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, y: acc + y["w"])
    short = F.transform(items, lambda x: F.struct(x["w"].alias("w"), F.xxhash64(x).alias("h")))  # lists travel with every candidate
    sorted_ = lists.select(F.col(node).alias("n"), F.sort_array(short, False).alias("i"), least.alias("t"))
    rests = F.transform("i", lambda x, k: F.struct(x.alias("x"), sums(F.slice("i", k + 1, F.size("i"))).alias("rest")))
    kept = cut_lineage(sorted_.withColumn("head", F.filter(rests, lambda z: z["rest"] >= F.col("t") - 1e-9)).withColumn("k", F.monotonically_increasing_id()))
    near = meeting_pairs(kept)  # numbers, shorter than names
    side = lambda s: kept.select(F.col("k").alias(s), F.col("i").alias(f"i{s}"), F.col("t").alias(f"t{s}"))
    weighed = near.join(side("a"), "a").join(side("b"), "b").withColumn("shared", sums(F.array_intersect("ia", "ib")))
    found = weighed.where(F.col("shared") >= F.greatest("ta", "tb") - 1e-9).select("a", "b", "shared")
    name = lambda s: kept.select(F.col("k").alias(s), F.col("n").alias(f"n{s}"))
    named = found.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("na", "nb").alias("a"), F.greatest("na", "nb").alias("b"), "shared")


def meeting_pairs(lists: DataFrame) -> DataFrame:
    """a < b: pairs of numbers of lists that have an item of their heads in common and may share enough, once each.

    lists: k (a number), i (items: w and h), t (what a pair must share) and head (structs with x, an item). An item sets one of
    128 bits, so each bit that only one list has is an item that isn't shared; of the items that are left, none weighs more than
    the heaviest common one, by which the pair meets too. Most pairs share one item of many: they are dropped there, neither written nor weighed.
    """
    bit = lambda x: F.pmod(x["h"], F.lit(128)).cast("int")
    one = lambda x, half: F.when(F.floor(bit(x) / 64) == half, F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(x))).otherwise(F.lit(0).cast("bigint"))
    bits = lambda half: F.aggregate("i", F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseOR(one(x, half)))
    heads = lists.select(F.struct("k", "t", F.size("i").alias("n"), bits(0).alias("m0"), bits(1).alias("m1")).alias("k"), F.transform("head", lambda z: z["x"]).alias("x")).select("k", F.explode("x").alias("x"))
    alone = lambda p, q, m: F.bit_count(F.col(f"{p}.{m}").bitwiseAND(F.bitwise_not(f"{q}.{m}")))
    left = lambda p, q: F.col(f"{p}.n") - alone(p, q, "m0") - alone(p, q, "m1")
    may = F.col("x.w") * F.least(left("a", "b"), left("b", "a")) >= F.greatest("a.t", "b.t") - 1e-6
    return within_pairs(heads, "x", "k").where(may).select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()


def within_pairs(rows: DataFrame, group: str, item: str, block: int = 256) -> DataFrame:
    """group, a < b: the pairs of distinct items of each group, once each. rows: distinct group and item.

    The items of a large group are spread by hash over blocks of about `block`, and each pair of blocks is joined
    apart, so a group of any size is spread over tasks and none is collected.
    """
    named = rows.select(F.col(group).alias("_g"), F.col(item).alias("i"))
    n = named.groupBy("_g").agg(F.count("*").alias("_n")).where("_n > 1")
    sized = salted_lookup(named, n, "_g", "_n").withColumn("blocks", F.ceil(F.col("_n") / block).cast("int"))
    placed = sized.withColumn("own", F.pmod(F.xxhash64("i"), F.col("blocks")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = placed.select("_g", "i", "own", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"))
    l, r = parts.alias("l"), parts.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("_g", "lo", "hi")]
    met = (F.col("l.i") < F.col("r.i")) & ((F.col("l.own") != F.col("r.own")) | (F.col("l.lo") == F.col("l.hi")))
    return l.join(r, same).where(met).select(F.col("l._g").alias(group), F.col("l.i").alias("a"), F.col("r.i").alias("b"))
