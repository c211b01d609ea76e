"""The graph of related files: edges, communities, insights, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.operators.evaluation import first_hits
from corpusmill.operators.ranking import numbered, overlapping_pairs
from corpusmill.session import cut_lineage


def item_weights(members: DataFrame) -> DataFrame:
    """kind, item, df, w: items of two files or more with the weight that sharing them adds."""
    w = F.when(F.col("kind") == "concept", C.WEIGHT_CONCEPT).otherwise(C.WEIGHT_TAG) / F.log2(F.col("df") + 2.0)
    return members.groupBy("kind", "item").agg(F.count("*").alias("df")).where("df > 1").withColumn("w", w)


def weighed_items(members: DataFrame) -> DataFrame:
    """file_id, items: each file's items with their weights."""
    rows = members.join(item_weights(members), ["kind", "item"]).select("file_id", F.struct("w", "kind", "item").alias("x"))
    return rows.groupBy("file_id").agg(F.collect_list("x").alias("items"))


def vocabulary_edges(members: DataFrame, floor: float = C.MIN_EDGE) -> DataFrame:
    """a < b and vocab: pairs of files whose shared items weigh `floor` or more together. members: distinct file_id, kind, item."""
    return overlapping_pairs(weighed_items(members), "file_id", "items", F.lit(floor)).withColumnRenamed("shared", "vocab")


def weigh_pairs(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """pairs with vocab, the weight of all items they share; files: file_id and items."""
    side = lambda s: files.select(F.col("file_id").alias(s), F.col("items").alias(f"i{s}"))
    shared = F.array_intersect("ia", "ib")
    return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").select("a", "b", F.coalesce(F.aggregate(shared, F.lit(0.0), lambda acc, x: acc + x["w"]), F.lit(0.0)).alias("vocab"))


def link_edges(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """a < b: pairs of files of which one's text links to the other as [[<12 hex digits>__...]]."""
    target = F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([0-9a-f]{12})__"), F.lit(1)))
    links = chunks.where("text IS NOT NULL").select("file_id", target.alias("to")).where("file_id <> to").distinct()
    real = links.join(files.select(F.col("file_id").alias("to")).distinct(), "to", "left_semi")
    return real.select(F.least("file_id", "to").alias("a"), F.greatest("file_id", "to").alias("b")).distinct()


def first_order(members: DataFrame, links: DataFrame, cosines: DataFrame, classes: DataFrame, floor: float = C.MIN_EDGE) -> DataFrame:
    """a, b, weight, vocab, wikilink, embedding: the signals summed, from the floor up.

    cosines: a, b, cosine of pairs of class representatives; classes: id, rep of files with a vector (dense.vector_classes).
    Returned are the pairs that reach the floor by shared items, are linked, are representatives with a cosine, or
    are a member and its representative (cosine 1); each is weighed by all its signals, the cosine by the
    classes of both files. Pairs that only their classes bring together, other than these, are left to the representatives,
    so a class of n copies has n - 1 such edges, not n (n - 1) / 2.
    """
    files = weighed_items(members)
    stars = classes.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))  # rep is the smallest
    other = links.select("a", "b").unionByName(cosines.select("a", "b")).unionByName(stars).distinct()
    below = weigh_pairs(other, files).where(F.col("vocab") < floor - 1e-9)
    pairs = vocabulary_edges(members, floor).unionByName(below)
    rep = lambda s: classes.select(F.col("id").alias(s), F.col("rep").alias(f"r{s}"))
    known = pairs.join(rep("a"), "a", "left").join(rep("b"), "b", "left").withColumn("lo", F.least("ra", "rb")).withColumn("hi", F.greatest("ra", "rb"))
    near = known.join(cosines.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "cosine"), ["lo", "hi"], "left")
    linked = near.join(links.select("a", "b", F.lit(C.WEIGHT_LINK).alias("wikilink")).distinct(), ["a", "b"], "left").fillna(0.0, ["wikilink"])
    cosine = F.when(F.col("ra") == F.col("rb"), 1.0).otherwise(F.coalesce("cosine", F.lit(0.0)))
    signed = linked.withColumn("embedding", C.WEIGHT_EMBEDDING * cosine)
    joined = signed.withColumn("total", F.col("vocab") + F.col("wikilink") + F.col("embedding"))
    return joined.where(F.col("total") >= floor - 1e-9).select("a", "b", F.round("total", 4).alias("weight"), *[F.round(c, 4).alias(c) for c in ("vocab", "wikilink", "embedding")])


def whole_graph(edges: DataFrame, inferred: DataFrame) -> DataFrame:
    """First- and second-order edges with all signals; aa is the second-order one. Inferred edges never feed back into the degrees they came from."""
    zero = [F.lit(0.0).alias(c) for c in ("vocab", "wikilink", "embedding")]
    return edges.withColumn("aa", F.lit(0.0)).unionByName(inferred.select("a", "b", "weight", *zero, F.col("weight").alias("aa")))


def both_ways(edges: DataFrame, *columns: str) -> DataFrame:
    """node, nbr and columns, each edge from either end."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("nbr"), *columns).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("nbr"), *columns))


def second_order(edges: DataFrame, floor: float = C.MIN_EDGE, weight: float = C.WEIGHT_SECOND) -> DataFrame:
    """a, b, weight: pairs without an edge whose common neighbours weigh enough, by Adamic-Adar over the roots of their degrees.

    Degrees are those of the edges given. A neighbour of degree d adds 1 / ln d to its pairs; a pair needs
    sum / sqrt(deg a * deg b) >= floor / weight, so a node's pairs must share at least the root of its own
    degree times that: nodes with many edges, which every pair around them shares for little, are passed over
    where they can't decide (overlapping_pairs).
    """
    adj = both_ways(edges)
    degree = adj.groupBy("node").agg(F.count("*").alias("deg"))
    near = adj.join(degree.where("deg > 1"), "node").select("nbr", F.struct((1 / F.log(F.col("deg"))).alias("w"), F.col("node").alias("z")).alias("x"))
    lists = near.groupBy(F.col("nbr").alias("node")).agg(F.collect_list("x").alias("items")).join(degree, "node")
    pairs = overlapping_pairs(lists, "node", "items", F.lit(floor / weight) * F.sqrt("deg"))
    side = lambda s: degree.select(F.col("node").alias(s), F.col("deg").alias(f"d{s}"))
    scored = pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti").join(side("a"), "a").join(side("b"), "b")
    return scored.withColumn("x", weight * F.col("shared") / F.sqrt(F.col("da") * F.col("db"))).where(F.col("x") >= floor - 1e-9).select("a", "b", F.round("x", 4).alias("weight"))


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 20) -> DataFrame:
    """file_id, community, settled: weighted label propagation, labels renumbered by (size descending, smallest member).

    Every node takes the label with the largest sum of edge weights around it (its own label counts as much
    as its strongest edge; ties to the smaller label), for `rounds` rounds at most or until no label
    changes; settled is false for nodes whose label still changed in the last round. Messages are summed map-side; lineage is cut each round in the shared folder.
    """
    out = cut_lineage(both_ways(edges, "weight"))
    own = out.groupBy("node").agg(F.max("weight").alias("weight"))
    step = cut_lineage(nodes.select(F.col("file_id").alias("node"), F.col("file_id").alias("label"), F.lit(False).alias("moved")).distinct())
    for _ in range(rounds):
        labels = step.select("node", "label")
        heard = out.join(labels.select(F.col("node").alias("nbr"), "label"), "nbr").select("node", "label", "weight")
        heard = heard.unionByName(own.join(labels, "node").select("node", "label", "weight"))
        sums = heard.groupBy("node", "label").agg(F.round(F.sum("weight"), 6).alias("w"))
        best = sums.groupBy("node").agg(F.min_by("label", F.struct((-F.col("w")).alias("w"), "label")).alias("new"))
        step = cut_lineage(labels.join(best, "node", "left").select("node", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("moved")))
        if not step.where("moved").limit(1).count():
            break
    sizes = step.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("least"))
    number = numbered(sizes, [F.desc("size"), "least"], "community").select("label", "community")
    return step.join(number, "label").select(F.col("node").alias("file_id"), "community", (~F.col("moved")).alias("settled"))


def top_concepts(members: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """community, concepts: the k concepts of most of its files, by number and then name, joined by |. members: file_id, kind, item."""
    held = members.where("kind = 'concept'").join(labels.select("file_id", "community"), "file_id").groupBy("community", "item").agg(F.count("*").alias("n"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), "item")
    top = held.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]), "|").alias("concepts"))


def isolated(degree: DataFrame, below: float = C.ISOLATED_BELOW) -> DataFrame:
    """file_id, degree of files whose edges weigh less than `below` together."""
    return degree.where(F.col("degree") < below).select("file_id", "degree")


def sparse_communities(stats: DataFrame, members: DataFrame, labels: DataFrame, size: int = C.SPARSE_SIZE, below: float = C.SPARSE_BELOW) -> DataFrame:
    """community, size, density, concepts of communities of at least `size` files with a density under `below`."""
    few = stats.where((F.col("size") >= size) & (F.col("density") < below))
    return few.join(top_concepts(members, labels), "community", "left").select("community", "size", "density", F.coalesce("concepts", F.lit("")).alias("concepts"))


def community_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """community, size, density: inner edges over possible ones; null for a single member."""
    side = lambda s: labels.select(F.col("file_id").alias(s), F.col("community").alias(f"c{s}"))
    inner = edges.join(side("a"), "a").join(side("b"), "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.count("*").alias("e"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    possible = F.col("size") * (F.col("size") - 1) / 2
    return sizes.join(inner, "community", "left").select("community", "size", F.round(F.when(F.col("size") > 1, F.coalesce("e", F.lit(0)) / possible), 4).alias("density"))


def neighbours(edges: DataFrame, k: int = C.TOP_NEIGHBOURS) -> DataFrame:
    """node, rank, nbr, weight: the k strongest edges of each node, ties to the smaller neighbour."""
    order = Window.partitionBy("node").orderBy(F.desc("weight"), "nbr")
    return both_ways(edges, "weight").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("node", "rank", "nbr", "weight")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """file_id, degree (sum of weights), n_edges; 0 for files without edges."""
    d = both_ways(edges, "weight").groupBy(F.col("node").alias("file_id")).agg(F.sum("weight").alias("degree"), F.count("*").alias("n_edges"))
    return nodes.select("file_id").distinct().join(d, "file_id", "left").select("file_id", F.round(F.coalesce("degree", F.lit(0.0)), 4).alias("degree"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def bridges(edges: DataFrame, labels: DataFrame, least: int = C.BRIDGE_COMMUNITIES) -> DataFrame:
    """file_id, n_communities: files with neighbours in at least `least` communities other than their own."""
    own = labels.select(F.col("file_id").alias("node"), "community")
    other = labels.select(F.col("file_id").alias("nbr"), F.col("community").alias("c"))
    g = both_ways(edges).join(own, "node").join(other, "nbr").where("c <> community").groupBy(F.col("node").alias("file_id")).agg(F.count_distinct("c").alias("n_communities"))
    return g.where(F.col("n_communities") >= least)


def surprising(edges: DataFrame, nodes: DataFrame, labels: DataFrame, top: int = C.SURPRISING_TOP) -> DataFrame:
    """a, b, weight, surprise: the top edges without a link between communities or categories, damped by the lighter end's degree."""
    d = degrees(edges, nodes)
    info = nodes.select("file_id", "category").join(labels, "file_id").join(d, "file_id")
    side = lambda s: info.select(F.col("file_id").alias(s), F.col("category").alias(f"g{s}"), F.col("community").alias(f"c{s}"), F.col("degree").alias(f"d{s}"))
    e = edges.where("wikilink = 0").join(side("a"), "a").join(side("b"), "b").where("ca <> cb OR NOT (ga <=> gb)")
    s = e.select("a", "b", "weight", F.round(F.col("weight") / F.log2(2 + F.least("da", "db")), 4).alias("surprise"))
    return s.orderBy(F.desc("surprise"), "a", "b").limit(top)


def seed_files(hits: DataFrame, most: int = C.SEED_FILES) -> DataFrame:
    """qid, file_id: the first `most` distinct files of each query's whole hit list (qid, file_id, rank)."""
    return first_hits(hits).where(F.col("rank") <= most).select("qid", "file_id")


def expand(seeds: DataFrame, edges: DataFrame, per_seed: int = C.PER_HOP, floor: float = C.EXPAND_FLOOR, seen: DataFrame | None = None) -> DataFrame:
    """qid, file_id, via, score: for each query's seed files their strongest neighbours that aren't seeds, each once, at its best score.

    seeds: qid, file_id. A seed brings at most per_seed neighbours with an edge of at least floor. seen (qid,
    file_id; the seeds if not given) holds the files that aren't brought in again.
    """
    near = seeds.select("qid", F.col("file_id").alias("via")).join(both_ways(edges, "weight"), F.col("via") == F.col("node")).where(F.col("weight") >= floor)
    fresh = near.join((seen if seen is not None else seeds).select("qid", F.col("file_id").alias("nbr")), ["qid", "nbr"], "left_anti")
    order = Window.partitionBy("qid", "via").orderBy(F.desc("weight"), "nbr")
    kept = fresh.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_seed)
    best = kept.groupBy("qid", F.col("nbr").alias("file_id")).agg(F.max_by(F.struct("via", "weight"), F.struct("weight", "via")).alias("w"))
    return best.select("qid", "file_id", "w.via", F.col("w.weight").alias("score"))


def expand_hops(seeds: DataFrame, edges: DataFrame, hops: int = 1, decay: float = C.HOP_DECAY, per_seed: int = C.PER_HOP, floor: float = C.EXPAND_FLOOR) -> DataFrame:
    """qid, file_id, via, score, hop: expansion over several hops; each hop starts from the files the last one brought in and weakens edges by decay before the floor."""
    seen, front, found = seeds.select("qid", "file_id"), seeds.select("qid", "file_id"), None
    for hop in range(1, hops + 1):
        weaker = edges.withColumn("weight", F.col("weight") * F.lit(decay ** (hop - 1)))
        new = cut_lineage(expand(front, weaker, per_seed, floor).join(seen, ["qid", "file_id"], "left_anti").withColumn("hop", F.lit(hop)))
        found = new if found is None else found.unionByName(new)
        front = new.select("qid", "file_id")
        seen = seen.unionByName(front)
    return found
