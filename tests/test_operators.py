import math
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import markdown as M
from corpusmill.functions import urls as U
from corpusmill.functions.text import raw_tokens, token_estimate, word_count
from corpusmill.operators import chunking, delta, dense, duplicates, evaluation, facets, graph, lexical, skew
from corpusmill.operators.dense import cosine_pairs, dense_topk, sign_bands, vector_classes
from corpusmill.operators.fusion import rrf
from corpusmill.functions import titles
from corpusmill.functions.stem import stem_en, stems
from corpusmill.operators.lexical import bm25, expand_acronyms, join_phrases, rerank
from corpusmill.operators.ranking import numbered, within_pairs
from corpusmill.operators.search import Expansion, Filters, neighbours_of, search
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.session import CLEANUP_KEY, cut_lineage
from corpusmill.sources.files import front_matter, parse_markdown, qrel_violations, scan_tree


def one(spark, expr, schema, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(expr).collect()]


def test_words_and_tokens(spark):
    values = ["a b c　d", "", None, "   "]
    assert one(spark, word_count(F.col("t")), "t string", *values) == [4, 0, None, 0]
    assert one(spark, token_estimate(F.col("t")), "t string", "a b c d e", "") == [6, 1]
    assert one(spark, raw_tokens(F.col("t")), "t string", "The über Goal-drift x1 9z") == [["the", "ber", "goal-drift", "x1"]]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("HTTPS://www.Example.org/a/b/?utm_source=x&id=3&ref=q#frag", "https://example.org/a/b?id=3"),
        ("http://example.org:8080/", "http://example.org:8080"), ("no url", ""), ("", ""), (None, ""), ("https://e.org/?reference=1", "https://e.org"),
    ],
)
def test_canonical_url(spark, raw, want):
    assert one(spark, U.canonical_url(F.col("u")), "u string", raw) == [want]


def test_indexable(spark):
    paths = ["a/b.md", ".x/a.md", "a/_trash/b.md", "_add_by_me/a.md", "_index/a.md", "_index/saved_queries/a.md", "_logs/l.md", "README.md", "a/README.md", "_x.md", "a/_audit_1.md"]
    assert one(spark, U.indexable(F.col("p")), "p string", *paths) == [True, False, False, False, False, True, False, False, True, False, False]


def test_hash_bucket_is_the_big_modulus(spark):
    import hashlib

    ids = ["q1", "q2", "", "ü"]
    want = [int(hashlib.sha1(x.encode()).hexdigest(), 16) % 100 for x in ids]
    assert one(spark, evaluation.hash_bucket(F.col("q")), "q string", *ids) == want


def test_bm25_ranks_the_unique_term_first_and_counts_empty_rows(spark):
    pool = spark.createDataFrame([("f1", "c0", "alpha beta beta", "T", ""), ("f2", "c0", "alpha gamma", None, None), ("f3", "c0", None, "beta", "beta"), ("f4", "c0", "", "x", "y")], "file_id string, chunk_id string, text string, title string, heading_path string")
    asked = spark.createDataFrame([(1, "beta beta"), (2, "nothing"), (3, "")], "qid int, query string")
    got = bm25(asked, pool, ["file_id", "chunk_id"]).collect()
    idf = math.log((4 - 1 + 0.5) / 1.5 + 1)
    want = idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 4)))
    assert [(r.qid, r.file_id, r["rank"]) for r in got] == [(1, "f1", 1)] and abs(got[0].score - want) < 1e-4
    empty = pool.where("false")
    assert bm25(asked, empty, ["file_id", "chunk_id"]).count() == 0


def test_phrases_join_longest_first(spark):
    assert one(spark, join_phrases(F.split("t", " "), [["goal", "drift"], ["latent", "goal", "drift"], ["x"]]), "t string", "a latent goal drift b goal drift goal") == [["a", "latent_goal_drift", "b", "goal_drift", "goal"]]


def test_rrf_merges_and_caps(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "qid int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "qid int, k string, rank int")
    got = rrf([a, b], ["k"], 2).orderBy("rank").collect()
    assert [r.k for r in got] == ["y", "x"] and abs(got[0].score - (1 / 62 + 1 / 61)) < 1e-6
    assert rrf([a, b.where("false")], ["k"], 9).count() == 2


def test_metrics(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "a", 3), ("q", "c", 4)], "qid string, file_id string, rank int")
    rel = spark.createDataFrame([("q", "a"), ("q", "c"), ("q", "c"), ("r", "z")], "qid string, file_id string")
    got = {r.qid: r for r in evaluation.per_query(hits, rel).collect()}
    assert got["q"].recall == 1.0 and abs(got["q"].ndcg - 1.5 / 1.63093) < 1e-4 and got["q"].rr == 1.0
    assert got["r"].recall == 0 and got["r"].first_hit is None
    assert {r.qid: r.state for r in evaluation.compare(evaluation.per_query(hits, rel), evaluation.per_query(hits.where("file_id <> 'a'"), rel)).collect()} == {"q": "worse", "r": "same"}


def test_last_version_and_delta(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", None, "z"), (None, 1, "n")], "k string, at int, v string")
    assert {(r.k, r.v) for r in delta.last_version(rows, ["k"], ["at"]).collect()} == {("a", "y"), (None, "n")}
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, d string")
    old = spark.createDataFrame([("1",), ("1",), ("9",), (None,)], "d string")
    assert {r.state: r.n for r in delta.hash_delta(now, old, "k", "d").collect()} == {"reused": 1, "encoded": 2, "dropped": 1}
    a, b = (delta.fingerprint(rows.orderBy(o), ["k", "at", "v"]).first() for o in ("v", F.desc("v")))
    assert a == b and delta.fingerprint(rows.where("false"), ["k"]).first().n == 0


def test_subset_groups_are_left_out(spark):
    keys = spark.createDataFrame([(1, "canonical_url", "u"), (2, "canonical_url", "u"), (3, "canonical_url", "u"), (1, "title_host", "t"), (2, "title_host", "t"), (3, "hash_suffix", "s"), (4, "hash_suffix", "s"), (5, "hash_suffix", "alone")], "row_id int, group_type string, group_key string")
    assert {r.group_key for r in duplicates.duplicate_groups(keys).collect()} == {"u", "s"}


def test_chunker_rules():
    long = " ".join(f"Word{i} is here." for i in range(500))
    body = f"# A\n\nshort text\n\n### C\n\n{long}\n\n# B\nend"
    got = chunking.chunks_of(body)
    assert got[0] == ("A", "short text") and got[1][0] == "A > C" and got[-1][0] == "B"
    assert all(" ... " in t for _, t in got[2:]) and len(got[2][1].split(" ... ")[0].split()) == 37
    assert got[1][1].startswith("Word0")  # the chunk before has few words: no overlap
    assert chunking.chunks_of("") == []
    giant = "x " * 2000
    assert [chunking.tokens_of(t) for _, t in chunking.chunks_of(giant)] == [2666]  # one sentence stays whole


def test_chunk_documents_ignores_null_and_blank(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "  \n", 0), (3, "one", 0)], "doc_id long, text string, chunk_id int")
    assert [(r.doc_id, r.chunk_id) for r in chunking.chunk_documents(df, "doc_id", "text").collect()] == [(3, "c0000")]


def _members(spark, files):
    return spark.createDataFrame([(f, "concept", c) for f, cs in files.items() for c in cs], "file_id string, kind string, item string")


def test_vocabulary_edges_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(1)
    files = {f"f{i:02d}": {f"c{int(r.paretovariate(0.8)) % 25}" for _ in range(6)} for i in range(40)}
    df = {c: sum(c in x for x in files.values()) for c in {c for x in files.values() for c in x}}
    for floor in (0.4, 0.8, 1.5):
        want = {}
        for a, b in itertools.combinations(sorted(files), 2):
            w = sum(1 / math.log2(2 + df[c]) for c in files[a] & files[b] if df[c] > 1)
            if w >= floor - 1e-9:
                want[a, b] = w
        got = {(x.a, x.b): x.vocab for x in graph.vocabulary_edges(_members(spark, files), floor).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_second_order_equals_brute_force(spark):
    import itertools
    import random

    r = random.Random(2)
    edges = {tuple(sorted(r.sample(range(25), 2))) for _ in range(45)}
    near = {n: {b if a == n else a for a, b in edges if n in (a, b)} for n in range(25)}
    want = {}
    for a, b in itertools.combinations(range(25), 2):
        if (a, b) not in edges and near[a] & near[b]:
            s = sum(1 / math.log(len(near[z])) for z in near[a] & near[b])
            if (w := 4 * s / math.sqrt(len(near[a]) * len(near[b]))) >= 1 - 1e-9:
                want[a, b] = round(w, 4)
    e = spark.createDataFrame([(a, b, 1.0) for a, b in edges], "a int, b int, weight double")
    got = {(x.a, x.b): x.weight for x in graph.second_order(e).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)


def test_communities_split_two_cliques(spark):
    pairs = [(a, b) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w")]
    e = spark.createDataFrame([(a, b, 2.0 if (a, b) != ("d", "w") else 0.5, 0.0) for a, b in pairs], "a string, b string, weight double, wikilink double")
    nodes = spark.createDataFrame([(n, "k") for n in "abcdwxyzq"], "file_id string, category string")
    labels = graph.communities(e, nodes)
    got = {r.file_id: r.community for r in labels.collect()}
    assert {got[n] for n in "abcd"} == {0} and {got[n] for n in "wxyz"} == {1} and got["q"] == 2
    stats = {r.community: r.density for r in graph.community_stats(e, labels).collect()}
    assert stats == {0: 1.0, 1: 1.0, 2: None}
    assert [(r.a, r.b) for r in graph.surprising(e, nodes, labels).collect()] == [("d", "w")]


def test_expand_takes_the_best_of_each_seed(spark):
    e = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 2.0), ("b", "d", 8.0)], "a string, b string, weight double")
    seeds = spark.createDataFrame([(1, "a"), (1, "b")], "qid int, file_id string")
    assert [(r.file_id, r.via, r.score) for r in graph.expand(seeds, e).collect()] == [("d", "b", 8.0)]


def test_dense_topk_equals_brute_force_in_tiles(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (60, 6)).astype(float) + 0.01  # many ties
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), "z") for i, v in enumerate(x)], "id long, vector array<double>, qid string")
    s = np.round(x @ x.T, 9)
    asked = df.where("id % 4 = 0").select(F.col("id").alias("qid"), "vector")
    for tile in (7, 1000):
        found: dict = {}
        for r in dense_topk(asked, df, "id", "vector", 5, tile=tile).orderBy("qid", "rank").collect():
            found.setdefault(r.qid, []).append(r.id)
        assert found == {q: sorted(range(60), key=lambda j: (-s[q, j], j))[:5] for q in range(0, 60, 4)}
    assert dense_topk(asked.where("false"), df, "id", "vector", 5).count() == 0
    assert dense_topk(asked, df.where("false"), "id", "vector", 5).count() == 0
    assert dense_topk(asked, df.limit(2), "id", "vector", 5).count() == 30


def test_cosine_pairs_recall_and_classes(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 24))
    x = np.vstack([base, base + 0.1 * rng.standard_normal((300, 24)), base[:40], base[:1], base[:1]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    s = x @ x.T
    classes = {r.id: (r.rep, r.copies) for r in vector_classes(df, "id", "vector").collect()}
    assert all(classes[600 + i] == (i, 4 if i == 0 else 2) for i in range(40)) and classes[640] == classes[641] == (0, 4) and classes[300] == (300, 1)
    got = {(r.a, r.b) for r in cosine_pairs(df, "id", "vector", 0.88).collect()}
    linked = {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.88}
    assert got <= linked and len(got) >= 0.99 * len(linked) > 100
    for n in (10, 10**5, 10**7, 10**9):
        bits, bands = sign_bands(n, 0.88)
        assert n / 2**bits <= 4 and (1 - (1 - math.acos(0.88) / math.pi) ** bits) ** bands <= 2e-4


def test_salted_lookup_keeps_every_row(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = salted_lookup(rows, counts, "k", "n", hot_rows=500)
    assert got.count() == 5000 and got.where("k = 'hot'").select("n").distinct().collect()[0].n == 1667
    assert hot_threshold(10**9) == 100_000


def test_numbered(spark):
    rows = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int").repartition(5)
    assert [r.n for r in numbered(rows, ["v"], "n").orderBy("v").collect()] == list(range(101))
    assert numbered(rows.where("false"), ["v"], "n").count() == 0


def test_facets_handle_nulls(spark):
    df = spark.createDataFrame([("f", [" A ", "a", None, ""]), ("g", ["a"]), ("g", None), (None, ["a"])], "file_id string, tags array<string>")
    assert [(r.tag, r.n_files) for r in facets.count_files(df, "tags", "tag").collect()] == [("a", 2)]


def test_tree_scan_and_front_matter(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_trash").mkdir()
    (tmp_path / "a" / "x.md").write_text("---\ntitle: Some: thing\ntags: [p, 'q']\nconcepts:\n  - One\n  - Two\n---\nbody\n")
    (tmp_path / "_trash" / "y.md").write_text("gone")
    (tmp_path / "README.md").write_text("meta")
    got = parse_markdown(scan_tree(spark, str(tmp_path))).collect()
    assert [(r.relpath, r.body) for r in got] == [("a/x.md", "body\n")]
    assert got[0].fields == {"title": "Some: thing", "tags": "p|q", "concepts": "One|Two"}
    assert front_matter(None) == ({}, "") and front_matter("no block")[0] == {}


def test_qrel_violations(spark):
    good = '{"qid":"1","query":"q","relevant_file_ids":["a"],"source":"synthetic","split":"dev"}'
    lines = [(1, good), (2, ""), (3, "{nope"), (4, good), (5, good.replace('"1"', '"2"').replace("dev", "x")), (6, good.replace('"1"', '"3"').replace('["a"]', "[]"))]
    got = {(r.line, r.problem) for r in qrel_violations(spark.createDataFrame(lines, "line int, value string")).collect()}
    assert got == {(3, "not a record"), (4, "qid occurs twice"), (5, "unknown split"), (6, "no relevant files")}


@pytest.mark.parametrize(
    "word, stem",
    [
        ("consistency", "consist"), ("knocking", "knock"), ("generously", "generous"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("relational", "relat"),
        ("happily", "happili"), ("skies", "sky"), ("news", "news"), ("argument", "argument"), ("rate", "rate"), ("rolling", "roll"), ("communication", "communic"), ("goal_drift", "goal_drift"), ("by", "by"), ("replacement", "replac"), ("adoption", "adopt"),
    ],
)
def test_stem(word, stem):
    assert stem_en(word) == stem


def test_stems_once_per_term(spark):
    df = spark.createDataFrame([("running",), ("running",), (None,)], "term string")
    assert [(r.term, r.stem) for r in stems(df).collect()] == [("running", "run")]


def test_acronyms_both_ways(spark):
    got = one(spark, expand_acronyms(F.split("t", " "), {"LGD": ["latent", "goal", "drift"]}), "t string", "lgd x", "a latent goal drift", "goal latent drift")
    assert got == [["lgd", "x", "latent", "goal", "drift"], ["a", "latent", "goal", "drift", "lgd"], ["goal", "latent", "drift"]]


def test_rerank_orders_by_overlap(spark):
    pool = spark.createDataFrame([("a", "red fish"), ("b", "red blue fish"), ("c", None)], "k string, text string")
    asked = spark.createDataFrame([(1, "blue fish")], "qid int, query string")
    got = rerank(pool.select(F.lit(1).alias("qid"), "k"), asked, pool, ["k"], 2).orderBy("rank").collect()
    assert [(r.k, r.score) for r in got] == [("b", 1.0), ("a", 0.5)]


def test_titles(spark):
    f = titles.fixed_title(F.col("t"), F.lit("https://e.org/a/some-good-title-0a1b2c3d"), F.lit("x_0a1b2c3d.pdf"))
    assert [tuple(r) for r in one(spark, f, "t string", "Fine", None, "untitled", "T H E  C O S T")] == [("Fine", ""), ("Some Good Title", "from url"), ("Some Good Title", "from url"), ("THE COST", "spaced capitals")]
    assert one(spark, titles.looks_like_authors(F.col("t")), "t string", "Ana Vidal, Ben Roe", "A Title", None) == [True, False, False]


def test_small_capitals(spark):
    values = ["L ANGUAGE M ODELS ARE F EW", "A TLAS OF B", "THE COST", "Plain A title", None]
    assert one(spark, titles.join_small_capitals(F.col("t")), "t string", *values) == ["Language Models ARE Few", "Atlas OF B", "THE COST", "Plain A title", None]


def test_expand_hops_decay(spark):
    e = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 8.0)], "a string, b string, weight double")
    seeds = spark.createDataFrame([(1, "a")], "qid int, file_id string")
    assert [r.file_id for r in graph.expand_hops(seeds, e, 1).collect()] == ["b"]
    assert sorted(r.file_id for r in graph.expand_hops(seeds, e, 2, 0.5).collect()) == ["b", "c"]
    assert [r.file_id for r in graph.expand_hops(seeds, e, 2, 0.25).collect()] == ["b"]


def test_front_fields_fences_and_marked_names(spark):
    texts = ["---\ntitle: 'A b'\ntags: [x]\n---\nbody `one` and `two`\n```\na\nb\n```\nend", "no block\n---\nx: y", "```\nopen", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select(M.front_fields(F.col("t")).alias("f"), M.code_lines(F.col("t")).alias("c"), M.marked_names(F.col("t")).alias("m"), M.field_line(F.col("t"), "x").alias("x")).orderBy("i").collect()
    assert [(p.field, p.value) for p in got[0].f] == [("title", "A b"), ("tags", "[x]")] and got[1].f == [] and got[4].f is None
    assert [(r.c.fences, r.c.lines) for r in got[:4]] == [(2, 2), (0, 0), (1, 1), (0, 0)] and got[4].c is None
    assert got[0].m == ["one", "two"] and [r.x for r in got] == [None, "y", None, None, None]
    assert df.where("i = 1").select(M.with_field(F.col("t"), "x", "$1")).first()[0] == "no block\n---\nx: $1"


def test_fetched_url_and_change_rules(spark):
    df = spark.createDataFrame([("https://arxiv.org/abs/2101.01234v2", "2024-05-05", "A B"), (" https://a.example/x ", "2020-01-01", "CONTRIBUTORS here"), ("x", "2030-02-02", "n" * 201), (None, "spring", None)], "u string, p string, a string")
    day = F.lit("2024-05-05").cast("date")
    got = df.select(U.fetched_url(F.col("u")), U.day_problem(F.col("p"), day), U.author_problem(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("https://arxiv.org/pdf/2101.01234.pdf", "today", None), ("https://a.example/x", "first of January", "contains CONTRIBUTORS"), ("x", "in the future", "too long"), (None, None, None)]


def test_groups_of_any_size_keep_their_rows(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 3)
    keys = [(i, "canonical_url", "u") for i in range(20)] + [(i, "title_host", "t") for i in range(10)] + [(i, "hash_suffix", "s") for i in range(15, 25)] + [(30, "title_host", "alone")]
    df = spark.createDataFrame(keys, "row_id long, group_type string, group_key string")
    groups = duplicates.duplicate_groups(df)
    assert sorted((r.group_type, r.row_id, r["size"]) for r in groups.collect()) == sorted([("canonical_url", i, 20) for i in range(20)] + [("hash_suffix", i, 10) for i in range(15, 25)])
    scored = spark.createDataFrame([(i, 5 if i in (7, 9, 22) else 1) for i in range(31)], "row_id long, richness int")
    assert sorted((r.group_type, r.row_id) for r in duplicates.winners(groups, scored).where("winner").collect()) == [("canonical_url", 7), ("hash_suffix", 22)]
    assert duplicates.duplicate_groups(df.where("false")).count() == 0


def test_refetch_guard_keeps_sources_without_a_suffix(spark, tmp_path):
    import hashlib

    from corpusmill.plans import ingest

    sha = lambda u: hashlib.sha1(u.encode()).hexdigest()[:8]
    rows = [
        (1, "a_0a0a0a0a.md", "https://e.org/1"), (2, "b.md", "https://e.org/2"), (3, "c.md", " https://e.org/2 "), (4, "d.md", "https://e.org/4"), (5, "e.md", None), (6, "f.md", " "), (7, None, "https://e.org/7"),
        (8, "g.md", "https://arxiv.org/abs/2101.01234v2"), (9, "h.md", "https://arxiv.org/abs/2202.00002"), (10, "i.md", "https://arxiv.org/html/2202.00002"), (11, "j_0b0b0b0b.md", "https://e.org/11"),
    ]
    files = [(f"x/y_{sha('https://e.org/4')}.md",), ("x/arxiv_2101.01234_ffffffff.pdf",), (f"x/_trash/y_{sha('https://e.org/7')}.md",), ("z_0a0a0a0a.md",)]
    spark.createDataFrame(rows, "row_id long, filename string, url string").write.parquet(str(tmp_path / "notion_sources.parquet"))
    spark.createDataFrame(files, "relpath string").write.parquet(str(tmp_path / "files.parquet"))
    got = {r.row_id: r.h for r in ingest.refetch_guard_addresses(spark, str(tmp_path)).collect()}
    assert got == {2: sha("https://e.org/2"), 7: sha("https://e.org/7"), 9: sha("https://arxiv.org/pdf/2202.00002.pdf"), 11: "0b0b0b0b"}


def test_copies_are_linked_through_their_class(spark):
    copy, near = [1.0, 0.0, 0.0, 0.0], [0.96, 0.28, 0.0, 0.0]
    df = spark.createDataFrame([(str(i), copy) for i in range(5)] + [("5", near), ("6", near), ("7", [0.0, 0.0, 1.0, 0.0])], "id string, vector array<double>")
    classes, pairs = vector_classes(df, "id", "vector"), cosine_pairs(df, "id", "vector", 0.88)
    assert [(r.a, r.b, round(r.cosine, 6)) for r in pairs.collect()] == [("0", "5", 0.96)]
    members = spark.createDataFrame([("1", "tag", "x"), ("6", "tag", "x"), ("2", "concept", "y"), ("4", "concept", "y")], "file_id string, kind string, item string")
    links = spark.createDataFrame([("3", "7")], "a string, b string")
    edges = {(r.a, r.b): (r.embedding, r.vocab, r.wikilink) for r in graph.first_order(members, links, pairs, classes, 0.2).collect()}
    stars = {("0", str(i)): (2.0, 0.0, 0.0) for i in range(1, 5)} | {("5", "6"): (2.0, 0.0, 0.0)}
    assert edges == stars | {("0", "5"): (1.92, 0.0, 0.0), ("1", "6"): (1.92, 0.25, 0.0), ("2", "4"): (2.0, 0.5, 0.0), ("3", "7"): (0.0, 0.0, 3.0)}


def test_second_order_edges_join_the_graph(spark):
    e = spark.createDataFrame([("a", "z", 1.0, 0.0, 0.0, 0.0), ("b", "z", 1.0, 0.0, 0.0, 0.0)], "a string, b string, weight double, vocab double, wikilink double, embedding double")
    whole = graph.whole_graph(e, graph.second_order(e, 0.5))
    assert {(r.a, r.b): (r.weight, r.aa) for r in whole.collect()} == {("a", "z"): (1.0, 0.0), ("b", "z"): (1.0, 0.0), ("a", "b"): (5.7708, 5.7708)}


def test_insights(spark):
    labels = spark.createDataFrame([(f"f{i}", 0, True) for i in range(6)] + [("g", 1, True)], "file_id string, community int, settled boolean")
    edges = spark.createDataFrame([("f0", "f1", 0.4), ("f1", "f2", 3.0)], "a string, b string, weight double")
    members = spark.createDataFrame([("f0", "concept", "y"), ("f1", "concept", "y"), ("f1", "concept", "x"), ("f2", "concept", "w"), ("f3", "concept", "v"), ("f0", "tag", "t")], "file_id string, kind string, item string")
    degree = graph.degrees(edges, labels)
    assert {r.file_id for r in graph.isolated(degree).collect()} == {"f0", "f3", "f4", "f5", "g"}
    found = graph.sparse_communities(graph.community_stats(edges, labels), members, labels).collect()
    assert [(r.community, r.size, r.density, r.concepts) for r in found] == [(0, 6, 0.1333, "y|v|w")]


def _deliveries(spark):
    """Chunks with older versions, repeated rows and a version out of place."""
    rows = [
        ("f1", "c0", 1, "old words about tides", "T", "H", ["a"], "md"), ("f1", "c0", 2, "tides tides here", "Tides", "H", ["a"], "md"), ("f1", "c0", 2, "tides tides here", "Tides", "H", ["a"], "md"),
        ("f2", "c0", 5, "goal drift", "G", "H", ["b"], "md"), ("f2", "c0", 3, "tides tides tides tides", "G", "H", ["a"], "md"), ("f2", "c1", 5, None, None, None, None, "md"),
        ("f3", "c0", None, "tides once and goal", "X", "tides", ["a"], "pdf"),
    ]
    df = spark.createDataFrame(rows, "file_id string, chunk_id string, at long, text string, title string, heading_path string, tags array<string>, kind string")
    more = df.select("*", F.timestamp_seconds("at").alias("indexed_at"), F.concat("file_id", F.lit("."), "kind").alias("relpath"), F.lit(1).alias("tokens"), F.col("tags").alias("concepts"), F.lit("c").alias("category"), F.lit("s").alias("subcategory"))
    return more.drop("at", "kind")


def test_bm25_over_deliveries_equals_bm25_over_current_rows(spark):
    rows = _deliveries(spark)
    asked = spark.createDataFrame([(1, "tides"), (2, "goal tides"), (3, "nothing"), (4, None)], "qid int, query string")
    once = delta.current_chunks(rows, "text", "title", "heading_path")
    assert {(r.file_id, r.chunk_id): r.text for r in once.collect()} == {("f1", "c0"): "tides tides here", ("f2", "c0"): "goal drift", ("f2", "c1"): None, ("f3", "c0"): "tides once and goal"}
    narrow = delta.current_chunks(rows, "title", text=False)
    assert {(r.file_id, r.chunk_id): r.title for r in narrow.collect()} == {(r.file_id, r.chunk_id): r.title for r in once.collect()}
    want = [tuple(r) for r in bm25(asked, once, delta.KEYS).orderBy("qid", "rank").collect()]
    got = [tuple(r) for r in bm25(asked, rows, delta.KEYS, current=lexical.current_lengths(rows)).orderBy("qid", "rank").collect()]
    assert got == want and len(got) == 5
    assert bm25(asked, rows.where("false"), delta.KEYS, current=lexical.current_lengths(rows.where("false"))).count() == 0
    assert bm25(asked.where("false"), rows, delta.KEYS).count() == 0


def test_search_modes_filters_and_expansion(spark):
    rows = _deliveries(spark)
    vectors = spark.createDataFrame([("f1", "c0", [1.0, 0.0]), ("f2", "c0", [0.0, 1.0]), ("f3", "c0", [0.6, 0.8])], "file_id string, chunk_id string, vector array<double>")
    asked = spark.createDataFrame([(1, "tides", [0.0, 1.0]), (2, None, [1.0, 0.0]), (3, "zzz", None)], "qid int, query string, vector array<double>")
    run = lambda **how: [(r.qid, r.file_id, r.source) for r in search(asked, rows, vectors=vectors, **how).orderBy("qid", "rank").collect()]
    assert run() == [(1, "f1", None), (1, "f3", None)]
    assert run(filters=Filters(file_type="pdf")) == [(1, "f3", None)] and run(filters=Filters(tag="b")) == [] and run(filters=Filters(concept="a", category="c"), k=1) == [(1, "f1", None)]
    assert run(mode="semantic", k=2) == [(1, "f2", None), (1, "f3", None), (2, "f1", None), (2, "f3", None)]
    edges = spark.createDataFrame([("f1", "f2", 4.0), ("f1", "f4", 9.0)], "a string, b string, weight double")
    wide = run(mode="hybrid", k=8, edges=edges, filters=Filters(file_type="md"))
    assert set(wide) == {(1, "f1", None), (1, "f2", None), (2, "f1", None), (2, "f2", None)}
    lexical_only = search(asked.withColumn("vector", F.lit(None).cast("array<double>")), rows, mode="hybrid", vectors=vectors, edges=edges, filters=Filters(file_type="md"), columns=["title"]).orderBy("rank").collect()
    assert [(r.file_id, r.chunk_id, r.source, r.score > 0) for r in lexical_only] == [("f1", "c0", None, True), ("f2", "c0", "graph_expansion", False)]
    again = search(asked, rows, mode="hybrid", vectors=vectors, edges=edges, reranked=True, k=1).collect()
    assert {(r.qid, r.file_id) for r in again} == {(1, "f1"), (2, "f1")}
    assert search(asked, rows.where("false"), mode="hybrid", vectors=vectors, edges=edges).count() == 0
    with pytest.raises(ValueError):
        search(asked, rows, mode="other")


def test_expansion_decays_over_hops_and_stays_in_the_pool(spark):
    edges = spark.createDataFrame([("a", "b", 4.0), ("b", "c", 8.0), ("c", "d", 30.0), ("a", "x", 9.0)], "a string, b string, weight double")
    hits = spark.createDataFrame([(1, "a", 1)], "qid int, file_id string, rank int")
    pool = spark.createDataFrame([(f,) for f in "abcd"], "file_id string")
    bring = lambda hops: sorted(r.file_id for r in neighbours_of(hits, edges, pool, Expansion(hops=hops)).collect())
    assert bring(1) == ["b"] and bring(2) == ["b", "c"] and bring(3) == ["b", "c", "d"]


def test_pairs_within_groups_of_any_size(spark):
    import itertools

    rows = [("big", f"i{i}") for i in range(40)] + [("small", "i1"), ("small", "i2"), ("one", "i1")]
    df = spark.createDataFrame(rows, "g string, item string")
    for block in (3, 256):
        got = [(r.g, r.a, r.b) for r in within_pairs(df, "g", "item", block).collect()]
        assert len(got) == len(set(got)) and set(got) == {("big", *p) for p in itertools.combinations(sorted(f"i{i}" for i in range(40)), 2)} | {("small", "i1", "i2")}
    df = spark.createDataFrame([("f", ["a", "b", "c"]), ("g", ["b", "a"]), ("h", None)], "file_id string, tags array<string>")
    assert {(r.term, r.other): (r.shared, r.jaccard) for r in facets.related_terms(df, "tags").collect()} == {("a", "b"): (2, 1.0), ("b", "a"): (2, 1.0), ("a", "c"): (1, 0.5), ("c", "a"): (1, 0.5), ("b", "c"): (1, 0.5), ("c", "b"): (1, 0.5)}


def test_title_groups_need_a_member_outside_of_address_groups(spark):
    rows = [(1, "https://e.org/1", "T", "x_aaaaaaaa.md"), (2, "https://e.org/1", "U", "y_bbbbbbbb.md"), (3, "https://e.org/3", "T", "x_cccccccc.md"), (4, "https://e.org/3", "V", "z.md"), (5, "https://e.org/5", "W", "x_aaaaaaaa.md"), (6, "https://e.org/6", "W", "w.md")]
    df = spark.createDataFrame(rows, "row_id long, url string, title string, filename string")
    got = duplicates.duplicate_groups(duplicates.keyed(df)).groupBy("group_type").agg(F.sort_array(F.collect_list("row_id")).alias("r")).collect()
    assert {r.group_type: r.r for r in got} == {"canonical_url": [1, 2, 3, 4], "title_host": [5, 6], "hash_suffix": [1, 5]}
    same = spark.createDataFrame([(1, "a", "f_aaaaaaaa.md"), (2, "a", "g_aaaaaaaa.md"), (3, "b", None), (4, None, None)], "doc_id long, text string, relpath string")
    assert [(r.group_type, r.doc_id) for r in duplicates.duplicate_groups(duplicates.keyed(same, "doc_id", None, None, "relpath", "text"), "doc_id").orderBy("doc_id").collect()] == [("content_hash", 1), ("content_hash", 2)]


def test_dense_lists_do_not_grow_with_small_tiles():
    from corpusmill.operators.dense import row_tiles

    assert row_tiles(400_000, 8192, 6) == 13 and row_tiles(48_000, 8192, 6) == 6 and row_tiles(0, 8192, 6) == 1


def test_earlier_runs(spark):
    ids = spark.createDataFrame([(1, "x"), (2, "x"), (3, None)], "row_ix long, sha1 string")
    now = spark.createDataFrame([("k1", "x"), ("k2", "y"), ("k3", None)], "k string, sha1 string")
    assert {r.k: r.row_ix for r in delta.reusable(now, ids, "sha1", "row_ix").collect()} == {"k1": 1, "k2": None, "k3": None}
    check = lambda m: delta.run_validity(spark.createDataFrame(m, "row_ix long, v array<float>"), ids, "row_ix", "v").collect()[0].state
    assert [check([(1, [1.0]), (2, [1.0]), (3, [2.0])]), check([(1, [1.0]), (2, [1.0])]), check([(1, [1.0]), (2, [1.0, 2.0]), (3, [1.0])]), check([])] == ["valid", "ids and vectors differ", "lengths differ", "no vectors"]


def test_stream_batches_append_what_is_new(spark, tmp_path):
    from corpusmill.streaming.log import append_unseen

    each = append_unseen(str(tmp_path / "out"), ["k"], "k string", spark.createDataFrame([("known",)], "k string"))
    batch = lambda *v: spark.createDataFrame([(x,) for x in v], "k string")
    for number, rows in [(0, ("a", "a", "known")), (1, ("a", "b", None)), (1, ("a", "b", None)), (2, ("b", None, "c"))]:
        each(batch(*rows), number)
    assert sorted((r.k or "") for r in spark.read.schema("k string").parquet(str(tmp_path / "out")).select("k").collect()) == ["", "a", "b", "c"]


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from corpusmill.session import ensure_checkpoint_dir

    nothing = N(isDefined=lambda: False)
    session = N(sparkContext=N(master="spark://host:7077", _jsc=N(sc=lambda: N(getCheckpointDir=lambda: nothing)), getConf=lambda: N(get=lambda *a: None)), conf=N(get=lambda *a: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_bm25_matches_inflected_forms_acronyms_and_phrases(spark):
    from corpusmill.operators.lexical import Lexicon

    keys = ["file_id", "chunk_id"]
    pool = spark.createDataFrame(
        [("f1", "c0", "agents drifting drifted", "Drifts", "drift"), ("f2", "c0", "latent goal drift", None, None), ("f3", "c0", "goal of latent things", None, None), ("f4", "c0", "other words here now", None, None)],
        "file_id string, chunk_id string, text string, title string, heading_path string",
    )
    asked = spark.createDataFrame([(1, "drift"), (2, "LGD"), (3, "goal")], "qid int, query string")
    full = Lexicon([["latent", "goal", "drift"], ["goal", "drift"]], {"LGD": ["latent", "goal", "drift"]}, True)
    got = {(r.qid, r.file_id): r.score for r in bm25(asked, pool, keys, lexicon=full).collect()}
    assert set(got) == {(1, "f1"), (2, "f2"), (3, "f3")}
    idf = math.log((4 - 1 + 0.5) / 1.5 + 1)  # one text of four holds the stem, twice among its 3 tokens; lengths are 3, 1, 4, 4
    assert abs(got[1, "f1"] - (idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 3)) + 0.5 + 0.3)) < 1e-4
    assert {(r.qid, r.file_id) for r in bm25(asked, pool, keys).collect()} == {(1, "f1"), (1, "f2"), (3, "f2"), (3, "f3")}


def test_phrases_join_from_the_left(spark):
    assert one(spark, join_phrases(F.split("t", " "), [["a1", "b1"], ["b1", "c1", "d1"]]), "t string", "a1 b1 c1 d1 a1 b1 a1 b1", "x a1 a1 b1 b1") == [["a1_b1", "c1", "d1", "a1_b1", "a1_b1"], ["x", "a1", "a1_b1", "b1"]]


def test_expansion_seeds_are_five_files_of_the_whole_list(spark, monkeypatch):
    from corpusmill.plans import graph as plan

    hits = [("a", i) for i in range(1, 8)] + [("b", 8), ("a", 9), ("c", 10), ("d", 11), ("e", 12), ("f", 13)]
    monkeypatch.setattr(plan, "_hits", lambda s, d, lex: spark.createDataFrame([(1, f, f"c{r}", r) for f, r in hits], "qid int, file_id string, chunk_id string, rank int"), raising=False)
    edges = [("a", "n1", 2.0), ("e", "n2", 2.0), ("f", "n3", 2.0), ("a", "f", 9.0), ("b", "n4", 1.0)]
    monkeypatch.setattr(plan, "_graph", lambda s, d: spark.createDataFrame(edges, "a string, b string, weight double"))
    assert sorted((r.file_id, r.via) for r in plan.expanded(spark, "").collect()) == [("n1", "a"), ("n2", "e")]


def _shuffle_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(p) for f in folders for p in Path(f.toString()).rglob("shuffle_*")}


def test_shuffles_of_kept_results_are_removed(spark):
    before = _shuffle_files(spark)
    kept = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).agg(F.count("*").alias("n")))
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left
    assert kept.agg(F.sum("n")).first()[0] == 1000
    assert spark.conf.get(CLEANUP_KEY) == "false"


def test_bands_meet_in_passes(spark, monkeypatch):
    assert dense.band_passes(40_000, 62) == [(0, 62)]
    assert [x for lo, hi in dense.band_passes(340_000, 87) for x in range(lo, hi)] == [*range(87)]
    assert len(dense.band_passes(340_000, 87)) == 4
    rng = np.random.default_rng(1)
    v = rng.standard_normal((60, 16))[rng.integers(0, 60, 400)] + 0.15 * rng.standard_normal((400, 16))
    rows = spark.createDataFrame([(f"{i:05d}", (r / np.linalg.norm(r)).tolist()) for i, r in enumerate(v)], "id string, v array<double>")
    at_once = {tuple(r) for r in dense.cosine_pairs(rows, "id", "v", 0.9).select("a", "b").collect()}
    monkeypatch.setattr(dense, "PASS_ROWS", 1000)
    assert len(dense.band_passes(400, 40)) > 1
    assert {tuple(r) for r in dense.cosine_pairs(rows, "id", "v", 0.9).select("a", "b").collect()} == at_once != set()


def test_pairs_that_share_too_little_are_dropped_where_they_meet(spark):
    import random

    from corpusmill.operators import ranking
    from corpusmill.operators.skew import cut_lineage

    rng = random.Random(4)
    weight = {i: 1.0 if i == 0 else 0.5 + i / 1000 for i in range(300)}  # all have the heaviest item
    lists = {k: [0, *sorted(rng.sample(range(1, 300), rng.choice([3, 5, 140]) if k % 40 == 0 else 4))] for k in range(240)}
    rows = [(k, [(weight[i], i) for i in sorted(items, key=lambda i: (-weight[i], -i))], 1.9) for k, items in lists.items()]
    df = spark.createDataFrame(rows, "k bigint, i array<struct<w: double, h: bigint>>, t double")
    near = {(r.a, r.b) for r in ranking.meeting_pairs(cut_lineage(df.selectExpr("*", "transform(i, x -> struct(x AS x)) AS head"))).collect()}
    want = {(a, b) for a in lists for b in lists if a < b and sum(weight[i] for i in set(lists[a]) & set(lists[b])) >= 1.9}
    assert want and want <= near and len(near) < 240 * 239 / 2 / 5  # all pairs meet by the first item


@pytest.mark.parametrize("name", ["reranked", "reranked_full", "search_filtered"])
def test_texts_of_candidates_are_found_without_a_shuffle_of_all(spark, tiny, name):
    import __spark_entry__ as e

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # only what has been counted is broadcast
    try:
        plan = e.queries()[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    semi = [x for x in plan.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)
