import base64
import math
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import bpe, canonical_values, cells, cooccurrence, formatting_duplicates, frequencies, golden_records, hnsw, packing, similar_vectors, splitting, subjects
from corpusmill.llm.queries import QUERIES, SQL
from tests.compare import same


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, name):
    same(spark, tiny, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name):
    QUERIES[name](spark, tiny).collect()


# 1
def brute_neighbours(x, ids, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    return {ids[i]: [ids[j] for j in sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:k]] for i in range(len(ids))}


def test_graph_recall():
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 32))
    x = (centres[rng.integers(150, size=3000)] + 0.4 * rng.standard_normal((3000, 32))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    got, _ = hnsw.FlatHnsw(x).search(x, 11)
    want = np.argsort(-(x @ x.T), axis=1)[:, :11]
    assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(got, want)]) > 0.95


def test_most_similar_shards_copies_and_ties(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    x = centres[rng.integers(30, size=600)] + 0.3 * rng.standard_normal((600, 16))
    x[100:140] = x[7]  # forty copies
    x[140:145] = 3 * x[7]  # the same direction
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "z") for i, v in enumerate(x)], "row_ix long, embedding array<float>, h string")
    want = brute_neighbours(x.astype(np.float64), list(range(600)), 5)
    ways = [{"probes": 4, "margin": 0.3}, {"probes": 4, "margin": 0.3, "part_rows": 30}, {"probes": 6, "margin": 0.4, "level_cells": 3, "shard_rows": 70}]
    for way in ways:  # one level of cells, cells cut into parts, two levels
        got = similar_vectors.most_similar(df, "row_ix", "embedding", 5, 16, **({"shard_rows": 100} | way))
        found: dict = {}
        for r in got.orderBy("row_ix", "rank").collect():
            found.setdefault(r.row_ix, []).append(r.neighbour)
        assert found[120] == want[120] and found[7] == want[7]
        assert np.mean([len(set(found[i]) & set(want[i])) / 5 for i in range(600)]) >= 0.9
    assert similar_vectors.most_similar(df.where("false"), "row_ix", "embedding", 5, 16).count() == 0
    assert similar_vectors.most_similar(df.limit(1), "row_ix", "embedding", 5, 16).count() == 0


def test_home_cell_is_the_same_for_any_number_of_probes():
    rng = np.random.default_rng(3)
    unit = lambda n: (v := rng.standard_normal((n, 16))) / np.linalg.norm(v, axis=1)[:, None]
    two_levels = similar_vectors.Cells(unit(60), unit(10), np.arange(0, 61, 6))
    x = unit(500)
    assert (two_levels.nearest(x, 1, 0.2)[:, 0] == two_levels.nearest(x, 4, 0.2)[:, 0]).all()


def test_pairs_meet_in_cells_of_large_tables():
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x = unit(np.repeat(rng.standard_normal((4000, 64)), 2, axis=0) + 0.55 * rng.standard_normal((8000, 64))).astype(np.float32)  # pairs at 0.77
    n = 2_400_000
    c = similar_vectors.Cells(similar_vectors.coarse_cells(x, -(-n // similar_vectors.cell_rows(n))))
    near = c.nearest(x, similar_vectors.cell_probes(len(c.fine)), similar_vectors.MARGIN)
    a, b = near[::2], near[1::2]
    met = (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.9
    assert similar_vectors.cell_rows(10**9) <= similar_vectors.PART_ROWS


def test_most_similar_with_many_scaled_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((200, 16))
    x[60:160] = x[60] * rng.uniform(0.1, 9, 100)[:, None]  # more than a search returns
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_ix long, embedding array<float>")
    found: dict = {}
    for r in similar_vectors.most_similar(df, "row_ix", "embedding", 10, 16).orderBy("row_ix", "rank").collect():
        found.setdefault(r.row_ix, []).append(r.neighbour)
    want = brute_neighbours(x.astype(np.float64), list(range(200)), 10)
    assert all(found[i] == want[i] for i in range(60, 160))


def test_usable_vectors(spark):
    inf, nan = float("inf"), float("nan")
    m = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0]), (6, None), (7, [1.0, None]), (8, [1.0, 1.0]), (None, [1.0, 1.0]), (9, [-0.0, 1.0]), (10, [0.0, 1.0])], "row_ix long, embedding array<float>")
    got = similar_vectors.usable_vectors(m, "row_ix", "embedding", 2).collect()
    assert sorted(r.id for r in got) == [1, 1, 8, 9, 10] and len({r.h for r in got}) == 3
    ids = spark.createDataFrame([(i, "extra") for i in (1, 1, 2, 3, 4, 5, 6, 7, 9)], "row_ix long, embedding string")
    assert sorted((r.row_ix, r.neighbour) for r in similar_vectors.most_similar(m, "row_ix", "embedding", 3, 2, among=ids).collect()) == [(1, 9), (9, 1)]


# 2
@pytest.mark.parametrize("most, partitions", [(1, 4), (2, 1), (3, 40), (None, 1), (None, 4), (None, 60)])
def test_ngrams_equal_brute_force(spark, most, partitions):
    r = random.Random(3)
    rows = [(r.choice("ab"), f"r{r.randrange(6)}", [r.choice(["x", "y", "z", None]) if r.random() < 0.7 else "x" for _ in range(r.randrange(9))]) for _ in range(80)]
    rows += [("a", None, ["x", "x"]), ("a", "r1", None), (None, "r1", ["x", "y"]), ("b", "r2", ["x"] * 12)]
    occ: dict = {}
    for g, rec, seq in rows:
        for n in range(1, (most or 12) + 1):
            for i in range(len(seq or []) - n + 1):
                w = tuple(seq[i : i + n])
                if None not in w:
                    occ.setdefault((g, w), []).append(rec)
    df = spark.createDataFrame(rows, "g string, r string, e array<string>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)  # more tasks than suffixes: intervals cross many borders
    try:
        found = frequencies.ngram_frequencies(df, "g", "r", "e", most).collect()
        assert frequencies.ngram_frequencies(df.where("false"), "g", "r", "e", most).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {(x.g, tuple(x.ngram)): (x.occurrences, x.records) for x in found}
    assert len(got) == len(found) and got == {k: (len(v), len(set(v) - {None})) for k, v in occ.items()}


# 3
def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cooccurrence, "BLOCK", 3)
    r = random.Random(4)
    baskets = {f"b{i}": set(r.choices("abcdefghijkl", weights=range(1, 13), k=r.randrange(9))) for i in range(60)}
    rows = [(b, i) for b, s in baskets.items() for i in s] * 2 + [(None, "a"), ("b1", None)]
    n = {x: sum(x in s for s in baskets.values()) for x in "abcdefghijkl"}
    want = {}
    for a in n:
        for b in n:
            c = sum(a in s and b in s for s in baskets.values())
            if a < b and c >= 3 and c * 60 >= 1.2 * n[a] * n[b]:
                want[a, b] = c
    got = cooccurrence.cooccurring_pairs(spark.createDataFrame(rows, "basket string, item string"), 60, min_together=3, min_lift=1.2).collect()
    assert {(x.item_a, x.item_b): x.n_ab for x in got} == want
    assert all(abs(x.pmi - math.log2(x.n_ab * 60 / x.n_a / x.n_b)) < 1e-5 for x in got)


# 4
@pytest.mark.parametrize(
    "text, want",
    [
        ("2014-01-06 17:05", "2014-01-06"), ("6 January 2014", "2014-01-06"), ("Jan. 6th, 2014", "2014-01-06"), ("20140106", "2014-01-06"), ("2014/1/6", "2014-01-06"), ("6.1.2014", "2014-01-06"),
        ("2014-01-06T08:30:00Z", "2014-01-06"), ("Monday, 6 January 2014", "2014-01-06"), ("2014-02-30", None), ("January 2014", None), ("2014", None), ("2015-13-08", None), ("soon", None), (None, None),
    ],
)
def test_whole_day(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(golden_records.whole_day(F.col("t")).cast("string")).first()[0]
    assert got == want


def test_people(spark):
    def true(f, *values):
        return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(f(F.col("t"))).collect()]

    assert true(golden_records.names_people, "Ana Vidal", "A. Vidal and B. Roe", "Ana Vidal; Ben Roe", "Jo van der Berg") == [True] * 4
    assert not any(true(golden_records.names_people, "admin", "Author name", "site.example", "Posted on 4 May by", "2020-01-01", "N/A", "", None, "Ana"))


def test_furniture_is_learned_from_repetition(spark):
    """Wordings that occur in no test table, in two languages: what many titles share is furniture, what one source's copies share is not."""
    r = random.Random(8)
    pages = ["Hold the bell to hear the tariff! Doors close at nine.", "Bitte die Karte an das Feld halten. Der Lift kommt gleich."]
    own = [f"A report on {r.choice(['kelp', 'basalt', 'looms'])} number {i}. It weighs {i} facts." for i in range(60)]
    rows = [(i, f"Title {i}", own[i]) for i in range(60)]
    rows += [(100 + i, f"Page {i}", pages[i % 2]) for i in range(30)]
    rows += [(200 + i, "Twin  title" if i % 2 else "twin TITLE", "One long text about twins. It is copied often.") for i in range(300)]
    rows += [(900, "Mixed", own[3] + " " + "It goes on with much more to say about its own matter. " + pages[0]), (901, "Twice", pages[0] + " " + pages[1] + " Ticket 77."), (902, "None", None)]
    df = spark.createDataFrame(rows, "row_id long, title string, description string")
    known = golden_records.furniture(df)
    got = {x.row_id: x.furnished for x in golden_records.furnished(df, known).collect()}
    half = golden_records.FURNITURE_WORDS
    assert known.count() == 4
    assert all(got[i] < half for i in [*range(60), *range(200, 500), 900]) and all(got[i] >= half for i in [*range(100, 130), 901]) and 902 not in got


def test_survivors_follow_the_order(spark):
    ts = "TIMESTAMP '2020-01-0%d 00:00:00'"
    rows = [(1, "Ana Vidal", "2012-01-02", "A text.", "a,b", " Curated", ts % 1), (2, "Ben Roe", "2030-01-02", "A longer text.", "A,a", "fetched", ts % 2), (3, "Cy Roe", "2013-01-02", None, "[]", "curated", ts % 3), (4, None, None, None, None, None, "NULL")]
    lit = lambda v: "NULL" if v is None else f"'{v}'"
    src = spark.sql(" UNION ALL ".join(f"SELECT {r[0]}L AS row_id, {lit(r[1])} AS author, {lit(r[2])} AS published, {lit(r[3])} AS description, {lit(r[4])} AS tags, {lit(r[5])} AS origin, {r[6]} AS updated_at, 'x' AS group_id, 't' AS title" for r in rows))
    rep = spark.createDataFrame([(9, 1), (9, 2), (9, 3), (9, 3), (9, 77), (8, 4), (None, 1)], "group_id long, row_id long")
    long = golden_records.candidates(rep, src)
    assert {r.field: r.row_id for r in golden_records.survivors(long).collect()} == {"author": 3, "published": 3, "description": 2, "tags": 1}
    assert {r.field for r in golden_records.consensus_values(long).collect()} == {"author", "published", "description", "tags"}
    votes = spark.createDataFrame([(1, "author", i, v, True, 0, t, s) for i, (v, t, s) in enumerate([("Ana Vidal", 2, 9), ("ana vidal", 2, 9), ("Ben Roe", 3, 9), ("Ben Roe", 3, None)])], "group_id long, field string, row_id long, value string, usable boolean, score long, trust int, seen long")
    assert [(r.value, round(r.votes, 2)) for r in golden_records.consensus_values(votes).collect()] == [("Ana Vidal", 6.0)] and [r.row_id for r in golden_records.survivors(votes).collect()] == [2]
    assert golden_records.survivors(golden_records.candidates(rep.where("false"), src)).count() == 0


# 5
@pytest.mark.parametrize("text", ["", "  ", "one", "w " * 601, "w " * 5000, "First part. " * 900, "# H\n\n" + "Line one.\n\nLine two, more.\n- item\n" * 400, "a b　c " * 700, "x" * 40_000])
def test_pieces(text):
    got = splitting.pieces(text)
    words = text.split()
    assert sum(p[2] for p in got) == len(words)
    taken = 0
    for k, (start, end, own, carried) in enumerate(got):
        assert text[start:end].split() == words[taken - carried : taken + own]
        assert (own + carried) * 4 // 3 <= 800
        assert carried == min(37, taken)
        taken += own


def test_overlap_goes_back_beyond_a_short_piece():
    text = "\n\n".join("w " * n for n in (563, 563, 10, 563))
    assert [p[2:] for p in splitting.pieces(text)] == [(563, 0), (563, 37), (10, 37), (563, 37)]


def test_pieces_cut_at_the_strongest_boundaries():
    text = "Some words here. " * 180 + "\n\n# Next\n\n" + "Other words there. " * 180
    (_, end, _, _), *_ = splitting.pieces(text)
    assert text[end:].lstrip().startswith("# Next")


def test_current_row_decides(spark):
    big, small = "w " * 700, "w"
    q = lambda c, at, t: f"SELECT 'f' AS file_id, '{c}' AS chunk_id, {at} AS indexed_at, {t} AS text, 'h' AS heading_path"
    d = "TIMESTAMP '2020-01-0%d 00:00:00'"
    rows = [q("a", d % 1, f"'{big}'"), q("a", d % 2, f"'{small}'"), q("b", d % 2, f"'{big}'"), q("b", d % 2, f"'{big}'"), q("b", d % 1, f"'{small}'"), q("c", d % 1, f"'{big}'"), q("c", d % 2, "NULL"), q("d", "NULL", f"'{big}'")]
    got = splitting.current_oversized(spark.sql(" UNION ALL ".join(rows)))
    assert {r.chunk_id for r in got.collect()} == {"b", "d"}
    assert splitting.split_oversized(got).groupBy("chunk_id").count().collect()[0]["count"] > 1


# 6
def test_matcher():
    m = canonical_values.Matcher([("Latent Goal Drift", ["goal creep"]), ("Consent & Data Provenance", []), ("Model Weight Custody", None), ("tip-line", [])])
    same_as = {
        "Latent Goal Drift": ["latent goal drift", "LatentGoalDrift", "#LatentGoalDrift", "re: Latent Goal Drift", "Latent Goal Drift (draft)", "Drift Latent Goal", "Latnet Goal Drfit", "Latent Goal…", "LGD", "l.g.d.", "Goal Crep", "Ｌａｔｅｎｔ Ｇｏａｌ Ｄｒｉｆｔ", "Lаtent Goal Drift"],
        "Consent & Data Provenance": ["C.D.P.", "Consent & Data P.", "consent and data provenance"], "tip-line": ["tipline", "tip line", "line tip", "tip_line"],
        "": ["harbour tides 3", "unsorted", "?", "", "zz", "wine cellar"],
    }
    for name, values in same_as.items():
        for v in values:
            assert m.match(v) == name, v
    assert canonical_values.Matcher([]).match("x") == ""


def test_cells(spark):
    df = spark.createDataFrame([("[a, 'b' | a]",), ("~",), (None,), (" , |",), ("[]",), ("null, x",)], "c string")
    assert [r[0] for r in df.select(cells.entered_values(F.col("c"))).collect()] == [["a", "b"], [], [], [], [], ["null", "x"]]


# 7
@pytest.mark.parametrize(
    "a, b, equal",
    [
        (("https://e.org/a?x=1&y=2", "A  Title", "f_1.md"), ("F-1.md", "a title!", " HTTPS://E.org/a/?y=2&x=1\n"), True), (("u", "Café", "f"), ("u", "Café", "f"), True), (("u", "Café", "f"), ("u", "Cafe", "f"), False),
        (("u", "t 1", "f"), ("u", "t 2", "f"), False), (("u", "ｔ​", "f"), ("u", "T", "f"), True), (("u", "Straße", "f"), ("u", "STRASSE", "f"), True),
    ],
)
def test_canonical_record(a, b, equal):
    assert (formatting_duplicates.canonical_record(a) == formatting_duplicates.canonical_record(b)) == equal


def test_groups_keep_every_row(spark):
    rows = [(i, "u", "T" if i % 2 else "t ", "f", "x") for i in range(200)] + [(200, None, "t", "f", "x"), (201, "v", "", "", "x"), (202, "", "v", "", "x")]
    df = spark.createDataFrame(rows, "row_id long, url string, title string, filename string, canon string")
    got = {r.row_id: (r.first_key, r.copies) for r in formatting_duplicates.formatting_groups(df, "row_id", ["url", "title", "filename"]).collect()}
    assert all(got[i] == (0, 200) for i in range(200)) and got[200] == (200, 1) and got[201] == (201, 2) and got[202] == (201, 2)
    assert formatting_duplicates.formatting_groups(df.where("false"), "row_id", ["url", "title", "filename"]).count() == 0


# 8
def test_encoder_equals_the_public_library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(bpe.load_vocabulary())
    r = random.Random(5)
    texts = ["", " ", "<|endoftext|>", "it's we'll", "a" * 20_000, "日本語 テキスト\r\n\t", "﻿é́ 🙂‍↔️ x²"] + ["".join(r.choice("ab é1.\n日x") for _ in range(r.randrange(300))) for _ in range(200)]
    assert all(encoder.encode(t) == other.encode_ordinary(t) for t in texts)


def test_encode_texts_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, " ", 5), (3, " ", 5)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, list(r.ids)) for r in bpe.encode_texts(df, "doc_id", "text").collect()) == [(1, []), (2, []), (3, [220]), (3, [220])]
    assert bpe.encode_texts(df.where("false"), "doc_id", "text").count() == 0


def test_perfect_hash_is_minimal_and_complete():
    keys = [str(i).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys, list(range(5000)))
    assert all(h.get(k) == i for i, k in enumerate(keys)) and sorted(h.values) == list(range(5000)) and h.get(b"none") == -1


# 9
def test_pack_is_valid_and_tight():
    r = random.Random(6)
    for sizes in ([], [2048], [1] * 10, [1025] * 7, [r.randrange(1, 2049) for _ in range(3000)], [int(min(2048, r.paretovariate(0.6) * 20)) for _ in range(3000)]):
        place = packing.pack(sizes)
        load = np.bincount(place, weights=sizes) if sizes else np.zeros(0)
        assert (load <= 2048).all() and len(place) == len(sizes)
        if sizes and max(sizes) < 1000:
            assert len(load) <= sum(sizes) / 2048 + 1


def test_two_replace_one():
    assert packing.pack([60, 50, 45, 44], 100)[0] == packing.pack([60, 50, 45, 44], 100)[0]
    place = packing.pack([70, 25, 16, 14], 100)  # 70 + 25 leaves 5: 16 + 14 fit exactly
    assert place[0] == place[2] == place[3] != place[1]


def test_documents_are_cut_only_above_the_capacity(spark):
    df = spark.createDataFrame([(1, 5000), (2, 4096), (3, 0), (4, None), (5, 2048), (6, 10), (6, 10)], "doc_id long, n int")
    got = packing.pack_documents(df, "doc_id", "n").collect()
    spans = sorted((r.doc_id, r.start, r.length) for r in got)
    assert spans == [(1, 0, 2048), (1, 2048, 2048), (1, 4096, 904), (2, 0, 2048), (2, 2048, 2048), (5, 0, 2048), (6, 0, 10), (6, 0, 10)]
    assert packing.pack_documents(df.where("false"), "doc_id", "n").count() == 0


def test_repeated_rows_over_the_capacity_share_no_container(spark):
    df = spark.createDataFrame([(1, 5000), (1, 5000), (1, 5001), (None, 3000), (None, 3000)], "doc_id long, n int")
    load: dict = {}
    for r in packing.pack_documents(df, "doc_id", "n").collect():
        load[r.container] = load.get(r.container, 0) + r.length
    assert sum(load.values()) == 21_001 and max(load.values()) <= 2048


# 10
def test_sentences():
    text = "---\ntitle: X y z\n---\n# Head line here\n\nOne two three. Four five\nsix don't! No.\n- item with words\n- another item here\r\nÉté à Zürich…"
    got = subjects.sentences(pa.array([None, text, " \n ", "", "One two three."]), subjects.WordHashes())
    said = ["one two three", "four five six dont", "item with words", "another item here été à zürich", "one two three"]
    assert got.per_text.tolist() == [0, 4, 0, 0, 1] and got.sizes.tolist() == [len(x.split()) for x in said]
    assert got.words.tolist() == [subjects._hash(unicodedata.normalize("NFD", w)) for x in said for w in x.split()]
    features, place = got.features()
    assert len(set(features[place == 0])) == 5 and features[place == 0].tolist() == features[place == 4].tolist()
    empty = subjects.sentences(pa.array([], pa.string()), subjects.WordHashes())
    assert not len(empty.words) and not len(empty.features()[0])


def test_vocabulary_knows_its_own_only():
    r = np.random.default_rng(4)
    own = np.unique(np.concatenate([r.integers(-(2**62), 2**62, 3000), np.arange(20) << 40]))  # the last ones share their low bits
    v = subjects.Vocabulary(own)
    assert (v.rows(own) == np.arange(len(own))).all() and (v.rows(r.integers(-(2**62), 2**62, 5000) | 1) < 0).sum() >= 4990


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels, areas = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "subject_labels", "subject_areas"))
    held = labels.where("doc_id % 3 = 0")
    model = subjects.fit_subjects(docs, labels.where("doc_id % 3 <> 0"), areas)
    found: dict = {}
    for r in subjects.document_subjects(docs.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), model).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    want: dict = {}
    for r in held.collect():
        want.setdefault(r.doc_id, set()).add(r.subject)
    hits = sum(len(found.get(k, set()) & v) for k, v in want.items())
    assert hits / sum(len(v - {"none"}) for v in want.values()) > 0.8
    assert hits / sum(len(v) for k, v in found.items()) > 0.8


def test_no_labels_no_subjects(spark):
    docs = spark.createDataFrame([(1, "One two three."), (2, None)], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    model = subjects.fit_subjects(docs, spark.createDataFrame([], "doc_id long, subject string, labelled_by string"), spark.createDataFrame([], "subject string, description string"))
    assert subjects.document_subjects(docs, model).count() == 0
