import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.functions.stem import stem_en
from corpusmill.operators import delta, lexical, scoring
from corpusmill.operators.lexical import RAW, Lexicon, bm25
from corpusmill.operators.search import representatives

KEYS = ["file_id", "chunk_id"]
WORDS = ["the", "of", *[f"w{i}" for i in range(12)]]


def _texts(n, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choices(WORDS, [60, 40, *range(12, 0, -1)], k=rng.randrange(0, 14))) for _ in range(n)]


def _score(asked, texts, titles):
    """Brute force: the score of each text."""
    split = [t.split() for t in texts]
    avg = sum(map(len, split)) / len(split)
    df = {w: sum(w in s for s in split) for w in asked}
    idf = {w: math.log((len(split) - df[w] + 0.5) / (df[w] + 0.5) + 1) for w in asked}
    part = lambda s, w: idf[w] * s.count(w) * 2.5 / (s.count(w) + 1.5 * (0.25 + 0.75 * len(s) / avg))
    return [sum(part(s, w) for w in asked if w in s) + (0.5 * sum(w in t.split() for w in asked) if s else 0) for s, t in zip(split, titles)]


def test_tokens_are_those_of_the_pattern():
    rows = ["The über Goal-drift x1 9z", None, "", "a -b_ 12ab c", "end", "x", "Start-", "K-9 KK é", "9" * 5 + "q7"]
    found, row = scoring.tokens(pa.array(rows))
    want = [(i, m.lower()) for i, t in enumerate(rows) for m in re.findall("[A-Za-z][A-Za-z0-9_-]+", t or "")]
    assert list(zip(row.tolist(), [x.decode() for x in found.to_pylist()])) == want
    found, row = scoring.tokens(pa.array(rows).slice(3, 4))
    assert list(zip((row + 3).tolist(), [x.decode() for x in found.to_pylist()])) == [w for w in want if 3 <= w[0] < 7]


def test_terms_join_phrases_from_the_left_and_stem():
    terms = scoring.Terms(pa.array(["goal_drift", "latent_goal_drift", "agent", "drift"]), [["goal", "drift"], ["latent", "goal", "drift"]], True)
    row, ids = terms.of(pa.array(["agents of latent goal drift drifting", "goal", "drift goal drift"]))
    assert list(zip(row.tolist(), ids.tolist())) == [(0, 2), (0, -1), (0, 1), (0, 3), (1, -1), (2, 3), (2, 0)]
    assert stem_en("agents") == "agent"


def test_hits_survive_their_bytes():
    terms = scoring.Terms(pa.array(["ab", "cd"]), [], False)
    dl, codes, tfs = scoring.hits_of(pa.array(["ab " * 300 + "cd", None, "cd"]), pa.array(["ab", "ab", None]), pa.array([None, None, "cd cd"]), terms)
    row, code, tf = scoring.read_hits(codes, tfs, 2)
    assert dl.tolist() == [301, 0, 1] and list(zip(row.tolist(), code.tolist(), tf.tolist())) == [(0, 0, 300), (0, 1, 1), (0, 2, 1), (2, 1, 1), (2, 5, 1)]


@pytest.mark.parametrize("first, tile", [(8192, 65_536), (16, 40), (1, 3)])
def test_ranking_passes_by_no_row_that_belongs_in_it(first, tile, monkeypatch):
    monkeypatch.setattr(scoring, "FIRST_TILE", first), monkeypatch.setattr(scoring, "TILE", tile)
    texts, rng = _texts(700), random.Random(3)
    titles = [rng.choice(["", "the w3", "w9"]) for _ in texts]
    terms = pa.array(WORDS)
    dl, codes, tfs = scoring.hits_of(pa.array(texts), pa.array(titles), pa.nulls(len(texts), pa.string()), scoring.Terms(terms, [], False))
    asked = [sorted(rng.sample(range(len(WORDS)), rng.randrange(1, 6))) for _ in range(60)]
    df = np.array([sum(w in t.split() for t in texts) for w in WORDS])
    starts = np.concatenate([[0], np.cumsum([len(a) for a in asked])])
    w = scoring.Weights(terms, np.log((len(texts) - df + 0.5) / (df + 0.5) + 1), dl.mean(), np.arange(60), starts, np.concatenate(asked))
    batches = pa.table({"k": np.arange(len(texts)), "dl": pa.array(dl, pa.int32()), "codes": codes, "tfs": tfs}).to_batches(max_chunksize=37)
    got = pa.Table.from_batches(scoring.ranked(batches, w, 4, False, ["k"])).to_pylist()
    assert len(got) <= 60 * 4  # what leaves a task; the pairs that share a word are some 30,000
    for i, a in enumerate(asked):
        score = _score([WORDS[t] for t in a], texts, titles)
        want = sorted((x for x in range(len(texts)) if score[x] > 0), key=lambda x: (-round(score[x], 9), x))[:4]
        assert [r["k"] for r in got if r["sid"] == i] == want


def test_pairs_of_query_and_row_are_not_shuffled(spark):
    texts = _texts(300)
    pool = spark.createDataFrame([(f"f{i:03}", "c0", t, "the w3", None) for i, t in enumerate(texts)], "file_id string, chunk_id string, text string, title string, heading_path string")
    asked = spark.createDataFrame([(i, f"the of w{i % 12} w{i % 5}") for i in range(40)] + [(99, None)], "qid int, query string")
    found = bm25(asked, pool, KEYS, k=3)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()  # of pairs; the sets of terms are made before
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.file_id)
    for i in range(40):
        score = _score(sorted({"the", "of", f"w{i % 12}", f"w{i % 5}"}), texts, ["the w3"] * 300)
        assert got[i] == [f"f{x:03}" for x in sorted((x for x in range(300) if score[x] > 0), key=lambda x: (-round(score[x], 9), x))[:3]]
    some = bm25(asked, pool, KEYS, k=3, explain=True).orderBy("qid", "rank").collect()
    assert [(r.qid, r.file_id) for r in some] == [(q, f) for q in sorted(got) for f in got[q]] and all(r.terms for r in some)


def test_sets_of_terms_are_ranked_in_several_passes(spark, monkeypatch):
    pool = spark.createDataFrame([(f"f{i:03}", "c0", t, None, None) for i, t in enumerate(_texts(90))], "file_id string, chunk_id string, text string, title string, heading_path string")
    asked = spark.createDataFrame([(i, f"w{i % 12} w{i % 5}") for i in range(20)], "qid int, query string")
    rows = lambda: sorted(map(tuple, bm25(asked, pool, KEYS, k=3, lexicon=Lexicon([["w1", "w2"]], {}, True)).collect()))
    want = rows()
    monkeypatch.setattr(lexical, "HELD", 9)
    assert rows() == want and len({r[0] for r in want}) == 20


def test_representatives_score_only_the_chunks_of_their_files(spark):
    rows = [(f, f"c{j}", t, None, None) for f, texts in {"a": ["w1 w1 of", "w1 w1 of", "w2"], "b": ["of of", "w2 w1"], "c": ["w9 w9"]}.items() for j, t in enumerate(texts)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "file_id string, chunk_id string, text string, title string, heading_path string").select(
        "*", F.timestamp_seconds(F.lit(1)).alias("indexed_at"), F.lit(1).alias("tokens"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("concepts"), *[F.lit("x").alias(c) for c in ("relpath", "category", "subcategory")])
    files = spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (1, "c")], "qid int, file_id string")
    asked = spark.createDataFrame([(1, "w1"), (2, "w2")], "qid int, query string")
    got = {(r.qid, r.file_id): (r.chunk_id, r.score > 0) for r in representatives(files, asked, df, delta.current_chunks(df), RAW).collect()}
    assert got == {(1, "a"): ("c0", True), (2, "a"): ("c2", True), (2, "b"): ("c1", True), (1, "c"): ("c0", False)}
