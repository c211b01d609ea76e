"""Front blocks, titles, paths and mined judgements on small fixtures."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import markdown as M
from corpusmill.functions import titles as T
from corpusmill.functions import urls as U
from corpusmill.operators import judgements as J
from corpusmill.plans.queries import QUERIES


def values(spark, expr, *texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(expr).collect()]


@pytest.mark.parametrize(
    "text, body, blocks",
    [
        ("---\nk: v\n---\nbody", "body", 0),
        ("---\nk: v\n---\nbody\n---\na: 1\nb: 2\n---\nend", "body\n\n\nend", 1),
        ("---\nk: v\n---\nx\n---\na: 1\n---\ny\n---\nb: 2\n---\nz", "x\n\n\ny\n\n\nz", 2),
        ("---\nk: v\n---\nx\n---\nplain words\n---\ny\n---\nb: 2\n---\nz", "x\n---\nplain words\n---\ny\n---\nb: 2\n---\nz", 0),
        ("---\nk: v\n---\nx\n---\na: 1\nopen", "x\n---\na: 1\nopen", 0),
        ("---\nk: v\n---\nx\n---\na: 1\nb: 2\nc: 3\nwords\nmore\n---\ny", "x\n\n\ny", 1),
        ("x\n---\na: 1\n---\ny", "x\n---\na: 1\n---\ny", 0),
        ("", "", 0),
    ],
)
def test_later_blocks_of_fields(spark, text, body, blocks):
    assert values(spark, M.stripped_body(F.col("t")), text) == [(body, blocks)]


def test_long_and_null_texts(spark):
    lines = "x\n" * 200_000
    assert values(spark, M.stripped_body(F.col("t")), None) == [None]
    assert values(spark, F.length(M.front_block(F.col("t"))), f"---\n{lines}---\nbody", f"---\n{lines}", None) == [len(lines), 0, None]
    assert values(spark, F.length(M.stripped_body(F.col("t"))["body"]), f"---\nk: v\n---\n{lines}") == [len(lines)]


def test_title_from_body(spark):
    texts = ["---\ntitle: x\n---\n\n# Untitled\n\n##  The   real one \n# Later", "no heading", "### third level", "# 12345\ntext", "", None, "  # " + "long " * 60]
    assert values(spark, T.from_body(F.col("t")), *texts) == ["The real one", None, None, None, None, None, ("long " * 60)[:200]]
    assert values(spark, T.from_file_name(F.col("t")), "A_Field__Guide_d312e417.pdf", "plain", None) == ["A Field Guide", "plain", None]


def test_paths_and_slugs(spark):
    paths = ["a/b.md", "a/_inbox/b.md", "_trash_2020/b.md", "x/_dupes_1/b.md", "a/_audit_x.md", "a/_health_check_1.md", ".obsidian/b.md", "_index/saved_queries/q.md", None]
    assert values(spark, U.sidecar_path(F.col("t")), *paths) == [True, False, False, False, False, False, False, True, None]
    assert values(spark, U.comparable_path(F.col("t")), *paths) == [True, False, False, False, True, True, False, False, None]
    assert values(spark, U.fetch_slug(F.col("t")), " What: is  this? ", "über-all", "", None, "w" * 130) == ["What_is_this", "über-all", "", None, "w" * 120]


def record(answer, question="q"):
    return f"---\nquestion: {question}\n---\n\n## Answer\n\n{answer}\n\n## Top results\n\n### 1. [First One](x)\n\nfile_id: `aa11` path: `d/one.md`\n\n### 2. [Second](x)\n\nfile_id: `bb22` path: `d/two.md`\n\n### 3. [Third](x)\n\nfile_id: `aa11` path: `d/one.md`\n"


def test_judgements_from_saved_records(spark):
    texts = [record("see bb22 and FIRST one"), record("see two.md"), record("nothing"), record("x\n**Paraphrases used:** two.md"), record("two.md", ""), "no record", "", None]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "k int, text string, split string")
    prior = spark.createDataFrame([("sq-1", "holdout", "saved_query")] * 2 + [("syn-1", "dev", "synthetic")], "qid string, split string, source string")
    got = sorted((r.qid, r.query, r.relevant_file_ids, r.split) for r in J.judgements(rows, "k", "text", prior).collect())
    assert got == [("sq-0", "q", ["aa11", "bb22"], "dev"), ("sq-1", "q", ["bb22"], "holdout")]
    assert J.judgements(rows.limit(0), "k", "text").count() == 0


def test_saved_record_round_trip(spark):
    hits = spark.createDataFrame([("what?", "as aa11 says", r, i, p, t, x) for r, i, p, t, x in [(1, "aa11", "d/one.md", "One [x]", "## Answer\nfoo"), (2, "bb22", None, None, None)]], "qid string, answer string, rank int, file_id string, relpath string, title string, text string")
    saved = J.saved_query(hits, "qid", "answer")
    assert [(r.query, r.relevant_file_ids) for r in J.judgements(saved, "qid", "text").collect()] == [("what?", ["aa11"])]


def test_drift(spark):
    relevant = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, None)], "qid int, file_id string")
    known = spark.createDataFrame([("a", 1), ("a", 2)], "file_id string, qid int")
    assert sorted(tuple(r) for r in J.drift(relevant, known).select("qid", "n_relevant", "n_known", "state").collect()) == [(1, 2, 1, "kept"), (2, 1, 0, "excluded"), (3, 1, 0, "excluded")]


def test_drift_ranks_no_words(spark, tiny, monkeypatch):
    from corpusmill.plans import search

    monkeypatch.setattr(search, "_ranked", None)
    assert QUERIES["eval_drift"](spark, tiny).count() > 0


def test_new_queries_have_rows(spark, tiny):
    for name in ("sidecar_tiers", "sidecar_rows", "fetch_summary", "body_titles", "stripped_bodies", "mined_judgements"):
        assert QUERIES[name](spark, tiny).count() > 0, name
