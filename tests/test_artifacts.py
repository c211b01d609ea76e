"""SQL functions, kept results, cached extraction and page texts on small fixtures."""

from pyspark.sql import functions as F

from corpusmill.functions.markdown import html_text
from corpusmill.functions.sql import register_functions
from corpusmill.functions.stem import stem_en
from corpusmill.operators.chunking import chunk_documents
from corpusmill.sources.artifacts import read_artifact, shrunk, write_artifact, write_lines
from corpusmill.sources.files import cached_extract, read_chunks


def test_sql_functions(spark):
    register_functions(spark)
    one = lambda x: spark.sql(f"SELECT {x} AS x").first().x
    assert one("tokenize('The über Goal-drift x1 9z')") == ["the", "ber", "goal-drift", "x1"]
    assert (one("tokenize(CAST(NULL AS STRING))"), one("count_tokens('a b c d e')"), one("count_tokens('')"), one("count_tokens(CAST(NULL AS STRING))")) == (None, 6, 1, 1)
    assert one(r"front_block('---\nk: v\n---\nbody')") == "k: v\n"
    assert (one("vec_dot(array(1D, 2D), array(3D, 4D))"), one("vec_cosine(array(0D), array(1D))"), one("vec_dot(array(1D), array(1D, 2D))")) == (11.0, None, None)
    assert abs(one("vec_cosine(array(1D, 2D), array(2D, 4D))") - 1) < 1e-12
    assert [one(f"stem_en('{w}')") for w in ("running", "policies")] == [stem_en("running"), stem_en("policies")] and one("stem_en(CAST(NULL AS STRING))") is None


def test_chunker_as_table_function(spark):
    register_functions(spark)
    docs = spark.createDataFrame([(1, "# A\n\n" + "word " * 900 + "\n\n## B\n\nmore words."), (2, ""), (3, None), (4, "  ")], "doc_id int, text string")
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT doc_id, c.chunk_id, c.heading_path, c.tokens, c.text FROM some_docs, LATERAL chunk_text(text) c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunk_documents(docs, "doc_id", "text").collect())) != []


def test_artifacts(spark, tmp_path):
    folder, a = str(tmp_path / "kept"), spark.range(5)
    assert read_artifact(spark, folder) is None
    write_artifact(spark, {"a": a, "b": spark.range(0)}, folder, {"model": "x"}, 1)
    write_artifact(spark, {"a": spark.range(7), "b": spark.range(2)}, folder, {"model": "y"}, 2)
    got = read_artifact(spark, folder, {"model": "y"})
    assert {n: df.count() for n, df in got.items()} == {"a": 7, "b": 2}
    assert read_artifact(spark, folder, {"model": "x"}) is None  # the last run is another model's
    a.write.mode("overwrite").parquet(f"{folder}/runs/3/a")  # broken off before its note
    assert read_artifact(spark, folder)["a"].count() == 7
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/runs/2/a")  # rows lost
    assert read_artifact(spark, folder) is None
    assert shrunk(spark.range(1), a) and not shrunk(spark.range(3), a) and not shrunk(spark.range(0), None)


def test_lines_and_chunks(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", ["x"])], "qid string, relevant_file_ids array<string>")
    write_lines(rows.coalesce(1), str(tmp_path / "q"), "qid")
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()] == ['{"qid":"a","relevant_file_ids":["x"]}', '{"qid":"b","relevant_file_ids":null}']
    path = str(tmp_path / "c")
    spark.createDataFrame([("1", "_trash/a.md"), ("2", "b.md")], "file_id string, relpath string").write.json(path)
    assert (read_chunks(spark, path).count(), read_chunks(spark, path, every=True).count()) == (1, 2)


def _extract(content: bytes) -> list[str]:
    if content == b"bad":
        raise ValueError("bad")
    return [content.decode()]


def test_cached_extract(spark):
    files = spark.createDataFrame([("a", b"one"), ("b", b"one"), ("c", b"two"), ("d", b"bad"), ("e", None)], "relpath string, content binary")
    first = cached_extract(files, _extract).cache()
    by = lambda df: {r.relpath: (r.n_pages, r.body, r.error) for r in df.collect()}
    assert by(first) == {"a": (1, "## Page 1\n\none", None), "b": (1, "## Page 1\n\none", None), "c": (1, "## Page 1\n\ntwo", None), "d": (0, "", "bad"), "e": (None, None, None)}
    kept = first.where("relpath <> 'c'").withColumn("body", F.lit("kept"))
    again = by(cached_extract(files, _extract, kept))
    assert (again["a"], again["b"], again["c"], again["d"]) == ((1, "kept", None), (1, "kept", None), (1, "## Page 1\n\ntwo", None), (0, "", "bad"))
    assert cached_extract(files.limit(0), _extract).count() == 0


def test_html_text(spark):
    page = "<html><head><title>T</title><style>p {x}</style></head><body><!-- no --><p>One &amp;lt; <b>two</b>\n three</p><div>a<br/>b</div><script>var x = '<p>';</script></body></html>"
    rows = spark.createDataFrame([(page,), ("3 < 4 and 5 > 2",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(html_text(F.col("t"))).collect()] == ["T\nOne &lt; two three\na\nb", "3 < 4 and 5 > 2", "", None]
