"""What several plans share: current chunks, question sets, vectors, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.functions.text import raw_tokens
from corpusmill.operators import delta
from corpusmill.operators.dense import unit, usable
from corpusmill.operators.lexical import Lexicon
from corpusmill.sources.tables import table

DIMENSION = 128
KEYS = ["file_id", "chunk_id"]


def current(spark, d, *columns, text: bool = False) -> DataFrame:
    """The current row of each chunk: its keys and the columns asked for. text: whether any of them depends on the text."""
    return delta.current_chunks(table(spark, d, "chunks"), *columns, text=text)


def lexicon(spark, d) -> Lexicon:
    """The default of a ranking: the vocabulary's concepts and tags as phrases, the fixed acronyms, and stems."""
    names = [r.name for r in table(spark, d, "vocab_terms").where("kind IN ('concept', 'tag') AND name IS NOT NULL").select("name").distinct().collect()]  # fixed table
    words = spark.createDataFrame([("phrase", n, n) for n in names] + [("acronym", a, x) for a, x in C.ACRONYMS.items()], "kind string, name string, x string").select("kind", "name", raw_tokens(F.col("x")).alias("t")).collect()
    return Lexicon([r.t for r in words if r.kind == "phrase"], {r.name: r.t for r in words if r.kind == "acronym"}, True)


def questions(spark, d, column: str = "title") -> DataFrame:
    """The stated query set: every log entry whose id is divisible by 50."""
    return table(spark, d, "log_entries").where(f"log_id % 50 = 0 AND {column} IS NOT NULL").select(F.col("log_id").alias("qid"), F.col(column).alias("query"))


def raw_vectors(spark, d) -> DataFrame:
    """row_ix, file_id, chunk_id, embedding of usable vectors, once each: half as large as unit vectors, which are in double precision."""
    ids = table(spark, d, "emb_ids").groupBy("row_ix").agg(F.min(F.struct("file_id", "chunk_id")).alias("i"))
    rows = table(spark, d, "emb_matrix").where(usable("embedding", DIMENSION)).groupBy("row_ix").agg(F.min("embedding").alias("e"))
    return rows.join(ids, "row_ix").select("row_ix", "i.file_id", "i.chunk_id", F.col("e").alias("embedding"))


def vectors(spark, d, raw: DataFrame | None = None) -> DataFrame:
    """row_ix, file_id, chunk_id, vector (unit) of usable vectors, once each. raw: raw_vectors, if kept."""
    return (raw_vectors(spark, d) if raw is None else raw).select("row_ix", *KEYS, unit(F.col("embedding")).alias("vector"))


def chunk_vectors(v: DataFrame, vector: str = "vector") -> DataFrame:
    """file_id, chunk_id, vector: one vector for each chunk, that of its smallest row_ix."""
    return v.groupBy(*KEYS).agg(F.min_by(vector, "row_ix").alias(vector))


CUR = """cur AS (SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY file_id, chunk_id
  ORDER BY indexed_at DESC NULLS LAST, text DESC NULLS LAST, tags DESC NULLS LAST, concepts DESC NULLS LAST) AS _r FROM chunks) WHERE _r = 1)"""
VEC = """vec AS (SELECT m.row_ix, i.id.file_id AS file_id, i.id.chunk_id AS chunk_id, m.v FROM
  (SELECT row_ix, min(embedding)::DOUBLE[] AS v FROM emb_matrix WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
     AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY row_ix) m
  JOIN (SELECT row_ix, min({'file_id': file_id, 'chunk_id': chunk_id}) AS id FROM emb_ids GROUP BY row_ix) i ON i.row_ix = m.row_ix)"""
TOK = "[A-Za-z][A-Za-z0-9_-]+"


def tokens_sql(column: str) -> str:
    return f"list_transform(regexp_extract_all({column}, '{TOK}'), lambda x: lower(x))"


def bm25_sql(queries: str, k: int, pool: str = "cur", name: str = "bm25") -> str:
    """CTEs ending in `name` (qid, file_id, chunk_id, rank, score, full) for the queries relation (qid, query)."""
    return f"""
{name}_q AS (SELECT DISTINCT qid, unnest({tokens_sql('query')}) AS term FROM {queries}),
{name}_d AS (SELECT file_id, chunk_id, {tokens_sql('title')} AS tt, {tokens_sql('heading_path')} AS th, coalesce({tokens_sql('text')}, []) AS tx FROM {pool}),
{name}_s AS (SELECT count(*) AS n, avg(len(tx)) AS avgdl FROM {name}_d),
{name}_t AS (SELECT file_id, chunk_id, dl, term, count(*) AS tf FROM (SELECT file_id, chunk_id, len(tx) AS dl, unnest(tx) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_t GROUP BY term),
{name}_p AS (SELECT qid, file_id, chunk_id, t.term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS part
  FROM {name}_t t JOIN {name}_q q ON q.term = t.term JOIN {name}_f f ON f.term = t.term, {name}_s),
{name}_b AS (SELECT qid, file_id, chunk_id, 0.5::DOUBLE AS w FROM (SELECT DISTINCT file_id, chunk_id, unnest(tt) AS term FROM {name}_d WHERE len(tx) > 0) x JOIN {name}_q q ON q.term = x.term
  UNION ALL SELECT qid, file_id, chunk_id, 0.3::DOUBLE FROM (SELECT DISTINCT file_id, chunk_id, unnest(th) AS term FROM {name}_d WHERE len(tx) > 0) x JOIN {name}_q q ON q.term = x.term),
{name}_a AS (SELECT qid, file_id, chunk_id, sum(v) AS full_score FROM (SELECT qid, file_id, chunk_id, part AS v FROM {name}_p UNION ALL SELECT qid, file_id, chunk_id, w FROM {name}_b) GROUP BY ALL),
{name} AS (SELECT qid, file_id, chunk_id, rank, round(full_score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(full_score, 9) DESC, file_id, chunk_id) AS rank FROM {name}_a WHERE full_score > 0) WHERE rank <= {k})"""


QS = "qs AS (SELECT log_id AS qid, title AS query FROM log_entries WHERE log_id % 50 = 0 AND title IS NOT NULL)"
