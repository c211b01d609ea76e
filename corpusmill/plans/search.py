"""Ranking queries: BM25, dense, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.functions.text import raw_tokens, token_estimate
from corpusmill.operators import delta
from corpusmill.operators import evaluation as E
from corpusmill.operators.dense import dense_topk, unit
from corpusmill.operators.fusion import rrf
from corpusmill.operators.lexical import RAW, bm25, join_phrases, postings, rerank
from corpusmill.operators.search import Filters, search
from corpusmill.operators.skew import small_side
from corpusmill.plans.common import CUR, KEYS, QS, VEC, bm25_sql, chunk_vectors, current, lexicon, questions, raw_vectors, tokens_sql, vectors
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table


def term_counts(spark, d):
    return postings(table(spark, d, "documents"), ["doc_id"], "text")


def token_counts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


def pool_stats(spark, d):
    dl = F.coalesce(F.size(raw_tokens(F.col("text"))), F.lit(0)).alias("dl")
    return current(spark, d, dl, text=True).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"))


def _ranked(spark, d, queries, k=8, lex=RAW, keep=None, explain=False):
    """BM25 over the current chunks; keep is a condition on their tags and path."""
    return bm25(queries, table(spark, d, "chunks"), KEYS, k=k, explain=explain, lexicon=lex, latest=True, keep=keep)


def bm25_topk(spark, d, lex=RAW):
    return _ranked(spark, d, questions(spark, d), lex=lex)


def bm25_vocabulary(spark, d, lex=RAW):
    """The best chunks for each name of the vocabulary."""
    names = table(spark, d, "vocab_terms").where("name IS NOT NULL").select(F.col("name").alias("qid"), F.col("name").alias("query")).distinct()
    return _ranked(spark, d, names, lex=lex)


def bm25_filtered(spark, d, lex=RAW):
    """Filters apply before the statistics: they are those of the filtered pool."""
    return _ranked(spark, d, questions(spark, d), lex=lex, keep=F.exists("tags", lambda t: F.lower(F.trim(t)) == "goal-drift") & F.lower("relpath").endswith(".md"))


def bm25_explain(spark, d, lex=RAW):
    """The three best with each term's contribution, terms in order."""
    r = _ranked(spark, d, questions(spark, d), 3, lex, explain=True)
    said = F.transform(F.array_sort(F.map_entries("terms")), lambda x: F.concat(x["key"], F.lit("="), F.format_string("%.2f", x["value"])))
    return r.select("qid", *KEYS, "rank", F.array_join(said, " ").alias("terms"))


def phrase_terms(spark, d):
    """Most frequent tokens of titles once names of the vocabulary are joined: term and n."""
    joined = join_phrases(raw_tokens(F.concat_ws(" ", "concepts", "title")), lexicon(spark, d).phrases)
    return table(spark, d, "notion_sources").select(F.explode(joined).alias("term")).where(F.col("term").contains("_")).groupBy("term").agg(F.count("*").alias("n"))


def stemmed_terms(spark, d):
    """Stems of the words of log entries, and how many entries hold each; distinct words are stemmed once."""
    from corpusmill.functions.stem import stems

    words = table(spark, d, "log_entries").select("log_id", F.explode(F.array_distinct(raw_tokens(F.concat_ws(" ", "title", "body")))).alias("term"))
    return words.join(stems(words.select("term")), "term").groupBy("stem").agg(F.count_distinct("log_id").alias("n"))


def reranked(spark, d, lex=RAW):
    """The 40 best of each question scored again by the share of its words they hold. Only the texts of those are fetched."""
    hits = cut_lineage(_ranked(spark, d, questions(spark, d), C.RERANK_POOL, lex))
    rows = table(spark, d, "chunks").join(small_side(hits.select(*KEYS).distinct()), KEYS, "left_semi")
    return rerank(hits, questions(spark, d), delta.current_chunks(rows, "text"), KEYS, 8)


def _dense(v, k):
    return dense_topk(v.where("row_ix % 50 = 0").select(F.col("row_ix").alias("qid"), "vector"), v, "row_ix", "vector", k)


def dense_nearest(spark, d):
    return _dense(cut_lineage(vectors(spark, d)), 8)


def _dense_rows(v, k):
    return _dense(v, k).join(v.select("row_ix", *KEYS), "row_ix")


def _relevant(raw):
    """The files of vectors within cosine 0.8 of the query's, among its ten nearest."""
    return raw.where("rank <= 10 AND score >= 0.8").select("qid", "file_id").distinct()


def _hybrid_lists(spark, d, k, lex=RAW):
    """The lexical list, the dense one of chunks, and the dense one of vectors it comes from."""
    v = cut_lineage(vectors(spark, d))
    asked = v.where("row_ix % 50 = 0").select("row_ix", *KEYS).join(current(spark, d, "heading_path"), KEYS).where("heading_path IS NOT NULL")
    lexical = _ranked(spark, d, asked.select(F.col("row_ix").alias("qid"), F.col("heading_path").alias("query")), k, lex)
    raw = cut_lineage(_dense_rows(v, k))
    return lexical, raw.groupBy("qid", *KEYS).agg(F.min("rank").alias("rank")), raw


def hybrid_rrf(spark, d, lex=RAW):
    """Lexical and dense lists of the same queries fused, each oversampled."""
    return rrf(list(_hybrid_lists(spark, d, 8 * C.OVERSAMPLE, lex)[:2]), KEYS, 8)


def multi_query_rrf(spark, d, lex=RAW):
    """Title and body of an entry as two wordings of one question, ranked in one pass and their lists fused."""
    words = questions(spark, d).select(F.struct("qid", F.lit("title").alias("wording")).alias("qid"), "query").unionByName(
        questions(spark, d, "body").select(F.struct("qid", F.lit("body").alias("wording")).alias("qid"), "query")
    )
    return rrf([_ranked(spark, d, words, 24, lex).select("qid.qid", *KEYS, "rank")], KEYS, 8)


def _runs(spark, d, lex=RAW):
    """Two runs over the same queries, and as relevant the files of vectors within cosine 0.8 of the query's."""
    lexical, near, raw = _hybrid_lists(spark, d, 40, lex)
    lexical = cut_lineage(lexical)
    return lexical, rrf([lexical, near], KEYS, 40), _relevant(raw)


def judged(spark, d):
    """What _runs gives as relevant, without the runs."""
    return _relevant(_dense_rows(cut_lineage(vectors(spark, d)), 10))


def eval_per_query(spark, d, lex=RAW):
    lexical, _, relevant = _runs(spark, d, lex)
    return E.per_query(lexical, relevant)


def eval_aggregate(spark, d, lex=RAW):
    rows = eval_per_query(spark, d, lex).withColumn("split", E.split_of(F.col("qid").cast("string"))).withColumn("source", F.when(F.col("n_relevant") > 1, "many").otherwise("one"))
    return E.aggregate(rows, "source")


def eval_compare(spark, d, lex=RAW):
    lexical, fused, relevant = _runs(spark, d, lex)
    return E.compare(E.per_query(lexical, relevant), E.per_query(fused, relevant))


SHOWN = ["relpath", "title", "heading_path", "tokens", "category", "subcategory"]


def _asked(spark, d, v):
    """Chunks with a vector as queries: heading as words, and the vector."""
    one = v.where("row_ix % 50 = 0").join(current(spark, d, "heading_path"), KEYS)
    return cut_lineage(one.select(F.col("row_ix").alias("qid"), F.col("heading_path").alias("query"), "vector"))


def search_filtered(spark, d):
    """The search operator on words, within one category and type of file."""
    first = Filters(category="02_Methods", file_type="md")
    return search(questions(spark, d), table(spark, d, "chunks"), filters=first, columns=SHOWN)


def search_semantic(spark, d):
    v = cut_lineage(vectors(spark, d))
    return search(_asked(spark, d, v), table(spark, d, "chunks"), mode="semantic", vectors=chunk_vectors(v), columns=SHOWN)


def search_hybrid(spark, d):
    """The search operator on words and vectors, candidates reranked."""
    raw = cut_lineage(raw_vectors(spark, d))
    near = chunk_vectors(raw, "embedding").select(*KEYS, unit(F.col("embedding")).alias("vector"))
    return search(_asked(spark, d, vectors(spark, d, raw)), table(spark, d, "chunks"), mode="hybrid", vectors=near, reranked=True, columns=SHOWN)


def holdout_split(spark, d):
    return table(spark, d, "files").select("file_id", E.hash_bucket(F.col("file_id")).alias("bucket"), E.split_of(F.col("file_id")).alias("split"))


_DENSE = """asked AS (SELECT row_ix AS qid, v FROM vec WHERE row_ix % 50 = 0),
sims AS (SELECT qid, row_ix, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM asked a, vec b),
dense AS (SELECT qid, row_ix, rank, s FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, row_ix) AS rank FROM sims))"""
_CHUNK_DENSE = """cv AS (SELECT file_id, chunk_id, arg_min(v, row_ix) AS v FROM vec JOIN (SELECT file_id, chunk_id FROM cur) USING (file_id, chunk_id) GROUP BY ALL),
ca AS (SELECT row_ix AS qid, v FROM vec JOIN (SELECT file_id, chunk_id FROM cur) USING (file_id, chunk_id) WHERE row_ix % 50 = 0),
cd AS (SELECT qid, file_id, chunk_id, s, row_number() OVER (PARTITION BY qid ORDER BY s DESC, file_id, chunk_id) AS rank FROM (SELECT qid, file_id, chunk_id, round(list_cosine_similarity(a.v, b.v), 9) AS s FROM ca a, cv b))"""
_SHOWN = ", ".join(SHOWN)
_HYBRID = """hq AS (SELECT row_ix AS qid, heading_path AS query FROM vec JOIN cur USING (file_id, chunk_id) WHERE row_ix % 50 = 0 AND heading_path IS NOT NULL)"""


def _near(k):
    return f"near AS (SELECT qid, file_id, chunk_id, min(rank) AS rank FROM dense JOIN vec USING (row_ix) WHERE rank <= {k} GROUP BY ALL)"


def _rrf(lists: list[str], k: int, name: str = "fused") -> str:
    every = " UNION ALL ".join(f"SELECT qid, file_id, chunk_id, rank FROM {x}" for x in lists)
    return f"""{name} AS (SELECT qid, file_id, chunk_id, rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, file_id, chunk_id) AS rank
      FROM (SELECT qid, file_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS s FROM ({every}) GROUP BY ALL)) WHERE rank <= {k})"""


def _per_query(run: str, name: str) -> str:
    return f"""{name}_h AS (SELECT qid, file_id, row_number() OVER (PARTITION BY qid ORDER BY r, file_id) AS rank FROM (SELECT qid, file_id, min(rank) AS r FROM {run} GROUP BY ALL)),
{name} AS (SELECT qid, count(*) AS n_relevant, round(sum(CASE WHEN rank <= 20 THEN 1 ELSE 0 END) / count(*), 6) AS recall,
  round(sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg,
  round(CASE WHEN min(rank) <= 10 THEN 1.0::DOUBLE / min(rank) ELSE 0 END, 6) AS rr, min(rank) AS first_hit FROM rel LEFT JOIN {name}_h USING (qid, file_id) GROUP BY qid)"""


_EVAL = f"""WITH {CUR}, {VEC}, {_DENSE}, {_HYBRID}, {bm25_sql('hq', 40)}, {_near(40)}, {_rrf(['bm25', 'near'], 40)},
rel AS (SELECT DISTINCT qid, file_id FROM dense JOIN vec USING (row_ix) WHERE rank <= 10 AND round(s, 4) >= 0.8),
{_per_query('bm25', 'pq')}, {_per_query('fused', 'pf')}"""
_BUCKET = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha1({c}), ''), lambda x: ('0x' || x)::BIGINT)), lambda acc, x: (acc * 16 + x) % 100)::INTEGER"
_SPLIT = "CASE WHEN {b} < 30 THEN 'holdout' ELSE 'dev' END"

QUERIES = {f.__name__: f for f in (term_counts, token_counts, pool_stats, bm25_topk, bm25_vocabulary, bm25_filtered, bm25_explain, phrase_terms, stemmed_terms, reranked, dense_nearest, hybrid_rrf, multi_query_rrf, eval_per_query, eval_aggregate, eval_compare, holdout_split, search_filtered, search_semantic, search_hybrid)}
#: The rankings with the default terms (phrases, acronyms, stems) carry _full; those on raw tokens are the variants compared with SQL.
_RANKINGS = (bm25_topk, bm25_vocabulary, bm25_filtered, bm25_explain, reranked, hybrid_rrf, multi_query_rrf, eval_per_query, eval_aggregate, eval_compare)
QUERIES |= {f"{f.__name__}_full": lambda spark, d, f=f: f(spark, d, lexicon(spark, d)) for f in _RANKINGS}
_WS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SQL = {
    "term_counts": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY ALL",
    "token_counts": f"SELECT doc_id, greatest(1, floor(len(regexp_extract_all(text, '[^{_WS}]+')) / 0.75))::INTEGER AS tokens FROM documents WHERE text IS NOT NULL",
    "pool_stats": f"WITH {CUR} SELECT count(*) AS n, round(avg(coalesce(len({tokens_sql('text')}), 0)), 6) AS avgdl FROM cur",
    "bm25_topk": f"WITH {CUR}, {QS}, {bm25_sql('qs', 8)} SELECT * FROM bm25",
    "bm25_vocabulary": f"WITH {CUR}, qs AS (SELECT DISTINCT name AS qid, name AS query FROM vocab_terms WHERE name IS NOT NULL), {bm25_sql('qs', 8)} SELECT * FROM bm25",
    "bm25_filtered": f"""WITH {CUR}, pool AS (SELECT * FROM cur WHERE len(list_filter(tags, lambda t: lower(trim(t)) = 'goal-drift')) > 0 AND lower(relpath) LIKE '%.md'), {QS}, {bm25_sql('qs', 8, 'pool')} SELECT * FROM bm25""",
    "bm25_explain": f"""WITH {CUR}, {QS}, {bm25_sql('qs', 3)}
      SELECT b.qid, b.file_id, b.chunk_id, b.rank, coalesce(string_agg(p.term || '=' || printf('%.2f', round(p.part, 3)), ' ' ORDER BY p.term), '') AS terms FROM bm25 b LEFT JOIN bm25_p p ON p.qid = b.qid AND p.file_id = b.file_id AND p.chunk_id = b.chunk_id AND p.part > 0 GROUP BY ALL""",
    "reranked": f"""WITH {CUR}, {QS}, {bm25_sql('qs', 40)}, p AS (SELECT qid, file_id, chunk_id, list_distinct({tokens_sql('query')}) AS q, list_distinct(coalesce({tokens_sql('text')}, [])) AS t FROM bm25 JOIN qs USING (qid) JOIN cur USING (file_id, chunk_id)),
      s AS (SELECT qid, file_id, chunk_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t))::DOUBLE / len(q), 6) ELSE 0 END AS score FROM p)
      SELECT qid, file_id, chunk_id, rank, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_id, chunk_id) AS rank FROM s) WHERE rank <= 8""",
    "dense_nearest": f"WITH {VEC}, {_DENSE} SELECT qid, row_ix, rank, round(s, 4) AS score FROM dense WHERE rank <= 8",
    "hybrid_rrf": f"WITH {CUR}, {VEC}, {_DENSE}, {_HYBRID}, {bm25_sql('hq', 32)}, {_near(32)}, {_rrf(['bm25', 'near'], 8)} SELECT * FROM fused",
    "multi_query_rrf": f"""WITH {CUR}, {QS}, qb AS (SELECT log_id AS qid, body AS query FROM log_entries WHERE log_id % 50 = 0 AND body IS NOT NULL), {bm25_sql('qs', 24, name='l1')}, {bm25_sql('qb', 24, name='l2')}, {_rrf(['l1', 'l2'], 8)} SELECT * FROM fused""",
    "phrase_terms": f"""WITH names AS (SELECT DISTINCT {tokens_sql('name')} AS t FROM vocab_terms WHERE kind IN ('concept', 'tag') AND name IS NOT NULL),
      pat AS (SELECT ' (' || string_agg(array_to_string(t, '  '), '|' ORDER BY len(t) DESC, t) || ') ' AS p FROM names WHERE len(t) > 1),
      x AS (SELECT {tokens_sql("concat_ws(' ', concepts, title)")} AS t FROM notion_sources), y AS (SELECT ' ' || array_to_string(t, '  ') || ' ' AS s FROM x)
      SELECT replace(f, '  ', '_') AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(s, p, 1)) AS f FROM y, pat UNION ALL SELECT unnest(list_filter(t, lambda w: contains(w, '_'))) FROM x) GROUP BY 1""",
    "search_filtered": f"""WITH {CUR}, pool AS (SELECT * FROM cur WHERE category = '02_Methods' AND relpath LIKE '%.md'), {QS}, {bm25_sql('qs', 8, 'pool')} SELECT qid, rank, score, file_id, chunk_id, NULL::VARCHAR AS source, {_SHOWN} FROM bm25 JOIN cur USING (file_id, chunk_id)""",
    "search_semantic": f"WITH {CUR}, {VEC}, {_CHUNK_DENSE} SELECT qid, rank, round(s, 4) AS score, file_id, chunk_id, NULL::VARCHAR AS source, {_SHOWN} FROM cd JOIN cur USING (file_id, chunk_id) WHERE rank <= 8",
    "search_hybrid": f"""WITH {CUR}, {VEC}, {_HYBRID}, {_CHUNK_DENSE}, {bm25_sql('hq', 160)}, near AS (SELECT * FROM cd WHERE rank <= 160), {_rrf(['bm25', 'near'], 40)},
      p AS (SELECT qid, file_id, chunk_id, list_distinct({tokens_sql('query')}) AS q, list_distinct(coalesce({tokens_sql('text')}, [])) AS t FROM fused JOIN (SELECT row_ix AS qid, heading_path AS query FROM vec JOIN cur USING (file_id, chunk_id)) USING (qid) JOIN cur USING (file_id, chunk_id)),
      s AS (SELECT qid, file_id, chunk_id, CASE WHEN len(q) > 0 THEN round(len(list_intersect(q, t))::DOUBLE / len(q), 6) ELSE 0 END AS score FROM p),
      r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, file_id, chunk_id) AS rank FROM s)
      SELECT qid, rank, score, file_id, chunk_id, NULL::VARCHAR AS source, {_SHOWN} FROM r JOIN cur USING (file_id, chunk_id) WHERE rank <= 8""",
    "eval_per_query": _EVAL + " SELECT * FROM pq",
    "eval_aggregate": _EVAL + f""", g AS (SELECT *, {_SPLIT.format(b=_BUCKET.format(c='qid::VARCHAR'))} AS split, CASE WHEN n_relevant > 1 THEN 'many' ELSE 'one' END AS source FROM pq)
      SELECT split, source, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(rr), 6) AS rr FROM g GROUP BY GROUPING SETS ((split), (split, source))""",
    "eval_compare": _EVAL + """ SELECT qid, CASE WHEN pf.qid IS NULL THEN 'only_a' WHEN pq.qid IS NULL THEN 'only_b' WHEN pf.ndcg - pq.ndcg > 1e-9 THEN 'better' WHEN pf.ndcg - pq.ndcg < -1e-9 THEN 'worse' ELSE 'same' END AS state,
      round(pf.ndcg - pq.ndcg, 6) AS delta FROM pq FULL JOIN pf USING (qid)""",
    "holdout_split": f"SELECT file_id, {_BUCKET.format(c='file_id')} AS bucket, {_SPLIT.format(b=_BUCKET.format(c='file_id'))} AS split FROM files",
}
