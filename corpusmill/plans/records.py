"""Records and pages made from the tables: sidecar rows, file records, detail sections, saved searches and their judgements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import markdown as M
from corpusmill.functions import titles as T
from corpusmill.functions import urls as U
from corpusmill.functions.sql import register_functions
from corpusmill.operators import delta, facets
from corpusmill.operators import judgements as J
from corpusmill.operators.delta import last_version
from corpusmill.operators.evaluation import split_of
from corpusmill.operators.ranking import numbered
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.plans.browse import _items, related_concepts
from corpusmill.plans.browse import SQL as _BROWSE
from corpusmill.plans.common import CUR, KEYS, VEC, bm25_sql, current, tokens_sql
from corpusmill.plans.ingest import SQL as _INGEST
from corpusmill.plans.ingest import duplicate_groups, vocabulary_drift
from corpusmill.plans.search import _BUCKET, _DENSE, _SPLIT, bm25_vocabulary, judged
from corpusmill.session import cut_lineage
from corpusmill.sources.tables import table

_TAXONOMY, _PLAIN = ["tags", "concepts", "risk_category", "source_type"], ["author", "published", "description"]


def _said(c):
    return F.nullif(F.trim(c), F.lit(""))


def sidecar_tiers(spark, d):
    """A row for every PDF: the earlier curated row of its file name, then the classified one, then what the name says.

    Names are compared without outer blanks, the last row of a name wins. Only the taxonomy falls back on the
    classification; author, day and description come from the curated row alone. Missing values are blank.
    """
    s = table(spark, d, "notion_sources").withColumn("filename", F.trim("filename")).where("filename <> ''")
    tier = lambda origin, columns, mark: last_version(s.where(F.lower(F.trim("origin")) == origin), ["filename"], ["row_id"]).select("filename", *[F.col(c).alias(f"{mark}_{c}") for c in columns])
    pdf = table(spark, d, "files").where(F.col("type") == "pdf").where(U.sidecar_path(F.col("relpath"))).withColumn("filename", F.element_at(F.split("relpath", "/"), -1))
    rows = pdf.select("file_id", "relpath", "filename").join(tier("curated", ["title", "url", *_TAXONOMY, *_PLAIN], "p"), "filename", "left").join(tier("classified", _TAXONOMY, "c"), "filename", "left")
    first = lambda name, *c: F.coalesce(*[_said(x) for x in c], F.lit("")).alias(name)
    return rows.select(
        "file_id", "filename", F.regexp_replace("relpath", "/?[^/]*$", "").alias("folder"), F.coalesce(_said("p_title"), T.from_file_name(F.col("filename"))).alias("title"), first("url", "p_url"),
        *[first(c, f"p_{c}", f"c_{c}") for c in _TAXONOMY], *[first(c, f"p_{c}") for c in _PLAIN],
    )


def sidecar_rows(spark, d):
    """A row for every Markdown file, in the order of folder and name: lists joined by a comma and a blank, nulls as blanks."""
    m = facets.memberships(table(spark, d, "chunks"), {"tag": "tags", "concept": "concepts"})
    sets = m.groupBy("file_id").pivot("kind", ["tag", "concept"]).agg(F.array_join(F.sort_array(F.collect_set("item")), ", "))
    f = table(spark, d, "files").where(F.col("type") == "md").where(U.sidecar_path(F.col("relpath")))
    blank = lambda c, n: F.coalesce(c, F.lit("")).alias(n)
    rows = f.join(sets, "file_id", "left").select("file_id", F.element_at(F.split("relpath", "/"), -1).alias("filename"), F.regexp_replace("relpath", "/?[^/]*$", "").alias("folder"), blank("title", "title"), blank("tag", "tags"), blank("concept", "concepts"), blank("source_type", "source_type"))
    return rows.orderBy("folder", "filename", "file_id")


def file_records(spark, d):
    """One JSON record per file: its attributes, and the number and tokens of its current chunks."""
    c = current(spark, d, "tokens").groupBy("file_id").agg(F.count("*").alias("parts"), F.sum(F.coalesce("tokens", F.lit(0))).alias("sum"))
    zero = lambda x, n: F.coalesce(x, F.lit(0).cast("bigint")).alias(n)
    shown = F.struct("file_id", "relpath", "type", "title", "category", "subcategory", "source_type", "n_pages", zero("parts", "n_chunks"), zero("sum", "n_tokens"))
    return table(spark, d, "files").drop("n_chunks", "n_tokens").join(c, "file_id", "left").select("file_id", F.to_json(shown, {"ignoreNullFields": "false"}).alias("record"))


def detail_sections(spark, d):
    """The sections of every file's page in their order: a header at place 0, then each current chunk under its heading. A digest of each."""
    body = F.concat(F.lit("## "), F.coalesce("heading_path", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    rows = cut_lineage(numbered(current(spark, d, F.md5(body).alias("section"), text=True), KEYS, "at"))
    n = rows.groupBy("file_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    placed = salted_lookup(rows, n, "file_id", "n", hot_rows=hot_threshold(rows.count())).select("file_id", (F.col("at") - F.col("first") + 1).alias("place"), "section")
    said = lambda c: F.coalesce(c, F.lit(""))
    head = F.concat(F.lit("# "), said("title"), F.lit("\n\nPath: "), said("relpath"), F.lit("\nCategory: "), said("category"), F.lit("\n"))
    return placed.unionByName(table(spark, d, "files").select("file_id", F.lit(0).cast("bigint").alias("place"), F.md5(head).alias("section")))


def concept_pages(spark, d):
    """The links of every concept's page: page name, concept, and the files that carry it with their titles."""
    m = facets.memberships(table(spark, d, "chunks"), {"concept": "concepts"}).select("file_id", F.col("item").alias("concept"))
    return m.join(table(spark, d, "files").select("file_id", "title"), "file_id", "left").select(U.file_slug(F.col("concept")).alias("page"), "concept", "file_id", F.coalesce("title", "file_id").alias("title"))


def related_titles(spark, d, most: int = 5):
    """The first titles of files that a concept shares with each of its related ones."""
    m = cut_lineage(facets.memberships(table(spark, d, "chunks"), {"concept": "concepts"}).select("file_id", "item"))
    pairs = cut_lineage(related_concepts(spark, d).select("term", "other"))
    n = m.groupBy("item").agg(F.count("*").alias("n"))
    wanted = pairs.groupBy("term").agg(F.collect_list("other").alias("others")).join(n.withColumnRenamed("item", "term"), "term")  # at most five others
    mine = salted_lookup(m.withColumnRenamed("item", "term"), wanted, "term", "n", hot_rows=hot_threshold(m.count())).select("file_id", "term", F.explode("others").alias("item"))
    both = mine.join(m, ["file_id", "item"]).join(table(spark, d, "files").select("file_id", "title"), "file_id", "left").withColumn("title", F.coalesce("title", "file_id"))
    order = Window.partitionBy("term", "item").orderBy("title", "file_id")
    return both.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("term", F.col("item").alias("other"), "place", "title")


def top_facets(spark, d, most: int = 20):
    """The tags and concepts of most files, the report's length of each kind."""
    m = facets.memberships(table(spark, d, "chunks"), {"tag": "tags", "concept": "concepts"}).groupBy("kind", "item").agg(F.count("*").alias("n_files"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n_files"), "item"))).where(F.col("rank") <= most).select("kind", "rank", "item", "n_files")


def largest_groups(spark, d, most: int = 20):
    """The largest groups of duplicate sources."""
    g = duplicate_groups(spark, d).groupBy("group_type", "group_key").agg(F.count("*").alias("n_rows"))
    return g.orderBy(F.desc("n_rows"), "group_type", "group_key").limit(most)


def vocabulary_status(spark, d):
    """Whether tags and vocabulary agree, in one row: in sync, drift, or nothing to compare with."""
    n = vocabulary_drift(spark, d).agg(F.count_if(F.col("state") == "unknown").alias("n_unknown"), F.count_if(F.col("state") == "unused").alias("n_unused"))
    known = table(spark, d, "vocab_terms").where("kind = 'tag'").agg(F.count_distinct("name").alias("n_names"))
    state = F.when(F.col("n_names") == 0, "no vocabulary").when(F.col("n_unknown") + F.col("n_unused") > 0, "drift").otherwise("in sync")
    return n.crossJoin(known).withColumn("state", state)  # two single rows


def index_health(spark, d):
    """Whether the chunks cover the tree: files and PDFs in both; degraded if the tree has PDFs and no chunk of one is indexed."""
    pdf = F.lower("relpath").endswith(".pdf")
    c = table(spark, d, "chunks").agg(F.count_distinct("file_id").alias("n_indexed"), F.count_distinct(F.when(pdf, F.col("file_id"))).alias("n_indexed_pdf"))
    f = table(spark, d, "files").agg(F.count_distinct("file_id").alias("n_files"), F.count_distinct(F.when(pdf, F.col("file_id"))).alias("n_pdf"))
    degraded = (F.col("n_pdf") > 0) & (F.col("n_indexed") > 0) & (F.col("n_indexed_pdf") == 0)
    return f.crossJoin(c).withColumn("degraded", degraded)  # two single rows


def fetch_slugs(spark, d):
    return table(spark, d, "notion_sources").where("title IS NOT NULL").select("row_id", U.fetch_slug(F.col("title")).alias("slug"))


def body_titles(spark, d):
    """Titles that documents give themselves: their first heading that says something."""
    return table(spark, d, "documents").select("doc_id", T.from_body(F.col("text")).alias("title")).where("title IS NOT NULL")


def stripped_bodies(spark, d):
    """Documents with a top block: the rest without it and without later blocks of fields, as digest, and the number of those."""
    rows = table(spark, d, "documents").where(M.front_block(F.col("text")) != "").select("doc_id", M.stripped_body(F.col("text")).alias("s"))
    return rows.select("doc_id", F.md5("s.body").alias("digest"), "s.blocks")


def _saved(spark, d):
    hits = cut_lineage(bm25_vocabulary(spark, d))
    rows = table(spark, d, "chunks").join(hits.select(*KEYS).distinct(), KEYS, "left_semi")
    shown = hits.join(delta.current_chunks(rows, "relpath", "title", "text"), KEYS)
    answer = F.concat(F.lit("Found in "), F.coalesce("title", F.lit("")), F.lit(" ("), F.element_at(F.split("relpath", "/"), -1), F.lit(")."))
    return J.saved_query(shown.withColumn("answer", answer), "qid", "answer")


def saved_queries(spark, d):
    """The best chunks for each name of the vocabulary kept as a Markdown record: its length and digest."""
    return _saved(spark, d).select("qid", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def mined_judgements(spark, d):
    """Judgements mined from those records, one row per relevant file."""
    return J.judgements(_saved(spark, d), "qid", "text").select("qid", "query", F.explode("relevant_file_ids").alias("file_id"), "source", "split")


def sql_tokens(spark, d):
    """Tokens of titles and how often each occurs, in the library's SQL functions."""
    register_functions(spark)
    table(spark, d, "notion_sources").createOrReplaceTempView("titled_sources")
    return spark.sql("SELECT term, count(*) AS n FROM (SELECT explode(tokens) AS term FROM (SELECT tokenize(title) AS tokens FROM titled_sources)) GROUP BY term")


def eval_drift(spark, d):
    """Judged queries whose relevant files are all gone from the manifest, after those held out are set aside."""
    relevant = judged(spark, d).where(split_of(F.col("qid").cast("string")) == "dev")
    return J.drift(relevant, table(spark, d, "files").where(U.indexable(F.col("relpath"))))


_SIDE_OK = f"({_BROWSE['manifest'].split('WHERE ', 1)[1]}) AND NOT regexp_matches('/' || relpath, '/_inbox/|/_trash_|/_dupes_|(^|/)(_audit_|_health_check_)[^/]*$')"
_TIER = "SELECT trim(filename) AS filename, arg_max(struct_pack({c}), row_id) AS {m} FROM notion_sources WHERE trim(filename) <> '' AND lower(trim(origin)) = '{o}' GROUP BY 1"
_PACK = lambda columns: ", ".join(f"{c} := {c}" for c in columns)
_ALL = ["title", "url", *_TAXONOMY, *_PLAIN]
_COALESCED = ", ".join([f"coalesce(nullif(trim(p.{c}), ''), nullif(trim(c.{c}), ''), '') AS {c}" for c in _TAXONOMY] + [f"coalesce(nullif(trim(p.{c}), ''), '') AS {c}" for c in _PLAIN])
_FRONT = r"^(?:\x{FEFF})?---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|\z)"
_EMPTY = ", ".join(f"'{t}'" for t in T.EMPTY_TITLES)
_RELATED = _BROWSE["related_concepts"]
_SAVED = f"""WITH {CUR}, qs AS (SELECT DISTINCT name AS qid, name AS query FROM vocab_terms WHERE name IS NOT NULL), {bm25_sql('qs', 8)},
  h AS (SELECT qid, rank, file_id, coalesce(title, '') AS title, coalesce(relpath, '') AS relpath, coalesce(text, '') AS text, 'Found in ' || coalesce(title, '') || ' (' || string_split(relpath, '/')[-1] || ').' AS answer FROM bm25 JOIN cur USING (file_id, chunk_id))"""

QUERIES = {f.__name__: f for f in (sidecar_tiers, sidecar_rows, file_records, detail_sections, concept_pages, related_titles, top_facets, largest_groups, vocabulary_status, index_health, fetch_slugs, body_titles, stripped_bodies, saved_queries, mined_judgements, eval_drift, sql_tokens)}
SQL = {
    "sidecar_tiers": f"""WITH p AS ({_TIER.format(c=_PACK(_ALL), m='p', o='curated')}), c AS ({_TIER.format(c=_PACK(_TAXONOMY), m='c', o='classified')}), f AS (SELECT file_id, relpath, string_split(relpath, '/')[-1] AS filename FROM files WHERE type = 'pdf' AND {_SIDE_OK})
      SELECT file_id, f.filename, regexp_replace(relpath, '/?[^/]*$', '') AS folder, coalesce(nullif(trim(p.title), ''), trim(regexp_replace(regexp_replace(regexp_replace(f.filename, '\\.[^.]*$', ''), '_[0-9a-f]{{8}}$', ''), '_+', ' ', 'g'))) AS title,
        coalesce(nullif(trim(p.url), ''), '') AS url, {_COALESCED} FROM f LEFT JOIN p ON p.filename = f.filename LEFT JOIN c ON c.filename = f.filename""",
    "sidecar_rows": f"""WITH t AS (SELECT file_id, string_agg(item, ', ' ORDER BY item) AS tags FROM {_items('tags')} GROUP BY file_id), c AS (SELECT file_id, string_agg(item, ', ' ORDER BY item) AS concepts FROM {_items('concepts')} GROUP BY file_id)
      SELECT file_id, string_split(relpath, '/')[-1] AS filename, regexp_replace(relpath, '/?[^/]*$', '') AS folder, coalesce(title, '') AS title, coalesce(tags, '') AS tags, coalesce(concepts, '') AS concepts, coalesce(source_type, '') AS source_type
      FROM files LEFT JOIN t USING (file_id) LEFT JOIN c USING (file_id) WHERE type = 'md' AND {_SIDE_OK}""",
    "file_records": f"""WITH {CUR}, c AS (SELECT file_id, count(*) AS parts, sum(coalesce(tokens, 0))::BIGINT AS s FROM cur GROUP BY file_id)
      SELECT file_id, to_json({{'file_id': file_id, 'relpath': relpath, 'type': type, 'title': title, 'category': category, 'subcategory': subcategory, 'source_type': source_type, 'n_pages': n_pages, 'n_chunks': coalesce(parts, 0), 'n_tokens': coalesce(s, 0)}})::VARCHAR AS record FROM files LEFT JOIN c USING (file_id)""",
    "detail_sections": f"""WITH {CUR} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS place, md5('## ' || coalesce(heading_path, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10)) AS section FROM cur
      UNION ALL SELECT file_id, 0, md5('# ' || coalesce(title, '') || chr(10) || chr(10) || 'Path: ' || coalesce(relpath, '') || chr(10) || 'Category: ' || coalesce(category, '') || chr(10)) FROM files""",
    "concept_pages": f"""SELECT substr(regexp_replace(regexp_replace(item, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS page, item AS concept, m.file_id, coalesce(title, m.file_id) AS title FROM {_items('concepts')} m LEFT JOIN files f ON f.file_id = m.file_id""",
    "related_titles": f"""WITH rel AS ({_RELATED}), mm AS (SELECT * FROM {_items('concepts')}), s AS (SELECT term, other, x.file_id, coalesce(f.title, x.file_id) AS title FROM rel JOIN mm x ON x.item = term JOIN mm y ON y.item = other AND y.file_id = x.file_id LEFT JOIN files f ON f.file_id = x.file_id)
      SELECT term, other, place, title FROM (SELECT *, row_number() OVER (PARTITION BY term, other ORDER BY title, file_id) AS place FROM s) WHERE place <= 5""",
    "top_facets": f"""WITH n AS (SELECT 'tag' AS kind, item, count(*) AS n_files FROM {_items('tags')} GROUP BY item UNION ALL SELECT 'concept', item, count(*) FROM {_items('concepts')} GROUP BY item)
      SELECT kind, rank, item, n_files FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n_files DESC, item) AS rank FROM n) WHERE rank <= 20""",
    "largest_groups": f"SELECT group_type, group_key, count(*) AS n_rows FROM ({_INGEST['duplicate_groups']}) GROUP BY ALL ORDER BY n_rows DESC, group_type, group_key LIMIT 20",
    "vocabulary_status": f"""WITH dr AS ({_INGEST['vocabulary_drift']}), n AS (SELECT count(*) FILTER (WHERE state = 'unknown') AS n_unknown, count(*) FILTER (WHERE state = 'unused') AS n_unused FROM dr), k AS (SELECT count(DISTINCT name) AS n_names FROM vocab_terms WHERE kind = 'tag')
      SELECT *, CASE WHEN n_names = 0 THEN 'no vocabulary' WHEN n_unknown + n_unused > 0 THEN 'drift' ELSE 'in sync' END AS state FROM n, k""",
    "index_health": """WITH f AS (SELECT count(DISTINCT file_id) AS n_files, count(DISTINCT CASE WHEN lower(relpath) LIKE '%.pdf' THEN file_id END) AS n_pdf FROM files),
      c AS (SELECT count(DISTINCT file_id) AS n_indexed, count(DISTINCT CASE WHEN lower(relpath) LIKE '%.pdf' THEN file_id END) AS n_indexed_pdf FROM chunks) SELECT *, n_pdf > 0 AND n_indexed > 0 AND n_indexed_pdf = 0 AS degraded FROM f, c""",
    "fetch_slugs": r"""SELECT row_id, substr(regexp_replace(trim(regexp_replace(title, '[^\p{L}\p{N}_ \t-]+', '', 'g')), '[ \t]+', '_', 'g'), 1, 120) AS slug FROM notion_sources WHERE title IS NOT NULL""",
    "body_titles": rf"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '{_FRONT}', ''), '\r?\n')) AS x, unnest(range(len(regexp_split_to_array(regexp_replace(text, '{_FRONT}', ''), '\r?\n')))) AS i FROM documents WHERE text IS NOT NULL),
      h AS (SELECT doc_id, i, substr(trim(regexp_replace(regexp_replace(x, '^[ \t]*##? +', ''), '[ \t]+', ' ', 'g')), 1, 200) AS t FROM l WHERE regexp_matches(x, '^[ \t]*##? +[^ \t]'))
      SELECT doc_id, arg_min(t, i) AS title FROM h WHERE length(t) > 2 AND NOT (lower(t) IN ({_EMPTY}) OR regexp_matches(lower(t), '^([0-9\W_]+|[0-9a-f]{{8,}}|https?://\S*|\S+\.(pdf|html?|md|docx?))$')) GROUP BY doc_id""",
    "stripped_bodies": rf"""WITH b AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '{_FRONT}', ''), '\n---[ \t]*\n', chr(1) || chr(10), 'g'), chr(1)) AS p FROM documents WHERE regexp_extract(text, '{_FRONT}', 1) <> ''),
      k AS (SELECT doc_id, p, coalesce(list_min(list_filter(list_transform(p, lambda x, i: CASE WHEN i % 2 = 0 AND (i = len(p) OR len(list_filter(string_split(x, chr(10)), lambda y: trim(y) <> '')) = 0
          OR len(list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '^[A-Za-z_][A-Za-z0-9_-]*[ \t]*:'))) * 5 < len(list_filter(string_split(x, chr(10)), lambda y: trim(y) <> '')) * 3) THEN i - 1 END), lambda z: z IS NOT NULL)), len(p)) AS stop FROM b)
      SELECT doc_id, md5(array_to_string(list_filter(p, lambda x, i: i - 1 < stop AND i % 2 = 1), chr(10) || chr(10)) || coalesce(array_to_string(list_transform(list_filter(p, lambda x, i: i - 1 >= stop), lambda x: chr(10) || '---' || x), ''), '')) AS digest, (stop // 2)::INTEGER AS blocks FROM k""",
    "saved_queries": _SAVED + r""", t AS (SELECT qid, '---' || chr(10) || 'question: ' || regexp_replace(qid, '[\r\n]+', ' ', 'g') || chr(10) || '---' || chr(10) || chr(10) || '## Answer' || chr(10) || chr(10) || coalesce(arg_min(answer, rank), '') || chr(10) || chr(10) || '## Top results' || chr(10) || chr(10)
        || string_agg('### ' || rank || '. [' || regexp_replace(title, '[\[\]\r\n]+', ' ', 'g') || ']' || chr(10) || chr(10) || 'file_id: `' || file_id || '` path: `' || relpath || '`' || chr(10) || chr(10) || regexp_replace(substr(text, 1, 1200), '(?m)^#', ' #', 'g') || chr(10), chr(10) ORDER BY rank) AS text FROM h GROUP BY qid)
      SELECT qid, length(text)::INTEGER AS n_chars, md5(text) AS digest FROM t""",
    "mined_judgements": _SAVED + r""", a AS (SELECT qid, arg_min(answer, rank) AS answer FROM h GROUP BY qid)
      SELECT DISTINCT 'sq-' || qid AS qid, qid AS query, file_id, 'saved_query' AS source, 'dev' AS split FROM h JOIN a USING (qid) WHERE contains(a.answer, file_id) OR (relpath <> '' AND contains(a.answer, string_split(relpath, '/')[-1])) OR (title <> '' AND contains(lower(a.answer), lower(regexp_replace(title, '[\[\]\r\n]+', ' ', 'g'))))""",
    "sql_tokens": f"SELECT term, count(*) AS n FROM (SELECT unnest({tokens_sql('title')}) AS term FROM notion_sources) GROUP BY term",
    "eval_drift": f"""WITH {VEC}, {_DENSE}, {CUR}, hq AS (SELECT row_ix AS qid FROM vec JOIN cur USING (file_id, chunk_id) WHERE row_ix % 50 = 0 AND heading_path IS NOT NULL), rel AS (SELECT DISTINCT qid, file_id FROM dense JOIN vec USING (row_ix) WHERE rank <= 10 AND round(s, 4) >= 0.8),
      dev AS (SELECT * FROM rel WHERE {_SPLIT.format(b=_BUCKET.format(c='qid::VARCHAR'))} = 'dev'), k AS (SELECT file_id FROM ({_BROWSE['manifest']}))
      SELECT qid, count(*) AS n_relevant, count(k.file_id) AS n_known, CASE WHEN count(k.file_id) > 0 THEN 'kept' ELSE 'excluded' END AS state FROM dev LEFT JOIN (SELECT DISTINCT file_id FROM k) k USING (file_id) GROUP BY qid""",
}
