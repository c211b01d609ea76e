"""Facets, file details, manifests, logs and deltas."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.functions.urls import indexable
from corpusmill.operators import delta, facets
from corpusmill.operators.ranking import numbered
from corpusmill.operators.skew import hot_threshold, salted_lookup
from corpusmill.plans.common import CUR, KEYS, current
from corpusmill.session import cut_lineage, ensure_checkpoint_dir
from corpusmill.sources.files import manifest_cell
from corpusmill.sources.tables import table


def list_tags(spark, d):
    return facets.count_files(table(spark, d, "chunks"), "tags", "tag", 2)


def list_concepts(spark, d):
    return facets.count_files(table(spark, d, "chunks"), "concepts", "concept", 2)


def list_categories(spark, d):
    return facets.categories(table(spark, d, "files"))


def index_stats(spark, d):
    return facets.index_stats(current(spark, d, "relpath", "category", "tokens"))


def related_concepts(spark, d):
    return facets.related_terms(table(spark, d, "chunks"), "concepts")


def file_table(spark, d):
    """Per file: its first title, and the union of its tags and concepts over all rows."""
    c = table(spark, d, "chunks")
    m = facets.memberships(c, {"tag": "tags", "concept": "concepts"})
    sets = m.groupBy("file_id").pivot("kind", ["tag", "concept"]).agg(F.array_join(F.sort_array(F.collect_set("item")), "|"))
    first = current(spark, d, "title").groupBy("file_id").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("chunk_id"))).alias("title"), F.count("*").alias("n_chunks"))
    return first.join(sets, "file_id", "left").select("file_id", "title", "n_chunks", F.coalesce("tag", F.lit("")).alias("tags"), F.coalesce("concept", F.lit("")).alias("concepts"))


def file_detail(spark, d):
    """Per file its path, the number of its current chunks and a digest of their texts: a sum over the chunks, so that a file of any size is digested where its rows are."""
    part = F.md5(F.concat_ws("/", "chunk_id", F.md5(F.coalesce("text", F.lit(""))))).alias("part")
    c = current(spark, d, part, text=True).groupBy("file_id").agg(F.count("*").alias("n_parts"), F.sum(F.conv(F.substring("part", 1, 12), 16, 10).cast("decimal(20,0)")).cast("string").alias("digest"))
    return c.join(table(spark, d, "files").select("file_id", "relpath"), "file_id", "left").select("file_id", "relpath", "n_parts", "digest")


def file_chunks(spark, d):
    """The current chunks of every file in order, with their place in it."""
    rows = cut_lineage(numbered(current(spark, d, "heading_path", "tokens"), ["file_id", "chunk_id"], "at"))
    first = rows.groupBy("file_id").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    placed = salted_lookup(rows, first, "file_id", "n", hot_rows=hot_threshold(rows.count()))
    return placed.select(*KEYS, (F.col("at") - F.col("first") + 1).alias("place"), "heading_path", "tokens")


def manifest(spark, d):
    f = table(spark, d, "files")
    kinds = dict(f.dtypes)
    rows = f.where(indexable(F.col("relpath")))
    return rows.select(*[manifest_cell(c, kinds[c]) for c in ("file_id", "type", "category", "subcategory", "title", "n_chunks", "n_tokens", "n_pages", "source_type", "relpath")])


def index_header(spark, d):
    return table(spark, d, "files").agg(F.count("*").alias("n_files"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("type") == "pdf").alias("n_pdf"))


def chunk_export(spark, d):
    """File attributes on every current chunk."""
    f = table(spark, d, "files").select("file_id", "source_type", "n_pages")
    return current(spark, d, "relpath", "heading_path", F.length("text").alias("n_chars"), text=True).join(f, "file_id", "left").select(*KEYS, "relpath", "heading_path", "source_type", "n_pages", "n_chars")


def mirror_groups(spark, d):
    """Pages of the mirror: files per category, and the 80 tags of most files."""
    f = table(spark, d, "files").groupBy(F.coalesce("category", F.lit("")).alias("name")).agg(F.count("*").alias("n_files")).select(F.lit("category").alias("page"), "name", "n_files")
    t = facets.count_files(table(spark, d, "chunks"), "tags", "name").orderBy(F.desc("n_files"), "name").limit(80)
    return f.unionByName(t.select(F.lit("tag").alias("page"), "name", "n_files"))


def stale_pages(spark, d):
    """Pages that a mirror of the Markdown files alone would move away (chunks of other files) or find empty (their files without current text)."""
    f = table(spark, d, "files").where("type = 'md'").select("file_id")
    c = current(spark, d, (F.trim(F.coalesce("text", F.lit(""))) != "").alias("filled"), text=True).groupBy("file_id").agg(F.bool_or("filled").alias("filled"))
    return c.join(f, "file_id", "left_anti").select("file_id", F.lit("no file").alias("state")).unionByName(f.join(c.where("filled"), "file_id", "left_anti").select("file_id", F.lit("no text").alias("state")))


def _digests(spark, d):
    return current(spark, d, F.sha1(F.col("text").cast("binary")).alias("sha1"), text=True).where("sha1 IS NOT NULL").select(*KEYS, "sha1")


def embed_delta(spark, d):
    """Current chunks against the texts that were embedded."""
    return delta.hash_delta(_digests(spark, d).select(F.concat_ws("/", *KEYS).alias("k"), "sha1"), table(spark, d, "emb_ids"), "k", "sha1")


def embed_plan(spark, d):
    """For every current chunk the row of the vector that can be used again, or null where one is to be made."""
    return delta.reusable(_digests(spark, d), table(spark, d, "emb_ids"), "sha1", "row_ix")


def embed_validity(spark, d):
    """Whether the earlier run can be built upon: its ids and vectors match one to one and have one length, and why not."""
    return delta.run_validity(table(spark, d, "emb_matrix"), table(spark, d, "emb_ids"), "row_ix", "embedding")


def embedding_rows(spark, d):
    """Lengths of vectors and how many rows have each; a vector that is null has length -1."""
    n = F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(-1)).cast("int").alias("length")
    return table(spark, d, "emb_matrix").groupBy(n).agg(F.count("*").alias("n"))


def unembedded(spark, d):
    """Current chunks without a vector, by category."""
    ids = table(spark, d, "emb_ids").select(*KEYS).distinct()
    return current(spark, d, "category").join(ids, KEYS, "left_anti").groupBy("category").agg(F.count("*").alias("n"))


def source_fingerprint(spark, d):
    """One digest of all files, whatever the order of rows, and their number."""
    return delta.fingerprint(table(spark, d, "files"), ["relpath", "n_tokens"])


def daily_log_upsert(spark, d):
    return delta.daily_upsert(table(spark, d, "log_entries")).withColumn("entry_date", F.col("entry_date").cast("string"))


def log_newest_first(spark, d):
    order = F.concat(F.lit("## ["), F.col("entry_date").cast("string"), F.lit("] "), F.coalesce(F.lower(F.trim("kind")), F.lit("")), F.lit(" | "), F.coalesce("title", F.lit("")))
    return table(spark, d, "log_entries").where("entry_date IS NOT NULL").orderBy(F.desc("entry_date"), F.desc("log_id")).select("log_id", order.alias("heading"))


def _stream(spark, d, name):
    from corpusmill.streaming.log import read_log

    t = table(spark, d, "log_entries")
    folder = f"{ensure_checkpoint_dir(spark)}/{name}-{spark.sparkContext.startTime}-{abs(hash(d)) % 10**8}"
    return read_log(spark, f"{d}/log_entries.parquet", t.schema), folder


def stream_daily_counts(spark, d):
    """Entries per day of arrival and kind, as a stream that takes what is there and stops."""
    from corpusmill.streaming.log import daily_counts, run_available

    s, folder = _stream(spark, d, "daily")
    run_available(daily_counts(s, "ingested_at", "kind"), "", f"{folder}/state", "complete", lambda b, i: b.write.mode("overwrite").parquet(f"{folder}/out"))
    return spark.read.schema("day date, kind string, runs bigint").parquet(f"{folder}/out").withColumn("day", F.col("day").cast("string"))


def stream_first_deliveries(spark, d):
    """Entries without repeats, by day, kind and title: the stream's state holds half a year, and what is older is looked up among those written."""
    from corpusmill.streaming.log import append_unseen, run_available, without_repeats

    s, folder = _stream(spark, d, "first")
    keys = ["entry_date", "kind", "title"]
    once = without_repeats(s.where("ingested_at IS NOT NULL"), keys, "ingested_at").select(*keys)
    schema = "entry_date date, kind string, title string"
    run_available(once, "", f"{folder}/state", "append", append_unseen(f"{folder}/out", keys, schema))
    return spark.read.schema(schema).parquet(f"{folder}/out").select(F.col("entry_date").cast("string").alias("entry_date"), "kind", "title")


def stream_embed_delta(spark, d):
    """Deliveries of chunks as a stream: each batch's texts that were neither embedded nor met in an earlier batch, once each."""
    from corpusmill.streaming.log import append_unseen, read_log, run_available

    folder = f"{ensure_checkpoint_dir(spark)}/delta-{spark.sparkContext.startTime}-{abs(hash(d)) % 10**8}"
    s = read_log(spark, f"{d}/chunks.parquet", table(spark, d, "chunks").schema)
    known = table(spark, d, "emb_ids").select("sha1").where("sha1 IS NOT NULL").distinct()
    rows = s.where("text IS NOT NULL").select(F.sha1(F.col("text").cast("binary")).alias("sha1"))
    run_available(rows, "", f"{folder}/state", "append", append_unseen(f"{folder}/out", ["sha1"], "sha1 string", known))
    return spark.read.schema("sha1 string").parquet(f"{folder}/out").select("sha1")


_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = f"nullif(lower(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), '')"


def _items(column):
    return f"(SELECT DISTINCT file_id, item FROM (SELECT file_id, unnest(list_transform({column}, lambda x: {_NORM})) AS item FROM chunks) WHERE item IS NOT NULL AND file_id IS NOT NULL)"


QUERIES = {
    f.__name__: f
    for f in (list_tags, list_concepts, list_categories, index_stats, related_concepts, file_table, file_detail, file_chunks, manifest, index_header, chunk_export, mirror_groups, stale_pages, embed_delta, embed_plan, embed_validity, embedding_rows, unembedded, source_fingerprint, daily_log_upsert, log_newest_first, stream_daily_counts, stream_first_deliveries, stream_embed_delta)
}
_ROOT = ", ".join(f"'{x}'" for x in C.META_DOCUMENTS) or "''"
_CELL = "coalesce(regexp_replace({c}::VARCHAR, '[\\x00-\\x1f\\x7f]+', ' ', 'g'), '') AS {c}"
SQL = {
    "list_tags": f"SELECT item AS tag, count(*) AS n_files FROM {_items('tags')} GROUP BY item HAVING count(*) >= 2",
    "list_concepts": f"SELECT item AS concept, count(*) AS n_files FROM {_items('concepts')} GROUP BY item HAVING count(*) >= 2",
    "list_categories": """WITH f AS (SELECT DISTINCT file_id, coalesce(category, '') AS category, coalesce(subcategory, '') AS subcategory FROM files)
      SELECT 1 AS level, category, NULL AS subcategory, count(DISTINCT file_id) AS n_files FROM f GROUP BY category UNION ALL SELECT 2, category, subcategory, count(DISTINCT file_id) FROM f GROUP BY ALL""",
    "index_stats": f"""WITH {CUR} SELECT count(*) AS n_chunks, count(DISTINCT file_id) AS n_files, count(DISTINCT CASE WHEN lower(relpath) LIKE '%.md' THEN file_id END) AS n_md,
      count(DISTINCT CASE WHEN lower(relpath) LIKE '%.pdf' THEN file_id END) AS n_pdf, count(DISTINCT nullif(category, '')) AS n_categories, coalesce(sum(tokens), 0)::BIGINT AS n_tokens FROM cur""",
    "related_concepts": f"""WITH m AS (SELECT * FROM {_items('concepts')}), n AS (SELECT item, count(*) AS n FROM m GROUP BY item),
      p AS (SELECT x.item AS term, y.item AS other, count(*) AS shared FROM m x JOIN m y ON x.file_id = y.file_id AND x.item <> y.item GROUP BY ALL),
      s AS (SELECT term, other, shared, round(shared::DOUBLE / (a.n + b.n - shared), 4) AS jaccard FROM p JOIN n a ON a.item = term JOIN n b ON b.item = other)
      SELECT term, rank, other, shared, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY jaccard DESC, shared DESC, other) AS rank FROM s) WHERE rank <= 5""",
    "file_table": f"""WITH {CUR}, f AS (SELECT file_id, arg_min(title, chunk_id) AS title, count(*) AS n_chunks FROM cur GROUP BY file_id),
      t AS (SELECT file_id, string_agg(item, '|' ORDER BY item) AS tags FROM {_items('tags')} GROUP BY file_id), c AS (SELECT file_id, string_agg(item, '|' ORDER BY item) AS concepts FROM {_items('concepts')} GROUP BY file_id)
      SELECT f.file_id, title, n_chunks, coalesce(tags, '') AS tags, coalesce(concepts, '') AS concepts FROM f LEFT JOIN t USING (file_id) LEFT JOIN c USING (file_id)""",
    "file_detail": f"""WITH {CUR}, p AS (SELECT file_id, count(*) AS n_parts, sum(('0x' || substr(md5(chunk_id || '/' || md5(coalesce(text, ''))), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS digest FROM cur GROUP BY file_id)
      SELECT p.file_id, relpath, n_parts, digest FROM p LEFT JOIN files USING (file_id)""",
    "file_chunks": f"WITH {CUR} SELECT file_id, chunk_id, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS place, heading_path, tokens FROM cur",
    "manifest": "SELECT " + ", ".join(_CELL.format(c=c) for c in "file_id type category subcategory title n_chunks n_tokens n_pages source_type relpath".split()) + f""" FROM files
      WHERE NOT regexp_matches(relpath, '(^|/)\\.') AND NOT list_has_any(string_split(relpath, '/'), ['_trash', '_add_by_me', '_logs']) AND NOT (list_contains(string_split(relpath, '/'), '_index') AND NOT list_contains(string_split(relpath, '/'), 'saved_queries'))
        AND NOT (NOT contains(relpath, '/') AND (starts_with(relpath, '_') OR relpath IN ({_ROOT}))) AND NOT regexp_matches(relpath, '(^|/)_audit_[^/]*\\.md$')""",
    "index_header": "SELECT count(*) AS n_files, sum(n_chunks)::BIGINT AS n_chunks, sum(n_tokens)::BIGINT AS n_tokens, count(*) FILTER (WHERE type = 'pdf') AS n_pdf FROM files",
    "chunk_export": f"WITH {CUR} SELECT c.file_id, chunk_id, c.relpath, heading_path, source_type, n_pages, length(text)::INTEGER AS n_chars FROM cur c LEFT JOIN files f ON f.file_id = c.file_id",
    "mirror_groups": f"""SELECT 'category' AS page, coalesce(category, '') AS name, count(*) AS n_files FROM files GROUP BY 2 UNION ALL
      SELECT * FROM (SELECT 'tag', item, count(*) AS n FROM {_items('tags')} GROUP BY item ORDER BY n DESC, item LIMIT 80)""",
    "stale_pages": f"""WITH {CUR}, f AS (SELECT file_id FROM files WHERE type = 'md'), c AS (SELECT file_id, bool_or(trim(coalesce(text, '')) <> '') AS filled FROM cur GROUP BY file_id)
      SELECT file_id, 'no file' AS state FROM c WHERE file_id NOT IN (SELECT file_id FROM f) UNION ALL SELECT file_id, 'no text' FROM f WHERE file_id NOT IN (SELECT file_id FROM c WHERE filled)""",
    "embed_plan": f"""WITH {CUR}, was AS (SELECT sha1, min(row_ix) AS row_ix FROM emb_ids WHERE sha1 IS NOT NULL GROUP BY sha1)
      SELECT file_id, chunk_id, sha1, row_ix FROM (SELECT file_id, chunk_id, sha1(text) AS sha1 FROM cur WHERE text IS NOT NULL) LEFT JOIN was USING (sha1)""",
    "embed_validity": """WITH m AS (SELECT DISTINCT row_ix, len(embedding) AS l FROM emb_matrix WHERE row_ix IS NOT NULL), i AS (SELECT DISTINCT row_ix FROM emb_ids WHERE row_ix IS NOT NULL)
      SELECT n_ids, n_vectors, unmatched, lengths, CASE WHEN n_vectors = 0 THEN 'no vectors' WHEN unmatched > 0 THEN 'ids and vectors differ' WHEN lengths > 1 THEN 'lengths differ' ELSE 'valid' END AS state
      FROM (SELECT (SELECT count(*) FROM i) AS n_ids, (SELECT count(DISTINCT row_ix) FROM m) AS n_vectors,
        (SELECT count(*) FROM i WHERE row_ix NOT IN (SELECT row_ix FROM m)) + (SELECT count(DISTINCT row_ix) FROM m WHERE row_ix NOT IN (SELECT row_ix FROM i)) AS unmatched, (SELECT count(DISTINCT l) FROM m) AS lengths)""",
    "embedding_rows": "SELECT coalesce(len(embedding), -1)::INTEGER AS length, count(*) AS n FROM emb_matrix GROUP BY 1",
    "stream_embed_delta": "SELECT DISTINCT sha1(text) AS sha1 FROM chunks WHERE text IS NOT NULL AND sha1(text) NOT IN (SELECT sha1 FROM emb_ids WHERE sha1 IS NOT NULL)",
    "embed_delta": f"""WITH {CUR}, now AS (SELECT sha1(text) AS d FROM cur WHERE text IS NOT NULL), was AS (SELECT DISTINCT sha1 AS d FROM emb_ids WHERE sha1 IS NOT NULL)
      SELECT state, count(*) AS n FROM (SELECT CASE WHEN d IN (SELECT d FROM was) THEN 'reused' ELSE 'encoded' END AS state FROM now UNION ALL SELECT 'dropped' FROM was WHERE d NOT IN (SELECT d FROM now)) GROUP BY state""",
    "unembedded": f"WITH {CUR} SELECT category, count(*) AS n FROM cur c WHERE NOT EXISTS (SELECT 1 FROM emb_ids e WHERE e.file_id = c.file_id AND e.chunk_id = c.chunk_id) GROUP BY category",
    "source_fingerprint": r"""WITH h AS (SELECT sha256(coalesce(relpath, '\N') || '|' || coalesce(n_tokens::VARCHAR, '\N')) AS h FROM files),
      s AS (SELECT coalesce(sum(('0x' || substr(h, 1, 12))::BIGINT), 0)::HUGEINT::VARCHAR AS a, coalesce(sum(('0x' || substr(h, 13, 12))::BIGINT), 0)::HUGEINT::VARCHAR AS b, count(*) AS n FROM h)
      SELECT sha256(a || '|' || b || '|' || n) AS digest, n FROM s""",
    "daily_log_upsert": """WITH r AS (SELECT *, lower(trim(kind)) AS k FROM log_entries WHERE entry_date IS NOT NULL AND trim(kind) <> '')
      SELECT entry_date::VARCHAR AS entry_date, k AS kind, arg_max_null(title, (ingested_at, log_id)) AS title, arg_max_null(body, (ingested_at, log_id)) AS body, count(*) AS runs, CASE WHEN count(*) > 1 THEN 'Runs today: ' || count(*) END AS note FROM r GROUP BY ALL""",
    "log_newest_first": "SELECT log_id, '## [' || entry_date || '] ' || coalesce(lower(trim(kind)), '') || ' | ' || coalesce(title, '') AS heading FROM log_entries WHERE entry_date IS NOT NULL",
    "stream_daily_counts": "SELECT (ingested_at AT TIME ZONE 'UTC')::DATE::VARCHAR AS day, lower(trim(kind)) AS kind, count(*) AS runs FROM log_entries WHERE ingested_at IS NOT NULL AND trim(kind) <> '' GROUP BY ALL",
    "stream_first_deliveries": "SELECT DISTINCT entry_date::VARCHAR AS entry_date, kind, title FROM log_entries WHERE ingested_at IS NOT NULL",
}
