"""Cleaning, routing, duplicate sources, guards and chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import markdown as M
from corpusmill.functions import urls as U
from corpusmill.functions.text import split_cell
from corpusmill.functions.titles import fixed_title
from corpusmill.operators import chunking
from corpusmill.operators import duplicates as D
from corpusmill.operators.delta import last_version
from corpusmill.sources.tables import table


def _sources(spark, d):
    return table(spark, d, "notion_sources")


def canonical_urls(spark, d):
    return _sources(spark, d).select("row_id", U.canonical_url(F.col("url")).alias("canonical"), U.host_of(F.col("url")).alias("host"))


def canonical_titles(spark, d):
    return _sources(spark, d).where("title IS NOT NULL").select("row_id", U.canonical_title(F.col("title")).alias("canonical"))


def url_handlers(spark, d):
    return _sources(spark, d).groupBy(U.handler(F.col("url")).alias("handler")).agg(F.count("*").alias("n"))


def first_per_handler(spark, d, n: int = 3):
    """The first n sources of each handler."""
    order = Window.partitionBy("handler").orderBy("row_id")
    rows = _sources(spark, d).select("row_id", U.handler(F.col("url")).alias("handler")).where("handler IS NOT NULL")
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).select("handler", "row_id")


def fetched_markers(spark, d):
    """Markers of what the tree already holds: trailing hashes of file names, with the number of files."""
    m = U.hash_suffix(F.element_at(F.split("relpath", "/"), -1)).alias("marker")
    return table(spark, d, "files").where(U.indexable(F.col("relpath"))).select(m).where("marker IS NOT NULL").groupBy("marker").agg(F.count("*").alias("n_files"))


def title_fixes(spark, d):
    """Titles that a rule changes, and why."""
    t = fixed_title(F.col("title"), F.col("url"), F.col("filename"))
    return _sources(spark, d).select("row_id", t.alias("t")).select("row_id", "t.value", "t.reason").where("reason <> ''")


def name_slugs(spark, d):
    return _sources(spark, d).where("title IS NOT NULL").select("row_id", U.file_slug(F.col("title")).alias("file_slug"), U.topic_slug(F.col("title")).alias("topic_slug"))


def clean_days(spark, d):
    return _sources(spark, d).select("row_id", F.coalesce(U.clean_day(F.col("published")), F.lit("")).alias("day"))


def short_hashes(spark, d):
    return table(spark, d, "files").select("file_id", F.substring(F.sha1("relpath"), 1, 12).alias("id12"), U.url_hash(F.col("relpath")).alias("id8"), (F.substring(F.sha1("relpath"), 1, 12) == F.col("file_id")).alias("agrees"))


def path_parts(spark, d):
    p = F.split("relpath", "/")
    depth = F.size(p)
    return table(spark, d, "files").select(
        "file_id", F.when(depth > 1, F.get(p, F.lit(0))).otherwise("").alias("category"), F.when(depth > 2, F.get(p, F.lit(1))).otherwise("").alias("subcategory"), F.element_at(p, -1).alias("name")
    )


def list_cells(spark, d):
    """Values of one-cell lists and how many rows hold them."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), split_cell(F.col(c)).alias("v")) for c in ("tags", "concepts", "risk_category")])
    rows = _sources(spark, d).select("row_id", F.explode(cells).alias("c")).select("row_id", "c.field", F.explode("c.v").alias("value"))
    return rows.distinct().groupBy("field", "value").agg(F.count("*").alias("n_rows"))


def sidecar_last_wins(spark, d):
    """One row per file name, the last."""
    return last_version(_sources(spark, d).where("filename IS NOT NULL"), ["filename"], ["row_id"]).select("filename", "row_id", "source_type")


def files_with_sidecar(spark, d):
    """Files joined to their sidecar row by name; the file's own value wins, the sidecar fills gaps."""
    side = sidecar_last_wins(spark, d).withColumnRenamed("source_type", "sidecar_type")
    f = table(spark, d, "files").withColumn("filename", F.element_at(F.split("relpath", "/"), -1))
    return f.join(side, "filename", "left").select("file_id", "row_id", F.coalesce(F.nullif(F.trim("source_type"), F.lit("")), F.nullif(F.trim("sidecar_type"), F.lit("")), F.lit("")).alias("source_type"))


def refetch_guard(spark, d):
    """Sources with a file suffix that isn't among those already in the tree, once per suffix; sources without one are in refetch_guard_addresses."""
    suffix = U.hash_suffix(F.col("filename"))
    seen = table(spark, d, "files").select(U.hash_suffix(F.col("relpath")).alias("h")).where("h IS NOT NULL").distinct()
    return _sources(spark, d).select(suffix.alias("h"), "row_id").where("h IS NOT NULL").join(seen, "h", "left_anti").groupBy("h").agg(F.min("row_id").alias("row_id"))


def _fetchable(spark, d):
    """row_id, kind, claim, h of every source with an address, and those of them that the tree doesn't hold."""
    kind, parts = U.handler(F.col("url")), F.split("relpath", "/")
    paper = F.when(F.col("kind") == "arxiv", U.arxiv_id(F.col("url")))
    address = F.when(F.col("kind") == "arxiv", U.fetched_url(F.col("url"))).otherwise(F.trim("url"))
    rows = _sources(spark, d).withColumn("kind", kind).where("kind IS NOT NULL").select("row_id", "kind", paper.alias("paper"), F.coalesce(U.hash_suffix(F.col("filename")), U.url_hash(address)).alias("h"))
    tree = table(spark, d, "files").where(~F.exists(parts, lambda p: p.startswith(".") | (p == "_trash"))).select(F.element_at(parts, -1).alias("name"))
    seen = tree.select(U.hash_suffix(F.col("name")).alias("h")).where("h IS NOT NULL").distinct()
    papers = tree.select(U.arxiv_id(F.col("name")).alias("paper")).where("paper IS NOT NULL").distinct()
    claimed = lambda x: x.withColumn("claim", F.coalesce("paper", "h"))
    return claimed(rows), claimed(rows.join(seen, "h", "left_anti").join(papers, "paper", "left_anti"))


def refetch_guard_addresses(spark, d):
    """Every source with an address that isn't in the tree yet: what a fetch would still take, once per paper or hash.

    The marker is the suffix of the source's file name, else the hash of the address that would be fetched. A
    source is in the tree if a file outside of the trash and hidden folders ends in its marker, or has its arXiv number.
    """
    left = _fetchable(spark, d)[1]
    return left.groupBy("claim").agg(F.min_by("h", "row_id").alias("h"), F.min("row_id").alias("row_id")).select("h", "row_id")


def fetch_summary(spark, d):
    """What a fetch of all sources comes to, by handler: rows, those to take, repeats of one that is taken, and those the tree holds."""
    rows, left = _fetchable(spark, d)
    per = left.groupBy("claim", "kind").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
    taken = per.groupBy("claim").agg(F.min_by("kind", "first").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_taken"))
    n = rows.groupBy("kind").agg(F.count("*").alias("n_rows")).join(left.groupBy("kind").agg(F.count("*").alias("n_left")), "kind", "left").join(taken, "kind", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n.select(F.col("kind").alias("handler"), "n_rows", zero("n_taken").alias("n_taken"), (zero("n_left") - zero("n_taken")).alias("n_repeated"), (F.col("n_rows") - zero("n_left")).alias("n_held"))


def duplicate_groups(spark, d):
    return D.duplicate_groups(D.keyed(_sources(spark, d)))


_SCALARS, _LISTS = ["title", "author", "published", "description", "source_type"], ["tags", "concepts", "risk_category"]


def _scored(spark, d):
    return _sources(spark, d).select("row_id", D.richness(_SCALARS, _LISTS, "url").alias("richness"))


def duplicate_winners(spark, d):
    return D.winners(duplicate_groups(spark, d), _scored(spark, d))


def duplicate_summary(spark, d):
    return duplicate_groups(spark, d).groupBy("group_type").agg(F.count_distinct("group_key").alias("n_groups"), F.count("*").alias("n_rows"))


def document_duplicates(spark, d):
    """Documents with byte-identical texts, and those whose file names end in the same hash."""
    return D.duplicate_groups(D.keyed(table(spark, d, "documents"), "doc_id", None, None, "relpath", "text"), "doc_id")


def exact_texts(spark, d):
    """Groups of documents with byte-identical text, by digest."""
    g = table(spark, d, "documents").where("text IS NOT NULL").groupBy(F.sha1(F.col("text").cast("binary")).alias("sha1")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return g.where("copies > 1")


def vocabulary_drift(spark, d):
    """Names used in tags but not in the vocabulary, and the other way round."""
    used = table(spark, d, "chunks").select(F.explode("tags").alias("name")).where("name IS NOT NULL").distinct()
    known = table(spark, d, "vocab_terms").where("kind = 'tag'").select("name").distinct()
    return used.join(known, "name", "left_anti").select("name", F.lit("unknown").alias("state")).unionByName(known.join(used, "name", "left_anti").select("name", F.lit("unused").alias("state")))


def trigger_hits(spark, d):
    """How many sources hold a trigger of each name of the vocabulary in their title, tags or concepts. The vocabulary is a fixed table; sources are scanned once."""
    known = table(spark, d, "vocab_terms").select("kind", "name", F.explode("triggers").alias("trigger")).where("trigger IS NOT NULL").distinct().collect()
    entry = lambda r: F.struct(F.lit(r.kind).alias("kind"), F.lit(r.name).alias("name"), F.lit(r.trigger.lower()).alias("trigger"))
    rows = _sources(spark, d).select("row_id", F.lower(F.concat_ws(" ", "title", "tags", "concepts")).alias("t"))
    held = F.filter(F.array(*[entry(r) for r in known]), lambda x: F.contains(F.col("t"), x["trigger"])) if known else F.array().cast("array<struct<kind:string,name:string,trigger:string>>")
    return rows.select("row_id", F.explode(held).alias("x")).groupBy("x.kind", "x.name").agg(F.count_distinct("row_id").alias("n"))


def sentence_packs(spark, d):
    """Sentences of each document packed greedily up to the limit: number of packs and the largest."""
    packs = chunking.greedy_pack(chunking.sentence_sizes(F.col("text")), 800)
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", packs.alias("p")).select("doc_id", F.size("p").alias("packs"), F.coalesce(F.array_max("p"), F.lit(0)).alias("largest"))


def document_chunks(spark, d):
    """The chunker over whole documents; no SQL: it is a fold, tested against its rules."""
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


def summaries(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", chunking.summary(F.lit(None).cast("string"), F.col("text")).alias("summary"))


def scrubbed(spark, d):
    t = U.scrub(F.col("text"))
    return table(spark, d, "documents").where(t != F.col("text")).select("doc_id", F.md5(t).alias("digest"))


def metadata_changes(spark, d):
    """Days and authors that a rule drops, and why: the change log. Today is the day of the row's last update."""
    drop = lambda f, why: F.struct(F.lit(f).alias("field"), F.col(f).alias("old"), why.alias("reason"))
    rules = F.array(drop("published", U.day_problem(F.col("published"), F.col("updated_at"))), drop("author", U.author_problem(F.col("author"))))
    return _sources(spark, d).select("row_id", F.explode(rules).alias("c")).select("row_id", "c.*").where("reason IS NOT NULL")


def fetch_claims(spark, d):
    """Each address a fetch would take, once: hash, its number of rows, and the row that claims it."""
    rows = _sources(spark, d).where("url IS NOT NULL").select("row_id", U.url_hash(U.fetched_url(F.col("url"))).alias("h"))
    return rows.groupBy("h").agg(F.count("*").alias("n_rows"), F.min("row_id").alias("row_id"))


def front_fields(spark, d):
    """The fields of every document's top block."""
    return table(spark, d, "documents").select("doc_id", F.explode(M.front_fields(F.col("text"))).alias("f")).select("doc_id", "f.field", "f.value")


def code_lines(spark, d):
    """Documents with fences: how many, and how many lines they hold."""
    return table(spark, d, "documents").select("doc_id", M.code_lines(F.col("text")).alias("c")).select("doc_id", "c.fences", "c.lines").where("fences > 0")


_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_U = "trim(regexp_replace({c}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
_CANON = f"""CASE WHEN regexp_matches({_U.format(c='url')}, '{_URL}') THEN lower(regexp_extract(u, '{_URL}', 1)) || '://' || regexp_replace(lower(regexp_extract(u, '{_URL}', 2)), '^www\\.', '')
  || regexp_replace(regexp_extract(u, '{_URL}', 3), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END ELSE '' END"""
_SRC = f"""s0 AS (SELECT *, {_U.format(c='url')} AS u FROM notion_sources),
s1 AS (SELECT *, list_filter(string_split(regexp_extract(u, '{_URL}', 4), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_|ref|fbclid|gclid|mc_cid|mc_eid)')) AS kept FROM s0),
src AS (SELECT *, {_CANON} AS canonical, coalesce(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]+)', 1)), '^www\\.', ''), '') AS host,
  trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+', ' ', 'g')) AS ctitle, nullif(regexp_extract(filename, '_([0-9a-f]{{8}})\\.[A-Za-z0-9]+$', 1), '') AS suffix FROM s1)"""
_GROUPS = f"""{_SRC}, keyed AS (SELECT row_id, 'canonical_url' AS group_type, canonical AS group_key, 1 AS p FROM src WHERE canonical <> '' UNION ALL
  SELECT row_id, 'title_host', ctitle || '@' || host, 2 FROM src WHERE ctitle <> '' AND host <> '' UNION ALL SELECT row_id, 'hash_suffix', 'suffix:' || suffix, 4 FROM src WHERE suffix IS NOT NULL),
sized AS (SELECT *, count(*) OVER (PARTITION BY group_type, group_key) AS size FROM keyed), m AS (SELECT * FROM sized WHERE size > 1),
url AS (SELECT row_id FROM m WHERE p = 1), t AS (SELECT DISTINCT group_key FROM m WHERE p = 2 AND row_id NOT IN (SELECT row_id FROM url)),
kept AS (SELECT * FROM m WHERE p = 1 OR (p = 2 AND group_key IN (SELECT group_key FROM t))),
inside AS (SELECT DISTINCT x.group_key FROM (SELECT x.group_key, x.size, y.group_type AS t2, y.group_key AS k2, count(*) AS c FROM m x JOIN kept y ON x.row_id = y.row_id WHERE x.p = 4 GROUP BY ALL) x WHERE c = size),
dg AS (SELECT group_type, group_key, row_id, size FROM kept UNION ALL SELECT group_type, group_key, row_id, size FROM m WHERE p = 4 AND group_key NOT IN (SELECT group_key FROM inside))"""
_FILLED = "CASE WHEN coalesce(lower(trim({c})) NOT IN ('', 'null', '~', '[]', '[ ]'), false) {more} THEN 1 ELSE 0 END"
_RICH = " + ".join([_FILLED.format(c=c, more="") for c in _SCALARS] + [_FILLED.format(c=c, more=f"AND length({c}) > 2") for c in _LISTS] + ["CASE WHEN contains(url, '://') THEN 1 ELSE 0 END"])
_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SIDE = "side AS (SELECT filename, max(row_id) AS row_id, arg_max(coalesce(source_type, chr(1)), row_id) AS st FROM notion_sources WHERE filename IS NOT NULL GROUP BY filename)"

_LEFT = r"""WITH n AS (SELECT row_id, trim(url) AS u, regexp_matches(lower(trim(url)), '^https?://([a-z0-9.]+\.)?arxiv\.org/') AS arxiv, nullif(regexp_extract(filename, '_([0-9a-f]{8})\.[A-Za-z0-9]+$', 1), '') AS suffix,
        regexp_extract(url, 'arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,6})', 1) AS a, nullif(regexp_extract(url, '(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,6})(?:[^0-9]|$)', 1), '') AS p FROM notion_sources WHERE trim(url) <> ''),
      k AS (SELECT row_id, CASE WHEN arxiv THEN 'arxiv' WHEN regexp_matches(lower(u), '\.pdf([?#].*)?$') THEN 'pdf' ELSE 'web' END AS handler, CASE WHEN arxiv THEN p END AS paper, coalesce(suffix, substr(sha1(CASE WHEN arxiv AND a <> '' THEN 'https://arxiv.org/pdf/' || a || '.pdf' ELSE u END), 1, 8)) AS h FROM n),
      t AS (SELECT string_split(relpath, '/')[-1] AS name FROM files WHERE NOT regexp_matches(relpath, '(^|/)(\.|_trash(/|$))')),
      l AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE regexp_extract(name, '_([0-9a-f]{8})\.[A-Za-z0-9]+$', 1) = k.h) AND NOT EXISTS (SELECT 1 FROM t WHERE regexp_extract(name, '(?:^|[^0-9.])([0-9]{4}\.[0-9]{4,6})(?:[^0-9]|$)', 1) = k.paper))"""

QUERIES = {
    f.__name__: f
    for f in (canonical_urls, canonical_titles, url_handlers, first_per_handler, fetched_markers, title_fixes, name_slugs, clean_days, short_hashes, path_parts, list_cells, sidecar_last_wins, files_with_sidecar, refetch_guard, refetch_guard_addresses, fetch_summary, duplicate_groups, duplicate_winners, duplicate_summary, document_duplicates, exact_texts, vocabulary_drift, trigger_hits, sentence_packs, document_chunks, summaries, scrubbed, metadata_changes, fetch_claims, front_fields, code_lines)
}
SQL = {
    "canonical_urls": f"WITH {_SRC} SELECT row_id, coalesce(canonical, '') AS canonical, host FROM src",
    "canonical_titles": f"WITH {_SRC} SELECT row_id, ctitle AS canonical FROM src WHERE title IS NOT NULL",
    "url_handlers": r"""SELECT CASE WHEN regexp_matches(lower(trim(url)), '^https?://([a-z0-9.]+\.)?arxiv\.org/') THEN 'arxiv' WHEN regexp_matches(lower(trim(url)), '\.pdf([?#].*)?$') THEN 'pdf' WHEN trim(url) <> '' THEN 'web' END AS handler, count(*) AS n FROM notion_sources GROUP BY 1""",
    "first_per_handler": r"""WITH h AS (SELECT row_id, CASE WHEN regexp_matches(lower(trim(url)), '^https?://([a-z0-9.]+\.)?arxiv\.org/') THEN 'arxiv' WHEN regexp_matches(lower(trim(url)), '\.pdf([?#].*)?$') THEN 'pdf' WHEN trim(url) <> '' THEN 'web' END AS handler FROM notion_sources)
      SELECT handler, row_id FROM (SELECT *, row_number() OVER (PARTITION BY handler ORDER BY row_id) AS r FROM h WHERE handler IS NOT NULL) WHERE r <= 3""",
    "fetched_markers": r"""SELECT regexp_extract(relpath, '_([0-9a-f]{8})\.[A-Za-z0-9]+$', 1) AS marker, count(*) AS n_files FROM files WHERE regexp_matches(relpath, '_([0-9a-f]{8})\.[A-Za-z0-9]+$') GROUP BY 1""",
    "name_slugs": r"""SELECT row_id, substr(regexp_replace(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) AS file_slug, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS topic_slug FROM notion_sources WHERE title IS NOT NULL""",
    "clean_days": r"""WITH x AS (SELECT row_id, regexp_extract(trim(published), '^(\d{4}-\d{2}-\d{2})', 1) AS d FROM notion_sources)
      SELECT row_id, CASE WHEN d <> '' AND try_cast(d AS DATE) >= DATE '2010-01-01' AND d NOT LIKE '%-01-01' THEN d ELSE '' END AS day FROM x""",
    "short_hashes": "SELECT file_id, substr(sha1(relpath), 1, 12) AS id12, substr(sha1(relpath), 1, 8) AS id8, substr(sha1(relpath), 1, 12) = file_id AS agrees FROM files",
    "path_parts": "WITH p AS (SELECT file_id, string_split(relpath, '/') AS p FROM files) SELECT file_id, CASE WHEN len(p) > 1 THEN p[1] ELSE '' END AS category, CASE WHEN len(p) > 2 THEN p[2] ELSE '' END AS subcategory, p[-1] AS name FROM p",
    "list_cells": f"""WITH c AS (SELECT row_id, 'tags' AS field, tags AS c FROM notion_sources UNION ALL SELECT row_id, 'concepts', concepts FROM notion_sources UNION ALL SELECT row_id, 'risk_category', risk_category FROM notion_sources),
      v AS (SELECT row_id, field, regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g') AS value FROM (SELECT row_id, field, unnest(regexp_split_to_array(c, '[,|]')) AS x FROM c WHERE c IS NOT NULL))
      SELECT field, value, count(DISTINCT row_id) AS n_rows FROM v WHERE value <> '' GROUP BY ALL""",
    "sidecar_last_wins": f"WITH {_SIDE} SELECT filename, row_id, nullif(st, chr(1)) AS source_type FROM side",
    "files_with_sidecar": f"""WITH {_SIDE} SELECT file_id, row_id, coalesce(nullif(trim(source_type), ''), nullif(trim(nullif(st, chr(1))), ''), '') AS source_type FROM files f LEFT JOIN side s ON s.filename = string_split(f.relpath, '/')[-1]""",
    "refetch_guard": r"""WITH n AS (SELECT row_id, nullif(regexp_extract(filename, '_([0-9a-f]{8})\.[A-Za-z0-9]+$', 1), '') AS h FROM notion_sources)
      SELECT h, min(row_id) AS row_id FROM n WHERE h IS NOT NULL AND h NOT IN (SELECT regexp_extract(relpath, '_([0-9a-f]{8})\.[A-Za-z0-9]+$', 1) FROM files) GROUP BY h""",
    "refetch_guard_addresses": _LEFT + " SELECT arg_min(h, row_id) AS h, min(row_id) AS row_id FROM l GROUP BY coalesce(paper, h)",
    "fetch_summary": _LEFT + """, t1 AS (SELECT arg_min(handler, row_id) AS handler FROM l GROUP BY coalesce(paper, h)),
      a AS (SELECT handler, count(*) AS n_rows FROM k GROUP BY 1), b AS (SELECT handler, count(*) AS n_left FROM l GROUP BY 1), c AS (SELECT handler, count(*) AS n_taken FROM t1 GROUP BY 1)
      SELECT handler, n_rows, coalesce(n_taken, 0) AS n_taken, coalesce(n_left, 0) - coalesce(n_taken, 0) AS n_repeated, n_rows - coalesce(n_left, 0) AS n_held FROM a LEFT JOIN b USING (handler) LEFT JOIN c USING (handler)""",
    "duplicate_groups": f"WITH {_GROUPS} SELECT * FROM dg",
    "duplicate_winners": f"""WITH {_GROUPS}, r AS (SELECT row_id, {_RICH} AS richness FROM notion_sources)
      SELECT group_type, group_key, row_id, size, richness, row_number() OVER (PARTITION BY group_type, group_key ORDER BY richness DESC, row_id) = 1 AS winner FROM dg JOIN r USING (row_id)""",
    "duplicate_summary": f"WITH {_GROUPS} SELECT group_type, count(DISTINCT group_key) AS n_groups, count(*) AS n_rows FROM dg GROUP BY group_type",
    "document_duplicates": """WITH k AS (SELECT doc_id, 'content_hash' AS group_type, 'sha1:' || substr(sha1(text), 1, 12) AS group_key FROM documents WHERE text IS NOT NULL
        UNION ALL SELECT doc_id, 'hash_suffix', 'suffix:' || regexp_extract(relpath, '_([0-9a-f]{8})\\.[A-Za-z0-9]+$', 1) FROM documents WHERE regexp_matches(relpath, '_([0-9a-f]{8})\\.[A-Za-z0-9]+$')),
      m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY group_type, group_key) AS size FROM k) WHERE size > 1),
      i AS (SELECT x.group_key FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.group_type = 'hash_suffix' AND y.group_type = 'content_hash' GROUP BY x.group_key, x.size, y.group_key HAVING count(*) = x.size)
      SELECT * FROM m WHERE group_type = 'content_hash' OR group_key NOT IN (SELECT group_key FROM i)""",
    "exact_texts": "SELECT sha1(text) AS sha1, count(*) AS copies, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "vocabulary_drift": """WITH u AS (SELECT DISTINCT unnest(tags) AS name FROM chunks), k AS (SELECT DISTINCT name FROM vocab_terms WHERE kind = 'tag')
      SELECT name, 'unknown' AS state FROM u WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM k) UNION ALL SELECT name, 'unused' FROM k WHERE name NOT IN (SELECT name FROM u WHERE name IS NOT NULL)""",
    "trigger_hits": """WITH v AS (SELECT DISTINCT kind, name, unnest(triggers) AS t FROM vocab_terms), r AS (SELECT row_id, lower(concat_ws(' ', title, tags, concepts)) AS x FROM notion_sources)
      SELECT kind, name, count(DISTINCT row_id) AS n FROM r JOIN v ON contains(x, lower(t)) GROUP BY ALL""",
    "sentence_packs": r"""WITH s AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '([.!?])[ \t\r\n\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> ''),
        lambda x: greatest(1, floor(len(list_filter(regexp_split_to_array(x, '[ \t\r\n\f]+'), lambda w: w <> '')) / 0.75))::INTEGER) AS z FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, CASE WHEN len(z) = 0 THEN {'packs': []::INTEGER[], 'cur': 0} ELSE list_reduce(list_prepend({'packs': []::INTEGER[], 'cur': 0}, list_transform(z, lambda x: {'packs': []::INTEGER[], 'cur': x})),
        lambda a, x: CASE WHEN a.cur > 0 AND a.cur + x.cur > 800 THEN {'packs': list_append(a.packs, a.cur), 'cur': x.cur} ELSE {'packs': a.packs, 'cur': a.cur + x.cur} END) END AS r FROM s)
      SELECT doc_id, (len(r.packs) + CASE WHEN r.cur > 0 THEN 1 ELSE 0 END)::INTEGER AS packs, greatest(coalesce(list_max(r.packs), 0), r.cur)::INTEGER AS largest FROM p""",
    "summaries": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r\n\f]*\n'), lambda x: regexp_replace(x, '^[ \t\r\n\f]+|[ \t\r\n\f]+$', '', 'g')), lambda x: x <> '' AND NOT (starts_with(x, '#') AND length(x) < 80)) AS ps FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, coalesce(array_to_string(string_split(regexp_replace(ps[1], '([.!?])[ \t\r\n\f]+([A-Z(])', '\1' || chr(1) || '\2', 'g'), chr(1))[1:4], ' '), '') AS summary FROM p""",
    "scrubbed": r"""WITH x AS (SELECT doc_id, text, regexp_replace(text, '[\x00-\x08\x0B-\x1F\x7F]', ' ', 'g') AS t FROM documents) SELECT doc_id, md5(t) AS digest FROM x WHERE t <> text""",
    "metadata_changes": r"""WITH x AS (SELECT row_id, published, author, regexp_extract(trim(published), '^(\d{4}-\d{2}-\d{2})', 1) AS iso, strftime(updated_at, '%Y-%m-%d') AS now FROM notion_sources),
      c AS (SELECT row_id, 'published' AS field, published AS old, CASE WHEN iso = '' THEN NULL WHEN iso = now THEN 'today' WHEN iso LIKE '%-01-01' THEN 'first of January' WHEN iso > now THEN 'in the future' WHEN iso < '2010' THEN 'before 2010' END AS reason FROM x
        UNION ALL SELECT row_id, 'author', author, CASE WHEN contains(author, 'Authority control databases') THEN 'contains Authority control databases' WHEN contains(author, 'CONTRIBUTORS ') THEN 'contains CONTRIBUTORS'
          WHEN contains(author, 'MusicBrainz') THEN 'contains MusicBrainz' WHEN length(trim(author)) > 200 THEN 'too long' END FROM x)
      SELECT * FROM c WHERE reason IS NOT NULL""",
    "fetch_claims": r"""WITH u AS (SELECT row_id, trim(url) AS u, regexp_extract(url, 'arxiv\.org/(?:abs|pdf)/(\d{4}\.\d{4,6})', 1) AS a FROM notion_sources WHERE url IS NOT NULL)
      SELECT substr(sha1(CASE WHEN a <> '' THEN 'https://arxiv.org/pdf/' || a || '.pdf' ELSE u END), 1, 8) AS h, count(*) AS n_rows, min(row_id) AS row_id FROM u GROUP BY 1""",
    "front_fields": r"""WITH b AS (SELECT doc_id, regexp_extract(text, '^(?:\x{FEFF})?---[ \t]*\r?\n((?:[^\n]*\n)*?)---[ \t]*(?:\r?\n|\z)', 1) AS block FROM documents WHERE text IS NOT NULL),
      f AS (SELECT doc_id, unnest(regexp_extract_all(block, '(?m)^([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:[ \t]*([^\r\n]*)', 1)) AS field, unnest(regexp_extract_all(block, '(?m)^([A-Za-z_][A-Za-z0-9_-]*)[ \t]*:[ \t]*([^\r\n]*)', 2)) AS value FROM b)
      SELECT doc_id, field, regexp_replace(value, '^[ \t''"]+|[ \t''"]+$', '', 'g') AS value FROM f""",
    "code_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE contains(text, '```')),
      f AS (SELECT *, regexp_matches(x, '^[ \t]*```') AS fence FROM l), s AS (SELECT *, sum(fence::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS open FROM f)
      SELECT doc_id, sum(fence::INTEGER)::INTEGER AS fences, sum((NOT fence AND open % 2 = 1)::INTEGER)::INTEGER AS lines FROM s GROUP BY doc_id HAVING sum(fence::INTEGER) > 0""",
}
