"""The graph of related files."""

from __future__ import annotations

from contextvars import ContextVar

from pyspark.sql import functions as F

from corpusmill import config as C
from corpusmill.operators import facets
from corpusmill.operators import graph as G
from corpusmill.operators.dense import cosine_pairs, mean_vectors, vector_classes
from corpusmill.operators.fusion import rrf
from corpusmill.operators.lexical import RAW
from corpusmill.operators.search import Expansion, search
from corpusmill.plans.common import CUR, KEYS, VEC, bm25_sql, chunk_vectors, lexicon, vectors
from corpusmill.plans.search import _DENSE, _HYBRID, SHOWN, _asked, _hybrid_lists, _near, _rrf
from corpusmill.session import cut_lineage, release
from corpusmill.sources.tables import table

#: The shared items of the test tables weigh less than those of a small vault: the floor that keeps some edges.
FLOOR = 0.35
COSINE = 0.88


def _members(spark, d):
    return cut_lineage(facets.memberships(table(spark, d, "chunks"), {"tag": "tags", "concept": "concepts"}))


def vocabulary_edges(spark, d):
    return G.vocabulary_edges(_members(spark, d), FLOOR).select("a", "b", F.round("vocab", 4).alias("vocab"))


def link_edges(spark, d):
    c = table(spark, d, "chunks")
    return G.link_edges(c, table(spark, d, "files"))


def file_vectors(spark, d):
    """The unit mean of each file's vectors: first and last component, 5 decimals."""
    m = mean_vectors(vectors(spark, d), "file_id", "vector")
    return m.select("file_id", F.round(F.get("vector", F.lit(0)), 5).alias("first"), F.round(F.element_at("vector", -1), 5).alias("last"))


#: The vectors that a plan has kept, for the means in its graph.
_KEPT: ContextVar = ContextVar("vectors", default=None)


def _means(spark, d):
    kept = _KEPT.get()
    return cut_lineage(mean_vectors(vectors(spark, d) if kept is None else kept, "file_id", "vector"))


def cosine_edges(spark, d):
    """Pairs of representatives of files with equal mean vectors; cosine_classes gives the members."""
    return cosine_pairs(_means(spark, d), "file_id", "vector", COSINE).select("a", "b", F.round("cosine", 4).alias("cosine"))


def cosine_classes(spark, d):
    """Every file with a vector, the class it belongs to, and how many members that has."""
    return vector_classes(_means(spark, d), "file_id", "vector").select(F.col("id").alias("file_id"), "rep", "copies")


def _edges(spark, d):
    m = _means(spark, d)
    classes = cut_lineage(vector_classes(m, "file_id", "vector"))
    cos = cut_lineage(cosine_pairs(m, "file_id", "vector", COSINE, classes))
    return cut_lineage(G.first_order(_members(spark, d), link_edges(spark, d), cos, classes, FLOOR))


def first_order_edges(spark, d):
    return _edges(spark, d)


def second_order_edges(spark, d):
    return G.second_order(_edges(spark, d), FLOOR)


def _graph(spark, d):
    e = _edges(spark, d)
    return cut_lineage(G.whole_graph(e, G.second_order(e, FLOOR)))


def graph_edges(spark, d):
    """All edges with all signals."""
    return _graph(spark, d)


def neighbours(spark, d):
    return G.neighbours(_graph(spark, d))


def file_degrees(spark, d):
    return G.degrees(_graph(spark, d), table(spark, d, "files"))


def isolated_files(spark, d):
    return G.isolated(G.degrees(_graph(spark, d), table(spark, d, "files")))


def _communities(spark, d):
    e = _graph(spark, d)
    return e, cut_lineage(G.communities(e, table(spark, d, "files")))


def communities(spark, d):
    return _communities(spark, d)[1]


def community_stats(spark, d):
    return G.community_stats(*_communities(spark, d))


def sparse_communities(spark, d):
    e, labels = _communities(spark, d)
    return G.sparse_communities(G.community_stats(e, labels), _members(spark, d), labels)


def bridges(spark, d):
    return G.bridges(*_communities(spark, d))


def surprising(spark, d):
    e, labels = _communities(spark, d)
    return G.surprising(e, table(spark, d, "files"), labels)


def _by_category(spark, d):
    """The graph, and categories in place of communities: the same insights with labels that are given."""
    return _graph(spark, d), table(spark, d, "files").select("file_id", F.coalesce("category", F.lit("")).alias("community")).distinct()


def category_stats(spark, d):
    return G.community_stats(*_by_category(spark, d))


def category_concepts(spark, d):
    return G.top_concepts(_members(spark, d), _by_category(spark, d)[1])


def sparse_categories(spark, d):
    e, labels = _by_category(spark, d)
    return G.sparse_communities(G.community_stats(e, labels), _members(spark, d), labels)


def category_bridges(spark, d):
    return G.bridges(*_by_category(spark, d))


def category_surprising(spark, d):
    e, labels = _by_category(spark, d)
    return G.surprising(e, table(spark, d, "files"), labels)


#: The weights are lower for the same reason: the floor that lets some neighbours in, where the default is config.EXPAND_FLOOR.
EXPAND_FLOOR = 1.5


def _hits(spark, d, lex):
    """The fused list of each query of hybrid_rrf, as long as a reranker takes it."""
    return cut_lineage(rrf(list(_hybrid_lists(spark, d, C.RERANK_POOL * C.OVERSAMPLE, lex)[:2]), KEYS, C.RERANK_POOL))


def expanded(spark, d, lex=RAW):
    """Files that neighbours of each query's first files bring in, those already hit left out."""
    hits = _hits(spark, d, lex)
    release(spark)
    return G.expand(G.seed_files(hits), _graph(spark, d), floor=EXPAND_FLOOR, seen=hits.select("qid", "file_id").distinct())


def expanded_full(spark, d):
    return expanded(spark, d, lexicon(spark, d))


def search_expanded(spark, d):
    """The whole search: words and vectors fused, neighbours over two hops brought in, all reranked, with the default terms."""
    v = cut_lineage(vectors(spark, d))
    how = Expansion(floor=EXPAND_FLOOR, hops=2)
    kept = _KEPT.set(v)
    try:
        edges = _graph(spark, d)
    finally:
        _KEPT.reset(kept)
    return search(_asked(spark, d, v), table(spark, d, "chunks"), mode="hybrid", vectors=chunk_vectors(v), edges=edges, expansion=how, reranked=True, lexicon=lexicon(spark, d), columns=SHOWN)


_WS = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_MEM = f"""mem AS (SELECT DISTINCT file_id, kind, item FROM (SELECT file_id, 'tag' AS kind, unnest(list_transform(tags, lambda x: nullif(lower(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), ''))) AS item FROM chunks
  UNION ALL SELECT file_id, 'concept', unnest(list_transform(concepts, lambda x: nullif(lower(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g')), ''))) FROM chunks) WHERE item IS NOT NULL AND file_id IS NOT NULL),
wt AS (SELECT kind, item, CASE kind WHEN 'concept' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END / log2(count(*) + 2.0::DOUBLE) AS w FROM mem GROUP BY kind, item HAVING count(*) > 1),
voc AS (SELECT x.file_id AS a, y.file_id AS b, sum(w) AS vocab FROM mem x JOIN mem y ON x.kind = y.kind AND x.item = y.item AND x.file_id < y.file_id JOIN wt ON wt.kind = x.kind AND wt.item = x.item GROUP BY ALL)"""
_COS = f"""{VEC}, un AS (SELECT file_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM vec WHERE file_id IS NOT NULL),
mv AS (SELECT file_id, list(m ORDER BY i) AS v FROM (SELECT file_id, i, avg(x) AS m FROM (SELECT file_id, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM un) GROUP BY ALL) GROUP BY file_id),
nv AS (SELECT file_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM mv),
cls AS (SELECT file_id, min(file_id) OVER (PARTITION BY list_transform(v, lambda x: round(x, 6) + 0.0)) AS rep, count(*) OVER (PARTITION BY list_transform(v, lambda x: round(x, 6) + 0.0)) AS copies FROM nv),
rv AS (SELECT file_id, v FROM nv JOIN cls USING (file_id) WHERE rep = file_id),
cos AS (SELECT x.file_id AS a, y.file_id AS b, list_cosine_similarity(x.v, y.v) AS cosine FROM rv x JOIN rv y ON x.file_id < y.file_id WHERE list_cosine_similarity(x.v, y.v) >= 0.88)"""
_LINK = """lnk AS (SELECT DISTINCT least(file_id, t) AS a, greatest(file_id, t) AS b FROM (SELECT file_id, unnest(regexp_extract_all(text, '\\[\\[([0-9a-f]{12})__', 1)) AS t FROM chunks) WHERE t <> file_id AND t IN (SELECT file_id FROM files))"""
_EDGES = f"""WITH {_MEM}, {_COS}, {_LINK},
cand AS (SELECT a, b FROM voc WHERE vocab >= {FLOOR} - 1e-9 UNION SELECT a, b FROM lnk UNION SELECT a, b FROM cos UNION SELECT rep, file_id FROM cls WHERE rep <> file_id),
e0 AS (SELECT c.a, c.b, coalesce(v.vocab, 0) AS vocab, CASE WHEN l.a IS NULL THEN 0 ELSE 3.0::DOUBLE END AS wikilink, CASE WHEN ca.rep = cb.rep THEN 2.0::DOUBLE ELSE coalesce(2 * cosine, 0) END AS embedding
  FROM cand c LEFT JOIN voc v ON v.a = c.a AND v.b = c.b LEFT JOIN lnk l ON l.a = c.a AND l.b = c.b LEFT JOIN cls ca ON ca.file_id = c.a LEFT JOIN cls cb ON cb.file_id = c.b
  LEFT JOIN cos ON cos.a = least(ca.rep, cb.rep) AND cos.b = greatest(ca.rep, cb.rep)),
edges AS (SELECT a, b, round(vocab + wikilink + embedding, 4) AS weight, round(vocab, 4) AS vocab, round(wikilink, 4) AS wikilink, round(embedding, 4) AS embedding FROM e0 WHERE vocab + wikilink + embedding >= {FLOOR} - 1e-9)"""
_SECOND = f"""adj1 AS (SELECT a AS node, b AS nbr FROM edges UNION ALL SELECT b, a FROM edges), deg1 AS (SELECT node, count(*) AS d FROM adj1 GROUP BY node),
p2 AS (SELECT x.nbr AS a, y.nbr AS b, sum(1 / ln(d)) AS s FROM adj1 x JOIN adj1 y ON x.node = y.node AND x.nbr < y.nbr JOIN deg1 ON deg1.node = x.node GROUP BY ALL),
second AS (SELECT p2.a, p2.b, round(4 * s / sqrt(da.d * db.d), 4) AS weight FROM p2 JOIN deg1 da ON da.node = p2.a JOIN deg1 db ON db.node = p2.b
  WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.a = p2.a AND e.b = p2.b) AND 4 * s / sqrt(da.d * db.d) >= {FLOOR} - 1e-9)"""
_GRAPH = f"""{_EDGES}, {_SECOND}, graph AS (SELECT *, 0.0::DOUBLE AS aa FROM edges UNION ALL SELECT a, b, weight, 0, 0, 0, weight FROM second),
adj AS (SELECT a AS node, b AS nbr, weight FROM graph UNION ALL SELECT b, a, weight FROM graph),
degree AS (SELECT file_id, round(coalesce(sum(weight), 0), 4) AS degree, count(nbr) AS n_edges FROM (SELECT DISTINCT file_id FROM files) f LEFT JOIN adj ON adj.node = f.file_id GROUP BY file_id),
lab AS (SELECT DISTINCT file_id, coalesce(category, '') AS community FROM files),
stats AS (SELECT community, size, CASE WHEN size > 1 THEN round(coalesce(e, 0) / (size * (size - 1) / 2), 4) END AS density FROM (SELECT community, count(*) AS size FROM lab GROUP BY 1)
  LEFT JOIN (SELECT x.community, count(*) AS e FROM graph g JOIN lab x ON x.file_id = g.a JOIN lab y ON y.file_id = g.b WHERE x.community = y.community GROUP BY 1) USING (community)),
top AS (SELECT community, string_agg(item, '|' ORDER BY n DESC, item) AS concepts FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, item) AS r FROM (SELECT community, item, count(*) AS n FROM mem JOIN lab USING (file_id) WHERE kind = 'concept' GROUP BY ALL)) WHERE r <= 3 GROUP BY 1)"""

_PARTS = (
    vocabulary_edges, link_edges, file_vectors, cosine_edges, cosine_classes, first_order_edges, second_order_edges, graph_edges, neighbours, file_degrees, isolated_files, communities, community_stats, sparse_communities, bridges, surprising,
    category_stats, category_concepts, sparse_categories, category_bridges, category_surprising, expanded, expanded_full, search_expanded,
)
QUERIES = {f.__name__: f for f in _PARTS}
SQL = {
    "vocabulary_edges": f"WITH {_MEM} SELECT a, b, round(vocab, 4) AS vocab FROM voc WHERE vocab >= {FLOOR} - 1e-9",
    "link_edges": f"WITH {_LINK} SELECT * FROM lnk",
    "file_vectors": f"WITH {_COS} SELECT file_id, round(v[1], 5) AS first, round(v[-1], 5) AS last FROM nv",
    "cosine_edges": f"WITH {_COS} SELECT a, b, round(cosine, 4) AS cosine FROM cos",
    "cosine_classes": f"WITH {_COS} SELECT file_id, rep, copies FROM cls",
    "first_order_edges": _EDGES + " SELECT * FROM edges",
    "second_order_edges": f"{_EDGES}, {_SECOND} SELECT * FROM second",
    "graph_edges": _GRAPH + " SELECT * FROM graph",
    "neighbours": _GRAPH + " SELECT node, rank, nbr, weight FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, nbr) AS rank FROM adj) WHERE rank <= 10",
    "file_degrees": _GRAPH + " SELECT * FROM degree",
    "isolated_files": _GRAPH + " SELECT file_id, degree FROM degree WHERE degree < 0.5",
    "category_stats": _GRAPH + " SELECT * FROM stats",
    "category_concepts": _GRAPH + " SELECT * FROM top",
    "sparse_categories": _GRAPH + " SELECT community, size, density, coalesce(concepts, '') AS concepts FROM stats LEFT JOIN top USING (community) WHERE size >= 5 AND density < 0.15",
    "category_bridges": _GRAPH + " SELECT node AS file_id, count(DISTINCT y.community) AS n_communities FROM adj JOIN lab x ON x.file_id = node JOIN lab y ON y.file_id = nbr WHERE x.community <> y.community GROUP BY node HAVING count(DISTINCT y.community) >= 3",
    "category_surprising": _GRAPH + """, i AS (SELECT f.file_id, f.category, community, degree FROM files f JOIN lab USING (file_id) JOIN degree USING (file_id))
      SELECT a, b, weight, round(weight / log2(2 + least(x.degree, y.degree)), 4) AS surprise FROM graph JOIN i x ON x.file_id = a JOIN i y ON y.file_id = b
      WHERE wikilink = 0 AND (x.community <> y.community OR x.category IS DISTINCT FROM y.category) ORDER BY surprise DESC, a, b LIMIT 20""",
    "expanded": f"""{_GRAPH}, {CUR}, {_DENSE}, {_HYBRID}, {bm25_sql('hq', 160)}, {_near(160)}, {_rrf(['bm25', 'near'], 40)},
      seen AS (SELECT DISTINCT qid, file_id FROM fused), fh AS (SELECT qid, file_id, row_number() OVER (PARTITION BY qid ORDER BY r, file_id) AS rank FROM (SELECT qid, file_id, min(rank) AS r FROM fused GROUP BY ALL)),
      n AS (SELECT s.qid, s.file_id AS via, nbr, weight FROM fh s JOIN adj ON adj.node = s.file_id WHERE rank <= 5 AND weight >= {EXPAND_FLOOR} AND NOT EXISTS (SELECT 1 FROM seen x WHERE x.qid = s.qid AND x.file_id = nbr)),
      k AS (SELECT *, row_number() OVER (PARTITION BY qid, via ORDER BY weight DESC, nbr) AS r FROM n)
      SELECT qid, nbr AS file_id, arg_max(via, (weight, via)) AS via, max(weight) AS score FROM k WHERE r <= 3 GROUP BY ALL""",
}
