"""Every core query runs on the smallest tables, and equals its SQL where it has one."""

import pytest

from corpusmill.plans import graph
from corpusmill.plans.queries import QUERIES, SQL
from tests.compare import same

#: Built on the graph, which is compared on its own: there it is made once for all of them.
ON_GRAPH = {"neighbours", "file_degrees", "isolated_files", "communities", "community_stats", "sparse_communities", "bridges", "surprising", "expanded", "expanded_full", "search_expanded"} | {n for n in QUERIES if "categor" in n and n in graph.QUERIES}


@pytest.fixture(scope="module")
def made(spark, tiny):
    return graph._graph(spark, tiny)


@pytest.fixture
def shared(request, monkeypatch):
    if request.node.callspec.params["name"] in ON_GRAPH:
        edges = request.getfixturevalue("made")
        monkeypatch.setattr(graph, "_graph", lambda spark, d: edges)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tiny, name, shared):
    same(spark, tiny, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tiny, name, shared):
    QUERIES[name](spark, tiny).collect()


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)
