"""Walks made whole within tasks are those that are made step by step."""

import pytest

from wanderank import queries
from wanderank.operators import indexes, walks
from wanderank.plans.params import Params
from wanderank.sources.graphs import graph_of

PAIRS = [(i, (i * 7 + 1) % 30) for i in range(30) if i % 11] + [(i, (i * 3 + 2) % 30) for i in range(25) if i % 11] + [(3, 4)] * 5 + [(40, 40), (-5, 2**40), (-5, 3)]


@pytest.mark.parametrize("dangling", ["walk_start", "absorb"])
def test_walks_in_tasks_are_the_same(spark, monkeypatch, dangling):
    g = graph_of(spark.createDataFrame(PAIRS, "src bigint, dst bigint"))
    starts = g.nodes.selectExpr("node AS start", "explode(sequence(1L, 3L)) AS walk")
    told = []
    for limit in (walks.LOCAL_EDGES, -1):
        monkeypatch.setattr(walks, "LOCAL_EDGES", limit)
        told.append(sorted(map(tuple, walks.walked(starts, g, 0.4, 3, dangling=dangling).collect())))
    assert told[0] == told[1]


def test_hub_walks_in_tasks_are_the_same(spark, monkeypatch):
    g = graph_of(spark.createDataFrame(PAIRS, "src bigint, dst bigint"))
    p, work = Params(g.n, g.m, alpha=0.4), spark.range(8).selectExpr("id AS source")
    hubs = indexes.Hubs(indexes.choose_hubs(g, 4), indexes.forward_oracle(g, indexes.choose_hubs(g, 4), 3, p), None, 3)
    told = []
    for limit in (walks.LOCAL_EDGES, -1):
        monkeypatch.setattr(walks, "LOCAL_EDGES", limit)
        monkeypatch.setattr(indexes, "LOCAL_EDGES", limit)
        told.append(sorted(map(tuple, indexes.hub_walks(g, work, 40, hubs, p).collect())))
    assert told[0] == told[1]


@pytest.mark.parametrize("name", ["topk_hub"])
def test_walks_are_no_joins(spark, name):
    """Before, eight joins with all numbered edges made a plan, again and again."""
    queries._graphs.pop((spark.sparkContext.applicationId, "/root/testdata/sf0.001", "links"), None)
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    made = queries.graph(spark, "/root/testdata/sf0.001", "links")
    assert "neighbours" not in made.__dict__ and "hub-neighbours" not in made._made
