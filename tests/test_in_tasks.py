"""What tasks make whole over a graph in numpy is what joins step by step make."""

import hashlib

import numpy as np
import pytest

from wanderank.operators import estimators, indexes, intask, pieces, walks
from wanderank.operators.push import push, unit_state
from wanderank.plans import adaptive
from wanderank.plans.params import Params
from wanderank.sources.graphs import graph_of

PAIRS = [(i, (i * 7 + 1) % 30) for i in range(30) if i % 11] + [(i, (i * 3 + 2) % 30) for i in range(25) if i % 11] + [(3, 4)] * 5 + [(40, 40), (-5, 2**40), (-5, 3)]


@pytest.fixture
def graph(spark):
    return graph_of(spark.createDataFrame(PAIRS, "src bigint, dst bigint"))


def close(a, b):
    a, b = sorted(map(tuple, a.collect())), sorted(map(tuple, b.collect()))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=1e-9)


@pytest.mark.parametrize("end", [":stop", ":0:next", ":12:next"])
def test_draws(end):
    start = np.array([0, 7, -5, 12, 99, 100, 2**40, -(2**33), 1499] * 3)
    walk = np.array([1, 9, 10, 99, 100, 65536, 10**9, 3, 12345678] * 3)
    wanted = [int(hashlib.md5(f"3:{s}:{w}{end}".encode()).hexdigest()[:8], 16) for s, w in zip(start, walk, strict=True)]
    assert intask.draws(3, start, walk, end.encode()).tolist() == wanted


def test_push(spark, graph):
    state = unit_state(spark.sql("SELECT explode(array(0L, 3L, 40L, -5L, 11L)) AS origin"))
    close(intask.pushed(graph, state, 0.2, 0.01), push(state, graph.transitions(0.2, "absorb"), 0.01))


def test_forward_push(spark, graph, monkeypatch):
    """Before, each ten rounds were a job of joins with all transitions."""
    work, p, told = spark.sql("SELECT explode(array(0L, 3L, 40L, -5L, 11L)) AS source"), Params(graph.n, graph.m, epsilon=0.01), []
    assert graph.distinct and graph.packed
    limits = (estimators.LOCAL_EDGES, -1)
    for limit in limits:
        monkeypatch.setattr(estimators, "LOCAL_EDGES", limit)
        spark.sparkContext.setJobGroup(f"forward{limit}", "forward")
        told.append(estimators.forward_push(graph, work, p))
        told[-1].collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    close(*told)
    jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forward{limit}")) for limit in limits]
    assert 2 * jobs[0] < jobs[1]


@pytest.mark.parametrize("opt", [False, True])
def test_walks_of_a_plan(spark, graph, monkeypatch, opt):
    monkeypatch.setattr(intask, "BLOCK", 16)
    monkeypatch.setattr(intask, "BATCH", 50)
    work, p, told = spark.sql("SELECT explode(array(0L, 3L, 40L, -5L, 11L)) AS source"), Params(graph.n, graph.m, opt=opt, delta=0.05), []
    for limit in (estimators.LOCAL_EDGES, -1):
        monkeypatch.setattr(estimators, "LOCAL_EDGES", limit)
        told.append(estimators.push_walk(graph, work, p, 3, rmax=0.05))
    close(*told)


def test_bounded(spark, graph, monkeypatch):
    work, told = spark.sql("SELECT explode(array(0L, 3L, 40L, -5L, 11L)) AS source"), []
    for limit in (adaptive.LOCAL_EDGES, -1):
        monkeypatch.setattr(adaptive, "LOCAL_EDGES", limit)
        told.append(adaptive.topk_bounded(graph, work, 3, Params(graph.n, graph.m), 3))
    close(*told)


def test_bounds_of_every_node(spark, graph, monkeypatch):
    work, told = spark.sql("SELECT explode(array(0L, 3L, 40L, -5L, 11L)) AS source"), []
    for limit in (adaptive.LOCAL_EDGES, -1):
        monkeypatch.setattr(adaptive, "LOCAL_EDGES", limit)
        told.append(adaptive.topk_bounded(graph, work, 3, Params(graph.n, graph.m), 3, every=True).fillna(0, "rank"))
    close(*told)
    assert told[0].where("rank = 0").count() and told[0].where("rank > 3").isEmpty()


def test_bounded_makes_few_jobs(spark, graph):
    """Before, each round of delta made dozens of jobs."""
    work = spark.range(3).selectExpr("id AS source")
    assert graph.distinct and graph.n and graph.m
    spark.sparkContext.setJobGroup("bounded", "bounded")
    adaptive.topk_bounded(graph, work, 3, Params(graph.n, graph.m), 3).collect()
    spark.sparkContext.setJobGroup("other", "other")
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("bounded")) < 20


def test_balanced(spark, graph, monkeypatch):
    work, told = spark.sql("SELECT explode(array(0L, 3L, 11L)) AS source"), []
    for limit in (adaptive.LOCAL_EDGES, -1):
        monkeypatch.setattr(adaptive, "LOCAL_EDGES", limit)
        monkeypatch.setattr(estimators, "LOCAL_EDGES", limit)
        told.append(adaptive.balanced(graph, work, Params(graph.n, graph.m), 3))
    close(*told)


def test_hub_walks_are_sums(spark, graph, monkeypatch):
    """Before, a row was written for each walk."""
    hubs = indexes.Hubs(indexes.choose_hubs(graph, 4), indexes.forward_oracle(graph, indexes.choose_hubs(graph, 4), 3, Params(graph.n, graph.m)), None, 3)
    rows, keep = [], indexes.kept

    def noted(df, name):
        out = keep(df, name)
        if name == "hub-walks":
            rows.append(out.count())
        return out

    monkeypatch.setattr(indexes, "kept", noted)
    indexes.hub_walks(graph, spark.range(8).selectExpr("id AS source"), 20_000, hubs, Params(graph.n, graph.m))
    assert rows and max(rows) < 8_000


@pytest.mark.parametrize("dangling", ["absorb", "walk_start"])
def test_walks_over_pieces(spark, graph, monkeypatch, dangling):
    """Before, graphs of more than LOCAL_EDGES edges met every edge in each step of a walk."""
    monkeypatch.setattr(pieces, "PIECE", 7)
    monkeypatch.setattr(pieces, "PARTITION", 20)
    monkeypatch.setattr(walks, "TASK_WALKS", 200)
    rows, told = spark.sql("SELECT s AS start, explode(sequence(1L, 120L)) AS walk FROM (SELECT explode(array(0L, 3L, 40L, -5L, 11L)) AS s)"), []
    for limit in (walks.LOCAL_EDGES, -1):
        monkeypatch.setattr(walks, "LOCAL_EDGES", limit)
        told.append(walks.walked(rows, graph, 0.2, 3, dangling=dangling))
    assert "neighbours" not in graph.__dict__ and "pieces" in graph._made
    close(*told)


def test_levels_of_the_backward_oracle_are_one_push(spark, graph, monkeypatch):
    """Before, there was a push for each level."""
    hubs, p, made, wanted = indexes.choose_hubs(graph, 3), Params(graph.n, graph.m), [], []
    monkeypatch.setattr(indexes, "push", lambda *a, **k: made.append(a) or push(*a, **k))
    told = sorted(map(tuple, indexes.backward_oracle(graph, hubs, p, 0.1).collect()))
    for level in indexes.LEVELS:
        start = hubs.selectExpr("hub AS origin", "hub AS node", "0D AS reserve", f"{level}D AS residual")
        wanted += [(r.origin, r.node, r.reserve / level, r.residual / level, level) for r in push(start, graph.backward(p.alpha), 0.1, strict=True).collect()]
    assert len(made) == 1 and len(told) == len(wanted)
    for x, y in zip(told, sorted(wanted), strict=True):
        assert x == pytest.approx(y, abs=1e-12)
