"""How tasks get a graph's edges, put them in order and sum up rounds over them."""

import re

import numpy as np
import pytest

from wanderank import queries
from wanderank.operators import estimators, intask, power
from wanderank.operators.gather import Gather, dense, in_order
from wanderank.operators.push import unit_state
from wanderank.plans import adaptive, bounded
from wanderank.plans.params import Params
from wanderank.sources.graphs import graph_of


def rounds_of(src, dst, at, rounds, n):
    """Scores by ``_rounds``, by plain rounds, and how many rounds the first made."""
    deg = np.bincount(src, minlength=n)
    moved, ends = Gather(src, dst, None, n), np.flatnonzero(deg == 0)
    found, made = power._rounds(moved, 0.8 / np.maximum(deg, 1), ends, at, 0.2, rounds)
    p = np.zeros(n)
    p[at] = 0.2
    for _ in range(rounds - 1):
        new = np.zeros(n)
        np.add.at(new, dst, 0.8 * p[src] / deg[src])
        new[at] += 0.2 + 0.8 * p[ends].sum()
        p = new
    return found, p, made


def random_edges(n=300, m=12_000, dead=0):
    r = np.random.default_rng(7)
    return r.integers(0, n - dead, m), r.integers(0, n, m)


# ---- rounds of the ground truth ------------------------------------------------------------------------------------------


def test_rounds_left_are_added_as_a_series():
    """Before, all 100 rounds were made one by one, also where each only added 0.8 times what the one before had."""
    found, want, made = rounds_of(*random_edges(), 3, 100, 300)
    assert made < 50 and np.abs(found - want).max() < 1e-15


@pytest.mark.parametrize("rounds", [2, 5, 30, 100])
def test_a_series_ends_with_the_rounds_that_were_asked_for(rounds):
    """Dead ends give back to the source; few rounds are those few, and not the limit."""
    found, want, made = rounds_of(*random_edges(dead=20), 3, rounds, 300)
    assert made <= min(rounds, 50) and np.abs(found - want).max() < 1e-15


@pytest.mark.parametrize("kind", ["path", "ring", "halves"])
def test_rounds_that_are_no_series_are_made(kind):
    """No node is left out that a later round reaches, and where rounds differ none is left out."""
    n = 150
    a = np.arange(n - 1)
    src, dst = (a, a + 1) if kind == "path" else (np.append(a, n - 1), np.append(a + 1, 0))
    if kind == "halves":  # two dense halves with one long way between them
        s, d = random_edges(40, 800)
        src, dst = np.concatenate([s, d + 110, np.arange(39, 110)]), np.concatenate([d, s + 110, np.arange(40, 111)])
    found, want, made = rounds_of(src, dst, 0, 100, n)
    assert np.abs(found - want).max() < 1e-14 and ((found > 0) == (want > 0)).all()
    assert kind == "halves" or made == 100


# ---- edges in order -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("low", [0, -7, 2**31 - 20, -(2**31) - 3, 2**40, -(2**62)])
@pytest.mark.parametrize("far", [0, 2**50])
@pytest.mark.parametrize("most", [None, 1, 300, 2**60])
def test_edges_are_numbered_and_sorted(low, far, most):
    """Before, ids were looked up by search and edges sorted by two keys in turn, 3.7 s of a task of 6 million edges."""
    r = np.random.default_rng(3)
    src, dst, more = r.integers(0, 20, 60) + low, r.integers(0, 20, 60) + low + far, np.array([low - 1, low + 30])
    ids, a, b = dense(src, dst, more)
    assert ids.tolist() == np.unique(np.concatenate([src, dst, more])).tolist() and (ids[a] == src).all() and (ids[b] == dst).all()
    cnt = None if most is None else r.integers(1, most + 1, 60)
    x, y, w = in_order(a, b, cnt, len(ids))
    assert list(zip(x, y, strict=True)) == sorted(zip(a, b, strict=True))
    if cnt is not None:
        assert sorted(zip(x, y, w, strict=True)) == sorted(zip(a, b, cnt, strict=True))


def test_ids_of_both_widths():
    src, dst = np.array([2**31 - 1, 5], np.int32), np.array([-3, 5], np.int32)
    ids, a, b = dense(src, dst, np.array([-(2**31) - 9]))
    assert ids[a].tolist() == src.tolist() and ids[b].tolist() == dst.tolist()
    assert [len(c) for c in dense(src[:0], dst[:0], np.zeros(0, np.int64))] == [0, 0, 0]


# ---- edges in tasks -------------------------------------------------------------------------------------------------------


@pytest.fixture
def graph(spark):
    return graph_of(spark.createDataFrame([(i % 40, (i * 7 + i // 40) % 41) for i in range(600)], "src bigint, dst bigint"))


def exchanged(df):
    """The exchanges of a plan that carry the edges' bytes."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange[^\n]*REPARTITION", plan)


def tasks_with_edges(rows):
    def told(batches):
        import pyarrow as pa

        parts, edges = set(), 0
        for batch in batches:
            parts |= {p for p in batch.column("part").to_pylist() if p is not None}
            edges += batch.num_rows - batch.column("src").null_count
        if parts:
            yield pa.RecordBatch.from_pydict({"parts": [sorted(parts)], "edges": [edges]})

    return sorted((tuple(r.parts), r.edges) for r in rows.mapInArrow(told, "parts array<bigint>, edges bigint").collect())


@pytest.mark.parametrize("readers", [64, 2])
def test_each_part_has_a_task_with_all_edges(spark, graph, monkeypatch, readers):
    from wanderank.sources import graphs

    monkeypatch.setattr(graphs, "READERS", readers)
    work = spark.range(4).selectExpr("CAST(id % 3 AS int) AS part", "id AS a")
    rows = graph.beside(work, 3)
    assert tasks_with_edges(rows) == [((i,), graph.packed.count()) for i in range(3)]
    assert len(exchanged(rows)) == (0 if readers == 64 else 1)
    assert rows.where("a is not null").count() == 4


def test_ground_truth_exchanges_no_copies_of_the_edges(spark, graph):
    """Before, six tasks had six copies of the edges written by the exchange, 288 MB for 6 million edges."""
    assert not exchanged(power.power_scores(graph, spark.range(5).selectExpr("id AS origin"), 0.2, 100))


def test_push_exchanges_no_copies_of_the_edges(spark, graph):
    state = unit_state(spark.range(5).selectExpr("id AS origin"))
    assert not exchanged(intask.pushed(graph, state, 0.2, 1e-6, "source"))


def test_bounded_topk_exchanges_no_copies_of_the_edges(spark, graph):
    p = Params(graph.n, graph.m, 0.5, 0.2, p_fail=1e-3)
    assert not exchanged(bounded.bounded_in_tasks(graph, spark.range(5).selectExpr("id AS origin"), 5, p, 1))
    assert adaptive.topk_bounded(graph, spark.range(2).selectExpr("id AS source"), 5, p, 1).count() == 10


READ_ONCE = ["power_iteration", "topk_errors", "topk_bounded", "topk_precision_recall", "kth_value", "bounds_table", "martingale_bounds"]


@pytest.mark.parametrize("name", READ_ONCE)
def test_queries_exchange_no_copies_of_the_edges(spark, name, monkeypatch):
    """What tasks make over all edges of the event graph, in each query: they read the packed edges, which no exchange copies for them."""
    seen = []
    for module in (queries, estimators, adaptive):
        monkeypatch.setattr(module, "kept", lambda df, name="step", f=module.kept: seen.append((name, len(exchanged(df)))) or f(df, name))
    queries.forget()
    queries.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    made = [x for x in seen if x[0] in ("truth", "push", "bounded")]
    assert made and not any(n for _, n in made)
