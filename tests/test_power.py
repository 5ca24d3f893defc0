"""Power iteration over all sources at once: both of its forms against rounds of push, and how many jobs it takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wanderank import queries
from wanderank.operators.estimators import origins, reserves
from wanderank.operators.gather import PIECE, Gather
from wanderank.operators.power import power_scores
from wanderank.operators.push import push, unit_state
from wanderank.sources.graphs import graph_of

PAIRS = [(-3, 5), (-3, 5), (5, 7), (7, -3), (7, 9), (9, 11), (5, 2**40), (2**40, 5), (-3, 9), (11, 11)]


def made(spark, pairs=PAIRS):
    return graph_of(spark.createDataFrame(pairs, "src bigint, dst bigint"), spark.createDataFrame([(20,)], "node bigint"))


@pytest.mark.parametrize("rounds", [1, 2, 7])
@pytest.mark.parametrize("limit", [0, 100])
def test_scores_are_the_reserves_of_as_many_rounds(spark, rounds, limit):
    g = made(spark)  # 11 and 20 are dead ends, 20 without any edge
    work = spark.createDataFrame([(-3,), (5,), (11,), (20,), (5,), (None,)], "source bigint")
    want = {(r.source, r.node): r.ppr for r in reserves(push(unit_state(origins(work)), g.transitions(0.2), 0.0, rounds)).collect()}
    found = power_scores(g, origins(work), 0.2, rounds, limit).collect()
    assert len(found) == len(want)
    assert {(r.source, r.node): pytest.approx(r.ppr, abs=1e-15) for r in found} == want


@pytest.mark.parametrize("limit", [0, 100])
def test_graphs_without_edges_or_sources(spark, limit):
    g = graph_of(spark.createDataFrame([], "src bigint, dst bigint"), spark.createDataFrame([(4,)], "node bigint"))
    found = power_scores(g, spark.createDataFrame([(4,)], "origin bigint"), 0.2, 100, limit).collect()
    assert [(r.source, r.node) for r in found] == [(4, 4)] and found[0].ppr == pytest.approx(1 - 0.8**100)
    assert power_scores(g, spark.createDataFrame([], "origin bigint"), 0.2, 100, limit).isEmpty()


def test_more_sources_than_columns_of_a_group(spark):
    g = made(spark, [(i, (i * 7 + 1) % 50) for i in range(50)] + [(i, (i * 3 + 2) % 50) for i in range(50)])
    work = spark.range(45).select(F.col("id").alias("origin"))
    told = [sorted((r.source, r.node, round(r.ppr, 12)) for r in power_scores(g, work, 0.2, 12, limit).collect()) for limit in (0, 1000)]
    assert told[0] == told[1]


@pytest.mark.parametrize("name", ["batch_topk", "stop_test", "topk_errors", "exact_topk", "bounds_table", "kth_value", "martingale_bounds", "power_iteration", "topk_precision_recall", "topk_adaptive_holds", "ppr_balanced_holds"])
def test_rounds_are_no_jobs_of_their_own(spark, name, monkeypatch):
    """The ground truth of these queries comes of few jobs; before, ten rounds made a plan and each round exchanged all of the state."""
    asked = []
    monkeypatch.setattr(queries, "exact", lambda g, rounds=100, f=queries.exact: asked.append(g) or f(g, rounds))
    queries.forget()
    queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert asked
    g = asked[0]
    queries.forget()
    sc = spark.sparkContext
    sc.setJobGroup(f"power-{name}", "")
    try:
        queries.exact(g)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup(f"power-{name}")) <= 8


def test_sums_need_no_room_for_all_edges():
    """Before, each round of the ground truth made arrays as long as the edges."""
    r = np.random.default_rng(5)
    src, dst, weight, values = r.integers(0, 900, 200_000), np.append(r.integers(0, 800, 199_000), np.full(1000, 850)), r.random(200_000), r.random(900)
    made = Gather(src, dst, weight, 900)
    assert made.sums(values) == pytest.approx(np.bincount(dst, weights=values[src] * weight, minlength=900), abs=1e-9)
    assert len(made.room) <= PIECE
    one = Gather(src, np.zeros_like(dst), weight, 900)  # all edges lead to one node
    assert one.sums(values)[0] == pytest.approx((values[src] * weight).sum()) and not one.sums(values)[1:].any()
    assert Gather(src[:0], dst[:0], weight[:0], 3).sums(np.ones(3)).tolist() == [0, 0, 0]
