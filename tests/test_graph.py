import math

import pytest

from conftest import DATA, same_rows
from wanderank import queries
from wanderank.operators import estimators
from wanderank.operators.push import push, unit_state
from wanderank.operators.topk import kth_value, topk
from wanderank.operators.walks import destinations, fan_out, walked
from wanderank.plans import adaptive
from wanderank.plans.params import Params
from wanderank.sources.graphs import both_ways, graph_of, read_graph, read_workload, remapped, write_graph, write_workload

CASES = {
    "self_loop": ([(0, 0), (0, 1), (1, 0)], 0, {0: 5 / 9, 1: 4 / 9}),
    "cycle2": ([(0, 1), (1, 0)], 0, {0: 5 / 9, 1: 4 / 9}),
    "dead_source": ([(1, 0)], 0, {0: 1.0}),
    "chain_dead": ([(0, 1), (1, 2)], 0, {0: 25 / 61, 1: 20 / 61, 2: 16 / 61}),
    "parallel": ([(0, 1), (0, 1), (0, 2), (1, 0), (2, 0)], 0, {0: 5 / 9, 1: 8 / 27, 2: 4 / 27}),
    "star": ([(0, i) for i in range(1, 5)] + [(i, 0) for i in range(1, 5)], 0, {0: 5 / 9, 1: 1 / 9, 2: 1 / 9, 3: 1 / 9, 4: 1 / 9}),
    "isolated": ([(0, 1), (1, 0)], 2, {2: 1.0}),
}


def made(spark, edges, n=5):
    return graph_of(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(n).selectExpr("id as node"))


def source(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "source bigint")


def scores(df):
    return {r["node"]: r["ppr"] for r in df.collect()}


def test_exact_scores_of_hand_computed_graphs(spark):
    # all cases as parts of one graph, ten ids each
    edges = [(10 * c + a, 10 * c + b) for c, (pairs, _, _) in enumerate(CASES.values()) for a, b in pairs]
    g = made(spark, edges, 10 * len(CASES))
    starts = source(spark, *(10 * c + start for c, (_, start, _) in enumerate(CASES.values())))
    rows = estimators.power_iteration(g, starts, Params(g.n, g.m)).collect()
    for c, (name, (_, start, want)) in enumerate(CASES.items()):
        got = {r["node"] - 10 * c: r["ppr"] for r in rows if r["source"] == 10 * c + start}
        assert got == pytest.approx(want, abs=1e-6), name


def test_combined_estimators_agree_with_exact_ones_at_dead_ends(spark):
    edges, start, want = CASES["chain_dead"]
    g = made(spark, edges, 3)
    p = Params(g.n, g.m, epsilon=0.1)
    for got in (
        estimators.push_walk(g, source(spark, start), p),
        estimators.push_walk(g, source(spark, start), p.at(opt=True)),
        estimators.bidirectional(g, source(spark, start), p),
    ):
        assert scores(got) == pytest.approx(want, abs=0.06)


def test_push_keeps_mass_and_threshold(spark):
    g = made(spark, [(0, 1), (1, 2), (2, 0), (0, 2), (3, 0)])
    state = push(unit_state(source(spark, 0).withColumnRenamed("source", "origin")), g.transitions(0.2), 0.01)
    rows = state.join(g.nodes, "node").collect()
    assert sum(r["reserve"] + r["residual"] for r in rows) == pytest.approx(1)
    assert all(r["residual"] < 0.01 * r["out_deg"] for r in rows)


def test_walks_are_the_same_again_and_from_an_index(spark):
    g = made(spark, CASES["star"][0])
    starts = fan_out(source(spark, 0, 1).withColumnRenamed("source", "start"), __import__("pyspark").sql.functions.lit(50))
    once, again = (sorted(map(tuple, walked(starts, g).collect())) for _ in range(2))
    assert once == again and len(once) == 100
    assert sum(r["cnt"] for r in destinations(walked(starts, g)).collect()) == 100


def test_topk_has_no_padding_and_breaks_ties_by_node(spark):
    ppr = spark.createDataFrame([(0, 3, 0.2), (0, 1, 0.2), (0, 2, 0.6), (0, 4, 0.0)], "source bigint, node bigint, ppr double")
    assert [(r["rank"], r["node"]) for r in topk(ppr, 9).orderBy("rank").collect()] == [(1, 2), (2, 1), (3, 3)]
    assert kth_value(ppr, 9).first()["kth"] == 0 and kth_value(ppr, 2).first()["kth"] == 0.2


def test_adaptive_topk_finds_the_exact_list(spark):
    g = made(spark, CASES["star"][0] + [(1, 2), (2, 3), (1, 0), (1, 0)])
    p = Params(g.n, g.m, epsilon=0.3)
    want = {r["node"] for r in topk(estimators.power_iteration(g, source(spark, 0), p), 2).collect()}
    assert {r["node"] for r in adaptive.topk_adaptive(g, source(spark, 0), 2, p).collect()} == want
    bounded = adaptive.topk_bounded(g, source(spark, 0), 2, p).collect()
    assert {r["node"] for r in bounded} == want and all(r["lb"] <= r["ppr"] <= r["ub"] for r in bounded)


def test_files_round_trip_and_bad_input(spark, tmp_path):
    g = made(spark, CASES["parallel"][0], 3)
    write_graph(g, str(tmp_path / "g"))
    back = read_graph(spark, str(tmp_path / "g"))
    assert (back.n, back.m) == (3, 5)
    work = spark.createDataFrame([(0, 2), (1, 2), (2, 0)], "query_no bigint, source bigint")
    write_workload(work, str(tmp_path / "w"))
    assert [r["source"] for r in read_workload(spark, str(tmp_path / "w"), 2).orderBy("query_no").collect()] == [2, 2]
    with pytest.raises(ValueError):
        Params(3, 5, epsilon=0)


def test_ids_in_order_of_first_appearance(spark):
    pairs = spark.createDataFrame([(1, "b", "a"), (2, "a", "c"), (3, "b", "c")], "seen int, src string, dst string")
    _, ids = remapped(pairs)
    assert {r["label"]: r["node"] for r in ids.collect()} == {"b": 0, "a": 1, "c": 2}


def test_empty_graph(spark):
    g = graph_of(spark.createDataFrame([], "src bigint, dst bigint"), spark.range(1).selectExpr("id as node"))
    assert scores(estimators.power_iteration(g, source(spark, 0), Params(1, 0), 3)) == pytest.approx({0: 1.0}, abs=0.6)


def test_parameters():
    p = Params(150, 9929)
    assert p.push_walk()[1] == pytest.approx(8556, abs=1) and p.montecarlo() == pytest.approx(10267, abs=1)
    assert p.bidirectional()[0] == pytest.approx(0.983, abs=1e-3) and p.delta == 1 / 150
    assert p.at(opt=True).push_walk()[0] == pytest.approx(p.push_walk()[0] / 0.8) and math.isclose(p.forward_push(), 0.5 / 9929)


@pytest.mark.parametrize(
    "name",
    [
        "graph_stats",
        "edge_multiplicity",
        "id_remap",
        "workload_generate",
        "params_table",
        "walk_histogram",
        "walk_absorbing",
        "forward_push",
        "forward_push_dead_end",
        "backward_push",
        "ppr_push_walk",
        "index_sizes",
    ],
)
def test_queries_equal_their_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLES[name]))


def test_pairs_both_ways(spark):
    """Before, each pair was counted once for each direction."""
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (4, -1), (None, 2), (5, None), (2**40, 1)]
    a, b = graph_of(spark.createDataFrame([(x, y) for x, y in rows] + [(y, x) for x, y in rows], "src bigint, dst bigint")), both_ways(spark.createDataFrame(rows, "a bigint, b bigint"))
    assert sorted(map(tuple, a.edges.collect())) == sorted(map(tuple, b.edges.collect()))
    assert sorted(map(tuple, a.nodes.collect())) == sorted(map(tuple, b.nodes.collect()))
