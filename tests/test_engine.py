"""The engine object, command line, reports, stored indexes and hubs, the stream of sources, and the adaptive plans' guarantees."""

import json

import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_rows
from wanderank import cli, queries
from wanderank.functions.bounds import stops
from wanderank.operators import estimators, indexes
from wanderank.operators.push import push, unit_state
from wanderank.operators.topk import topk
from wanderank.operators.walks import BLOCK, destinations, fan_out, walked
from wanderank.plans import adaptive
from wanderank.plans.engine import PprEngine
from wanderank.plans.params import Params
from wanderank.sources.graphs import graph_of, write_graph, write_workload
from wanderank.streaming.answer import answer_stream


@pytest.fixture(scope="module")
def graph(spark):
    """Forty nodes, two hubs, some dead ends, parallel edges."""
    edges = [(i, (7 * i + 3) % 40) for i in range(36)] + [(i, i % 2) for i in range(2, 36)] * 2 + [(0, i) for i in range(1, 30)] + [(1, i) for i in range(2, 40, 3)]
    return graph_of(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(41).selectExpr("id as node"))


@pytest.fixture(scope="module")
def sources(spark):
    return spark.createDataFrame([(0,), (5,), (38,), (40,)], "source bigint")


@pytest.fixture(scope="module")
def truth(graph, sources):
    return estimators.power_iteration(graph, sources, Params(graph.n, graph.m))


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


@pytest.mark.parametrize(
    "name",
    [
        "rest_bound",
        "topk_adaptive_holds",
        "topk_bounded_holds",
        "topk_hub_holds",
        "ppr_hub_holds",
        "ppr_balanced_holds",
        "stop_test",
        "index_hit_ratio",
        "hub_sizes",
    ],
)
def test_queries_equal_their_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.execute(queries.ORACLES[name]))


def test_bounds_hold_the_exact_scores(graph, sources, truth):
    exact = {k: r["ppr"] for k, r in table(truth, "source", "node").items()}
    p = Params(graph.n, graph.m, epsilon=0.3)
    for r in adaptive.topk_bounded(graph, sources, 5, p).collect():
        assert r["lb"] - 1e-9 <= exact[r["source"], r["node"]] <= r["ub"] + 1e-9 and 0 <= r["rest_ub"]


def test_bounds_of_every_node(graph, sources, truth):
    """Before, only the list's nodes came out. The relative bound takes a score for 1/n at least where nothing better is known, so smaller ones are not promised."""
    p = Params(graph.n, graph.m, epsilon=0.3)
    found = adaptive.topk_bounded(graph, sources, 5, p, every=True)
    rows, rest = table(found, "source", "node"), {r["source"]: r["rest_ub"] for r in found.collect()}
    for (source, node), r in table(truth, "source", "node").items():
        if (source, node) not in rows:
            assert r["ppr"] <= rest[source] + 1e-9
        elif r["ppr"] >= 1 / p.n:
            assert rows[source, node]["lb"] - 1e-9 <= r["ppr"] <= rows[source, node]["ub"] + 1e-9
    listed = [sorted(map(tuple, df.collect())) for df in (found.where("rank is not null"), adaptive.topk_bounded(graph, sources, 5, p))]
    assert listed[0] == listed[1] and len(rows) > len(listed[0])


@pytest.mark.parametrize(
    ("changed", "bounded"),
    [
        (lambda df: df.withColumn("ub", F.when(F.col("rank").isNull(), 0.0).otherwise(F.col("ub"))), False),
        (lambda df: df.where("rank is not null").withColumn("rest_ub", F.lit(0.0)), False),
        (lambda df: df.where("rank is not null").withColumn("rest_ub", F.lit(1.0)), True),
    ],
    ids=["ub outside the list", "bound of the rest", "wide bound of the rest"],
)
def test_bounded_holds_checks_all_bounds(spark, monkeypatch, changed, bounded):
    """Before, it looked at the bounds of the list's nodes alone, and left the bound of the nodes not reached out."""
    plan = adaptive.topk_bounded
    monkeypatch.setattr(adaptive, "topk_bounded", lambda *a, **k: changed(plan(*a, **k)))
    rows = queries.topk_bounded_holds(spark, DATA).collect()
    assert rows and {(r["full"], r["good"], r["bounded"]) for r in rows} == {(True, True, bounded)}


def test_bounded_by_hand(spark):
    """A source with nodes 1 and 2 reached, and 3 not; one value is changed in each of the others."""
    rows, nan = [], float("nan")
    cases = [(0.4, 0.6, 0.2), (0.51, 0.6, 0.2), (0.4, 0.49, 0.2), (0.4, nan, 0.2), (0.4, 0.6, 0.1), (0.4, 0.6, nan)]
    for source, (lb, ub, rest) in enumerate(cases):
        rows += [(source, 1, 0.3, 0.4, rest), (source, 2, lb, ub, rest)]
    # a node reached that has no score, and a source of which nothing was found
    rows += [(6, 1, 0.3, 0.4, 0.2), (6, 2, 0.4, 0.6, 0.2), (6, 9, 0.01, 0.1, 0.2)]
    found = spark.createDataFrame(rows, "source int, node int, lb double, ub double, rest_ub double")
    truth = spark.createDataFrame([(s, n, v) for s in range(8) for n, v in ((1, 0.35), (2, 0.5), (3, 0.15))], "source int, node int, ppr double")
    assert {r["source"]: r["bounded"] for r in queries._bounded(found, truth).collect()} == {s: s == 0 for s in range(8)}


def test_adaptive_lists_are_exact_up_to_the_error(graph, sources, truth):
    p = Params(graph.n, graph.m, epsilon=0.3)
    want = table(topk(truth, 3), "source", "rank")
    for plan in (adaptive.topk_adaptive, adaptive.topk_martingale):
        got = table(plan(graph, sources, 3, p), "source", "rank")
        exact = {k: r["ppr"] for k, r in table(truth, "source", "node").items()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert exact.get((r["source"], r["node"]), 0) >= (1 - p.epsilon) / (1 + p.epsilon) * max(want[k]["ppr"], p.delta) - p.delta


def test_rounds_never_use_a_walk_twice(spark, graph, sources):
    p = Params(graph.n, graph.m, epsilon=0.3)
    state = push(unit_state(estimators.origins(sources)), graph.transitions(p.alpha, "absorb"), 0.05)
    first = estimators.walk_plan(state, p, 200)
    used = estimators.used_up(first, None)
    second = estimators.walk_plan(state, p, 300, used)
    a, b = table(first, "origin", "node"), table(second, "origin", "node")
    assert a.keys() == b.keys() and all(b[k]["first"] == a[k]["first"] + a[k]["n_walks"] for k in a)
    again = table(estimators.used_up(second, used), "origin", "node")
    assert all(again[k]["used"] == b[k]["first"] + b[k]["n_walks"] for k in b)


def test_hubs_come_near_the_exact_scores_saved_or_not(spark, graph, sources, truth, tmp_path):
    p = Params(graph.n, graph.m, epsilon=0.2)
    assert p.bidirectional()[0] < 1
    hubs = indexes.build_hubs(graph, p, h=3, blocks=5)
    indexes.save_hubs(hubs, str(tmp_path), p, 3)
    back = indexes.load_hubs(spark, str(tmp_path), p, 3)
    assert back.blocks == 5 and back.backward is not None
    exact = {k: r["ppr"] for k, r in table(truth, "source", "node").items()}
    without = indexes.Hubs(back.hubs, back.forward, None, back.blocks)
    answers = [{k: r["ppr"] for k, r in table(indexes.hub_ppr(graph, sources, p, h), "source", "node").items()} for h in (hubs, back, without)]
    assert answers[0] == pytest.approx(answers[1])
    for got in answers:
        assert all(abs(got.get(k, 0) - v) <= p.epsilon * max(v, p.delta) for k, v in exact.items())
    for split in (False, True):
        counts = indexes.hub_walks(graph, sources, 1000, hubs, p, split=split).groupBy("start").agg(F.sum("cnt").alias("n")).collect()
        assert all(r["n"] <= 1000 + 1e-6 for r in counts)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        indexes.load_hubs(spark, str(tmp_path), p, 4)


def test_fan_out_in_blocks_makes_each_number_once(spark):
    rows = spark.createDataFrame([(1, 0, 3 * BLOCK + 5), (2, 7, 9), (3, 4, 4)], "start bigint, lo bigint, n bigint")
    got = fan_out(rows, F.col("n"), F.col("lo")).groupBy("start").agg(
        F.count("walk").alias("c"),
        F.min("walk").alias("a"),
        F.max("walk").alias("b"),
        F.count_distinct("walk").alias("d"),
    ).collect()
    assert {tuple(r) for r in got} == {(1, 3 * BLOCK + 5, 1, 3 * BLOCK + 5, 3 * BLOCK + 5), (2, 2, 8, 9, 2)}


def test_long_walks_are_all_told(spark, graph):
    starts = fan_out(spark.createDataFrame([(0,)], "start bigint"), F.lit(200))
    assert sum(r["cnt"] for r in destinations(walked(starts, graph, alpha=0.1)).collect()) == 200


def test_neighbours_are_numbered_without_gaps(graph):
    rows = graph.neighbours.groupBy("src").agg(F.count("k").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).collect()
    deg = {r["node"]: r["out_deg"] for r in graph.nodes.collect()}
    assert all((r["n"], r["a"], r["b"]) == (deg[r["src"]], 0, deg[r["src"]] - 1) for r in rows)


def test_stop_needs_tight_bounds(spark):
    p = Params(10_000, 100_000, delta=0.0001)
    rows = [(0, i, 0.1 - i / 1000, (0.1 - i / 1000) * 0.99, (0.1 - i / 1000) * 1.01) for i in range(10)] + [(1, i, 0.00011, 0.0, 1.0) for i in range(10)]
    got = {r["source"]: r["stop"] for r in stops(spark.createDataFrame(rows, "source int, node int, ppr double, lb double, ub double"), p, 3).collect()}
    assert got == {0: True, 1: False}


def test_command_line_and_report(spark, graph, tmp_path, capsys):
    write_graph(graph, str(tmp_path / "g"))
    write_workload(spark.createDataFrame([(0, 0), (1, 5)], "query_no bigint, source bigint"), str(tmp_path / "g/ssquery.txt"))
    common = ["--prefix", str(tmp_path), "--dataset", "g", "--k", "5", "--result_dir", str(tmp_path / "out")]
    assert cli.main(["gen-exact-topk", *common]) == 0 and cli.main(["build", *common]) == 0
    capsys.readouterr()
    assert cli.main(["topk", *common, "--opt"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["figures"]["precision"] >= 0.6 and told["result"]["n"] == graph.n and told["result"]["total number of rand-walks"] > 0
    assert cli.main(["query", *common, "--with_idx"]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert 0 < told["result"]["total usage ratio of rand-walk idx"] <= 1
    saved = json.loads("".join(r["value"] for r in spark.read.text(str(tmp_path / "out/execution/g.query.push_walk.with_idx.k-5.rmax-1.json")).collect()))
    assert saved["command_line"].startswith("query") and saved["start_time"] <= saved["end_time"] and saved["timer"]["propagation"] > 0
    assert cli.main(["batch-topk", *common, "--algo", "forward_push"]) == 0
    assert spark.read.parquet(str(tmp_path / "out/batch-topk.parquet")).count() == 5
    assert spark.read.parquet(str(tmp_path / "g/exact-topk.parquet")).count() == 10


def test_engine_and_stream(spark, graph, sources, tmp_path):
    engine = PprEngine(graph, 0.3)
    with pytest.raises(ValueError):
        engine.topk(sources, 0)
    with pytest.raises(ValueError):
        engine.query(sources, "none")
    want = table(engine.topk(sources, 4, "forward_push"), "source", "rank")
    sources.write.parquet(str(tmp_path / "asked"))
    stream = spark.readStream.schema("source bigint").parquet(str(tmp_path / "asked"))
    answer_stream(engine, stream, 4, str(tmp_path / "answers"), str(tmp_path / "checkpoint"), "forward_push").awaitTermination()
    got = table(spark.read.parquet(str(tmp_path / "answers/batch=*")), "source", "rank")
    assert got == want
