import pytest

from conftest import DATA
from wanderank import queries
from wanderank.sources.graphs import graph_of


def test_registered_push_goes_on_until_nothing_is_due(spark, monkeypatch):
    edges = [(0, 1)] + [(2, 3), (3, 2)] * 1000  # 0's only link is a dead end, 1 is one
    g = graph_of(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.range(4).selectExpr("id as node"))
    monkeypatch.setattr(queries, "graph", lambda *_: g)
    monkeypatch.setattr(queries, "sources", lambda _: spark.createDataFrame([(0,), (1,)], "source bigint"))
    rows = {(r["source"], r["node"]): r for r in queries.QUERIES["forward_push_dead_end"](spark, DATA).collect()}
    assert (rows[1, 1]["reserve"], rows[1, 1]["residual"]) == (1.0, 0.0)
    assert rows[0, 0]["residual"] < 4 * queries.params(g).forward_push() and rows[0, 1]["residual"] == 0
    assert sum(r["reserve"] + r["residual"] for k, r in rows.items() if k[0] == 0) == pytest.approx(1, abs=1e-5)
