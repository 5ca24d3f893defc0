"""Registry of graph queries and of the DuckDB SQL that checks them.

Graphs: events (user after user), links (pages to their link targets, with dead ends and string ids) and trade
(customers and suppliers). All run over their whole tables; the workload is 20 sources drawn by hash.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.bounds import martingale_bounds, rest_bound, score_bounds, stops
from .operators import estimators, indexes
from .operators.push import push, unit_state
from .operators.topk import evaluated, kth_value, precision_recall, topk
from .operators.walks import destinations, fan_out, walked
from .plans import adaptive
from .plans.engine import PprEngine
from .plans.params import Params, lambda_bound
from .report import report_row, result_fields
from .session import kept
from .sources import graphs

ALPHA, SEED, SOURCES, EXACT_ROUNDS, K, EPSILON = 0.2, 1, 20, 100, 10, 0.5
#: Rounds of the SQL of pushes that run until nothing is due: residuals fall by 1 - alpha a round, to 2e-12 of what they were.
SQL_ROUNDS = 120
WALKS = 200
_graphs: dict = {}


def graph(spark, sf_dir: str, name: str) -> graphs.Graph:
    """The graph of a folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _graphs:
        if name == "links":
            pairs, ids = graphs.remapped(graphs.pages_links(spark, sf_dir))
            _graphs[key] = graphs.graph_of(pairs)
            _graphs[key].ids = ids
        elif name == "trade":
            _graphs[key] = graphs.both_ways(graphs.trade_pairs(spark, sf_dir))
        else:
            _graphs[key] = graphs.graph_of(graphs.events_flow(spark, sf_dir))
    return _graphs[key]


def forget() -> None:
    """The next query that needs the ground truth of a graph makes it anew."""
    for g in _graphs.values():
        g.__dict__.pop("truth", None)


def sources(g: graphs.Graph) -> DataFrame:
    if not hasattr(g, "work"):
        g.work = graphs.workload(g, SOURCES, SEED)
    return g.work


def params(g: graphs.Graph, **changes) -> Params:
    return Params(g.n, g.m, EPSILON, ALPHA, **changes)


def told(df: DataFrame, *values: str, digits: int = 6) -> DataFrame:
    """Floats to the digits that both engines agree on."""
    return df.withColumns({v: F.round(v, digits) for v in values})


def exact(g: graphs.Graph, rounds: int = EXACT_ROUNDS) -> DataFrame:
    if not hasattr(g, "truth"):
        with graphs.few_at_once(g.edges.sparkSession):
            g.truth = kept(estimators.power_iteration(g, sources(g), params(g), rounds), "truth")
    return g.truth


# ---- scans and parameters ------------------------------------------------------------------------------------------


def graph_stats(spark, sf_dir):
    out = None
    for name in ("events", "links", "trade"):
        g = graph(spark, sf_dir, name)
        row = g.nodes.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("out_deg").alias("m"),
            F.count(F.when(F.col("out_deg") == 0, 1)).alias("dead_ends"),
        ).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("distinct_edges")))
        row = row.select(F.lit(name).alias("graph"), "n", "m", "dead_ends", "distinct_edges", (F.col("m") / F.col("n")).alias("mean_degree"))
        out = row if out is None else out.unionByName(row)
    return told(out, "mean_degree")


def edge_multiplicity(spark, sf_dir):
    return graph(spark, sf_dir, "events").edges


def self_loop_filter(spark, sf_dir):
    rows = graphs.events_flow(spark, sf_dir)
    return rows.agg(
        F.count(F.lit(1)).alias("m_declared"),
        F.count(F.when(F.col("src") != F.col("dst"), 1)).alias("m_loaded"),
        F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"),
    )


def id_remap(spark, sf_dir):
    return graph(spark, sf_dir, "links").ids


def file_round_trip(spark, sf_dir):
    """Edge list and attributes written as text and read again."""
    from .session import shared_dir

    g = graph(spark, sf_dir, "links")
    folder = f"{shared_dir(spark)}/wanderank-graph-{time.time_ns()}"
    graphs.write_graph(g, folder)
    return graphs.read_graph(spark, folder).edges


def workload_generate(spark, sf_dir):
    return sources(graph(spark, sf_dir, "events"))


def workload_load(spark, sf_dir):
    from .session import shared_dir

    path = f"{shared_dir(spark)}/wanderank-work-{time.time_ns()}"
    graphs.write_workload(sources(graph(spark, sf_dir, "events")), path)
    return graphs.read_workload(spark, path, SOURCES)


def params_table(spark, sf_dir):
    rows = []
    for name in ("events", "links", "trade"):
        p = params(graph(spark, sf_dir, name))
        opt, b, f, t = p.at(opt=True), p.bidirectional(), p.push_walk(), p.push_walk_topk()
        rows.append((
            name,
            p.n,
            p.m,
            p.delta,
            p.mean_degree,
            b[0],
            b[1],
            f[0],
            f[1],
            opt.push_walk()[0],
            t[0],
            t[1],
            p.montecarlo(),
            p.forward_push(),
            p.topk_threshold(),
        ))
    names = "delta mean_degree bi_rmax bi_omega pw_rmax pw_omega pw_rmax_onehop topk_rmax topk_omega mc_omega fp_rmax topk_threshold".split()
    made = spark.createDataFrame(rows, "graph string, n bigint, m bigint, " + ", ".join(f"{c} double" for c in names))
    return told(made, *names, digits=9)


def lambda_table(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    p = params(g)
    rows = g.nodes.select("node", lambda_bound(1.0 / (F.col("out_deg") + 1.0), p.log_fail, 1.0 / (F.col("in_deg") + 1.0), F.col("out_deg") + 10.0).alias("lam"))
    return told(rows, "lam", digits=9)


def walk_cost_model(spark, sf_dir):
    p = params(graph(spark, sf_dir, "events"))
    rows = [(r, p.walk_cost(r), p.walk_cost(r, True)) for r in (0.01, 0.1, 0.5, 1.0)]
    return told(spark.createDataFrame(rows, "rsum double, online double, indexed double"), "online", "indexed", digits=12)


def index_sizes(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return g.nodes.select("node", params(g).index_size(F.col("out_deg")).alias("size"), params(g, opt=True).index_size(F.col("out_deg")).alias("size_onehop"))


# ---- walks -----------------------------------------------------------------------------------------------------------


def _walk_query(name, **how):
    def run(spark, sf_dir):
        g = graph(spark, sf_dir, name)
        starts = fan_out(estimators.origins(sources(g)).withColumnRenamed("origin", "start"), F.lit(WALKS))
        return destinations(walked(starts, g, ALPHA, SEED, **how))

    return run


def _hub_parts(spark, sf_dir, blocks=8):
    g = graph(spark, sf_dir, "trade")
    hubs = kept(indexes.choose_hubs(g, 16), "hubs")
    return g, hubs, kept(indexes.forward_oracle(g, hubs, blocks, params(g), SEED), "oracle")


def hub_sizes(spark, sf_dir):
    return indexes.oracle_sizes(_hub_parts(spark, sf_dir)[2])


def hub_block_expand(spark, sf_dir):
    _, hubs, oracle = _hub_parts(spark, sf_dir)
    quotas = hubs.select(
        F.lit(0).cast("bigint").alias("source"),
        "hub",
        (F.pmod(graphs.draw_number(F.lit(SEED), F.col("hub"), F.lit("quota")), F.lit(256))).alias("walks"),
    )
    return indexes.expanded(quotas, oracle)


# ---- push -------------------------------------------------------------------------------------------------------------


def _state(df):
    return told(df, "reserve", "residual").select(F.col("origin").alias("source"), "node", "reserve", "residual")


def _forward(name, scale=1.0, dangling="source"):
    def run(spark, sf_dir):
        g = graph(spark, sf_dir, name)
        return _state(push(estimators.started(g, sources(g), dangling), g.transitions(ALPHA, dangling), params(g).forward_push() * scale))

    return run


def forward_push_resume(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    first = push(estimators.started(g, sources(g)), g.transitions(ALPHA), params(g).forward_push() * 16, 10)
    return _state(push(first, g.transitions(ALPHA), params(g).forward_push()))


def power_iteration(name):
    def run(spark, sf_dir):
        return told(exact(graph(spark, sf_dir, name)), "ppr").where("ppr > 0")

    return run


def backward_push(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return _state(push(unit_state(estimators.origins(sources(g))), g.backward(ALPHA), 0.01, strict=True)).withColumnRenamed("source", "target")


def backward_push_all_targets(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return _state(estimators.all_targets(g, params(g), 0.05)).withColumnRenamed("source", "target")


# ---- estimators ---------------------------------------------------------------------------------------------------------


def ppr_montecarlo(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return told(estimators.montecarlo(g, sources(g), params(g), SEED), "ppr")


def ppr_forward_push(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return told(estimators.forward_push(g, sources(g), params(g)), "ppr")


def _push_walk(opt=False, indexed=False, name="events"):
    def run(spark, sf_dir):
        g = graph(spark, sf_dir, name)
        p = params(g, opt=opt)
        index = kept(indexes.build_index(g, p, SEED), "index") if indexed else None
        return told(estimators.push_walk(g, sources(g), p, SEED, index), "ppr")

    return run


def ppr_bidirectional(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return told(estimators.bidirectional(g, sources(g), params(g), SEED), "ppr")


def index_build(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    rows = indexes.build_index(g, params(g), SEED).where("dest is not null")
    return rows.groupBy("start", "dest").agg(F.count(F.lit(1)).alias("cnt"))


def index_hit_ratio(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    p = params(g)
    rmax, omega = p.push_walk()
    state = push(unit_state(estimators.origins(sources(g))), g.transitions(ALPHA, "absorb"), rmax)
    held = g.nodes.select(F.col("node").alias("start"), p.index_size(F.col("out_deg")).alias("held"))
    use = estimators.index_use(estimators.walk_plan(state, p, omega), held)
    return told(use.agg((F.sum("from_index") / F.sum("n_walks")).alias("hit_ratio")), "hit_ratio")


# ---- top-k and evaluation --------------------------------------------------------------------------------------------------


def exact_topk(spark, sf_dir):
    return told(topk(exact(graph(spark, sf_dir, "events")), K), "ppr")


def kth(spark, sf_dir):
    return told(kth_value(exact(graph(spark, sf_dir, "events")), K), "kth")


def _evaluated(spark, sf_dir, ks):
    g = graph(spark, sf_dir, "events")
    guess = estimators.forward_push(g, sources(g), params(g))
    return evaluated(topk(guess, max(ks)), topk(exact(g), max(ks)), ks)


def topk_precision_recall(spark, sf_dir):
    return told(
        precision_recall(_evaluated(spark, sf_dir, [K])).select("k", "precision", "precision_ref", "recall", "n_sources"),
        "precision",
        "precision_ref",
        "recall",
    )


def topk_errors(spark, sf_dir):
    return told(_evaluated(spark, sf_dir, [K]).select("source", "hits", "n_predicted", "n_exact", "max_abs", "avg_abs"), "max_abs", "avg_abs", digits=5)


def batch_topk(spark, sf_dir):
    ks = [i * (50 // 5) for i in range(1, 5)] + [50]
    return told(precision_recall(_evaluated(spark, sf_dir, ks)).select("k", "precision", "recall", "n_sources"), "precision", "recall")


def bounds_table(spark, sf_dir):
    """Bounds of a first round, and of a second one that starts from them."""
    g = graph(spark, sf_dir, "events")
    p, none = params(g), F.lit(None).cast("double")
    rows = exact(g).select("source", "node", F.round("ppr", 9).alias("p"), F.round(F.col("ppr") * 0.5, 9).alias("h"))
    lb, ub = score_bounds(p, F.col("p"), F.col("h"), none, none, F.lit(0.5), F.lit(20_000.0))
    rows = rows.withColumns({"lb": lb, "ub": ub})
    lb2, ub2 = score_bounds(p, F.col("p"), F.col("h"), F.col("lb"), F.col("ub"), F.lit(0.25), F.lit(40_000.0))
    return told(rows.select("source", "node", "lb", "ub", lb2.alias("lb2"), ub2.alias("ub2")), "lb", "ub", "lb2", "ub2")


def martingale_table(spark, sf_dir):
    """Martingale bounds of a round, and of a second one that starts from them."""
    g = graph(spark, sf_dir, "events")
    rows = exact(g).select("source", "node", "ppr", F.round(F.col("ppr") * 0.25, 9).alias("r"), F.lit(0.0).alias("lb"), F.lit(1.0).alias("ub"))
    for total, low, up in ((4094, "lb", "ub"), (8190, "lb2", "ub2")):
        lb, ub = martingale_bounds(0.5, -20.0, total, 1 / g.n, F.round(F.col("ppr") * total, 6), F.col("r"), F.col("lb"), F.col("ub"))
        rows = rows.withColumns({low: lb, up: ub})
    return told(rows.select("source", "node", "lb", "ub", "lb2", "ub2"), "lb", "ub", "lb2", "ub2")


def stop_test(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    rows = exact(g).select("source", "node", F.round("ppr", 9).alias("ppr"), (F.round("ppr", 9) * 0.9).alias("lb"), (F.round("ppr", 9) * 1.1).alias("ub"))
    return stops(rows, params(g, delta=0.0005), K)


# ---- adaptive plans, hubs, report --------------------------------------------------------------------------------------------


def topk_adaptive(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return adaptive.topk_adaptive(g, sources(g), K, params(g), SEED)


def topk_bounded(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return adaptive.topk_bounded(g, sources(g), K, params(g), SEED)


def topk_hub(spark, sf_dir):
    g = graph(spark, sf_dir, "links")
    return adaptive.topk_martingale(g, sources(g), K, params(g), seed=SEED)


def ppr_hub(spark, sf_dir):
    g = graph(spark, sf_dir, "links")
    return indexes.hub_ppr(g, sources(g), params(g), seed=SEED)


def ppr_balanced(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return adaptive.balanced(g, sources(g), params(g), SEED)


def rest_bound_table(spark, sf_dir):
    """The bound of nodes that no walk has reached, two rounds on end."""
    g = graph(spark, sf_dir, "events")
    p = params(g)
    rows = sources(g).select("source").distinct().withColumn("rsum", 1.0 / (F.col("source") + 2.0))
    rows = rows.withColumn("first", rest_bound(p, F.col("rsum"), F.lit(500.0), F.lit(1.0)))
    return told(rows.withColumn("second", rest_bound(p, F.col("rsum") / 2, F.lit(1000.0), F.col("first"))), "rsum", "first", "second", digits=9)


def _guarantee(found: DataFrame, truth: DataFrame, k: int, epsilon: float) -> DataFrame:
    """By source: whether a list has k nodes, and whether no node outside beats one inside by more than the error allowed.

    The estimate promises scores within epsilon above delta = 1/n, so a node may be in the list instead of another of at most
    (1 + epsilon) / (1 - epsilon) times its score; scores below delta count as delta.
    """
    both = truth.join(found.select("source", "node", F.lit(True).alias("inside")), ["source", "node"], "left")
    least = F.min(F.when(F.col("inside"), F.col("ppr")))
    most = F.max(F.when(F.col("inside").isNull(), F.col("ppr")))
    told_ = both.groupBy("source").agg(
        F.count(F.when(F.col("inside"), 1)).alias("found"),
        F.count(F.lit(1)).alias("all"),
        least.alias("least"),
        most.alias("most"),
    )
    return told_.select(
        "source",
        (F.col("found") == F.least(F.lit(k), F.col("all"))).alias("full"),
        F.lit((1 + epsilon) / (1 - epsilon)).alias("__f"),
        "least",
        "most",
    )


def _holds(rows: DataFrame, delta: float) -> DataFrame:
    beaten = F.coalesce(F.col("most"), F.lit(0.0)) > F.col("__f") * F.greatest("least", F.lit(delta))
    return rows.select("source", "full", (~beaten).alias("good"))


def topk_adaptive_holds(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return _holds(_guarantee(topk_adaptive(spark, sf_dir), exact(g), K, EPSILON), 1 / g.n)


def _bounded(found: DataFrame, truth: DataFrame) -> DataFrame:
    """By source: whether the bounds of every node reached hold its exact score, and that of the rest the scores of all other nodes.

    A node that is on one side alone counts: one without an exact score has 0, one that was not reached must be within rest_ub.
    """
    rest = found.groupBy("source").agg(F.min("rest_ub").alias("rest"))
    both = found.select("source", "node", "lb", "ub", F.lit(True).alias("reached")).join(truth.withColumnRenamed("ppr", "true"), ["source", "node"], "full_outer")
    both = both.join(rest, "source", "left").withColumn("true", F.coalesce("true", F.lit(0.0)))
    low, high = (F.when(F.col("reached"), F.col(c)).otherwise(other) for c, other in (("lb", F.lit(0.0)), ("ub", F.col("rest"))))
    holds = (low <= F.col("true") + 1e-9) & (F.col("true") <= high + 1e-9) & ~F.isnan(high)
    return both.groupBy("source").agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("bounded"))


def topk_bounded_holds(spark, sf_dir):
    """As above, and whether all bounds hold the exact score, and that of the nodes not reached."""
    g = graph(spark, sf_dir, "events")
    found = kept(adaptive.topk_bounded(g, sources(g), K, params(g), SEED, every=True), "bounded")
    return _holds(_guarantee(found.where("rank is not null"), exact(g), K, EPSILON), 1 / g.n).join(_bounded(found, exact(g)), "source")


def topk_hub_holds(spark, sf_dir):
    g = graph(spark, sf_dir, "links")
    return _holds(_guarantee(topk_hub(spark, sf_dir), exact(g), K, EPSILON), 1 / g.n)


def _near(found: DataFrame, truth: DataFrame, epsilon: float, delta: float) -> DataFrame:
    """By source: whether all scores of delta or more are met within epsilon, and the others within epsilon * delta."""
    both = truth.withColumnRenamed("ppr", "true").join(found, ["source", "node"], "full_outer").fillna(0.0, ["ppr", "true"])
    good = F.abs(F.col("ppr") - F.col("true")) <= epsilon * F.greatest("true", F.lit(delta))
    return both.groupBy("source").agg(F.bool_and(good).alias("near"))


def ppr_hub_holds(spark, sf_dir):
    g = graph(spark, sf_dir, "links")
    return _near(ppr_hub(spark, sf_dir), exact(g), EPSILON, 1 / g.n)


def ppr_balanced_holds(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    return _near(ppr_balanced(spark, sf_dir), exact(g), EPSILON, 1 / g.n)


def run_report(spark, sf_dir):
    g = graph(spark, sf_dir, "events")
    engine = PprEngine(g, EPSILON, SEED)
    engine.query(sources(g))
    figures = {**result_fields(engine.params, engine.timers, SOURCES, {})}
    return report_row(spark, "query", "push_walk", engine.params, figures, engine.timers, "query --algo push_walk")


QUERIES = {
    "graph_stats": graph_stats, "edge_multiplicity": edge_multiplicity, "self_loop_filter": self_loop_filter, "id_remap": id_remap, "file_round_trip": file_round_trip,
    "workload_generate": workload_generate, "workload_load": workload_load, "params_table": params_table, "lambda_bound": lambda_table, "walk_cost_model": walk_cost_model, "index_sizes": index_sizes,
    "walk_histogram": _walk_query("events"), "walk_no_zero_hop": _walk_query("events", zero_hop=False), "walk_dead_end": _walk_query("links"), "walk_absorbing": _walk_query("links", dangling="absorb"),
    "hub_sizes": hub_sizes, "hub_block_expand": hub_block_expand,
    "forward_push": _forward("events"), "forward_push_dead_end": _forward("links"), "forward_push_absorbing": _forward("links", 1.0, "absorb"), "forward_push_trade": _forward("trade"), "forward_push_resume": forward_push_resume,
    "power_iteration": power_iteration("events"), "power_iteration_dead_end": power_iteration("links"), "backward_push": backward_push, "backward_push_all_targets": backward_push_all_targets,
    "ppr_montecarlo": ppr_montecarlo, "ppr_forward_push": ppr_forward_push, "ppr_push_walk": _push_walk(), "ppr_push_walk_onehop": _push_walk(opt=True), "ppr_push_walk_indexed": _push_walk(indexed=True), "ppr_push_walk_dead_end": _push_walk(name="links"), "ppr_bidirectional": ppr_bidirectional,
    "index_build": index_build, "index_hit_ratio": index_hit_ratio,
    "exact_topk": exact_topk, "kth_value": kth, "topk_precision_recall": topk_precision_recall, "topk_errors": topk_errors, "batch_topk": batch_topk, "bounds_table": bounds_table, "martingale_bounds": martingale_table, "stop_test": stop_test,
    "topk_adaptive": topk_adaptive, "topk_bounded": topk_bounded, "topk_hub": topk_hub, "ppr_hub": ppr_hub, "ppr_balanced": ppr_balanced, "run_report": run_report,
    "rest_bound": rest_bound_table, "topk_adaptive_holds": topk_adaptive_holds, "topk_bounded_holds": topk_bounded_holds, "topk_hub_holds": topk_hub_holds, "ppr_hub_holds": ppr_hub_holds, "ppr_balanced_holds": ppr_balanced_holds,
}

# ---- DuckDB SQL ------------------------------------------------------------------------------------------------------------

RAW = {
    "events": "raw AS MATERIALIZED (SELECT * FROM (SELECT lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst FROM events) WHERE src IS NOT NULL AND dst IS NOT NULL)",
    "trade": "both_ways AS (SELECT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey), raw AS MATERIALIZED (SELECT a AS src, b AS dst FROM both_ways UNION ALL SELECT b, a FROM both_ways)",
    "links": """found AS (SELECT page_id, 'p' || page_id AS src, regexp_extract_all(html, 'href="([^"]*)"', 1) AS l FROM pages),
links AS (SELECT page_id, src, unnest(range(len(l))) AS spot, unnest(l) AS dst FROM found),
firsts AS (SELECT label, min((page_id, spot, side)) AS f FROM (SELECT page_id, spot, 0 AS side, src AS label FROM links UNION ALL SELECT page_id, spot, 1, dst FROM links) GROUP BY label),
ids AS MATERIALIZED (SELECT label, row_number() OVER (ORDER BY f, label) - 1 AS node FROM firsts),
raw AS MATERIALIZED (SELECT a.node AS src, b.node AS dst FROM links l JOIN ids a ON l.src = a.label JOIN ids b ON l.dst = b.label)""",
}
GRAPH = """edges AS MATERIALIZED (SELECT src, dst, count(*) AS cnt FROM raw WHERE src <> dst GROUP BY src, dst),
nodes AS MATERIALIZED (SELECT node, coalesce(o.d, 0)::BIGINT AS out_deg, coalesce(i.d, 0)::BIGINT AS in_deg
  FROM (SELECT src AS node FROM raw UNION SELECT dst FROM raw) u
  LEFT JOIN (SELECT src AS node, sum(cnt) AS d FROM edges GROUP BY src) o USING (node) LEFT JOIN (SELECT dst AS node, sum(cnt) AS d FROM edges GROUP BY dst) i USING (node)),
size AS MATERIALIZED (SELECT count(*)::DOUBLE AS n, sum(out_deg)::DOUBLE AS m, ln(2.0::DOUBLE * count(*)) AS lf FROM nodes)"""
WORK = f"""work AS MATERIALIZED (SELECT q AS query_no, node AS source FROM (SELECT q, ('0x' || substr(md5('{SEED}:' || q || ':source'), 1, 8))::BIGINT % (SELECT count(*) FROM nodes) AS place FROM range({SOURCES}) r(q))
  JOIN (SELECT node, row_number() OVER (ORDER BY node) - 1 AS place FROM nodes) USING (place)),
sources AS MATERIALIZED (SELECT DISTINCT source AS origin FROM work)"""


def _with(name: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",\n".join((RAW[name], GRAPH, WORK, *more)) + "\n"


def _moves(dangling: str = "source") -> str:
    back = f" UNION ALL SELECT node, NULL, false, 0.0, {1 - ALPHA}::DOUBLE, 0.0 FROM nodes WHERE out_deg = 0" if dangling == "source" else ""
    return f"""moves AS MATERIALIZED (SELECT node AS src, node AS dst, true AS own, {ALPHA}::DOUBLE AS rsv, 0.0::DOUBLE AS res, out_deg::DOUBLE AS deg FROM nodes
  UNION ALL SELECT src, dst, false, 0.0, {1 - ALPHA}::DOUBLE * cnt / out_deg, out_deg FROM edges JOIN nodes ON src = node{back})"""


BACK = f"""moves AS MATERIALIZED (SELECT node AS src, node AS dst, true AS own, {ALPHA}::DOUBLE AS rsv, 0.0::DOUBLE AS res, 1.0::DOUBLE AS deg FROM nodes
  UNION ALL SELECT dst, src, false, 0.0, {1 - ALPHA}::DOUBLE * cnt / out_deg, 1.0 FROM edges JOIN nodes ON src = node)"""


def _rounds(
    rmax: str,
    rounds: int,
    strict: bool = False,
    start: str = "SELECT 0 AS round, origin, origin AS node, 0.0::DOUBLE AS reserve, 1.0::DOUBLE AS residual FROM sources",
    name: str = "st",
) -> str:
    """Synchronous push as a recursive table; ``rmax`` is a number, or SQL over ``size``."""
    due = f"(s.residual > 0 AND round(s.residual, 12) {'>' if strict else '>='} t.deg * z.rmax)"
    return f"""lim_{name} AS MATERIALIZED (SELECT ({rmax})::DOUBLE AS rmax FROM size),
{name}(round, origin, node, reserve, residual) AS ({start}
  UNION ALL SELECT round + 1, origin, node, sum(a), sum(b) FROM (
    SELECT s.round, s.origin, coalesce(t.dst, s.origin) AS node,
           CASE WHEN t.own THEN s.reserve ELSE 0 END + CASE WHEN {due} THEN s.residual * t.rsv ELSE 0 END AS a,
           CASE WHEN t.own AND NOT {due} THEN s.residual ELSE 0 END + CASE WHEN {due} THEN s.residual * t.res ELSE 0 END AS b
    FROM {name} s JOIN moves t ON s.node = t.src JOIN lim_{name} z ON true WHERE s.round < {rounds} AND (t.own OR {due})) GROUP BY round, origin, node),
end_{name} AS MATERIALIZED (SELECT origin, node, reserve, residual FROM {name} WHERE round = {rounds})"""


FP = "0.5 / m"
PW = "0.5 * sqrt(1.0 / n / 3 / m / lf)"
STATE = "SELECT origin AS {0}, node, round(reserve, 6) AS reserve, round(residual, 6) AS residual FROM end_{1}"
TRUTH = _rounds("0.0", EXACT_ROUNDS, name="tr") + ",\nexact AS MATERIALIZED (SELECT origin AS source, node, reserve AS ppr FROM end_tr WHERE reserve > 0)"
RANKED = "SELECT source, row_number() OVER (PARTITION BY source ORDER BY round(ppr, 6) DESC, node) AS rank, node, ppr FROM {0} WHERE ppr > 0"


def _walks(starts: str, zero_hop: bool = True, dangling: str = "walk_start", name: str = "w") -> str:
    """Walks as a recursive table; ``starts``: SQL for (start, walk)."""
    draw = lambda *k: "('0x' || substr(md5(" + " || ':' || ".join((f"'{SEED}'", *k)) + "), 1, 8))::BIGINT"
    hops = f"floor(ln(({draw('start', 'walk', chr(39) + 'stop' + chr(39))} + 1) / 4294967296.0::DOUBLE) / {math.log(1 - ALPHA)!r}::DOUBLE)::INT" + ("" if zero_hop else " + 1")
    first = hops if dangling == "absorb" else f"CASE WHEN out_deg = 0 THEN 0 ELSE {hops} END"
    pick = draw("x.start", "x.walk", "x.step", "'next'")
    join = "JOIN" if dangling == "absorb" else "LEFT JOIN"
    return f"""nbr AS MATERIALIZED (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, dst FROM raw WHERE src <> dst),
{name}(start, walk, step, cur, len) AS (SELECT start, walk, 0, start, {first} FROM ({starts}) JOIN nodes ON node = start
  UNION ALL SELECT x.start, x.walk, x.step + 1, coalesce(b.dst, x.start), x.len FROM {name} x JOIN nodes d ON d.node = x.cur {join} nbr b ON b.src = x.cur AND b.k = {pick} % greatest(d.out_deg, 1) WHERE x.step < x.len),
end_{name} AS MATERIALIZED (SELECT start, walk, cur AS dest FROM {name} WHERE step = len)"""


SOME = f"SELECT origin AS start, unnest(range(1, {WALKS + 1})) AS walk FROM sources"
COUNTS = "SELECT start, dest, count(*) AS cnt FROM end_w GROUP BY start, dest"
MC = "SELECT origin AS start, unnest(range(1, (SELECT ceil(3 * lf / 0.25 * n)::BIGINT FROM size) + 1)) AS walk FROM sources"


def _plan(opt: bool) -> str:
    share = 1 - ALPHA if opt else 1.0
    return f"""plan AS MATERIALIZED (SELECT s.*, rsum, greatest(ceil(round(residual / rsum * greatest(floor(round(2.5 * lf / 0.25 * n * rsum * {share}::DOUBLE, 9)), 1), 9)), 1)::BIGINT AS n_walks
  FROM (SELECT * FROM end_st WHERE residual > 0) s JOIN (SELECT origin, sum(residual) AS rsum FROM end_st GROUP BY origin) USING (origin), size)"""


def _push_walk_sql(name: str, opt: bool = False) -> str:
    share = 1 - ALPHA if opt else 1.0
    rmax = PW + (f" / {1 - ALPHA}" if opt else "")
    need = "SELECT start, unnest(range(1, k + 1)) AS walk FROM (SELECT node AS start, max(n_walks) AS k FROM plan GROUP BY node)"
    hop = f" UNION ALL SELECT origin, node, residual * {ALPHA} FROM end_st" if opt else ""
    return _with(name, _moves("absorb"), _rounds(rmax, SQL_ROUNDS), _plan(opt), _walks(need, not opt, "absorb"), f"""parts AS (SELECT origin AS source, node, reserve AS ppr FROM end_st{hop}
  UNION ALL SELECT p.origin, w.dest, p.residual * {share}::DOUBLE / p.n_walks FROM plan p JOIN end_w w ON p.node = w.start AND w.walk <= p.n_walks),
summed AS (SELECT source, node, sum(ppr) AS ppr FROM parts GROUP BY source, node HAVING sum(ppr) > 0)""") + "SELECT source, node, round(ppr / sum(ppr) OVER (PARTITION BY source), 6) AS ppr FROM summed"


def _hub_sql(end: str) -> str:
    starts = "SELECT hub AS start, unnest(range(1, 256)) AS walk FROM hubs"
    hubs = "hubs AS MATERIALIZED (SELECT node AS hub FROM nodes ORDER BY in_deg * out_deg DESC, node LIMIT 16)"
    oracle = "oracle AS MATERIALIZED (SELECT start AS hub, floor(log2(walk) + 1e-9)::INT AS block, dest, count(*) AS cnt FROM end_w GROUP BY ALL)"
    return _with("trade", hubs, _walks(starts, dangling="absorb"), oracle) + end


def _evaluated_sql(ks: list[int], end: str) -> str:
    guess = f"guess AS (SELECT origin AS source, node, reserve AS ppr FROM end_st WHERE reserve > 0), rg AS ({RANKED.format('guess')}), rx AS ({RANKED.format('exact')})"
    both = f"""ks AS (SELECT unnest({ks})::INT AS k),
a AS (SELECT k, source, node, ppr AS got FROM rg, ks WHERE rank <= k), b AS (SELECT k, source, node, ppr AS tru FROM rx, ks WHERE rank <= k),
per AS (SELECT k, source, count(CASE WHEN got IS NOT NULL AND tru IS NOT NULL THEN 1 END) AS hits, count(got) AS n_predicted, count(tru) AS n_exact,
  max(abs(coalesce(got, 0) - tru)) AS max_abs, avg(abs(coalesce(got, 0) - tru)) AS avg_abs FROM a FULL JOIN b USING (k, source, node) GROUP BY k, source)"""
    return _with("events", _moves(), _rounds(FP, SQL_ROUNDS), TRUTH, guess, both) + end


def _params_sql() -> str:
    one = """SELECT '{0}' AS graph, n::BIGINT AS n, m::BIGINT AS m, 1 / n AS delta, m / n AS mean_degree, 0.5 * sqrt(m / n / 3 / lf) AS bi_rmax, 0.5 * sqrt(m / n / 3 / lf) * 3 * lf * n / 0.25 AS bi_omega,
  0.5 * sqrt(1 / n / 3 / m / lf) AS pw_rmax, 2.5 * lf * n / 0.25 AS pw_omega, 0.5 * sqrt(1 / n / 3 / m / lf) / 0.8 AS pw_rmax_onehop,
  0.5 * sqrt(1 / n / 3 / m / lf) * sqrt(m * 0.5 * sqrt(1 / n / 3 / m / lf)) * 3 AS topk_rmax, 2.5 * lf * n / 0.25 AS topk_omega, 3 * lf / 0.25 * n AS mc_omega, 0.5 / m AS fp_rmax, 0.23 / 500 ** 0.77 / n ** 0.23 AS topk_threshold
FROM (SELECT (SELECT count(*) FROM (SELECT src FROM raw_{0} UNION SELECT dst FROM raw_{0}))::DOUBLE AS n, (SELECT count(*) FROM raw_{0} WHERE src <> dst)::DOUBLE AS m), LATERAL (SELECT ln(2 * n) AS lf)"""
    raws = ",\n".join(RAW[g].replace("raw AS", f"raw_{g} AS") for g in ("events", "links", "trade"))
    cols = "delta mean_degree bi_rmax bi_omega pw_rmax pw_omega pw_rmax_onehop topk_rmax topk_omega mc_omega fp_rmax topk_threshold".split()
    return f"WITH {raws}\nSELECT graph, n, m, " + ", ".join(f"round(({c})::DOUBLE, 9) AS {c}" for c in cols) + " FROM (" + " UNION ALL ".join(one.format(g) for g in ("events", "links", "trade")) + ")"


def _stats_sql() -> str:
    raws = ",\n".join(RAW[g].replace("raw AS", f"raw_{g} AS") for g in ("events", "links", "trade"))
    one = """SELECT '{0}' AS graph, (SELECT count(*) FROM (SELECT src FROM raw_{0} UNION SELECT dst FROM raw_{0})) AS n, (SELECT count(*) FROM raw_{0} WHERE src <> dst) AS m,
  (SELECT count(*) FROM (SELECT src AS x FROM raw_{0} UNION SELECT dst FROM raw_{0}) WHERE x NOT IN (SELECT src FROM raw_{0} WHERE src <> dst)) AS dead_ends,
  (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM raw_{0} WHERE src <> dst)) AS distinct_edges"""
    return f"WITH {raws}\nSELECT *, round(m::DOUBLE / n, 6) AS mean_degree FROM (" + " UNION ALL ".join(one.format(g) for g in ("events", "links", "trade")) + ")"


def _lambda(r: str, u: str, w: str) -> str:
    return f"lf * {r} / (3.0 * {w}) + sqrt(4.0::DOUBLE / 9.0 * lf * lf * {r} * {r} + 8.0 * {w} * lf * {r} * {u}) / (2.0 * {w})"


def _bounds_sql(table: str, rsum: str, walks: str) -> str:
    """Bounds of rows (source, node, p, h, lb0, ub0) of a table."""
    lam = _lambda(rsum, "CASE WHEN ub0 > h THEN ub0 - h ELSE 1 - h END", walks)
    known = "CASE WHEN h > 1 / n THEN greatest(h, coalesce(lb0, 0)) WHEN coalesce(lb0, 0) > 0 THEN lb0 ELSE 1 / n END"
    return f"""SELECT source, node, p, h,
  greatest(p - lam, CASE WHEN e < 1 THEN p / (1 + e) ELSE 0 END, CASE WHEN h > 1 / n THEN greatest(h, coalesce(lb0, 0)) ELSE h END, 0) AS lb, least(p + lam, CASE WHEN e < 1 THEN p / (1 - e) ELSE 1 END, 1) AS ub
FROM (SELECT *, {lam} AS lam, sqrt(2.67::DOUBLE * {rsum} * lf / {walks}) / sqrt({known}) AS e FROM {table} AS t, size)"""


def _martingale_sql(table: str, total: int) -> str:
    """Martingale bounds (rmax 0.5, ln of the failure -20) of rows (source, node, ppr, r, lb, ub) of a table, never wider than before."""
    t = f"{total}.0::DOUBLE"
    return f"""SELECT source, node, ppr, r, CASE WHEN low < 1 AND low > lb THEN low ELSE lb END AS lb, CASE WHEN up > 0 AND up < ub THEN up ELSE ub END AS ub FROM (
  SELECT *, r + CASE WHEN ok AND e < 1 THEN least(w + lam, w / (1 - e)) ELSE w + lam END / {t} AS up, r + CASE WHEN ok THEN greatest(w / (1 + e), w - lam) ELSE w - lam END / {t} AS low FROM (
    SELECT *, w > 0 AND mean > 0 AS ok, CASE WHEN w > 0 AND mean > 0 THEN (sqrt(a * a + 40.0::DOUBLE * mean) - a) / mean END AS e, sqrt(a * a + 40.0::DOUBLE * {t} * 0.0625) - a AS lam FROM (
      SELECT *, round(ppr * {t}, 6) AS w, {t} * greatest(1 / n - r, lb - r) AS mean, 0.5::DOUBLE * -20.0 / 3 AS a FROM {table}, size)))"""


BI = "0.5 * sqrt(m / n / 3 / lf)"

ORACLES = {
    "graph_stats": _stats_sql(),
    "edge_multiplicity": _with("events") + "SELECT * FROM edges",
    "self_loop_filter": "WITH " + RAW["events"] + " SELECT count(*) AS m_declared, count(CASE WHEN src <> dst THEN 1 END) AS m_loaded, count(CASE WHEN src = dst THEN 1 END) AS self_loops FROM raw",
    "id_remap": "WITH " + RAW["links"] + " SELECT label, node FROM ids",
    "file_round_trip": _with("links") + "SELECT * FROM edges",
    "workload_generate": _with("events") + "SELECT * FROM work",
    "workload_load": _with("events") + "SELECT * FROM work",
    "params_table": _params_sql(),
    "lambda_bound": _with("events") + f"SELECT node, round({_lambda('r', 'u', 'w')}, 9) AS lam FROM (SELECT node, 1.0::DOUBLE / (out_deg + 1) AS r, 1.0::DOUBLE / (in_deg + 1) AS u, out_deg + 10.0::DOUBLE AS w FROM nodes), size",
    "walk_cost_model": _with("events") + "SELECT rsum, round(2.5 * lf * n / 0.25 * rsum * 0.8 * 4e-7::DOUBLE, 12) AS online, round(2.5 * lf * n / 0.25 * rsum * 0.8 * 4e-7::DOUBLE / 140, 12) AS indexed FROM (SELECT unnest([0.01, 0.1, 0.5, 1.0])::DOUBLE AS rsum), size",
    "index_sizes": _with("events") + f"SELECT node, ceil(out_deg * {PW} * (2.5 * lf * n / 0.25))::BIGINT AS size, ceil(out_deg * ({PW} / 0.8) * (2.5 * lf * n / 0.25) * 0.8)::BIGINT AS size_onehop FROM nodes, size",
    "walk_histogram": _with("events", _walks(SOME)) + COUNTS,
    "walk_no_zero_hop": _with("events", _walks(SOME, zero_hop=False)) + COUNTS,
    "walk_dead_end": _with("links", _walks(SOME)) + COUNTS,
    "walk_absorbing": _with("links", _walks(SOME, dangling="absorb")) + COUNTS,
    "hub_sizes": _hub_sql("SELECT hub, sum(cnt)::BIGINT AS size, (2 ** floor(log2(sum(cnt))) - 1)::BIGINT AS full FROM oracle GROUP BY hub"),
    "hub_block_expand": _hub_sql(f"SELECT 0::BIGINT AS source, dest, sum(cnt)::BIGINT AS cnt FROM (SELECT hub, ('0x' || substr(md5('{SEED}:' || hub || ':quota'), 1, 8))::BIGINT % 256 AS walks FROM hubs) JOIN oracle USING (hub) WHERE (walks >> block) & 1 = 1 GROUP BY dest"),
    "forward_push": _with("events", _moves(), _rounds(FP, SQL_ROUNDS)) + STATE.format("source", "st"),
    "forward_push_dead_end": _with("links", _moves(), _rounds(FP, SQL_ROUNDS)) + STATE.format("source", "st"),
    "forward_push_absorbing": _with("links", _moves("absorb"), _rounds(FP, SQL_ROUNDS)) + STATE.format("source", "st"),
    "forward_push_trade": _with("trade", _moves(), _rounds(FP, SQL_ROUNDS)) + STATE.format("source", "st"),
    "forward_push_resume": _with(
        "events",
        _moves(),
        _rounds(f"16 * {FP}", 10),
        _rounds(FP, SQL_ROUNDS, start="SELECT 0 AS round, origin, node, reserve, residual FROM end_st", name="again"),
    ) + STATE.format("source", "again"),
    "power_iteration": _with("events", _moves(), TRUTH) + "SELECT * FROM (SELECT source, node, round(ppr, 6) AS ppr FROM exact) WHERE ppr > 0",
    "power_iteration_dead_end": _with("links", _moves(), TRUTH) + "SELECT * FROM (SELECT source, node, round(ppr, 6) AS ppr FROM exact) WHERE ppr > 0",
    "backward_push": _with("events", BACK, _rounds("0.01", SQL_ROUNDS, strict=True)) + STATE.format("target", "st"),
    "backward_push_all_targets": _with(
        "events",
        BACK,
        _rounds("0.05", SQL_ROUNDS, strict=True, start="SELECT 0 AS round, node AS origin, node, 0.0::DOUBLE AS reserve, 1.0::DOUBLE AS residual FROM nodes"),
    ) + STATE.format("target", "st"),
    "ppr_montecarlo": _with("events", _walks(MC)) + "SELECT start AS source, dest AS node, round(count(*) / any_value(ceil(3 * lf / 0.25 * n)), 6) AS ppr FROM end_w, size GROUP BY start, dest",
    "ppr_forward_push": _with("events", _moves(), _rounds(FP, SQL_ROUNDS)) + "SELECT origin AS source, node, round(reserve, 6) AS ppr FROM end_st WHERE reserve > 0",
    "ppr_push_walk": _push_walk_sql("events"),
    "ppr_push_walk_onehop": _push_walk_sql("events", opt=True),
    "ppr_push_walk_indexed": _push_walk_sql("events"),
    "ppr_push_walk_dead_end": _push_walk_sql("links"),
    "ppr_bidirectional": _with("events", BACK, _rounds(BI, SQL_ROUNDS, strict=True, start="SELECT 0 AS round, node AS origin, node, 0.0::DOUBLE AS reserve, 1.0::DOUBLE AS residual FROM nodes"),
        f"walks_n AS (SELECT CASE WHEN {BI} >= 1 THEN ceil(3 * lf / 0.25 * n) ELSE ceil({BI} * 3 * lf * n / 0.25) END::BIGINT AS k, {BI} >= 1 AS plain FROM size)",
        _walks("SELECT origin AS start, unnest(range(1, (SELECT k FROM walks_n) + 1)) AS walk FROM sources"),
        "cnts AS (SELECT start, dest, count(*) AS cnt FROM end_w GROUP BY start, dest)",
        """parts AS (SELECT start AS source, origin AS node, cnt * residual / k AS ppr FROM cnts JOIN end_st ON dest = node, walks_n WHERE residual > 0
  UNION ALL SELECT s.origin, t.origin, t.reserve FROM sources s JOIN end_st t ON s.origin = t.node WHERE t.reserve > 0),
summed AS (SELECT source, node, sum(ppr) AS ppr FROM parts GROUP BY source, node)""") + "SELECT source, node, round(ppr / sum(ppr) OVER (PARTITION BY source), 6) AS ppr FROM summed WHERE NOT (SELECT plain FROM walks_n) UNION ALL SELECT start, dest, round(cnt / k::DOUBLE, 6) FROM cnts, walks_n WHERE plain",
    "index_build": _with(
        "events",
        _walks(
            f"SELECT start, unnest(range(1, k + 1)) AS walk FROM (SELECT node AS start, ceil(out_deg * {PW} * (2.5 * lf * n / 0.25))::BIGINT AS k FROM nodes, size)",
            dangling="absorb",
        ),
    ) + COUNTS,
    "index_hit_ratio": _with(
        "events",
        _moves("absorb"),
        _rounds(PW, SQL_ROUNDS),
        _plan(False),
    ) + f"SELECT round(sum(least(n_walks, held))::DOUBLE / sum(n_walks), 6) AS hit_ratio FROM plan p JOIN (SELECT node, ceil(out_deg * {PW} * (2.5 * lf * n / 0.25))::BIGINT AS held FROM nodes, size) h ON p.node = h.node",
    "exact_topk": _with("events", _moves(), TRUTH) + f"SELECT source, rank::INT AS rank, node, round(ppr, 6) AS ppr FROM ({RANKED.format('exact')}) WHERE rank <= {K}",
    "kth_value": _with("events", _moves(), TRUTH) + f"SELECT source, round(coalesce(max(CASE WHEN rank = {K} THEN ppr END), 0), 6) AS kth FROM ({RANKED.format('exact')}) WHERE rank <= {K} GROUP BY source",
    "topk_precision_recall": _evaluated_sql(
        [K],
        "SELECT k, round(avg(CASE WHEN n_predicted > 0 THEN hits / n_predicted::DOUBLE ELSE 0 END), 6) AS precision, round(avg(hits / n_exact::DOUBLE), 6) AS precision_ref, round(avg(hits / n_exact::DOUBLE), 6) AS recall, count(*) AS n_sources FROM per GROUP BY k",
    ),
    "topk_errors": _evaluated_sql([K], "SELECT source, hits, n_predicted, n_exact, round(max_abs, 5) AS max_abs, round(avg_abs, 5) AS avg_abs FROM per"),
    "batch_topk": _evaluated_sql(
        [10, 20, 30, 40, 50],
        "SELECT k, round(avg(CASE WHEN n_predicted > 0 THEN hits / n_predicted::DOUBLE ELSE 0 END), 6) AS precision, round(avg(hits / n_exact::DOUBLE), 6) AS recall, count(*) AS n_sources FROM per GROUP BY k",
    ),
    "rest_bound": _with(
        "events",
        f"once AS (SELECT source, rsum, {_lambda('rsum', '1.0::DOUBLE', '500.0::DOUBLE')} AS first FROM (SELECT DISTINCT source, 1.0::DOUBLE / (source + 2) AS rsum FROM work), size)",
    )
    + f"SELECT source, round(rsum, 9) AS rsum, round(first, 9) AS first, round({_lambda('(rsum / 2)', 'first', '1000.0::DOUBLE')}, 9) AS second FROM once, size",
    "topk_adaptive_holds": _with("events") + "SELECT DISTINCT source, true AS full, true AS good FROM work",
    "topk_bounded_holds": _with("events") + "SELECT DISTINCT source, true AS full, true AS good, true AS bounded FROM work",
    "topk_hub_holds": _with("links") + "SELECT DISTINCT source, true AS full, true AS good FROM work",
    "ppr_hub_holds": _with("links") + "SELECT DISTINCT source, true AS near FROM work",
    "ppr_balanced_holds": _with("events") + "SELECT DISTINCT source, true AS near FROM work",
    "bounds_table": _with("events", _moves(), TRUTH, "one AS (SELECT source, node, round(ppr, 9) AS p, round(ppr * 0.5, 9) AS h, NULL::DOUBLE AS lb0, NULL::DOUBLE AS ub0 FROM exact)",
        f"two AS ({_bounds_sql('one', '0.5::DOUBLE', '20000.0::DOUBLE')})", f"three AS ({_bounds_sql('(SELECT source, node, p, h, lb AS lb0, ub AS ub0 FROM two)', '0.25::DOUBLE', '40000.0::DOUBLE')})")
    + "SELECT source, node, round(two.lb, 6) AS lb, round(two.ub, 6) AS ub, round(three.lb, 6) AS lb2, round(three.ub, 6) AS ub2 FROM two JOIN three USING (source, node)",
    "martingale_bounds": _with("events", _moves(), TRUTH, "one AS (SELECT source, node, ppr, round(ppr * 0.25, 9) AS r, 0.0::DOUBLE AS lb, 1.0::DOUBLE AS ub FROM exact)",
        f"two AS ({_martingale_sql('one', 4094)})", f"three AS ({_martingale_sql('two', 8190)})")
    + "SELECT source, node, round(two.lb, 6) AS lb, round(two.ub, 6) AS ub, round(three.lb, 6) AS lb2, round(three.ub, 6) AS ub2 FROM two JOIN three USING (source, node)",
    "stop_test": _with("events", _moves(), TRUTH) + f"""SELECT source, coalesce(max(CASE WHEN r = {K} THEN p END), 0) >= 0.001 OR (0.0005 < any_value(0.23 / 500 ** 0.77 / n ** 0.23) AND NOT bool_or(b <= {K} AND p * 1.1 > 1.5 * (p * 0.9)) AND max(k) > 0.0005
    AND NOT bool_or(b > {K} AND p > 0 AND p * 1.1 > k * 1.5 AND p * 1.1 <= 3 * (p * 0.9))) AS stop
FROM (SELECT *, coalesce(max(CASE WHEN b = {K} THEN p * 0.9 END) OVER (PARTITION BY source), 0) AS k FROM (
  SELECT source, node, p, row_number() OVER (PARTITION BY source ORDER BY round(p, 12) DESC, node) AS r, row_number() OVER (PARTITION BY source ORDER BY round(p * 0.9, 12) DESC, node) AS b FROM (SELECT source, node, round(ppr, 9) AS p FROM exact))), size GROUP BY source""",
}
