"""Estimators of personalized PageRank: each returns (source, node, ppr) for all sources at once."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.params import POWER_ITERATIONS, Params
from ..report import counted, phase
from ..session import kept
from ..sources.graphs import Graph, few_at_once
from .intask import pushed, walk_sums
from .power import LOCAL_EDGES, power_scores
from .push import push, residual_sums, unit_state
from .walks import destinations, fan_out, walked


def origins(sources: DataFrame) -> DataFrame:
    return sources.select(F.col("source").cast("bigint").alias("origin")).where("origin is not null").distinct()


def reserves(state: DataFrame) -> DataFrame:
    """The reserves of a push as estimates."""
    return state.where("reserve > 0").select(F.col("origin").alias("source"), "node", F.col("reserve").alias("ppr"))


def started(graph: Graph, sources: DataFrame, dangling: str = "source") -> DataFrame:
    """All residual at the sources; a dead end that its own rest goes back to has all in its reserve at once, the sum of endless rounds."""
    state = unit_state(origins(sources))
    if dangling != "source":
        return state
    ends = graph.nodes.where("out_deg = 0").select("node", F.lit(True).alias("__end"))
    state = state.join(ends, "node", "left")
    return state.select(
        "origin",
        "node",
        F.when(F.col("__end"), 1.0).otherwise(0.0).alias("reserve"),
        F.when(F.col("__end"), 0.0).otherwise(1.0).alias("residual"),
    )


def power_iteration(graph: Graph, sources: DataFrame, p: Params, rounds: int = POWER_ITERATIONS) -> DataFrame:
    """Ground truth: every residual is pushed in each round, the sources side by side."""
    return power_scores(graph, origins(sources), p.alpha, rounds)


def forward_push(graph: Graph, sources: DataFrame, p: Params, rounds: int | None = None) -> DataFrame:
    """The reserves of a push. Where the edges fit a worker and no number of ``rounds`` is given, each task pushes its sources to the end."""
    if rounds is None and graph.distinct <= LOCAL_EDGES:
        with phase("propagation"), few_at_once(graph.edges.sparkSession):
            return reserves(kept(pushed(graph, started(graph, sources), p.alpha, p.forward_push(), "source"), "push"))
    return reserves(push(started(graph, sources), graph.transitions(p.alpha), p.forward_push(), rounds))


def montecarlo(graph: Graph, sources: DataFrame, p: Params, seed: int = 1) -> DataFrame:
    """Shares of the destinations of omega walks, rounded up."""
    n = math.ceil(p.montecarlo())
    starts = fan_out(origins(sources).withColumnRenamed("origin", "start"), F.lit(n))
    found = destinations(walked(starts, graph, p.alpha, seed))
    return found.select(F.col("start").alias("source"), F.col("dest").alias("node"), (F.col("cnt") / F.lit(float(n))).alias("ppr"))


def normalised(ppr: DataFrame) -> DataFrame:
    """Absorbing scores divided by their sum per source: the scores with restart at the source."""
    total = ppr.groupBy("source").agg(F.sum("ppr").alias("total"))
    return ppr.join(total, "source").select("source", "node", (F.col("ppr") / F.col("total")).alias("ppr"))


def walk_plan(state: DataFrame, p: Params, omega: float, used: DataFrame | None = None) -> DataFrame:
    """Residual rows with their number of walks: ceil(share of the source's floor(omega * rsum)), at least one each.

    ``first``: walks of the node that the source has used up before, from ``used`` (origin, node, used); its next walks
    have the numbers after that.
    """
    left = state.where("residual > 0").join(residual_sums(state), "origin")
    share = 1 - p.alpha if p.opt else 1.0
    # rounded before floor and ceil, so that the order of a sum does not decide
    walks = F.greatest(F.floor(F.round(F.lit(omega) * F.col("rsum") * share, 9)), F.lit(1))
    plan = left.withColumn("n_walks", F.greatest(F.ceil(F.round(F.col("residual") / F.col("rsum") * walks, 9)), F.lit(1)).cast("bigint"))
    if used is None:
        return plan.withColumn("first", F.lit(0).cast("bigint"))
    return plan.join(used, ["origin", "node"], "left").withColumn("first", F.coalesce("used", F.lit(0))).drop("used")


def used_up(plan: DataFrame, used: DataFrame | None) -> DataFrame:
    """(origin, node, used): the walks that are used up after the plan."""
    now = plan.select("origin", "node", (F.col("first") + F.col("n_walks")).alias("used"))
    both = now if used is None else now.unionByName(used)
    return both.groupBy("origin", "node").agg(F.max("used").alias("used"))


def online_walks(plan: DataFrame, graph: Graph, p: Params, seed: int, after: DataFrame | None = None) -> DataFrame:
    """(start, walk, dest) of the walks the plan needs at each node, shared by all sources; those of an index (``after``: start, held) are left out."""
    need = plan.groupBy(F.col("node").alias("start")).agg(F.max(F.col("first") + F.col("n_walks")).alias("n"), F.min("first").alias("first"))
    if after is not None:
        need = need.join(after, "start", "left").withColumn("first", F.greatest("first", F.coalesce("held", F.lit(0)))).drop("held")
    rows = fan_out(need, F.col("n"), F.col("first")).select("start", "walk")
    return walked(rows, graph, p.alpha, seed, zero_hop=not p.opt, dangling="absorb")


def walks_in_sums(plan: DataFrame, graph: Graph, p: Params, seed: int) -> DataFrame:
    """(source, node, ppr): the residuals carried to the destinations of the plan's walks, summed up within tasks."""
    weight = F.col("residual") * (1 - p.alpha if p.opt else 1.0) / F.col("n_walks")
    rows = plan.select(F.col("origin").alias("source"), F.col("node").alias("start"), "first", F.col("n_walks").alias("n"), weight.alias("weight"), F.lit(0).alias("longer"))
    with phase("rand-walks"):
        found = kept(walk_sums(graph, rows, p.alpha, seed, not p.opt), "walk-sums")
    return found.select("source", "node", F.col("total").alias("ppr"))


def combined(state: DataFrame, plan: DataFrame, walks: DataFrame, p: Params, summed: bool = False) -> DataFrame:
    """Reserves plus residuals carried to the walks' destinations; the one-hop form keeps alpha of each residual where it is.

    ``summed``: ``walks`` are what ``walks_in_sums`` returns.
    """
    share = 1 - p.alpha if p.opt else 1.0
    parts = state.select(F.col("origin").alias("source"), "node", F.col("reserve").alias("ppr"))
    if p.opt:
        parts = parts.unionByName(state.select(F.col("origin").alias("source"), "node", (F.col("residual") * p.alpha).alias("ppr")))
    if summed:
        return normalised(parts.unionByName(walks).groupBy("source", "node").agg(F.sum("ppr").alias("ppr")).where("ppr > 0"))
    carried = plan.alias("r").join(walks.alias("w"), F.expr("r.node = w.start AND w.walk > r.first AND w.walk <= r.first + r.n_walks"))
    parts = parts.unionByName(carried.select(
        F.col("r.origin").alias("source"),
        F.col("w.dest").alias("node"),
        (F.col("r.residual") * share / F.col("r.n_walks")).alias("ppr"),
    ))
    return normalised(parts.groupBy("source", "node").agg(F.sum("ppr").alias("ppr")).where("ppr > 0"))


def push_walk(
    graph: Graph,
    sources: DataFrame,
    p: Params,
    seed: int = 1,
    index: DataFrame | None = None,
    rounds: int | None = None,
    rmax: float | None = None,
) -> DataFrame:
    """Forward push, then walks from what is left; ``index``: stored walks (start, walk, dest) that are used first.

    Push and walks let mass vanish at dead ends; the scores are divided by their sum at the end, so that walks and
    index don't depend on the source.
    """
    own_rmax, omega = p.push_walk()
    state = push(unit_state(origins(sources)), graph.transitions(p.alpha, "absorb"), rmax or own_rmax, rounds)
    return with_walks(graph, state, kept(walk_plan(state, p, omega), "walk-plan"), p, seed, index)


def with_walks(graph: Graph, state: DataFrame, plan: DataFrame, p: Params, seed: int, index: DataFrame | None = None) -> DataFrame:
    """(source, node, ppr) of a push's state and the written plan of its walks."""
    counted(walks=lambda: plan.agg(F.coalesce(F.sum("n_walks"), F.lit(0))).first()[0])
    if index is None and graph.distinct <= LOCAL_EDGES:
        return combined(state, plan, walks_in_sums(plan, graph, p, seed), p, summed=True)
    if index is None:
        return combined(state, plan, online_walks(plan, graph, p, seed), p)
    # a walk of the index that was absorbed has no destination but is used up: held counts walk numbers
    held = index.groupBy("start").agg(F.max("held").alias("held"))
    counted(index_walks=lambda: index_use(plan, held).agg(F.coalesce(F.sum("from_index"), F.lit(0))).first()[0])
    rest = online_walks(plan, graph, p, seed, held)
    return combined(state, plan, index.where("dest is not null").select("start", "walk", "dest").unionByName(rest), p)


def index_use(plan: DataFrame, held: DataFrame) -> DataFrame:
    """The plan with ``from_index``: how many of its walks the index (start, held) still has."""
    rows = plan.join(held.select(F.col("start").alias("node"), "held"), "node", "left")
    return rows.withColumn("from_index", F.greatest(F.lit(0), F.least(F.col("n_walks"), F.coalesce("held", F.lit(0)) - F.col("first"))))


def bidirectional(graph: Graph, sources: DataFrame, p: Params, seed: int = 1, rounds: int | None = None, back: DataFrame | None = None) -> DataFrame:
    """Walks from the sources, and backward push from every target (``back``: its state, if there is one)."""
    rmax, omega = p.bidirectional()
    if rmax >= 1:
        return montecarlo(graph, sources, p, seed)
    n = math.ceil(omega)
    starts = fan_out(origins(sources).withColumnRenamed("origin", "start"), F.lit(n))
    found = destinations(walked(starts, graph, p.alpha, seed, dangling="absorb"))
    back = all_targets(graph, p, rmax, rounds) if back is None else back
    return from_both_sides(found, back, n)


def all_targets(graph: Graph, p: Params, rmax: float, rounds: int | None = None) -> DataFrame:
    """The backward states of all nodes as targets; origin is the target."""
    return push(unit_state(graph.nodes.select(F.col("node").alias("origin"))), graph.backward(p.alpha), rmax, rounds, strict=True)


def from_both_sides(found: DataFrame, back: DataFrame, n: float) -> DataFrame:
    """reserve of the target at the source plus the mean of its residuals at the walks' destinations."""
    met = found.join(back.where("residual > 0"), F.col("dest") == F.col("node")).select(
        F.col("start").alias("source"),
        F.col("origin").alias("node"),
        (F.col("cnt") * F.col("residual") / F.lit(float(n))).alias("ppr"),
    )
    direct = found.select("start").distinct().join(back.where("reserve > 0"), F.col("start") == F.col("node")).select(
        F.col("start").alias("source"),
        F.col("origin").alias("node"),
        F.col("reserve").alias("ppr"),
    )
    return normalised(direct.unionByName(met).groupBy("source", "node").agg(F.sum("ppr").alias("ppr")))
