"""Adaptive plans: push and walks refined until the top k of each source are settled, or costs are in balance.

All sources share a schedule of delta; those that are settled leave it, the others' push states are pushed on. A round
never uses the walks of the rounds before again, be they from an index or online: a cursor per source and node tells
how many are used up.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bounds import martingale_bounds, rest_bound, score_bounds, stops
from ..operators.estimators import all_targets, montecarlo, origins, used_up, walk_plan, with_walks
from ..operators.indexes import Hubs, build_hubs, hub_all_targets, hub_walks
from ..operators.intask import pushed
from ..operators.power import LOCAL_EDGES
from ..operators.push import is_pushed, push, residual_sums, unit_state
from ..operators.topk import kth_value, topk
from ..report import counted, phase
from ..session import kept
from ..sources.graphs import Graph, few_at_once
from .bounded import bounded_in_tasks
from .params import Params


#: Walks of the first of the doubling batches, as a power of two; fewer settle nothing.
FIRST_BATCH = 8


def _settled(done: DataFrame | None, part: DataFrame) -> DataFrame:
    return part if done is None else done.unionByName(part)


def topk_adaptive(graph: Graph, sources: DataFrame, k: int, p: Params, seed: int = 1, index: DataFrame | None = None) -> DataFrame:
    """One-hop form: delta from 1/(10 k), quartered down to 1/n; a source stops when its k-th score is (1 + epsilon) delta or more."""
    if k < 1:
        raise ValueError("k must be at least 1")
    p = p.at(opt=True, p_fail=1 / p.n**2)
    delta, least = max(1 / p.n, 1 / (10 * k)), 1 / p.n
    state, done, used = unit_state(origins(sources)), None, None
    while True:
        now = p.at(delta=delta)
        rmax, omega = now.push_walk_topk()
        state = push(state, graph.transitions(p.alpha, "absorb"), rmax)
        plan = kept(walk_plan(state, now, omega, used), "adaptive-plan")
        ppr = kept(with_walks(graph, state, plan, now, seed, index), "adaptive")
        kth = kept(kth_value(ppr, k).select("source", (F.col("kth") >= (1 + p.epsilon) * delta).alias("stop")), "adaptive-kth")
        last = delta <= least
        ready = kth if last else kth.where("stop")
        done = _settled(done, topk(ppr, k).join(ready, "source", "left_semi"))
        left = kth.where("not stop")
        if last or left.isEmpty():
            return done
        left = left.select(F.col("source").alias("origin"))
        used = kept(used_up(plan, used).join(left, "origin", "left_semi"), "adaptive-used")
        state = kept(state.join(left, "origin", "left_semi"), "adaptive-state")
        delta = max(least, delta / 4)


def topk_bounded(graph: Graph, sources: DataFrame, k: int, p: Params, seed: int = 1, index: DataFrame | None = None, every: bool = False) -> DataFrame:
    """With lower and upper bounds: delta from 1/4, halved down to 1/n, until the bounds tell the top k from the rest.

    Returns (source, rank, node, ppr, lb, ub, rest_ub); rest_ub bounds the scores of all nodes that no walk has reached.
    With ``every``, the rows of all nodes reached in a source's last round, with no rank where they are not in its list.
    """
    p = p.at(opt=False, p_fail=1 / (p.n**2 * max(1.0, math.log(p.n))))
    if index is None and graph.distinct <= LOCAL_EDGES:
        with phase("rand-walks"), few_at_once(graph.edges.sparkSession):
            found = kept(bounded_in_tasks(graph, origins(sources), k, p, seed, every), "bounded")
        counted(walks=lambda: found.where("rank = 1").agg(F.coalesce(F.sum("walks"), F.lit(0))).first()[0])
        return found.drop("walks")
    delta, least = max(0.25, 1 / p.n), 1 / p.n
    state, done, old, used = unit_state(origins(sources)), None, None, None
    rest = origins(sources).select(F.col("origin").alias("source"), F.lit(1.0).alias("rest_ub"))
    while True:
        now = p.at(delta=delta)
        rmax, omega = now.push_walk()
        state = push(state, graph.transitions(p.alpha, "absorb"), rmax)
        plan = kept(walk_plan(state, now, omega, used), "bounds-plan")
        ppr = with_walks(graph, state, plan, now, seed, index)
        spent = plan.groupBy(F.col("origin").alias("source")).agg(F.max("rsum").alias("rsum"), F.sum("n_walks").alias("walks"))
        bound = rest_bound(now, F.coalesce("rsum", F.lit(0.0)), F.coalesce("walks", F.lit(1)), F.col("rest_ub"))
        rest = kept(rest.join(spent, "source", "left").select("source", bound.alias("rest_ub")), "bounds-rest")
        rows = ppr.join(spent, "source", "left").join(state.select(F.col("origin").alias("source"), "node", "reserve"), ["source", "node"], "left")
        rows = rows.join(old, ["source", "node"], "left") if old is not None else rows.withColumns({
            "lb0": F.lit(None).cast("double"),
            "ub0": F.lit(None).cast("double"),
        })
        lb, ub = score_bounds(now, F.col("ppr"), F.col("reserve"), F.col("lb0"), F.col("ub0"), F.coalesce("rsum", F.lit(0.0)), F.coalesce("walks", F.lit(1)))
        bounds = kept(rows.select("source", "node", "ppr", lb.alias("lb"), ub.alias("ub")), "bounds")
        ready = kept(stops(bounds, now, k), "bounds-stop")
        last = delta <= least
        best = bounds.join(topk(bounds, k).select("source", "node", "rank"), ["source", "node"], "left" if every else "inner").join(rest, "source")
        done = _settled(
            done,
            best.join(ready if last else ready.where("stop"), "source", "left_semi").select("source", "rank", "node", "ppr", "lb", "ub", "rest_ub"),
        )
        left = ready.where("not stop")
        if last or left.isEmpty():
            return done
        origin = left.select(F.col("source").alias("origin"))
        state = kept(state.join(origin, "origin", "left_semi"), "bounds-state")
        used = kept(used_up(plan, used).join(origin, "origin", "left_semi"), "bounds-used")
        rest = rest.join(left, "source", "left_semi")
        keep_bounds = delta < now.topk_threshold()
        old = bounds.select("source", "node", F.col("lb").alias("lb0"), F.col("ub").alias("ub0")) if keep_bounds else None
        delta = max(least, delta / 2)


def topk_martingale(graph: Graph, sources: DataFrame, k: int, p: Params, hubs: Hubs | None = None, seed: int = 1) -> DataFrame:
    """Hub oracles and doubling batches of walks, with martingale bounds; targets that can't reach the top k are pruned.

    Returns (source, rank, node, ppr, lb, ub), ranked by lower bound; ppr is the bound's middle.
    """
    rmax, _ = p.bidirectional()
    if rmax >= 1:
        return topk(montecarlo(graph, sources, p, seed), k).withColumns({"lb": F.col("ppr"), "ub": F.col("ppr")})
    enough = 2 * rmax * math.log(2 * k / p.p_fail) / p.epsilon**2 / p.delta
    log_fail = math.log(p.p_fail / 2 / p.n / max(1.0, math.log2(p.n * p.alpha * p.n * p.n)) / 2)
    hubs = build_hubs(graph, p, seed=seed) if hubs is None else hubs
    back = kept(hub_all_targets(graph, hubs, p, rmax), "hub-targets")
    weights = back.where("residual > 0").select(F.col("origin").alias("target"), F.col("node").alias("dest"), "residual")
    own = back.where("reserve > 0").select(F.col("origin").alias("target"), F.col("node").alias("source"), "reserve")
    # bounds start from the targets that the source's reserve or walks reach; all others stay at (0, 1) and are never in the top k
    state, done, total, first = None, None, 0, 1
    live = origins(sources).select(F.col("origin").alias("source"))
    for i in itertools.count(FIRST_BATCH):
        n = 2**i
        found = hub_walks(graph, live, n, hubs, p, seed, first, split=True)
        first, total = first + n, total + n
        new = found.join(weights, "dest").groupBy(F.col("start").alias("source"), "target").agg(F.sum(F.col("cnt") * F.col("residual")).alias("w"))
        direct = own.join(live, "source", "left_semi").select("source", "target", F.lit(0.0).alias("w"))
        parts = new.unionByName(direct)
        if state is not None:
            parts = parts.unionByName(state.select("source", "target", F.col("weight").alias("w")))
        rows = parts.groupBy("source", "target").agg(F.sum("w").alias("weight")).join(own, ["source", "target"], "left").withColumn("reserve", F.coalesce("reserve", F.lit(0.0)))
        rows = rows.join(
            state.select("source", "target", F.col("lb").alias("lb0"), F.col("ub").alias("ub0")),
            ["source", "target"],
            "left",
        ) if state is not None else rows.withColumns({"lb0": F.lit(0.0), "ub0": F.lit(1.0)})
        lb, ub = martingale_bounds(
            rmax,
            log_fail,
            total,
            1 / p.n,
            F.col("weight"),
            F.col("reserve"),
            F.coalesce("lb0", F.lit(0.0)),
            F.coalesce("ub0", F.lit(1.0)),
        )
        state = kept(rows.select("source", "target", "weight", "reserve", lb.alias("lb"), ub.alias("ub")), "martingale")
        ranked_rows = topk(
            state.select("source", F.col("target").alias("node"), F.col("lb").alias("ppr"), "ub", "lb").where("ppr > 0"),
            k,
        ).withColumnRenamed("ppr", "lb")
        ranked_rows = ranked_rows.join(state.select("source", F.col("target").alias("node"), "ub"), ["source", "node"])
        best = kept(ranked_rows.select("source", "rank", "node", ((F.col("lb") + F.col("ub")) / 2).alias("ppr"), "lb", "ub"), "martingale-top")
        kth = best.where(F.col("rank") == k)
        enough_now = n >= enough
        ready = live if enough_now else kth.where(F.col("lb") * (1 + p.epsilon) >= F.col("ub")).select("source")
        done = _settled(done, best.join(ready, "source", "left_semi"))
        if enough_now:
            return done
        live = kept(live.join(ready, "source", "left_anti"), "martingale-live")
        if live.isEmpty():
            return done
        floor = kth.select("source", F.col("lb").alias("floor"))
        state = kept(
            state.join(live, "source", "left_semi").join(floor, "source", "left").where("floor is null or ub > floor").drop("floor"),
            "martingale-state",
        )


def balanced(graph: Graph, sources: DataFrame, p: Params, seed: int = 1) -> DataFrame:
    """Push and walk with the push threshold found by cost: from 8 r it is halved while the walks left are expected to
    take longer than the push did. Costs are counted (edges touched, walks), not timed, so reruns agree."""
    rmax, omega = p.push_walk()
    state, deg = unit_state(origins(sources)), graph.nodes.select("node", F.col("out_deg").cast("double").alias("deg"))
    now, pushed_edges = 8 * rmax, 0.0
    while True:
        due = state.join(deg, "node").where(is_pushed(F.col("residual"), F.col("deg"), now))
        pushed_edges += due.agg(F.coalesce(F.sum("deg"), F.lit(0.0))).first()[0]
        if graph.distinct <= LOCAL_EDGES:
            with phase("propagation"):
                state = kept(pushed(graph, state, p.alpha, now), "push")
        else:
            state = push(state, graph.transitions(p.alpha, "absorb"), now)
        left = residual_sums(state).agg(F.coalesce(F.sum("rsum"), F.lit(0.0))).first()[0]
        if now <= rmax or omega * left * (1 - p.alpha) <= pushed_edges:
            return with_walks(graph, state, kept(walk_plan(state, p, omega), "walk-plan"), p, seed)
        now = max(rmax, now / 2)


__all__ = ["all_targets", "balanced", "topk_adaptive", "topk_bounded", "topk_martingale"]
