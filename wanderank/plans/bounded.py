"""Bounded top-k of one source within a task: the rounds of ``adaptive.topk_bounded`` over a graph in numpy.

The bounds and the stop test are those of ``functions.bounds``, on arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.intask import Net, batches_of, dealt, in_tasks, tasks_of
from ..operators.topk import DIGITS
from ..sources.graphs import Graph
from .params import Params

FOUND = "source bigint, rank int, node bigint, ppr double, lb double, ub double, rest_ub double, walks bigint"


def _lambda(rsum: float, log_fail: float, upper, walks: int):
    return log_fail * rsum / (3.0 * walks) + np.sqrt(4.0 / 9.0 * log_fail * log_fail * rsum * rsum + 8.0 * walks * log_fail * rsum * upper) / (2.0 * walks)


def _bounds(p: Params, ppr: np.ndarray, reserve: np.ndarray, lower: np.ndarray, upper: np.ndarray, rsum: float, walks: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``score_bounds``; ``lower`` and ``upper`` are nan where there are none."""
    before = np.where(np.isnan(lower), 0.0, lower)
    room = np.where(upper > reserve, upper - reserve, 1.0 - reserve)
    absolute = _lambda(rsum, p.log_fail, room, walks)
    held = reserve > 1 / p.n
    known = np.where(held, np.maximum(reserve, before), np.where(before > 0, before, 1 / p.n))
    relative = np.sqrt(2.67 * rsum * p.log_fail / walks) / np.sqrt(known)
    sure = relative < 1
    ub = np.minimum(np.minimum(ppr + absolute, np.where(sure, ppr / np.where(sure, 1.0 - relative, 1.0), 1.0)), 1.0)
    lb = np.maximum(np.maximum(ppr - absolute, np.where(sure, ppr / (1.0 + relative), 0.0)), np.where(held, np.maximum(reserve, before), reserve))
    return np.maximum(lb, 0.0), ub


def _first(values: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties by place."""
    return np.argsort(-values, kind="stable")[:k]


def _stops(p: Params, ppr: np.ndarray, lb: np.ndarray, ub: np.ndarray, k: int) -> bool:
    """As ``stops``."""
    e, high, best = p.epsilon, _first(np.round(ppr, 12), k), _first(np.round(lb, 12), k)
    kth = ppr[high[-1]] if len(high) == k else 0.0
    if kth >= 2 * p.delta:
        return True
    kth_lb = lb[best[-1]] if len(best) == k else 0.0
    inside = np.zeros(len(ppr), bool)
    inside[best] = True
    outside = ~inside & (ppr > 0) & (ub > kth_lb * (1 + e)) & ((ub <= (1 + e) / (1 - e) * lb) if e < 1 else True)
    wide = inside & (ub > (1 + e) * lb)
    return bool(p.delta < p.topk_threshold() and not wide.any() and kth_lb > p.delta and not outside.any())


def bounded_source(net: Net, source: int, k: int, p: Params, seed: int, every: bool = False) -> tuple[np.ndarray, ...]:
    """Places of the top k of ``source`` (a place), with ppr, lb and ub, the bound of the nodes not reached and the number of walks.

    With ``every``, the other nodes reached follow the top k.
    """
    reserve, residual, used = np.zeros(net.n), np.zeros(net.n), np.zeros(net.n, np.int64)
    lower, upper = np.full(net.n, np.nan), np.full(net.n, np.nan)
    residual[source] = 1.0
    delta, least, rest, made = max(0.25, 1 / p.n), 1 / p.n, 1.0, 0
    while True:
        now = p.at(delta=delta)
        rmax, omega = now.push_walk()
        net.push(reserve, residual, p.alpha, rmax)
        left = np.flatnonzero(residual > 0)
        rsum, walks, ppr = float(residual[left].sum()), 1, reserve.copy()
        if len(left):
            total = max(math.floor(round(omega * rsum, 9)), 1)
            count = np.maximum(np.ceil(np.round(residual[left] / rsum * total, 9)), 1).astype(np.int64)
            ppr += net.sums(left, used[left], count, residual[left] / count, seed, p.alpha)
            used[left] += count
            walks = int(count.sum())
            made += walks
        rest = float(_lambda(rsum, now.log_fail, rest, walks))
        ppr /= ppr.sum()
        met = np.flatnonzero(ppr > 0)
        lb, ub = _bounds(now, ppr[met], reserve[met], lower[met], upper[met], rsum, walks)
        if delta <= least or _stops(now, ppr[met], lb, ub, k):
            best = _first(np.round(ppr[met], DIGITS), len(met) if every else k)
            return met[best], ppr[met][best], lb[best], ub[best], rest, made
        lower[:], upper[:] = np.nan, np.nan
        if delta < now.topk_threshold():
            lower[met], upper[met] = lb, ub
        delta = max(least, delta / 2)


def bounded_in_tasks(graph: Graph, starts: DataFrame, k: int, p: Params, seed: int, every: bool = False) -> DataFrame:
    """``FOUND`` of all sources; ``starts``: (origin), distinct. With ``every``, of all nodes reached, without a rank beyond k."""
    (places, parts), none = dealt(starts, tasks_of(graph)), F.lit(None)
    work = starts.join(places, "origin").select(F.col("origin").alias("a"), F.col("origin").alias("b"), none.alias("c"), none.alias("d"), none.alias("x"), none.alias("y"), "part")

    def run(net: Net, mine: dict) -> Iterator[pa.RecordBatch]:
        for source in np.unique(mine["a"]):
            at, ppr, lb, ub, rest, made = bounded_source(net, int(net.at(source)), k, p, seed, every)
            n, rank = len(at), np.arange(1, len(at) + 1, dtype=np.int32)
            columns = [np.full(n, source), np.ma.masked_greater(rank, k), net.ids[at], ppr, lb, ub, np.full(n, rest), np.full(n, made)]
            yield from batches_of([c.split()[0] for c in FOUND.split(", ")], columns)

    return in_tasks(graph, work, parts, run, FOUND)
