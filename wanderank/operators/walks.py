"""Random walks by hash draws.

A walk's length and each of its steps come from an MD5 of (seed, start, walk number, step), so that retried tasks, an
index and other SQL engines draw the same walk. The length is geometric and drawn first; a step is an equi-join of the
walks still under way with (node, number of the out-edge). After ``UNROLL`` steps the finished walks are set aside. Where the
edges fit a worker, each task holds them in numpy instead and makes all steps of its walks, with the same draws.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..report import phase
from ..session import dropped, kept, sized
from ..sources.graphs import Graph, draw_number, narrow
from .pieces import PIECES_EDGES, walked_over_pieces
from .power import LOCAL_EDGES

UNROLL = 8
#: Walks that one row of the first stage of a fan-out stands for, and walks of a task after it.
BLOCK, TASK_WALKS = 8192, 100_000


def walk_length(seed: int, start: Column, walk: Column, alpha: float, zero_hop: bool = True) -> Column:
    """Hops of a walk: each further one with probability 1 - alpha; the first is certain without zero-hop walks."""
    u = (draw_number(F.lit(seed), start, walk, F.lit("stop")) + 1) / F.lit(float(1 << 32))
    hops = F.floor(F.ln(u) / F.lit(math.log(1 - alpha))).cast("int")
    return hops if zero_hop else hops + 1


def walked(starts: DataFrame, graph: Graph, alpha: float = 0.2, seed: int = 1, zero_hop: bool = True, dangling: str = "walk_start") -> DataFrame:
    """(start, walk, dest) for each row (start, walk) of ``starts``.

    A start without out-edges is its own destination. A dead end on the way sends the walk back to its start, or with
    ``dangling`` "absorb" ends it there without a destination unless its length is reached.
    """
    deg = graph.nodes.select(F.col("node").alias("start"), F.col("out_deg").alias("deg"))
    rows = starts.select("start", "walk").join(deg, "start")
    hops = walk_length(seed, F.col("start"), F.col("walk"), alpha, zero_hop)
    alive = rows.select(
        "start",
        "walk",
        F.col("start").alias("cur"),
        F.col("deg").alias("deg"),
        F.lit(0).alias("step"),
        F.when((F.col("deg") == 0) & (F.lit(dangling) != "absorb"), 0).otherwise(hops).alias("len"),
    )
    alive = alive.withColumn("home", F.col("deg"))
    finished, spark = [], starts.sparkSession
    with phase("rand-walks"):
        if graph.distinct <= LOCAL_EDGES:
            return kept(walked_in_tasks(alive, graph, seed, dangling), "walks").drop("hub")
        alive = kept(alive, "walks")
        if graph.distinct <= PIECES_EDGES:
            parts = max(1, min(spark.sparkContext.defaultParallelism, alive.count() // TASK_WALKS))
            out = walked_over_pieces(alive, graph, seed, dangling, parts)
            dropped(alive)
            return out
        with sized(spark, alive.count()):
            while True:
                at = alive
                for _ in range(UNROLL):
                    at = _stepped(at, graph.neighbours, seed, dangling)
                at = kept(at, "walks")
                dropped(alive)
                finished.append(at.where("step >= len").select("start", "walk", F.col("cur").alias("dest")))
                alive = at.where("step < len")
                if alive.isEmpty():
                    return functools.reduce(DataFrame.unionByName, finished)


def walked_in_tasks(alive: DataFrame, graph: Graph, seed: int, dangling: str, hubs: tuple[int, ...] = ()) -> DataFrame:
    """(start, walk, dest, hub) of walks (start, walk, len) from their first step to their last; each task gets all edges and a share of the walks.

    A walk that comes to one of ``hubs``, or starts there, rests there and is marked. Walks that are absorbed have no row.
    """
    parts = max(1, graph.edges.sparkSession.sparkContext.defaultParallelism)
    long = lambda c: F.col(c).cast("bigint")
    edges = graph.edges.select(F.lit(0).alias("kind"), long("src").alias("a"), long("dst").alias("b"), long("cnt").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    walks = alive.select(F.lit(1).alias("kind"), long("start").alias("a"), long("walk").alias("b"), long("len").alias("c"), F.pmod(F.hash("start", "walk"), F.lit(parts)).alias("part"))
    rows = edges.unionByName(walks).repartitionById(parts, "part").sortWithinPartitions("kind").drop("part")
    return rows.mapInArrow(lambda batches: _walks_of_task(batches, seed, dangling == "absorb", hubs), "start bigint, walk bigint, dest bigint, hub boolean")


def _walks_of_task(batches: Iterator[pa.RecordBatch], seed: int, absorb: bool, hubs: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    edges, net = [], None
    for batch in batches:
        kind, *cols = (batch.column(c).to_numpy() for c in ("kind", "a", "b", "c"))
        first = int(np.searchsorted(kind, 1))
        if first:
            edges.append([narrow(c[:first]) for c in cols])
        if first == len(kind):
            continue
        if net is None:
            net = _Net(edges, hubs)
        yield net.walked(*(c[first:] for c in cols), seed, absorb)


class _Net:
    """A graph's out-edges in order of (src, dst), with the sums of parallel edges up to each. The last node has no edge and no id of its own."""

    def __init__(self, edges: list, hubs: tuple[int, ...]):
        src, dst, cnt = (np.concatenate(c) for c in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 3
        edges.clear()
        self.hubs = np.array(hubs, np.int64)
        self.ids = np.unique(np.concatenate([np.unique(src), np.unique(dst)])).astype(np.int64)
        n = len(self.ids)
        src, dst = np.searchsorted(self.ids, src).astype(np.int32), np.searchsorted(self.ids, dst).astype(np.int32)
        order = np.lexsort((dst, src))
        self.dst = dst[order]
        self.upto = np.cumsum(cnt[order], dtype=np.int64)
        self.deg = np.bincount(src, weights=cnt, minlength=n + 1).astype(np.int64)
        self.base = np.cumsum(self.deg) - self.deg
        self.is_hub = np.append(np.isin(self.ids, self.hubs), False)

    def walked(self, start: np.ndarray, walk: np.ndarray, length: np.ndarray, seed: int, absorb: bool) -> pa.RecordBatch:
        n, md5 = len(self.ids), hashlib.md5
        home = np.searchsorted(self.ids, start)
        known = home < n
        known[known] = self.ids[home[known]] == start[known]
        home[~known] = n
        cur, gone = home.copy(), np.zeros(len(start), bool)
        rests = np.isin(start, self.hubs)
        alive, step = np.flatnonzero(~rests & (length > 0)), 0
        while len(alive):
            deg = self.deg[cur[alive]]
            moving, stuck = alive[deg > 0], alive[deg == 0]
            draws = [int.from_bytes(md5(b"%d:%d:%d:%d:next" % (seed, s, w, step)).digest()[:4], "big") for s, w in zip(start[moving].tolist(), walk[moving].tolist(), strict=True)]
            pick = np.array(draws, np.int64) % deg[deg > 0]
            cur[moving] = self.dst[np.searchsorted(self.upto, self.base[cur[moving]] + pick, side="right")]
            rests[moving] = self.is_hub[cur[moving]]
            if absorb:
                gone[stuck] = True
            else:
                cur[stuck] = home[stuck]
            step += 1
            alive = alive[~gone[alive] & ~rests[alive] & (length[alive] > step)]
        dest = np.where(cur < n, self.ids[np.minimum(cur, n - 1)], start) if n else start
        left = ~gone
        return pa.RecordBatch.from_arrays([pa.array(start[left]), pa.array(walk[left]), pa.array(dest[left]), pa.array(rests[left])], ["start", "walk", "dest", "hub"])


def _stepped(alive: DataFrame, neighbours: DataFrame, seed: int, dangling: str, hubs: bool = False) -> DataFrame:
    """One hop of the walks that have not reached their length; others pass. With ``hubs`` walks also rest where ``hub`` is true."""
    goes = F.col("step") < F.col("len")
    if hubs:
        goes = goes & ~F.col("hub")
    pick = F.pmod(draw_number(F.lit(seed), F.col("start"), F.col("walk"), F.col("step"), F.lit("next")), F.greatest(F.col("deg"), F.lit(1)))
    a = alive.withColumn("pick", F.when(goes & (F.col("deg") > 0), pick)).alias("a")
    joined = a.join(neighbours.alias("b"), (F.col("a.cur") == F.col("b.src")) & (F.col("a.pick") == F.col("b.k")), "left")
    moved = F.col("b.dst").isNotNull()
    stuck = goes & ~moved  # at a dead end
    out = joined.select(
        F.col("a.start").alias("start"), F.col("a.walk").alias("walk"),
        F.when(moved, F.col("b.dst")).when(stuck, F.col("a.start")).otherwise(F.col("a.cur")).alias("cur"),
        F.when(moved, F.col("b.dst_deg")).when(stuck, F.col("a.home")).otherwise(F.col("a.deg")).alias("deg"),
        F.when(goes, F.col("a.step") + 1).otherwise(F.col("a.step")).alias("step"),
        F.col("a.len").alias("len"), F.col("a.home").alias("home"), stuck.alias("stuck"),
        *([F.when(moved, F.col("b.dst_hub")).otherwise(F.col("a.hub")).alias("hub")] if hubs else []),
    )
    return (out.where("not stuck") if dangling == "absorb" else out).drop("stuck")


def fan_out(rows: DataFrame, n: Column, first: Column | None = None) -> DataFrame:
    """Each row once for each walk number ``first`` + 1 to n (1 to n by default); rows without such numbers go.

    In two stages, first blocks of numbers and then, dealt over the tasks, the numbers, so that no row is made into very
    many by one task.
    """
    first = F.lit(0) if first is None else first
    rows = rows.withColumns({"__lo": first.cast("bigint"), "__n": n.cast("bigint")}).where("__n > __lo")
    total = rows.agg(F.coalesce(F.sum(F.col("__n") - F.col("__lo")), F.lit(0))).first()[0]
    blocks = rows.withColumn("__b", F.explode(F.expr(f"sequence(0L, (__n - __lo - 1) div {BLOCK})")))
    tasks = max(1, total // TASK_WALKS, min(total // BLOCK, rows.sparkSession.sparkContext.defaultParallelism))
    if tasks > 1:
        blocks = blocks.repartition(int(tasks), *[F.col(f"`{c}`") for c in blocks.columns])
    numbers = F.expr(f"sequence(__lo + __b * {BLOCK} + 1, least(__lo + (__b + 1) * {BLOCK}, __n))")
    return blocks.withColumn("walk", F.explode(numbers)).drop("__lo", "__n", "__b")


def destinations(walks: DataFrame) -> DataFrame:
    """(start, dest, cnt)."""
    return walks.groupBy("start", "dest").agg(F.count(F.lit(1)).alias("cnt"))
