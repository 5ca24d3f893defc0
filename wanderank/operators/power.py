"""Power iteration of many sources side by side.

With all residuals pushed in each round, the reserves after t rounds are p_t = alpha e + W p_(t-1) with p_0 = 0, so that
scores alone are carried on. Where the edges fit a worker, each task holds them in numpy and runs all rounds of its share of
the sources. For larger graphs, a state row holds a node's scores for a group of sources, one column each, so that a round
meets every edge once for the group and not once per source. Both give the scores of the same rounds over all edges.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..report import phase
from ..session import dropped, kept, sized
from ..sources.graphs import Graph, unpacked
from .gather import Gather, dense

#: Distinct edges that a worker holds, at about 40 bytes each.
LOCAL_EDGES = 8_000_000
#: Sources of a group of the larger form, and rounds of one of its plans.
WIDE, UNROLL = 20, 5
#: What the rounds that a geometric series stands for may be off by, in sum over all nodes.
TAIL = 1e-13
SCORES = "source bigint, node bigint, ppr double"


def power_scores(graph: Graph, origins: DataFrame, alpha: float, rounds: int, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(source, node, ppr) after ``rounds`` rounds in which every residual is pushed; ``origins``: (origin), distinct."""
    ids = sorted(r[0] for r in origins.collect())
    if not ids or rounds < 1:
        return origins.sparkSession.createDataFrame([], SCORES)
    if graph.distinct <= local_edges:
        return _local(graph, ids, alpha, rounds)
    return functools.reduce(DataFrame.unionByName, [_group(graph, ids[i : i + WIDE], alpha, rounds) for i in range(0, len(ids), WIDE)])


# ---- within a task ------------------------------------------------------------------------------------------------------


def _local(graph: Graph, ids: list[int], alpha: float, rounds: int) -> DataFrame:
    spark = graph.edges.sparkSession
    parts = min(len(ids), max(1, spark.sparkContext.defaultParallelism))
    shares = [ids[i::parts] for i in range(parts)]
    rows = graph.beside(spark.range(parts).select(F.col("id").cast("int").alias("part")), parts)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            src, dst, cnt, part = (batch.column(c) for c in ("src", "dst", "cnt", "part"))
            for i in np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False)):
                # a row of the work has no edge: a graph may have none
                empty = (np.zeros(0, np.uint8),) * 3
                held.setdefault(part[int(i)].as_py(), []).append([unpacked(c[int(i)]) for c in (src, dst, cnt)] if src[int(i)].is_valid else empty)
            del batch, src, dst, cnt, part
        for i in list(held):
            yield from _iterated([np.concatenate(c) for c in zip(*held.pop(i), strict=True)], shares[i], alpha, rounds)

    return rows.mapInArrow(scored, SCORES)


def _iterated(edges: list[np.ndarray], sources: list[int], alpha: float, rounds: int) -> Iterator[pa.RecordBatch]:
    """The scores of each source over the edges (src, dst, cnt), which come in any order and are taken out of the list; a dead end's rest goes back to the source."""
    src, dst, cnt = edges
    edges.clear()
    ids, src, dst = dense(src, dst, np.array(sources, np.int64))
    n, single = len(ids), not len(cnt) or int(cnt.max()) == 1
    deg = np.bincount(src, weights=None if single else cnt, minlength=n)
    moved = Gather(src, dst, None if single else cnt, n)
    del src, dst, cnt
    ends = np.flatnonzero(deg == 0)
    share = (1 - alpha) / np.maximum(deg, 1)
    for source in sources:
        p = _rounds(moved, share, ends, int(np.searchsorted(ids, source)), alpha, rounds)[0]
        met = np.flatnonzero(p > 0)
        for lo in range(0, len(met), 100_000):
            some = met[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), source, np.int64)), pa.array(ids[some]), pa.array(p[some])], ["source", "node", "ppr"])


def _rounds(moved: Gather, share: np.ndarray, ends: np.ndarray, at: int, alpha: float, rounds: int) -> tuple[np.ndarray, int]:
    """The scores of the source at ``at`` after ``rounds`` rounds, and how many of these were made one by one.

    A round adds d_t = p_t - p_(t-1), and d_(t+1) = W d_t, where W lets 1 - alpha of all mass through. Once d_(t+1) differs from
    (1 - alpha) d_t by a sum e over all nodes, the rounds left add (1 - alpha)^k d_(t+1) for k = 1, 2, ..., but for e / alpha^2 in sum
    over all nodes; where that is within ``TAIL``, they are added as the geometric series that they are. By then no node is left
    to be reached: a round that reaches none is followed by none that does.
    """
    p, before, reached, done = np.zeros(moved.n), None, 1, 1
    p[at] = alpha
    while done < rounds:
        back = share[ends] @ p[ends]
        new = moved.sums(p * share)
        new[at] += alpha + back
        done += 1
        gain, p = new - p, new
        if before is not None and np.abs(gain - (1 - alpha) * before).sum() <= TAIL * alpha * alpha and np.count_nonzero(p) == reached:
            left = rounds - done
            return p + gain * ((1 - alpha) * (1 - (1 - alpha) ** left) / alpha), done
        before, reached = gain, np.count_nonzero(p)
    return p, done


# ---- larger graphs ------------------------------------------------------------------------------------------------------


def _moves(graph: Graph, group: list[int], alpha: float) -> tuple[DataFrame, int | None]:
    """(src, dst, res, only): what a unit of score at src gives to dst, and the id that stands for what dead ends give back, if there are any.

    ``only`` is null, or the one column that a row holds for. What dead ends give back differs by column: it is gathered at an
    id of its own, whose edges are those of each column's source.
    """
    deg = graph.nodes.select(F.col("node").alias("src"), F.col("out_deg").cast("double").alias("deg"))
    none = F.lit(None).cast("int")
    moved = graph.edges.join(deg, "src").select("src", "dst", (F.lit(1 - alpha) * F.col("cnt") / F.col("deg")).alias("res"), none.alias("only"))
    low, high, ends = graph.nodes.agg(F.min("node"), F.max("node"), F.count_if(F.col("out_deg") == 0)).first()
    places = F.broadcast(graph.nodes.sparkSession.createDataFrame(list(enumerate(group)), "j int, src bigint"))
    back = None
    if ends:
        back = low - 1 if low > -(1 << 63) else high + 1
        moved = moved.unionByName(deg.where("deg = 0").select("src", F.lit(back).cast("bigint").alias("dst"), F.lit(1 - alpha).alias("res"), none.alias("only")))
        moved = moved.unionByName(moved.drop("only").join(places, "src").select(F.lit(back).cast("bigint").alias("src"), "dst", "res", F.col("j").alias("only")))
    # a source's own row stays in the state, whether edges lead there or not
    stay = places.select("src", F.col("src").alias("dst"), F.lit(0.0).alias("res"), none.alias("only"))
    # by target, so that the rows of a round are summed up before they are exchanged; a target of many edges is split by src
    return kept(moved.unionByName(stay).repartitionByRange("dst", "src"), "power-moves"), back


def _round(state: DataFrame, moves: DataFrame, group: list[int], names: list[str], alpha: float, back: int | None) -> DataFrame:
    given = "res * {c}" if back is None else "CASE WHEN only IS NULL OR only = {j} THEN res * {c} ELSE 0D END"
    sums = [F.expr(f"sum({given.format(c=c, j=j)}) AS {c}") for j, c in enumerate(names)]
    rows = moves.join(state, F.col("src") == F.col("node")).groupBy("dst").agg(*sums)
    return rows.selectExpr("dst AS node", *[f"{c} + CASE WHEN dst = {s}L THEN {alpha!r}D ELSE 0D END AS {c}" for s, c in zip(group, names, strict=True)])


def _group(graph: Graph, group: list[int], alpha: float, rounds: int) -> DataFrame:
    names = [f"p{j}" for j in range(len(group))]
    places = graph.nodes.sparkSession.createDataFrame(list(enumerate(group)), "j int, node bigint")
    state = places.select("node", *[F.when(F.col("j") == j, alpha).otherwise(0.0).alias(c) for j, c in enumerate(names)])
    with phase("propagation"), sized(graph.nodes.sparkSession, graph.distinct):
        moves, back = _moves(graph, group, alpha)
        state, done = kept(state, "power"), 1
        while done < rounds:
            before = state
            for _ in range(min(UNROLL, rounds - done)):
                state = _round(state, moves, group, names, alpha, back)
                done += 1
            state = kept(state, "power")
            dropped(before)
        dropped(moves)
    rows = state.selectExpr(f"stack({len(group)}, {', '.join(f'{s}L, {c}' for s, c in zip(group, names, strict=True))}) AS (source, ppr)", "node")
    if back is not None:
        # what dead ends gave back in the last round belongs to the source
        rows = rows.selectExpr("source", f"CASE WHEN node = {back}L THEN source ELSE node END AS node", "ppr").groupBy("source", "node").agg(F.sum("ppr").alias("ppr"))
    return rows.where("ppr > 0").select("source", "node", "ppr")
