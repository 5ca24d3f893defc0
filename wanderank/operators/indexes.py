"""Stored walks: the index of every node, and the oracles of hubs."""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.params import Params
from ..report import counted, phase
from ..session import kept, sized
from ..sources.graphs import Graph
from .estimators import all_targets, from_both_sides, montecarlo, origins
from .intask import walk_sums
from .push import push, unit_state
from .walks import LOCAL_EDGES, UNROLL, _stepped, destinations, fan_out, walk_length, walked

#: Levels of the stored backward pushes; a residual there is at most 1 / alpha.
LEVELS = (0.05, 0.25, 1.0, 5.0)


def build_index(graph: Graph, p: Params, seed: int = 1) -> DataFrame:
    """(start, walk, dest, held): the walks that push-and-walk will want of each node; dest is null where a walk was absorbed."""
    sizes = graph.nodes.select(F.col("node").alias("start"), p.index_size(F.col("out_deg")).alias("held"))
    rows = fan_out(sizes, F.col("held")).select("start", "walk", "held")
    found = walked(rows, graph, p.alpha, seed, zero_hop=not p.opt, dangling="absorb")
    return rows.join(found, ["start", "walk"], "left").select("start", "walk", "dest", "held")


def index_path(folder: str, p: Params) -> str:
    """Variants of the index must not be mixed: the name tells the one-hop form and a scale other than 1."""
    scale = "" if p.rmax_scale == 1 else f".scale-{p.rmax_scale:g}"
    return f"{folder}/walk-index{'.onehop' if p.opt else ''}{scale}.parquet"


def save_index(index: DataFrame, folder: str, p: Params) -> str:
    """Sorted by start within files, so that a lookup of few nodes skips row groups."""
    path = index_path(folder, p)
    index.repartitionByRange("start").sortWithinPartitions("start", "walk").write.mode("overwrite").parquet(path)
    return path


def load_index(spark: SparkSession, folder: str, p: Params) -> DataFrame:
    return spark.read.parquet(index_path(folder, p))


# ---- hubs ---------------------------------------------------------------------------------------------------------


@dataclass
class Hubs:
    """Hubs (hub), their stored walks (hub, block, dest, cnt) and their stored backward pushes; these are null where there are none."""

    hubs: DataFrame
    forward: DataFrame
    backward: DataFrame | None
    blocks: int


def choose_hubs(graph: Graph, h: int) -> DataFrame:
    """(hub): the h nodes with the most edges in and out, ties by node."""
    return graph.nodes.orderBy((F.col("in_deg") * F.col("out_deg")).desc(), "node").limit(h).select(F.col("node").alias("hub"))


def forward_oracle(graph: Graph, hubs: DataFrame, blocks: int, p: Params, seed: int = 1) -> DataFrame:
    """(hub, block, dest, cnt): 2^block walks in each block, so that any number below 2^blocks is a sum of blocks."""
    rows = fan_out(hubs.select(F.col("hub").alias("start")), F.lit((1 << blocks) - 1))
    found = walked(rows, graph, p.alpha, seed, dangling="absorb")
    block = F.floor(F.log2(F.col("walk").cast("double")) + 1e-9).cast("int")
    return found.groupBy(F.col("start").alias("hub"), block.alias("block"), "dest").agg(F.count(F.lit(1)).alias("cnt"))


def oracle_sizes(oracle: DataFrame) -> DataFrame:
    """(hub, size, full): stored walks, and the largest number below the top power of two in it."""
    sizes = oracle.groupBy("hub").agg(F.sum("cnt").alias("size"))
    return sizes.withColumn("full", (F.pow(F.lit(2.0), F.floor(F.log2(F.col("size").cast("double")))) - 1).cast("bigint"))


def expanded(quotas: DataFrame, oracle: DataFrame) -> DataFrame:
    """(source, dest, cnt) of ``quotas`` (source, hub, walks): the blocks whose bits are set in the number of walks."""
    bit = F.expr("(shiftright(walks, block) & 1) = 1")
    return quotas.join(oracle, "hub").where(bit).groupBy("source", "dest").agg(F.sum("cnt").alias("cnt"))


def _hub_neighbours(graph: Graph, hubs: Hubs) -> DataFrame:
    """The numbered out-edges, with a mark where they lead to a hub."""
    known = graph._made.get("hub-neighbours")
    if known is None or known[0] is not hubs:
        mark = hubs.hubs.select(F.col("hub").alias("dst"), F.lit(True).alias("dst_hub"))
        table = graph.neighbours.join(mark, "dst", "left").withColumn("dst_hub", F.coalesce("dst_hub", F.lit(False)))
        known = graph._made["hub-neighbours"] = (hubs, kept(table, "hub-neighbours"))
    return known[1]


def _online_hub_walks(graph: Graph, starts: DataFrame, number: Column, first: int, split: bool, hubs: Hubs, n: int, p: Params, seed: int) -> tuple[list, list]:
    """(start, dest, cnt) of walks that ended on the way, and (source, hub, all) of those that came to a hub, in parts; step by step."""
    spark = graph.nodes.sparkSession
    deg = graph.nodes.select(F.col("node").alias("start"), F.col("out_deg").alias("deg"))
    rows = fan_out(starts, number, F.lit(first - 1)).join(deg, "start")
    length = walk_length(seed, F.col("start"), F.col("walk"), p.alpha) + F.when(F.col("is_hub"), 0).otherwise(int(split))
    alive = rows.select(
        "start",
        "walk",
        F.col("start").alias("cur"),
        "deg",
        F.lit(0).alias("step"),
        length.alias("len"),
        F.col("deg").alias("home"),
        F.col("is_hub").alias("hub"),
    )
    ended, arrived = [], []
    with phase("rand-walks"), sized(spark, n * starts.count()):
        while True:
            # arriving at a hub hands the walk over, before it is decided whether it stops there
            for _ in range(UNROLL):
                alive = _stepped(alive, _hub_neighbours(graph, hubs), seed, "absorb", hubs=True)
            at = kept(alive, "hub-walks")
            ended.append(at.where("not hub and step >= len").groupBy("start", F.col("cur").alias("dest")).agg(F.count(F.lit(1)).alias("cnt")))
            arrived.append(at.where("hub").groupBy(F.col("start").alias("source"), F.col("cur").alias("hub")).agg(F.count(F.lit(1)).alias("all")))
            alive = at.where("not hub and step < len")
            if alive.isEmpty():
                break
    return ended, arrived


def _online_rest(graph: Graph, counts: DataFrame, most: int, p: Params, seed: int) -> DataFrame:
    """(start, dest, cnt) of the walks beyond a hub's stored ones, shared by all sources."""
    need = counts.where("more > 0").groupBy(F.col("hub").alias("start")).agg(F.max("more").alias("n"))
    online = walked(fan_out(need, F.col("n") + most, F.lit(most)).select("start", "walk"), graph, p.alpha, seed, dangling="absorb").alias("w")
    return counts.alias("c").join(
        online,
        (F.col("c.hub") == F.col("w.start")) & (F.col("w.walk") <= F.col("c.more") + most),
    ).groupBy(F.col("c.source").alias("start"), F.col("w.dest").alias("dest")).agg(F.count(F.lit(1)).alias("cnt"))


def hub_walks(graph: Graph, sources: DataFrame, n: int, hubs: Hubs, p: Params, seed: int = 1, first: int = 1, split: bool = False) -> DataFrame:
    """(start, dest, cnt) of walks ``first`` to ``first + n - 1`` from each source; at a hub the rest comes from its stored walks.

    Arrivals beyond a hub's stored walks go on online, as walks of the hub with numbers beyond the stored ones.
    ``split``: alpha n of the walks of a source that is no hub end at it for certain and are not drawn; the others make a
    first hop and count a little less than one each, so that they are (1 - alpha) n in all.
    """
    mark = hubs.hubs.select(F.col("hub").alias("cur"), F.lit(True).alias("at_hub"))
    starts = origins(sources).select(F.col("origin").alias("start"))
    moving = math.ceil((1 - p.alpha) * n) if split else n
    weight = (1 - p.alpha) * n / moving if split else 1.0
    starts = starts.join(
        mark.select(F.col("cur").alias("start"), F.col("at_hub").alias("is_hub")),
        "start",
        "left",
    ).withColumn("is_hub", F.coalesce("is_hub", F.lit(False)))
    starts = kept(starts, "hub-starts")
    number = F.lit(first - 1) + F.when(F.col("is_hub"), F.lit(n)).otherwise(F.lit(moving))
    counted(walks=lambda: n * starts.count())
    local = graph.distinct <= LOCAL_EDGES
    if local:
        plan = starts.select(
            F.col("start").alias("source"), "start", F.lit(first - 1).cast("bigint").alias("first"), (number - (first - 1)).cast("bigint").alias("n"), F.lit(1.0).alias("weight"),
            F.when(F.col("is_hub"), 0).otherwise(int(split)).alias("longer"),
        )
        with phase("rand-walks"):
            sums = kept(walk_sums(graph, plan, p.alpha, seed, hubs=tuple(r[0] for r in hubs.hubs.collect())), "hub-walks").withColumn("total", F.col("total").cast("bigint"))
        ended = [sums.where("not hub").select(F.col("source").alias("start"), F.col("node").alias("dest"), F.col("total").alias("cnt"))]
        arrived = [sums.where("hub").select("source", F.col("node").alias("hub"), F.col("total").alias("all"))]
    else:
        ended, arrived = _online_hub_walks(graph, starts, number, first, split, hubs, n, p, seed)
    most = (1 << hubs.blocks) - 1
    counts = functools.reduce(DataFrame.unionByName, arrived).groupBy("source", "hub").agg(F.sum("all").alias("all"))
    counts = kept(
        counts.select("source", "hub", F.least("all", F.lit(most)).alias("walks"), F.greatest(F.col("all") - most, F.lit(0)).alias("more")),
        "hub-counts",
    )
    counted(index_walks=lambda: counts.agg(F.coalesce(F.sum("walks"), F.lit(0))).first()[0])
    stored = expanded(counts, hubs.forward).select(F.col("source").alias("start"), "dest", "cnt")
    if local:
        more = counts.where("more > 0").select("source", F.col("hub").alias("start"), F.lit(most).cast("bigint").alias("first"), F.col("more").alias("n"), F.lit(1.0).alias("weight"), F.lit(0).alias("longer"))
        rest = walk_sums(graph, more, p.alpha, seed).select(F.col("source").alias("start"), F.col("node").alias("dest"), F.col("total").cast("bigint").alias("cnt"))
    else:
        rest = _online_rest(graph, counts, most, p, seed)
    parts = functools.reduce(DataFrame.unionByName, ended).unionByName(stored).unionByName(rest)
    if not split:
        return parts.groupBy("start", "dest").agg(F.sum("cnt").alias("cnt"))
    parts = parts.join(starts, "start").select("start", "dest", (F.col("cnt") * F.when(F.col("is_hub"), 1.0).otherwise(weight)).alias("cnt"))
    stay = starts.where("not is_hub").select("start", F.col("start").alias("dest"), F.lit(p.alpha * n).alias("cnt"))
    return parts.unionByName(stay).groupBy("start", "dest").agg(F.sum("cnt").alias("cnt"))


def backward_oracle(graph: Graph, hubs: DataFrame, p: Params, rmax: float) -> DataFrame:
    """(src, dst, rsv, res, lvl): stored backward pushes from each hub at each level, per unit of residual."""
    spark = graph.nodes.sparkSession
    # a push of its own for each hub and level, all of them side by side
    tags = [(i, r[0], level) for i, (r, level) in enumerate(itertools.product(hubs.collect(), LEVELS))]
    tags = F.broadcast(spark.createDataFrame(tags, "origin bigint, src bigint, lvl double"))
    start = tags.select("origin", F.col("src").alias("node"), F.lit(0.0).alias("reserve"), F.col("lvl").alias("residual"))
    state = push(start, graph.backward(p.alpha), rmax, strict=True)
    out = state.join(tags, "origin").select("src", F.col("node").alias("dst"), (F.col("reserve") / F.col("lvl")).alias("rsv"), (F.col("residual") / F.col("lvl")).alias("res"), "lvl")
    return kept(out, "backward-oracle")


def build_hubs(graph: Graph, p: Params, h: int = 16, blocks: int = 8, seed: int = 1) -> Hubs:
    """The oracles of the h best hubs, written to the shared folder."""
    hubs = kept(choose_hubs(graph, h), "hubs")
    rmax, _ = p.bidirectional()
    return Hubs(hubs, kept(forward_oracle(graph, hubs, blocks, p, seed), "hub-oracle"), None if rmax >= 1 else backward_oracle(graph, hubs, p, rmax), blocks)


def hub_path(folder: str, p: Params, h: int) -> str:
    """Oracles of other accuracy or number of hubs must not be mixed."""
    return f"{folder}/hub-oracle.eps-{p.epsilon:g}.hubs-{h}"


def save_hubs(hubs: Hubs, folder: str, p: Params, h: int) -> str:
    path = hub_path(folder, p, h)
    hubs.hubs.withColumn("blocks", F.lit(hubs.blocks)).write.mode("overwrite").parquet(f"{path}/hubs.parquet")
    hubs.forward.repartitionByRange("hub").sortWithinPartitions("hub", "block").write.mode("overwrite").parquet(f"{path}/forward.parquet")
    if hubs.backward is not None:
        hubs.backward.write.mode("overwrite").parquet(f"{path}/backward.parquet")
    return path


def load_hubs(spark: SparkSession, folder: str, p: Params, h: int) -> Hubs:
    """Stored oracles; without the backward part, targets are pushed without it. A missing forward part raises Spark's own error."""
    path = hub_path(folder, p, h)
    forward, hubs = spark.read.parquet(f"{path}/forward.parquet"), spark.read.parquet(f"{path}/hubs.parquet")
    try:
        backward = spark.read.parquet(f"{path}/backward.parquet")
    except AnalysisException:
        backward = None
    return Hubs(hubs.select("hub"), forward, backward, hubs.agg(F.max("blocks")).first()[0])


def hub_all_targets(graph: Graph, hubs: Hubs, p: Params, rmax: float) -> DataFrame:
    """Backward states of all targets, a hub's push being its stored one of the smallest level that is enough."""
    if hubs.backward is None:
        return all_targets(graph, p, rmax)
    moves, hub = graph.backward(p.alpha), hubs.hubs.select(F.col("hub").alias("src"))
    plain = moves.join(hub, "src", "left_anti")
    # a hub's own row only keeps: what its stored push leaves there comes with the stored rows
    own = moves.where("own").join(hub, "src").withColumn("rsv", F.lit(0.0))
    rows = hubs.backward.select("src", "dst", F.lit(False).alias("own"), "rsv", "res", "lvl", F.lit(1.0).alias("deg"))
    moves = kept(plain.unionByName(own).unionByName(rows), "hub-moves")
    return push(unit_state(graph.nodes.select(F.col("node").alias("origin"))), moves, rmax, strict=True, levels=LEVELS)


def hub_ppr(graph: Graph, sources: DataFrame, p: Params, hubs: Hubs | None = None, seed: int = 1) -> DataFrame:
    """The bidirectional estimate with the oracles of hubs on both sides."""
    rmax, omega = p.bidirectional()
    if rmax >= 1:
        return montecarlo(graph, sources, p, seed)
    hubs = build_hubs(graph, p, seed=seed) if hubs is None else hubs
    n = math.ceil(omega)
    return from_both_sides(hub_walks(graph, sources, n, hubs, p, seed), hub_all_targets(graph, hubs, p, rmax), n)


__all__ = [
    "Hubs",
    "backward_oracle",
    "build_hubs",
    "build_index",
    "choose_hubs",
    "destinations",
    "expanded",
    "forward_oracle",
    "hub_all_targets",
    "hub_ppr",
    "hub_walks",
    "load_hubs",
    "load_index",
    "oracle_sizes",
    "save_hubs",
    "save_index",
]
