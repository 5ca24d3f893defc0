"""Walks and pushes of a graph whose edges fit a worker: each task holds all edges in numpy and does its share of the work whole.

Walks are drawn as in ``walks``, by MD5 of (seed, start, walk number, step), here of many walks at once. A task gets ranges of walk
numbers, makes the walks and sends out sums by destination, so that no row per walk is written or exchanged. Walks of a node that
several sources use are made once.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept
from ..sources.graphs import Graph, unpacked
from .gather import Gather, dense, in_order

#: Walk numbers that a node's range is cut into, walks that a task makes at once, and draws at once (so that they stay in the cache).
BLOCK, BATCH, DRAWS = 1 << 16, 1 << 18, 1 << 15

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


# ---- draws --------------------------------------------------------------------------------------------------------------


def _digits(values: np.ndarray) -> np.ndarray:
    """How many characters the numbers have in decimals, a sign included."""
    size = np.abs(values)
    out = np.ones(len(values), np.int64) + (values < 0)
    for k in range(1, 19):
        more = size >= 10**k
        if not more.any():
            break
        out += more
    return out


def _md5_first(words: list, n: int) -> np.ndarray:
    """The first 4 bytes, as a big-endian number, of the MD5 of messages of one block; ``words``: 16 of them, each a number or an array."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    t, r = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            np.bitwise_and(t, b, out=t)
            np.bitwise_xor(t, d, out=t)
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_and(t, d, out=t)
            np.bitwise_xor(t, c, out=t)
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            np.bitwise_xor(t, d, out=t)
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, out=t)
            np.bitwise_or(t, b, out=t)
            np.bitwise_xor(t, c, out=t)
            g = 7 * i % 16
        np.add(t, a, out=t)
        word = words[g]
        if isinstance(word, np.ndarray):
            np.add(t, word, out=t)
            word = 0
        np.add(t, np.uint32((_SINES[i] + word) & 0xFFFFFFFF), out=t)
        s = _SHIFTS[i // 16][i % 4]
        np.right_shift(t, np.uint32(32 - s), out=r)
        np.left_shift(t, np.uint32(s), out=t)
        np.bitwise_or(t, r, out=t)
        np.add(t, b, out=a)
        a, b, c, d = d, a, b, c
    a += np.uint32(_START[0])
    return a.byteswap().astype(np.int64)


def draws(seed: int, start: np.ndarray, walk: np.ndarray, end: bytes) -> np.ndarray:
    """``draw_number(seed, start, walk, *end)`` of each pair of numbers; ``end`` is what follows the walk's number, with its colons."""
    out = np.empty(len(start), np.int64)
    layout = _digits(start) * 32 + _digits(walk)
    for kind in np.unique(layout):
        at = np.flatnonzero(layout == kind)
        for lo in range(0, len(at), DRAWS):
            some = at[lo : lo + DRAWS]
            out[some] = _drawn(seed, start[some], walk[some], int(kind) // 32, int(kind) % 32, end)
    return out


def _drawn(seed: int, start: np.ndarray, walk: np.ndarray, a: int, b: int, end: bytes) -> np.ndarray:
    head = b"%d:" % seed
    size = len(head) + a + 1 + b + len(end)
    if size > 55:
        raise ValueError("a draw's text is longer than one block")
    fixed = bytearray(64)
    text = head + b"\0" * a + b":" + b"\0" * b + end + b"\x80"
    fixed[: len(text)] = text
    fixed[56:60] = (size * 8).to_bytes(4, "little")
    words: list = [int.from_bytes(fixed[4 * i : 4 * i + 4], "little") for i in range(16)]
    for values, first, count in ((start, len(head), a), (walk, len(head) + a + 1, b)):
        left = np.abs(values)
        for place in range(first + count - 1, first - 1, -1):
            if place == first and (values < 0).any():  # of one layout with longer numbers above zero
                digit = np.where(values < 0, ord("-") - 48, left)
            elif place == first:
                digit = left
            else:
                up = left // 10
                digit, left = left - up * 10, up
            part = (digit + 48).astype(np.uint32) << np.uint32(8 * (place % 4))
            i = place // 4
            words[i] = part | np.uint32(words[i]) if not isinstance(words[i], np.ndarray) else words[i] | part
    return _md5_first(words, len(start))


# ---- a task's graph --------------------------------------------------------------------------------------------------------


class Net:
    """A graph's out-edges in order of (src, dst); ``more``: ids that may have no edge."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cnt: np.ndarray, more: np.ndarray, hubs: tuple[int, ...] = ()):
        self.ids, src, dst = dense(src, dst, more)
        self.n = n = len(self.ids)
        #: Whether no edge has a parallel one; the counts are left out then.
        self.single = not len(cnt) or int(cnt.max()) == 1
        self.src, self.dst, self.cnt = in_order(src, dst, None if self.single else cnt, n)
        self.deg = np.bincount(self.src, weights=self.cnt, minlength=n).astype(np.int64)
        self.base = np.cumsum(self.deg) - self.deg
        self.hub = np.isin(self.ids, np.array(hubs, np.int64))

    @functools.cached_property
    def upto(self) -> np.ndarray:
        """The sums of parallel edges up to each edge."""
        return np.arange(1, len(self.src) + 1) if self.single else np.cumsum(self.cnt, dtype=np.int64)

    def at(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def push(self, reserve: np.ndarray, residual: np.ndarray, alpha: float, rmax: float, back: int | None = None) -> None:
        """Synchronous rounds until nothing is due, as ``push`` makes them; both arrays are changed in place.

        A dead end's rest goes to ``back`` (a place), or vanishes where that is None.
        """
        if not hasattr(self, "first"):
            self.first = np.searchsorted(self.src, np.arange(self.n + 1))
        share = (1 - alpha) / np.maximum(self.deg, 1)
        least = self.deg * rmax
        while True:
            due = np.flatnonzero((residual > 0) & (np.round(residual, 12) >= least))
            if not len(due):
                return
            mass = residual[due]
            reserve[due] += alpha * mass
            residual[due] = 0.0
            lo, size = self.first[due], self.first[due + 1] - self.first[due]
            if size.sum() > len(self.src) // 4:
                given = np.zeros(self.n)
                given[due] = mass * share[due]
                if not hasattr(self, "moved"):
                    self.moved = Gather(self.src, self.dst, self.cnt, self.n)
                residual += self.moved.sums(given)
            else:
                edge = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
                given = np.repeat(mass * share[due], size)
                if not self.single:
                    given *= self.cnt[edge]
                residual += np.bincount(self.dst[edge], weights=given, minlength=self.n)
            if back is not None:
                residual[back] += (1 - alpha) * mass[self.deg[due] == 0].sum()

    def walked(self, start: np.ndarray, walk: np.ndarray, seed: int, alpha: float, zero_hop: bool, absorb: bool, longer: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(dest, hub) of each walk from ``start`` (places): -1 where it was absorbed; whether it came to rest at a hub, or starts there."""
        ids = self.ids[start]
        u = (draws(seed, ids, walk, b":stop") + 1) / float(1 << 32)
        length = np.floor(np.log(u) / math.log(1 - alpha)).astype(np.int64) + (0 if zero_hop else 1) + longer
        if not absorb:
            length[self.deg[start] == 0] = 0
        cur, rests = start.astype(np.int64), self.hub[start].copy()
        alive, step = np.flatnonzero(~rests & (length > 0)), 0
        while len(alive):
            deg = self.deg[cur[alive]]
            moving, stuck, deg = alive[deg > 0], alive[deg == 0], deg[deg > 0]
            spot = self.base[cur[moving]] + draws(seed, ids[moving], walk[moving], b":%d:next" % step) % deg
            cur[moving] = self.dst[spot if self.single else np.searchsorted(self.upto, spot, side="right")]
            rests[moving] = self.hub[cur[moving]]
            if absorb:
                cur[stuck] = -1
            else:
                cur[stuck] = start[stuck]
            step += 1
            alive = alive[(cur[alive] >= 0) & ~rests[alive] & (length[alive] > step)]
        return cur, rests


    def sums(self, start: np.ndarray, first: np.ndarray, count: np.ndarray, weight: np.ndarray, seed: int, alpha: float) -> np.ndarray:
        """By node, the weights of the walks first + 1 to first + count of each start that end there; dead ends absorb."""
        out, upto = np.zeros(self.n), np.cumsum(count)
        for lo in range(0, int(upto[-1]) if len(upto) else 0, BATCH):
            number = np.arange(lo, min(lo + BATCH, upto[-1]))
            row = np.searchsorted(upto, number, side="right")
            dest, _ = self.walked(start[row], first[row] + number - (upto - count)[row] + 1, seed, alpha, True, True)
            left = dest >= 0
            out += np.bincount(dest[left], weights=weight[row][left], minlength=self.n)
        return out


def in_tasks(graph: Graph, work: DataFrame, parts: int, run: Callable[[Net, dict], Iterator[pa.RecordBatch]], schema: str, hubs: tuple[int, ...] = ()) -> DataFrame:
    """``run`` with the graph and a task's rows of ``work`` (part, a, b, c, d bigint, x, y double), in columns; a and b name nodes, where they are not null."""
    long, names = lambda c: F.col(c).cast("bigint").alias(c), [*"abcdxy", "src", "dst", "cnt"]
    work = work.select(*[long(c) for c in "abcd"], *[F.col(c).cast("double").alias(c) for c in "xy"], F.col("part").cast("int").alias("part"))
    rows = graph.beside(kept(work, "work"), parts).select(*names, "part")

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, given = [], []
        for batch in batches:
            at = batch.column("src").is_valid().to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(at):
                edges.append([unpacked(batch.column(c)[int(i)]) for c in ("src", "dst", "cnt")])
            at = ~at & batch.column("part").is_valid().to_numpy(zero_copy_only=False)
            if at.any():
                abcd = [batch.column(c).fill_null(0).to_numpy() for c in "abcd"]
                given.append([c[at] for c in abcd + [batch.column(c).fill_null(0.0).to_numpy() for c in "xy"]])
            del batch
        if not given:
            return
        mine = dict(zip("abcdxy", (np.concatenate(c) for c in zip(*given, strict=True)), strict=True))
        src, dst, cnt = (np.concatenate(c) for c in zip(*edges, strict=True)) if edges else (np.zeros(0, np.int64),) * 3
        edges.clear()
        given.clear()
        net = Net(src, dst, cnt, np.concatenate([mine["a"], mine["b"]]), hubs)
        del src, dst, cnt
        yield from run(net, mine)

    return rows.mapInArrow(ran, schema)


def tasks_of(graph: Graph) -> int:
    return max(1, graph.edges.sparkSession.sparkContext.defaultParallelism)


def dealt(state: DataFrame, most: int) -> tuple[DataFrame, int]:
    """(origin, part) and the number of parts, ``most`` at most: the origins in turn to the tasks, so that none gets many more than others."""
    ids = sorted(r[0] for r in state.select("origin").distinct().collect())
    parts = max(1, min(most, len(ids)))
    return F.broadcast(state.sparkSession.createDataFrame([(o, i % parts) for i, o in enumerate(ids)], "origin bigint, part int")), parts


def batches_of(names: list[str], columns: list[np.ndarray], size: int = 100_000) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), size):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + size]) for c in columns], names)


def _flat(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """lo, lo + 1, ... of each range, one after the other."""
    return np.repeat(lo - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


# ---- walks ---------------------------------------------------------------------------------------------------------------


def walk_sums(graph: Graph, plan: DataFrame, alpha: float, seed: int, zero_hop: bool = True, dangling: str = "absorb", hubs: tuple[int, ...] = ()) -> DataFrame:
    """(source, node, hub, total): the weights of the walks that end at a node, summed up in each task; those at rest at a hub apart.

    ``plan``: (source, start, first, n, weight, longer): walks first + 1 to first + n of a start, ``longer`` by so many hops. Numbers are
    cut into blocks, which are dealt over the tasks; sources that use a block of a start share its walks.
    """
    parts, absorb = tasks_of(graph), dangling == "absorb"
    rows = plan.where("n > 0").withColumn("__b", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + n - 1) div {BLOCK})")))
    work = rows.select(
        F.col("source").alias("a"), F.col("start").alias("b"), F.expr(f"greatest(first, __b * {BLOCK})").alias("c"), F.expr(f"least(first + n, (__b + 1) * {BLOCK})").alias("d"),
        F.col("weight").alias("x"), F.col("longer").alias("y"), F.pmod(F.hash("start", "__b"), F.lit(parts)).alias("part"),
    )

    def run(net: Net, mine: dict) -> Iterator[pa.RecordBatch]:
        sources, who = np.unique(mine["a"], return_inverse=True)
        sums = np.zeros((len(sources), 2 * net.n))
        # walks of one start, block and added length stand together
        block, longer = mine["c"] // BLOCK, mine["y"].astype(np.int64)
        order = np.lexsort((longer, block, mine["b"]))
        who, start, block, longer, lo, hi, weight = (c[order] for c in (who, net.at(mine["b"]), block, longer, mine["c"], mine["d"], mine["x"]))
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] != start[:-1]) | (block[1:] != block[:-1]) | (longer[1:] != longer[:-1])
        group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        least, most = np.minimum.reduceat(lo, heads), np.maximum.reduceat(hi, heads)
        size = most - least
        begin = 0
        while begin < len(heads):
            stop = begin + max(1, int(np.searchsorted(np.cumsum(size[begin:]), BATCH, side="right")))
            here = slice(heads[begin], heads[stop] if stop < len(heads) else len(start))
            walk = _flat(least[begin:stop] + 1, size[begin:stop])
            first = np.repeat(start[heads[begin:stop]], size[begin:stop])
            dest, rests = net.walked(first, walk, seed, alpha, zero_hop, absorb, np.repeat(longer[heads[begin:stop]], size[begin:stop]))
            offset = np.cumsum(size[begin:stop]) - size[begin:stop]
            dest = np.where(dest >= 0, dest + net.n * rests, -1)
            at = group[here] - begin
            for s in np.unique(who[here]):
                of = who[here] == s
                count = (hi[here] - lo[here])[of]
                ends = dest[_flat(offset[at[of]] + lo[here][of] - least[begin:stop][at[of]], count)]
                given = np.repeat(weight[here][of], count)
                left = ends >= 0
                sums[s] += np.bincount(ends[left], weights=given[left], minlength=2 * net.n)
            begin = stop
        for s, source in enumerate(sources):
            met = np.flatnonzero(sums[s])
            yield from batches_of(["source", "node", "hub", "total"], [np.full(len(met), source), net.ids[met % net.n], met >= net.n, sums[s][met]])

    return in_tasks(graph, work, parts, run, "source bigint, node bigint, hub boolean, total double", hubs)


# ---- push ----------------------------------------------------------------------------------------------------------------


def pushed(graph: Graph, state: DataFrame, alpha: float, rmax: float, dangling: str = "absorb") -> DataFrame:
    """(origin, node, reserve, residual) after forward rounds until nothing is due; a task has whole origins.

    A dead end's rest vanishes, or goes to the origin with ``dangling`` "source".
    """
    (places, parts), none = dealt(state, tasks_of(graph)), F.lit(None)
    work = state.join(places, "origin").select(F.col("origin").alias("a"), F.col("node").alias("b"), none.alias("c"), none.alias("d"), F.col("reserve").alias("x"), F.col("residual").alias("y"), "part")

    def run(net: Net, mine: dict) -> Iterator[pa.RecordBatch]:
        for origin in np.unique(mine["a"]):
            of = mine["a"] == origin
            reserve, residual, held = np.zeros(net.n), np.zeros(net.n), np.zeros(net.n, bool)
            at = net.at(mine["b"][of])
            reserve[at], residual[at], held[at] = mine["x"][of], mine["y"][of], True
            net.push(reserve, residual, alpha, rmax, int(net.at(origin)) if dangling == "source" else None)
            met = np.flatnonzero(held | (reserve > 0) | (residual > 0))
            yield from batches_of(["origin", "node", "reserve", "residual"], [np.full(len(met), origin), net.ids[met], reserve[met], residual[met]])

    return in_tasks(graph, work, parts, run, "origin bigint, node bigint, reserve double, residual double")
