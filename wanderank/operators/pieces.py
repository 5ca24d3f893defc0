"""Walks of a graph that is too large for ``walks._Net`` but fits a worker as sorted arrays, at about 5 bytes an edge.

The edges are cut in order of (src, dst) into pieces. A task gets all pieces as they are, and a share of the walks; ids are
looked up for the nodes that walks come to, never for all edges. Draws are those of ``walks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import kept, settings
from ..sources.graphs import Graph, narrow, unpacked
from .intask import draws

#: Distinct edges that a worker holds in this form.
PIECES_EDGES = 80_000_000
#: Edges of a piece at most and of a partition about, and rows that are sent to a worker at once.
PIECE, PARTITION, ROWS = 1 << 18, 1 << 20, 32


def pieces(graph: Graph) -> DataFrame:
    """(src, deg, dst, cnt) binary: a piece's sources with the number of their edges in it, and its edges in order of (src, dst)."""
    if "pieces" not in graph._made:
        parts = graph.distinct // PARTITION + 1
        edges = graph.edges.select("src", "dst", "cnt").repartitionByRange(parts, "src", "dst")
        graph._made["pieces"] = kept(edges.mapInArrow(_cut, "src binary, deg binary, dst binary, cnt binary"), "pieces")
    return graph._made["pieces"]


def _bytes(values: np.ndarray) -> bytes:
    values = narrow(values)
    values = values.astype(np.uint8) if len(values) and 0 <= values.min() and values.max() < 256 else values
    return bytes([values.itemsize]) + values.tobytes()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [[b.column(c).to_numpy() for c in range(3)] for b in batches if b.num_rows]
    if not held:
        return
    src, dst, cnt = (np.concatenate(c) for c in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((dst, src))
    src, dst, cnt = src[order], dst[order], cnt[order]
    for lo in range(0, len(src), PIECE):
        s, d, c = src[lo : lo + PIECE], dst[lo : lo + PIECE], cnt[lo : lo + PIECE]
        ids, first = np.unique(s, return_index=True)
        columns = [ids, np.add.reduceat(c, first), d, c]
        yield pa.RecordBatch.from_arrays([pa.array([_bytes(x)], pa.binary()) for x in columns], ["src", "deg", "dst", "cnt"])


class Pieces:
    """The pieces of a graph, in any order."""

    def __init__(self, rows: list[list[np.ndarray]]):
        rows.sort(key=lambda r: (int(r[0][0]), int(r[2][0])))
        self.dst, self.cnt = [r[2] for r in rows], [r[3] for r in rows]
        none = [np.zeros(0, np.int64)]
        self.ids, place = np.unique(np.concatenate(none + [r[0].astype(np.int64) for r in rows]), return_inverse=True)
        self.deg = np.bincount(place, weights=np.concatenate(none + [r[1] for r in rows]), minlength=len(self.ids)).astype(np.int64)
        self.base = np.cumsum(self.deg) - self.deg
        size = np.array([int(r[1].sum(dtype=np.int64)) for r in rows], np.int64)
        self.start = np.cumsum(size) - size

    def ends(self, spot: np.ndarray) -> np.ndarray:
        """Where the edges of these numbers lead; parallel edges have a number each."""
        piece, out = np.searchsorted(self.start, spot, side="right") - 1, np.empty(len(spot), np.int64)
        order = np.argsort(piece, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(piece[order])) + 1):
            if len(some):
                i = int(piece[some[0]])
                at = spot[some] - self.start[i]
                if len(self.dst[i]) != (self.start[i + 1] if i + 1 < len(self.start) else self.deg.sum()) - self.start[i]:
                    at = np.searchsorted(np.cumsum(self.cnt[i], dtype=np.int64), at, side="right")
                out[some] = self.dst[i][at]
        return out

    def walked(self, start: np.ndarray, walk: np.ndarray, length: np.ndarray, seed: int, absorb: bool) -> pa.RecordBatch:
        cur, gone = start.copy(), np.zeros(len(start), bool)
        alive, step = np.flatnonzero(length > 0), 0
        while len(alive):
            at = np.searchsorted(self.ids, cur[alive])
            goes = at < len(self.ids)
            goes[goes] = self.ids[at[goes]] == cur[alive][goes]
            moving, stuck, at = alive[goes], alive[~goes], at[goes]
            cur[moving] = self.ends(self.base[at] + draws(seed, start[moving], walk[moving], b":%d:next" % step) % self.deg[at])
            if absorb:
                gone[stuck] = True
            else:
                cur[stuck] = start[stuck]
            step += 1
            alive = alive[~gone[alive] & (length[alive] > step)]
        return pa.RecordBatch.from_arrays([pa.array(c[~gone]) for c in (start, walk, cur)], ["start", "walk", "dest"])


def walked_over_pieces(alive: DataFrame, graph: Graph, seed: int, dangling: str, parts: int) -> DataFrame:
    """(start, walk, dest) of walks (start, walk, len), written; those that are absorbed have no row."""
    none, names = F.lit(None), ("src", "deg", "dst", "cnt")
    edges = pieces(graph).select(*names, *[none.cast("bigint").alias(c) for c in "abc"], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    walks = alive.select(
        *[none.cast("binary").alias(c) for c in names], *[F.col(c).cast("bigint").alias(k) for c, k in (("start", "a"), ("walk", "b"), ("len", "c"))],
        F.pmod(F.hash("start", "walk"), F.lit(parts)).alias("part"),
    )

    def ran(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, given = [], []
        for batch in batches:
            edge = batch.column("src").is_valid().to_numpy(zero_copy_only=False)
            rows += [[unpacked(batch.column(c)[int(i)]) for c in names] for i in np.flatnonzero(edge)]
            if not edge.all():
                given.append([batch.column(c).fill_null(0).to_numpy()[~edge] for c in "abc"])
        if given:
            start, walk, length = (np.concatenate(c) for c in zip(*given, strict=True))
            yield Pieces(rows).walked(start, walk, length, seed, dangling == "absorb")

    # a piece has up to 1 MB and more
    with settings(alive.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(ROWS)}):
        return kept(edges.unionByName(walks).repartitionById(parts, "part").drop("part").mapInArrow(ran, "start bigint, walk bigint, dest bigint"), "walks")
