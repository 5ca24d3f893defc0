"""Edges as arrays: dense ids, sorted edges, and weighted sums over the in-edges of every node, in pieces that stay in the cache."""

from __future__ import annotations

import numpy as np

#: Edges of a piece about; a node's in-edges are never cut, so a piece may be longer.
PIECE = 1 << 15
#: Ids that lie in a range of so many times their count, or of ``LEAST_ROOM``, are looked up in a table of the range.
ROOM, LEAST_ROOM = 8, 1 << 16
#: Ids that are looked up at once, so that they need no room as 8 bytes each.
CHUNK = 1 << 18


def dense(src: np.ndarray, dst: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, src, dst): the distinct ids of the edges and of ``more`` in order, and the edges by their places there."""
    held = [c for c in (src, dst, more) if len(c)]
    low, high = min((int(c.min()) for c in held), default=0), max((int(c.max()) for c in held), default=-1)
    if high - low >= max(LEAST_ROOM, ROOM * sum(map(len, held))):
        ids = np.unique(np.concatenate([np.unique(c).astype(np.int64) for c in held]))
        return ids, np.searchsorted(ids, src).astype(np.int32), np.searchsorted(ids, dst).astype(np.int32)
    met = np.zeros(high - low + 1, bool)
    for c in held:
        for lo in range(0, len(c), CHUNK):
            met[np.subtract(c[lo : lo + CHUNK], low, dtype=np.int64)] = True
    place = np.cumsum(met, dtype=np.int32) - np.int32(1)

    def placed(values: np.ndarray) -> np.ndarray:
        out = np.empty(len(values), np.int32)
        for lo in range(0, len(values), CHUNK):
            np.take(place, np.subtract(values[lo : lo + CHUNK], low, dtype=np.int64), out=out[lo : lo + CHUNK], mode="clip")
        return out

    return np.flatnonzero(met) + low, placed(src), placed(dst)


def in_order(first: np.ndarray, second: np.ndarray, count: np.ndarray | None, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """The rows in order of (first, second), both in 0 to n - 1; ``count`` goes along. Whole numbers that fit together into 63 bits are sorted as one."""
    whole = count is None or count.dtype.kind in "iu"
    a, b = max(n - 1, 1).bit_length(), 0 if count is None or not len(count) or not whole else int(count.max()).bit_length()
    if not whole or 2 * a + b > 63 or (b and count.min() < 0):
        order = np.argsort(first.astype(np.int64) * n + second, kind="stable")
        return first[order], second[order], None if count is None else count[order]
    key = first.astype(np.int64)
    key <<= a
    key |= second
    if count is not None:
        key <<= b
        np.bitwise_or(key, count, out=key, casting="unsafe")
    key.sort()

    def lowest(bits: int, kind: np.dtype) -> np.ndarray:
        out = np.bitwise_and(key, (1 << bits) - 1, out=np.empty(len(key), kind), casting="unsafe")
        np.right_shift(key, bits, out=key)
        return out

    count = None if count is None else lowest(b, count.dtype)
    second = lowest(a, np.dtype(np.int32))
    return key.astype(np.int32), second, count


class Gather:
    """Edges in order of (dst, src), whatever order they come in, so that sums don't depend on it; ``n``: number of nodes.

    ``weight`` None stands for a weight of 1 on each edge.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, weight: np.ndarray | None, n: int):
        self.n = n
        dst, self.src, self.weight = in_order(dst, src, weight, n)
        new = np.ones(len(dst), bool)
        new[1:] = dst[1:] != dst[:-1]
        heads = np.flatnonzero(new)
        self.target = dst[heads]
        upto = np.append(heads, len(dst))
        # pieces: from one target's first edge to another's
        self.pieces, at = [], 0
        while at < len(heads):
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + PIECE, side="right")) - 1)
            self.pieces.append((at, to, int(upto[at]), int(upto[to]), heads[at:to] - heads[at]))
            at = to
        self.room = np.empty(max((hi - lo for _, _, lo, hi, _ in self.pieces), default=0))
        self.total = np.empty(len(heads))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By node, the sum of weight times the value at the other end over the edges that lead to it."""
        out = np.zeros(self.n)
        for at, to, lo, hi, first in self.pieces:
            room = np.take(values, self.src[lo:hi], out=self.room[: hi - lo], mode="clip")
            if self.weight is not None:
                room *= self.weight[lo:hi]
            np.add.reduceat(room, first, out=self.total[at:to])
        out[self.target] = self.total
        return out
