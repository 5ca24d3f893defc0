"""Parameters of the estimators as pure functions of the graph's size and the accuracy asked for.

``ln`` is the natural logarithm. A plan is immutable: adaptive loops derive a new one for each delta.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of one walk, online and read from an index, in the cost model (fixed values).
WALK_COST, INDEX_SPEEDUP = 4e-7, 140.0
#: Exponent of the power law that scores are taken to follow, and the k it is scaled for (fixed values).
POWER, POWER_K = 0.77, 500
POWER_ITERATIONS = 100


@dataclass(frozen=True)
class Params:
    """Graph size and accuracy; delta and p_fail default to 1/n."""

    n: int
    m: int
    epsilon: float = 0.5
    alpha: float = 0.2
    delta: float | None = None
    p_fail: float | None = None
    rmax_scale: float = 1.0
    opt: bool = False

    def __post_init__(self):
        if self.n < 1 or self.m < 0:
            raise ValueError("a graph has at least one node")
        if not self.epsilon > 0:
            raise ValueError("epsilon must be positive")
        if not 0 < self.alpha < 1:
            raise ValueError("alpha lies between 0 and 1")
        object.__setattr__(self, "delta", self.delta or 1 / self.n)
        object.__setattr__(self, "p_fail", self.p_fail or 1 / self.n)

    def at(self, **changes) -> Params:
        return replace(self, **changes)

    @property
    def log_fail(self) -> float:
        return math.log(2 / self.p_fail)

    @property
    def edges(self) -> int:
        return max(1, self.m)

    @property
    def mean_degree(self) -> float:
        return self.m / self.n

    def bidirectional(self) -> tuple[float, float]:
        """(rmax, omega) of backward push and walks."""
        rmax = self.epsilon * math.sqrt(self.edges * self.delta / 3 / self.log_fail) * self.rmax_scale
        return rmax, rmax * 3 * self.log_fail / self.delta / self.epsilon**2

    def push_walk(self) -> tuple[float, float]:
        """(rmax, omega) of forward push and walks; the one-hop form pushes less far."""
        rmax = self.epsilon * math.sqrt(self.delta / 3 / self.edges / self.log_fail) * self.rmax_scale
        return rmax / (1 - self.alpha) if self.opt else rmax, self._omega()

    def push_walk_topk(self) -> tuple[float, float]:
        base = self.epsilon * math.sqrt(self.delta / 3 / self.edges / self.log_fail)
        return base * math.sqrt(self.edges * base) * self.rmax_scale * 3, self._omega()

    def _omega(self) -> float:
        return (2 + self.epsilon) * self.log_fail / self.delta / self.epsilon**2

    def montecarlo(self) -> float:
        """omega, the number of walks."""
        return 3 * self.log_fail / self.epsilon**2 / self.delta

    def forward_push(self) -> float:
        """rmax of push alone, which carries no guarantee."""
        return self.rmax_scale * self.delta * self.epsilon * self.n / self.edges

    def topk_threshold(self) -> float:
        """The delta from which on bounds are kept."""
        return (1 - POWER) / POWER_K**POWER / self.n ** (1 - POWER)

    def walk_cost(self, rsum: float, indexed: bool = False) -> float:
        """Seconds that the walks from a residual sum are expected to take."""
        cost = self._omega() * rsum * (1 - self.alpha) * WALK_COST
        return cost / INDEX_SPEEDUP if indexed else cost

    def index_size(self, out_deg: Column) -> Column:
        """Walks that the index holds for a node."""
        rmax, omega = self.push_walk()
        return F.ceil(out_deg * F.lit(rmax) * F.lit(omega) * F.lit(1 - self.alpha if self.opt else 1.0)).cast("bigint")


def lambda_bound(rsum: Column, log_fail: float, upper: Column, walks: Column) -> Column:
    """Deviation of the walks' sum that is exceeded with probability p_fail at most."""
    lf = F.lit(log_fail)
    return lf * rsum / (3.0 * walks) + F.sqrt(F.lit(4.0 / 9.0) * lf * lf * rsum * rsum + 8.0 * walks * lf * rsum * upper) / (2.0 * walks)
