"""Confidence bounds and stopping tests as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.params import Params, lambda_bound


def score_bounds(p: Params, ppr: Column, reserve: Column, lower: Column, upper: Column, rsum: Column, walks: Column) -> tuple[Column, Column]:
    """(lb, ub) of a score from an absolute and a relative bound; ``lower`` and ``upper`` are those of the round before, null in the first."""
    reserve, before = F.coalesce(reserve, F.lit(0.0)), F.coalesce(lower, F.lit(0.0))
    room = F.when(upper > reserve, upper - reserve).otherwise(1.0 - reserve)
    absolute = lambda_bound(rsum, p.log_fail, room, walks)
    known = F.when(reserve > 1 / p.n, F.greatest(reserve, before)).when(before > 0, before).otherwise(F.lit(1 / p.n))
    relative = F.sqrt(F.lit(2.67) * rsum * p.log_fail / walks) / F.sqrt(known)
    sure = relative < 1
    ub = F.least(ppr + absolute, F.when(sure, ppr / F.when(sure, 1.0 - relative)).otherwise(1.0), F.lit(1.0))
    lb = F.greatest(
        ppr - absolute,
        F.when(sure, ppr / (1.0 + relative)).otherwise(0.0),
        F.when(reserve > 1 / p.n, F.greatest(reserve, before)).otherwise(reserve),
        F.lit(0.0),
    )
    return lb, ub


def martingale_lambda(rmax: float, log_fail: float, total: int) -> float:
    """Deviation of a sum of ``total`` walks with steps up to rmax; ``log_fail`` is negative, ln(p / 2)."""
    b = total * (rmax / 2) ** 2
    a = rmax * log_fail / 3
    return math.sqrt(a * a - 2 * b * log_fail) - a


def martingale_bounds(
    rmax: float,
    log_fail: float,
    total: int,
    least: float,
    weight: Column,
    reserve: Column,
    lower: Column,
    upper: Column,
) -> tuple[Column, Column]:
    """(lb, ub), never wider than before, from the weight gathered by ``total`` walks."""
    lam, a = martingale_lambda(rmax, log_fail, total), rmax * log_fail / 3
    mean = F.lit(float(total)) * F.greatest(F.lit(least) - reserve, lower - reserve)
    usable = (weight > 0) & (mean > 0)
    safe = F.when(usable, mean)
    eps = (F.sqrt(F.lit(a * a) - 2.0 * safe * log_fail) - a) / safe
    tight = usable & (eps < 1)
    up = reserve + F.when(tight, F.least(weight + lam, weight / F.when(tight, 1.0 - eps))).otherwise(weight + lam) / float(total)
    low = reserve + F.when(usable, F.greatest(weight / (1.0 + eps), weight - lam)).otherwise(weight - lam) / float(total)
    return F.when((low < 1) & (low > lower), low).otherwise(lower), F.when((up > 0) & (up < upper), up).otherwise(upper)


def rest_bound(p: Params, rsum: Column, walks: Column, before: Column) -> Column:
    """Upper bound of the nodes that no walk has ended at so far; ``before``: that of the round before, 1 at first."""
    return lambda_bound(rsum, p.log_fail, before, walks)


def stops(bounds: DataFrame, p: Params, k: int) -> DataFrame:
    """(source, stop) for rows (source, node, ppr, lb, ub): whether the top k are certain enough at this delta.

    Only the top k by score and by lower bound are ranked, which every task does for its own rows first; the rest is
    aggregation, so that no task gets all nodes of a source.
    """
    from ..operators.topk import first_of

    e = p.epsilon
    high = first_of(bounds, k, F.round("ppr", 12), "ppr").groupBy("source").agg(F.max(F.when(F.col("rank") == k, F.col("value"))).alias("kth"))
    best = first_of(bounds, k, F.round("lb", 12), "lb").select("source", "node", "rank", "value")
    kth = best.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("value"))), F.lit(0.0)).alias("kth_lb"))
    rows = bounds.join(best.select("source", "node", F.lit(True).alias("inside")), ["source", "node"], "left").join(kth, "source")
    inside = F.coalesce("inside", F.lit(False))
    outside = ~inside & (F.col("ppr") > 0) & (F.col("ub") > F.col("kth_lb") * (1 + e)) & (F.col("ub") <= (1 + e) / (1 - e) * F.col("lb") if e < 1 else F.lit(True))
    wide = inside & (F.col("ub") > (1 + e) * F.col("lb"))
    told = rows.groupBy("source").agg((~F.bool_or(wide) & (F.max("kth_lb") > p.delta) & ~F.bool_or(outside)).alias("certain"))
    sure = F.lit(p.delta < p.topk_threshold()) & F.col("certain")
    return told.join(high, "source").select("source", ((F.coalesce("kth", F.lit(0.0)) >= 2 * p.delta) | sure).alias("stop"))
