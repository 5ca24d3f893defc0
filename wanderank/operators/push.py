"""Residual push as synchronous rounds of one join and one aggregation.

A state row (origin, node, reserve, residual) is joined with the transitions of its node: its own row keeps what is not
pushed, the others carry what a pushed residual turns into. The state is read once per round, so that several rounds
make one plan; after ``UNROLL`` of them it is written to the shared folder and its forerunner is deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..report import phase
from ..session import dropped, kept, sized

UNROLL = 10
STATE = "origin bigint, node bigint, reserve double, residual double"


def unit_state(origins: DataFrame) -> DataFrame:
    """All residual at the origin itself; ``origins``: (origin), distinct."""
    return origins.select(F.col("origin"), F.col("origin").alias("node"), F.lit(0.0).alias("reserve"), F.lit(1.0).alias("residual"))


def is_pushed(residual: Column, deg: Column, rmax: float, strict: bool = False) -> Column:
    """Whether a residual is due; multiplied instead of divided, so that a dead end (degree 0) always is."""
    rounded = F.round(residual, 12)
    due = rounded > deg * F.lit(rmax) if strict else rounded >= deg * F.lit(rmax)
    return (residual > 0) & due


def one_round(state: DataFrame, moves: DataFrame, rmax: float, strict: bool = False, levels: tuple = ()) -> DataFrame:
    """One synchronous round. Moves with a level stand for whole stored pushes: of these the smallest level that is
    at least the residual is taken, scaled to it."""
    everything = rmax == 0 and not strict
    due = "(s.residual > 0)" if everything else f"(s.residual > 0 AND s.rounded {'>' if strict else '>='} t.deg * {rmax!r}D)"
    taken = f"(t.own OR {due})"
    if levels:
        chosen = " ".join(f"WHEN s.residual <= {level!r}D THEN {level!r}D" for level in sorted(levels))
        taken += f" AND (t.lvl IS NULL OR t.lvl = CASE {chosen} END)"
    # rounding is dear and is done once per row of the state, before the join
    state = state if everything else state.selectExpr("origin", "node", "reserve", "residual", "round(residual, 12) AS rounded")
    # as text: a plan of many rounds is built from few calls
    joined = state.alias("s").join(moves.alias("t"), F.expr(f"s.node = t.src AND {taken}"))
    out = joined.selectExpr(
        "s.origin AS origin",
        "coalesce(t.dst, s.origin) AS node",
        f"CASE WHEN t.own THEN s.reserve ELSE 0D END + CASE WHEN {due} THEN s.residual * t.rsv ELSE 0D END AS reserve",
        f"CASE WHEN t.own AND NOT {due} THEN s.residual ELSE 0D END + CASE WHEN {due} THEN s.residual * t.res ELSE 0D END AS residual",
    )
    return out.groupBy("origin", "node").agg(F.expr("sum(reserve) AS reserve"), F.expr("sum(residual) AS residual"))


def frontier(state: DataFrame, moves: DataFrame, rmax: float, strict: bool = False) -> DataFrame:
    """State rows that are due."""
    deg = moves.where("own").select(F.col("src").alias("node"), "deg")
    return state.join(deg, "node").where(is_pushed(F.col("residual"), F.col("deg"), rmax, strict))


def round_rows(state: DataFrame, moves: DataFrame, rmax: float) -> int:
    """About the most rows that a round's join makes: an origin's due nodes have 1 / rmax edges or so, and at most all."""
    origins = state.select("origin").distinct().count()
    if "sizes" not in moves.__dict__:
        moves.sizes = tuple(moves.agg(F.count(F.lit(1)), F.count_if("own")).first())
    size, nodes = moves.sizes
    return int(origins * (size if rmax <= 0 else min(size, size / max(1, nodes) / rmax + 1)))


def push(state: DataFrame, moves: DataFrame, rmax: float, rounds: int | None = None, strict: bool = False, levels: tuple = ()) -> DataFrame:
    """Rounds until nothing is due, or exactly ``rounds`` of them. A written state may be pushed on with a smaller rmax.

    Without ``rounds`` it ends, as a round leaves at most 1 - alpha of what was due.
    """
    spark, done, before = state.sparkSession, 0, None
    with phase("propagation"), sized(spark, round_rows(state, moves, rmax)):
        while True:
            now = UNROLL if rounds is None else min(UNROLL, rounds - done)
            for _ in range(now):
                state = one_round(state, moves, rmax, strict, levels)
            done += now
            state = kept(state, "push")
            dropped(before)
            before = state
            if (rounds is not None and done >= rounds) or (rounds is None and frontier(state, moves, rmax, strict).isEmpty()):
                return state


def residual_sums(state: DataFrame) -> DataFrame:
    return state.groupBy("origin").agg(F.sum("residual").alias("rsum"))
