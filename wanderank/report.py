"""Run reports: one JSON document per run with the times, the command, the parameters, the result's figures and the timers."""

from __future__ import annotations

import json
import resource
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from .plans.params import Params

_NOW: ContextVar[Timers | None] = ContextVar("timers", default=None)


class Timers(dict):
    """Seconds by name, and counts of walks. While ``active``, phases that run on this thread are added up here."""

    def __init__(self):
        super().__init__()
        self.counts: dict[str, int] = {}
        self.started = time.strftime("%Y-%m-%d %H:%M:%S")

    @contextmanager
    def span(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self[name] = self.get(name, 0.0) + time.perf_counter() - began

    @contextmanager
    def active(self) -> Iterator[None]:
        token = _NOW.set(self)
        try:
            yield
        finally:
            _NOW.reset(token)


@contextmanager
def phase(name: str) -> Iterator[None]:
    """Time of a phase (propagation, rand-walks, sorting top-k), added to the active timers, if any."""
    now = _NOW.get()
    if now is None:
        yield
        return
    with now.span(name):
        yield


def counted(**numbers) -> None:
    """Counts for the active timers; a callable is called only if there are some."""
    now = _NOW.get()
    if now is not None:
        for name, n in numbers.items():
            now.counts[name] = now.counts.get(name, 0) + int(n() if callable(n) else n)


#: Names of the phases and of the figures of the evaluation in a report (fixed values).
PHASES = {"rand-walks": "rand-walks", "propagation": "propagation", "topk": "sorting top-k ppr"}
FIGURES = {
    "max_abs_err": "topk max absolute error",
    "avg_abs_err": "topk avg absolute error",
    "max_rel_err": "topk max relative error",
    "avg_rel_err": "topk avg relative error",
    "precision": "topk precision",
    "recall": "topk recall",
}


def result_fields(p: Params, timers: Timers, n_sources: int, figures: dict) -> dict:
    """The figures of a run under their usual names; times are of the whole batch, its average is by source."""
    total = timers.get("total", 0.0)
    memory = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    out = {"n": p.n, "m": p.m, "avg query time(s/q)": total / max(1, n_sources), "total memory usage(MB)": round(memory, 1), "total time usage(s)": total}
    out |= {f"total time on {told}(s)": timers.get(name, 0.0) for name, told in PHASES.items()}
    out |= {f"total time ratio on {told}(%)": 100 * timers.get(name, 0.0) / total if total else 0.0 for name, told in PHASES.items()}
    walks, used = timers.counts.get("walks", 0), timers.counts.get("index_walks", 0)
    out |= {
        "total number of rand-walks": walks,
        "total number of rand-walk idx used": used,
        "total usage ratio of rand-walk idx": used / walks if walks else 0.0,
    }
    return out | {told: figures[name] for name, told in FIGURES.items() if name in figures}


def report(action: str, algorithm: str, p: Params, result: dict, timers: dict, command_line: str = "") -> dict:
    now = time.strftime("%Y-%m-%d %H:%M:%S")
    started = getattr(timers, "started", now)
    return {
        "start_time": started,
        "end_time": now,
        "command_line": command_line,
        "action": action,
        "algorithm": algorithm,
        "config": asdict(p),
        "result": result,
        "timer": dict(timers),
    }


def report_row(spark: SparkSession, *args) -> DataFrame:
    """The report as one row: its parts as JSON text."""
    r = report(*args)
    text = {k: v if isinstance(v, str) else json.dumps(v, sort_keys=True) for k, v in r.items()}
    return spark.createDataFrame([tuple(text.values())], ", ".join(f"{k} string" for k in text))


def report_name(graph: str, action: str, algorithm: str, indexed: bool, k: int, p: Params) -> str:
    """A report's name tells the run's settings, so that runs with others don't mix."""
    return f"{graph}.{action}.{algorithm}.{'with' if indexed else 'without'}_idx.k-{k}.rmax-{p.rmax_scale:g}.json"


def save_report(spark: SparkSession, path: str, *args) -> None:
    """One JSON document at ``path``; a later run with the same settings replaces it."""
    spark.createDataFrame([(json.dumps(report(*args), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
