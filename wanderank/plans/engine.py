"""The engine as one object: estimates, top-k lists, ground truth, indexes and evaluation over one graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import estimators, indexes
from ..operators.topk import evaluated, precision_recall, topk
from ..report import Timers, report, result_fields
from ..session import kept
from ..sources.graphs import Graph
from . import adaptive
from .params import Params

ALGORITHMS = ("push_walk", "forward_push", "montecarlo", "bidirectional", "hub")


class PprEngine:
    """Answers many sources in one batch; results are ordinary DataFrames."""

    def __init__(self, graph: Graph, epsilon: float = 0.5, seed: int = 1, **params):
        self.graph, self.seed = graph, seed
        self.params = Params(graph.n, graph.m, epsilon, **params)
        self.timers = Timers()

    def _estimate(self, sources: DataFrame, algorithm: str, index, balanced: bool, hubs) -> DataFrame:
        g, p, s = self.graph, self.params, self.seed
        if algorithm == "push_walk":
            return adaptive.balanced(g, sources, p, s) if balanced else estimators.push_walk(g, sources, p, s, index)
        if algorithm == "forward_push":
            return estimators.forward_push(g, sources, p)
        if algorithm == "montecarlo":
            return estimators.montecarlo(g, sources, p, s)
        if algorithm == "bidirectional":
            return estimators.bidirectional(g, sources, p, s)
        if algorithm == "hub":
            return indexes.hub_ppr(g, sources, p, hubs, s)
        raise ValueError(f"algorithm is one of {', '.join(ALGORITHMS)}")

    def query(
        self,
        sources: DataFrame,
        algorithm: str = "push_walk",
        index: DataFrame | None = None,
        balanced: bool = False,
        hubs: indexes.Hubs | None = None,
    ) -> DataFrame:
        """(source, node, ppr) of all nodes that the estimate reaches, written to the shared folder, so that the times are those of the work."""
        with self.timers.active(), self.timers.span("total"):
            return kept(self._estimate(sources, algorithm, index, balanced, hubs), "answer")

    def topk(self, sources: DataFrame, k: int, algorithm: str = "push_walk", index: DataFrame | None = None, hubs: indexes.Hubs | None = None) -> DataFrame:
        """(source, rank, node, ppr); push and walks and hubs refine until the top k are settled."""
        if not 1 <= k < self.graph.n:
            raise ValueError("k lies between 1 and the number of nodes")
        with self.timers.active(), self.timers.span("total"):
            if algorithm == "push_walk":
                plan = adaptive.topk_adaptive if self.params.opt else adaptive.topk_bounded
                found = plan(self.graph, sources, k, self.params, self.seed, index)
            elif algorithm == "hub":
                found = adaptive.topk_martingale(self.graph, sources, k, self.params, hubs, self.seed)
            else:
                scores = kept(self._estimate(sources, algorithm, index, False, hubs), "answer")
                with self.timers.span("topk"):
                    return kept(topk(scores, k), "topk")
            return kept(found.select("source", "rank", "node", "ppr"), "topk")

    def batch_topk(self, sources: DataFrame, k: int, truth: DataFrame, algorithm: str = "push_walk") -> DataFrame:
        """Precision, recall and errors for k/5, 2k/5, ... k. Adaptive plans are run for each k, others once for the largest."""
        ks = sorted({max(1, i * (k // 5)) for i in range(1, 5)} | {k})
        if algorithm in ("push_walk", "hub"):
            out = None
            for one in ks:
                part = evaluated(self.topk(sources, one, algorithm), truth, [one])
                out = part if out is None else out.unionByName(part)
            return precision_recall(out)
        return precision_recall(evaluated(self.topk(sources, k, algorithm), truth, ks))

    def exact_topk(self, sources: DataFrame, k: int) -> DataFrame:
        return topk(estimators.power_iteration(self.graph, sources, self.params), k)

    def build_index(self) -> DataFrame:
        return indexes.build_index(self.graph, self.params, self.seed)

    def build_hubs(self, h: int = 16, blocks: int = 8) -> indexes.Hubs:
        return indexes.build_hubs(self.graph, self.params, h, blocks, self.seed)

    def evaluate(self, predicted: DataFrame, truth: DataFrame, k: int) -> DataFrame:
        return precision_recall(evaluated(predicted, truth, [k]))

    def report(self, action: str, algorithm: str, n_sources: int, figures: dict | None = None, command_line: str = "") -> dict:
        """The run's report: times, command, parameters, figures."""
        return report(action, algorithm, self.params, result_fields(self.params, self.timers, n_sources, figures or {}), self.timers, command_line)
