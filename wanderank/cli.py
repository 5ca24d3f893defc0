"""Command line: six actions over a graph folder (attribute.txt, graph.txt, ssquery.txt)."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from .operators import indexes
from .plans.engine import ALGORITHMS, PprEngine
from .report import report_name, result_fields, save_report
from .sources.graphs import read_graph, read_workload, workload, write_workload

ACTIONS = ("query", "topk", "batch-topk", "gen-exact-topk", "build", "generate-ss-query")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wanderank", description=__doc__)
    p.add_argument("action", choices=ACTIONS)
    p.add_argument("--prefix", default=".", help="folder of all graphs")
    p.add_argument("--dataset", required=True, help="folder of the graph below the prefix")
    p.add_argument("--algo", choices=ALGORITHMS, default="push_walk")
    p.add_argument("--epsilon", type=float, default=0.5, help="relative error, above 0")
    p.add_argument("--query_size", type=int, default=1000, help="sources that are read or drawn")
    p.add_argument("--k", type=int, default=500)
    p.add_argument("--with_idx", action="store_true", help="use the stored walks, or hub oracles, of an earlier build")
    p.add_argument("--opt", action="store_true", help="one-hop form")
    p.add_argument("--balanced", action="store_true", help="find the push threshold by cost")
    p.add_argument("--rmax_scale", type=float, default=1.0)
    p.add_argument("--exact_ppr_path", help="folder of the exact lists; the graph's by default")
    p.add_argument("--result_dir", default=".", help="folder of results and run reports")
    p.add_argument("--hubs", type=int, default=16, help="hubs whose walks and pushes are stored")
    p.add_argument("--seed", type=int, default=1)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("wanderank").getOrCreate()
    folder = f"{a.prefix.rstrip('/')}/{a.dataset}"
    engine = PprEngine(read_graph(spark, folder), a.epsilon, a.seed, opt=a.opt, rmax_scale=a.rmax_scale)
    truth_path, out = f"{a.exact_ppr_path or folder}/exact-topk.parquet", f"{a.result_dir.rstrip('/')}/{a.action}.parquet"
    if a.action == "generate-ss-query":
        write_workload(workload(engine.graph, a.query_size, a.seed), f"{folder}/ssquery.txt")
        return 0
    if a.action == "build":
        if a.algo == "hub":
            print(indexes.save_hubs(engine.build_hubs(a.hubs), folder, engine.params, a.hubs))
        else:
            print(indexes.save_index(engine.build_index(), folder, engine.params))
        return 0
    sources = read_workload(spark, f"{folder}/ssquery.txt", a.query_size)
    if a.action == "gen-exact-topk":
        engine.exact_topk(sources, a.k).write.mode("ignore").parquet(truth_path)
        return 0
    index = hubs = None
    if a.with_idx and a.algo == "hub":
        hubs = indexes.load_hubs(spark, folder, engine.params, a.hubs)
    elif a.with_idx:
        index = indexes.load_index(spark, folder, engine.params)
    try:
        truth = spark.read.parquet(truth_path)
    except AnalysisException:
        truth = None
        print(f"no exact lists at {truth_path}: precision is not reported", file=sys.stderr)
    figures: dict = {}
    if a.action == "query":
        found = engine.query(sources, a.algo, index, a.balanced, hubs)
    elif a.action == "topk":
        found = engine.topk(sources, a.k, a.algo, index, hubs)
        figures = engine.evaluate(found, truth, a.k).first().asDict() if truth is not None else {}
    elif truth is None:
        print("batch-topk needs exact lists", file=sys.stderr)
        return 1
    else:
        found = engine.batch_topk(sources, a.k, truth, a.algo)
        figures = found.where(f"k = {a.k}").first().asDict()
    with engine.timers.span("write"):
        found.write.mode("overwrite").parquet(out)
    result = result_fields(engine.params, engine.timers, sources.count(), figures)
    name = report_name(a.dataset.strip("/").replace("/", "_"), a.action, a.algo, a.with_idx, a.k, engine.params)
    save_report(spark, f"{a.result_dir.rstrip('/')}/execution/{name}", a.action, a.algo, engine.params, result, engine.timers, " ".join(argv or sys.argv[1:]))
    print(json.dumps({"out": out, "figures": figures, "timer": engine.timers, "result": result}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
