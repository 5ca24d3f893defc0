"""Graphs, their files and the graphs derived from tables.

A graph is a DataFrame of edges (src, dst, cnt) with parallel edges counted and self-loops dropped, and a DataFrame of
nodes (node, out_deg, in_deg), isolated ones included. Node ids are bigint.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import kept, ranked, settings

#: Edges of a row of ``Graph.packed`` about, and tasks at most that read these rows each for itself.
PACKED, READERS = 1 << 18, 64


@dataclass
class Graph:
    """Edges and nodes, written once so that every round reads them with known sizes."""

    edges: DataFrame
    nodes: DataFrame
    m_declared: int | None = None
    _made: dict = field(default_factory=dict)

    @cached_property
    def n(self) -> int:
        return self.nodes.count()

    @cached_property
    def m(self) -> int:
        return self.edges.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]

    @cached_property
    def distinct(self) -> int:
        """Rows of the edges, parallel ones counted once."""
        return self.edges.count()

    @cached_property
    def packed(self) -> DataFrame:
        """(src, dst, cnt) binary: the edges as the bytes of arrays of many, so that sending all of them to each task is sending few rows."""
        # many edges at a time, also where ``few_at_once`` holds
        with settings(self.edges.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": "65536"}):
            return kept(self.edges.select("src", "dst", "cnt").mapInArrow(_packed, "src binary, dst binary, cnt binary"), "packed")

    def beside(self, work: DataFrame, parts: int) -> DataFrame:
        """``packed`` and the rows of ``work`` (part, ...) in a task for each part from 0 to ``parts`` - 1.

        Up to ``READERS`` tasks read the packed edges and the work, which is a table that is cheap to read, as they are written, so
        that no copy of the edges for each task goes through an exchange and its files.
        """
        if parts > READERS:
            copies = self.packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
            return copies.unionByName(work, allowMissingColumns=True).repartitionById(parts, "part")
        own = [self.packed.withColumn("part", F.lit(i)).unionByName(work.where(F.col("part") == i), allowMissingColumns=True).coalesce(1) for i in range(parts)]
        # rows of no part in two partitions: Spark puts a union of single partitions into one
        apart = work.sparkSession.range(0, 2, 1, 2).select(F.lit(None).cast("int").alias("part"))
        return functools.reduce(DataFrame.unionByName, own).unionByName(apart, allowMissingColumns=True)

    @cached_property
    def neighbours(self) -> DataFrame:
        """(src, k, dst, dst_deg): the k-th out-edge of src, by dst, parallel edges one by one.

        The numbers are summed up in ranges of (src, dst) first and then along a node's ranges, so that no task gets all
        edges of a node.
        """
        edges = numbered(self.edges).withColumn("k", F.explode(F.sequence(F.col("lo"), F.col("lo") + F.col("cnt") - 1)))
        deg = self.nodes.select(F.col("node").alias("dst"), F.col("out_deg").alias("dst_deg"))
        return kept(edges.select("src", "k", "dst").join(deg, "dst").select("src", "k", "dst", "dst_deg"), "neighbours")

    def transitions(self, alpha: float, dangling: str = "source") -> DataFrame:
        """Forward push as a table: what a unit of residual at src turns into.

        Rows (src, dst, own, rsv, res, lvl, deg): ``own`` rows keep what is not pushed. A dead end's rest goes to the
        query's source (dst null), or vanishes with ``dangling`` "absorb".
        """
        key = ("forward", alpha, dangling)
        if key not in self._made:
            none, zero = F.lit(None).cast("double"), F.lit(0.0)
            own = self.nodes.select(
                F.col("node").alias("src"),
                F.col("node").alias("dst"),
                F.lit(True).alias("own"),
                F.lit(alpha).alias("rsv"),
                zero.alias("res"),
                none.alias("lvl"),
                F.col("out_deg").cast("double").alias("deg"),
            )
            deg = self.nodes.select(F.col("node").alias("src"), F.col("out_deg").cast("double").alias("deg"))
            moved = self.edges.join(deg, "src").select(
                "src",
                "dst",
                F.lit(False).alias("own"),
                zero.alias("rsv"),
                (F.lit(1 - alpha) * F.col("cnt") / F.col("deg")).alias("res"),
                none.alias("lvl"),
                "deg",
            )
            rows = own.unionByName(moved)
            if dangling == "source":
                back = deg.where("deg = 0").select(
                    "src",
                    F.lit(None).cast("bigint").alias("dst"),
                    F.lit(False).alias("own"),
                    zero.alias("rsv"),
                    F.lit(1 - alpha).alias("res"),
                    none.alias("lvl"),
                    "deg",
                )
                rows = rows.unionByName(back)
            elif dangling != "absorb":
                raise ValueError("dangling is 'source' or 'absorb'")
            self._made[key] = kept(rows, "transitions")
        return self._made[key]

    def backward(self, alpha: float) -> DataFrame:
        """Backward push as a table of the same form; thresholds there don't depend on degrees (deg 1)."""
        key = ("backward", alpha)
        if key not in self._made:
            none, zero, one = F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0)
            own = self.nodes.select(
                F.col("node").alias("src"),
                F.col("node").alias("dst"),
                F.lit(True).alias("own"),
                F.lit(alpha).alias("rsv"),
                zero.alias("res"),
                none.alias("lvl"),
                one.alias("deg"),
            )
            deg = self.nodes.select(F.col("node").alias("src"), F.col("out_deg").cast("double").alias("d"))
            moved = self.edges.join(deg, "src").select(
                F.col("dst").alias("src"),
                F.col("src").alias("dst"),
                F.lit(False).alias("own"),
                zero.alias("rsv"),
                (F.lit(1 - alpha) * F.col("cnt") / F.col("d")).alias("res"),
                none.alias("lvl"),
                one.alias("deg"),
            )
            self._made[key] = kept(own.unionByName(moved), "backward")
        return self._made[key]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append([batch.column(c).to_numpy() for c in range(3)])
            rows += len(held[-1][0])
        if rows >= PACKED or (batch is None and rows):
            columns = [narrow(np.concatenate(c)) for c in zip(*held, strict=True)]
            if columns[2].max() < 256:
                columns[2] = columns[2].astype(np.uint8)
            # the numbers' width goes ahead
            yield pa.RecordBatch.from_arrays([pa.array([bytes([c.itemsize]) + c.tobytes()], pa.binary()) for c in columns], ["src", "dst", "cnt"])
            held, rows = [], 0


def few_at_once(spark: SparkSession):
    """Within, a worker gets few rows at a time: for plans whose rows are nearly all ``Graph.packed``, of up to 3 MB each."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"})


def unpacked(value: pa.BinaryScalar) -> np.ndarray:
    """The array of a cell of ``Graph.packed``."""
    held = value.as_buffer()
    return np.frombuffer(held, {1: np.uint8, 4: np.int32, 8: np.int64}[held[0]], offset=1)


def narrow(values: np.ndarray) -> np.ndarray:
    """As int32 where all of them fit."""
    fits = not len(values) or (values.min() >= -(1 << 31) and values.max() < 1 << 31)
    return values.astype(np.int32) if fits else values


def numbered(edges: DataFrame) -> DataFrame:
    """Edges (src, dst, cnt) with ``lo``: the number, from 0, that the first of the parallel edges has among those of src, by dst."""
    rows = kept(edges.repartitionByRange("src", "dst").withColumn("part", F.spark_partition_id()), "ranges")
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("src", "part").agg(F.sum("cnt").alias("own"))
    starts = starts.select("src", "part", F.coalesce(F.sum("own").over(before("src", "part")), F.lit(0)).alias("base"))
    rows = rows.withColumn("inner", F.coalesce(F.sum("cnt").over(before("src", "part", "dst")), F.lit(0)))
    return rows.join(starts, ["src", "part"]).withColumn("lo", F.col("base") + F.col("inner"))


def graph_of(pairs: DataFrame, nodes: DataFrame | None = None, m_declared: int | None = None) -> Graph:
    """The graph of (src, dst) rows; ``nodes`` (node) adds isolated ones. Nulls are no edges."""
    pairs = pairs.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src is not null and dst is not null")
    # the pairs are read once: a node that only has self-loops is found in the table of counts
    counts = kept(pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt")), "edges")
    edges, ends = counts.where("src <> dst"), counts.where("src = dst").select(F.col("src").alias("node"))
    if nodes is not None:
        ends = ends.unionByName(nodes.select(F.col("node").cast("bigint").alias("node")))
    seen = ends.distinct().select("node", F.lit(0).cast("bigint").alias("out_deg"), F.lit(0).cast("bigint").alias("in_deg"))
    zero = F.lit(0).cast("bigint")
    both = seen.unionByName(edges.select(
        F.col("src").alias("node"),
        F.col("cnt").alias("out_deg"),
        zero.alias("in_deg"),
    )).unionByName(edges.select(F.col("dst").alias("node"), zero.alias("out_deg"), F.col("cnt").alias("in_deg")))
    return Graph(edges, kept(both.groupBy("node").agg(F.sum("out_deg").alias("out_deg"), F.sum("in_deg").alias("in_deg")), "nodes"), m_declared)


def both_ways(pairs: DataFrame) -> Graph:
    """The graph of (a, b) rows, each of which is an edge from a to b and one back. Nulls are no edges; the pairs are counted once, for both directions."""
    pairs = pairs.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a is not null and b is not null")
    counts = kept(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt")), "edges")
    there = counts.where("src <> dst")
    edges = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cnt"))
    # a self-loop is no edge, but its node stays
    ends = counts.select(F.col("src").alias("node"), F.expr("if(src = dst, 0L, cnt)").alias("deg")).unionByName(there.select(F.col("dst").alias("node"), F.col("cnt").alias("deg")))
    degrees = ends.groupBy("node").agg(F.sum("deg").alias("out_deg"))
    return Graph(edges, kept(degrees.withColumn("in_deg", F.col("out_deg")), "nodes"))


# ---- files --------------------------------------------------------------------------------------------------


def read_attributes(spark: SparkSession, path: str) -> dict[str, int]:
    """``name=number`` lines (n, m)."""
    rows = spark.read.text(path).select(
        F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(\d+)", 1).alias("k"),
        F.regexp_extract("value", r"^\s*(\w+)\s*=\s*(\d+)", 2).alias("v"),
    ).where("k <> ''")
    return {r["k"]: int(r["v"]) for r in rows.collect()}


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of an edge list with white space between the two ids of a line; other lines are skipped."""
    both = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").rlike(r"^\d+\s+\d+$"))
    return rows.select(both[0].cast("bigint").alias("src"), both[1].cast("bigint").alias("dst"))


def read_graph(spark: SparkSession, folder: str) -> Graph:
    """``attribute.txt`` (n, m) and ``graph.txt`` in a folder; ids are 0 to n - 1, or it raises."""
    declared = read_attributes(spark, f"{folder}/attribute.txt")
    pairs = read_edges(spark, f"{folder}/graph.txt")
    n = declared["n"]
    if not pairs.where((F.col("src") >= n) | (F.col("dst") >= n)).isEmpty():
        raise ValueError(f"an edge of {folder} names a node beyond n = {n}")
    return graph_of(pairs, spark.range(n).select(F.col("id").alias("node")), declared.get("m"))


def write_graph(graph: Graph, folder: str) -> None:
    """The edge list and attributes as text, parallel edges repeated."""
    lines = graph.edges.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("cnt"))))
    lines.select(F.concat_ws(" ", "src", "dst").alias("value")).write.mode("overwrite").text(f"{folder}/graph.txt")
    graph.edges.sparkSession.range(1).select(F.explode(F.array(F.lit(f"n={graph.n}"), F.lit(f"m={graph.m}"))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/attribute.txt")


def remapped(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """External ids to dense ones in order of first appearance.

    ``pairs``: (seen, src, dst), ``seen`` an orderable place of the row. Returns the pairs with dense ids, and (label, node).
    """
    ends = pairs.select(F.posexplode(F.array("src", "dst")).alias("side", "label"), "seen").where("label is not null")
    first = ends.groupBy("label").agg(F.min(F.struct("seen", "side")).alias("first"))
    ids = kept(ranked(first, [F.col("first"), F.col("label")], "node").select("label", "node"), "ids")
    a = ids.select(F.col("label").alias("src"), F.col("node").alias("s"))
    b = ids.select(F.col("label").alias("dst"), F.col("node").alias("d"))
    return pairs.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst")), ids


def draw_number(*parts) -> F.Column:
    """A number in 0 to 2^32 - 1 from the MD5 of the parts: equal in every run, retry and SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("bigint")


def workload(graph: Graph, size: int, seed: int = 1) -> DataFrame:
    """(query_no, source): uniform draws of nodes with replacement; duplicates stay."""
    nodes = ranked(graph.nodes.select("node"), [F.col("node")], "place")
    spark = graph.nodes.sparkSession
    drawn = spark.range(size).select(
        F.col("id").alias("query_no"),
        F.pmod(draw_number(F.lit(seed), F.col("id"), F.lit("source")), F.lit(graph.n)).alias("place"),
    )
    return kept(drawn.join(nodes, "place").select("query_no", F.col("node").alias("source")), "workload")


def write_workload(work: DataFrame, path: str) -> None:
    """One source per line in order of query_no; an existing file stays."""
    work.orderBy("query_no").select(F.col("source").cast("string").alias("value")).write.mode("ignore").text(path)


def read_workload(spark: SparkSession, path: str, size: int | None = None) -> DataFrame:
    """(query_no, source): the first ``size`` lines; a missing file raises Spark's own error."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("f"),
        F.monotonically_increasing_id().alias("at"),
        F.trim("value").alias("value"),
    ).where(F.col("value").rlike(r"^\d+$"))
    rows = ranked(rows, [F.col("f"), F.col("at")], "query_no").select("query_no", F.col("value").cast("bigint").alias("source"))
    return rows if size is None else rows.where(F.col("query_no") < size)


# ---- graphs derived from tables ---------------------------------------------------------------------------------


def events_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each event's user after the one before it in time.

    The order is cut by the hour; only the last event of each hour crosses over, so no task sees all events.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", F.date_trunc("hour", "ts").alias("hour"))
    inside = F.lag("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id"))
    first = F.row_number().over(Window.partitionBy("hour").orderBy("ts", "event_id")) == 1
    rows = events.withColumns({"src": inside, "first": first})
    last = events.groupBy("hour").agg(F.max(F.struct("ts", "event_id", "user_id"))["user_id"].alias("user"))
    last = last.select("hour", F.lag("user").over(Window.orderBy("hour")).alias("before"))
    rows = rows.join(last, "hour").select(F.when(F.col("first"), F.col("before")).otherwise(F.col("src")).alias("src"), F.col("user_id").alias("dst"))
    return rows.where("src is not null and dst is not null")


def pages_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seen, src, dst): a page and each target of its links, as strings."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("at", "dst"))
    return found.select(F.struct("page_id", "at").alias("seen"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), "dst")


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): customers (even ids) and suppliers (odd ids), both ways, one edge per line item."""
    return trade_pairs(spark, sf_dir).select(F.explode(F.array(
        F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
        F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
    )).alias("e")).select("e.*")


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): the customer (even id) and the supplier (odd id) of each line item."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"))
