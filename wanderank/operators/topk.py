"""Top-k lists and their evaluation against exact ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DIGITS = 6


def first_of(rows: DataFrame, k: int, order: Column, value: str) -> DataFrame:
    """(source, node, rank, value): the k largest of each source by ``order``, ties by node. Tasks drop what can't be among them before the exchange."""
    place = Window.partitionBy("source").orderBy(order.desc(), "node")
    return rows.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("source", "node", "rank", F.col(value).alias("value"))


def topk(ppr: DataFrame, k: int) -> DataFrame:
    """(source, rank, node, ppr): the k largest of each source, ties (to 6 digits) by node; fewer where there are fewer."""
    best = first_of(ppr.where("ppr > 0"), k, F.round("ppr", DIGITS), "ppr")
    return best.select("source", "rank", "node", F.col("value").alias("ppr"))


def kth_value(ppr: DataFrame, k: int) -> DataFrame:
    """(source, kth): the k-th largest value; 0 where there are fewer than k."""
    best = topk(ppr, k)
    return best.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("ppr"))), F.lit(0.0)).alias("kth"))


def evaluated(predicted: DataFrame, exact: DataFrame, ks: list[int]) -> DataFrame:
    """(k, source, hits, n_predicted, n_exact, max_abs, avg_abs, max_rel, avg_rel) of ranked lists against exact ranked ones."""
    spark = predicted.sparkSession
    sizes = F.broadcast(spark.createDataFrame([(k,) for k in ks], "k int"))
    a = predicted.join(sizes, F.col("rank") <= F.col("k")).select("k", "source", "node", F.col("ppr").alias("got"))
    b = exact.join(sizes, F.col("rank") <= F.col("k")).select("k", "source", "node", F.col("ppr").alias("true"))
    both = a.join(b, ["k", "source", "node"], "full_outer")
    off = F.abs(F.coalesce("got", F.lit(0.0)) - F.col("true"))
    return both.groupBy("k", "source").agg(
        F.count(F.when(F.col("got").isNotNull() & F.col("true").isNotNull(), 1)).alias("hits"), F.count("got").alias("n_predicted"), F.count("true").alias("n_exact"),
        F.max(off).alias("max_abs"), F.avg(off).alias("avg_abs"), F.max(off / F.col("true")).alias("max_rel"), F.avg(off / F.col("true")).alias("avg_rel"),
    )


def precision_recall(per_source: DataFrame) -> DataFrame:
    """Averages over the sources for each k; precision_ref divides by the exact list's length, as the usual report does."""
    return per_source.groupBy("k").agg(
        F.avg(F.when(F.col("n_predicted") > 0, F.col("hits") / F.col("n_predicted")).otherwise(0.0)).alias("precision"),
        F.avg(F.when(F.col("n_exact") > 0, F.col("hits") / F.col("n_exact")).otherwise(0.0)).alias("precision_ref"),
        F.avg(F.when(F.col("n_exact") > 0, F.col("hits") / F.col("n_exact")).otherwise(0.0)).alias("recall"),
        F.max("max_abs").alias("max_abs_err"), F.avg("avg_abs").alias("avg_abs_err"), F.max("max_rel").alias("max_rel_err"), F.avg("avg_rel").alias("avg_rel_err"), F.count(F.lit(1)).alias("n_sources"),
    )
