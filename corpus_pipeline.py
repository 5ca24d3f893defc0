"""The corpus pipeline: toxic documents out, near duplicates out, contaminated documents out, sources mixed, sharded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, so every stage works on all that the one before kept.

Defined results, stage by stage: a null text is an empty one (toxicity judges it like a document without toxic words; empty
texts are copies of each other; without words nothing is contaminated); a null source is a source of its own; repeated
rows are judged alike and are copies, of which one stays; ties in a group go to the smallest doc_id, a null one last, and
then to the row's place; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderank.llm import decontaminate, mixing, near_copies, sharding, toxicity
from wanderank.llm.common import as_scan, checked, clear_of, located, scoped
from wanderank.session import removed, scratch_path, scratch_scope

#: Toxic rows whose locators are broadcast at most.
BROADCAST_ROWS = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. Null and empty texts are scored as texts without words; equal texts get equal scores."""
    rows = located(as_scan(clear_of(docs, "__at")))
    toxic = toxicity.scored(rows.select("__at", "text"), toxicity.trained(spark, sf_dir)).where("predicted = 1").select("__at")
    return rows.join(checked(scoped(spark, "toxic", lambda: toxic), BROADCAST_ROWS), "__at", "left_anti").drop("__at")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (5-word shingles, similarity 0.8 or more): the smallest doc_id."""
    return near_copies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources draws them."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards 0 to 7 of equal size, uniformly shuffled."""
    return sharding.shuffle_into_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Neither the toxicity model nor the components can be told in SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote for itself, and its input, are deleted when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars"))
    last = None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        if last:
            removed(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
