"""Scratch tables in the shared folder, checked broadcasts and shuffle sizing for iterative plans."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that joins may broadcast after it was counted.
BROADCAST_ROWS = 200_000
#: Rows that one shuffle partition of an iteration holds about, that are worth a task of their own, and that one holds at most
#: where there would be more than ``MANY_PARTITIONS``.
PARTITION_ROWS, TASK_ROWS, LARGE_ROWS, MANY_PARTITIONS = 250_000, 20_000, 4_000_000, 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where that setting is empty and the master is local, so that there is only one machine, a temporary folder is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(found)
        return found.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wanderank-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


#: Scratch tables made inside ``scratch_scope``, innermost last.
_SCOPES: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is there is deleted when the application ends, or its ``scratch_scope``."""
    path = f"{shared_dir(spark)}/wanderank-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(where)
    files.deleteOnExit(where)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are deleted at its end."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            removed(spark, path)


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends, the plan gets true sizes, lost executors don't matter."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Delete the scratch table of a ``kept`` DataFrame that nothing reads any more."""
    path = getattr(df, "__dict__", {}).get("scratch")
    if path:
        removed(df.sparkSession, path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session's settings changed within, and as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small(df: DataFrame) -> DataFrame:
    """A written table, broadcast in joins if its count allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@contextmanager
def sized(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, shuffles get partitions for about so many rows of a step; the session's settings are restored afterwards.

    Adaptive execution stays as the session has it: it splits skewed keys, and joins partitions that came out small.
    """
    parts = max(min(-(-rows // PARTITION_ROWS), MANY_PARTITIONS), -(-rows // LARGE_ROWS), min(spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1))
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts)}):
        yield


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with ``name`` bigint: its place from 0 in the order of unique keys, without a window over all rows."""
    spark = df.sparkSession
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = kept(rows.withColumns({"__part": F.spark_partition_id(), "__in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    counts = sorted(rows.groupBy("__part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    table = spark.sql("select * from values " + ", ".join(f"({p}, {s}L)" for p, s in starts) + " as t(__part, __start)") if starts else None
    if table is None:
        return rows.withColumn(name, F.lit(0).cast("bigint")).drop("__part", "__in")
    return rows.join(F.broadcast(table), "__part").withColumn(name, F.col("__start") + F.col("__in")).drop("__part", "__in", "__start")
