"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Every input partition knows only how many rows it has. The driver draws the matrix of how many of
them go to each shard, so that the shards' sizes come out exact, and writes it as a table; each partition permutes its
rows and deals them out by its row of the matrix; one exchange moves them; each shard permutes what it got, in
cells that are counted and then numbered on end.
Every order of all rows is equally likely, rows of one source or group of copies spread like all others,
and no key decides where a row goes, so that no key can make a partition large.

Defined results: nulls are ordinary values; repeated rows each get a slot of their own; an empty table
gives no rows; a shard may stay empty where there are fewer rows than shards; input columns named
``shard`` or ``slot`` (in any case) are replaced.
"""

from __future__ import annotations

import itertools
import json
import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checked, clear_of, maybe_broadcast, scratch_path, utf8_size, written

#: Rows that one cell (a part of a shard that one task permutes) holds about.
CELL_ROWS = 8192
#: Rows of the matrix that one constant of a plan holds while it is written; most rows of a table that is broadcast.
MATRIX_ROWS, BROADCAST_ROWS = 4096, 100_000
#: Rank of a row in its partition: the low 33 bits of monotonically_increasing_id().
LOCAL_RANK = (1 << 33) - 1


def hypergeometric(good: int, bad: int, drawn: int, rng: random.Random) -> int:
    """How many of ``drawn`` of ``good + bad`` balls are good, drawn exactly: inversion outwards from the mode."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    at_mode = math.exp(choose(good, mode) + choose(bad, drawn - mode) - choose(good + bad, drawn))
    left = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (drawn - up) / ((up + 1) * (bad - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - drawn + down) / ((good - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
        if p_up < 1e-300 and p_down < 1e-300:
            break
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows sent from each partition (of ``counts`` rows) to each shard (of exactly ``sizes`` rows)."""
    rng, room, matrix = random.Random(seed), list(sizes), []
    for n in counts:
        row, left, space = [], n, sum(room)
        for k, free in enumerate(room):
            sent = hypergeometric(free, space - free, left, rng) if left else 0
            row.append(sent)
            left -= sent
            space -= free
            room[k] -= sent
        matrix.append(row)
    return matrix


def _is_scan(docs: DataFrame) -> bool:
    """Whether the plan only reads, filters and projects files: then its partitions are the same in every pass."""
    lines = docs._jdf.queryExecution().optimizedPlan().toString().strip().splitlines()
    heads = [line.lstrip(" :+-").split(" ")[0].split("[")[0] for line in lines]
    return all(h in ("Project", "Filter", "Relation") for h in heads if h)


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def _matrix_table(spark, counts: list[int], sizes: list[int], seed: int) -> DataFrame:
    """(__part, __ends): for each partition the ranks at which its rows for each shard end, as a written table."""
    path = scratch_path(spark, "shard-matrix")
    rows = [{"__part": p, "__ends": list(itertools.accumulate(row))} for p, row in enumerate(communication_matrix(counts, sizes, seed))]
    kind = "array<struct<__part:int,__ends:array<bigint>>>"
    for at in range(0, max(1, len(rows)), MATRIX_ROWS):
        part = json.dumps(rows[at : at + MATRIX_ROWS], separators=(",", ":"))
        spark.range(1).select(F.inline(F.from_json(F.lit(part), kind))).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema("__part int, __ends array<bigint>").parquet(path)


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = 20_240_817) -> DataFrame:
    """``docs`` with ``shard`` int (0 to shards - 1; sizes at most one apart) and ``slot`` long (gapless from 0 in each shard)."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    docs = clear_of(docs, "shard", "slot")
    if not _is_scan(docs):
        docs = written(docs, "to-shard")
    spark = docs.sparkSession
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):
        # else the splits follow the number of executors alive, which may change between the passes
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    found = dict(docs.groupBy(F.spark_partition_id().alias("p")).count().collect())
    counts = [found.get(p, 0) for p in range(max(found, default=-1) + 1)]
    total = sum(counts)
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    cells = max(1, -(-total // (shards * CELL_ROWS)))
    matrix = checked(_matrix_table(spark, counts, sizes, seed), BROADCAST_ROWS)

    names = [f.name for f in docs.schema.fields if _hashable(f.dataType)]
    mixed = F.xxhash64(F.lit(seed), *[F.col(f"`{n}`") for n in names])
    order = ["__mixed", *[F.col(f"`{n}`") for n in docs.columns if n == "doc_id"]]
    dealt = docs.withColumn("__mixed", mixed).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"__part": F.spark_partition_id(), "__rank": F.monotonically_increasing_id().bitwiseAND(F.lit(LOCAL_RANK))})
    # no row of the matrix, or a rank beyond its last end: the input changed between the passes
    dealt = dealt.join(matrix, "__part", "left")
    inside = F.coalesce(F.col("__rank") < F.get(F.col("__ends"), F.lit(shards - 1)), F.lit(False))
    shard = sum((F.when(F.col("__rank") >= F.get(F.col("__ends"), F.lit(k)), 1).otherwise(0) for k in range(shards - 1)), F.lit(0))
    shard = F.when(inside, shard).otherwise(F.raise_error(F.lit("the input's partitions changed between two passes over it")).cast("int"))
    again = F.xxhash64(F.lit(seed + 1), F.col("__mixed"))
    dealt = dealt.withColumns({
        "shard": shard.cast("int"),
        "__again": again,
        "__cell": F.pmod(F.shiftright(again, 20), F.lit(cells)).cast("int"),
    }).drop("__part", "__rank", "__ends")

    place = F.row_number().over(Window.partitionBy("shard", "__cell").orderBy("__again", "__mixed")).cast("bigint") - 1
    if cells == 1:
        return dealt.withColumn("slot", place).drop("__mixed", "__again", "__cell")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "__cell").agg(F.count(F.lit(1)).alias("n")).select("shard", "__cell", F.coalesce(before, F.lit(0)).alias("__start"))
    dealt = dealt.withColumn("__place", place).join(maybe_broadcast(starts, "shard-starts", BROADCAST_ROWS), ["shard", "__cell"])
    return dealt.withColumn("slot", F.col("__start") + F.col("__place")).select(*[F.col(f"`{c}`") for c in docs.columns], "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op3: law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    digests = docs.select("doc_id", (utf8_size(F.col("text")) + 1).alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"))
    return shuffle_into_shards(digests).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
