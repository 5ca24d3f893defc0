"""SimHash near-duplicates: pivot distance tables, their cells, verified links, components.

Each document gets a 64-bit fingerprint of the XXH64 values of its 3-word shingles. Equal fingerprints are
one node from then on, so that exact copies (a third of all rows, say) weigh as one.

The fingerprint is cut into blocks, and each block has ``REFERENCES`` reference fingerprints (pivots). A row of the
distance table holds the Hamming distances of a fingerprint to all of them, each over the reference's block. By the
triangle inequality the largest difference of two fingerprints' coordinates in a block is at most their distance
there, so the sum of these differences over the blocks is at most their distance: a pair for which it is more than
3 is discarded, the survivors are verified bit by bit. It also follows that fingerprints within 3 bits have
equal coordinates in all but 3 blocks; for each choice of these blocks the table's equal cells propose pairs, so
that no pass over all pairs is needed. The blocks get more, and thus the cells smaller, as the fingerprints do.

A cell of more than ``HOT`` fingerprints is not compared pair by pair: its fingerprints go through a finer table
(``FINE`` blocks), and those of cells that are still hot are joined exactly: x and y are within 3 bits if and
only if some z is within 2 bits of x and 1 of y, so that a join on z finds the same components from a fixed
number of rows per fingerprint. A task hands on a spanning forest of its links, and the components come from
alternating large-star and small-star rounds, each written to the shared folder.

Defined results: null, empty and blank texts have fingerprint zero, which links like any other; fewer than
3 words are one shingle; a null id never is a component's id unless all its ids are null; repeated rows
fall into one component, of which one row stays; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_scan, checked, clear_of, located, maybe_broadcast, per_text, removed, scoped, written

SHINGLE, SEED, BITS = 3, 42, 3
#: Reference fingerprints of a block, blocks of the finer table, and the most fingerprints of a cell that are compared pair by pair.
REFERENCES, FINE, HOT = 8, 10, 4096
BROADCAST_ROWS = 100_000
#: Shingles whose bits are counted at once.
LANE_ROWS = 255
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words; fewer words are one run, and none give nothing."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; 0 for one without words."""
    h = shingle_hashes(text, SHINGLE)
    return _majority(h) if len(h) else 0


def _majority(h: np.ndarray) -> int:
    """Bits set in over half of the hashes: eight counters of a byte each are added at once in a 64-bit lane."""
    n, out = len(h), 0
    padded = np.zeros(-(-n // LANE_ROWS) * LANE_ROWS, np.uint64)
    padded[:n] = h
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & LANES).reshape(-1, LANE_ROWS).sum(axis=1, dtype=np.uint64)
        counts = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for byte in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * byte + bit)
    return out


def fingerprints(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with the text replaced by ``fp`` bigint (the fingerprint's 64 bits)."""
    return per_text(
        rows,
        text_col,
        {"fp": ("bigint", pa.int64())},
        lambda: lambda texts: {"fp": np.array(list(map(fingerprint, texts)), np.uint64).view(np.int64)},
    )


def block_plan(n: int) -> int:
    """Blocks of the fingerprint, so that a cell by chance holds few of ``n`` (a block tells at least one bit less than it has)."""
    return next((blocks for blocks in (5, 6, 7) if n <= 2 ** ((64 // blocks - 1) * (blocks - BITS) + 1)), 7)


@functools.lru_cache(maxsize=8)
def references(blocks: int) -> list[tuple[int, list[int]]]:
    """For each block its mask and its reference fingerprints, which are zero elsewhere."""
    rng, edges = random.Random(64), [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [(m, [rng.getrandbits(64) & m for _ in range(REFERENCES)]) for m in masks]


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def cells(fps: DataFrame, blocks: int) -> DataFrame:
    """(cell, fp): one cell per choice of blocks, the hash of the choice's number and of the coordinates to all references of these blocks."""
    fp, tables = F.col("fp"), []
    for mask, own in references(blocks):
        # four bits for each coordinate, as no block has more than 15 bits
        parts = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(r))).bitwiseAND(F.lit(_signed(mask)))).cast("bigint") for r in own]
        tables.append(functools.reduce(lambda a, c: F.shiftleft(a, 4).bitwiseOR(c), parts).alias(f"t{len(tables)}"))
    chosen = itertools.combinations(range(blocks), blocks - BITS)
    keys = F.array(*[F.xxhash64(F.lit(k), *[F.col(f"t{c}") for c in some]) for k, some in enumerate(chosen)])
    return fps.select("fp", *tables).select(F.explode(keys).alias("cell"), "fp")


def distance_table(fp: np.ndarray, blocks: int) -> np.ndarray:
    """(fingerprint, block, reference): the distances over the reference's block."""
    masks = np.array([m for m, _ in references(blocks)], np.uint64)
    points = np.array([own for _, own in references(blocks)], np.uint64)
    return np.bitwise_count((fp[:, None, None] ^ points[None]) & masks[None, :, None]).astype(np.int8)


class Forest:
    """Links that join two trees; others are known already."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (parent := up.get(x, x)) != x:
            up[x] = x = up.get(parent, parent)
        return x

    def joins(self, x: int, y: int) -> bool:
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def close_pairs(cell: np.ndarray, fp: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of rows of one cell within BITS bits; rows are sorted by cell."""
    table = distance_table(fp, blocks)
    found, live, lag = [], np.arange(len(fp)), 0
    while len(live):
        lag += 1
        live = live[live + lag < len(fp)]
        live = live[cell[live] == cell[live + lag]]
        apart = np.abs(table[live] - table[live + lag]).max(axis=2).sum(axis=1, dtype=np.int64)
        near = live[apart <= BITS]
        near = near[np.bitwise_count(fp[near] ^ fp[near + lag]) <= BITS]
        found.append((near, near + lag))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _cell_links(hot: int, blocks: int):
    """For rows sorted by cell: (a, b) links, or (a, null) for each fingerprint of a hot cell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest()
        held_b, held_f, hot_cell = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def told(b: np.ndarray, f: np.ndarray):
            i, j = close_pairs(b, f, blocks)
            pairs = [(x, y) for x, y in zip(f[i].view(np.int64).tolist(), f[j].view(np.int64).tolist(), strict=True) if forest.joins(x, y)]
            return pd.DataFrame({"a": np.array([p[0] for p in pairs], np.int64), "b": pd.array([p[1] for p in pairs], "Int64")})

        def handed(f: np.ndarray):
            return pd.DataFrame({"a": f.view(np.int64), "b": pd.array([None] * len(f), "Int64")})

        for batch in batches:
            b = np.concatenate((held_b, batch["cell"].to_numpy(np.int64)))
            f = np.concatenate((held_f, batch["fp"].to_numpy(np.int64).view(np.uint64)))
            if not len(b):
                continue
            # the last cell of the batch may go on in the next one
            first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            sizes = np.diff(np.concatenate((first, [len(b)])))
            is_hot = sizes > hot
            if hot_cell is not None and b[0] == hot_cell:
                is_hot[0] = True
            mask = np.repeat(is_hot, sizes)
            if mask.any():
                yield handed(f[mask])
            hot_cell = b[-1] if mask[-1] else None
            cut = first[-1] if not mask[-1] else len(b)
            done = np.flatnonzero(~mask[:cut])
            if len(done):
                yield told(b[done], f[done])
            held_b, held_f = (b[cut:], f[cut:]) if not mask[-1] else (b[:0], f[:0])
        if len(held_b):
            yield told(held_b, held_f)

    return run


def _masks(bits: int) -> list[int]:
    """All 64-bit words with at most ``bits`` bits set, as signed numbers."""
    words = [sum(1 << i for i in c) for k in range(bits + 1) for c in itertools.combinations(range(64), k)]
    return [_signed(w) for w in words]


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) with the components of all pairs within 3 bits, from a fixed number of rows per fingerprint."""
    around = lambda bits: fps.select(
        "fp",
        F.explode(F.from_json(F.lit(json.dumps(_masks(bits))), "array<bigint>")).alias("m"),
    ).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    centres = around(1).groupBy("z").agg(F.min("fp").alias("b"))
    return around(2).join(centres, "z").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def links(distinct_fps: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within 3 bits."""
    spark = distinct_fps.sparkSession
    parts, found = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // 200_000)), None
    for blocks in (block_plan(n), FINE):
        rows = cells(distinct_fps, blocks).repartition(parts, "cell").sortWithinPartitions("cell")
        told = written(rows.mapInPandas(_cell_links(hot, blocks), "a bigint, b bigint"), "simhash-links")
        sure = told.where("b is not null")
        found = sure if found is None else found.unionByName(sure)
        crowded = told.where("b is null")
        if crowded.isEmpty():
            return found
        distinct_fps = written(crowded.select(F.col("a").alias("fp")).distinct(), "simhash-crowded")
    return found.unionByName(written(ball_links(distinct_fps), "simhash-balls"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b); root is the component's smallest node.

    A node with very many neighbours is a hot key of the joins; its table of minima is written (or broadcast, if small),
    so that Spark can split what it is joined with.
    """
    spark = edges.sparkSession
    pairs = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "simhash-edges")
    size, mark = pairs.count(), None
    table = (lambda df: F.broadcast(df)) if size <= BROADCAST_ROWS else (lambda df: written(df, "simhash-low"))
    while True:
        # large star: neighbours above a node go to its smallest neighbour
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its neighbours below go to the smallest of them
        low = table(large.groupBy("a").agg(F.min("b").alias("m")))
        below = F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
        small = large.join(low, "a").select(F.explode(below).alias("e")).select("e.*").where("a <> b").distinct()
        new = written(small, "simhash-stars")
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        removed(spark, pairs.scratch)
        pairs = new
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per row of ``docs``: id, ``fp``, ``component_id`` and the row's locator ``__at``."""
    rows = located(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    prints = written(fingerprints(rows), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    edges = links(distinct.select("fp"), distinct.count(), hot)
    # fingerprints of several rows, or with links; the others' component is the row itself
    table = distinct.where("n > 1").select("fp", F.col("low").alias("component_id"))
    if not edges.isEmpty():
        member = written(distinct.join(components(edges).withColumnRenamed("node", "fp"), "fp"), "simhash-members")
        lowest = maybe_broadcast(member.groupBy("root").agg(F.min("low").alias("component_id")), "simhash-lowest", BROADCAST_ROWS)
        linked = written(member.join(lowest, "root").select("fp", "component_id"), "simhash-linked")
        table = table.join(linked.select("fp"), "fp", "left_anti").unionByName(linked)
    table = maybe_broadcast(table.withColumn("__of_many", F.lit(True)), "simhash-table", BROADCAST_ROWS)
    own = F.when(F.col("__of_many"), F.col("component_id")).otherwise(F.col("id"))
    return prints.join(table, "fp", "left").select("fp", "id", "__at", own.alias("component_id"))


def without_others(docs: DataFrame, make) -> DataFrame:
    """``docs`` (a scan) without all but one row of each ``g`` of the rows (id, __at, g) that ``make`` returns: the smallest id, at the smallest locator, stays."""
    spark = docs.sparkSession

    def gone() -> DataFrame:
        rows = written(make(), "rows")
        first = rows.groupBy("g").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id"), F.col("__at"))).alias("first"))
        # places are unique, so that no group makes a hot key
        return rows.select("__at").join(first.select(F.col("first.__at").alias("__at")), "__at", "left_anti")

    return located(docs).join(checked(scoped(spark, "gone", gone), BROADCAST_ROWS), "__at", "left_anti").drop("__at")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: its smallest doc_id, at the smallest locator, stays."""
    docs = as_scan(clear_of(docs, "__at"))
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    return without_others(docs, lambda: near_duplicates(docs).select("id", "__at", group.alias("g")))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op8."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
