"""Near copies by word shingles: sketches propose pairs, the shingle sets decide.

Two texts are near copies if the sets of their 5-word shingles have a Jaccard similarity of at least 0.8; what such
pairs connect is one component. Texts of equal sets are one node from then on. Pairs are proposed by two sketches:

* the SimHash fingerprints of the 5-word shingles, linked by the pivot distance tables of :mod:`.simhash` at 3 bits.
  This finds copies with few changes. Similarity 0.8 moves about 10 of 64 bits, and no pivot discards anything at
  that radius (coordinates of unrelated fingerprints differ by 6 as a rule), so that it can't be the only net;
* MinHash: a byte of each of 400 minima; nodes with equal bytes in one of 20 bands of 5 share a bucket. A pair of
  similarity 0.8 shares no bucket with probability (1 - 0.8^5)^20 = 0.0004, and a more similar one with less. A pair
  is likely if its sketches agree in ``LIKELY`` of the bytes (a pair of similarity 0.8 fails that with 0.0013, one of 0.82 with 0.00002).

Likely pairs are verified by their sets: first every node of a bucket with the bucket's lead, the node with the most
neighbours (the two most likely ones of its buckets), which joins large groups of copies around their original, then
the likely pairs of nodes that are still in different components, the likeliest of each component first and ever
more of them, until none is left untried. No pair of lower similarity is ever linked.

No group comes together in a task: the nodes of a bucket's largest component are dealt over tasks, and the others of
that bucket, few as a rule, go to each of these. A verifying task holds the set of one text, which is repeated for
parts of its partners, and one batch of these.

Defined results: null, empty and blank texts have no shingles and are copies of each other; fewer than 5 words are
one shingle; repeated rows are copies; of rows with and without an id the one with an id stays.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_scan, checked, clear_of, located, maybe_broadcast, per_text, written
from .simhash import BROADCAST_ROWS, _majority, components, links, shingle_hashes, without_others

SHINGLE, SIMILAR = 5, 0.8
BANDS, BAND_ROWS, MINIMA = 20, 5, 400
#: Share of equal sketch bytes from which a pair is looked at: three standard deviations below ``SIMILAR``.
LIKELY = 0.74
#: Shingles whose minima are taken at once; partners of a text that one task compares with it.
LANE, PARTNERS = 1024, 64
#: Rows of a bucket that one task compares the others with.
PART = 256
#: Pairs of a component and a bucket that are tried in the first round, and how many times more in each further one.
TRIES, MORE = 2, 8


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


@functools.lru_cache(maxsize=1)
def _maps() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(80)
    flips, factors = rng.integers(0, 1 << 64, (2, MINIMA), dtype=np.uint64)
    return flips[:, None], (factors | np.uint64(1))[:, None]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte of the minimum of each map over the set."""
    flips, factors = _maps()
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), LANE):
        np.minimum(least, ((hashes[None, k : k + LANE] ^ flips) * factors).min(axis=1), out=least)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least SIMILAR."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < SIMILAR * len(b) - 1e-9:
        return False
    common = int((b[np.minimum(b.searchsorted(a), len(b) - 1)] == a).sum())
    return common >= SIMILAR * (len(a) + len(b) - common) - 1e-9


SKETCH = {"node": ("bigint", pa.int64()), "fp": ("bigint", pa.int64()), "sketch": ("binary", pa.binary())}


def _sketched(texts: list[str]) -> dict:
    out: dict[str, list] = {name: [] for name in SKETCH}
    for text in texts:
        hashes = shingle_hashes(text, SHINGLE)
        own = np.unique(hashes)
        out["node"].append(xxhash.xxh64_intdigest(own.tobytes()))
        out["fp"].append(_majority(hashes) if len(hashes) else 0)
        out["sketch"].append(sketch(own).tobytes() if len(own) else None)
    return out | {name: np.array(out[name], np.uint64).view(np.int64) for name in ("node", "fp")}


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, MINIMA)


def _agreeing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) with their sketches -> the likely ones, with the number of equal bytes."""
    for p in batches:
        agree = (_matrix(list(p["sa"])) == _matrix(list(p["sb"]))).sum(axis=1)
        likely = agree >= LIKELY * MINIMA
        yield pd.DataFrame({"a": p["a"].to_numpy(np.int64)[likely], "b": p["b"].to_numpy(np.int64)[likely], "agree": agree[likely]})


def _checked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (b, salt), the text of b itself first (``lead``) -> the pairs that are alike."""
    now, own = None, np.empty(0, np.uint64)
    for p in batches:
        out = []
        for a, b, lead, text in zip(p["a"].tolist(), p["b"].tolist(), p["lead"].tolist(), p["text"], strict=True):
            if lead:
                if b != now:
                    now, own = b, shingle_set(text)
            elif alike(shingle_set(text), own):
                out.append((a, b))
        yield pd.DataFrame({"a": np.array([x[0] for x in out], np.int64), "b": np.array([x[1] for x in out], np.int64)})


def _groups_of(batches: Iterator[pd.DataFrame], by: str) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``by``, group by group."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        key = b[by].to_numpy()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist()
        for at, end in zip(first, [*first[1:], len(b)], strict=True):
            part = b.iloc[at:end]
            if held and held[0][by].iloc[0] != key[at]:
                yield pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)


def _across(tries: int):
    """Rows of one part of a bucket -> for each component but the bucket's largest its likeliest pairs with others.

    A part holds all rows of the smaller components and some of the largest (``big``); the first part also compares the smaller
    ones among themselves. Of the buckets that two nodes share only that of the first band proposes the pair.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups_of(batches, "part"):
            node, big, rows = g["node"].to_numpy(np.int64), g["big"].to_numpy(bool), _matrix(list(g["sketch"]))
            _, label = np.unique(g["label"].to_numpy(np.int64), return_inverse=True)
            open_to = np.ones(len(node), bool) if g["first"].iloc[0] else big
            band, bands = int(g["band"].iloc[0]), rows[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS)
            pairs: dict[int, list[tuple[int, int, int]]] = {}
            for i in np.flatnonzero(~big).tolist():
                agree = (rows == rows[i]).sum(axis=1)
                likely = np.flatnonzero(open_to & (agree >= LIKELY * MINIMA) & (label != label[i]))
                shared = (bands[likely, :band] == bands[i, :band]).all(axis=2).any(axis=1)
                for j in likely[~shared].tolist():
                    pairs.setdefault(int(label[i]), []).append((-int(agree[j]), i, j))
            chosen = [(p, len(found) > tries) for found in pairs.values() for p in heapq.nsmallest(tries, found)]
            ends = np.array([p[1:] for p, _ in chosen], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"a": node[ends[:, 0]], "b": node[ends[:, 1]], "more": np.array([m for _, m in chosen], bool)})

    return run


class Copies:
    """The nodes of a corpus and the links between them."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark = docs.sparkSession
        self.docs = located(as_scan(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
        self.prints = written(per_text(self.docs, "text", SKETCH, lambda: _sketched), "copies-prints")
        # a node's text is that of any of its rows: an exact copy, or one with the same shingles
        one = self.prints.where("sketch is not null").groupBy("node").agg(F.min(F.struct("__at", "fp", "sketch")).alias("s"))
        self.nodes = written(one.select("node", "s.__at", "s.fp", "s.sketch"), "copies-nodes")
        self.parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.nodes.count() // 20_000))

    def by_fingerprints(self) -> DataFrame:
        """Pairs (a, b) whose fingerprints are equal or linked, as a forest."""
        first = written(self.nodes.groupBy("fp").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")), "copies-prints-of")
        many = maybe_broadcast(first.where("n > 1").select("fp", "b"), "copies-prints-many", BROADCAST_ROWS)
        equal = self.nodes.select("fp", F.col("node").alias("a")).join(many, "fp").where("a <> b").select("a", "b")
        found = links(first.select("fp"), first.count())
        ends = first.select("fp", F.col("b").alias("node"))
        linked = found.join(
            ends.select(F.col("fp").alias("a"), F.col("node").alias("x")),
            "a",
        ).join(ends.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b")
        return equal.unionByName(linked.select(F.col("x").alias("a"), F.col("y").alias("b")))

    def crowd(self) -> DataFrame:
        """(bucket, node, lead) of all buckets of more than one node; the lead has the most neighbours in all its buckets."""
        band = lambda k: F.conv(F.hex(F.substring("sketch", k * BAND_ROWS + 1, BAND_ROWS)), 16, 10).cast("bigint") + F.lit(k << (8 * BAND_ROWS))
        rows = self.nodes.select(F.explode(F.array(*map(band, range(BANDS)))).alias("bucket"), "node")
        many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = written(rows.join(maybe_broadcast(many, "copies-many", BROADCAST_ROWS), "bucket"), "copies-rows-of-many")
        weight = maybe_broadcast(rows.groupBy("node").agg(F.sum("n").alias("w")), "copies-weight", BROADCAST_ROWS)
        leads = rows.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("w", "node"))["node"].alias("lead"))
        return written(rows.join(maybe_broadcast(leads, "copies-leads", BROADCAST_ROWS), "bucket").select("bucket", "node", "lead"), "copies-crowd")

    def likeliest(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) the two for each a whose sketches agree most, if they are likely."""
        own = self.nodes.select("node", "sketch")
        both = pairs.join(
            own.select(F.col("node").alias("a"), F.col("sketch").alias("sa")),
            "a",
        ).join(own.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
        agree = both.select("a", "b", "sa", "sb").mapInPandas(_agreeing, "a bigint, b bigint, agree bigint")
        best = agree.groupBy("a").agg(F.slice(F.sort_array(F.collect_set(F.struct("agree", "b")), False), 1, 2).alias("best"))  # at most one pair per band
        return best.select("a", F.explode("best.b").alias("b"))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) whose shingle sets are alike."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        places = maybe_broadcast(ends.join(self.nodes.select("node", "__at"), "node"), "copies-places", BROADCAST_ROWS)
        texts = written(self.docs.select("__at", "text").join(places, "__at").select("node", "text"), "copies-texts")
        hot = pairs.groupBy("b").count().where(F.col("count") > PARTNERS).select("b", F.ceil(F.col("count") / PARTNERS).cast("int").alias("salts"))
        salted = pairs.join(maybe_broadcast(hot, "copies-hot", BROADCAST_ROWS), "b", "left").select(
            "a",
            "b",
            F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
        )
        salted = written(salted, "copies-salted")
        members = salted.join(texts.select(F.col("node").alias("a"), "text"), "a").select("a", "b", "salt", F.lit(False).alias("lead"), "text")
        leads = salted.select("b", "salt").distinct().join(texts.select(F.col("node").alias("b"), "text"), "b").select(
            F.col("b").alias("a"),
            "b",
            "salt",
            F.lit(True).alias("lead"),
            "text",
        )
        rows = members.unionByName(leads).repartition(self.parts, "b", "salt").sortWithinPartitions("b", "salt", F.desc("lead"))
        return written(rows.select("a", "b", "lead", "text").mapInPandas(_checked, "a bigint, b bigint"), "copies-verified")

    def untried(self, crowd: DataFrame, roots: DataFrame, tries: int) -> DataFrame:
        """Likely pairs (a, b, more) of different components, by parts of buckets."""
        label = crowd.join(checked(roots, BROADCAST_ROWS), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("label"))
        sizes = label.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = sizes.groupBy("bucket").agg(
            F.max(F.struct("n", "label"))["label"].alias("largest"),
            F.sum("n").alias("n"),
            F.count(F.lit(1)).alias("labels"),
        ).where("labels > 1")
        rows = label.join(maybe_broadcast(mixed, "copies-mixed", BROADCAST_ROWS), "bucket").withColumns({
            "big": F.col("label") == F.col("largest"),
            "salts": F.ceil(F.col("n") / PART).cast("int"),
        })
        every = F.sequence(F.lit(0), F.col("salts") - 1)
        rows = rows.withColumn("salt", F.explode(F.when(F.col("big"), F.array(F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))).otherwise(every)))
        rows = rows.join(self.nodes.select("node", "sketch"), "node").select(
            F.xxhash64("bucket", "salt").alias("part"),
            F.shiftright("bucket", 8 * BAND_ROWS).cast("int").alias("band"),
            (F.col("salt") == 0).alias("first"),
            "node",
            "label",
            "big",
            "sketch",
        )
        return rows.repartition(self.parts, "part").sortWithinPartitions("part").mapInPandas(_across(tries), "a bigint, b bigint, more boolean")

    def labels(self) -> DataFrame:
        """(node, root) of the nodes that have links."""
        crowd = self.crowd()
        pairs = self.likeliest(crowd.where("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
        ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        first = written(pairs.unionByName(self.by_fingerprints()).distinct(), "copies-pairs")
        sure, tried, tries = self.verified(first), written(ordered(first), "copies-tried"), TRIES
        while True:
            roots = written(components(sure), "copies-roots")
            found = written(self.untried(crowd, roots, tries), "copies-across")
            new = written(ordered(found).join(tried, ["a", "b"], "left_anti"), "copies-new")
            right = None if new.isEmpty() else self.verified(new)
            if right is not None and not right.isEmpty():
                sure, roots = written(sure.unionByName(right), "copies-sure"), None
            if found.where("more").isEmpty():
                return written(components(sure), "copies-roots") if roots is None else roots
            tried, tries = written(tried.unionByName(new), "copies-tried"), tries * MORE

    def told(self) -> DataFrame:
        roots = checked(self.labels(), BROADCAST_ROWS)
        return self.prints.select("id", "__at", "node").join(roots, "node", "left").select("id", "__at", F.coalesce("root", "node").alias("g"))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, the row's locator ``__at``, and ``g``, the same for the rows of a component."""
    return Copies(docs, id_col, text_col).told()


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component: its smallest doc_id, at the smallest locator, stays."""
    docs = as_scan(clear_of(docs, "__at"))
    return without_others(docs, lambda: groups(docs))
