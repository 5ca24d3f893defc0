"""Benchmark decontamination by winnowing.

The hash of every ``K``-gram of words is taken, and of each ``WINDOW`` consecutive ones the smallest is kept
(the last of equals). A span of ``K + WINDOW - 1`` = 10 words that a document shares with a benchmark item has
one whole window of such hashes, so both sides keep the same one: every span that long is found. The kept
hashes of the documents are looked up among those of the benchmark; each match is extended word by word to
both sides, and a run of 10 words or more is a hit. An item of fewer than 10 words is one window by itself;
its hash is looked up at every position, which winnowing with a window of 1 would keep.

The benchmark is broadcast in blocks of ``BLOCK_BYTES`` of text at most (or one item); the usual benchmark is one block.
With more, the documents are scanned once per block and the hits of a document are merged afterwards.
A document's matches stay in its task, so that a passage which very many documents share makes no large group.

Defined results: null, empty and wordless texts have no words and no hits; wordless items are no items; items
of the same id count once, those of a null id hit words but have no id to report; repeated rows are judged one by one;
an empty benchmark leaves all documents clean; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_scan, checked, clear_of, located, per_text, scoped, written

#: Words of a k-gram, hashes of a winnowing window, and words of a span that is always found.
K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
BLOCK_BYTES = 16 << 20
#: Words, of usual length, that a task remembers the hashes of.
MEMO_WORDS, MEMO_LENGTH = 300_000, 64
BROADCAST_ROWS = 100_000

#: Bytes of words stay, A-Z become a-z, others become a space: word bytes are 0-9, a-z and all beyond ASCII.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Hashes(dict):
    """Word -> 64-bit hash, remembered for words of usual length."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[j : j + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def winnow(v: np.ndarray, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions of the smallest value of each window of WINDOW values (last of equals); ``valid``: which windows count."""
    n = len(v) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64)
    at, low = np.zeros(n, np.int64), v[:n].copy()
    for d in range(1, WINDOW):
        other = v[d : d + n]
        less = other <= low
        at[less] = d
        np.minimum(low, other, out=low)
    at += np.arange(n)
    return np.unique(at if valid is None else at[valid[:n]])


class Index:
    """The fingerprints of a block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str]]):
        hashes = Hashes()
        self.ids, self.words, long, short = [], [], [], defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            number = len(self.ids)
            self.ids.append(item_id)
            self.words.append(words)
            h = np.fromiter((hashes[w] for w in words), np.uint64, len(words))
            if len(words) < SPAN:
                short[len(words)].append((int(gram_hashes(h, len(words))[0]), number, 0))
            else:
                grams = gram_hashes(h, K)
                long += [(int(grams[q]), number, int(q)) for q in winnow(grams)]
        self.long = self._table(long)
        self.short = {k: self._table(v) for k, v in sorted(short.items())}

    @staticmethod
    def _table(rows: list[tuple[int, int, int]]):
        """Sorted distinct hashes, and for each the list of (item number, position)."""
        places = defaultdict(list)
        for value, number, q in rows:
            places[value].append((number, q))
        keys = sorted(places)
        return np.array(keys, np.uint64), [places[k] for k in keys]


def _found(table, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``values`` that are in the table, and their places in it."""
    keys = table[0]
    if not len(keys) or not len(values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    hit = np.flatnonzero(keys[at] == values)
    return hit, at[hit]


def _extended(doc: list[bytes], item: list[bytes], p: int, q: int) -> tuple[int, int]:
    """The longest run of equal words around doc[p] and item[q], as [start, end) in the document; empty if they differ."""
    a, b = p, q
    while a > 0 and b > 0 and doc[a - 1] == item[b - 1]:
        a, b = a - 1, b - 1
    e, f = p, q
    while e < len(doc) and f < len(item) and doc[e] == item[f]:
        e, f = e + 1, f + 1
    return a, e


def scanned(texts: list[str | None], index: Index, hashes: Hashes) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: number of words, hit runs [start, end) in order of discovery, numbers of the items that occur."""
    docs = [words_of(t) for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = np.fromiter((hashes[w] for d in docs for w in d), np.uint64, int(sizes.sum()))
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    left = ends[doc_of] - np.arange(len(h))  # words from here to the end of the document
    out = [(len(d), [], []) for d in docs]
    known: dict[tuple[int, int, int], int] = {}
    grams = gram_hashes(h, K)
    kept = winnow(grams, left >= SPAN)
    hit, place = _found(index.long, grams[kept])
    for p, k in zip(kept[hit].tolist(), place.tolist(), strict=True):
        d = int(doc_of[p])
        p -= int(starts[d])
        for number, q in index.long[1][k]:
            if known.get((d, number, p - q), -1) > p:
                continue  # inside a run that is known
            a, e = _extended(docs[d], index.words[number], p, q)
            known[d, number, p - q] = max(e, p + 1)
            if e - a >= SPAN:
                out[d][1].append((a, e))
                out[d][2].append(number)
    for k, table in index.short.items():
        values = gram_hashes(h, k)
        hit, place = _found(table, values)
        for p, t in zip(hit.tolist(), place.tolist(), strict=True):
            if left[p] < k:
                continue
            d = int(doc_of[p])
            p -= int(starts[d])
            for number, _ in table[1][t]:
                if docs[d][p : p + k] == index.words[number]:
                    out[d][1].append((p, p + k))
                    out[d][2].append(number)
    return out


def merged_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, e in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([a, e])
    return [tuple(x) for x in out]


HITS = {"n_words": ("bigint", pa.int64()), "runs": ("array<array<bigint>>", pa.list_(pa.list_(pa.int64()))), "items": ("array<string>", pa.list_(pa.string()))}


def _scan(rows: DataFrame, index, text_col: str) -> DataFrame:
    """``rows`` with the text replaced by the columns of HITS."""
    memo = {}

    def make():
        table, hashes = index.value, memo.setdefault("hashes", Hashes())

        def run(texts: list[str]) -> dict:
            found = scanned(texts, table, hashes)
            return {
                "n_words": [x[0] for x in found],
                "runs": [[list(r) for r in merged_runs(x[1])] for x in found],
                "items": [sorted({table.ids[n] for n in x[2] if table.ids[n] is not None}) for x in found],
            }

        return run

    return per_text(rows, text_col, HITS, make)


def benchmark_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The distinct items in blocks of about ``block_bytes`` of text."""
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null").distinct()
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-n_bytes // block_bytes))
    return [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b) if blocks > 1 else items for b in range(blocks)]


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, locator ``__at``, n_words, runs (hit words, [start, end)), items (sorted ids)."""
    rows = located(as_scan(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    context, parts = docs.sparkSession.sparkContext, []
    blocks = benchmark_blocks(benchmark, block_bytes=block_bytes)
    for block in blocks:
        index = context.broadcast(Index([tuple(r) for r in block.collect()]))
        part = _scan(rows, index, "text")
        if len(blocks) == 1:
            return part
        if not parts:
            counts = written(part.select("__at", "id", "n_words", "runs", "items"), "winnow-first")
            part = counts
        parts.append(written(part.where(F.size("runs") > 0).select("__at", "runs", "items"), "winnow-hits"))
        index.destroy()
    all_rows, found = counts.select("__at", "id", "n_words"), functools.reduce(DataFrame.unionByName, parts)
    found = found.groupBy("__at").agg(
        F.flatten(F.collect_list("runs")).alias("all"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    step = F.aggregate(
        F.array_sort("all"),
        F.array().cast("array<array<bigint>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (r[0] <= F.get(F.element_at(done, -1), F.lit(1))),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], r[1]))),
            ),
        ).otherwise(F.concat(done, F.array(r))),
    )
    found = found.select("__at", step.alias("runs"), "items")
    none = F.array().cast("array<string>")
    return all_rows.join(found, "__at", "left").select(
        "id",
        "__at",
        "n_words",
        F.coalesce("runs", F.array().cast("array<array<bigint>>")).alias("runs"),
        F.coalesce("items", none).alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark."""
    docs = as_scan(clear_of(docs, "__at"))
    bad = checked(scoped(docs.sparkSession, "contaminated", lambda: hits(docs, benchmark).where(F.size("runs") > 0).select("__at")), BROADCAST_ROWS)
    return located(docs).join(bad, "__at", "left_anti").drop("__at")


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op9."""
    found = hits(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r[1] - r[0])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated"),
    )


def by_hand(text: str | None, items: list[tuple[str, str]]) -> tuple[int, int, int, str]:
    """Plain version for tests: (n_words, n_hit, n_items, items_sha256)."""
    doc, hit, seen = words_of(text), set(), set()
    for item_id, item in items:
        words = words_of(item)
        size = min(SPAN, len(words))
        for q in range(len(words) - size + 1) if words else ():
            for p in range(len(doc) - size + 1):
                if doc[p : p + size] == words[q : q + size]:
                    hit.update(range(p, p + size))
                    seen.add(item_id)
    return len(doc), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()


#: The same windows in DuckDB's SQL.
ORACLE = r"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
        FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0))),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, ks WHERE len(w) >= k),
occ AS (SELECT p.doc_id, p.i, p.k, n.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM pos) p JOIN win n ON p.k = n.k AND p.g = n.g),
cov AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS spot FROM occ) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
