"""Toxic spans by a linear-chain conditional random field.

Training (bounded, on the driver): labelled documents, as many toxic as clean ones up to ``TRAIN_DOCS`` of
each and of at most ``TRAIN_CHARS`` characters, in order of a hash of their id. A token of a toxic document gets
a soft label: the share of the occurrences of its features (word, prefixes) there that is more than their rate in
clean documents explains; all other tokens get label 0. A two-state CRF is fitted to windows of these tokens
by gradient ascent on the conditional likelihood. A logistic calibration from what a document's marginals
come to (largest, expected number and share of toxic words) to the document's label is then fitted on the same documents.

Scoring: forward-backward over all words of the whole text. The two-state recursions are products of 2 x 2
matrices; all texts of a batch are one chain that restarts at each text, cut into chunks of equal length,
whose products are composed by a prefix scan. So a very long text takes no more steps than short ones.
Inputs of a score are the text's words alone; spans are offsets in the text as it is. Fixed seeds and orders make the model the same in every run.

Defined results: null, empty and wordless texts get the score of a document without toxic words; with fewer
than one labelled document of each class all documents score 0; repeated rows get equal scores; an empty
table gives no rows; input columns named like the added ones are replaced.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, per_text

#: Bounds of the training sample: documents of each class, characters of a document.
TRAIN_DOCS, TRAIN_CHARS = 1200, 10_000
#: Words of a training window to each side, passes, step, weight decay, and the least weight that is kept.
CONTEXT, PASSES, STEP, DECAY, LEAST_WEIGHT = 12, 8, 0.3, 1e-4, 0.02
#: A feature marks tokens if so many toxic documents hold it, with such log odds of its rates and such a likelihood ratio.
SUPPORT, ODDS, GAIN = 3, 2.0, 24.0
THRESHOLD = 0.3
#: Marginals from which on a word is counted, and the share of toxic words that is told from none.
COUNTED, LEAST_SHARE = 0.3, 0.002
CHUNK, MEMO_WORDS, MEMO_LENGTH = 64, 300_000, 64
WORD = re.compile(r"\w+")
PREFIXES = (4, 5, 6, 7)


def features(word: str) -> list[str]:
    return ["w" + word, *(f"{n}{word[:n]}" for n in PREFIXES if len(word) > n)]


def _products(m: np.ndarray, backwards: bool = False) -> np.ndarray:
    """Running products over the first axis of 2 x 2 matrices (n, 2, 2), each scaled; later ones stand on the left.

    ``backwards``: the products run from the end, later ones standing on the right.
    """
    if backwards:
        return _products(m[::-1].transpose(0, 2, 1))[::-1].transpose(0, 2, 1)
    n = len(m)
    width = -(-n // CHUNK)
    padded = np.empty((width * CHUNK, 2, 2))
    padded[:n], padded[n:] = m, np.eye(2)
    cells = padded.reshape(width, CHUNK, 2, 2).transpose(1, 2, 3, 0)  # step, row, column, chunk
    out = np.empty((CHUNK, 2, 2, width))
    out[0] = cells[0]
    for k in range(1, CHUNK):
        out[k] = _times(cells[k], out[k - 1])
    total, reach = out[-1].copy(), 1
    while reach < width:  # inclusive prefix scan over the chunks
        total[..., reach:] = _times(total[..., reach:], total[..., :-reach])
        reach *= 2
    before = np.empty_like(total)
    before[..., 0], before[..., 1:] = np.eye(2), total[..., :-1]
    for k in range(CHUNK):
        out[k] = _times(out[k], before)
    return out.transpose(3, 0, 1, 2).reshape(-1, 2, 2)[:n]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices along the last axis, scaled to a largest entry of 1."""
    c = np.empty(np.broadcast_shapes(a.shape, b.shape))
    for i in range(2):
        for j in range(2):
            c[i, j] = a[i, 0] * b[0, j] + a[i, 1] * b[1, j]
    return c / c.max(axis=(0, 1))


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """P(label 1) of each token by forward-backward.

    unary: log potentials of label 1; first: positions where texts begin; trans[i, j]: log potential of j after i;
    start: log potentials of the first label.
    """
    n = len(unary)
    if not n:
        return np.empty(0)
    e = np.exp(np.clip(unary, -30, 30))
    a = np.exp(trans)
    m = np.empty((n, 2, 2))
    m[:, 0, 0], m[:, 0, 1] = a[0, 0], a[1, 0]
    m[:, 1, 0], m[:, 1, 1] = e * a[0, 1], e * a[1, 1]
    m[first, 0, :] = np.exp(start[0])
    m[first, 1, :] = (e[first] * np.exp(start[1]))[:, None]
    alpha = _products(m).sum(axis=2)  # any vector from before the first text is forgotten there
    # beta before the potentials of the token itself: m_{t+1}^T ... ; it restarts where the next text begins
    nxt = np.empty((n, 2, 2))
    nxt[:-1], nxt[-1] = m[1:], 1.0
    nxt[first[1:] - 1] = 1.0
    beta = _products(nxt, backwards=True).sum(axis=1)
    p = alpha * beta
    return p[:, 1] / p.sum(axis=1)


@dataclass
class Crf:
    """Weights of the two-state chain and of the calibration."""

    weights: dict[str, float]
    trans: np.ndarray
    start: np.ndarray
    bias: float = 0.0
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(4))
    known: bool = True

    def potential(self, word: str) -> float:
        get = self.weights.get
        total = self.bias + get("w" + word, 0.0)
        for n in PREFIXES:
            if len(word) <= n:
                break
            total += get(f"{n}{word[:n]}", 0.0)
        return total


def unlike(docs: list[tuple[list[str], int]]) -> list[tuple[list[str], int]]:
    """The documents without near copies of earlier ones (an equal minimum of one of four hashes of word pairs)."""
    seen: set[tuple] = set()
    out = []
    for words, y in docs:
        pairs = {zlib.crc32(f"{a} {b}".encode("utf-8", "surrogatepass")) for a, b in zip(words, words[1:], strict=False)}
        keys = {(y, k, min((h * m) & 0xFFFFFFFF for h in pairs)) for k, m in enumerate((1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))} if pairs else {(y, *words)}
        if not keys & seen:
            out.append((words, y))
        seen |= keys
    return out


def _gain(k1: int, n1: int, k0: int, n0: int) -> float:
    """Likelihood ratio statistic of two counts against one common rate."""
    rate = (k1 + k0) / (n1 + n0)
    part = lambda k, n: k * math.log(k / (n * rate)) if k else 0.0
    return 2 * (part(k1, n1) + part(k0, n0))


def marks(docs: list[tuple[list[str], int]]) -> dict[str, float]:
    """Features that are more frequent in toxic documents, each with the share of its tokens there that is excess.

    Tokens are counted once per context, the pair of words around them, so that copied passages don't count as
    widespread. A feature needs ``SUPPORT`` toxic documents, a rate ``ODDS`` (log) above that in clean documents and
    a likelihood ratio of ``GAIN``.
    """
    counts, n = (Counter(), Counter()), [1, 1]
    for words, y in docs:
        counts[y].update(words)
        n[y] += len(words)
    total: tuple[Counter, Counter] = (Counter(), Counter())
    for y in (0, 1):
        for w, k in counts[y].items():
            for f in features(w):
                total[y][f] += k
    odds = lambda k1, k0: math.log((k1 + 0.5) / n[1]) - math.log((k0 + 0.5) / n[0])
    likely = {f for f, k in total[1].items() if k >= SUPPORT and odds(k, total[0][f]) >= ODDS / 2}
    of_word = {w: found for w in counts[1].keys() | counts[0].keys() if (found := [f for f in features(w) if f in likely])}
    places: tuple[dict, dict] = ({f: {} for f in likely}, {f: {} for f in likely})
    inside: dict[str, set[int]] = {f: set() for f in likely}
    for d, (words, y) in enumerate(docs):
        for i, w in enumerate(words):
            for f in of_word.get(w, ()):
                around = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                places[y][f][zlib.crc32(around.encode("utf-8", "surrogatepass"))] = w
                if y:
                    inside[f].add(d)
    out = {}
    for f in likely:
        k1, k0 = len(places[1][f]), len(places[0][f])
        if len(inside[f]) < SUPPORT or odds(k1, k0) < ODDS or _gain(k1, n[1], k0, n[0]) < GAIN:
            continue
        # a prefix that nearly always belongs to one word says no more than the word
        if f[0] == "w" or max(Counter(places[1][f].values()).values()) < 0.8 * k1:
            out[f] = 1 - math.exp(-odds(k1, k0))
    return out


def token_labels(words: list[str], y: int, marked: dict[str, float]) -> np.ndarray:
    """The probability that a token of a toxic document is toxic by its marked features; 0 in clean documents."""
    if y != 1:
        return np.zeros(len(words))
    memo: dict[str, float] = {}
    return np.array([memo[w] if w in memo else memo.setdefault(w, max((marked.get(f, 0.0) for f in features(w)), default=0.0)) for w in words])


def _windows(words: list[str], labels: np.ndarray, like: set[str], rng: np.random.Generator) -> list[tuple[int, int]]:
    """Parts of a document to train on: around its toxic tokens, around tokens like toxic ones, and one at random."""
    spots = [i for i, w in enumerate(words) if labels[i] > 0 or w in like]
    if len(words):
        spots.append(int(rng.integers(len(words))))
    out: list[list[int]] = []
    for s in sorted(spots):
        a, b = max(0, s - CONTEXT), min(len(words), s + CONTEXT + 1)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def fit(docs: list[tuple[str, int]], seed: int = 11) -> Crf:
    """Fit the chain and its calibration on (text, toxic) pairs."""
    rng = np.random.default_rng(seed)
    one: dict[str, str] = {}  # each word is kept once
    tokens = [([one.setdefault(w, w) for w in map(str.lower, WORD.findall(t))], y) for t, y in docs]
    model = Crf({}, np.zeros((2, 2)), np.zeros(2))
    if {y for _, y in tokens} != {0, 1}:
        model.known = False
        return model
    marked = marks(unlike(tokens))
    ids: dict[str, np.ndarray] = {}
    number: dict[str, int] = {}
    spans = []
    labelled = [token_labels(words, y, marked) for words, y in tokens]
    toxic = {f for (words, _), labels in zip(tokens, labelled, strict=True) for i in np.flatnonzero(labels >= 0.5).tolist() for f in features(words[i])}
    like = {w for words, _ in tokens for w in set(words) if any(f in toxic for f in features(w))}
    for (words, _), labels in zip(tokens, labelled, strict=True):
        for a, b in _windows(words, labels, like, rng):
            for w in words[a:b]:
                if w not in ids:
                    ids[w] = np.array([number.setdefault(f, len(number)) for f in features(w)], np.int64)
            spans.append(([ids[w] for w in words[a:b]], labels[a:b].astype(float)))
    # ascent on the log likelihood, a batch of windows at a time, with steps scaled by past gradients
    model.bias = -3.0
    weights, seen = np.zeros(len(number)), np.full(len(number), 1e-8)
    seen_small = np.full(7, 1e-8)
    for _ in range(PASSES):
        order = rng.permutation(len(spans))
        for part in np.array_split(order, max(1, len(order) // 256)):
            chosen = [spans[i] for i in part]
            sizes = np.array([len(s[0]) for s in chosen])
            first = np.cumsum(sizes) - sizes
            flat = [f for s in chosen for f in s[0]]
            width = np.array([len(f) for f in flat])
            owner, column = np.repeat(np.arange(len(flat)), width), np.concatenate(flat)
            y = np.concatenate([s[1] for s in chosen])
            unary = np.bincount(owner, weights[column], len(flat)) + model.bias
            p, pair = _pairwise(unary, first, model.trans, model.start)
            error = y - p
            used, place = np.unique(column, return_inverse=True)
            grad = np.bincount(place, error[owner], len(used))
            seen[used] += grad**2
            weights[used] += STEP * (grad - DECAY * weights[used]) / np.sqrt(seen[used])
            inner = np.ones(len(y), bool)
            inner[first] = False
            now, last = y[inner], y[np.flatnonzero(inner) - 1]
            small = np.zeros(7)
            for i in range(2):
                for j in range(2):
                    small[2 * i + j] = np.sum((last == i) * (now == j)) - pair[i, j]
            small[4:6] = [np.sum(y[first] == 0) - np.sum(1 - p[first]), np.sum(y[first]) - np.sum(p[first])]
            small[6] = error.sum()
            seen_small += small**2
            step = 0.1 * small / np.sqrt(seen_small)
            model.trans += step[:4].reshape(2, 2)
            model.start += step[4:6]
            model.bias += step[6]
    model.weights = {f: float(weights[i]) for f, i in number.items() if abs(weights[i]) >= LEAST_WEIGHT}
    _calibrate(model, tokens)
    return model


def _pairwise(unary, first, trans, start):
    """Marginals, and the expected number of each pair of labels."""
    p = marginals(unary, first, trans, start)
    n = len(unary)
    inner = np.ones(n, bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    # conditional of the label given the one before follows from forward messages; two-state identity on marginals:
    # P(1, 1) solves the odds ratio exp(t11 + t00 - t01 - t10) of each pair with its margins
    a, b = p[at - 1], p[at]
    ratio = math.exp(trans[1, 1] + trans[0, 0] - trans[0, 1] - trans[1, 0])
    if abs(ratio - 1) < 1e-9:
        both = a * b
    else:
        s = 1 + (a + b) * (ratio - 1)
        both = (s - np.sqrt(np.maximum(0, s * s - 4 * ratio * (ratio - 1) * a * b))) / (2 * (ratio - 1))
    pair = np.array([[np.sum(1 - a - b + both), np.sum(b - both)], [np.sum(a - both), np.sum(both)]])
    return p, pair


SUMMARY = 4


def _summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each text: 1, logit of its largest marginal, log of its expected number of toxic words, and of their share."""
    out = np.zeros((len(sizes), SUMMARY))
    out[:, 0], out[:, 1], out[:, 3] = 1.0, -8.0, math.log(LEAST_SHARE)
    some = np.flatnonzero(sizes)
    if len(some):
        first = (np.cumsum(sizes) - sizes)[some]
        top = np.clip(np.maximum.reduceat(p, first), 3.4e-4, 1 - 3.4e-4)
        expected = np.add.reduceat(np.where(p >= COUNTED, p, 0.0), first)
        out[some, 1] = np.log(top / (1 - top))
        out[some, 2] = np.log1p(expected)
        out[some, 3] = np.log(LEAST_SHARE + expected / sizes[some])
    return out


def _calibrate(model: Crf, tokens: list[tuple[list[str], int]]) -> None:
    """Logistic regression of the documents' labels on their summaries, by Newton steps with a small ridge."""
    sizes = np.array([len(w) for w, _ in tokens])
    memo: dict[str, float] = {}
    unary = np.array([memo.setdefault(w, 0.0) if w in memo else memo.setdefault(w, model.potential(w)) for words, _ in tokens for w in words])
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    x = _summary(marginals(unary, first, model.trans, model.start), sizes)
    y, beta = np.array([t[1] for t in tokens], float), np.zeros(SUMMARY)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(SUMMARY)
        beta += np.linalg.solve(hessian, x.T @ (y - p) - 0.1 * beta)
    model.calibration = beta


class Scorer(dict):
    """Scores whole texts; as a dict it remembers the potentials of words of usual length."""

    def __init__(self, model: Crf):
        self.model = model

    def __missing__(self, word: str) -> float:
        value = self.model.potential(word.lower())
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value

    def scored(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Score of each text, and its toxic spans as character offsets [start, end) of the whole text."""
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.model.known:
            return np.zeros(len(texts)), spans
        words = [WORD.findall(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        unary = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(words)), float, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        p = marginals(unary, starts[sizes > 0], self.model.trans, self.model.start)
        z = _summary(p, sizes) @ self.model.calibration
        doc_of = np.repeat(np.arange(len(texts)), sizes)
        hits: dict[int, list[int]] = {}
        for t in np.flatnonzero(p >= 0.5).tolist():
            hits.setdefault(int(doc_of[t]), []).append(t - int(starts[doc_of[t]]))
        for d, at in hits.items():
            places = [m.span() for m in WORD.finditer(texts[d])]
            spans[d] = [places[k] for k in at]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[str, int]]:
    """The bounded training sample: rows whose crc32(id) mod 4 is not 2, by hash of the id within each class.

    The labels alone are counted and thinned by the hash to a few thousand ids; only the documents of these are
    brought to the driver, one text for an id that repeats.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").where(~held_out("id"))
    marked = marked.groupBy("id").agg(F.max("y").alias("y")).withColumn("h", F.pmod(F.xxhash64(F.lit(5), F.col("id").cast("string")), F.lit(1 << 32)))
    n = dict(marked.groupBy("y").count().collect())
    share = {y: min(1.0, 1.5 * TRAIN_DOCS / n[y]) for y in n}
    below = F.when(F.col("y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))) * F.lit(float(1 << 32))
    chosen = marked.where(F.col("h") < below)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") <= TRAIN_CHARS)
    rows = rows.join(F.broadcast(chosen), "id").groupBy("id", "y", "h").agg(F.min("t").alias("t"))
    found = sorted(((r["y"], r["h"], r["t"] or "") for r in rows.collect()), key=lambda r: (r[0], r[1], r[2]))
    return [(t, y) for k in (0, 1) for y, _, t in [r for r in found if r[0] == k][:TRAIN_DOCS]]


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(docs: DataFrame, model: Crf, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``score`` double, ``predicted`` int and ``spans`` array<array<bigint>>; the model, bounded by the training sample, is broadcast."""
    docs = clear_of(docs, "score", "predicted", "spans")
    model = docs.sparkSession.sparkContext.broadcast(model)
    memo = {}

    def make():
        scorer = memo.setdefault("scorer", Scorer(model.value))

        def run(texts: list[str]) -> dict:
            score, spans = scorer.scored(texts)
            return {"score": score, "spans": [[list(x) for x in own] for own in spans]}

        return run

    out = per_text(docs, text_col, {"score": ("double", pa.float64()), "spans": ("array<array<bigint>>", pa.list_(pa.list_(pa.int64())))}, make)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def trained(spark, sf_dir: str) -> Crf:
    """The model of the labelled documents of ``sf_dir``."""
    return fit(training_sample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return scored(docs, trained(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted", "spans")
