"""Token counts by finite-state transducers of a byte-level BPE tokenizer.

Two deterministic transducers, compiled from the tokenizer's file, count tokens without building them.

* The pre-tokenizer runs over characters (classes of letters, digits, spaces and the rest) and marks where
  words begin. The texts of a batch, with an end mark after each, are cut into chunks of equal length.
  A chunk's map from entry state to exit state is an element of the automaton's transition monoid, which is
  numbered and tabulated as far as it is met; the maps of all chunks are composed by a parallel prefix scan,
  which gives every chunk its entry state, and the chunks then run side by side. So a text of any length is
  handled in steps of one chunk length.
* The BPE transducer runs over bytes and goes back to its first state where a word begins. After each prefix of a
  word the greedy merges end in one token, found by the pairs that merging leaves apart; a state holds the
  vocabulary entries still open, each with the token before it and the token count there, relative to now. A
  transition emits the change of the token count. States and transitions are compiled when first met and kept.

The chunks of all texts run through the BPE transducer side by side, too. A chunk's map takes an entry state to its
exit state and its emitted count. Where a word begins in the chunk, the map is constant from there on: exit state and
count of that part need no entry state; the head before it is run when the exit of the chunk before is known.
Composing the maps along a text therefore needs one step of the scan, except inside words longer than a chunk, which
are gone through in order. A text's tokens are the sum of its chunks' counts.

The special strings of the tokenizer are cut out first and count as one token, as its library does by default.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts and words are counted whole;
repeated rows are counted each; an empty table gives no rows; input columns with the names added are replaced.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, per_text, utf8_size

#: Length of a chunk; states that a worker keeps; chunks that are run one by one.
CHUNK, MEMO_STATES, FEW = 128, 300_000, 16

# Character classes: the letters that contractions are made of stand alone.
LETTER, S, T_, R, E_, V, M, L, D, NUMBER, QUOTE, OTHER, SPACE, BLANK, END = range(15)
CLASSES = 16
#: White space by Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
END_MARK = 0x110000

# States of the pre-tokenizer: what has been read since the word began.
(START, IN_LETTERS, IN_NUMBER, IN_OTHER, AT_QUOTE, QUOTE_E, QUOTE_L, CLOSED, ONE_SPACE, ONE_BLANK, LAST_SPACE, LAST_BLANK) = range(12)
STATES = 12
#: States of the BPE transducer that have fixed numbers: at the beginning of a word, and not known yet (emits nothing).
START_STATE, UNKNOWN = 0, 1
#: Added to a byte where a word begins; added to a count so that it is stored without a sign; multiplier of the hash.
FRESH, BIAS, SPREAD = 256, 1 << 15, np.uint64(0x9E3779B97F4A7C15)
#: Emissions: a word begins at this character; a word begins at the character before it.
HERE, BEFORE = 1, 2


def _step(state: int, c: int) -> tuple[int, int]:
    """Next state and emission of the pre-tokenizer on a character of class c."""
    if c == END:
        return START, HERE | (BEFORE if state in (QUOTE_E, QUOTE_L) else 0)
    white = c in (SPACE, BLANK)
    fresh = {SPACE: ONE_SPACE, BLANK: ONE_BLANK, QUOTE: AT_QUOTE, OTHER: IN_OTHER, NUMBER: IN_NUMBER}.get(c, IN_LETTERS)
    if state in (START, CLOSED):
        return fresh, HERE
    if state in (ONE_SPACE, ONE_BLANK, LAST_SPACE, LAST_BLANK):
        if white:  # a run of white space; its last character goes to what follows
            return (LAST_SPACE if c == SPACE else LAST_BLANK), 0
        split = BEFORE if state in (LAST_SPACE, LAST_BLANK) else 0
        if state in (ONE_SPACE, LAST_SPACE):  # a space leads the word
            return (IN_OTHER if c == QUOTE else fresh), split
        return fresh, split | HERE
    if state == AT_QUOTE:
        if c in (S, T_, M, D):
            return CLOSED, 0
        if c in (R, V):
            return QUOTE_E, 0
        if c == L:
            return QUOTE_L, 0
        return (IN_OTHER, 0) if c in (QUOTE, OTHER) else (fresh, HERE)
    if state in (QUOTE_E, QUOTE_L):
        if c == (E_ if state == QUOTE_E else L):
            return CLOSED, 0
        return (IN_LETTERS, BEFORE) if fresh == IN_LETTERS else (fresh, BEFORE | HERE)
    same = {IN_LETTERS: fresh == IN_LETTERS, IN_NUMBER: c == NUMBER, IN_OTHER: c in (QUOTE, OTHER)}[state]
    return (state, 0) if same else (fresh, HERE)


class WordScanner:
    """The pre-tokenizer, run over many characters at once."""

    def __init__(self):
        self.next = np.zeros((STATES, CLASSES), np.uint8)
        self.emit = np.zeros((STATES, CLASSES), np.uint8)
        for s in range(STATES):
            for c in range(END + 1):
                self.next[s, c], self.emit[s, c] = _step(s, c)
        self._monoid()
        self.classes = np.full(END_MARK + 1, OTHER, np.uint8)
        for code in range(END_MARK):
            kind = unicodedata.category(chr(code))[0]
            if kind == "L":
                self.classes[code] = LETTER
            elif kind == "N":
                self.classes[code] = NUMBER
        self.classes[WHITE] = BLANK
        for char, c in {" ": SPACE, "'": QUOTE, "s": S, "t": T_, "r": R, "e": E_, "v": V, "m": M, "l": L, "d": D}.items():
            self.classes[ord(char)] = c
        self.classes[END_MARK] = END

    def _monoid(self) -> None:
        """All maps of states that strings of characters can make, and their products."""
        steps = [tuple(self.next[:, c].tolist()) for c in range(END + 1)]
        number = {tuple(range(STATES)): 0}
        maps = [tuple(range(STATES))]
        for m in maps:  # grows as it runs
            for s in steps:
                product = tuple(s[x] for x in m)
                if product not in number:
                    number[product] = len(maps)
                    maps.append(product)
        n = len(maps)
        dtype = np.uint8 if n <= 256 else np.uint16
        self.maps = np.array(maps, np.uint8)
        self.then_class = np.zeros((n, CLASSES), dtype)
        for c, s in enumerate(steps):
            self.then_class[:, c] = [number[tuple(s[x] for x in m)] for m in maps]
        self.then_map = np.array([[number[tuple(b[x] for x in a)] for b in maps] for a in maps], dtype)

    def starts(self, codes: np.ndarray) -> np.ndarray:
        """Positions where words begin; ``codes`` are code points, with END_MARK after each text."""
        n = len(codes)
        width = -(-n // CHUNK)
        classes = np.full(width * CHUNK, END, np.uint8)
        classes[:n] = self.classes[codes]
        columns = np.ascontiguousarray(classes.reshape(width, CHUNK).T)
        flat = self.then_class.ravel()
        maps = np.zeros(width, np.intp)
        for column in columns:
            maps = flat[maps * CLASSES + column].astype(np.intp)
        # inclusive prefix scan of the chunks' maps
        product, reach, total = self.then_map.ravel(), 1, len(self.maps)
        while reach < width:
            maps[reach:] = product[maps[:-reach] * total + maps[reach:]]
            reach *= 2
        state = np.concatenate(([START], self.maps[maps[:-1], START])).astype(np.intp)
        step, emit, marks = self.next.ravel(), self.emit.ravel(), np.empty((CHUNK, width), np.uint8)
        for row, column in zip(marks, columns, strict=True):
            at = state * CLASSES + column
            row[:] = emit[at]
            state = step[at].astype(np.intp)
        marks = marks.T.ravel()[:n]
        begins = (marks & HERE) != 0
        begins[:-1] |= (marks[1:] & BEFORE) != 0
        return np.flatnonzero(begins)


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BpeTransducer:
    """Counts a word's tokens state by state; compiled as far as it is met."""

    def __init__(self, vocabulary: dict[str, int], merges: list):
        byte_of = _byte_of()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.text = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.merge = {(vocabulary[a], vocabulary[b]): (rank, vocabulary[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = {byte_of[token]: i for token, i in vocabulary.items() if len(token) == 1}
        self.made_of = {into: (rank, a, b) for (a, b), (rank, into) in self.merge.items()}
        made = {into for _, into in self.merge.values()} | set(self.single.values())
        # the trie of all tokens that merging can make
        self.child: dict[tuple[int, int], int] = {}
        self.ends: list[int] = [-1]
        self.leaf: list[bool] = [False]
        for i in made:
            node = 0
            for b in self.text[i]:
                step = self.child.get((node, b))
                if step is None:
                    step = self.child[node, b] = len(self.ends)
                    self.ends.append(-1)
                    self.leaf.append(True)
                    self.leaf[node] = False
                node = step
            self.ends[node] = i
        self.apart: dict[tuple[int, int], bool] = {}
        self.sound: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states = [((0, -1, 0),), ()]
        self.number = {state: k for k, state in enumerate(self.states)}
        self.steps: dict[int, int] = {}
        self._sized(1 << 16)

    def merged(self, ids: list[int]) -> list[int]:
        """Merge by rank, the leftmost of equals first, until nothing merges."""
        while len(ids) > 1:
            found = [self.merge.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:], strict=False)]
            best = min(found)
            if best[0] == 1 << 60:
                break
            at, out = 0, []
            while at < len(ids):
                if at + 1 < len(ids) and found[at] == best:
                    out.append(best[1])
                    at += 2
                else:
                    out.append(ids[at])
                    at += 1
            ids = out
        return ids

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of two tokens gives these two.

        Merges happen in order of rank, so a token lives from its own merge to that of the token it goes into.
        Walking back in time along the right edge of a and the left edge of b gives all pairs that ever meet;
        the tokens stay apart unless such a pair has a merge of its own while both live.
        """
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 4 * MEMO_STATES:
                self.apart.clear()
            known = self.apart[a, b] = self._never_meet(a, b)
        return known

    def _never_meet(self, x: int, y: int) -> bool:
        x_ends = y_ends = 1 << 60
        while True:
            meets = self.merge.get((x, y))
            if meets and meets[0] < x_ends and meets[0] <= y_ends:
                return False
            from_x, from_y = self.made_of.get(x), self.made_of.get(y)
            if from_x is None and from_y is None:
                return True
            if from_y is None or (from_x is not None and from_x[0] > from_y[0]):
                x_ends, x = from_x[0], from_x[2]
            else:
                y_ends, y = from_y[0], from_y[1]

    def reached(self, token: int) -> bool:
        """Whether merging a token's bytes gives the token."""
        known = self.sound.get(token)
        if known is None:
            known = self.sound[token] = self.merged([self.single[x] for x in self.text[token]]) == [token]
        return known

    def _compiled(self, state: int, byte: int) -> tuple[int, int]:
        if state == UNKNOWN:
            return UNKNOWN, 0
        opened, last = [], None
        for node, token, count in self.states[state]:
            step = self.child.get((node, byte))
            if step is None:
                continue
            if not self.leaf[step]:
                opened.append((step, token, count))
            ends = self.ends[step]
            if last is None and ends >= 0 and self.reached(ends) and (token < 0 or self.stay_apart(token, ends)):
                last = (ends, count + 1)
        token, count = last
        key = (*((n, t, c - count) for n, t, c in opened), (0, token, 0))
        number = self.number.get(key)
        if number is None:
            number = self.number[key] = len(self.states)
            self.states.append(key)
        return number, count

    # The transitions as an open hash table of arrays: key state << 8 | byte, value next state << 16 | count + BIAS.

    def _sized(self, size: int) -> None:
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        if self.steps:
            self._filed(np.fromiter(self.steps.keys(), np.int64, len(self.steps)), np.fromiter(self.steps.values(), np.int64, len(self.steps)))

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SPREAD) >> self.shift).view(np.int64)

    def _filed(self, keys: np.ndarray, values: np.ndarray) -> None:
        slots, last = self._slots(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            self.keys[slots[free]] = keys[free]  # of several that want one slot the last has it
            done = self.keys[slots] == keys
            self.values[slots[done]] = values[done]
            keys, values, slots = keys[~done], values[~done], (slots[~done] + 1) & last

    def _step(self, key: int) -> int:
        """The packed value of a transition, compiled if it is new."""
        value = self.steps.get(key)
        if value is None:
            number, count = self._compiled(key >> 8, key & 255)
            value = self.steps[key] = number << 16 | (count + BIAS)
        return value

    def _values(self, keys: np.ndarray) -> np.ndarray:
        """Packed values of the transitions."""
        slots = self._slots(keys)
        out = self.values[slots]
        other = np.flatnonzero(self.keys[slots] != keys)
        while len(other):
            # the next slot; an empty one before the key is found means that the transition is new
            empty = self.keys[slots[other]] < 0
            if empty.any():
                new = np.unique(keys[other[empty]])
                known = len(self.steps)
                packed = np.array([self._step(k) for k in new.tolist()], np.int64)
                if 4 * len(self.steps) > len(self.keys):
                    self._sized(4 * len(self.keys))
                    return self._values(keys)
                if len(self.steps) > known:
                    self._filed(new, packed)
                out[other[empty]] = packed[np.searchsorted(new, keys[other[empty]])]
                other = other[~empty]
            slots[other] = (slots[other] + 1) & (len(self.keys) - 1)
            hit = self.keys[slots[other]] == keys[other]
            out[other[hit]] = self.values[slots[other[hit]]]
            other = other[~hit]
        return out

    def run(self, data: np.ndarray, at: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Run side by side over ``length`` bytes from ``at`` on, from the given states; exit states and emitted counts.

        data: bytes, with FRESH added where a word begins.
        """
        order = np.argsort(-length, kind="stable")
        place, state, total = at[order], state[order].astype(np.int64), np.zeros(len(at), np.int64)
        live = np.searchsorted(-length[order], -np.arange(int(length.max(initial=0))), side="left")  # of which length > step
        for m in live.tolist():
            now = data[place[:m]]
            place[:m] += 1
            own = state[:m]
            own[now >= FRESH] = START_STATE
            packed = self._values(own << 8 | (now & 255))
            state[:m] = packed >> 16
            total[:m] += (packed & 0xFFFF) - BIAS
        exits, counts = np.empty_like(state), np.empty_like(total)
        exits[order], counts[order] = state, total
        return exits, counts

    def run_one(self, data: list[int], state: int) -> tuple[int, int]:
        """The same over one run of bytes."""
        total, steps = 0, self.steps
        for now in data:
            key = (now & 255) if now >= FRESH else state << 8 | now
            value = steps.get(key)
            if value is None:
                value = self._step(key)
                self._filed(np.array([key]), np.array([value]))
                if 4 * len(steps) > len(self.keys):
                    self._sized(4 * len(self.keys))
            state = value >> 16
            total += (value & 0xFFFF) - BIAS
        return state, total

    def counts(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Tokens of the texts that stand in ``data`` (see ``run``) from ``begin`` on; each begins with a word, if it has any."""
        if len(self.states) > MEMO_STATES:
            self._reset()
        chunks = -(-size // CHUNK)
        text = np.repeat(np.arange(len(size)), chunks)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        at = begin[text] + inner * CHUNK
        length = np.minimum(CHUNK, size[text] - inner * CHUNK)
        # the part from the first word on
        exits, counts = self.run(data, at, length, np.where(inner == 0, START_STATE, UNKNOWN))
        # the heads: bytes before the first word of a chunk
        fresh = np.append(np.flatnonzero(data >= FRESH), len(data))
        head = np.minimum(fresh[np.searchsorted(fresh, at)] - at, length)
        waiting = np.flatnonzero((inner > 0) & (head > 0))
        while len(waiting):
            ready = exits[waiting - 1] != UNKNOWN
            if ready.sum() <= FEW:  # inside few long words: in order, one by one
                for k in waiting.tolist():
                    if exits[k - 1] == UNKNOWN:
                        break
                    state, n = self.run_one(data[at[k] : at[k] + head[k]].tolist(), int(exits[k - 1]))
                    counts[k] += n
                    if head[k] == length[k]:
                        exits[k] = state
                    waiting = waiting[1:]
                continue
            now, waiting = waiting[ready], waiting[~ready]
            state, n = self.run(data, at[now], head[now], exits[now - 1])
            counts[now] += n
            exits[now] = np.where(head[now] == length[now], state, exits[now])
        return np.bincount(text, counts, len(size)).astype(np.int64)


class TokenCounter:
    """Counts of whole texts."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space is compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.bpe = BpeTransducer(model["vocab"], model["merges"])
        self.scanner = WordScanner()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        pieces, owner, total = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            for special in self.special:
                if special in text:
                    parts = [p for part in parts for p in part.split(special)]
                    total[i] += text.count(special)
            pieces += parts
            owner += [i] * len(parts)
        joined = "\n".join(pieces) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces))) - 1
        codes[ends] = ord("\n")
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))  # of each character in the bytes
        codes[ends] = END_MARK
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint16)
        data[place[self.scanner.starts(codes)]] += FRESH
        begin = place[np.concatenate(([0], ends[:-1] + 1))]
        np.add.at(total, np.array(owner, np.int64), self.bpe.counts(data, begin, place[ends] - begin))
        return total


@functools.lru_cache(maxsize=2)
def _counter(tokenizer_json: str) -> TokenCounter:
    return TokenCounter(tokenizer_json)


def token_counts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` (without its text) with n_bytes, n_tokens and over_limit; the tokenizer's file, of a few MB, is broadcast."""
    docs = clear_of(docs, "n_bytes", "n_tokens", "over_limit").withColumn("n_bytes", utf8_size(F.col(text_col)))
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    docs = per_text(docs, text_col, {"n_tokens": ("bigint", pa.int64())}, lambda: lambda texts: {"n_tokens": _counter(spec.value).counts(texts)})
    return docs.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """The contract's rows for op1."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs, tokenizer_path)
