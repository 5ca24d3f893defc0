"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, in page order, inline markup taken
away. Each block is a vector: its tag path (hashed tag, class and id names), its hashed words, and a few
measures of its text (length, share of linked text, punctuation, place). A bidirectional LSTM in numpy reads
the page's whole sequence of blocks, so that every block is judged by all that stands before and after it,
and gives the probability that the block belongs to the article; blocks from ``THRESHOLD`` on are kept.

The network is trained here, on the driver, on ``TRAIN_PAGES`` pages that a seeded generator composes of the
parts of usual pages (menus, headers, adverts, notices, forms, sidebars, articles of several builds, reader
comments, footers), with words drawn from several alphabets so that it learns structure rather than topics.

Defined results: a null or empty page, or one without article blocks, gives an empty text; scripts, styles,
templates and comments are no blocks (nor drawings and scriptless fallbacks that are closed); a tag or comment that
the end of the page cuts off is dropped; character references are decoded by the HTML5 rules; a page of any length,
depth and number of blocks is read whole: an element's path is a pointer to its parent's, and the network goes through
long pages in slices that hand on its state; repeated rows are read each; an empty table gives no rows; extra
columns pass through, but input columns named ``text`` or ``n_chars`` (in any case) are replaced.
"""

from __future__ import annotations

import functools
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clear_of, per_text

#: Hash sizes and dimensions of the path and word vectors, number of text measures, hidden units of a direction.
PATHS, PATH_DIM, WORDS, WORD_DIM, MEASURES, HIDDEN = 1024, 16, 2048, 6, 8, 16
TRAIN_PAGES, PASSES, BATCH, RATE, SEED = 700, 10, 32, 0.01, 5
THRESHOLD = 0.5
#: Blocks that are scored at once, blocks of a slice of a longer page, and characters from which on a text is not split into a list.
SLICE_BLOCKS, SLICE_STEPS, LONG_TEXT = 40_000, 4096, 500_000
#: Paths and words that a task remembers, the latter of usual length.
MEMO, MEMO_LENGTH = 200_000, 64

# Names of HTML elements (fixed values).
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
RAW_TAGS, CLOSED_RAW_TAGS = frozenset("script style template textarea".split()), frozenset("noscript svg".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*)(?:>|\Z)",
    re.S,
)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME = re.compile(r"[a-z]+")
MARKS = ".,;:!?…"
PUNCTUATION, SPACES, NO_SPACES = re.compile(f"[{MARKS}]"), re.compile(r"\s+"), re.compile("[^ ]+")


class Path:
    """An open element: its parent's path and the hashed names along it, shared with the parent where it adds none."""

    __slots__ = ("ids", "last", "names", "vector_ids")

    def __init__(self, above: Path | None, tag: str, own: tuple[str, ...]):
        ids = frozenset(_hash(n, PATHS) for n in own)
        if above is not None:
            ids = above.ids if ids <= above.ids else above.ids | ids
        self.ids, self.last, self.vector_ids = ids, _hash("last " + tag, PATHS), None

    def numbers(self) -> np.ndarray:
        if self.vector_ids is None:
            self.vector_ids = np.array(sorted(self.ids | {self.last}), np.int64)
        return self.vector_ids


class Paths(dict):
    """Paths by (parent, names), remembered across pages."""

    def of(self, above: Path | None, tag: str, own: tuple[str, ...]) -> Path:
        key = (above, own)
        found = self.get(key)
        if found is None:
            if len(self) >= MEMO:
                self.clear()
            found = self[key] = Path(above, tag, own)
        return found


def _plain(raw: str) -> str:
    """Character references decoded, each run of white space as one space, trimmed."""
    text = html.unescape(raw)
    return " ".join(text.split()) if len(text) < LONG_TEXT else SPACES.sub(" ", text).strip(" ")


Block = tuple[Path | None, str, float]


def blocks(page: str | None, paths: Paths | None = None) -> list[Block]:
    """Leaf blocks of a page: (path, text, share of it that is linked)."""
    page, paths = page or "", Paths() if paths is None else paths
    out: list[Block] = []
    stack: list[tuple[str, Path]] = []
    opened: dict[str, int] = {}  # how many of each tag are on the stack
    shut_at: dict[str, int] = {}  # where the next closing tag of a name was last found; the end of the page if there is none
    parts: list[str] = []
    linked, in_link, at, end = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            raw = "".join(parts)
            text = _plain(raw)
            if text:
                out.append((stack[-1][1] if stack else None, text, min(1.0, linked / max(1, len(raw)))))
            parts.clear()
        linked = 0

    def pop() -> str:
        tag = stack.pop()[0]
        opened[tag] -= 1
        return tag

    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW_TAGS or name in CLOSED_RAW_TAGS:
            if not closing and not (m[3] or "").endswith("/"):
                if shut_at.get(name, -1) < at:
                    stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
                    shut_at[name] = stop.end() if stop else end + 1
                if shut_at[name] <= end:
                    at = shut_at[name]
                elif name in RAW_TAGS:
                    at = end
            continue
        if name == "a":
            in_link = 0 if closing else 1
            continue
        if name not in BLOCK_TAGS:
            if name in VOID_TAGS:
                parts.append(" ")
            continue
        flush()
        if closing:
            if opened.get(name):
                while pop() != name:
                    pass
            in_link = 0
        elif name not in VOID_TAGS:
            if stack and stack[-1][0] == "p":
                pop()
            while stack and stack[-1][0] in SELF_CLOSING.get(name, ()):
                pop()
            attributes = (m[3] or m[6] or "").lower()
            own = [name]
            for value in NAMES.findall(attributes) if attributes else ():
                for n in NAME.findall("".join(value)):
                    own += (f"{name}.{n}", "." + n)
            stack.append((name, paths.of(stack[-1][1] if stack else None, name, tuple(own))))
            opened[name] = opened.get(name, 0) + 1
    flush()
    return out


def _hash(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class Features:
    """Vectors of blocks, remembering paths and words."""

    def __init__(self):
        self.paths = Paths()
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = _hash(word, WORDS)
            if len(word) <= MEMO_LENGTH:
                if len(self.words) >= MEMO:
                    self.words.clear()
                self.words[word] = n
        return n

    def _words(self, text: str) -> np.ndarray:
        text = text.lower()
        tokens = text.split(" ") if len(text) < LONG_TEXT else (m[0] for m in NO_SPACES.finditer(text))
        return np.fromiter(map(self.word, tokens), np.int64)

    def of(self, pages: list[list[Block]], first: int = 0, total: int | None = None):
        """Ids of the distinct paths and which of these each block has, word ids (with the blocks' sizes) and measures of all blocks.

        first, total: of a part of one page, the place of its first block and the number of the page's blocks.
        """
        number: dict[Path | None, int] = {}
        path, words, sizes, measures = [], [], [], []
        for page in pages:
            n = total or len(page)
            for k, (own, text, linked) in enumerate(page, first):
                path.append(number.setdefault(own, len(number)))
                ids = self._words(text)
                words.append(ids)
                size, chars = max(1, len(ids)), len(text)
                sizes.append(size)
                marks = len(PUNCTUATION.findall(text)) if chars < LONG_TEXT else sum(map(text.count, MARKS))
                measures.append((
                    min(1.0, np.log1p(chars) / 8),
                    linked,
                    min(1.0, size / 20),
                    min(1.0, marks / (1 + size) * 4),
                    float(text[-1] in ".!?:…\"'”"),
                    k / n,
                    (n - k) / n,
                    1.0,
                ))
        ids = [own.numbers() if own is not None else np.zeros(1, np.int64) for own in number]
        widths = np.array([len(p) for p in ids], np.int64)
        flat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        return flat(ids), widths, np.array(path, np.int64), flat(words), np.array(sizes, np.int64), np.array(measures, np.float64).reshape(-1, MEASURES)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction: gates in the order input, forget, output, candidate."""

    def __init__(self, rng, inputs: int, hidden: int):
        self.w = rng.normal(0, 1 / np.sqrt(inputs + hidden), (inputs + hidden, 4 * hidden))
        self.b = np.zeros(4 * hidden)
        self.b[hidden : 2 * hidden] = 1.0
        self.h = hidden

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False, state=None):
        """x: (time, batch, inputs); states of padded steps stay as they were. Returns outputs, tape and the last state."""
        steps, batch, inputs = x.shape
        n = self.h
        h, c = state if state is not None else (np.zeros((batch, n)), np.zeros((batch, n)))
        out, tape = np.empty((steps, batch, n)), []
        projected = x.reshape(-1, inputs) @ self.w[:inputs]
        projected = projected.reshape(steps, batch, -1) + self.b
        for t in range(steps):
            z = projected[t] + h @ self.w[inputs:]
            gates = _sigmoid(z[:, : 3 * n])
            g = np.tanh(z[:, 3 * n :])
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            new_c = f * c + i * g
            tanh_c = np.tanh(new_c)
            live = mask[t][:, None]
            if keep:
                tape.append((h, c, i, f, o, g, tanh_c))
            c = np.where(live, new_c, c)
            h = np.where(live, o * tanh_c, h)
            out[t] = h
        return out, tape, (h, c)

    def back(self, x, mask, tape, d_out):
        steps, batch, inputs = x.shape
        n = self.h
        dw, db, dx = np.zeros_like(self.w), np.zeros_like(self.b), np.zeros_like(x)
        dh, dc = np.zeros((batch, n)), np.zeros((batch, n))
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tanh_c = tape[t]
            live = mask[t][:, None]
            dh = dh + d_out[t]
            d_new_h = np.where(live, dh, 0)
            d_new_c = np.where(live, dc, 0) + d_new_h * o * (1 - tanh_c**2)
            dz = np.concatenate((d_new_c * g * i * (1 - i), d_new_c * c * f * (1 - f), d_new_h * tanh_c * o * (1 - o), d_new_c * i * (1 - g**2)), axis=1)
            both = np.concatenate((x[t], h), axis=1)
            dw += both.T @ dz
            db += dz.sum(axis=0)
            d_both = dz @ self.w.T
            dx[t] = d_both[:, :inputs]
            dh = np.where(live, d_both[:, inputs:], dh)
            dc = np.where(live, d_new_c * f, dc)
        return dw, db, dx


class Labeller:
    """Embeddings, a bidirectional LSTM and a logistic output."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        inputs = PATH_DIM + WORD_DIM + MEASURES
        self.path_vectors = rng.normal(0, 0.3, (PATHS, PATH_DIM))
        self.word_vectors = rng.normal(0, 0.1, (WORDS, WORD_DIM))
        self.ahead, self.behind = Lstm(rng, inputs, HIDDEN), Lstm(rng, inputs, HIDDEN)
        self.out = rng.normal(0, 0.3, 2 * HIDDEN + inputs)
        self.bias = np.zeros(1)

    def vectors(self, features) -> np.ndarray:
        paths, widths, path, words, sizes, measures = features
        a = (np.add.reduceat(self.path_vectors[paths], np.cumsum(widths) - widths) / np.sqrt(widths)[:, None])[path]
        b = np.add.reduceat(self.word_vectors[words], np.cumsum(sizes) - sizes) / sizes[:, None]
        return np.concatenate((a, b, measures), axis=1)

    @staticmethod
    def _grid(counts: np.ndarray):
        """Place of each block in a (time, page) grid, and which cells are blocks."""
        steps = int(counts.max())
        page = np.repeat(np.arange(len(counts)), counts)
        time = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        mask = np.zeros((steps, len(counts)), bool)
        mask[time, page] = True
        return time, page, mask

    def scores(self, features, counts: np.ndarray, keep: bool = False):
        """P(article) of each block; ``counts``: blocks of each page, at least one."""
        v = self.vectors(features)
        time, page, mask = self._grid(counts)
        x = np.zeros((*mask.shape, v.shape[1]))
        x[time, page] = v
        fore, tape_a, _ = self.ahead.run(x, mask, keep)
        # from the end: padded steps come first there and leave the state at zero
        back, tape_b, _ = self.behind.run(x[::-1], mask[::-1], keep)
        both = np.concatenate((fore[time, page], back[::-1][time, page], v), axis=1)
        p = _sigmoid(both @ self.out + self.bias)
        return (p, (time, page, mask, x, both, tape_a, tape_b)) if keep else p

    def long_scores(self, features: Features, page: list[Block], step: int = SLICE_STEPS) -> np.ndarray:
        """P(article) of each block of one page, slice by slice in both directions; a slice hands its state to the next."""
        starts = range(0, len(page), step)
        z = np.full(len(page), self.bias[0])
        for ahead in (True, False):
            state, net = None, self.ahead if ahead else self.behind
            own = self.out[:HIDDEN] if ahead else self.out[HIDDEN : 2 * HIDDEN]
            for a in starts if ahead else reversed(starts):
                part = page[a : a + step]
                v = self.vectors(features.of([part], a, len(page)))
                x = (v if ahead else v[::-1])[:, None, :]
                out, _, state = net.run(x, np.ones((len(part), 1), bool), state=state)
                told = out[:, 0] @ own
                z[a : a + step] += told + v @ self.out[2 * HIDDEN :] if ahead else told[::-1]
        return _sigmoid(z)

    def trained(self, pages: list[tuple[list, np.ndarray]], seed: int = SEED) -> Labeller:
        rng, memory, moments = np.random.default_rng(seed), Features(), {}
        names = ("path_vectors", "word_vectors", "aw", "ab", "bw", "bb", "out", "bias")
        step = 0
        for _ in range(PASSES):
            order = rng.permutation(len(pages))
            for part in np.array_split(order, max(1, len(order) // BATCH)):
                chosen = [pages[i] for i in part]
                features = memory.of([p for p, _ in chosen])
                counts, y = np.array([len(p) for p, _ in chosen]), np.concatenate([labels for _, labels in chosen])
                p, (time, page, mask, x, both, tape_a, tape_b) = self.scores(features, counts, keep=True)
                error = (p - y) / len(chosen)
                d_both = error[:, None] * self.out
                d_fore, d_back = np.zeros((*mask.shape, HIDDEN)), np.zeros((*mask.shape, HIDDEN))
                d_fore[time, page], d_back[time, page] = d_both[:, :HIDDEN], d_both[:, HIDDEN : 2 * HIDDEN]
                aw, ab, dx_a = self.ahead.back(x, mask, tape_a, d_fore)
                bw, bb, dx_b = self.behind.back(x[::-1], mask[::-1], tape_b, d_back[::-1])
                dv = d_both[:, 2 * HIDDEN :] + dx_a[time, page] + dx_b[::-1][time, page]
                paths, widths, path, words, sizes, _ = features
                d_path, d_word = np.zeros_like(self.path_vectors), np.zeros_like(self.word_vectors)
                d_own = np.zeros((len(widths), PATH_DIM))
                np.add.at(d_own, path, dv[:, :PATH_DIM])
                np.add.at(d_path, paths, np.repeat(d_own / np.sqrt(widths)[:, None], widths, axis=0))
                np.add.at(d_word, words, np.repeat(dv[:, PATH_DIM : PATH_DIM + WORD_DIM] / sizes[:, None], sizes, axis=0))
                step += 1
                grads = dict(zip(names, (d_path, d_word, aw, ab, bw, bb, both.T @ error, np.array([error.sum()])), strict=True))
                values = dict(zip(
                    names,
                    (self.path_vectors, self.word_vectors, self.ahead.w, self.ahead.b, self.behind.w, self.behind.b, self.out, self.bias),
                    strict=True,
                ))
                for name, g in grads.items():
                    m, s = moments.setdefault(name, (np.zeros_like(g), np.zeros_like(g)))
                    m += 0.1 * (g - m)
                    s += 0.01 * (g * g - s)
                    values[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        return self


# ---- composed training pages -------------------------------------------------------------------------------

#: Usual names of parts of pages, and usual words in them (fixed values).
ARTICLE_NAMES = "content article post entry story main body text article-body post-content entry-content story-body page-content".split()
AD_NAMES = "ad ads advert advertisement sponsored promo banner adsbox ad-slot sponsor".split()
NOTICE_NAMES = "cookie notice cookie-banner alert consent gdpr message popup modal warning subscribe paywall".split()
SIDE_NAMES = "sidebar side related widget rail aside recommended most-read tags trending".split()
HEAD_NAMES = "header top masthead site-header branding toolbar breadcrumb".split()
NAV_NAMES = "nav menu navbar navigation main-menu links topnav".split()
FOOT_NAMES = "footer bottom site-footer copyright legal colophon".split()
COMMENT_NAMES = "comments comment reply discussion responses comment-list disqus thread".split()
BOILERPLATE = "home about contact login register subscribe newsletter search menu share cookies accept privacy terms copyright rights reserved advertisement sponsored reply comments next previous related read more email submit".split()
ALPHABETS = ("etaoinshrdlu", "enisratdhulcgmöäü", "esaitnrulodcéèà", "eaosrnidlctuñóí", "оеаинтсрвл", "的一是不了人我在有他这中")


def composed_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page and, for each of its blocks in order, whether it belongs to the article."""
    letters = ALPHABETS[rng.randrange(len(ALPHABETS))]
    out, labels = [], []
    word = lambda: "".join(rng.choices(letters, k=rng.randrange(1, 11)))

    def words(n: int, dots: bool = True, boiler: float = 0.0) -> str:
        made = [BOILERPLATE[rng.randrange(len(BOILERPLATE))] if rng.random() < boiler else word() for _ in range(max(1, n))]
        if dots and rng.random() < 0.9:
            made = [w + (",", ".", ".")[rng.randrange(3)] if rng.random() < 0.12 else w for w in made]
            made[-1] += "." if rng.random() < 0.9 else ""
        return " ".join(made).capitalize()

    pick = lambda names: names[rng.randrange(len(names))]
    def block(tag: str, text: str, kept: bool, shut: bool = True, inner: str = "") -> None:
        out.append(f"<{tag}{inner}>{text}" + (f"</{tag}>" if shut else ""))
        labels.append(kept)

    def links(n: int, tag: str = "li") -> None:
        for _ in range(n):
            block(tag, f'<a href="/{word()}">{words(rng.randrange(1, 4), False, 0.4)}</a>', False)

    def area(names, tags, fill) -> None:
        tag = pick(tags)
        own = "" if tag != "div" and rng.random() < 0.6 else f' class="{pick(names)}"' if rng.random() < 0.8 else f' id="{pick(names)}"'
        out.append(f"<{tag}{own}>")
        fill()
        out.append(f"</{tag}>")

    def plain(n_low: int, n_high: int, boiler: float):
        def fill() -> None:
            text = words(rng.randrange(n_low, n_high), True, boiler)
            if rng.random() < 0.5:
                out.append(text)
                labels.append(False)
            else:
                block("p", text, False)
        return fill

    def menu() -> None:
        out.append("<ul>")
        links(rng.randrange(2, 9))
        out.append("</ul>")

    def side() -> None:
        if rng.random() < 0.6:
            block("h3", words(rng.randrange(1, 4), False, 0.5), False)
        if rng.random() < 0.6:
            menu()
        else:
            for _ in range(rng.randrange(1, 4)):
                block("p", words(rng.randrange(4, 40), True, 0.1), False)

    def form() -> None:
        out.append("<form>")
        block("label", words(rng.randrange(1, 4), False, 0.7), False)
        out.append('<input type="text">')
        block("button", words(1, False, 0.9), False)
        out.append("</form>")

    def comments() -> None:
        block(pick(("h2", "h3")), words(2, False, 0.8), False)
        for _ in range(rng.randrange(1, 6)):
            out.append(f'<div class="{pick(COMMENT_NAMES)}">')
            if rng.random() < 0.6:
                block(pick(("div", "h4", "p")), words(2, False), False)
            block("p", words(rng.randrange(3, 80)), False)
            out.append("</div>")

    def article() -> None:
        titled = rng.random() < 0.85
        if titled:
            block(pick(("h1", "h1", "h2")), words(rng.randrange(2, 14), False), True)
        sloppy = rng.random() < 0.3
        for _ in range(rng.randrange(1, 14)):
            kind, n = rng.random(), rng.randrange(1, 12) if rng.random() < 0.25 else rng.randrange(10, 160)
            if kind < 0.75:
                text = words(n, True, 0.5 if rng.random() < 0.1 else 0.0)
                if rng.random() < 0.25:
                    text = f"<b>{text}<br>" if sloppy else f"<b>{text}</b>"
                if rng.random() < 0.15:
                    text += f' <a href="#">{words(2, False)}</a> {words(5)}'
                block("p", text, True, not sloppy or rng.random() < 0.6)
            elif kind < 0.82:
                block(pick(("h2", "h3")), words(rng.randrange(1, 8), False), True)
            elif kind < 0.88:
                out.append("<ul>")
                for _ in range(rng.randrange(1, 5)):
                    block("li", words(rng.randrange(2, 25)), True)
                out.append("</ul>")
            elif kind < 0.92:
                block("blockquote", words(n), True)
            elif kind < 0.95:
                out.append("<div>")
                block("p", words(n), True)
                out.append("</div>")
            else:
                area(AD_NAMES, ("div", "aside"), plain(2, 25, 0.2))

    out.append('<html lang="xx"><head>')
    block("title", words(rng.randrange(2, 12), False), False)
    out.append("<style>p{margin:0}</style><script>var x;</script></head><body>")
    parts = [
        (HEAD_NAMES, ("header", "div"), plain(1, 12, 0.4)),
        (NAV_NAMES, ("nav", "div"), menu),
        (AD_NAMES, ("div", "aside"), plain(2, 30, 0.1)),
        (NOTICE_NAMES, ("div", "section"), plain(5, 40, 0.5)),
        (SIDE_NAMES, ("aside", "div"), side),
        (NOTICE_NAMES, ("div",), form),
    ]
    for k in rng.sample(range(len(parts)), len(parts)):
        if rng.random() < (0.7 if parts[k][2] is menu else 0.4):
            area(*parts[k])
    if rng.random() < 0.95:
        area(ARTICLE_NAMES, ("article", "article", "main", "div"), article)
    tail = [
        (COMMENT_NAMES, ("div", "section"), comments),
        (SIDE_NAMES, ("aside", "div"), side),
        (AD_NAMES, ("div",), plain(2, 30, 0.1)),
        (NOTICE_NAMES, ("div",), form),
    ]
    for k in rng.sample(range(len(tail)), len(tail)):
        if rng.random() < 0.35:
            area(*tail[k])
    if rng.random() < 0.85:
        area(FOOT_NAMES, ("footer", "footer", "div"), plain(2, 30, 0.3))
    if rng.random() < 0.85:
        out.append("</body></html>")
    return "".join(out), labels


def training_pages(n: int, seed: int = SEED) -> list[tuple[list, np.ndarray]]:
    rng, made = random.Random(seed), []
    while len(made) < n:
        page, labels = composed_page(rng)
        cut = blocks(page)
        if len(cut) == len(labels):
            made.append((cut, np.array(labels, float)))
    return made


@functools.lru_cache(maxsize=1)
def trained_labeller() -> Labeller:
    return Labeller().trained(training_pages(TRAIN_PAGES))


def main_texts(pages: list[str | None], model: Labeller, features: Features) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p, features.paths) for p in pages]
    out = [""] * len(pages)
    for i, page in enumerate(cut):
        if len(page) > SLICE_BLOCKS:
            out[i] = "\n\n".join(text for (_, text, _), q in zip(page, model.long_scores(features, page), strict=True) if q >= THRESHOLD)
            cut[i] = []
    # pages of like length run side by side
    order, first = sorted((i for i, c in enumerate(cut) if c), key=lambda i: len(cut[i])), 0
    while first < len(order):
        last, longest = first, len(cut[order[first]])
        while last < len(order) and (last == first or (len(cut[order[last]]) * (last - first + 1) <= SLICE_BLOCKS and len(cut[order[last]]) <= 2 * longest + 8)):
            last += 1
        chosen = [cut[i] for i in order[first:last]]
        counts = np.array([len(c) for c in chosen])
        p = model.scores(features.of(chosen), counts)
        at = 0
        for i, c in zip(order[first:last], chosen, strict=True):
            out[i] = "\n\n".join(text for (_, text, _), q in zip(c, p[at : at + len(c)], strict=True) if q >= THRESHOLD)
            at += len(c)
        first = last
    return out


def extracted(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with the html replaced by ``text`` and its ``n_chars``; the network (of fixed size) goes with the tasks."""
    pages = clear_of(pages, "text", "n_chars")
    model = pages.sparkSession.sparkContext.broadcast(trained_labeller())
    memo = {}

    def make():
        features = memo.setdefault("features", Features())
        return lambda texts: {"text": main_texts(texts, model.value, features)}

    return per_text(pages, html_col, {"text": ("string", pa.string())}, make).withColumn("n_chars", F.char_length("text").cast("bigint"))


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's rows for op10."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
