"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between block-level tags, with
the path of open tags above it. A bidirectional LSTM in numpy reads, for every
block, hashed vectors of its tag path (tag names, words of class, id and role)
and of all its words, and a few statistics, and labels the block as main text or
not from the context of the whole page.

The labeller is trained on at most ``TRAIN_PAGES`` pages of at most
``TRAIN_CHARS`` characters, those with the smallest hash of page_id. Their
blocks get labels from what tags and names say; variants of the pages with
other containers and with added notices, sidebars, forms and comments teach it
that position and names go together.

Defined results: a null or empty page, or one without blocks, gives an empty
text; scripts, styles, markup comments and tags never give text; unclosed and
stray tags are read as browsers read them where it matters for blocks; a null
url or page_id stays null; repeated rows get equal results; an empty table
gives no row; further columns are ignored.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.llm.shared import batches_of, smallest

TRAIN_PAGES = 300
TRAIN_CHARS = 40_000
PATH_SPACE, WORD_SPACE = 1024, 1024
SIZE, HIDDEN, STATS = 20, 12, 6
EPOCHS = 8
#: Places whose vectors are looked up at once.
PIECE = 1 << 16
#: Least number of gradient steps, for small samples.
STEPS = 400

#: Fixed values of HTML: tags whose text is not shown, tags without an end, and tags inside a line.
RAW = frozenset("script style template noscript iframe object svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Names that mark what is not main text, and names of main containers (fixed values for the training labels).
ASIDE_TAGS = frozenset("nav header footer aside form button select option label textarea fieldset head title menu dialog".split())
ASIDE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner promo sponsor sponsored cookie cookies consent notice alert popup modal newsletter subscribe"
    " sidebar side widget nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer foot copyright comment comments reply replies"
    " respond disqus social share sharing related recommended pagination pager tags toolbar login signup search form".split()
)
MAIN_TAGS = frozenset("article main".split())
MAIN_NAMES = frozenset("article content post entry story body text main".split())

TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[a-zA-Z/!?][^>]*+(?:>|\Z)", re.S
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[a-z]+")
#: An end tag inside one of these closes nothing outside of it, unless it belongs to the table.
WALLS = frozenset("table td th caption".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
#: What the start of a table's part ends, the innermost first.
CELLS = ("td", "th", "caption")
ROW_GROUPS = ("thead", "tbody", "tfoot")
ENDED = {**dict.fromkeys(CELLS, CELLS), "tr": (*CELLS, "tr"), **dict.fromkeys(ROW_GROUPS, (*CELLS, "tr", *ROW_GROUPS))}


class Open:
    """An open tag, its names and the open tag above it, so that a path of any depth costs one link."""

    __slots__ = ("tag", "names", "above")

    def __init__(self, tag: str, names: tuple[str, ...], above: Open | None) -> None:
        self.tag, self.names, self.above = tag, names, above


class Block:
    __slots__ = ("text", "inner", "linked", "links")

    def __init__(self, text: str, inner: Open | None, linked: int, links: int) -> None:
        self.text, self.inner, self.linked, self.links = text, inner, linked, links

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Open tags with their names, the innermost last."""
        out, tag = [], self.inner
        while tag:
            out.append((tag.tag, tag.names))
            tag = tag.above
        return tuple(reversed(out))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    inner: Open | None = None
    scopes: list[Counter[str]] = [Counter()]  # open tags by name, one counter for each open wall
    parts: list[str] = []
    state = [0, 0, 0]  # open links, characters in links, links of the block
    ends: dict[str, re.Pattern] = {}

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, inner, state[1], state[2]))
        state[1] = state[2] = 0

    def pop(tag: str) -> None:
        nonlocal inner
        for scope in reversed(scopes):
            if scope[tag]:
                break
            if tag not in TABLE_PARTS or scope["table"]:
                return
        else:
            return
        found = False
        while not found:
            found = inner.tag == tag
            if inner.tag in WALLS:
                scopes.pop()
            else:
                scopes[-1][inner.tag] -= 1
            inner = inner.above

    def add(text: str) -> None:
        if text:
            text = html.unescape(text)  # a reference ends where a tag begins
            parts.append(text)
            if state[0]:
                state[1] += len(text)

    at = 0
    while True:
        found = TAG.search(page, at)
        if found is None:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            close()
        if found[1]:
            if tag == "a":
                state[0] = 0
            pop(tag)
            continue
        if tag in RAW:
            end = ends.setdefault(tag, re.compile(rf"</{re.escape(tag)}[\s/>]", re.I)).search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in VOID:
            continue
        if tag == "a":
            state[0] = 1
            state[2] += 1
        if not inline:
            if scopes[-1]["p"] and tag != "button":
                pop("p")
            for ended in ENDED.get(tag, ()):
                pop(ended)
            if tag in ("li", "option", "dt", "dd") and inner and inner.tag == tag:
                pop(tag)
        attributes = found[3]
        names: tuple[str, ...] = ()
        if attributes and "=" in attributes:
            names = tuple(w for m in NAMES.finditer(attributes) for w in WORD.findall((m[1] or m[2] or m[3] or "").lower()))
        inner = Open(tag, names, inner)
        if tag in WALLS:
            scopes.append(Counter())
        scopes[-1][tag] += 1
    close()
    return out


def told(block: Block) -> bool:
    """Label for training: what tags and names say."""
    inside = False
    heading = block.path and block.path[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6")
    for tag, names in block.path:
        if tag == "header" and inside and heading:
            continue
        if tag in ASIDE_TAGS or (names and not ASIDE_NAMES.isdisjoint(names) and tag not in ("body", "html", *MAIN_TAGS)):
            return False
        inside = inside or tag in MAIN_TAGS or not MAIN_NAMES.isdisjoint(names)
    return inside or (len(block.text) > 40 and block.linked * 2 < len(block.text))


def variants(page: str, others: list[str], rng: random.Random) -> list[str]:
    """The page, and versions of it in other frames with added blocks that are not main text."""
    text = lambda n: html.escape(rng.choice(others)[: rng.randrange(20, n)])
    extra = [
        lambda: f'<aside class="{rng.choice(["sidebar", "widget", "related"])}"><h3>{text(40)}</h3><p>{text(200)}</p></aside>',
        lambda: f'<div class="{rng.choice(["cookie-notice", "consent banner", "alert notice", "popup modal"])}"><p>{text(160)}</p><button>OK</button></div>',
        lambda: f'<form action="/s"><label>{text(30)}</label><input name="q"><button>{text(25)}</button></form>',
        lambda: f'<{rng.choice(["section", "div"])} {rng.choice(["id", "class"])}="comments">' + "".join(f'<div class="comment"><p>{text(300)}</p></div>' for _ in range(rng.randrange(1, 5))) + "</div>",
        lambda: f'<div class="{rng.choice(["ad", "advert", "sponsored", "promo"])}">{text(150)}</div>',
        lambda: f'<header><a href="/">{text(30)}</a><p>{text(80)}</p></header>',
        lambda: f'<ul class="{rng.choice(["menu", "breadcrumbs", "pagination", "share"])}">' + "".join(f'<li><a href="/{k}">{text(25)}</a></li>' for k in range(5)) + "</ul>",
        lambda: f'<div class="{rng.choice(["newsletter", "subscribe", "login", "search"])}"><p>{text(120)}</p></div>',
    ]
    made = [page]
    for _ in range(2):
        new = page
        ends = [m.end() for m in re.finditer("</p>", new)]
        for spot in sorted(rng.sample(ends, min(len(ends), 2)), reverse=True):
            word = html.escape(rng.choice(rng.choice(others).split() or ["and"]))
            new = f"{new[:spot]}<p>{word}</p>{new[spot:]}"
        if rng.random() < 0.5:  # paragraphs of a few words, some of them all alike
            one, size = rng.choice(others), rng.randrange(1, 6)
            alike = rng.random() < 0.5
            new = re.sub("<p>([^<]+)", lambda m: "<p>" + html.escape(" ".join((one if alike else m[1]).split()[:size])), new)
        frame = rng.choice(["article", "main", 'div class="content"', 'div class="post-body"', 'div id="main-content"', 'section class="story"', 'div class="entry-text"'])
        new = re.sub(r"<article\b[^>]*>", f"<{frame}>", new).replace("</article>", f"</{frame.split()[0]}>")
        if rng.random() < 0.4:
            new = new.replace("<nav>", '<div class="menu">').replace("</nav>", "</div>")
        if rng.random() < 0.4:
            new = new.replace("<footer>", '<div id="footer">').replace("</footer>", "</div>")
        spots = [m.start() for m in re.finditer(r"<(?:p|h1|footer|nav|div)\b|</body>", new)]
        for spot in sorted(rng.sample(spots, min(len(spots), rng.randrange(1, 4))), reverse=True):
            new = new[:spot] + rng.choice(extra)() + new[spot:]
        made.append(new)
    return made


class Encoded:
    """Blocks of one page as places of path and word vectors, and statistics."""

    def __init__(self) -> None:
        self.places: dict[str, int] = {}

    def place(self, name: str, space: int) -> int:
        found = self.places.get(name)
        if found is None:
            if len(self.places) > 200_000:
                self.places.clear()
            found = self.places[name] = zlib.crc32(name.encode()) % space
        return found

    def of(self, blocks: list[Block]) -> tuple[list[list[int]], list[dict[int, int]], np.ndarray]:
        """Places of paths, how often each place has a word of the block (all its words), and statistics."""
        paths, words, stats = [], [], np.zeros((len(blocks), STATS))
        sets: dict[Open | None, frozenset[str]] = {None: frozenset()}  # names of a tag and all above; shared where a tag adds none
        known: dict[tuple, list[int]] = {}
        for k, b in enumerate(blocks):
            fresh, tag = [], b.inner
            while tag not in sets:
                fresh.append(tag)
                tag = tag.above
            names = sets[tag]
            for tag in reversed(fresh):
                own_names = {f"t {tag.tag}", *(f"n {n}" for n in tag.names)}
                names = sets[tag] = names if own_names <= names else names | own_names
            key = (names, b.inner and b.inner.tag)
            path = known.get(key)
            if path is None:
                path = known[key] = sorted(self.place(n, PATH_SPACE) for n in (names | {f"last {b.inner.tag}"} if b.inner else names))
            paths.append(path)
            own = b.text.split()
            times: Counter[int] = Counter()
            for w, n in Counter(map(str.lower, own)).items():
                times[self.place("w " + w, WORD_SPACE)] += n
            words.append(times)
            n = len(b.text)
            stats[k] = (
                np.log1p(n) / 6, np.log1p(len(own)) / 4, min(1.0, b.linked / n), min(b.links, 5) / 5, min(1.0, 4 * (b.text.count(".") + b.text.count(",")) / len(own)), 1.0,
            )
        return paths, words, stats


class Labeller:
    """Bidirectional LSTM over encoded blocks."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        scale = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.weights = {
            "path": rng.normal(0, 0.1, (PATH_SPACE, SIZE)), "word": rng.normal(0, 0.05, (WORD_SPACE, SIZE)), "stat": scale(STATS, SIZE),
            "out": scale(2 * HIDDEN, 1), "bias": np.zeros(1),
        }
        for way in "fb":
            self.weights |= {f"x{way}": scale(SIZE, 4 * HIDDEN), f"h{way}": scale(HIDDEN, 4 * HIDDEN), f"c{way}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}

    def inputs(self, pages: list[tuple]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Vectors of all blocks (pages, steps, SIZE), the mask, and what the gradient needs."""
        steps = max(len(p[0]) for p in pages)
        mask = np.zeros((len(pages), steps), bool)
        for k, p in enumerate(pages):
            mask[k, : len(p[0])] = True
        paths = [x for p in pages for x in p[0]]
        words = [x for p in pages for x in p[1]]
        stats = np.concatenate([p[2] for p in pages])
        flat = stats @ self.weights["stat"]
        kept = []
        for name, lists, mean in (("path", paths, False), ("word", words, True)):
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            places = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
            row = np.repeat(np.arange(len(sizes)), sizes)
            if mean:
                times = np.fromiter((n for x in lists for n in x.values()), np.float64, len(places))
                share = times / np.bincount(row, times, len(sizes))[row]
            else:
                share = np.full(len(places), 0.5)
            some = np.flatnonzero(sizes)
            ends = np.cumsum(sizes)
            starts = (ends - sizes)[some]
            at = 0
            while at < len(some):  # in pieces, since a vector is much larger than its place
                stop = max(at + 1, int(np.searchsorted(starts, starts[at] + PIECE)))
                low, high = starts[at], ends[some[stop - 1]]
                part = self.weights[name][places[low:high]] * share[low:high, None]
                flat[some[at:stop]] += np.add.reduceat(part, starts[at:stop] - low, axis=0)
                at = stop
            kept.append((name, places, share, row))
        x = np.zeros((len(pages), steps, SIZE))
        x[mask] = np.tanh(flat)
        return x, mask, (stats, kept)

    def run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states of one direction. States do not change on padding."""
        pages, steps, _ = x.shape
        projected = x @ self.weights[f"x{way}"] + self.weights[f"c{way}"]
        h, c = np.zeros((pages, HIDDEN)), np.zeros((pages, HIDDEN))
        out, tape = np.zeros((pages, steps, HIDDEN)), []
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = projected[:, t] + h @ self.weights[f"h{way}"]
            gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[:, t, None]
            new_c = np.where(on, f * c + i * g, c)
            wide = np.tanh(new_c)
            new_h = np.where(on, o * wide, h)
            if keep:
                tape.append((t, h, c, i, f, o, g, wide, on))
            h, c = new_h, new_c
            out[:, t] = h
        return out, tape

    def chances(self, pages: list[tuple]) -> list[np.ndarray]:
        """Chance of main text for every block of every page."""
        x, mask, _ = self.inputs(pages)
        both = np.concatenate([self.run(x, mask, "f")[0], self.run(x, mask, "b")[0]], axis=2)
        p = 1 / (1 + np.exp(-(both @ self.weights["out"] + self.weights["bias"])[:, :, 0]))
        return [p[k, : len(page[0])] for k, page in enumerate(pages)]

    def slopes(self, pages: list[tuple], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss."""
        w = self.weights
        x, mask, (stats, kept) = self.inputs(pages)
        states = {way: self.run(x, mask, way, keep=True) for way in "fb"}
        both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
        p = 1 / (1 + np.exp(-(both @ w["out"] + w["bias"])[:, :, 0]))
        want = np.zeros(mask.shape)
        for k, own in enumerate(labels):
            want[k, : len(own)] = own
        error = np.where(mask, p - want, 0) / mask.sum()
        slope = {"out": np.einsum("pth,pt->h", both, error)[:, None], "bias": np.array([error.sum()])}
        back = error[:, :, None] * w["out"][:, 0]
        dx = np.zeros_like(x)
        for n, way in enumerate("fb"):
            dh, dc = np.zeros((len(pages), HIDDEN)), np.zeros((len(pages), HIDDEN))
            slope[f"h{way}"], dz_all = np.zeros_like(w[f"h{way}"]), np.zeros((*mask.shape, 4 * HIDDEN))
            for t, h, c, i, f, o, g, wide, on in reversed(states[way][1]):
                dh = dh + back[:, t, n * HIDDEN : (n + 1) * HIDDEN]
                inner = np.where(on, dc + dh * o * (1 - wide * wide), 0)
                dz = np.concatenate([inner * g * i * (1 - i), inner * c * f * (1 - f), np.where(on, dh * wide, 0) * o * (1 - o), inner * i * (1 - g * g)], axis=1)
                slope[f"h{way}"] += h.T @ dz
                dz_all[:, t] = dz
                dh, dc = np.where(on, dz @ w[f"h{way}"].T, dh), np.where(on, inner * f, dc)
            slope[f"x{way}"] = np.einsum("pts,ptz->sz", x, dz_all)
            slope[f"c{way}"] = dz_all.sum((0, 1))
            dx += dz_all @ w[f"x{way}"].T
        flat = (dx * (1 - x * x))[mask]
        slope["stat"] = stats.T @ flat
        for name, places, share, row in kept:
            slope[name] = np.zeros_like(w[name])
            np.add.at(slope[name], places, flat[row] * share[:, None])
        return slope

    def fit(self, pages: list[tuple], labels: list[np.ndarray], epochs: int = EPOCHS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        moment = {k: np.zeros_like(v) for k, v in self.weights.items()}
        spread = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        epochs = max(epochs, -(-STEPS * 16 // len(pages)))
        for epoch in range(epochs):
            order = rng.permutation(len(pages))
            for start in range(0, len(order), 16):
                chosen = order[start : start + 16]
                step += 1
                for k, s in self.slopes([pages[i] for i in chosen], [labels[i] for i in chosen]).items():
                    moment[k] = 0.9 * moment[k] + 0.1 * s
                    spread[k] = 0.999 * spread[k] + 0.001 * s * s
                    self.weights[k] = self.weights[k] - 0.01 / (1 + 8 * epoch / epochs) * (moment[k] / (1 - 0.9**step)) / (np.sqrt(spread[k] / (1 - 0.999**step)) + 1e-8)


def train(pages: DataFrame, most: int = TRAIN_PAGES) -> Labeller:
    """Fit on a bounded sample of pages, which is all that reaches the driver."""
    fit_for = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).filter(
        F.length("html").between(1, TRAIN_CHARS)
    )
    sample = smallest(fit_for, F.xxhash64("page_id", F.length("html")), most)
    taken = [r.html for r in sorted(sample.collect(), key=lambda r: (r.page_id is not None, r.page_id, r.html))]
    labeller, encoder, rng = Labeller(), Encoded(), random.Random(3)
    others = [b.text for page in taken[:100] for b in blocks_of(page)] or ["text"]
    rows, labels = lessons(taken, encoder, others, rng)
    if rows:
        labeller.fit(rows, labels)
    return labeller


def worn(words: dict[int, int], rng: random.Random) -> dict[int, int]:
    chance = rng.random()
    return words if chance < 0.25 else Counter(rng.randrange(WORD_SPACE) for _ in range(sum(words.values()))) if chance < 0.4 else {}


def lessons(taken: list[str], encoder: Encoded, others: list[str], rng: random.Random) -> tuple[list[tuple], list[np.ndarray]]:
    """Encoded variants of pages with labels. Most blocks lose their words or get chance ones, so that rare words are not learnt by heart."""
    rows, labels = [], []
    for page in taken:
        for version in variants(page, others, rng):
            blocks = blocks_of(version)
            if blocks:
                paths, words, stats = encoder.of(blocks)
                rows.append((paths, [worn(w, rng) for w in words], stats))
                labels.append(np.array([told(b) for b in blocks], float))
    return rows, labels


def texts_of_pages(pages: list[str | None], labeller: Labeller, encoder: Encoded) -> list[str]:
    """Main texts; pages of like length share a run, so padding and memory stay small."""
    cut = [blocks_of(p) if p else [] for p in pages]
    out = [""] * len(pages)
    order = sorted((k for k in range(len(cut)) if cut[k]), key=lambda k: len(cut[k]))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and stop - start < 256 and len(cut[order[stop]]) * (stop - start + 1) <= 20_000:
            stop += 1
        group = order[start:stop]
        for k, chance in zip(group, labeller.chances([encoder.of(cut[k]) for k in group]), strict=True):
            out[k] = "\n".join(b.text for b, p in zip(cut[k], chance.tolist(), strict=True) if p > 0.5)
        start = stop
    return out


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(labeller)  # of fixed size
    state: dict[str, Encoded] = {}

    def rows(batch: pa.RecordBatch) -> dict:
        texts = texts_of_pages(batch.column("html").to_pylist(), shared.value, state.setdefault("encoder", Encoded()))
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts]}

    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return batches_of(narrow, rows, "page_id long, url string, text string, n_chars long", 4 << 20)


def op4_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, train(pages))
