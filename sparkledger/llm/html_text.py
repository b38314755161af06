"""Main text of web pages: a bidirectional LSTM labels each block of a page as content or not.

A page is cut into leaf blocks, in page order: runs of text that no block-level tag interrupts. Each block is a vector of
its tag path (hashed tags and the parts of class, id and role on the way from the root), its words (hashed) and a few
numbers. An LSTM reads the blocks forwards, another backwards, so that every block is judged with the whole page in
view; the blocks judged as content, joined by a line feed, are the main text.

The model is fitted here, with numpy, on SAMPLE_PAGES pages of smallest hash. Their labels come from landmarks: blocks
inside article or main are content, but for landmarks of other kinds in them. Landmarks are rarely all there, so that each
page is also seen rearranged: its content under other containers, its other blocks and further ones under the
containers that such blocks have elsewhere, landmarks left out. The model (about 60,000 numbers) is broadcast; pages
are read, labelled and joined where Spark reads them, without a shuffle.

Defined results: a null or empty page, and one without content, has an empty text; character references are decoded
once; white space inside a block (line breaks too) is one space; comments, scripts, styles, templates, titles and
fallback frames are no blocks; a tag that never ends is dropped, tags left open end where HTML ends them; repeated rows
each get their own result row; an empty table gives an empty result; a page of any length is one sequence, whole;
columns of any name pass through. Where no sampled page has a landmark, paragraphs stand for content in the fit.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import free_name

#: The most pages that the model is fitted on, the longest page and the most blocks of one among them.
SAMPLE_PAGES, SAMPLE_CHARS, SAMPLE_BLOCKS = 400, 1 << 16, 200
PASSES, BATCH, RATE, DECAY, SEED = 10, 40, 0.01, 0.02, 42
#: Places of the hashed path parts and words, the sizes of their vectors, numbers of a block, and cells of an LSTM.
PATHS, WORDS, PATH_SIZE, WORD_SIZE, NUMBERS, CELLS = 1024, 1024, 24, 12, 6, 24
#: Words that a block counts as having besides its own, so that few words say little.
FEW = 8
#: Blocks, with padding, that are labelled at once, unless one page has more.
LABELLED = 1 << 14

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|template|noscript|iframe|svg|title|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1[^>]*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][^\s/>]*)([^>]*)>|</?[a-z][^>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_]+")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag ends, where that is the innermost open block or its neighbour.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Block:
    """A leaf block: the tags and attribute parts on its path, its text, and how much of the text is in links."""

    path: tuple[str, ...]
    text: str
    links: float = 0.0


@lru_cache(maxsize=1 << 14)
def _parts(tag: str, attributes: str) -> tuple[str, ...]:
    """An element as path parts: its tag, and parts of its class, id and role with their first four letters."""
    found = [f"<{tag}"]
    for m in _NAMED.finditer(attributes):
        for x in _PARTS.findall(m[2] or m[3] or m[4] or ""):
            found += [x.lower(), f"{x.lower()[:4]}-"]
    return tuple(found)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    page = page or ""
    found: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    said: list[str] = []
    linked = links = at = 0

    def close() -> None:
        nonlocal links
        if said:
            text = " ".join("".join(said).split())
            if text:
                path = tuple(dict.fromkeys(p for tag, parts in stack if tag not in _INLINE for p in parts))
                found.append(Block(path, text, min(1.0, links / len(text))))
            said.clear()
        links = 0

    def leave(depth: int) -> None:
        nonlocal linked
        linked -= sum(tag == "a" for tag, _ in stack[depth:])
        del stack[depth:]

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            said.append(raw)
            if linked:
                links += len(raw)

    for m in _TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        ends, attributes = m[2] if m[3] else m[5], (m[4] if m[3] else m[7]) or ""
        if tag == "br":
            said.append(" ")
            continue
        if tag not in _INLINE:
            close()
        if ends:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    leave(depth)
                    break
                if tag in _INLINE and stack[depth][0] not in _INLINE:  # an inline end tag reaches no further than its block
                    break
            continue
        if tag in _VOID:
            continue
        if tag not in _INLINE:
            own = _ENDS.get(tag, ())
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or stack[depth][0] in own:
                    leave(depth)
                elif stack[depth][0] not in _INLINE:
                    break
        if not attributes.endswith("/") or tag not in _INLINE:
            stack.append((tag, _parts(tag, attributes)))
            linked += tag == "a"
    text(page[at:])
    close()
    return found


@lru_cache(maxsize=1 << 14)
def _path_places(path: tuple[str, ...]) -> tuple[int, ...]:
    last = next((p for p in reversed(path) if p[0] == "<"), "")
    return (*(crc32(p.encode()) % PATHS for p in path), crc32(f"leaf {last}".encode()) % PATHS)


@dataclass
class Leaves:
    """Blocks as numbers: hashed path parts and words in a line each, with where each block's begin."""

    paths: np.ndarray
    path_at: np.ndarray
    words: np.ndarray
    word_at: np.ndarray
    numbers: np.ndarray


def _word_places(text: str) -> list[int]:
    return [crc32(w) % WORDS for w in text.lower().encode("utf-8", "replace").split()] or [0]


def leaves_of(page: list[Block], word_places: Callable[[str], list[int]] = _word_places) -> Leaves:
    paths, words, numbers = [], [], []
    for k, b in enumerate(page):
        paths.append(_path_places(b.path))
        words.append(word_places(b.text))
        n = len(b.text)
        numbers.append((math.log1p(n) / 5, math.log1p(len(words[-1])) / 4, b.links, b.text[-1] in ".!?…\"”»", k / len(page), 1 / (1 + k)))
    starts = lambda x: np.concatenate([[0], np.cumsum([len(y) for y in x])[:-1]]).astype(np.int64)
    flat = lambda x: np.fromiter(chain.from_iterable(x), np.int64)
    return Leaves(flat(paths), starts(paths), flat(words), starts(words), np.array(numbers, np.float32).reshape(-1, NUMBERS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """The network's numbers; all are fitted."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new() -> Labeller:
        rng = np.random.default_rng(SEED)
        size = PATH_SIZE + WORD_SIZE + NUMBERS
        made = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        w = {"path": made(PATHS, PATH_SIZE, scale=0.3), "word": made(WORDS, WORD_SIZE, scale=0.3)}
        for way in ("fore", "back"):
            bias = np.zeros(4 * CELLS, np.float32)
            bias[CELLS : 2 * CELLS] = 1  # cells keep what they hold at first
            w |= {f"{way}_x": made(size, 4 * CELLS, scale=size**-0.5), f"{way}_h": made(CELLS, 4 * CELLS, scale=CELLS**-0.5), f"{way}_b": bias}
        return Labeller(w | {"out": made(2 * CELLS + size, scale=0.1), "out_b": np.zeros(1, np.float32)})

    def vectors(self, page: Leaves) -> np.ndarray:
        w = self.weights
        if not len(page.numbers):
            return np.zeros((0, PATH_SIZE + WORD_SIZE + NUMBERS), np.float32)
        counts = FEW + np.diff(np.append(page.word_at, len(page.words)))[:, None]
        return np.concatenate(
            [np.add.reduceat(w["path"][page.paths], page.path_at), np.add.reduceat(w["word"][page.words], page.word_at) / counts, page.numbers], axis=1
        )

    def read(self, way: str, x: np.ndarray, there: np.ndarray, kept: list | None = None) -> np.ndarray:
        """The cell outputs of an LSTM over pages x (page, block, number); where a page has ended, it stands still."""
        w_x, w_h, bias = (self.weights[f"{way}_{k}"] for k in "xhb")
        h = c = np.zeros((len(x), CELLS), np.float32)
        out = np.zeros((*x.shape[:2], CELLS), np.float32)
        for t in range(x.shape[1]):
            z = x[:, t] @ w_x + h @ w_h + bias  # step by step, so that no product is large enough for threads
            gates, new = _sigmoid(z[:, : 3 * CELLS]), np.tanh(z[:, 3 * CELLS :])
            put, keep, show = np.split(gates, 3, axis=1)
            m = there[:, t, None]
            c1 = m * (keep * c + put * new) + (1 - m) * c
            shown = np.tanh(c1)
            h1 = m * (show * shown) + (1 - m) * h
            if kept is not None:
                kept.append((h, c, put, keep, show, new, shown, m))
            h, c = h1, c1
            out[:, t] = h
        return out

    def unread(self, way: str, x: np.ndarray, kept: list, d_out: np.ndarray, slopes: dict[str, np.ndarray]) -> np.ndarray:
        """The slopes of read(), from those of its outputs; returns those of x."""
        w_x, w_h = self.weights[f"{way}_x"], self.weights[f"{way}_h"]
        d_x, z = np.zeros_like(x), np.zeros((len(x), 4 * CELLS), np.float32)
        d_h = d_c = np.zeros((len(x), CELLS), np.float32)
        for t in range(x.shape[1] - 1, -1, -1):
            h, c, put, keep, show, new, shown, m = kept[t]
            d = d_h + d_out[:, t]
            own = d * m
            d_c1 = d_c + own * show * (1 - shown**2)
            live = d_c1 * m
            z[:, :CELLS] = live * new * put * (1 - put)
            z[:, CELLS : 2 * CELLS] = live * c * keep * (1 - keep)
            z[:, 2 * CELLS : 3 * CELLS] = own * shown * show * (1 - show)
            z[:, 3 * CELLS :] = live * put * (1 - new**2)
            slopes[f"{way}_x"] += x[:, t].T @ z
            slopes[f"{way}_h"] += h.T @ z
            slopes[f"{way}_b"] += z.sum(0)
            d_x[:, t] = z @ w_x.T
            d_h, d_c = z @ w_h.T + d * (1 - m), live * keep + d_c1 * (1 - m)
        return d_x

    @staticmethod
    def padded(sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Which places of a (page, block) table hold a block, and each place's mirror image within its page."""
        n = np.array(sizes)[:, None]
        place = np.arange(max(sizes))[None]
        return (place < n).astype(np.float32), np.where(place < n, n - 1 - place, place)

    def chances(self, pages: list[Leaves]) -> list[np.ndarray]:
        """The chance of being content, for each block of each page."""
        sizes = [len(p.numbers) for p in pages]
        order, out = sorted(range(len(pages)), key=sizes.__getitem__), [np.zeros(0, np.float32)] * len(pages)
        order = [k for k in order if sizes[k]]
        while order:
            n = 1  # from the longest on, so that pages of about one length share a table
            while n < len(order) and (n + 1) * sizes[order[-1]] <= LABELLED:
                n += 1
            part, order = order[-n:], order[:-n]
            scores = self._scores([pages[k] for k in part])[0]
            for k, z in zip(part, scores, strict=True):
                out[k] = _sigmoid(z[: sizes[k]])
        return out

    def _scores(self, pages: list[Leaves], kept: dict[str, list] | None = None) -> tuple[np.ndarray, ...]:
        there, mirror = self.padded([len(p.numbers) for p in pages])
        x = np.zeros((*there.shape, PATH_SIZE + WORD_SIZE + NUMBERS), np.float32)
        for k, p in enumerate(pages):
            x[k, : len(p.numbers)] = self.vectors(p)
        rows = np.arange(len(pages))[:, None]
        turned = x[rows, mirror]
        fore = self.read("fore", x, there, kept and kept["fore"])
        back = self.read("back", turned, there, kept and kept["back"])[rows, mirror]
        w = self.weights["out"]
        z = fore @ w[:CELLS] + back @ w[CELLS : 2 * CELLS] + x @ w[2 * CELLS :] + self.weights["out_b"]
        return z, x, turned, fore, back, there, mirror

    def slopes(self, pages: list[Leaves], marks: list[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
        """The mean loss of the pages' blocks, and its slope by each number."""

        class Kept(list):
            __bool__ = lambda self: True

        kept = {"fore": Kept(), "back": Kept()}
        z, x, turned, fore, back, there, mirror = self._scores(pages, kept)
        y = np.zeros(there.shape, np.float32)
        for k, m in enumerate(marks):
            y[k, : len(m)] = m
        chance, total = _sigmoid(z), there.sum()
        loss = float(-(there * (y * np.log(chance + 1e-9) + (1 - y) * np.log(1 - chance + 1e-9))).sum() / total)
        d = ((chance - y) * there / total).astype(np.float32)
        out = {k: np.zeros_like(v) for k, v in self.weights.items()}
        w, rows = self.weights["out"], np.arange(len(pages))[:, None]
        out["out_b"][0] = d.sum()
        out["out"][:] = np.concatenate([np.einsum("pt,ptk->k", d, v) for v in (fore, back, x)])
        d_x = d[..., None] * w[2 * CELLS :]
        d_x += self.unread("fore", x, kept["fore"], d[..., None] * w[:CELLS], out)
        d_x += self.unread("back", turned, kept["back"], (d[..., None] * w[CELLS : 2 * CELLS])[rows, mirror], out)[rows, mirror]
        own = np.concatenate([d_x[k, : len(p.numbers)] for k, p in enumerate(pages)])
        sizes = lambda at, all_of: np.diff(np.append(at, len(all_of)))
        n_paths, n_words = (np.concatenate(x) for x in ([sizes(p.path_at, p.paths) for p in pages], [sizes(p.word_at, p.words) for p in pages]))
        add = lambda of, places, n, d: np.stack([np.bincount(places, np.repeat(c, n), len(of)) for c in d.T], axis=1)
        out["path"] += add(out["path"], np.concatenate([p.paths for p in pages]), n_paths, own[:, :PATH_SIZE])
        out["word"] += add(out["word"], np.concatenate([p.words for p in pages]), n_words, own[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / (FEW + n_words[:, None]))
        return loss, out


#: Where other blocks than content stand on pages, and which kinds of a page's parts are named so.
AROUND = {
    "menu": (["<nav"], "nav menu navbar navigation breadcrumb breadcrumbs topnav mainmenu links tabs toc"),
    "header": (["<header"], "header masthead topbar top banner site-header page-header branding logo tagline"),
    "footer": (["<footer"], "footer bottom copyright colophon site-footer page-footer legal imprint"),
    "sidebar": (["<aside"], "sidebar side aside widget rail related recommended popular trending more tags archive teaser"),
    "notice": (["<div"], "notice cookie cookies consent gdpr alert banner message warning popup modal overlay paywall disclaimer"),
    "advert": (["<div"], "ad ads advert advertisement adbox sponsor sponsored promo promotion affiliate adsense partner"),
    "form": (["<form"], "form newsletter subscribe signup login search contact register poll feedback share social"),
    "comments": (["<section"], "comments comment replies reply discussion responses thread feedback reader-comments disqus"),
}
CONTENT = "content article post entry story main body text post-content entry-content article-body story-text page-content".split()
PLAIN = "wrapper container page site inner outer row col layout box section wrap root app block".split()
_LANDMARKS = {"<article", "<main"}
_OTHERS = {"<nav", "<header", "<footer", "<aside", "<form"}


def marks_of(page: list[Block]) -> np.ndarray | None:
    """1 for blocks under article or main without another landmark or a telling name on the way; None without such a landmark."""
    names = {n for _, said in AROUND.values() for n in said.split() if "-" not in n} - {"body", "text", "section", "top", "banner", "more", "links", "share", "tags"}
    if not any(_LANDMARKS & set(b.path) for b in page):
        return None
    out = []
    for b in page:
        under = [k for k, p in enumerate(b.path) if p in _LANDMARKS]
        inner = set(b.path[under[0] :]) if under else set()
        out.append(bool(under) and not (inner & _OTHERS and b.path[-1] != "<h1") and not inner & names)
    return np.array(out, np.float32)


class Rearranged:
    """Pages made of the sample's blocks, under containers drawn anew, with the marks that follow from them."""

    def __init__(self, sample: list[tuple[list[Block], np.ndarray]]):
        self.rng = random.Random(SEED)
        self.content = [[b for b, m in zip(p, y, strict=True) if m] for p, y in sample]
        self.content = [p for p in self.content if p]
        self.other = [b for p, y in sample for b, m in zip(p, y, strict=True) if not m] or [b for p in self.content for b in p]

    def _container(self, names: list[str]) -> list[str]:
        return list(_parts("div" if self.rng.random() < 0.7 else "section", f"class='{self.rng.choice(names)}'"))

    def _plain(self) -> list[str]:
        return [p for _ in range(self.rng.choice((0, 0, 1, 1, 2))) for p in self._container(PLAIN)]

    def _around(self, kind: str, within: list[str]) -> list[Block]:
        tags, names = AROUND[kind]
        r = self.rng
        named = self._container(names.split())
        way = within + (tags if r.random() < 0.4 else []) + (named if r.random() < 0.75 else [])
        way = way if len(way) > len(within) else within + named
        n = {"menu": r.randint(1, 8), "sidebar": r.randint(1, 6), "comments": r.randint(1, 8)}.get(kind, r.randint(1, 3))
        leaf = {"menu": ["<ul", "<li"], "form": r.choice((["<label"], ["<p"], ["<button"], ["<fieldset", "<legend"])), "sidebar": r.choice((["<ul", "<li"], ["<p"], ["<h3"]))}
        out = []
        for _ in range(n):
            b = r.choice(r.choice(self.content)) if kind in ("comments", "sidebar", "notice") and r.random() < 0.6 else r.choice(self.other)
            own = leaf.get(kind) or r.choice(([], ["<p"], ["<p"], ["<div"], ["<h4"]))
            linked = 1.0 if kind == "menu" or kind == "sidebar" and r.random() < 0.5 else b.links if r.random() < 0.7 else 0.0
            out.append(Block(tuple(dict.fromkeys(way + own)), b.text, linked))
        return out

    def __call__(self, k: int) -> tuple[list[Block], np.ndarray]:
        r, content = self.rng, self.content[k % len(self.content)]
        root = ["<html", "<body", *self._plain()]
        head, tail, made = [], [], []
        for kind, place in (("header", head), ("menu", head), ("notice", head), ("advert", head), ("sidebar", r.choice((head, tail))), ("comments", tail), ("form", r.choice((head, tail))), ("advert", tail), ("sidebar", tail), ("notice", tail), ("footer", tail)):
            if r.random() < 0.45:
                place += self._around(kind, root)
        holder = r.choice((["<article"], ["<main"], ["<main", "<article"], [], []))
        way = root + holder + (self._container(CONTENT) if not holder or r.random() < 0.4 else [])
        inside = [kind for kind in ("advert", "sidebar", "form", "comments", "notice", "menu") if r.random() < 0.12]
        for n, b in enumerate(content):
            own = [b.path[-1]] if b.path[-1:] and b.path[-1][0] == "<" and r.random() < 0.7 else r.choice((["<p"], ["<p"], ["<h2"], ["<ul", "<li"], ["<blockquote", "<p"], ["<div"], ["<pre"], ["<table", "<tr", "<td"], ["<section", "<p"]))
            if n == 0 and r.random() < 0.6:
                own = ["<h1"]
            made.append((Block(tuple(dict.fromkeys(way + own)), b.text, b.links if r.random() < 0.9 else r.random()), 1.0))
            if inside and r.random() < 0.2:
                made += [(x, 0.0) for x in self._around(inside.pop(), way)]
        made += [(x, 0.0) for kind in inside for x in self._around(kind, way)]
        page = [(b, 0.0) for b in head] + made + [(b, 0.0) for b in tail]
        return [b for b, _ in page], np.array([m for _, m in page], np.float32)


def fit_pages(pages: list[str], passes: int = PASSES) -> Labeller:
    """A labeller of the given pages' blocks, by steps along the slope (Adam) over batches of pages of about one length."""
    model = Labeller.new()
    cut = [b for b in map(blocks, pages) if b and len(b) <= SAMPLE_BLOCKS]
    sample = [(b, m) for b in cut if (m := marks_of(b)) is not None]
    sample = sample or [(b, np.array([x.path[-1:] == ("<p",) for x in b], np.float32)) for b in cut]
    sample = [(b, m) for b, m in sample if m.any()]
    if not sample:
        return model
    places = cache(_word_places)
    made, own = Rearranged(sample), [(leaves_of(b, places), m) for b, m in sample]
    first, second = ({k: np.zeros_like(v) for k, v in model.weights.items()} for _ in range(2))
    step = 0
    for n in range(passes):
        other = [made(k) for k in range(2 * len(sample))]
        seen = own + [(leaves_of(b, places), m) for b, m in other]
        seen.sort(key=lambda x: (len(x[1]), x[0].numbers[0, 0]))
        parts = [seen[k : k + BATCH] for k in range(0, len(seen), BATCH)]
        made.rng.shuffle(parts)
        for part in parts:
            _, slopes = model.slopes([p for p, _ in part], [m for _, m in part])
            size = math.sqrt(sum(float(np.square(g).sum()) for g in slopes.values()))
            step += 1
            rate = RATE * (1 - n / passes) * math.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in slopes.items():
                g *= min(1.0, 5 / max(size, 1e-9))
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.weights[k] -= rate * (first[k] / (np.sqrt(second[k]) + 1e-8) + DECAY * model.weights[k])
    return model


def fit(pages: DataFrame, column: str = "html", sample_pages: int = SAMPLE_PAGES, passes: int = PASSES) -> Labeller:
    """A labeller fitted on sample_pages different pages at most, those of smallest hash.

    The hashes are looked up first, so that each task sends the driver hashes only; then come the pages up to the last one."""
    fit_in = pages.select(F.col(column).alias("page")).where(F.length("page").between(1, SAMPLE_CHARS)).withColumn("hash", F.xxhash64("page"))
    hashes = [r["hash"] for r in fit_in.select("hash").distinct().orderBy("hash").limit(sample_pages).collect()]
    if not hashes:
        return fit_pages([], passes)
    chosen = fit_in.where(F.col("hash") <= hashes[-1]).groupBy("hash").agg(F.min("page").alias("page"))
    return fit_pages([r["page"] for r in sorted(chosen.collect(), key=lambda r: r["hash"])], passes)


def main_texts(pages: list[str | None], model: Labeller) -> Iterator[str]:
    cut = [blocks(p) for p in pages]
    for page, chances in zip(cut, model.chances([leaves_of(b) for b in cut]), strict=True):
        yield "\n".join(b.text for b, chance in zip(page, chances.tolist(), strict=True) if chance >= 0.5)


def extract(pages: DataFrame, model: Labeller, column: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text of a column of HTML, in a column called name (with _ added where pages has such a name)."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def found(page: pa.Array) -> pa.Array:
        return pa.array(list(main_texts(page.to_pylist(), held.value)), pa.string())

    return pages.withColumn(free_name(pages, name), found(F.col(column)))
