"""Main text of web pages by a recurrent block labeller in numpy.

A page is cut into leaf blocks. Each block is read as a vector: hashed tokens of its tag path (tags, classes, ids),
hashed words, and a few measures of the block. A bidirectional LSTM runs over all blocks of the page and labels each one
as main text or not. It learns from laid-out pages made up here (articles among menus, adverts, comments and so on, with
many ways to name their parts) and from a bounded sample of the given pages, as far as their elements say what they are.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtspark.llm import words
from courtspark.llm.common import lowest

#: Given pages that are learnt from, at most, and the longest of them; pages made up.
FIT_PAGES, FIT_CHARS, MADE_PAGES = 200, 50_000, 500
TAG_BUCKETS, TAG_DIM, WORD_BUCKETS, WORD_DIM, MEASURES, HIDDEN = 2048, 16, 2048, 4, 6, 16
#: Blocks of a training window, pages labelled together, blocks labelled at once.
WINDOW, TOGETHER, STEP_BLOCKS = 48, 256, 1 << 16

#: Elements without main text: they end with their own end or, left open, with that of the element around them.
_SKIPPED = frozenset("noscript template svg iframe object textarea select title".split())
#: Opening one of these ends an open vector image or choice list: they can't stand in it.
_NO_PART = frozenset("article body h1 h2 h3 h4 h5 h6 main ol p section table ul".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(script|style)(?![\w:-])[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(textarea|title|iframe)(?![\w:-])[^>]*(?<!/)>(?:(?!<\2(?![\w:-])).)*?</\2\s*>"
    r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^<>]*)>""",
    re.DOTALL | re.IGNORECASE,
)
_NAMES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening the first closes an open one of the others, up to the nearest element named last.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"optgroup"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "thead": ({"tbody", "thead", "tr"}, {"table"}), "tfoot": ({"tbody", "thead", "tr"}, {"table"}),
}


def blocks(page: str) -> list[tuple[str, tuple, float]]:
    """(text, path of (tag, attributes), share of link text) of each leaf block with text, in page order.

    Block elements end blocks, inline elements don't; character references are decoded, white space becomes one space.
    Scripts, styles, comments, titles, images, embedded pages and form fields hold no text; names count whole, so that
    elements with names of their own are read. Unclosed and wrongly nested elements are closed as the next ones demand.
    """
    out: list[tuple[str, tuple, float]] = []
    stack: list[tuple[str, str]] = []
    held: list[str] = []
    path, linked, in_link, at = (), 0, 0, 0
    skipped, inner = "", []  # the element that is passed over, and what is open inside it

    def flush():
        nonlocal held, linked
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            if text:
                out.append((text, path, min(1.0, linked / max(1, len(text)))))
            held, linked = [], 0

    for m in _TOKEN.finditer(page):
        if m.start() > at and not skipped:
            text = page[at : m.start()]
            if held or not text.isspace():
                if not held:
                    path = tuple(stack)
                held.append(text)
                linked += len(text) if in_link else 0
        at = m.end()
        close, tag, attrs = (m[3], m[4], m[5]) if m[4] else (m[6], m[7], m[8])
        if not tag:
            continue
        tag = tag.lower()
        if skipped:
            if tag == skipped or tag in inner:
                if not close:
                    inner += [] if attrs.endswith("/") else [tag]
                elif tag in inner:
                    del inner[len(inner) - 1 - inner[::-1].index(tag) :]
                else:
                    skipped = ""
                continue
            ends = close and any(tag == name for name, _ in stack)
            if not close and tag in _NO_PART and "foreignobject" not in inner:
                ends = skipped in ("svg", "select", "title")
            if not ends and (skipped != "title" or not close):
                inner += [] if close or attrs.endswith("/") or tag in _VOID else [tag]
                continue
            skipped = ""
        if tag in _SKIPPED:
            if not close and not attrs.endswith("/"):
                skipped, inner = tag, []
        elif tag == "br":
            if held:
                held.append(" ")
        elif tag == "a":
            in_link = 0 if close else 1
        elif tag in _BLOCK:
            flush()
            if close:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        in_link = 0
                        break
                continue
            ends, stop = _CLOSES.get(tag, ({"p"}, {"button", "td", "th"}))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in ends:
                    del stack[k:]
                    if tag in ("li", "dt", "dd", "option", "td", "th"):
                        break
            if tag not in _VOID and not attrs.endswith("/"):
                stack.append((tag, attrs))
    if at < len(page) and not skipped:
        text = page[at:]
        if held or not text.isspace():
            if not held:
                path = tuple(stack)
            held.append(text)
    flush()
    return out


_tokens: dict[tuple, list[int]] = {}


def _path_tokens(path: tuple) -> list[int]:
    """Buckets of the tokens along a path: tags, words of classes, ids and roles, and the innermost element again."""
    if path not in _tokens:
        if len(_tokens) > 20_000:
            _tokens.clear()
        found = set()
        for depth, (tag, attrs) in enumerate(path):
            found.add(tag)
            if depth == len(path) - 1:
                found.add("leaf " + tag)
            for kind, *values in _NAMES.findall(attrs) if attrs else ():
                for name in re.split(r"[\s_-]+|(?<=[a-z])(?=[A-Z])", "".join(values)):
                    name = name.lower().rstrip("0123456789")
                    if name:
                        found.update((f"name {name}", f"stem {name[:5]}"))
        _tokens[path] = sorted(zlib.crc32(t.encode()) % TAG_BUCKETS for t in found)
    return _tokens[path]


@dataclass
class Coded:
    """Blocks of some pages as numbers: path tokens and words in rows, block by block, and measures."""

    tag: np.ndarray
    tag_block: np.ndarray
    word: np.ndarray
    word_block: np.ndarray
    measures: np.ndarray

    @classmethod
    def of(cls, pages: list[list[tuple]]) -> Coded:
        flat = [b for p in pages for b in p]
        tags = [_path_tokens(b[1]) for b in flat]
        counts = np.array([len(t) for t in tags], dtype=np.int64)
        word, block = [], []
        for a, b, raw, offs in words.chunks(pa.array([t for t, _, _ in flat], pa.large_string())):
            starts, ends, first = words.spans(words.LOWER[raw], offs)
            word.append((words.hashes(words.LOWER[raw], starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64))
            block.append(np.repeat(np.arange(a, b), np.diff(first)))
        size = np.array([len(t) for t, _, _ in flat], dtype=float)
        place = np.concatenate([(np.arange(len(p)) + 0.5) / len(p) for p in pages if p] or [np.empty(0)])
        stops = np.array([sum(t.count(c) for c in ".!?") for t, _, _ in flat], dtype=float)
        link = np.array([k for _, _, k in flat], dtype=float)
        measures = np.stack([np.log1p(size) / 5, size < 40, link, np.minimum(stops, 5) / 5, place, np.ones(len(flat))], axis=1) if flat else np.empty((0, MEASURES))
        none = np.empty(0, np.int64)
        return cls(
            np.array([x for t in tags for x in t], dtype=np.int64), np.repeat(np.arange(len(flat)), counts),
            np.concatenate(word or [none]), np.concatenate(block or [none]), measures,
        )


def _sums(rows: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, rows.shape[1]))
    if len(block):
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        out[block[at]] = np.add.reduceat(rows, at)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Embeddings, an LSTM in each direction and a logistic layer on both states and the block's own vector."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = TAG_DIM + WORD_DIM + MEASURES
        self.p = {
            "tag": rng.normal(0, 0.3, (TAG_BUCKETS, TAG_DIM)), "word": rng.normal(0, 0.05, (WORD_BUCKETS, WORD_DIM)),
            **{f"w{d}": rng.normal(0, 0.2, (size + HIDDEN, 4 * HIDDEN)) for d in "fb"}, **{f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in "fb"},
            "out": rng.normal(0, 0.2, (2 * HIDDEN + size,)), "bias": np.zeros(1),
        }

    def vectors(self, c: Coded) -> np.ndarray:
        n = len(c.measures)
        tag = _sums(self.p["tag"][c.tag], c.tag_block, n)
        word = _sums(self.p["word"][c.word], c.word_block, n) / np.maximum(np.bincount(c.word_block, minlength=n), 1)[:, None]
        return np.concatenate([tag, word, c.measures], axis=1)

    def run(self, d: str, x: np.ndarray, there: np.ndarray, keep: bool = False):
        """States for each step of ``x`` (steps, pages, vector); where ``there`` is 0 a page has ended."""
        h = c = np.zeros((x.shape[1], HIDDEN))
        states, trail = np.empty((*x.shape[:2], HIDDEN)), []
        w, b = self.p["w" + d], self.p["b" + d]
        for t in range(len(x)):
            z = np.concatenate([x[t], h], axis=1)
            g = z @ w + b
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * u
            on = there[t][:, None]
            if keep:
                trail.append((z, i, f, o, u, c, new, on))
            c = np.where(on, new, c)
            h = np.where(on, o * np.tanh(new), h)
            states[t] = h
        return states, trail

    def logits(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        """One number per step and page; the backward pass reads each page from its own last block."""
        turn = _turned(there)
        pages = np.arange(x.shape[1])
        ahead, _ = self.run("f", x, there)
        back, _ = self.run("b", x[turn, pages], there)
        return np.concatenate([ahead, back[turn, pages], x], axis=2) @ self.p["out"] + self.p["bias"]

    def labels(self, pages: list[list[tuple]]) -> list[np.ndarray]:
        """For each page which blocks are main text; pages of like length are labelled together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            size = max(1, min(TOGETHER, STEP_BLOCKS // longest))
            group, order = order[-size:], order[:-size]
            x, there = _padded(self.vectors(Coded.of([pages[i] for i in group])), [len(pages[i]) for i in group])
            found = self.logits(x, there) > 0
            for k, i in enumerate(group):
                out[i] = found[: len(pages[i]), k]
        return out

    def step(self, c: Coded, lengths: list[int], y: np.ndarray) -> dict:
        """Gradients of the mean loss over the blocks of some windows."""
        vec = self.vectors(c)
        x, there = _padded(vec, lengths)
        turn, pages = _turned(there), np.arange(len(lengths))
        ahead, trail_f = self.run("f", x, there, True)
        back, trail_b = self.run("b", x[turn, pages], there, True)
        z = np.concatenate([ahead, back[turn, pages], x], axis=2)
        goal, _ = _padded(y[:, None], lengths)
        err = (_sigmoid(z @ self.p["out"] + self.p["bias"]) - goal[:, :, 0]) * there / max(1, there.sum())
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["out"], grads["bias"] = np.einsum("tp,tpd->d", err, z), np.array([err.sum()])
        dz = err[:, :, None] * self.p["out"]
        dx = dz[:, :, 2 * HIDDEN :].copy()
        dx += self._back("f", trail_f, dz[:, :, :HIDDEN], grads)
        turned = self._back("b", trail_b, dz[:, :, HIDDEN : 2 * HIDDEN][turn, pages], grads)
        dx += turned[turn, pages]
        flat = np.concatenate([dx[:n, k] for k, n in enumerate(lengths)])
        np.add.at(grads["tag"], c.tag, flat[c.tag_block, :TAG_DIM])
        many = np.maximum(np.bincount(c.word_block, minlength=len(flat)), 1)
        np.add.at(grads["word"], c.word, (flat[:, TAG_DIM : TAG_DIM + WORD_DIM] / many[:, None])[c.word_block])
        return grads

    def _back(self, d: str, trail: list, dh_out: np.ndarray, grads: dict) -> np.ndarray:
        w = self.p["w" + d]
        dh = dc = np.zeros_like(dh_out[0])
        dx = np.zeros((*dh_out.shape[:2], len(w) - HIDDEN))
        for t in range(len(trail) - 1, -1, -1):
            z, i, f, o, u, before, new, on = trail[t]
            dh = dh + dh_out[t]
            th = np.tanh(new)
            dn = np.where(on, dc + dh * o * (1 - th**2), 0)
            g = np.concatenate([dn * u * i * (1 - i), dn * before * f * (1 - f), np.where(on, dh * th * o * (1 - o), 0), dn * i * (1 - u**2)], axis=1)
            grads["w" + d] += z.T @ g
            grads["b" + d] += g.sum(axis=0)
            dz = g @ w.T
            dx[t] = dz[:, :-HIDDEN]
            dc = np.where(on, dn * f, dc)
            dh = np.where(on, dz[:, -HIDDEN:], dh)
        return dx


def _turned(there: np.ndarray) -> np.ndarray:
    """For each step and page the step that a reading from the page's end reaches there; steps past the end stay."""
    steps, length = np.arange(len(there))[:, None], there.sum(axis=0).astype(np.int64)
    return np.where(steps < length, length - 1 - steps, steps)


def _padded(rows: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    n, m = np.array(lengths), max(lengths)
    there = np.arange(m)[:, None] < n
    out = np.zeros((len(n), m, rows.shape[1]))
    out[there.T] = rows
    return out.transpose(1, 0, 2), there


def train(pages: list[tuple[list[tuple], np.ndarray]], epochs: int = 10, batch: int = 16, rate: float = 0.01, seed: int = 11) -> Labeller:
    """A labeller fitted by Adam on pages (blocks, labels), in windows of at most ``WINDOW`` blocks."""
    model, rng = Labeller(seed), np.random.default_rng(seed)
    cut = [(p[a : a + WINDOW], y[a : a + WINDOW]) for p, y in pages for a in range(0, len(p), WINDOW)]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    n = 0
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for a in range(0, len(order), batch):
            some = [cut[i] for i in order[a : a + batch]]
            grads = model.step(Coded.of([p for p, _ in some]), [len(p) for p, _ in some], np.concatenate([y for _, y in some]).astype(float))
            n += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                own = rate / 10 if k == "word" else rate  # single words say less than their place on the page
                model.p[k] -= own * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)
    return model


#: Ways to write the parts of a page. Element and class names that web pages commonly use.
MAIN = ["<article>", "<main>", '<div class="content">', '<div class="post">', '<div class="entry-content">', '<div class="article-body">', '<div id="content">', '<div id="main">', '<section class="story">', '<div class="text">', '<div itemprop="articleBody">', '<div role="main">', '<div class="post-body">', '<main><article>', '<div class="page"><article class="post">']
OTHER = {
    "menu": ["<nav>", '<div class="menu">', '<div class="navbar">', '<ul class="nav">', '<div id="navigation">', '<div class="breadcrumb">', '<div class="topnav">', '<div role="navigation">'],
    "head": ["<header>", '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<div class="logo">', '<div role="banner">'],
    "foot": ["<footer>", '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<div class="legal">', '<div role="contentinfo">'],
    "side": ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<div class="widget">', '<div class="recommended">', '<div class="share">', '<div class="social">', '<div class="tags">', '<div role="complementary">'],
    "note": ['<div class="cookie">', '<div class="cookie-banner">', '<div class="notice">', '<div id="consent">', '<div class="alert">', '<div class="popup">', '<div class="newsletter">', '<div class="subscribe">', '<div class="modal">', '<div role="dialog">'],
    "ad": ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-top">', '<aside class="ad">', '<div class="banner-ad">'],
    "form": ["<form>", '<form class="search">', '<form id="login">', '<div class="signup"><form>', '<div role="search"><form>'],
    "talk": ['<div class="comments">', '<section id="comments">', '<div class="comment-list">', '<ol class="commentlist">', '<div class="replies">', '<div id="disqus">', '<section class="comments">', '<div class="reader-comments">'],
}


_MARK, _START, _STOP = "\ue000", "\ue001", "\ue002"


def _bordered(part: str) -> str:
    return _START + part + _STOP


def _closed(opening: str) -> str:
    return "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))


def made_pages(vocabulary: list[str], n: int, seed: int = 5) -> list[tuple[list[tuple], np.ndarray]]:
    """Laid-out pages of random words with the label of each block: the paragraphs of the article are main text."""
    rng = np.random.default_rng(seed)
    vocabulary = vocabulary or ["lorem", "ipsum", "dolor", "sit", "amet"]

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def sentence(low, high):
        return " ".join(pick(vocabulary) for _ in range(int(rng.integers(low, high)))) + pick([".", ".", "", "?"])

    def part(kind):
        opening = pick(OTHER[kind])
        if kind == "menu" or kind in ("foot", "side") and rng.random() < 0.5:
            links = "".join(f'<li><a href="#">{sentence(1, 4)}</a></li>' for _ in range(int(rng.integers(2, 9))))
            inner = f"<ul>{links}</ul>"
        elif kind == "form":
            inner = f"<label>{sentence(1, 4)}</label><input><p>{sentence(2, 9)}</p><button>{sentence(1, 3)}</button>"
        elif kind == "talk":
            inner = "".join(f"<{pick(['p', 'div', 'li'])}>{sentence(3, 40)}" for _ in range(int(rng.integers(1, 6))))
        elif kind == "head":
            inner = pick(["", "<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>"]).format(sentence(1, 5)) + sentence(1, 6)
        else:
            inner = "".join(pick(["{}", "<p>{}</p>", "<h3>{}</h3>", "<div>{}</div>"]).format(sentence(2, 30)) for _ in range(int(rng.integers(1, 4))))
        return opening + inner + _closed(opening)

    def article():
        kinds = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<pre>{}</pre>", "<div>{}</div>", "<p><a href='#'>{}</a></p>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]
        inner = [pick(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>", ""]).format(sentence(2, 12))]
        for _ in range(int(rng.integers(1, 14))):
            inner.append(pick(kinds).format(sentence(2, 60)))
            if rng.random() < 0.12:
                inner.append(_bordered(part(pick(["ad", "side", "note", "form", "talk", "ad"]))))
        return inner

    out = []
    for _ in range(n):
        opening = pick(MAIN)
        pieces = [part(k) for k in ("note", "head", "menu", "ad", "form") if rng.random() < 0.5]
        rng.shuffle(pieces)
        tail = [part(k) for k in ("talk", "side", "ad", "form", "foot") if rng.random() < 0.6]
        wrap = pick(["", '<div class="wrapper">', '<div id="page">', '<div class="container">'])
        body = "".join(map(_bordered, pieces)) + opening + "".join(article()) + _closed(opening) + "".join(map(_bordered, tail))
        # words between the borders are no main text and carry a mark through the parser
        marked, inside = [], 0
        for bit in re.split(f"([{_START}{_STOP}]|<[^>]*>)", body):
            inside += (bit == _START) - (bit == _STOP)
            if bit not in (_START, _STOP):
                marked.append(_MARK + bit if inside and bit.strip() and not bit.startswith("<") else bit)
        found = blocks("<!DOCTYPE html><html><head><title>x</title></head><body>" + wrap + "".join(marked) + _closed(wrap) + "</body></html>")
        out.append(([(t.replace(_MARK, ""), p, k) for t, p, k in found], np.array([_MARK not in t for t, _, _ in found])))
    return out


_NOT_MAIN = re.compile(r"\b(ads?|advert\w*|sponsor\w*|promo|comments?|sidebar|related|share|social|cookie\w*|notice|newsletter|menu|nav\w*)\b", re.IGNORECASE)


def told_by_elements(found: list[tuple]) -> np.ndarray | None:
    """Labels of a page whose elements say what they are (an article or main element); else None."""
    paths = [[t for t, _ in path] for _, path, _ in found]
    if not any("article" in p or "main" in p for p in paths):
        return None
    return np.array(
        [
            ("article" in p or "main" in p) and not {"nav", "aside", "footer", "form"} & set(p) and not any(_NOT_MAIN.search(a) for _, a in path)
            for p, (_, path, _) in zip(paths, found, strict=True)
        ]
    )


def fitted(pages: DataFrame, html: str = "html", id: str = "page_id") -> Labeller:
    """A labeller trained on made-up layouts and a bounded sample of ``pages`` (those with the smallest id hash)."""
    rows = pages.select(F.struct(F.col(id).alias("id"), F.xxhash64(html).alias("page")).alias("row"), F.col(html).alias("body"))
    sample = lowest(rows.where(F.length("body") <= FIT_CHARS), F.col("row"), FIT_PAGES, rows.count()).select("body").collect()
    found = [blocks(r[0]) for r in sample]
    told = [(f, y) for f in found if f and (y := told_by_elements(f)) is not None]
    vocabulary = sorted({w for f in found for t, _, _ in f for w in t.split()[:20]})[:5000]
    made = [(f, y) for f, y in made_pages(vocabulary, MADE_PAGES) if f]
    return train(told + made)


def extracted(pages: DataFrame, model: Labeller, html: str = "html", id: str = "page_id", keep: tuple = ()) -> DataFrame:
    """``id``, the columns ``keep``, text, n_chars: the main blocks of each page in page order, two line ends apart.

    A null or empty page, or one without main text, has an empty text.
    """
    ship = pages.sparkSession.sparkContext.broadcast(model)  # a model of fixed size
    names = [id, *keep, "text", "n_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ship.value
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                b = whole.slice(a, 1024)
                found = [blocks(v.as_py()) for v in b.column(b.num_columns - 1)]
                text = ["\n\n".join(t for (t, _, _), y in zip(f, label, strict=True) if y) for f, label in zip(found, own.labels(found), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names)

    kinds = [f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id, *keep)]
    chosen = pages.select(id, *keep, F.coalesce(html, F.lit("")).alias("_html"))
    return chosen.mapInArrow(run, ", ".join([*kinds, "text string", "n_chars long"]))
