"""Main text of web pages by a recurrent labeller over the page's sequence of text blocks.

A page becomes blocks: runs of text between block-level tags, each with the path of its open tags
(name, class, id, role). A bidirectional LSTM in numpy reads for each block a vector of hashed path
parts, hashed words and a few measures, and labels it as main text or not with the whole page in
view. It is trained on the driver from at most `sample` pages (the smallest by hash), `chars` code points
and `most_blocks` blocks of each: the tags and
names that mean navigation or notices teach it, and copies of the pages with such parts put in at
random, under many names, teach it names these pages lack.

What a browser never shows (comments, scripts, styles, templates, the head), drawings and form controls
are no blocks and do not part the text around them; formulas are text. An unclosed quote in a tag ends
with the tag. References are decoded, white space inside a block becomes one space, blocks are
trimmed and joined by one line break. A null or empty page gives an empty text. Repeated rows are
read row by row. Broken markup closes what is open; a block has no size limit.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm.bilstm import Adam, BiLSTM
from policylake.llm.staging import sampled, small_batches

# Element names of HTML.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr svg "
             "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts semantics annotation annotation-xml".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style template head title noscript svg annotation annotation-xml iframe object canvas audio video select textarea button option datalist".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_P_INSIDE = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
# Names that mean something other than the article.
ASIDE_TAGS = set("nav header footer aside form menu dialog".split())
ASIDE_NAMES = set("""ad ads advert adverts advertisement banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice
notices alert nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar footer bottom copyright sidebar side widget related
recommended share sharing social comment comments reply replies discussion disqus form search login signup subscribe newsletter pagination pager tags""".split())
MAIN_TAGS, MAIN_NAMES = {"article", "main"}, set("article content post entry story body text main".split())

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|textarea|title|template|noscript|iframe|svg(?![^>]*/>))\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<([a-zA-Z][^\s/>]*)([^>]*)>", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PARTS = re.compile(r"[A-Za-z]+")
PATHS, WORDS, MEASURES = 512, 64, 5

Block = tuple[str, tuple[str, ...], int]


def blocks(page: str | None) -> list[Block]:
    """(text, path parts, code points of the text inside links) of each block of a page."""
    page = page or ""
    out: list[Block] = []
    open_: list[tuple[str, tuple[str, ...]]] = []
    held: list[str] = []
    linked = hidden = links = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((text, tuple(p for name, names in open_ if name not in INLINE for p in (f"<{name}", *names)), linked))
        held.clear()
        linked = 0

    def leave(k: int) -> None:
        nonlocal hidden, links
        for name, _ in open_[k:]:
            hidden -= name in UNSEEN
            links -= name == "a"
        del open_[k:]

    for m in RAW.finditer(page):
        if m.start() > at and not hidden:
            text = page[at : m.start()]
            held.append(text)
            if links:
                linked += len(text.strip())
        at = m.end()
        if m[1]:
            if m[1].lower() == "title":
                flush()
            continue
        name, attributes = (m[3] or m[5] or "").lower(), m[4] or m[6] or ""
        if not name:
            continue
        if name == "br":
            held.append(" ")
            continue
        if name not in INLINE:
            flush()
        if m[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    leave(k)
                    break
            continue
        if name in NO_P_INSIDE:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == "p":
                    leave(k)
                    break
                if open_[k][0] not in INLINE:
                    break
        if name in CLOSES:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in CLOSES[name]:
                    leave(k)
                    break
                if open_[k][0] in ("ul", "ol", "dl", "table", "select"):
                    break
        if name in VOID or attributes.endswith("/"):
            continue
        names = [x.lower() for g in NAMED.findall(attributes) for x in PARTS.findall(" ".join(g))]
        open_.append((name, tuple(names)))
        hidden += name in UNSEEN
        links += name == "a"
    if not hidden:
        held.append(page[at:])
    flush()
    return out


def taught(path: tuple[str, ...]) -> bool:
    """What tags and names alone say about a block."""
    if any(p[1:] in ASIDE_TAGS if p[0] == "<" else p in ASIDE_NAMES for p in path):
        return False
    return any(p[1:] in MAIN_TAGS if p[0] == "<" else p in MAIN_NAMES for p in path) or path[-1:] in (("<p",), ("<h1",), ("<blockquote",), ("<pre",))


def _vectors(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and hashed path part of each part; hashed words (share); measures."""
    row, part = [], []
    words, measures = np.zeros((len(page), WORDS), np.float32), np.zeros((len(page), MEASURES), np.float32)
    for i, (text, path, linked) in enumerate(page):
        own = {crc32(p.encode()) % PATHS for p in path} | {crc32(b"leaf" + path[-1].encode()) % PATHS if path else 0}
        row.extend([i] * len(own))
        part.extend(sorted(own))
        some = text.split(" ")
        words[i] = np.bincount([crc32(w.encode()) % WORDS for w in some], minlength=WORDS) / max(1, len(some))
        measures[i] = (min(len(text), 2000) / 500, len(some) < 6, linked / (len(text) + 1), sum(text.count(c) for c in ".,;:") / (len(some) + 1), i / len(page))
    return np.array(row, np.int64), np.array(part, np.int64), words, measures


class Labeller:
    def __init__(self, hidden: int = 12, width: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.lstm = BiLSTM(width, hidden, rng)
        self.p = self.lstm.p
        self.p["path"] = (rng.standard_normal((PATHS, width)) * 0.3).astype(np.float32)
        self.p["word"] = (rng.standard_normal((WORDS, width)) * 0.1).astype(np.float32)
        self.p["measure"] = (rng.standard_normal((MEASURES, width)) * 0.3).astype(np.float32)
        self.p["head"] = (rng.standard_normal((2 * hidden, 1)) * 0.3).astype(np.float32)
        self.p["own"] = np.zeros((width, 1), np.float32)
        self.p["bias"] = np.zeros(1, np.float32)
        self.width = width

    def _input(self, pages: list[list[Block]]):
        steps = max(map(len, pages))
        x = np.zeros((steps, len(pages), self.width), np.float32)
        mask = np.zeros((steps, len(pages)), np.float32)
        parts = []
        for b, page in enumerate(pages):
            if not page:
                continue
            row, part, words, measures = _vectors(page)
            one = words @ self.p["word"] + measures @ self.p["measure"]
            np.add.at(one, row, self.p["path"][part])
            x[: len(page), b], mask[: len(page), b] = one, 1
            parts.append((b, row, part, words, measures))
        return x, mask, parts

    def scores(self, pages: list[list[Block]], keep: dict | None = None):
        x, mask, parts = self._input(pages)
        h = self.lstm.forward(x, mask, keep)
        z = (h @ self.p["head"] + x @ self.p["own"])[:, :, 0] + self.p["bias"]
        return z, h, x, mask, parts

    def learn(self, pages: list[list[Block]], label: list[list[bool]], optimiser: Adam) -> None:
        keep: dict = {}
        z, h, x, mask, parts = self.scores(pages, keep)
        y = np.zeros_like(z)
        for b, one in enumerate(label):
            y[: len(one), b] = one
        dz = ((1 / (1 + np.exp(-z)) - y) * mask / max(1.0, mask.sum()))[:, :, None].astype(np.float32)
        dx, grads = self.lstm.backward(x, dz @ self.p["head"].T, keep, mask)
        dx = dx + dz @ self.p["own"].T
        grads["head"] = np.einsum("tbh,tbo->ho", h, dz)
        grads["own"] = np.einsum("tbh,tbo->ho", x, dz)
        grads["bias"] = dz.sum(axis=(0, 1))
        for k in ("path", "word", "measure"):
            grads[k] = np.zeros_like(self.p[k])
        for b, row, part, words, measures in parts:
            d = dx[: len(words), b]
            np.add.at(grads["path"], part, d[row])
            grads["word"] += words.T @ d
            grads["measure"] += measures.T @ d
        optimiser.step(self.p, grads)


def _varied(page: list[Block], rng: np.random.Generator) -> list[Block]:
    """The page with other containers and with aside parts put in."""
    frame = [("<html", "<body", "<article"), ("<html", "<body", "<main"), ("<html", "<body", "<div", rng.choice(sorted(MAIN_NAMES))), ("<html", "<body", "<main", "<article", "<section"), ("<html", "<body", "<div", rng.choice(sorted(MAIN_NAMES)), "<article")]
    base = frame[rng.integers(len(frame))]
    leaf = lambda path: path[-1:] if path and path[-1][0] == "<" else ("<p",)
    out = [(t, (*base, *(leaf(p) if leaf(p)[0] not in ("<article", "<main", "<div") else ())), n) if taught(p) else (t, p, n) for t, p, n in page]
    texts = [t for t, _, _ in page] or ["text"]
    for _ in range(rng.integers(0, 5)):
        text = texts[rng.integers(len(texts))]
        text = text if rng.random() < 0.5 else " ".join(text.split()[: rng.integers(1, 12)])
        box = (f"<{rng.choice(sorted(ASIDE_TAGS))}",) if rng.random() < 0.4 else (rng.choice(["<div", "<section", "<ul", "<p", "<aside"]), rng.choice(sorted(ASIDE_NAMES)))
        inner = [(), ("<p",), ("<ul", "<li"), ("<div",), ("<h3",), ("<div", "<p")][rng.integers(6)]
        outer = base if rng.random() < 0.3 else ("<html", "<body")
        at, count = rng.integers(len(out) + 1), rng.integers(1, 4)
        out[at:at] = [(text, (*outer, *box, *inner), len(text) if rng.random() < 0.3 else 0)] * count
    return out


def trained(pages: DataFrame, sample: int = 256, rounds: int = 220, seed: int = 3, chars: int = 50_000, most_blocks: int = 400) -> Labeller:
    texts = sampled(pages, "html", sample, chars)
    parsed = [b[:most_blocks] for b in map(blocks, texts) if b] or [[("text", ("<html", "<body", "<article", "<p"), 0), ("menu", ("<html", "<body", "<nav"), 0)]]
    rng, model, optimiser = np.random.default_rng(seed), Labeller(seed=seed), Adam(0.02)
    for r in range(rounds):
        some = [parsed[i] for i in rng.integers(len(parsed), size=12)]
        some = [p if rng.random() < 0.3 else _varied(p, rng) for p in some]
        optimiser.rate = 0.02 if r < rounds * 2 // 3 else 0.004
        model.learn(some, [[taught(path) for _, path, _ in p] for p in some], optimiser)
    return model


def extract(pages: DataFrame, model: Labeller, carried: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """`carried`, text and n_chars of every row of `pages` (html)."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(carried))]
    slim = pages.select(*(F.col(c).alias(n) for c, n in zip(carried, names, strict=True)), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 64):
                part = batch.slice(lo, 64)
                parsed = [blocks(x) for x in part.column("html").to_pylist()]
                texts = [""] * len(parsed)
                order = sorted(range(len(parsed)), key=lambda i: len(parsed[i]))  # pages of like length share steps
                for group in (order[:32], order[32:56], order[56:62], order[62:]):
                    if group and parsed[group[-1]]:
                        z = labeller.scores([parsed[i] for i in group])[0]
                        for b, i in enumerate(group):
                            texts[i] = "\n".join(t for (t, _, _), s in zip(parsed[i], z[:, b].tolist(), strict=False) if s > 0)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    kinds = "".join(f"{n} {slim.schema[n].dataType.simpleString()}, " for n in names)
    done = slim.mapInArrow(run, f"{kinds}text string, n_chars long")
    return done.select(*(F.col(n).alias(c) for c, n in zip(carried, names, strict=True)), "text", "n_chars")
