"""Main text of pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once into its leaf blocks: the pieces of text between block-level tags, each with the tags, class names
and ids above it. A block's features are these ancestors and the shape of its text (length, share of linked text,
punctuation, place). The field has two labels, content and other, weights for features and for neighbouring labels,
and is decoded by Viterbi. Whether article or main elements hold
two fifths of a page's text, and the block, is a feature too, so that boxes of unknown names beside them are told apart. It is trained by its likelihood on labelled pages; labelled_pages() makes a set of them from
templates of common page layouts, other labelled pages can be given instead.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    # left out up to the end tag, where that comes before the next start of the same kind
    r"|<(noscript|template|iframe|svg|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:[^<]++|<(?!/?\2\b))*+</\2\s*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: Tags that stand within a line, tags without an end, and tags that end an open paragraph.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr object q s samp small span strike strong sub sup time tt u var wbr br img input "
    "math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that may stand in a head, all others end one, and tags that are passed over where their end is missing.
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
OPEN_ENDED = frozenset("noscript template iframe svg select".split())
#: Tags whose start implies the end of an open one of the same kind.
IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Other tags whose start ends an open paragraph.
ENDS_PARAGRAPH = frozenset("div article section ul ol table h1 h2 h3 h4 h5 h6 footer header nav aside form main blockquote pre".split())


@dataclass
class Block:
    text: str
    above: tuple[str, ...]  # distinct tags and .names
    linked: int
    tag: str = "-"  # the nearest tag that makes a block


class _Open:
    """The open elements, so kept that a tag costs the same at any depth."""

    def __init__(self):
        self.tags: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of tags that make a block
        self.counts: dict[str, int] = {}
        self._above: tuple[str, ...] | None = ()

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        if tag not in INLINE:
            self.blocks.append(len(self.tags))
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append((tag, names))
        for x in (tag, *("." + w for w in names)):
            if not self.counts.setdefault(x, 0):
                self._above = None
            self.counts[x] += 1

    def close(self, k: int) -> None:
        while len(self.tags) > k:
            tag, names = self.tags.pop()
            self.places[tag].pop()
            if self.blocks and self.blocks[-1] == len(self.tags):
                self.blocks.pop()
            for x in (tag, *("." + w for w in names)):
                self.counts[x] -= 1
                if not self.counts[x]:
                    del self.counts[x]
                    self._above = None

    def last(self, tag: str) -> int | None:
        at = self.places.get(tag)
        return at[-1] if at else None

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def above(self) -> tuple[str, ...]:
        if self._above is None:
            self._above = tuple(self.counts)
        return self._above

    def block(self) -> str:
        return self.tags[self.blocks[-1]][0] if self.blocks else "-"


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page, in page order. Character references are decoded, white space is made single."""
    out: list[Block] = []
    open_ = _Open()
    held: list[str] = []
    linked = 0
    above: tuple[str, ...] = ()
    nearest = "-"

    def flush() -> None:
        nonlocal held, linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append(Block(text, above, min(linked, len(text)), nearest))
            held, linked = [], 0

    def names(attributes: str) -> tuple[str, ...]:
        if "=" not in attributes:
            return ()
        return tuple(w for m in _NAMES.finditer(attributes) for w in _PART.findall((m[1] or m[2] or m[3] or "").lower()))

    def leave_head() -> None:
        flush()
        open_.close(open_.places["head"][0])

    for m in _TOKEN.finditer(page):
        tag = m[4]
        if tag is None:
            if (left := m[1] or m[2]) is not None:
                if left.lower() not in ("title",):
                    flush()
                continue
            raw = m[0]
            if raw.startswith("<") and len(raw) > 1:
                continue
            text = html.unescape(raw)
            if not held:
                if not text.strip():
                    continue
                if open_.has("head"):
                    leave_head()
                above, nearest = open_.above(), open_.block()
            held.append(text)
            if open_.has("a"):
                linked += len(text)
            continue
        tag = tag.lower()
        if m[3]:
            k = open_.last(tag)
            if tag not in INLINE:
                flush()
            if k is not None and (tag not in INLINE or not open_.blocks or open_.blocks[-1] < k):
                open_.close(k)
            continue
        if open_.has("head") and tag not in HEAD:
            leave_head()
        if tag == "br":
            if held:
                held.append("\n")
            continue
        if tag in INLINE:
            if tag not in VOID:
                open_.push(tag, names(m[5]))
            continue
        flush()
        if tag in VOID or tag in OPEN_ENDED:
            continue
        # a line's tags that were left open don't reach into the next block
        open_.close(open_.blocks[-1] + 1 if open_.blocks else 0)
        if open_.tags and (tag in IMPLIED or tag in ENDS_PARAGRAPH) and open_.block() in IMPLIED.get(tag, ("p",)):
            open_.close(open_.blocks[-1])
            open_.close(open_.blocks[-1] + 1 if open_.blocks else 0)
        open_.push(tag, names(m[5]))
    flush()
    return out


#: Elements that hold a page's own text.
ROOTS = frozenset(("article", "main"))
_BINS = (1, 3, 6, 12, 25, 50, 100)


def features(all_: list[Block]) -> list[list[str]]:
    n, out = len(all_), []
    inside = [not ROOTS.isdisjoint(b.above) for b in all_]
    rooted = 5 * sum(len(b.text) for b, x in zip(all_, inside, strict=True) if x) >= 2 * sum(len(b.text) for b in all_) > 0  # not if only comments are articles
    for i, b in enumerate(all_):
        words = b.text.count(" ") + 1
        share = b.linked / len(b.text)
        f = {"bias", *("up:" + a for a in b.above)}
        f.add("tag:" + b.tag)
        root = "root:" + ("none" if not rooted else "in" if inside[i] else "out")
        f |= {root, f"{root}:{b.tag}"}
        f.add(f"words:{sum(words > x for x in _BINS)}")
        f.add(f"links:{0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.9 else 3}")
        f.add("ends:" + (b.text[-1] if b.text[-1] in ".!?:;,\"»”" else "-"))
        f.add(f"stops:{min(3, sum(b.text.count(c) for c in '.!?'))}")
        if i == 0:
            f.add("first")
        if i == n - 1:
            f.add("last")
        if n == 1:
            f.add("alone")
        if b.text[0] in "©|»›•":
            f.add("sign")
        out.append(sorted(f))
    return out


@dataclass
class Field:
    """Weights: of features for content against other, of label pairs, of the first label."""

    index: dict[str, int]
    weights: np.ndarray
    pairs: np.ndarray  # (2, 2)
    start: np.ndarray

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        get, w = self.index.get, self.weights
        return np.array([sum(w[k] for k in map(get, f) if k is not None) for f in feats])

    def decode(self, feats: list[list[str]]) -> list[bool]:
        """The likeliest labels (Viterbi)."""
        if not feats:
            return []
        s = self.scores(feats).tolist()
        (a, b), (c, d) = self.pairs.tolist()
        v0, v1 = self.start.tolist()
        v1 += s[0]
        back: list[tuple[bool, bool]] = []
        for x in s[1:]:
            f0, f1 = v1 + c > v0 + a, v1 + d > v0 + b
            back.append((f0, f1))
            v0, v1 = (v1 + c if f0 else v0 + a), (v1 + d if f1 else v0 + b) + x
        now = v1 > v0
        out = [now]
        for f0, f1 in reversed(back):
            now = f1 if now else f0
            out.append(now)
        return out[::-1]

    def extract(self, page: str) -> tuple[str, list[tuple[Block, bool]]]:
        found = blocks(page)
        labels = self.decode(features(found))
        return " ".join(b.text for b, keep in zip(found, labels, strict=True) if keep), list(zip(found, labels, strict=True))


def train(pages: list[tuple[str, list[bool]]], rounds: int = 12, penalty: float = 0.02, rate: float = 0.3, least: int = 3) -> Field:
    """Maximum likelihood with a penalty, by adaptive gradient steps over pages. pages: html and the label of each block.

    Features of fewer than `least` pages get no weight, so names that one page has don't explain its labels away.
    """
    data = []
    for page, labels in pages:
        f = features(blocks(page))
        if f and len(f) == len(labels):
            data.append((f, np.array(labels, int)))
    seen = Counter(x for f, _ in data for x in {x for b in f for x in b})
    index = {x: k for k, x in enumerate(sorted(x for x, c in seen.items() if c >= least))}
    coded = [([np.array([index[x] for x in b if x in index]) for b in f], y) for f, y in data]
    w, pairs, start = np.zeros(len(index)), np.zeros((2, 2)), np.zeros(2)
    gw, gp, gs = np.full(len(index), 1e-3), np.full((2, 2), 1e-3), np.full(2, 1e-3)
    order = random.Random(7)
    for _ in range(rounds):
        order.shuffle(coded)
        for f, y in coded:
            n = len(f)
            s = np.zeros((n, 2))
            s[:, 1] = [w[b].sum() for b in f]
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = start + s[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp(fwd[i - 1, 0] + pairs[0], fwd[i - 1, 1] + pairs[1]) + s[i]
            for i in range(n - 2, -1, -1):
                bwd[i] = np.logaddexp(pairs[:, 0] + s[i + 1, 0] + bwd[i + 1, 0], pairs[:, 1] + s[i + 1, 1] + bwd[i + 1, 1])
            z = np.logaddexp(*fwd[-1])
            p = np.exp(fwd + bwd - z)
            for b, d in zip(f, y - p[:, 1], strict=True):
                g = d - penalty * w[b] / n
                gw[b] += g * g
                w[b] += rate * g / np.sqrt(gw[b])
            gp_ = np.zeros((2, 2))
            for i in range(1, n):
                gp_ -= np.exp(fwd[i - 1][:, None] + pairs + s[i] + bwd[i] - z)
                gp_[y[i - 1], y[i]] += 1
            gp += gp_**2
            pairs += rate * gp_ / np.sqrt(gp)
            gs_ = -p[0]
            gs_[y[0]] += 1
            gs += gs_**2
            start += rate * gs_ / np.sqrt(gs)
    return Field(index, w, pairs, start)


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages from templates, with the label of each leaf block."""
    r = random.Random(seed)
    parts = "an ber co de el fi gra hu in ja ker lo mi no or pa que ri sta tu um ver wi xe yo zen ér ñal ß ü".split()

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def prose(a: int, b: int) -> str:
        text = ". ".join(words(4, 18).capitalize() for _ in range(r.randint(a, b)))
        if r.random() < 0.15:
            text = text.upper().replace(" ", "!! ")
        elif r.random() < 0.08:
            text = " | ".join(words(1, 2) for _ in range(r.randint(8, 30)))
        if r.random() < 0.3:
            text = text.replace(". ", f'. <a href="/x">{words(1, 3)}</a> ', 1)
        if r.random() < 0.2:
            text = text.replace(". ", ".<br>", 1)
        return text + r.choice([".", ".", ".", "", "!"])

    def name(*known: str) -> str:
        """A start tag's content; its class is now and then one that no other page has."""
        wrap = r.choice(known)
        if r.random() < 0.15:
            return f'{"div" if wrap.split()[0] not in ("aside", "section") else wrap.split()[0]} class="{words(1, 1)}{r.randint(0, 999)}"'
        return wrap

    def links(k: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3)}</a></li>' for i in range(k))

    out = []
    for _ in range(n):
        page: list[str] = []
        labels: list[bool] = []

        def put(before: str, text: str, after: str, keep: bool, page=page, labels=labels) -> None:
            page.append(before + text + after)
            labels.append(keep)

        def menu(k: int, wrap: str, page=page, labels=labels) -> None:
            tag = wrap.split()[0]
            page.append(f"<{wrap}><ul>{links(k)}</ul></{tag}>")
            labels.extend([False] * k)

        def box(wrap: str, text: str, put=put) -> None:
            put(f"<{wrap}>", text, f"</{wrap.split()[0]}>", False)

        if r.random() < 0.12:  # text without any frame
            kind, m = r.random(), r.randint(1, 5)
            if kind < 0.3:
                put("", prose(2, 8).replace("<br>", " "), "", True)
            else:
                if kind < 0.6:
                    put("<h1>", words(2, 10), "</h1>", True)
                for _ in range(m if kind < 0.8 else 1):
                    put(r.choice(["<p>", "<p>", "<div>"]), prose(1, 8), "", True)
                    page[-1] += "</div>" if page[-1].startswith("<div>") else "</p>"
            out.append((r.choice(["", f"<html><head><title>{words(1, 5)}</title></head><body>"]) + "".join(page), labels))
            continue
        if r.random() < 0.4:
            box(name("header", 'div class="header"', 'div id="masthead"', 'div class="site-header"'), words(1, 6))
        if r.random() < 0.8:
            menu(r.randint(1, 9), r.choice(["nav", "nav", 'div class="menu"', 'div id="nav"', 'div class="breadcrumb"', 'ul class="navbar"']))
        if r.random() < 0.35:
            box(name('div class="cookie-notice"', 'div class="notice"', 'div id="cookie-banner"', 'div class="alert"', 'div role="alert"', 'section class="notification"', 'div class="consent"', 'p class="notice"'), prose(1, 2))
        if r.random() < 0.6:
            box(name('div class="ad"', 'div class="ad"', 'div class="ads"', 'div class="advert"', 'aside class="ad"', 'div id="banner"', 'div class="sponsored"', 'div class="promo"', 'div class="advertisement"'), prose(1, 3))
        side = lambda page=page, labels=labels, box=box, menu=menu: box(r.choice(['aside', 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="widget"', 'div class="related"']), prose(1, 3)) if r.random() < 0.5 else menu(r.randint(2, 6), r.choice(["aside", 'div class="sidebar"', 'div class="related-posts"']))
        if r.random() < 0.25:
            side()
        wrap = r.choice(["article", "article", "article", "article", "article", "main", "main", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'section class="story"', 'div class="article-body"', "body"])
        page.append(f"<{wrap}>" if wrap != "body" else "<div>")
        if r.random() < 0.85:
            put("<h1>", words(2, 14), "</h1>", True)
        for k in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.76:
                put(r.choice(["<p>", "<p>", "<p>", "<p><b>", '<p class="text">', "<div>"]), prose(1, 8), r.choice(["</p>", "</p>", "<p>"]) if page else "", True)
                if page[-1].startswith("<div>"):
                    page[-1] = page[-1].rsplit("<", 1)[0] + "</div>"
            elif kind < 0.83:
                put("<h2>", words(1, 8), "</h2>", True)
            elif kind < 0.88:
                m = r.randint(1, 5)
                page.append("<ul>" + "".join(f"<li>{words(3, 14)}</li>" for _ in range(m)) + "</ul>")
                labels.extend([True] * m)
            elif kind < 0.92:
                put("<blockquote>", prose(1, 3), "</blockquote>", True)
            elif kind < 0.95:
                put("<pre>", words(3, 15), "</pre>", True)
            elif k and kind < 0.975:
                box(r.choice(['div class="ad"', 'aside class="promo"', 'div class="share"', 'aside', 'div class="newsletter"']), prose(1, 2))
            else:
                m = r.randint(1, 3)
                page.append("<table><tr>" + "".join(f"<td>{words(1, 5)}</td>" for _ in range(m)) + "</tr></table>")
                labels.extend([True] * m)
        page.append(f"</{wrap.split()[0]}>" if wrap != "body" else "</div>")
        if r.random() < 0.35:
            inner = r.choice(["section", "div", "ol", "div"]) + " " + r.choice(['class="comments"', 'id="comments"', 'class="comment-list"', 'class="user-comments"', 'class="responses"', 'id="disqus_thread"', 'class="discussion"', *[f'class="{words(1, 1)}"'] * 4])
            m = r.randint(1, 5)
            page.append(f"<{inner}>" + "".join(r.choice(['<div class="comment"><p>%s</p></div>', "<p>%s</p>", '<article class="comment"><p>%s</p></article>', '<li class="comment">%s</li>']) % prose(1, 4) for _ in range(m)) + f"</{inner.split()[0]}>")
            labels.extend([False] * m)
        if r.random() < 0.25:
            put(r.choice(["<form>", '<form class="search">', '<form id="subscribe">']), f"<label>{words(1, 4)}</label> <button>{words(1, 2)}", "</button></form>", False)
            labels.append(False)
            page[-1] = page[-1].replace("<button>", "<p>").replace("</button>", "</p>")
        if r.random() < 0.3:
            side()
        if r.random() < 0.85:
            box(r.choice(["footer", "footer", 'div class="footer"', 'div id="footer"']), "&copy; " + words(1, 5) + r.choice(["", " &middot; " + prose(1, 2)]))
        if r.random() < 0.1 and page:
            page[-1] = page[-1].rsplit("</", 1)[0]
        out.append((f"<!DOCTYPE html><html><head><title>{words(1, 5)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>" + "".join(page) + "</body></html>", labels))
    return out


_trained: list[Field] = []


def default_field() -> Field:
    if not _trained:
        _trained.append(train(labelled_pages()))
    return _trained[0]


def extract(pages: DataFrame, field: Field | None = None, with_blocks: bool = False) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages; with_blocks also the blocks with their labels.

    Null and empty pages have an empty text. Text outside tags is a block. Equal rows get equal texts. Other columns
    are ignored.
    """
    sent = common.tuned(pages.sparkSession).sparkContext.broadcast(field or default_field())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = [], []
            for page in batch.column(2):
                text, found = sent.value.extract(page.as_py() or "")
                texts.append(text)
                if with_blocks:
                    rows.append([{"text": b.text, "above": list(b.above), "content": keep} for b, keep in found])
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            names = ["page_id", "url", "text", "n_chars"]
            if with_blocks:
                columns.append(pa.array(rows, pa.list_(pa.struct([("text", pa.string()), ("above", pa.list_(pa.string())), ("content", pa.bool_())]))))
                names.append("blocks")
            yield pa.record_batch(columns, names)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long" + (", blocks array<struct<text:string,above:array<string>,content:boolean>>" if with_blocks else ""))
