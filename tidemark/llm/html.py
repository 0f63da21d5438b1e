"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Pages are read into block nodes (unclosed and wrongly nested tags are mended the way
browsers do: a block closes an open paragraph, an item closes its sibling).  Each node gets
features of its tag, attribute tokens, depth, siblings, and of the text density of its
subtree; boosted trees give the log odds that it belongs to the article.  Decoding maximises
the sum of log odds over all sets in which a chosen node's ancestors are chosen too, so a
paragraph never survives inside a menu that is dropped.

The trees are trained on pages written by ``sample_page``: random layouts (semantic or plain
containers, with or without telling attributes) around random prose, whose labels are known.

Null and empty html give the empty text; repeated rows repeat; an empty table gives no rows;
columns other than id, url and html are not read.  Text of an unfinished tag is markup; a stray
quote is a character of its tag, which ends at the next ``>``; an unclosed silent element ends
with the block around it (script, style, title and textarea run to the end of the page).
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.boosting import Booster, boost

# Element vocabulary of HTML.
BLOCKS = """html body div section article main aside nav header footer form fieldset ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 blockquote pre
table thead tbody tfoot tr td th caption figure figcaption details summary address menu dialog legend center hgroup""".split()
SILENT = {"script", "style", "title", "textarea", "noscript", "template", "svg", "iframe", "select", "button", "object", "annotation", "annotation-xml", "canvas", "audio", "video", "datalist"}
RAW = {"script", "style", "title", "textarea"}                     # no tags inside: only their own end tag ends them
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Attribute tokens that tell furniture from article.
FURNITURE = set("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs crumbs
sidebar side aside widget related recommended more popular trending footer foot header masthead topbar toolbar cookie cookies consent gdpr notice alert popup modal
overlay newsletter subscribe subscription signup login search form share sharing social follow comment comments discussion disqus reply replies respond feedback
tags pagination pager legal copyright disclaimer skip hidden contact rating reader readers""".split())
ARTICLE = set("article content main post entry story body text page prose blog news copy read detail".split())

# A quote opens a value only right after the equals sign; any other is a character of a name or value.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*))?)*+)(>?)|<[!?/][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|data-y|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PIECE = re.compile(r"[a-z]+|[A-Z][a-z]*")
TAGS = {t: k + 1 for k, t in enumerate(BLOCKS)}
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@lru_cache(maxsize=20_000)
def attribute_tokens(attrs: str) -> tuple[int, int, int]:
    """Numbers of furniture and article tokens, and the label a training page carries (-1: none)."""
    bad = good = 0
    label = -1
    for name, value in ATTRIBUTE.findall(attrs):
        value = value.strip("\"'")
        if name.lower() == "data-y":
            label = int(value)
            continue
        words = {w.lower() for w in PIECE.findall(value)}
        bad += len(words & FURNITURE)
        good += len(words & ARTICLE)
    return bad, good, label


def tag_end(source: str, m: re.Match) -> int:
    """Where the tag of a match ends: a value quoted to the end of the page holds the next ``>``; 0 if there is none."""
    return m.end() if m[4] else source.find(">", m.end(2)) + 1


class Page:
    """Block nodes in document order (parents first) and text runs with their owner."""

    def __init__(self, source: str):
        self.tag, self.parent, self.bad, self.good, self.label = ["html"], [-1], [0], [0], [-1]
        self.runs: list[tuple[int, str]] = []
        self.stats = [[0, 0, 0, 0, 0]]                             # characters, link characters, words, stops, runs of own text
        self.stack, self.link, self.text = [0], False, []
        at, n = 0, len(source)
        while at < n:
            m = TOKEN.search(source, at)
            if m is None:
                self._add(source[at:])
                break
            if m.start() > at:
                self._add(source[at:m.start()])
            name = m[2]
            if name is None:
                at = m.end()
                continue
            at = tag_end(source, m)
            if not at:                                              # a tag that never ends
                break
            name, attrs = name.lower(), source[m.end(2):at - 1]
            if not m[1] and name in SILENT and not attrs.endswith("/"):
                at = self._skip(source, at, name)
            elif name in TAGS:
                self._close(name) if m[1] else self._open(name, attrs)
            elif name == "a":
                self.link = not m[1]
            elif name in ("br", "hr", "img", "wbr", "input"):
                self.text.append(" ")
        self._flush()

    def _skip(self, source: str, at: int, name: str) -> int:
        """Where a silent element ends: after its end tag, or before the end of a block around it."""
        if name in RAW:
            end = re.compile(f"</{name}(?![^\\s/>])[^>]*>?", re.I).search(source, at)
            return end.end() if end else len(source)
        around, inside = {self.tag[i] for i in self.stack} | {"head"}, []
        while m := TOKEN.search(source, at):
            if m[2] is None:
                at = m.end()
                continue
            at, tag = tag_end(source, m), m[2].lower()
            if not at:
                break
            if not m[1]:
                if tag in RAW:
                    at = self._skip(source, at, tag)
                elif tag == "body" and tag not in around:           # an element left open in the head
                    return m.start()
                elif tag in TAGS:
                    inside.append(tag)
            elif tag == name:
                return at
            elif tag in inside:
                del inside[len(inside) - 1 - inside[::-1].index(tag):]
            elif tag in around:
                return m.start()
        return len(source)

    def _add(self, text: str) -> None:
        self.text.append(text)
        if self.link:
            self.stats[self.stack[-1]][1] += len(text)

    def _flush(self) -> None:
        if self.text:
            words = entities.unescape("".join(self.text)).split()
            self.text = []
            if words:
                text = " ".join(words)
                owner = self.stack[-1]
                self.runs.append((owner, text))
                own = self.stats[owner]
                own[0] += len(text)
                own[2] += len(words)
                own[3] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
                own[4] += 1

    def _pop_to(self, k: int) -> None:
        self._flush()
        del self.stack[k:]

    def _open(self, name: str, attrs: str) -> None:
        if name in ("html", "body") and any(self.tag[i] == name for i in self.stack):
            return
        for k in range(len(self.stack) - 1, 0, -1):                # an open paragraph ends where a block begins
            if self.tag[self.stack[k]] in ("p", *HEADS):
                self._pop_to(k)
                break
        for k in range(len(self.stack) - 1, 0, -1) if name in CLOSES else ():
            if self.tag[self.stack[k]] in FENCES[name]:
                break
            if self.tag[self.stack[k]] in CLOSES[name]:
                self._pop_to(k)
                break
        self._flush()
        bad, good, label = attribute_tokens(attrs)
        self.tag.append(name)
        self.parent.append(self.stack[-1])
        self.bad.append(bad)
        self.good.append(good)
        self.label.append(label)
        self.stats.append([0, 0, 0, 0, 0])
        self.stack.append(len(self.tag) - 1)

    def _close(self, name: str) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.tag[self.stack[k]] == name:
                self._pop_to(k)
                return


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature rows of all nodes of all pages; parent (global) and page of each node."""
    sizes = [len(p.tag) for p in pages]
    first = np.concatenate([[0], np.cumsum(sizes)])
    page = np.repeat(np.arange(len(pages)), sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages]) + first[page]
    root = np.zeros(len(page), bool)
    root[first[:-1]] = True
    parent[root] = first[:-1]
    tag = np.array([TAGS[t] for p in pages for t in p.tag])
    own = np.array([s for p in pages for s in p.stats], float)
    bad, good = (np.array([x for p in pages for x in getattr(p, k)], float) for k in ("bad", "good"))
    depth = np.zeros(len(page), int)
    bad_above, good_above = bad.copy(), good.copy()
    order = np.arange(len(page))
    level, levels = order[root], []
    children_of = np.argsort(parent + 0, kind="stable")
    bounds = np.searchsorted(parent[children_of], np.arange(len(page) + 1))
    while len(level):                                               # nodes by depth
        levels.append(level)
        counts = bounds[level + 1] - bounds[level]
        starts = np.repeat(bounds[level], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        below = children_of[starts]
        below = below[~root[below]]
        depth[below] = depth[parent[below]] + 1
        bad_above[below] += bad_above[parent[below]]
        good_above[below] += good_above[parent[below]]
        level = below
    in_tag = lambda *names: np.isin(tag, [TAGS[t] for t in names])
    furniture_tag = in_tag("nav", "aside", "footer", "header", "form", "menu", "dialog", "fieldset").astype(float)
    article_tag = in_tag("article", "main").astype(float)
    tag_above, article_above = furniture_tag.copy(), article_tag.copy()
    for level in levels[1:]:
        tag_above[level] += tag_above[parent[level]]
        article_above[level] += article_above[parent[level]]
    sub = np.concatenate([own, np.ones((len(page), 1)), in_tag("p")[:, None], in_tag("li", "td")[:, None], in_tag(*HEADS)[:, None], bad[:, None], good[:, None], article_tag[:, None], furniture_tag[:, None], in_tag("h1")[:, None]], 1).astype(float)
    for level in reversed(levels[1:]):
        np.add.at(sub, parent[level], sub[level])
    total = sub[first[page]]
    brothers = bounds[parent + 1] - bounds[parent]
    place = np.empty(len(page))
    place[children_of] = np.arange(len(page)) - bounds[parent[children_of]]
    same = np.bincount(parent * 64 + tag, minlength=64 * len(page))[parent * 64 + tag]
    before, after = np.zeros((len(page), 3)), np.zeros((len(page), 3))
    ranked = children_of
    linked = np.stack([sub[:, 2], sub[:, 1] / np.maximum(sub[:, 0], 1), bad], 1)
    near = parent[ranked[1:]] == parent[ranked[:-1]]
    before[ranked[1:][near]] = linked[ranked[:-1][near]]
    after[ranked[:-1][near]] = linked[ranked[1:][near]]
    chars = np.maximum(sub[:, 0], 1)
    up = sub[parent]
    columns = [
        tag, np.minimum(depth, 20), bad, good, bad_above, good_above, furniture_tag, tag_above, article_tag, article_above,
        np.log1p(sub[:, 0]), sub[:, 1] / chars, np.log1p(sub[:, 2]), sub[:, 3] / np.maximum(sub[:, 2], 1), sub[:, 0] / sub[:, 5], sub[:, 2] / np.maximum(sub[:, 4], 1),
        sub[:, 0] / np.maximum(total[:, 0], 1), np.log1p(own[:, 2]), own[:, 1] / np.maximum(own[:, 0], 1), sub[:, 6] / sub[:, 5], sub[:, 7] / sub[:, 5], sub[:, 8] / sub[:, 5],
        sub[:, 9] / sub[:, 5], sub[:, 10] / sub[:, 5], sub[:, 11], sub[:, 12] / sub[:, 5], total[:, 11] > 0, (total[:, 11] > 0) & (article_above == 0) & (sub[:, 11] == 0),
        brothers, place / np.maximum(brothers, 1), same / np.maximum(brothers, 1), *before.T, *after.T, tag[parent], up[:, 1] / np.maximum(up[:, 0], 1), up[:, 2] / np.maximum(up[:, 4], 1),
        up[:, 6] / up[:, 5], up[:, 0] / np.maximum(total[:, 0], 1), (np.arange(len(page)) - first[page]) / np.maximum(np.array(sizes)[page], 1), sub[:, 13] > 0, up[:, 13] > 0,
    ]
    return np.stack([np.asarray(c, float) for c in columns], 1), parent, page


# ---- training pages -------------------------------------------------------------------------

_SYLLABLES = "the er ing on an re tion es st en at ed to it is or ha ti of nd le ou ve co de ai qu ez ch un ß é ñ ü".split()


def _words(rng: random.Random, low: int, high: int) -> str:
    words = ["".join(rng.choices(_SYLLABLES, k=rng.randrange(1, 4))) for _ in range(rng.randrange(low, high + 1))]
    mode = rng.random()
    words = [w + rng.choice(["", "", "", "", "", "", ",", "."]) for w in words]
    if mode < 0.08:
        words = [w.upper() + "!!" for w in words]
    text = " ".join(words)
    return text[:1].upper() + text[1:] + rng.choice([".", ".", ".", "", "?"])


def sample_page(rng: random.Random) -> str:
    """A page whose block nodes carry their label in ``data-y``."""
    named = rng.random() < 0.65                                     # telling attributes
    plain = rng.random() < 0.45                                     # div instead of semantic elements

    def el(tag: str, body: str, y: int | None, *names: str, swap: bool = True) -> str:
        tag = "div" if swap and plain and tag in ("nav", "aside", "header", "footer", "article", "main", "section") else tag
        attrs = "" if y is None else f' data-y="{y}"'
        if names and (named or tag == "div" and rng.random() < 0.75):
            attrs += f' {rng.choice(["class", "class", "id"])}="{rng.choice(names)}{rng.choice(["", "", "-box", "_1", " wide"])}"'
        return f"<{tag}{attrs}>{body}</{tag}>"

    def links(low: int, high: int, top: int = 3) -> str:
        return "".join(el("li", f'<a href="/x">{_words(rng, 1, top)}</a>', 0) for _ in range(rng.randrange(low, high)))

    def menu() -> str:
        body = f"<ul data-y='0'>{links(2, 9)}</ul>" if rng.random() < 0.8 else " | ".join(f'<a href="/y">{_words(rng, 1, 2)}</a>' for _ in range(rng.randrange(2, 8)))
        return el("nav", body, 0, "nav", "menu", "navbar", "breadcrumbs", "main-menu")

    def advert() -> str:
        body = _words(rng, 2, 25) if rng.random() < 0.6 else el("p", _words(rng, 3, 30), 0)
        return el(rng.choice(["div", "aside"]), body, 0, "ad", "advert", "sponsored", "promo", "banner", "ad-slot") if named or rng.random() < 0.9 else ""

    def notice() -> str:
        return el("div", rng.choice([_words(rng, 4, 30), el("p", _words(rng, 4, 30), 0)]), 0, "cookie-notice", "notice", "consent", "alert", "newsletter")

    def form() -> str:
        return el("form", f'<label>{_words(rng, 1, 4)}</label> <input name="q"> <button>{_words(rng, 1, 2)}</button>' + rng.choice(["", el("p", _words(rng, 2, 15), 0)]), 0, "search", "signup", "login-form")

    def sidebar() -> str:
        parts = [el(rng.choice(["h3", "h4"]), _words(rng, 1, 4), 0), f"<ul data-y='0'>{links(2, 7, 8)}</ul>"]
        if rng.random() < 0.6:
            parts.append(el("p", _words(rng, 4, 30), 0))
        if rng.random() < 0.3:
            parts.append(el("div", _words(rng, 4, 30), 0, "widget"))
        return el("aside", "".join(parts), 0, "sidebar", "side", "related", "widget", "popular")

    def header() -> str:
        body = rng.choice([el("h1", _words(rng, 1, 3), 0), el("p", _words(rng, 1, 6), 0), f"<a href='/'>{_words(rng, 1, 3)}</a>", el("div", _words(rng, 1, 8), 0, "logo")])
        return el("header", body + (menu() if rng.random() < 0.5 else ""), 0, "header", "masthead", "site-header", "topbar")

    def footer() -> str:
        body = rng.choice(["&copy; 2020 ", ""]) + rng.choice([_words(rng, 2, 25), el("p", _words(rng, 3, 25), 0), f"<ul data-y='0'>{links(1, 5)}</ul>" + _words(rng, 2, 12)])
        return el("footer", body, 0, "footer", "site-footer", "legal", "copyright")

    def comments() -> str:
        one = lambda: el(rng.choice(["div", "li", "article"]) if named else "div", rng.choice([el("p", f"<b>{_words(rng, 1, 2)}</b> {_words(rng, 3, 40)}", 0), el("h4", _words(rng, 1, 2), 0) + el("p", _words(rng, 3, 50), 0)]), 0, "comment", "reply", "comment-body", swap=False)
        return el("section", rng.choice(["", el("h3", _words(rng, 1, 3), 0)]) + "".join(one() for _ in range(rng.randrange(1, 7))), 0, "comments", "discussion", "comment-list", "reader-comments")

    def paragraph() -> str:
        text = _words(rng, *rng.choice([(1, 3), (1, 12), (5, 40), (20, 120), (60, 260)]))
        k = rng.random()
        if k < 0.2:
            words = text.split(" ")
            i = rng.randrange(len(words))
            words[i] = rng.choice([f"<a href='/z'>{words[i]}</a>", f"<em>{words[i]}</em>", f"<b>{words[i]}</b>"])
            text = " ".join(words)
        elif k < 0.3:
            return f"<p data-y='1'><b>{text}<br>"
        return f"<p data-y='1'>{text}" + ("</p>" if k < 0.9 else "")

    def part() -> str:
        k = rng.random()
        if k < 0.76:
            return paragraph()
        if k < 0.82:
            return el(rng.choice(["h2", "h3"]), _words(rng, 1, 9), 1)
        if k < 0.87:
            tag = rng.choice(["ul", "ol"])
            return f"<{tag} data-y='1'>" + "".join(el("li", _words(rng, 2, 30), 1) for _ in range(rng.randrange(1, 7))) + f"</{tag}>"
        if k < 0.90:
            return el("blockquote", rng.choice([_words(rng, 4, 50), el("p", _words(rng, 4, 50), 1)]), 1)
        if k < 0.92:
            return el("pre", _words(rng, 4, 40), 1)
        if k < 0.94:
            return "<table data-y='1'>" + "".join("<tr data-y='1'>" + "".join(el("td", _words(rng, 1, 6), 1) for _ in range(3)) + "</tr>" for _ in range(rng.randrange(1, 5))) + "</table>"
        if k < 0.96:
            return f"<figure data-y='1'><img src='a.png'>{el('figcaption', _words(rng, 3, 20), 1)}</figure>"
        return rng.choice([advert, notice, form])() if named else paragraph()

    story = (el("h1", _words(rng, 2, 12), 1) if rng.random() < 0.8 else "") + "".join(part() for _ in range(rng.choice([1, 2, 3, 5, 8, 14, 25])))
    if rng.random() < 0.3:
        story = el("div", story, 1, "article-body", "entry-content", "text", "story-body")
    if rng.random() < 0.25 and not plain:
        story = el("header", el("h1", _words(rng, 2, 10), 1), 1) + story
    if rng.random() < 0.2:
        story += comments() if rng.random() < 0.5 else el("div", f"<ul data-y='0'>{links(2, 5)}</ul>", 0, "share", "social", "tags", "related")
    core = el(rng.choice(["article", "article", "main", "section", "div"]), story, 1, "article", "content", "post", "main", "story", "entry")
    if rng.random() < 0.3:
        core = el("main", core, 1, "main", "content", "page")
    lead = [f() for f in (header, menu, notice, advert, form) if rng.random() < 0.45]
    tail = [f() for f in (comments, sidebar, advert, form, notice, menu) if rng.random() < 0.35]
    if rng.random() < 0.3:
        lead.append(sidebar())
    if rng.random() < 0.85:
        tail.append(footer())
    body = "".join(lead) + core + "".join(tail)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["wrap", "container", "page", "layout"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_words(rng, 1, 9)}</title><style>p{{}}</style></head><body>{body}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 900, seed: int = 11) -> Booster:
    """The model, trained on ``pages`` written pages."""
    rng = random.Random(seed)
    docs = [Page(sample_page(rng)) for _ in range(pages)]
    x, parent, page = features(docs)
    y = np.array([v for d in docs for v in d.label])
    inside = y == 1
    for i in range(len(y) - 1, -1, -1):                             # an unlabelled wrapper belongs if anything in it does
        if inside[i]:
            inside[parent[i]] = inside[parent[i]] or y[parent[i]] == -1
    return boost(x, inside.astype(float))


def chosen(margin: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Best set of nodes closed under ancestors: a subtree counts if its own and its best descendants' log odds sum above zero."""
    gain = margin.copy()
    value, up = gain.tolist(), parent.tolist()
    for i in range(len(value) - 1, -1, -1):
        if up[i] != i and value[i] > 0:
            value[up[i]] += value[i]
    keep = [False] * len(value)
    for i in range(len(value)):
        keep[i] = value[i] > 0 and (up[i] == i or keep[up[i]])
    return np.array(keep, bool)


def extract(sources: list[str], model: Booster) -> list[str]:
    pages = [Page(s) for s in sources]
    x, parent, page = features(pages)
    margin = np.clip(model.margin(x), -6, 6)
    keep = chosen(margin, parent)
    first = np.concatenate([[0], np.cumsum([len(p.tag) for p in pages])])
    return ["\n\n".join(t for owner, t in p.runs if keep[first[k] + owner]) for k, p in enumerate(pages)]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: id, url, main text, its length in code points."""
    model = pages.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = extract([h or "" for h in part.column(2).to_pylist()], model.value)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    frame = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in frame.schema}
    got = frame.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return got.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
