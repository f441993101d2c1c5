"""HTML extraction: a tree-structured graphical model over the DOM.

Each element that bounds blocks, and each block of text, is a node that is content or not.
A node's own potential is a logistic score of its features (tag, hashed words and tokens of
class, id and role, text length, link density, place); a parent and a child share a potential
for each pair of labels. Sum-product messages go up and then down the tree, and blocks with a
content marginal of at least one half are the main text. Both kinds of potentials are learned
together by the likelihood of whole labelled trees, whose gradient the same messages give. The
pages for that (``labelled_pages``) come from a seeded grammar in which every block is marked,
as the tables carry no labelled pages; no list of names takes part outside that grammar, and a name
alone decides nothing, as content there carries misleading names too.

Block rules: character references are decoded, white space inside a block becomes one blank,
blocks are joined in page order by two line feeds; scripts, styles and form controls are no
text. Edge cases: null or empty html gives an empty text, so does a page without content;
unclosed tags end with their parent, an unclosed head or button where the page's blocks begin;
text beside no element forms its own block; repeated rows extract alike; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache
from html import unescape
from random import Random
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option button iframe object svg math canvas audio video title datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins del kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr input".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[a-z]+")
#: Fixed values of the HTML language: what a head may hold, and what ends a control whose end tag is missing.
HEAD = frozenset("title meta link script style base noscript template bgsound basefont".split())
ENDS_CONTROL = CLOSES_P | {"body", "html", "td", "th", "tr", "li", "dd", "dt"}

TAGS = ["article", "main", "nav", "header", "footer", "aside", "form", "menu", "ul", "li", "table", "p", "h", "section", "div", "quote", "dialog", "body"]
_TAG_OF = {t: i for i, t in enumerate(TAGS)} | {f"h{i}": TAGS.index("h") for i in range(1, 7)}
_TAG_OF |= {"ol": TAGS.index("ul"), "dl": TAGS.index("ul"), "dd": TAGS.index("li"), "dt": TAGS.index("li"), "blockquote": TAGS.index("quote"), "pre": TAGS.index("quote"), "figure": TAGS.index("quote"), "figcaption": TAGS.index("quote"), "tr": TAGS.index("table"), "td": TAGS.index("table"), "th": TAGS.index("table"), "tbody": TAGS.index("table"), "fieldset": TAGS.index("form"), "details": TAGS.index("div")}
#: Slots that the words and whole tokens of class, id and role are hashed to; their weights are learned.
NAME_SLOTS = 512
PLAIN = len(TAGS) + 11
WIDTH = PLAIN + NAME_SLOTS


class Node:
    __slots__ = ("tag", "parent", "kids", "words", "hidden", "label", "text", "links", "block")

    def __init__(self, tag, parent, words=frozenset(), hidden=False, label=None):
        self.tag, self.parent, self.kids, self.words, self.hidden, self.label = tag, parent, [], words, hidden, label
        self.text, self.links, self.block = 0, 0, None


def dom(html: str, marked: bool = False) -> Node:
    """The tree of block elements with text blocks as leaves (``block`` holds their text). ``marked`` pages carry labels in ``data-y``."""
    root = Node("body", None)
    stack: list[tuple[str, Node]] = [("body", root)]
    pieces: list[str] = []
    linked, anchors, skip, at = 0, 0, "", 0

    def flush():
        nonlocal linked
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            leaf = Node("#text", stack[-1][1])
            leaf.block, leaf.text, leaf.links = text, len(text), min(linked, len(text))
            stack[-1][1].kids.append(leaf)
        pieces.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        if not skip and m.start() > at:
            piece = html[at : m.start()]
            pieces.append(piece)
            if anchors:
                linked += len(piece)
        if m.start() < at:
            continue
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing = bool(m[1] or m[4])
        if skip:
            if closing and tag == skip or not closing and (skip == "head" and tag not in HEAD or skip in ("button", "select", "option", "datalist") and tag in ENDS_CONTROL):
                skip = ""
            elif skip == "head" and tag in HEAD and not closing:
                pass  # its content is no text, whatever it holds
            else:
                continue
            if closing:
                continue
        if tag == "head":
            skip = "" if closing else "head"
            continue
        if tag in RAW:
            if not closing and not (m[0].endswith("/>")):
                if tag in ("script", "style", "textarea", "title", "noscript", "template", "iframe"):
                    end = _raw_end(html, tag, at)
                    at = len(html) if end < 0 else html.find(">", end) + 1 or len(html)
                elif not skip:
                    skip = tag
            continue
        if skip:
            continue
        if tag == "a":
            anchors = 0 if closing else 1
        if tag in INLINE:
            if tag in ("br", "wbr") or tag == "img":
                pieces.append(" " if tag == "br" else "")
            continue
        flush()
        if closing:
            anchors = 0
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    del stack[depth:]
                    break
            continue
        if tag in VOID or tag in ("html",):
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            stack.pop()
        if tag in SIBLINGS:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] in SIBLINGS[tag]:
                    del stack[depth:]
                    break
                if stack[depth][0] in SCOPES[tag]:
                    break
        node = stack[0][1] if tag == "body" else _element(tag, m[3] if m[2] else m[6], stack[-1][1], marked)
        if tag == "body":
            continue
        stack[-1][1].kids.append(node)
        if not m[0].endswith("/>"):
            stack.append((tag, node))
    if not skip and at < len(html):
        pieces.append(html[at:])
    flush()
    return root


def _raw_end(html: str, tag: str, at: int) -> int:
    found = re.compile(f"</{tag}", re.I).search(html, at)
    return found.start() if found else -1


def _element(tag: str, attributes: str, parent: Node, marked: bool) -> Node:
    if not attributes or attributes.isspace():
        return Node(tag, parent)
    words, hidden, label = set(), False, None
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name in ("class", "id", "role"):
            for token in value.split():
                words.update(_WORD.findall(token))
                words.add("=" + token)
        elif marked and name == "data-y":
            label = int(value)
    return Node(tag, parent, frozenset(words), hidden, label)


def ordered(root: Node) -> list[Node]:
    """All nodes, parents first and in page order; sums text and link lengths upwards."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.kids))
    for node in reversed(out):
        if node.parent is not None:
            node.parent.text += node.text
            node.parent.links += node.links
    return out


class _Slots(dict):
    """Memo from a word or token to its feature."""

    def __missing__(self, word: str) -> int:
        slot = PLAIN + crc32(word.encode("utf-8", "replace")) % NAME_SLOTS
        if len(self) < 100_000:
            self[word] = slot
        return slot


_slots = _Slots()


def features(nodes: list[Node]) -> np.ndarray:
    """What each node shows by itself; what its surroundings say comes by messages."""
    x = np.zeros((len(nodes), WIDTH))
    base = len(TAGS)
    for i, n in enumerate(nodes):
        row = x[i]
        if n.tag in _TAG_OF:
            row[_TAG_OF[n.tag]] = 1
        row[base] = 1
        row[base + 1] = n.hidden
        density = n.links / n.text if n.text else 0
        row[base + 2] = density
        row[base + 3] = density > 0.6
        row[base + 4] = n.text / (n.text + 400)
        if n.block is not None:
            row[base + 5] = 1
            row[base + 6] = n.text / (n.text + 100)
            row[base + 7] = n.block[-1:] in ".!?"
        row[base + 8] = n.parent is not None and n.parent.tag == "body"
        row[base + 9] = n.text == 0
        row[base + 10] = bool(n.words)
        for word in n.words:
            row[_slots[word]] = 1
    return x


@dataclass(frozen=True)
class DomModel:
    weight: np.ndarray
    pair: np.ndarray  # log potential of (parent, child)


def marginals(nodes: list[Node], model: DomModel) -> np.ndarray:
    """P(content) of each node by sum-product: messages to the parents, then back to the children."""
    own = features(nodes) @ model.weight
    index = {id(n): i for i, n in enumerate(nodes)}
    parent = [-1 if n.parent is None else index[id(n.parent)] for n in nodes]
    t = np.exp(model.pair)
    (t00, t01), (t10, t11) = t.tolist()
    up1 = np.clip(own, -30, 30).tolist()  # log ratio content : boilerplate gathered from below
    sent = [0.0] * len(nodes)
    from math import exp, log

    for i in range(len(nodes) - 1, 0, -1):
        r = exp(max(-40.0, min(40.0, up1[i])))
        sent[i] = log((t10 + t11 * r) / (t00 + t01 * r))
        up1[parent[i]] += sent[i]
    full = up1[:1] + [0.0] * (len(nodes) - 1)
    for i in range(1, len(nodes)):
        r = exp(max(-40.0, min(40.0, full[parent[i]] - sent[i])))
        full[i] = up1[i] + log((t01 + t11 * r) / (t00 + t10 * r))
    return 1 / (1 + np.exp(-np.clip(np.array(full), -40, 40)))


def extract(html: str | None, model: DomModel) -> str:
    if not html:
        return ""
    nodes = ordered(dom(html))
    if len(nodes) < 2:
        return ""
    p = marginals(nodes, model)
    return "\n\n".join(n.block for n, x in zip(nodes, p) if n.block is not None and x >= 0.5)


def labelled_pages(count: int = 300, seed: int = 3) -> list[str]:
    """Pages of a seeded grammar; ``data-y`` marks content (1) and boilerplate (0) subtrees."""
    rng = Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "un", "sa", "vel", "or", "dan", "is", "pre", "tu", "gon", "a", "e"]

    def some(low, high, end="."):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randrange(low, high))]
        return " ".join(words).capitalize() + end

    def pick(*options):
        return rng.choice(options)

    def links(n):
        return "".join(f'<li><a href="/x">{some(1, 3, "")}</a></li>' for _ in range(n))

    def noise(tag_attr):
        """Names that say little, some with a word that tells of boilerplate elsewhere."""
        some_names = ["row", "col", "wrap", "inner", "clearfix", "hentry", "status-publish", "tags-news", "no-comments", "has-sidebar", "with-ads", "share-enabled", "category-menu", "notice-free", "type-post", "grid", "box", "container", "header-fixed", "footer-visible", "related-on"]
        extra = " ".join(rng.sample(some_names, rng.randint(1, 3)))
        return tag_attr.replace('class="', f'class="{extra} ', 1) if 'class="' in tag_attr else f'{tag_attr} class="{extra}"'

    def names(words):
        return pick("", f' class="{pick(*words)}"', f' id="{pick(*words)}"', f' class="{pick("site", "page", "x", "block")}-{pick(*words)}"')

    def nav():
        tag = pick("nav", "nav", "div", "header")
        attr = names(["nav", "menu", "navbar"]) if tag != "div" else f' class="{pick("nav", "menu", "navbar", "breadcrumb")}"'
        return f'<{tag}{attr} data-y="0"><ul>{links(rng.randrange(2, 8))}</ul></{tag}>'

    def boiler():
        kind = rng.randrange(9)
        if kind == 0:
            return f'<aside{names(["sidebar", "related", "widget"])} data-y="0"><h3>{some(1, 4, "")}</h3>{pick(f"<ul>{links(4)}</ul>", f"<p>{some(6, 40)}</p>")}</aside>'
        if kind == 1:
            return f'<div class="{pick("ad", "ads", "advert", "ad-box", "sponsored", "banner", "promo")}" data-y="0">{pick(some(3, 30), f"<p>{some(4, 40)}</p>")}</div>'
        if kind == 2:
            return f'<div {pick("class", "id")}="{pick("cookie-notice", "notice", "cookie-banner", "consent", "popup", "alert")}" data-y="0"><p>{some(6, 40)}</p><button>ok</button></div>'
        if kind == 3:
            return f'<form{names(["search", "signup", "login", "newsletter"])} data-y="0"><label>{some(1, 4, "")}</label><input><p>{some(3, 20)}</p></form>'
        if kind == 4:
            return f'<{(t := pick("section", "div"))} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "replies")}" data-y="0"><h2>{some(1, 3, "")}</h2>' + "".join(f'<{(c := pick("div", "article", "p"))}{pick("", " class=comment")}><p>{some(4, 60)}</p></{c}>' for _ in range(rng.randrange(1, 5))) + f"</{t}>"
        if kind == 5:
            return f'<div class="{pick("share", "social", "related", "newsletter", "tags", "pagination")}" data-y="0">{pick(f"<ul>{links(3)}</ul>", some(2, 12))}</div>'
        if kind == 6:
            return f'<header{names(["header", "masthead"])} data-y="0"><h1>{some(1, 4, "")}</h1><p>{some(2, 12)}</p></header>'
        if kind == 7:
            return f'<div class="{pick("sidebar", "side", "widget", "rail")}" data-y="0"><h3>{some(1, 4, "")}</h3><p>{some(4, 40)}</p></div>'
        return f'<div hidden data-y="0"><p>{some(3, 30)}</p></div>'

    def story():
        parts = [f"<h1>{some(3, 10, '')}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.randrange(1, 9)):
            parts.append(pick(
                f"<p>{some(1, 12)}</p>", f"<p>{some(10, 90)}</p>", f"<p>{some(10, 90)}", f"<p><b>{some(10, 60)}<br>", f"<p>{some(5, 30, '')} <a href=x>{some(1, 3, '')}</a> {some(3, 30)}</p>",
                f"<h2>{some(2, 6, '')}</h2>", f"<ul><li>{some(3, 20)}</li><li>{some(2, 20)}</li></ul>", f"<blockquote>{some(5, 30)}</blockquote>", f"<div>{some(8, 60)}</div>", some(8, 40),
                f"<table><tr><td>{some(1, 5)}</td><td>{some(1, 5)}</td></tr></table>", f"<pre>{some(3, 20)}</pre>", f"<figure><figcaption>{some(3, 12)}</figcaption></figure>",
            ))
            if rng.random() < 0.12:
                parts.append(boiler())
        if rng.random() < 0.4:  # a page may hold no more than a heading and a paragraph
            parts = parts[: rng.randint(0, 1)] + [pick(f"<p>{some(1, 30)}</p>", f"<p>{some(1, 9)}</p>", f"<p><b>{some(2, 12)}<br>")]
        if rng.random() < 0.2:
            parts[0] = f"<header>{parts[0]}</header>"
        inner = "".join(parts)
        if rng.random() < 0.35:  # a container that says nothing, or little
            where = pick("div", "div", "section", "article", "main")
            attr = pick("", "", noise("")) if where in ("div", "section") else noise(f' class="{pick("post", "entry", "story")}"')
            return pick(f'<{where}{attr} data-y="1">{inner}</{where}>', f'<div{noise("")}><{where}{attr} data-y="1">{inner}</{where}></div>', f'<div><div data-y="1">{inner}</div></div>')
        return pick(
            f'<article data-y="1">{inner}</article>', f'<article data-y="1">{inner}</article>', f'<main data-y="1">{inner}</main>', f'<main><article data-y="1">{inner}</article></main>',
            f'<div class="{pick("content", "post", "entry-content", "article-body", "story", "main")}" data-y="1">{inner}</div>', f'<div id="{pick("content", "main", "article")}" data-y="1">{inner}</div>',
        )

    pages = []
    for _ in range(count):
        top = [nav()] + [boiler() for _ in range(rng.randrange(0, 3))]
        tail = [boiler() for _ in range(rng.randrange(0, 3))] + [f'<footer{names(["footer"])} data-y="0">{pick("", "&copy; ")}{pick(some(2, 30), f"<p>{some(2, 30)}</p>")}</footer>'] * int(rng.random() < 0.9)
        body = "".join(top) + story() + "".join(tail)
        if rng.random() < 0.25:
            body = f'<div{pick(noise(""), noise(f""" class="{pick("page", "wrapper", "container")}" """.rstrip()))}>{body}</div>'
        pages.append(f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>")
    return pages


def _labels(nodes: list[Node]) -> list[int]:
    """Labels hold for what stands below, until another one; an unlabelled ancestor is content if most of its text is."""
    label: dict[int, int | None] = {}
    for n in nodes:
        label[id(n)] = n.label if n.label is not None else None if n.parent is None else label[id(n.parent)]
    share: dict[int, list[int]] = {}
    for n in reversed(nodes):
        good, all_ = share.get(id(n), [0, 0])
        if n.block is not None:
            good, all_ = n.text * (label[id(n)] or 0), n.text
        if n.parent is not None:
            s = share.setdefault(id(n.parent), [0, 0])
            s[0] += good
            s[1] += all_
        if label[id(n)] is None:
            label[id(n)] = int(2 * good > all_)
    return [label[id(n)] for n in nodes]


def fit(x: np.ndarray, y: np.ndarray, parent: np.ndarray, steps: int = 400, ridge: float = 0.1) -> DomModel:
    """Maximum likelihood of whole labelled trees: the gradient is what the labels show less what sum-product expects.

    Nodes of all pages are rows, parents before children; the messages of one depth go at once.
    """
    depth = np.zeros(len(y), int)
    for i in np.flatnonzero(parent >= 0):
        depth[i] = depth[parent[i]] + 1
    levels = [np.flatnonzero(depth == d) for d in range(1, depth.max() + 1)]
    child = np.flatnonzero(parent >= 0)
    up_to = parent[child]
    seen = np.array([np.sum((y[up_to] == a) & (y[child] == b)) for a in (0, 1) for b in (0, 1)], float)
    theta, m, v = (np.zeros(x.shape[1] + 4) for _ in range(3))
    for step in range(1, steps + 1):
        pair = theta[-4:]
        t00, t01, t10, t11 = np.exp(pair)
        up, sent = x @ theta[:-4], np.zeros(len(y))
        for at in reversed(levels):
            r = np.exp(np.clip(up[at], -40, 40))
            sent[at] = np.log((t10 + t11 * r) / (t00 + t01 * r))
            np.add.at(up, parent[at], sent[at])
        full = up.copy()
        for at in levels:
            r = np.exp(np.clip(full[parent[at]] - sent[at], -40, 40))
            full[at] = up[at] + np.log((t01 + t11 * r) / (t00 + t10 * r))
        above, below = np.clip(full[up_to] - sent[child], -40, 40), np.clip(up[child], -40, 40)
        joint = np.exp(np.stack([pair[0] + 0 * above, pair[1] + below, pair[2] + above, pair[3] + above + below]))
        expected = (joint / joint.sum(axis=0)).sum(axis=1)
        p = 1 / (1 + np.exp(-np.clip(full, -40, 40)))
        g = np.concatenate([x.T @ (y - p), seen - expected]) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return DomModel(theta[:-4], theta[-4:].reshape(2, 2))


@cache
def train(count: int = 800, seed: int = 3) -> DomModel:
    """The model of the labelled pages."""
    xs, ys, parents, before = [], [], [], 0
    for html in labelled_pages(count, seed):
        nodes = ordered(dom(html, marked=True))
        index = {id(n): before + i for i, n in enumerate(nodes)}
        parents += [-1 if n.parent is None else index[id(n.parent)] for n in nodes]
        before += len(nodes)
        xs.append(features(nodes))
        ys += _labels(nodes)
    return fit(np.vstack(xs), np.array(ys, float), np.array(parents))


def extractor(model: DomModel, spark):
    """A column function from html to the main text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h if isinstance(h, str) else None, shared.value) for h in html], dtype=object)

    return main_text
