"""Main text of web pages by belief propagation on the document tree.

A page is cut into block elements and text blocks. Every node is content or not. It depends on its parent by a table of
parent-child potentials, one for each kind of element and what its class, id and role hint at; text blocks also show what they are by
length, share of link text and punctuation. Messages pass up the tree and down again (sum-product, in logarithms, all pages of a run level by
level), and text blocks whose content marginal is at least one half are the main text.

The tables are counted on labelled pages: a bounded sample (``TRAINING_PAGES``, by a hash of the page id) of pages whose own markup tells
the article from the rest, and the text of those pages set into layouts whose parts are labelled, with and without telling tags.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a line feed. Scripts, styles, other
raw elements, comments and the head never are text; what stands in math, noscript, object or canvas is. A null or empty page gives an empty text; unclosed or misplaced tags close as far as
the tags around them say; pages of any size are read whole. Other columns are carried along in a struct.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdloom.llm.common import hashed_sample

TRAINING_PAGES, TRAINING_CHARS = 300, 50_000
LEAST_LAYOUTS = 30  # with fewer pages, layouts are also filled with stock text
RUN_PAGES = 200
SMOOTHING = 0.5

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>?""", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
RAW = {"script", "style", "title", "textarea", "iframe", "xmp", "noembed", "noframes"}  # run to the end of the page when unclosed
SKIPPED = {"template", "svg", "select"}  # their content is no text of the page; an unclosed one hides nothing
VOID = {"br", "hr", "img", "input", "meta", "link", "base", "col", "area", "embed", "param", "source", "track", "wbr"}
KINDS = {
    "article": "article", "main": "main", "section": "section", "div": "div", "center": "div", "p": "p", "blockquote": "p", "pre": "p", "figure": "figure", "figcaption": "figure",
    "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "ul": "list", "ol": "list", "dl": "list", "li": "item", "dt": "item",
    "dd": "item", "table": "table", "tbody": "table", "thead": "table", "tfoot": "table", "caption": "cell", "tr": "table", "td": "cell", "th": "cell", "nav": "nav", "menu": "nav",
    "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "button": "form", "label": "form", "address": "address", "details": "div",
    "summary": "p", "dialog": "aside", "hr": "div", "body": "body", "html": "body", "head": "head",
}
CLOSES = {  # an opening tag ends these open elements, up to the nearest of the bounds
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, set()),
}
ENDS_PARAGRAPH = set(KINDS) - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "label", "button", "body", "html", "head"}
GOOD = {"article", "content", "post", "entry", "main", "story", "text", "body", "page", "prose"}
BAD = {
    "nav", "navbar", "navigation", "menu", "header", "masthead", "footer", "sidebar", "side", "aside", "cookie", "cookies", "notice", "consent", "banner", "gdpr", "ad", "ads", "advert",
    "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion", "comment", "comments", "reply", "replies", "respond", "discussion", "share", "sharing", "social", "related",
    "recommended", "breadcrumb", "breadcrumbs", "subscribe", "newsletter", "popup", "modal", "overlay", "login", "signup", "search", "form", "widget", "pagination", "pager", "alert",
    "contentinfo", "complementary", "copyright", "toolbar", "tags", "disclaimer", "hidden", "skip",
}


@dataclass
class Trees:
    """Nodes of several pages in order of opening: parents (-1: a page's root), levels, features, text of text blocks, gold labels."""

    parent: list[int] = field(default_factory=list)
    level: list[int] = field(default_factory=list)
    kind: list[str] = field(default_factory=list)
    signs: list[tuple[str, ...]] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    gold: list[int | None] = field(default_factory=list)
    page: list[int] = field(default_factory=list)

    def add(self, page: int, parent: int, kind: str, signs: tuple[str, ...], text: str | None, gold: int | None) -> int:
        self.parent.append(parent)
        self.level.append(self.level[parent] + 1 if parent >= 0 else 0)
        self.kind.append(kind)
        self.signs.append(signs)
        self.text.append(text)
        self.gold.append(gold if gold is not None or parent < 0 else self.gold[parent])
        self.page.append(page)
        return len(self.parent) - 1


def _hint(attrs: str, labelled: bool) -> tuple[str, int | None]:
    if not attrs or attrs.isspace():
        return "none", None
    words, gold = set(), None
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role", "aria-label"):
            words |= set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()))
        elif labelled and name == "data-gold":
            gold = int(value)
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE) or name == "aria-hidden" and value.lower() == "true":
            words.add("hidden")
    if re.search(r"(?:^|\s)hidden(?=\s|$|/)", attrs):
        words.add("hidden")
    bad, good = words & BAD, words & GOOD
    return "bad" if bad else "good" if good else "none", gold


def _text_signs(text: str, linked: int) -> tuple[str, ...]:
    size = len(text)
    share = linked / max(1, size)
    return (f"size:{min(size.bit_length(), 9)}", f"link:{0 if share < 0.1 else 1 if share < 0.5 else 2}", f"stop:{int(text[-1] in '.!?:;…')}")


def parse(trees: Trees, page: int, source: str, labelled: bool = False) -> None:
    """Add the tree of a page. Only ``labelled`` layouts, which are made here, may say what is content."""
    root = trees.add(page, -1, "body none", (), None, None)
    stack: list[tuple[str, int]] = [("", root)]
    parts: list[str] = []
    linked, link_from, at, size = 0, None, 0, len(source)
    never: dict[str, int] = {}

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            trees.add(page, stack[-1][1], "text none", _text_signs(text, linked), text, None)
        parts.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal link_from
        flush()
        del stack[to:]
        if link_from is not None and link_from > len(stack):
            link_from = None

    def said(low: int, high: int) -> None:
        nonlocal linked
        if high > low:
            parts.append(source[low:high])
            if link_from is not None:
                linked += high - low

    while at < size:
        token = TOKEN.search(source, at)
        if token is None:
            said(at, size)
            break
        said(at, token.start())
        at = token.end()
        if token["tag"] is None:
            continue
        tag, ends = token["tag"].lower(), bool(token["end"])
        if tag in RAW or tag in SKIPPED:
            if not ends and not token["attrs"].rstrip().endswith("/"):
                if at >= never.get(tag, size + 1):
                    stop = None
                else:
                    stop = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                if stop is None:
                    never[tag] = at  # no end tag from here on: not looked for again
                at = stop.end() if stop else size if tag in RAW else at
                parts.append(" ")
        elif tag == "a":
            link_from = None if ends else len(stack)
        elif tag in ("br", "img", "input", "wbr"):
            parts.append(" " if tag != "wbr" else "")
        elif tag in KINDS:
            if ends:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if depth:
                    close(depth)
                else:
                    flush()
                continue
            if tag in CLOSES:
                names, bounds = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in names:
                        close(i)
                        break
                    if stack[i][0] in bounds:
                        break
            if tag in ENDS_PARAGRAPH and stack[-1][0] == "p":
                close(len(stack) - 1)
            flush()
            if tag not in VOID:
                hint, gold = _hint(token["attrs"], labelled)
                kind = KINDS[tag]
                if kind in ("header", "footer") and any(t in ("article", "main") for t, _ in stack):
                    kind += "-inside"  # of an article, not of the page
                stack.append((tag, trees.add(page, stack[-1][1], f"{kind} {hint}", (), None, gold)))
    flush()


@dataclass
class ContentModel:
    """Logarithms: of a node's signs given its label, of its label given its parent's (root: given none)."""

    signs: dict[str, tuple[float, float]]
    links: dict[str, np.ndarray]

    def unary(self, trees: Trees) -> np.ndarray:
        known = self.signs
        none = (0.0, 0.0)
        out = np.zeros((len(trees.kind), 2))
        for i, signs in enumerate(trees.signs):
            for sign in signs:
                a, b = known.get(sign, none)
                out[i, 0] += a
                out[i, 1] += b
        return out

    def pairwise(self, trees: Trees) -> np.ndarray:
        kinds = sorted(self.links)
        number = {k: i for i, k in enumerate(kinds)}
        other = number["div none"]
        return np.stack([self.links[k] for k in kinds])[[number.get(k, other) for k in trees.kind]]


def content_marginals(model: ContentModel, trees: Trees) -> np.ndarray:
    """Probability of every node to be content: messages from the leaves up, then from the roots down."""
    parent, level = np.array(trees.parent), np.array(trees.level)
    own, link = model.unary(trees), model.pairwise(trees)
    order = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[order], np.arange(level.max() + 2))
    levels = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    up = np.zeros_like(own)  # from a node to its parent, by the parent's label
    for nodes in reversed(levels):
        up[nodes] = np.logaddexp(link[nodes, :, 0] + own[nodes, None, 0], link[nodes, :, 1] + own[nodes, None, 1])
        inner = nodes[parent[nodes] >= 0]
        np.add.at(own, parent[inner], up[inner])
    down = np.zeros_like(own)
    for nodes in levels:
        rest = np.where(parent[nodes, None] >= 0, own[parent[nodes]] + down[parent[nodes]] - up[nodes], np.log(0.5))
        down[nodes] = np.logaddexp(link[nodes, 0, :] + rest[:, None, 0], link[nodes, 1, :] + rest[:, None, 1])
    odds = own + down
    return 1 / (1 + np.exp(np.clip(odds[:, 0] - odds[:, 1], -700, 700)))


def _counted_tables(trees: Trees) -> ContentModel:
    size = np.array([len(t or "") for t in trees.text], float)
    good = size * np.array([g == 1 for g in trees.gold])
    for i in range(len(size) - 1, -1, -1):  # an element without a label is what most of its text is
        if trees.parent[i] >= 0:
            size[trees.parent[i]] += size[i]
            good[trees.parent[i]] += good[i]
    label = np.where([g is None for g in trees.gold], 2 * good > size, np.array([g == 1 for g in trees.gold])).astype(int)
    signs, links = Counter(), Counter()
    for i, own in enumerate(label.tolist()):
        if size[i] == 0:
            continue
        above = label[trees.parent[i]] if trees.parent[i] >= 0 else own
        links[trees.kind[i], above, own] += 1
        for sign in trees.signs[i]:
            signs[sign, own] += 1
    families = Counter()
    for (sign, own), n in signs.items():
        families[sign.split(":")[0], own] += n
    spread = Counter(sign.split(":")[0] for sign in {s for s, _ in signs})
    tables = {}
    for sign in {s for s, _ in signs}:
        family = sign.split(":")[0]
        tables[sign] = tuple(float(np.log((signs[sign, x] + SMOOTHING) / (families[family, x] + SMOOTHING * spread[family]))) for x in (0, 1))
    pairs = {}
    for kind in {f"{k} {hint}" for k in (*KINDS.values(), "header-inside", "footer-inside", "text") for hint in ("none", "good", "bad")}:
        table = np.array([[links[kind, a, x] + SMOOTHING for x in (0, 1)] for a in (0, 1)])
        pairs[kind] = np.log(table / table.sum(axis=1, keepdims=True))
    return ContentModel(tables, pairs)


# Labelled pages -------------------------------------------------------------------------------------------------------

FILLER = ["A short line of text", "A longer piece of text that goes on for a while, with commas, and ends in a stop.", "Home", "About us", "Read more"]


def labelled_layouts(title: str, body: list[str], small: list[str], rng: random.Random) -> list[str]:
    """Pages whose parts say by ``data-gold`` whether they are content."""
    e = html.escape
    pick = lambda: e(rng.choice(small))
    links = lambda n: "".join(f'<li><a href="#">{pick()}</a></li>' for _ in range(n))
    long_ = lambda: e(rng.choice(body))
    text = "".join(f"<p>{e(x)}</p>" for x in body)
    rich = text + f"<h2>{pick()}</h2><ul><li>{long_()}</li><li>{pick()}.</li></ul><blockquote><p>{long_()}</p></blockquote><table><tr><td>{pick()}</td><td>{pick()}</td></tr></table><pre>{pick()}</pre>"
    head = f"<h1>{e(title)}</h1>"
    comments = f'<h3>{pick()}</h3><div class="comment"><p>{long_()}</p><a href="#">{pick()}</a></div><div class="comment"><p>{pick()}.</p></div>'
    def nest(part: str, most: int = 4) -> str:
        for _ in range(rng.randrange(most)):
            tag = rng.choice(["div", "div", "section"])
            part = f"<{tag}>{part}</{tag}>"
        return part

    text, rich, comments = nest(text), nest(rich), nest(comments)
    form = f"<form><label>{pick()}</label><p>{pick()}.</p><button>{pick()}</button></form>"
    return [
        f'<nav data-gold="0"><ul>{links(5)}</ul></nav><div class="ad" data-gold="0">{long_()}</div><article data-gold="1">{head}{rich}</article><footer data-gold="0">{pick()} &middot; {long_()}</footer>',
        f'<div id="page"><header class="site-header" data-gold="0"><h2>{pick()}</h2><nav><a href="#">{pick()}</a> <a href="#">{pick()}</a></nav></header><div class="cookie-notice" data-gold="0"><p>{long_()}</p></div>'
        f'<main data-gold="1"><div class="post">{head}{rich}</div></main><aside class="sidebar" data-gold="0"><h3>{pick()}</h3><ul>{links(4)}</ul><p>{long_()}</p></aside>'
        f'<section id="comments" class="comments" data-gold="0">{comments}</section><footer data-gold="0"><p>{long_()}</p></footer></div>',
        f'<div class="wrapper"><div class="header" data-gold="0"><p>{pick()}</p></div><div class="menu" data-gold="0"><ul>{links(6)}</ul></div><div class="content" data-gold="1">{head}{text}<div class="advert" data-gold="0"><p>{long_()}</p></div>'
        f'{rich}</div><div class="sidebar" data-gold="0"><p>{long_()}</p></div><div class="footer" data-gold="0"><p>{long_()}</p></div></div>',
        f'<header data-gold="0">{pick()}</header><article data-gold="1"><header>{head}<p>{pick()}</p></header>{rich}<aside data-gold="0"><p>{long_()}</p></aside><div class="share" data-gold="0"><ul>{links(3)}</ul></div>'
        f'<section class="comments" data-gold="0">{comments}</section><footer data-gold="0"><p>{long_()}</p></footer></article><div data-gold="0">{form}</div>',
        f'<div data-gold="0"><a href="#">{pick()}</a> <a href="#">{pick()}</a> <a href="#">{pick()}</a></div>{nest(f'<div data-gold="1">{head}{rich}</div>')}<div data-gold="0"><ul>{links(5)}</ul></div><div data-gold="0">{form}</div>',
        f'<div class="notice" data-gold="0"><p>{long_()}</p></div><section data-gold="1">{head}{text}</section><div id="related" data-gold="0"><h3>{pick()}</h3><ul>{links(4)}</ul></div>'
        f'<form data-gold="0"><p>{long_()}</p></form><div role="contentinfo" data-gold="0"><p>{long_()}</p></div>',
        f'<h1 data-gold="1">{e(title)}</h1>' + "".join(f'<p data-gold="1">{e(x)}</p>' for x in body) + f'<div class="footer" data-gold="0">{pick()}</div>',
        nest("".join(f'<p data-gold="1">{e(x)}</p>' for x in body)) + f'<ul data-gold="0">{links(3)}</ul>',
        nest(f'<div data-gold="1">{text}</div>') + f'<div data-gold="0"><a href="#">{pick()}</a> <a href="#">{pick()}</a></div>',
        nest(f'<div data-gold="1">{head}{text}</div>', 2),
        f'<div class="cookie-banner" data-gold="0">{long_()}</div><article data-gold="1">{text}</article>',
    ]


def learn_content(pages: list[str]) -> ContentModel:
    """From pages whose article element tells content apart, and their texts set into labelled layouts."""
    trees, rng = Trees(), random.Random(5)
    count = 0
    for source in [*pages, *[""] * max(0, LEAST_LAYOUTS - len(pages))]:
        own = Trees()
        parse(own, 0, source)
        if any(k.startswith("article") for k in own.kind):
            start = len(trees.parent)
            for i, kind in enumerate(own.kind):
                above = own.parent[i]
                gold = 1 if kind.startswith("article") else 0 if above == 0 else None
                trees.add(count, above + start if above >= 0 else -1, kind, own.signs[i], own.text[i], gold)
            count += 1
        inside = [t for i, t in enumerate(own.text) if t]
        body = sorted(inside, key=len)[-rng.randint(1, 6) :] or [" ".join(rng.choices(FILLER, k=3)) + "." for _ in range(rng.randint(1, 6))]
        small = [t for t in inside if len(t) < 60] or FILLER
        for layout in labelled_layouts(small[0], body, small, rng):
            parse(trees, count, layout, labelled=True)
            count += 1
    return _counted_tables(trees)


def fit_content(pages: DataFrame) -> ContentModel:
    """From a bounded sample of ``pages(page_id, html)``."""
    sample = hashed_sample(pages.select("page_id", "html").filter(F.length("html") <= TRAINING_CHARS), "page_id", TRAINING_PAGES)
    return learn_content([r["html"] for r in sample.collect()])


def main_texts(model: ContentModel, pages: list[str | None]) -> list[str]:
    trees = Trees()
    for i, source in enumerate(pages):
        parse(trees, i, source or "")
    marginal = content_marginals(model, trees)
    blocks: list[list[str]] = [[] for _ in pages]
    for node in np.flatnonzero(marginal >= 0.5).tolist():
        if trees.text[node] is not None:
            blocks[trees.page[node]].append(trees.text[node])
    return ["\n".join(b) for b in blocks]


def extract_main_text(pages: DataFrame, model: ContentModel) -> DataFrame:
    """Rows of ``pages(html, ...)`` as ``row`` (all columns but ``html``), ``text`` and ``n_chars``."""
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    rows = pages.select(F.struct(*rest).alias("row"), "html")
    return rows.mapInArrow(_extracted(model), f"row {rows.schema['row'].dataType.simpleString()}, text string, n_chars bigint")


def _extracted(model: ContentModel) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, RUN_PAGES):
                part = batch.slice(low, RUN_PAGES)
                texts = main_texts(model, part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    return run
