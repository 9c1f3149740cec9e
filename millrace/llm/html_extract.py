"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A page is read into its block elements (inline elements belong to the block around them; unclosed and wrongly nested tags are
mended as browsers do for the common cases). Each block has features: tag, attribute tokens of its own and of its ancestors,
depth, text lengths, link density, blocks, paragraphs and text density in its subtree, and its place and share among its
siblings. Boosted trees, written here in numpy and trained on PAGES generated and labelled pages (no table is read), give the
odds that a block whose parent is kept holds, or leads to, main text. Decoding goes down the tree and keeps a block only if its
parent is kept, so a kept paragraph in a dropped menu can't occur.

The text of kept blocks has character references decoded and white space runs turned into one space; blocks are trimmed, empty
ones dropped, and joined in page order by one line feed. Script, style, head and comments never are text; svg, select, noscript, object
and template aren't either if they are closed, and what follows the start tag of an unclosed one is read like the rest of the page.

Null or empty html gives an empty text. Bytes that aren't UTF-8 are read as U+FFFD. Pages of any length are read whole. Repeated rows give repeated rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import lean

PAGES = 800

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "template", "noscript", "iframe", "svg", "textarea", "title", "select", "object"))
#: Of these only script, style, title, textarea and iframe reach to the end of a page without an end tag, as in browsers.
ENDLESS = frozenset("script style title textarea iframe".split())
#: Elements that end an open svg; foreignobject and desc may hold them.
_LEAVES_SVG = "b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|h[1-6]|head|hr|i|img|li|listing|menu|meta|nobr|ol|p|pre|ruby|s|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
_SPANS = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|iframe)(?=[\s/>]).*?(?:</(?P=raw)|\Z)|<(?P<end>/?)(?:(?P<tag>svg|select|noscript|object|template)|(?P<held>foreignobject|desc)|(?P<leaves>{_LEAVES_SVG}))(?=[\s/>])(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+|[^>]*)>""", re.S | re.I)
CLOSES_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
TAG_GROUPS = ("html body", "head script style noscript template title iframe svg select object textarea", "article main", "section", "div center", "p", "h1 h2 h3 h4 h5 h6 hgroup", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside dialog", "form fieldset button input", "table thead tbody tfoot tr td th", "figure figcaption", "blockquote pre address")
TAG_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
TOKEN_GROUPS = (
    "article content contents post entry main body story text page detail copy prose blog",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links topbar",
    "ad ads adv advert advertisement advertising adsbygoogle banner sponsor sponsored promo promotion dfp",
    "comment comments disqus reply replies respond discussion feedback commentlist",
    "cookie cookies consent notice notification popup modal alert gdpr overlay warning newsletter subscribe signup",
    "footer foot copyright legal bottom",
    "header head masthead logo top branding title",
    "sidebar side aside rail widget related recommended recommendations more trending popular share sharing social tags meta byline author",
    "form search login register contact input",
)
TOKEN_GROUP = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_SPLIT = re.compile(r"[A-Za-z][a-z]*")
N_TAGS, N_TOKENS = len(TAG_GROUPS) + 1, len(TOKEN_GROUPS)


class Page:
    """Block elements in page order; runs are (block, stretch, raw text, in a link), a stretch being the text between two block borders."""

    __slots__ = ("parent", "tag", "tokens", "attrs", "runs")

    def __init__(self, source: str):
        self.parent, self.tag, self.tokens, self.attrs, self.runs = [-1], ["html"], [0], [""], []
        stack: list[tuple[str, int]] = [("#root", 0)]  # (tag, block that text inside belongs to)
        at = stretch = links = 0
        n = len(source)
        lowered = spans = None
        drawing = False
        while at < n:
            m = TOKEN.search(source, at)
            begin = m.start() if m else n
            if begin > at:
                self.runs.append((stack[-1][1], stretch, source[at:begin], links > 0))
            if m is None:
                break
            at = m.end()
            if m["cdata"] is not None:
                self.runs.append((stack[-1][1], stretch, html.escape(m["cdata"]), links > 0))
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                depth = len(stack) - 1
                while depth > 0 and stack[depth][0] != tag:
                    # an inline end tag doesn't end blocks; a list item's end stays in its list
                    if tag in INLINE and stack[depth][0] not in INLINE:
                        depth = 0
                        break
                    depth -= 1
                if depth > 0:
                    links -= sum(t == "a" for t, _ in stack[depth:])
                    del stack[depth:]
                if tag not in INLINE:
                    stretch += 1
                continue
            if tag in RAW and tag not in ENDLESS:
                spans = _spans(source) if spans is None else spans
                stretch += 1
                end = spans.get(begin)
                if end is not None:
                    at = end
                elif tag == "svg":
                    drawing = not m["attrs"].endswith("/")
                continue
            if drawing:  # in an svg that nothing closed
                if tag in CLOSES_P:
                    drawing = False
                elif m["attrs"].endswith("/") and tag not in INLINE:
                    continue
            if tag in RAW:
                lowered = lowered or source.lower()
                close = lowered.find(f"</{tag}", at)
                if len(lowered) != n:  # a letter whose lower case is longer: search as it is
                    found = re.compile(f"</{tag}", re.I).search(source, at)
                    close = found.start() if found else -1
                end = source.find(">", close) if close >= 0 else -1
                at = n if end < 0 else end + 1
                stretch += 1
                continue
            if tag in INLINE:
                if tag == "br":
                    self.runs.append((stack[-1][1], stretch, " ", False))
                elif tag not in VOID and not m["attrs"].endswith("/"):
                    stack.append((tag, stack[-1][1]))
                    links += tag == "a"
                continue
            stretch += 1
            self._imply(stack, tag)
            links = sum(t == "a" for t, _ in stack)
            block = len(self.tag)
            self.parent.append(stack[-1][1])
            self.tag.append(tag)
            attrs = m["attrs"]
            self.attrs.append(attrs)
            self.tokens.append(_tokens(attrs) if "=" in attrs else 0)
            if tag not in VOID:
                stack.append((tag, block))

    @staticmethod
    def _imply(stack: list[tuple[str, int]], tag: str) -> None:
        """End the elements that the start of a block implies the end of."""

        def end(tags: frozenset[str], within: frozenset[str]) -> None:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in tags:
                    del stack[i:]
                    return
                if stack[i][0] in within:
                    return

        if tag in CLOSES_P:
            end(frozenset("p"), frozenset(("td", "th", "div", "article", "section", "body", "li", "blockquote", "table", "button")))
        if tag == "li":
            end(frozenset(("li",)), frozenset(("ul", "ol", "menu")))
        elif tag in ("dt", "dd"):
            end(frozenset(("dt", "dd")), frozenset(("dl",)))
        elif tag in ("td", "th"):
            end(frozenset(("td", "th")), frozenset(("tr", "table")))
        elif tag == "tr":
            end(frozenset(("tr",)), frozenset(("table", "tbody", "thead", "tfoot")))
        elif tag == "body":
            end(frozenset(("head",)), frozenset())


def _tokens(attrs: str) -> int:
    """Bits of the token groups that occur in class, id and role."""
    out = 0
    for name, value in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
            for token in _SPLIT.findall(value):
                if (g := TOKEN_GROUP.get(token.lower())) is not None:
                    out |= 1 << g
    return out


def _spans(source: str) -> dict[int, int]:
    """Where the closed svg, select, noscript, object and template elements begin and end; each end tag belongs to the last open one. An svg
    is not closed if an element stands in it that ends it."""
    out: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    held = 0
    for m in _SPANS.finditer(source):
        if m["leaves"]:
            if not held and not m["end"]:
                opened.pop("svg", None)
        elif m["held"]:
            held = max(0, held - 1) if m["end"] else held + (not m["attrs"].endswith("/"))
        elif m["tag"]:
            tag = m["tag"].lower()
            if not m["end"]:
                if tag != "svg" or not m["attrs"].endswith("/"):
                    opened.setdefault(tag, []).append(m.start())
            elif opened.get(tag):
                out[opened[tag].pop()] = m.end()
                if tag == "svg" and not opened[tag]:
                    held = 0
    return out


FEATURES = 2 * N_TAGS + 2 * N_TOKENS + 13


def features(pages: list[Page]) -> np.ndarray:
    """One row for each block of the pages, one page after the other."""
    columns: list[list] = [[] for _ in range(13)]
    for page in pages:
        n, up = len(page.tag), page.parent
        own, link = [0] * n, [0] * n
        for block, _, text, linked in page.runs:
            if text and not text.isspace():
                own[block] += len(text)
                if linked:
                    link[block] += len(text)
        total, links, blocks = own[:], link[:], [1] * n
        inner = [int(t == "p") for t in page.tag]
        for i in range(n - 1, 0, -1):
            p = up[i]
            total[p] += total[i]
            links[p] += links[i]
            blocks[p] += blocks[i]
            inner[p] += inner[i]
        group = [TAG_GROUP.get(t, N_TAGS - 1) for t in page.tag]
        depth, before, width, above, tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        tokens = page.tokens
        for i in range(1, n):
            p = up[i]
            depth[i] = depth[p] + 1
            above[i] = above[p] | tokens[p]
            tags[i] = tags[p] | 1 << group[p]
            before[i] = width[p]
            width[p] += 1
        over = [max(p, 0) for p in up]
        for column, values in zip(columns, (group, tokens, above, tags, depth, own, total, links, blocks, inner, before, [width[p] for p in over], [total[p] for p in over]), strict=True):
            column += values
    group, tokens, above, tags, depth, own, total, links, blocks, inner, before, siblings, around = (np.array(c) for c in columns)
    x = np.zeros((len(group), FEATURES), dtype=np.float32)
    x[np.arange(len(group)), group] = 1
    for g in range(N_TAGS):
        x[:, N_TAGS + g] = tags >> g & 1
    c = 2 * N_TAGS
    for g in range(N_TOKENS):
        x[:, c + g] = tokens >> g & 1
        x[:, c + N_TOKENS + g] = above >> g & 1
    c += 2 * N_TOKENS
    page_total = np.repeat([max(1, int(t)) for t in total[depth == 0]], [len(p.tag) for p in pages])
    values = (depth, np.log1p(own), np.log1p(total), links / np.maximum(total, 1), np.log1p(blocks), total / blocks, inner, inner / blocks, before, siblings, siblings - before, total / np.maximum(around, 1), total / page_total)
    for k, v in enumerate(values):
        x[:, c + k] = v
    return x


# ---- boosted trees


class Boosted:
    """Logistic gradient boosting with histogram trees of a fixed depth."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 16):
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        n, f = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # x > edge[k] means bin > k
        code, usable = binned + np.arange(f) * self.bins, np.arange(self.bins) < np.array([len(e) for e in edges])[:, None]
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        score = np.full(n, self.base)
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature, self.cut, self.leaf = np.zeros((self.trees, inner), dtype=np.int64), np.full((self.trees, inner), np.inf, dtype=np.float32), np.zeros((self.trees, leaves))
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            grad, hess, node = y - p, p * (1 - p), np.zeros(n, dtype=np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (f * self.bins) + code).ravel()
                g, h = (np.bincount(at, np.repeat(w, f), count * f * self.bins).reshape(count, f, self.bins).cumsum(2) for w in (grad, hess))
                gt, ht = g[:, :, -1:], h[:, :, -1:]
                gain = g**2 / (h + 1) + (gt - g) ** 2 / (ht - h + 1) - gt**2 / (ht + 1)
                gain[(h < 0.5) | (ht - h < 0.5) | ~usable] = 0
                flat = gain.reshape(count, -1)
                choice = [(k // self.bins, k % self.bins) if flat[q, k] > 1e-3 else (0, -1) for q, k in enumerate(flat.argmax(1).tolist())]
                right = np.zeros(n, dtype=bool)
                for q, (j, k) in enumerate(choice):
                    if k >= 0:
                        self.feature[t, first + q], self.cut[t, first + q] = j, edges[j][k]
                        mine = node == first + q
                        right[mine] = binned[mine, j] > k
                node = 2 * node + 1 + right
            leaf = node - inner
            g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
            self.leaf[t] = self.rate * g / (h + 1)
            score += self.leaf[t][leaf]
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.cut[t][node])
            out += self.leaf[t][node - inner]
        return out


def decoded(parent: list[int], log_odds: list[float]) -> list[bool]:
    """From the root down: the odds are those of a block whose parent is kept; below a dropped block all is dropped."""
    kept = [log_odds[0] > 0]
    for i in range(1, len(parent)):
        kept.append(kept[parent[i]] and log_odds[i] > 0)
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    out: list[str] = []
    held: list[str] = []
    now = None
    for block, stretch, raw, _ in page.runs:
        if not kept[block]:
            continue
        if (block, stretch) != now:
            if held and (text := " ".join(html.unescape("".join(held)).split())):
                out.append(text)
            held, now = [], (block, stretch)
        held.append(raw)
    if held and (text := " ".join(html.unescape("".join(held)).split())):
        out.append(text)
    return "\n".join(out)


# ---- generated, labelled pages


def labelled_page(rng: np.random.Generator) -> str:
    """A page of one of many layouts; blocks that hold or lead to main text carry data-keep."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    syllables = ("th", "on", "er", "ti", "ing", "ea", "ver", "li", "men", "ci", "do", "qu", "st", "re", "en", "un", "eau", "mo", "ar", "le")
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        return " ".join(word() + ("," if chance(0.08) else "") for _ in range(int(rng.integers(lo, hi)))).capitalize() + "."

    def prose(lo: int, hi: int) -> str:
        return " ".join(sentence() for _ in range(int(rng.integers(lo, hi))))

    K = ' data-keep="1"'
    named = lambda *names: pick(f' class="{pick(*names)}"', f' id="{pick(*names)}"', f' class="{pick("box", "row", "col-3", "c1")} {pick(*names)}"')
    links = lambda lo, hi: "<ul>" + "".join(f'<li><a href="/{word()}">{word()} {word() if chance(0.3) else ""}</a></li>' for _ in range(int(rng.integers(lo, hi)))) + "</ul>"

    def menu() -> str:
        body = links(3, 12) if chance(0.7) else " | ".join(f'<a href="/{word()}">{word()}</a>' for _ in range(int(rng.integers(3, 9))))
        return pick(f"<nav>{body}</nav>", f"<nav{named('nav', 'menu')}>{body}</nav>", f"<div{named('menu', 'navbar', 'navigation', 'breadcrumb')}>{body}</div>", f"<ul{named('menu', 'nav')}>{''.join(f'<li><a href=/x>{word()}</a>' for _ in range(5))}</ul>")

    def header() -> str:
        body = f"<h1>{word()} {word()}</h1>" if chance(0.4) else f"<p>{sentence(2, 6)}</p>"
        return pick(f"<header>{body}{menu() if chance(0.4) else ''}</header>", f"<div{named('header', 'masthead', 'topbar')}>{body}</div>")

    def footer() -> str:
        body = pick(f"&copy; {word()}.example &middot; {prose(1, 4)}", f"<p>&copy; 2020 {word()}</p>{links(2, 6)}", f"<p>{prose(1, 3)}</p>")
        return pick(f"<footer>{body}</footer>", f"<div{named('footer', 'copyright', 'legal')}>{body}</div>", f"<footer{named('footer')}>{body}</footer>")

    def advert() -> str:
        body = pick(prose(1, 3), f"<p>{prose(1, 2)}</p>", f'<a href="/x">{sentence()}</a>')
        return pick(f'<div class="ad">{body}</div>', f"<div{named('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo', 'adsbygoogle')}>{body}</div>", f"<aside{named('ad', 'sponsored')}>{body}</aside>")

    def sidebar() -> str:
        body = f"<h3>{word()}</h3>{links(3, 8)}" if chance(0.6) else f"<h3>{word()}</h3><p>{prose(1, 3)}</p>"
        return pick(f"<aside>{body}</aside>", f"<aside{named('sidebar')}>{body}</aside>", f"<div{named('sidebar', 'related', 'widget', 'rail', 'trending')}>{body}</div>")

    def notice() -> str:
        body = f"<p>{prose(1, 3)}</p><button>{word()}</button>" if chance(0.5) else prose(1, 2)
        return f"<{(t := pick('div', 'div', 'section', 'dialog'))}{named('cookie-banner', 'consent', 'notice', 'popup', 'newsletter', 'alert')}>{body}</{t}>"

    def form() -> str:
        return f"<form{pick('', named('search', 'login', 'contact'))}><label>{word()}</label><input name=q><p>{sentence()}</p><button>{word()}</button></form>"

    def comments() -> str:
        one = lambda: pick(f"<div{named('comment')}><p>{word()}</p><p>{prose(1, 5)}</p></div>", f"<li{named('comment')}>{prose(1, 4)}</li>", f"<article{named('comment')}><p>{prose(1, 4)}</p></article>")
        body = f"<h2>{word()}</h2>" + "".join(one() for _ in range(int(rng.integers(1, 7))))
        return pick(f"<section{named('comments', 'discussion')}>{body}</section>", f"<div{named('comments', 'commentlist', 'disqus')}>{body}</div>")

    def block() -> str:
        r = rng.random()
        if r < 0.72:
            inline = pick("", "", "<b>", "<i>", '<a href="/y">')
            close = {"<b>": pick("</b>", "<br>"), "<i>": "</i>", '<a href="/y">': "</a>", "": ""}[inline]
            return f"<p{K}>{inline}{sentence()}{close} {prose(0, 7)}{pick('</p>', '</p>', '</p>', '')}"
        if r < 0.8:
            return f"<h{(h := int(rng.integers(2, 4)))}{K}>{sentence(2, 6)}</h{h}>"
        if r < 0.88:
            return f"<ul{K}>" + "".join(f"<li{K}>{sentence()}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if r < 0.92:
            return f"<blockquote{K}><p{K}>{prose(1, 3)}</p></blockquote>"
        if r < 0.95:
            return f"<pre{K}>{prose(1, 3)}</pre>"
        if r < 0.97:
            return f"<table{K}><tr{K}><td{K}>{word()}</td><td{K}>{sentence()}</td></tr><tr{K}><td{K}>{word()}</td><td{K}>{sentence()}</td></tr></table>"
        return f"<figure{K}><img src=x><figcaption{K}>{sentence()}</figcaption></figure>"

    def article() -> str:
        parts = [f"<h1{K}>{sentence(1, 10)}</h1>"] if chance(0.8) else []
        for _ in range(int(rng.integers(1, 14)) if chance(0.85) else int(rng.integers(14, 60))):
            parts.append(block())
            if chance(0.04):
                parts.append(pick(advert, sidebar, notice, form)())
        if chance(0.1):
            parts = [f"<div{K}{pick('', named('text', 'section', 'body'))}>", *parts, "</div>"]
        if chance(0.05):
            parts = [f"<h1{K}>{sentence(1, 4)}</h1>", f"<p{K}>{sentence(1, 4)}</p>"][int(rng.integers(2)) :]
        body = "".join(parts) if chance(0.95) else f"{prose(1, 4)}<br><br>{prose(1, 4)}"
        tag, names = pick(("article", None), ("article", None), ("article", ("post", "entry")), ("main", None), ("div", ("content", "post-content", "article-body", "entry-content", "main", "story")), ("section", ("content", "article")), ("div", None))
        return f"<{tag}{K}{'' if names is None else named(*names)}>{body}{comments() if chance(0.1) else ''}</{tag}>"

    if chance(0.04):
        return pick("", "<body data-keep=1>") + "".join(block() for _ in range(int(rng.integers(1, 9))))
    before = [f() for f, p in ((header, 0.4), (menu, 0.8), (notice, 0.25), (advert, 0.5), (form, 0.15), (sidebar, 0.15)) if chance(p)]
    after = [f() for f, p in ((sidebar, 0.3), (comments, 0.4), (advert, 0.25), (notice, 0.15), (form, 0.15), (footer, 0.85)) if chance(p)]
    main = article()
    if chance(0.3):
        inner_before, inner_after = [], []
        while before and chance(0.3):
            inner_before.insert(0, before.pop())
        while after and chance(0.3):
            inner_after.append(after.pop(0))
        main = f"<{(t := pick('main', 'div', 'div'))}{K}{pick('', named('main', 'container', 'page', 'wrapper'))}>{''.join(inner_before)}{main}{''.join(inner_after)}</{t}>"
    end = pick("</body></html>", "</body></html>", "")
    return f"<!DOCTYPE html><html{K}><head><title>{sentence()}</title><style>p{{}}</style></head><body{K}>{''.join(before)}{main}{''.join(after)}{end}"


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = 3) -> Boosted:
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(labelled_page(rng))
        keep = np.array(["data-keep" in a for a in page.attrs])
        keep[0] = True
        rows = np.flatnonzero(keep[np.maximum(page.parent, 0)])  # blocks whose parent is kept
        xs.append(features([page])[rows])
        ys.append(keep[rows].astype(float))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys))


def extract(source: str, model: Boosted) -> str:
    return extract_all([source], model)[0]


def extract_all(sources: list[str], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    odds = model.log_odds(features(pages)).tolist()
    ends = np.cumsum([len(p.tag) for p in pages]).tolist()
    return [text_of(p, decoded(p.parent, odds[e - len(p.tag) : e])) for p, e in zip(pages, ends, strict=True)]


def _extract(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = extract_all([x.as_buffer().to_pybytes().decode(errors="replace") if x.is_valid else "" for x in part.column("html")], shared.value)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text)."""
    pages = pages.select("page_id", "url", "html")
    shared = pages.sparkSession.sparkContext.broadcast(trained())
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType())])
    return pages.mapInArrow(lean(_extract(shared)), schema)


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
