"""Main text of web pages by a tree-structured graphical model.

A page's block elements and its blocks of text are the nodes of a tree; each is content or
not. A node's potential comes from its tag, words in its class, id and role, its length and
its share of link text; a parent-child potential says how labels agree along an edge.
Messages passed up and down the tree (sum-product, exact on trees) give each node's
marginal; text whose marginal favours content is kept, in page order. The weights are
trained by gradient ascent on the likelihood of labelled pages, with the same messages;
the labelled pages are laid out by this module in many styles.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_in_arrow
from . import common

#: Elements whose content is no markup, up to their end tag or the page's end.
_RAW = "script|style|textarea|title|iframe|xmp|noembed|noframes"
#: Elements whose content isn't shown as text.
_HIDDEN = frozenset("noscript template select button object canvas video audio map math svg datalist".split())
# A value may hold any quotes but its own; a quote that is never closed belongs to an unquoted value.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
_TOKEN = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)|<({_RAW})(?=[\s/>]){_ATTRIBUTES}(?:>|\Z).*?(?:</\1(?=[\s/>]){_ATTRIBUTES}(?:>|\Z)|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|[^<]+|<""", re.S | re.I)
_BLOCK = frozenset("html body head main article section aside nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary hr center dialog menu hgroup search".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table", "tbody", "thead", "tfoot")), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "body": ("head", ()), "tbody": ("thead tbody tr td th", ("table",))}
_WORD = re.compile(r"[a-z]+")
_NAMED = re.compile(r"""(?<![^\s/"'])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_KEYS = {
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp".split(),
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toolbar tabs pagination pager".split(),
    "foot": "footer foot copyright legal colophon contentinfo".split(),
    "head": "header head".split(),
    "site": "masthead topbar logo branding site".split(),
    "side": "sidebar side aside widget widgets related recommended recirc trending popular complementary".split(),
    "by": "byline author meta date dateline published timestamp".split(),
    "note": "notice notices cookie cookies consent gdpr alert popup modal overlay banner newsletter subscribe signup paywall".split(),
    "talk": "comment comments commentlist disqus reply replies respond discussion reader feedback".split(),
    "form": "form login search searchbox".split(),
    "social": "share social sharing follow twitter facebook".split(),
    "main": "content article main post entry story body text page hentry prose document".split(),
}
#: Kinds of elements that hold others, for the potentials of edges.
_HOLDS = {t: k for k, tags in {"b": "#root html body", "a": "article main", "d": "div section center", "l": "ul ol li dl dd dt table tbody tr td th", "h": "header", "f": "footer nav aside form"}.items() for t in tags.split()}
_KEY = {w: k for k, words in _KEYS.items() for w in words}


class Page:
    """A page's tree: tag, parent, features of each node; blocks: (node, text)."""

    def __init__(self, source: str):
        self.parent, self.tags, self.named = [-1], ["#root"], [()]
        self.blocks: list[tuple[int, str]] = []
        self.shares: list[tuple[int, int]] = []  # of each block: characters, those in links
        stack, parts, linked, in_link = [0], [], 0, False
        length, hidden = 0, []  # (element that hides its content, depth there)

        def flush():
            nonlocal length, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self._node("#text", stack[-1], ())
                    self.blocks.append((len(self.tags) - 1, text))
                    self.shares.append((length, linked))
                parts.clear()
            length = linked = 0

        for m in _TOKEN.finditer(source):
            s = m[0]
            if s[0] != "<" or s == "<":
                if hidden:
                    continue
                text = html.unescape(s) if "&" in s else s
                parts.append(text)
                n = len(text.strip())
                length += n
                linked += n * in_link
                continue
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in _HIDDEN:
                if not m[2]:
                    hidden.append((tag, len(stack)))
                elif any(t == tag for t, _ in hidden):
                    while hidden.pop()[0] != tag:
                        pass
            elif m[2]:
                if tag == "a":
                    in_link = False
                elif tag in _BLOCK:
                    flush()
                    in_link = False
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[i]] == tag:
                            del stack[i:]
                            break
                    while hidden and len(stack) < hidden[-1][1]:
                        hidden.pop()  # it was never closed
            elif tag == "a":
                in_link = True
            elif tag == "br" or tag == "hr":
                flush()
            elif tag in _BLOCK:
                flush()
                in_link = False
                self._close(stack, tag)
                self._node(tag, stack[-1], self._names(m[4]))
                stack.append(len(self.tags) - 1)
        flush()

    def _node(self, tag, parent, names):
        self.tags.append(tag)
        self.parent.append(parent)
        self.named.append(names)

    def _close(self, stack, tag):
        """End what the start of this element ends."""
        if self.tags[stack[-1]] == "p":
            stack.pop()
        ends, until = _CLOSES.get(tag, ("", ()))
        if ends:
            ends = ends.split()
            for i in range(len(stack) - 1, 0, -1):
                t = self.tags[stack[i]]
                if t in until:
                    break
                if t in ends:
                    del stack[i:]
                    if tag not in ("tr", "tbody"):
                        break

    @staticmethod
    def _names(attributes: str):
        if "=" not in attributes:
            return ()
        found = set()
        for m in _NAMED.finditer(attributes):
            for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower()):
                if w in _KEY:
                    found.add("k:" + _KEY[w])
        return tuple(sorted(found))

    def edges(self) -> list[str]:
        """The kind of each node's edge with its parent: by the parent's tag, and whether the node is text."""
        return [f"{_HOLDS.get(self.tags[p], 'o') if i else '-'}:{'x' if self.tags[i] == '#text' else 'e'}" for i, p in enumerate(self.parent)]

    def features(self) -> list[list[str]]:
        """Of each node."""
        size, links, units = [0] * len(self.tags), [0] * len(self.tags), [0] * len(self.tags)
        for (i, _), (n, m) in zip(self.blocks, self.shares, strict=True):
            size[i], links[i], units[i] = n, m, 1
        for i in range(len(self.tags) - 1, 0, -1):
            p = self.parent[i]
            size[p] += size[i]
            links[p] += links[i]
            units[p] += units[i]
        out = []
        for i, tag in enumerate(self.tags):
            kind = "x" if tag == "#text" else "e"
            dense = "0" if not links[i] else "1" if links[i] * 3 < size[i] else "2" if links[i] * 3 < 2 * size[i] else "3"
            long_ = min(6, max(2, (size[i] // max(1, units[i])).bit_length() // 2)) if size[i] else -1  # up to 15 characters are alike
            out.append([f"t:{tag}", f"c:{_HOLDS.get(self.tags[self.parent[i]], 'o') if i else '-'}:{tag}", f"d:{kind}{dense}", f"l:{kind}{long_}", *self.named[i], *(f"{k}:{tag}" for k in self.named[i])])
        return out


def _log_sum(a: float, b: float) -> float:
    m = a if a > b else b
    return m + math.log1p(math.exp(-abs(a - b)))


#: Edge weights, by parent's and child's labels: e0 both no, e1 only the child, e2 only the parent, e3 both.
def marginals(parent: list[int], own: list[float], edge: list[tuple[float, float, float, float]]):
    """Log-odds of content of each node; parents come before children. edge[i]: of node i with its parent.

    Also what each node passes up, and what comes down to it, for the edges' marginals.
    """
    n = len(parent)
    inner = own[:]
    up = [0.0] * n
    for i in range(n - 1, 0, -1):
        e0, e1, e2, e3 = edge[i]
        up[i] = _log_sum(e2, e3 + inner[i]) - _log_sum(e0, e1 + inner[i])
        inner[parent[i]] += up[i]
    total = inner[:]
    outer = [0.0] * n
    for i in range(1, n):
        e0, e1, e2, e3 = edge[i]
        outer[i] = total[parent[i]] - up[i]
        total[i] = inner[i] + _log_sum(e1, e3 + outer[i]) - _log_sum(e0, e2 + outer[i])
    return total, inner, outer


class Model:
    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def potentials(self, page: Page, features=None):
        w = self.weights
        own = [sum(w.get(f, 0.0) for f in fs) for fs in features or page.features()]
        known: dict[str, tuple] = {}
        edges = []
        for k in page.edges():
            if k not in known:
                known[k] = tuple(w.get(f"{k}{j}", 0.0) for j in range(4))
            edges.append(known[k])
        return own, edges

    def text(self, source: str) -> str:
        """A page's content: its blocks joined by line feeds."""
        page = Page(source)
        if not page.blocks:
            return ""
        odds, _, _ = marginals(page.parent, *self.potentials(page))
        return "\n".join(t for i, t in page.blocks if odds[i] > 0)


_TEXT = """time year people way day man thing woman life child world school state family student group country problem hand
part place case week company system program question work government number night point home water room mother area money
story fact month lot right study book eye job word business issue side kind head house service friend father power hour
a y i ä ó à 7 12 2024 game line end member law car city community name president team minute idea kid body information back parent face""".split()


def labelled(number: int = 260) -> list[tuple[str, list[bool]]]:
    """Pages and, for each of their nodes but the root, whether it is content.

    In the source, content elements carry an attribute that only this function reads.
    """
    rng = random.Random(23)
    words = lambda a, b: " ".join(rng.choice(_TEXT) for _ in range(rng.randint(a, b)))
    sentence = lambda a=1, b=18: words(a, b).capitalize() + rng.choice([".", ".", "?", ""])
    links = lambda n, tag="li": "".join(f'<{tag}><a href="/{rng.choice(_TEXT)}">{words(1, 3)}</a></{tag}>' for _ in range(n))
    pick = rng.choice
    out = []
    for _ in range(number):
        some = rng.randint(1, 8)
        menu = pick([f"<nav><ul>{links(some)}</ul></nav>", f'<div class="menu"><ul>{links(some)}</ul></div>', f'<ul id="navigation">{links(some)}</ul>', f"<nav>{links(some, 'span')}</nav>", f'<div id="breadcrumb">{links(some, "span")}</div>'])
        head = pick(["", f"<header><p>{words(1, 4)}</p>{menu}</header>", f'<div id="masthead"><h1>{words(1, 3)}</h1><p>{sentence(3, 8)}</p></div>', f"<header><div>{words(2, 5)}</div></header>"])
        ad = lambda: pick([f'<div class="{pick(["ad", "ads banner", "sponsored", "promo"])}">{sentence(1, 20)}</div>', f'<aside class="advert"><p>{sentence(1, 16)}</p></aside>', ""])  # noqa: E731,B023
        note = lambda: pick(["", f'<div class="cookie-notice"><p>{sentence(1, 20)}</p></div>', f'<div id="newsletter"><p>{sentence(1, 15)}</p></div>', f'<p class="notice">{sentence(1, 12)}</p>'])
        side = pick(["", f"<aside><h3>{words(1, 3)}</h3><ul>{links(4)}</ul></aside>", f'<div class="sidebar"><p>{sentence(5, 25)}</p><ul>{links(3)}</ul></div>', f'<aside class="related"><p>{sentence(3, 20)}</p></aside>'])
        foot = pick([f"<footer>&copy; {words(1, 3)} &middot; {sentence(1, 25)}</footer>", f'<div id="footer"><p>{sentence(1, 20)}</p></div>', f"<footer><p>{sentence(1, 10)}</p><ul>{links(3)}</ul></footer>", ""])
        form = pick(["", f"<form><p>{words(2, 5)}</p><input></form>", f'<form class="search"><label>{words(1, 2)}</label></form>', f"<form><fieldset><legend>{words(1, 3)}</legend><div>{sentence(2, 8)}</div></fieldset></form>"])
        said = "".join(f'<{t} class="comment"><p>{sentence(1, 40)}</p></{t}>' for t in [pick(["div", "li"])] * rng.randint(1, 4))
        talk = pick(["", "", f'<section class="comments"><h3>{words(1, 2)}</h3>{said}</section>', f'<div id="comments">{said}</div>', f'<ol class="commentlist">{said}</ol>', f'<section id="discussion"><p>{sentence(3, 30)}</p></section>'])
        title = pick(["h1", "h1", "h2"])
        body = f"<{title} c>{words(1, 9)}</{title}>"
        for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 14])):
            if rng.random() < 0.12:
                body += pick([ad(), ad(), note(), f'<div class="share">{links(3, "span")}</div>', f'<div class="related"><p>{sentence(2, 12)}</p></div>'])
            body += pick([
                f"<p c>{' '.join(sentence() for _ in range(rng.randint(1, 9)))}</p>", f"<p c>{sentence(1, 2)}</p>", f"<p c><b>{sentence()}<br>{sentence()}", f"<p c>{sentence()}</p>", f"<p c>{words(1, 1)}</p>",
                f'<p c>{sentence()} <a href="/x">{words(1, 3)}</a> {sentence()}</p>', f'<p c>{words(1, 4)} <a href="/x">{words(1, 4)}</a> {words(1, 6)}</p>', f'<p c><a href="/x">{words(1, 5)}</a> {words(1, 4)}</p>', f'<ul c><li c>{words(1, 3)} <a href="/x">{words(1, 3)}</a></li><li c>{words(2, 6)}</li></ul>', f"<div c>{sentence(2, 20)}</div>", f"{sentence(3, 20)}<br>{sentence(3, 20)}<br>", f"<h2 c>{words(1, 6)}</h2>", f"<ul c><li c>{sentence(1, 9)}</li><li c>{sentence(2, 14)}</li></ul>", f"<blockquote c><p c>{sentence(3, 20)}</p></blockquote>",
                f"<pre c>{words(2, 20)}</pre>", f"<table c><tr c><td c>{words(1, 2)}</td><td c>{words(1, 3)}</td></tr></table>", f"<p c>{sentence()} {sentence()}</p>", f"<figure c><figcaption c>{sentence(2, 8)}</figcaption></figure>",
            ])
        inside = pick(["", "", ad(), ad(), talk, talk, f'<div class="share">{links(3, "span")}</div>', note()])
        holder = pick(["article", "article", "main", 'div class="content"', 'div id="main-content"', 'div class="post-body"', 'section class="story"', "div", "div", ""])
        if holder and rng.random() < 0.25:  # an article's own head: its title stays, who wrote it and when don't
            line = f'<{pick(["p", "div"])} class="{pick(["byline", "meta", "author", "date"])}">{words(2, 5)}</{pick(["p", "div"])}>'
            at = pick(["header", 'div class="article-header"', 'div class="entry-header"'])
            body = f"<{at}><{title} c>{words(1, 9)}</{title}>{line}</{at.split()[0]}>{body}"
        # Without a holder the blocks stand right in the body.
        main = f"<{holder} c>{body}{inside}</{holder.split()[0]}>" if holder else body
        if rng.random() < 0.3:
            main = f"<main>{main}{talk}</main>" if holder != "main" else f"<div>{main}{talk}</div>"
        around = (pick([head + menu, menu, head]), note(), ad(), main, side, form, talk, ad(), foot) if rng.random() < 0.85 else ("", "", "", main, "", "", "", "", "")
        page = "".join(around)
        # Text right in the body is content where the body holds the article's blocks.
        own = "" if holder else " c"
        out.append(pick([f"<html><body{own}>{page}</body></html>", f"<html><body{own}>{page}</body></html>", f'<html><body><div id="wrapper"{own}>{page}</div></body></html>', f"<body{own}>{page}"]))
    pages = []
    for source in out:
        page = _Marked(source)
        pages.append((page, page.marks))
    return pages


class _Marked(Page):
    """A labelled page: elements with the attribute ``c``, and text right in them, are content; so is whatever holds content.

    Below an element that isn't content nothing is, then, which is what messages pass down.
    """

    def __init__(self, source: str):
        self.marks = [False]
        super().__init__(source)
        for i in range(len(self.marks) - 1, 0, -1):
            if self.marks[i]:
                self.marks[self.parent[i]] = True

    def _node(self, tag, parent, names):
        super()._node(tag, parent, [n for n in names if n != "c"])
        self.marks.append("c" in names if tag != "#text" else self.marks[parent])

    @staticmethod
    def _names(attributes: str):
        return (*Page._names(attributes), *(["c"] if re.search(r"\sc$", attributes) else []))


@functools.cache
def trained(rounds: int = 100, rate: float = 40.0, decay: float = 2e-5) -> Model:
    """Weights of the labelled pages' features and edges."""
    data = [(p, p.features(), marks) for p, marks in labelled()]
    model = Model({})
    w = model.weights
    total = sum(len(m) for _, _, m in data)
    sums: dict[str, float] = {}
    for _ in range(rounds):
        grad: dict[str, float] = {}
        for page, features, marks in data:
            own, edge = model.potentials(page, features)
            kinds = page.edges()
            odds, inner, outer = marginals(page.parent, own, edge)
            for i, fs in enumerate(features):
                d = marks[i] - 1 / (1 + math.exp(-max(-500, min(500, odds[i]))))
                for f in fs:
                    grad[f] = grad.get(f, 0.0) + d
                if i:
                    k, e = kinds[i], edge[i]
                    logs = [e[0], e[1] + inner[i], e[2] + outer[i], e[3] + inner[i] + outer[i]]
                    top = max(logs)
                    z = sum(math.exp(x - top) for x in logs)
                    truth = 2 * marks[page.parent[i]] + marks[i]
                    for j in range(4):
                        grad[f"{k}{j}"] = grad.get(f"{k}{j}", 0.0) + (j == truth) - math.exp(logs[j] - top) / z
        for f, g in grad.items():
            g = g / total - decay * w.get(f, 0.0) / 10
            sums[f] = sums.get(f, 1e-8) + g * g
            w[f] = w.get(f, 0.0) + rate * 0.2 * g / math.sqrt(sums[f])
    return model


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    text: the main text, empty where there is none or html is null. White space within a
    block is one space; blocks are joined by one line feed, in page order. Nothing else is
    dropped or cut. Repeated rows and null ids come back as they are; other columns are
    left alone.
    """
    model = model or trained()

    def run(batches):
        for batch in batches:
            texts = [model.text(x) if x else "" for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return map_in_arrow(pages.select("page_id", "url", F.col("html").cast("string")), run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all pages."""
    return extract(common.table(spark, sf_dir, "pages"))
