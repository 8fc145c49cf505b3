import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from tamarack.llm import htmltext

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<!-- <p>never</p> --><article><h1>A title&nbsp;here</h1><p>First   paragraph with a <a href="/x">link</a> and &eacute;&#33; more
text.<p>Yes.</p><ul><li>one item<li>two items</ul><blockquote><p>A quoted sentence stands here.</p></blockquote><div class="ad">Buy this now.</div></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked what this article had to say about it.</p></div></section>
<aside class="related"><p>Read another story about this.</p></aside><form><p>Your name</p><button>Send</button></form><footer>&copy; me &middot; all of it</footer></body></html>"""


def test_only_the_article_stays():
    assert htmltext.trained().text(PAGE) == "A title here\nFirst paragraph with a link and é! more text.\nYes.\none item\ntwo items\nA quoted sentence stands here."


#: Pages written by hand, in layouts that the labelled pages don't have; (source, main text).
BY_HAND = [
    ('<html><body><p>The first paragraph of this page is here.</p><p>The second one, right in the body.</p></body></html>', "The first paragraph of this page is here.\nThe second one, right in the body."),
    ("<p title=it's>Second paragraph is here, and it goes on for a while.", "Second paragraph is here, and it goes on for a while."),
    ('<article><p>One <a title="5" wide" href=x>link here</a> and some more words.</p><p>Next &lt;one&gt;.</p></article>', "One link here and some more words.\nNext <one>."),
    ('<article><p>Some words <b class="x>before the end</b> of it.</p></article>', "Some words before the end of it."),
    ('<article><p>Sizes: 3 < 5 and 7 > 2.</p><p>All of it.</p></article><footer>Imprint', "Sizes: 3 < 5 and 7 > 2.\nAll of it."),
    (
        """<!doctype html><html><head><title>A post</title><link rel=stylesheet href=s.css></head><body class="home blog"><div id="page"><div id="masthead" class="site-header"><h1><a href="/">My log</a></h1></div>
<ul class="nav-menu"><li><a href="/">Home</a><li><a href="/about">About me</a></ul><div id="content"><div class="post"><h2>Bread at last</h2><div class="entry"><p>It took three days &mdash; and much flour.</p><ol><li>Mix it<li>Wait for it</ol>
<p>Then bake.</p></div></div><div id="comments"><h3>2 thoughts</h3><ol class="commentlist"><li><p>Nice bread you have there, I must say.</p></li><li><p>Thanks for this.</p></li></ol></div></div>
<div id="sidebar" class="widget-area"><h3>Archive</h3><ul><li><a href="/1">May</a></li></ul></div><div id="footer"><p>Powered by something.</p></div></div></body></html>""",
        "Bread at last\nIt took three days — and much flour.\nMix it\nWait for it\nThen bake.",
    ),
    (
        """<body><div class="topbar"><div class="logo">The Daily</div></div><nav class="breadcrumbs"><a href=/>News</a> <a href=/c>City</a></nav><main><section class="story"><h1>Bridge opens</h1><p>The bridge was opened on Monday after years of work.</p>
<aside class="related"><h4>Read also</h4><ul><li><a href=/2>Old bridge closes</a></ul></aside><p>It is 300 m long.</p><blockquote>A good day, said the mayor.</blockquote></section></main><div class="newsletter-signup"><p>Get our letter every morning.</p><form><input><button>Join</button></form></div>
<div class="cookie-banner"><p>This site uses cookies.</p></div><footer><p>All rights reserved</p></footer></body>""",
        "Bridge opens\nThe bridge was opened on Monday after years of work.\nIt is 300 m long.\nA good day, said the mayor.",
    ),
    (
        """<html><body><header><nav><ul><li><a href="/docs">Docs</a></li><li><a href="/api">API</a></li></ul></nav></header><div class="sidebar"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div>
<div class="document"><h1>Install</h1><p>Run the command below.</p><pre>make
  install</pre><table><tr><td>Flag</td><td>Meaning</td></tr></table></div></body></html>""",
        "Install\nRun the command below.\nmake install\nFlag\nMeaning",
    ),
]


@pytest.mark.parametrize("n", range(len(BY_HAND)))
def test_pages_written_by_hand(n):
    source, text = BY_HAND[n]
    assert htmltext.trained().text(source) == text


def test_blocks_are_those_of_another_parser():
    """Random well-formed trees, read by the standard library's parser."""
    rng = random.Random(9)

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4 or depth == 0:
                out.append(rng.choice(["some words", " a &amp; b ", "x", "&eacute;t&#233; ", "1 &lt; 2 ", "\n \t"]))
            elif kind < 0.6:
                out.append(f'<b class="y>z" data-x=\'"\'>{rng.choice(["bold", "it is"])}</b>')
            elif kind < 0.7:
                out.append(rng.choice(['<script>var a = "</p><div>";</script>', "<!-- <p>no</p> -->", "<style>p > b {}</style>", "<br>", "<svg><title>t</title><g>u</g></svg>", "<button>Go <i>on</i></button>"]))
            else:
                tag = rng.choice(["div", "section", "ul", "blockquote", "article"])
                out.append(f'<{tag} id="{rng.choice("abc")}">{tree(depth - 1)}</{tag}>')
        return "".join(out)

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.parts, self.hidden = [], [], 0

        def flush(self):
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append(text)

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "svg", "button")
            if tag in ("div", "section", "ul", "blockquote", "article", "br"):
                self.flush()

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "svg", "button")
            if tag in ("div", "section", "ul", "blockquote", "article"):
                self.flush()

        def handle_data(self, data):
            if not self.hidden:
                self.parts.append(data)

    for _ in range(300):
        source = tree(4)
        plain = Plain()
        plain.feed(source)
        plain.close()
        plain.flush()
        assert [t for _, t in htmltext.Page(source).blocks] == plain.blocks


def test_labelled_pages_are_learned():
    model, wrong, total = htmltext.trained(), 0, 0
    for page, marks in htmltext.labelled(40):
        odds, _, _ = htmltext.marginals(page.parent, *model.potentials(page))
        texts = [i for i, _ in page.blocks]
        wrong += sum((odds[i] > 0) != marks[i] for i in texts)
        total += len(texts)
    assert wrong <= 0.02 * total


def test_messages_give_the_marginals_of_all_labellings():
    import itertools
    import math

    parent, own = [-1, 0, 0, 1, 1], [0.3, -0.7, 0.2, 1.1, -0.4]
    edge = [(0, 0, 0, 0)] + [(0.5, -0.2, -0.9, 0.8), (0.1, 0.3, -0.4, 0.6)] * 2
    odds, _, _ = htmltext.marginals(parent, own, edge)
    for i in range(5):
        mass = [0.0, 0.0]
        for y in itertools.product((0, 1), repeat=5):
            mass[y[i]] += math.exp(sum(o * b for o, b in zip(own, y, strict=True)) + sum(edge[j][2 * y[parent[j]] + y[j]] for j in range(1, 5)))
        assert abs(odds[i] - math.log(mass[1] / mass[0])) < 1e-9


def test_rows_and_edges(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, "v", None), (3, None, ""), (None, "w", "<p>"), (4, "x", deep), (5, "y", "<article><p>" + "long words " * 50_000), (6, "z", 'a < b <a href="')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    out = htmltext.extract(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = {r.page_id: r for r in out.collect()}
    assert out.count() == 8 and all(r.n_chars == len(r.text) for r in found.values())
    assert found[2].text == found[3].text == found[None].text == ""
    assert found[5].n_chars == len(("long words " * 50_000).strip())
    assert htmltext.extract(pages.limit(0)).count() == 0
