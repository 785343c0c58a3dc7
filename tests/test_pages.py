"""The node table against a tree that is walked."""

import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tidewater.operators import pages
from tidewater.sources.tables import table


class Node:
    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def all(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.all()

    def texts(self):
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            else:
                yield from c.texts()


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in pages.VOID:
            self.at = n

    def handle_endtag(self, tag):
        n = self.at
        while n and n.tag != tag:
            n = n.parent
        if n and n.parent:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def clean(node):
    kept = []
    for c in node.children:
        if isinstance(c, Node):
            style = c.attrs.get("style", "").lower()
            mark = f"{c.attrs.get('id', '')} {c.attrs.get('class', '')}".strip()
            if c.tag in pages.NOISE or "hidden" in c.attrs or c.attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or re.search(pages.NOISE_MARK, mark):
                continue
            if c.tag == "img":
                if c.attrs.get("alt", "").strip():
                    kept.append(c.attrs["alt"].strip())
                continue
            clean(c)
        kept.append(c)
    node.children = kept


def best_root(page):
    tree = Tree(page).root
    clean(tree)
    found = []
    for selector in pages.ROOTS:
        for n in tree.all():
            classes = n.attrs.get("class", "").split()
            if n.tag == selector or "." + selector[1:] == selector and selector[1:] in classes or "#" + selector[1:] == selector and n.attrs.get("id") == selector[1:] or selector == "[role=main]" and n.attrs.get("role") == "main":
                found.append(n)
    score = lambda n: len(" ".join(n.texts())) + sum(pages.POINTS.get(d.tag, 0) for d in n.all())
    if not found:
        return "", score(tree)
    n = max(found, key=score)
    return n.tag, score(n)


FIXTURES = [
    "<html><head><title> A &amp; B </title><meta property='og:description' content='og'><meta name=description content=' what it says '></head><body><nav>" + "<a href='/x'>menu</a> " * 9 + "</nav><article><p>one <b>two</p><p>three</article><div role=main><h2>T</h2><pre>x\ny</pre></div></body></html>",
    "<body><main>short</main><div id='content'>" + "long text here " * 9 + "<img src=a alt='a picture'><img src=b></div><div class='cookie banner'><article>" + "noise " * 99 + "</article></div></body>",
    "<p>no candidate <code>x</code><script>var a = '<article>';</script>", "", "plain text only", "<div hidden><article>gone</article></div>", "<article>tie</article><main>tie</main><article>tie</article>",
    "<body><div class='x docs-content y'><table><tr><td>1</table></div><section style='Display:None'><main>hidden main is long enough to win</main></section></body>", "</div></p><article><br/>a<br>b<div/>c</article>",
]


def test_roots_of_fixtures_and_of_all_pages(spark):
    rows = [(i, p) for i, p in enumerate(FIXTURES)] + [(100 + r.page_id, r.html) for r in table(spark, "/root/testdata/sf0.001", "pages").collect()]
    df = spark.createDataFrame(rows, "k long, html string")
    got = {r.k: (r.root, r.score) for r in pages.content_roots(pages.page_events(df, "k", "html"), "k").collect()}
    for k, page in rows:
        if k in got or best_root(page)[1]:
            assert got[k] == best_root(page), (k, page[:80])


def test_articles(spark):
    df = spark.createDataFrame([(0, FIXTURES[0], "https://h.org/a/b?q"), (1, "<title>T</title><article><h1>T</h1><ul><li>a<li><a href='c.html'>b</a> <a href='#x'>y</a></ul><p>same</p><p>same</p></article>", "https://h.org/a/b"), (2, None, None)], "k long, html string, url string")
    got = {r.k: r for r in pages.articles(df, "k", "html", "url").collect()}
    assert (got[0].title, got[0].description) == ("A & B", "what it says") and got[0].markdown.startswith("# A & B\n\nwhat it says\n\n")
    assert got[1].markdown == "# T\n\n- a\n\n- [b](https://h.org/a/c.html) [y](#x)\n\nsame" and got[1].root == "article" and 2 not in got


def test_absolute_links(spark):
    from urllib.parse import urljoin

    base, links = "https://h.org/a/b.html?q=1#f", ["c", "/c", "//g.org/c", "?x=1", "#y", "mailto:a@b", "http://z/", "", "./d/e", "a b"]
    df = spark.createDataFrame([(x,) for x in links], "l string")
    got = [r[0] for r in df.select(pages.absolute(F.lit(base), F.col("l"))).collect()]
    assert got == [x if x.startswith(("#", "mailto:")) or not x else urljoin(base, x) for x in links]
    assert spark.range(1).select(pages.absolute(F.lit("https://h.org"), F.lit("c"))).first()[0] == "https://h.org/c"
