"""Pages as tables of nodes: what is noise, which node holds the content, and that node as Markdown.

A page is cut into events in the order of its text: an element begins, a text stands, an element ends. What holds for a
node's whole subtree is a difference of running sums between its begin and its end: how deep it lies in noise, how much
text and structure it has. Only the cutting is Python; all else are windows over a page's events.
"""

from __future__ import annotations

import html.parser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

# Elements that are never content, marks of noise in ids and classes, and what may hold the content, the surest first.
NOISE = "script style noscript template svg canvas iframe form input button select textarea".split()
NOISE_MARK = r"(?i)(?:^|[-_\s])(?:cookie|consent|banner|modal|newsletter|subscribe|sponsor|advertisement|ad-container|social-share|share-buttons|feedback-widget|tracking|promo)(?:$|[-_\s])"
ROOTS = ("article", "main", "[role=main]", ".markdown-body", ".theme-doc-markdown", ".docs-content", ".documentation", "#content", "#main-content", "body")
# Points for elements inside a node, besides a point for each character of text.
POINTS = {"pre": 400, "code": 400, "h1": 150, "h2": 150, "h3": 150, "table": 80}
MOST_DESCRIPTION = 300
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = "p div section article main ul ol table tr br blockquote pre header footer nav aside h1 h2 h3 h4 h5 h6 li dl dt dd figure".split()
BEGIN, TEXT, END = 0, 1, 2
_EVENTS = "array<struct<kind: int, node: int, tag: string, attrs: map<string, string>, text: string>>"


class _Cutter(html.parser.HTMLParser):
    """Events of a page. An end closes all that was left open inside; one that nothing opened is passed over."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.events, self.open, self.nodes = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.events.append((BEGIN, self.nodes, tag, {k: v or "" for k, v in attrs}, None))
        if tag in VOID:
            self.events.append((END, self.nodes, tag, None, None))
        else:
            self.open.append((tag, self.nodes))
        self.nodes += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while True:
                t, node = self.open.pop()
                self.events.append((END, node, t, None, None))
                if t == tag:
                    break

    def handle_data(self, data):
        self.events.append((TEXT, None, None, None, data))


def cut_page(page: str | None) -> list[tuple]:
    cutter = _Cutter()
    cutter.feed(page or "")
    cutter.close()
    while cutter.open:
        tag, node = cutter.open.pop()
        cutter.events.append((END, node, tag, None, None))
    return cutter.events


def _cut(pages: pd.Series) -> pd.Series:
    return pages.map(cut_page)


# ---------------------------------------------------------------- nodes
def page_events(pages: DataFrame, key: str, page: str, base: str | None = None) -> DataFrame:
    """``key``, ``base``, ``pos``, ``kind``, ``node``, ``tag``, ``attrs``, ``text`` of what is not noise; a picture with a description is that text."""
    cut = pages.select(key, (F.col(base) if base else F.lit("")).alias("base"), F.posexplode(F.pandas_udf(_cut, _EVENTS)(page)).alias("pos", "e")).select(key, "base", "pos", "e.*")
    a = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    style = F.lower(a("style"))
    hidden = F.map_contains_key("attrs", F.lit("hidden")) | (a("aria-hidden") == "true") | F.contains(style, F.lit("display:none")) | F.contains(style, F.lit("visibility:hidden"))
    marked = F.rlike(F.concat_ws(" ", a("id"), a("class")), F.lit(NOISE_MARK))
    noise = (F.col("kind") == BEGIN) & (F.col("tag").isin(NOISE) | F.coalesce(hidden | marked, F.lit(False)))
    noisy = F.max(noise).over(Window.partitionBy(key, "node"))
    step = F.when(~noisy | F.col("node").isNull(), 0).when(F.col("kind") == BEGIN, 1).when(F.col("kind") == END, -1).otherwise(0)
    depth = F.sum("step").over(Window.partitionBy(key).orderBy("pos"))
    live = cut.withColumn("step", step).withColumn("depth", depth).where((F.col("depth") == 0) & (F.col("step") == 0)).drop("step", "depth")
    picture = (F.col("tag") == "img") & (F.col("kind") == BEGIN)
    alt = F.when(picture, F.nullif(F.trim(a("alt")), F.lit("")))
    live = live.withColumns({"kind": F.when(alt.isNotNull(), TEXT).otherwise(F.col("kind")), "text": F.coalesce(alt, "text")})
    return live.where((F.col("tag").isNull()) | (F.col("tag") != "img") | (F.col("kind") == TEXT))


def _matches(selector: str) -> Column:
    a = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    if selector.startswith("."):
        return F.array_contains(F.split(a("class"), r"\s+"), selector[1:])
    if selector.startswith("#"):
        return a("id") == selector[1:]
    if selector.startswith("["):
        return a("role") == selector[1:-1].split("=")[1]
    return F.col("tag") == selector


def content_roots(events: DataFrame, key: str) -> DataFrame:
    """``key``, ``first`` and ``last`` (positions), ``root``, ``score`` of the node with the highest score among those that may hold the content.

    Of equal scores the surer kind of node counts, then the earlier one. A page without any such node is its own root.
    """
    stripped = F.length(F.regexp_replace("text", r"^\s+|\s+$", ""))
    chars = F.when((F.col("kind") == TEXT) & (stripped > 0), stripped + 1).otherwise(0)
    points = F.lit(0)
    for tag, n in POINTS.items():
        points = F.when((F.col("kind") == BEGIN) & (F.col("tag") == tag), n).otherwise(points)
    w = Window.partitionBy(key).orderBy("pos")
    kind = F.lit(None).cast("int")
    for i in range(len(ROOTS) - 1, -1, -1):
        kind = F.when(_matches(ROOTS[i]), i).otherwise(kind)
    summed = events.withColumns({"c": F.sum(chars).over(w), "p": F.sum(points).over(w), "kind_of": F.when(F.col("kind") == BEGIN, kind)})
    # an element's own points lie before its begin's sum, so that they count for what is around it only
    nodes = summed.where("node IS NOT NULL AND tag <> 'img'").groupBy(key, "node").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("tag").alias("tag"), F.max("kind_of").alias("kind_of"), (F.max("c") - F.min("c")).alias("c"), (F.max("p") - F.min("p")).alias("p"))
    score = F.col("c") - (F.col("c") > 0).cast("int") + F.col("p")
    best = nodes.where("kind_of IS NOT NULL").groupBy(key).agg(F.max_by(F.struct("first", "last", F.col("tag").alias("root"), score.alias("score")), F.struct(score.alias("s"), -F.col("kind_of"), -F.col("first"))).alias("b"))
    whole = summed.groupBy(key).agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.max("c").alias("c"), F.max("p").alias("p"))
    out = whole.join(best, key, "left")
    pick = lambda n, other: F.coalesce(F.col(f"b.{n}"), other).alias(n)
    return out.select(key, pick("first", F.col("first")), pick("last", F.col("last")), pick("root", F.lit("")), pick("score", score))


def page_metadata(events: DataFrame, key: str) -> DataFrame:
    """``key``, ``title``, ``description`` (null if there is none)."""
    a = lambda name: F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))
    w = Window.partitionBy(key).orderBy("pos")
    title = F.sum(F.when(F.col("tag") == "title", F.when(F.col("kind") == BEGIN, 1).when(F.col("kind") == END, -1)).otherwise(0)).over(w)
    number = F.sum(F.when((F.col("tag") == "title") & (F.col("kind") == BEGIN), 1).otherwise(0)).over(w)
    marked = events.withColumns({"in_title": (title > 0) & (number == 1) & (F.col("kind") == TEXT), "meta": F.when((F.col("tag") == "meta") & (F.col("kind") == BEGIN), F.when(a("name") == "description", 0).when(a("property") == "og:description", 1))})
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("in_title"), F.struct("pos", F.regexp_replace("text", r"^\s+|\s+$", "").alias("t"))))), lambda x: x.t), " ")
    return marked.groupBy(key).agg(F.nullif(said, F.lit("")).alias("title"), F.nullif(F.trim(F.min_by(a("content"), F.when(F.col("meta").isNotNull(), F.struct("meta", "pos")))), F.lit("")).alias("description"))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page; places of the same page and mail and telephone links stay."""
    host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*/|/)?", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    return (
        F.when((link == "") | F.rlike(link, F.lit(r"^(#|[a-zA-Z][a-zA-Z0-9+.-]*:)")) | (host == ""), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, link)).when(F.startswith(link, F.lit("/")), F.concat(host, link))
        .when(F.startswith(link, F.lit("?")), F.concat(page, link)).otherwise(F.concat(host, F.when(path == "", "/").otherwise(path), F.regexp_replace(link, r"^(\./)+", "")))
    )


def articles(pages: DataFrame, key: str, page: str, base: str | None = None) -> DataFrame:
    """``key``, ``root``, ``score``, ``title``, ``description``, ``markdown`` of each page that has anything but noise.

    The Markdown is that of the root, lines that repeat the one before left out. A title stands before it unless it begins
    with a heading, and a description of up to 300 characters that it does not hold.
    """
    events = page_events(pages, key, page, base)
    roots, meta = content_roots(events, key), page_metadata(events, key)
    inside = events.join(roots.select(key, "first", "last"), key).where(F.col("pos").between(F.col("first"), F.col("last")))
    href = F.coalesce(F.try_element_at("attrs", F.lit("href")), F.lit(""))
    link = F.last(F.when((F.col("kind") == BEGIN) & (F.col("tag") == "a"), absolute(F.col("base"), F.trim(href))), True).over(Window.partitionBy(key).orderBy("pos"))
    begins, ends = F.col("kind") == BEGIN, F.col("kind") == END
    piece = (
        F.when(F.col("kind") == TEXT, F.regexp_replace("text", r"\s+", " ")).when(begins & F.rlike("tag", F.lit("^h[1-6]$")), F.concat(F.lit("\n"), F.repeat(F.lit("#"), F.substring("tag", 2, 1).cast("int")), F.lit(" ")))
        .when(begins & (F.col("tag") == "li"), "\n- ").when(begins & (F.col("tag") == "a"), "[").when(ends & (F.col("tag") == "a"), F.concat(F.lit("]("), "link", F.lit(")"))).when(F.col("tag").isin(BLOCK), "\n").otherwise("")
    )
    pieces = inside.withColumn("link", link).select(key, "pos", piece.alias("piece")).where("piece <> ''")
    # a page's pieces are one row as its text was
    text = pieces.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x.piece), "").alias("t"))
    lines = F.filter(F.transform(F.split("t", "\n"), lambda x: F.trim(F.regexp_replace(x, " {2,}", " "))), lambda x: x != "")
    text = text.select(key, lines.alias("l")).select(key, F.array_join(F.filter("l", lambda x, i: (i == 0) | (x != F.get("l", i - 1))), "\n\n").alias("body"))
    out = roots.join(meta, key).join(text, key, "left").withColumn("body", F.coalesce("body", F.lit("")))
    heading = F.when(F.col("title").isNotNull() & ~F.startswith("body", F.lit("#")), F.concat(F.lit("# "), "title"))
    told = F.when((F.length("description") <= MOST_DESCRIPTION) & ~F.contains("body", F.col("description")), F.col("description"))
    return out.select(key, "root", "score", "title", "description", F.concat_ws("\n\n", heading, told, F.nullif("body", F.lit(""))).alias("markdown"))


@query("page_articles")
def page_articles(spark, sf_dir):
    return articles(table(spark, sf_dir, "pages"), "page_id", "html", "url").withColumn("markdown", F.md5("markdown"))
