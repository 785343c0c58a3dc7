"""Recall with widening, stemmed conjunctive search, outlines under a budget, line windows, and small text functions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_json
from ..registry import query
from ..shared import dealt, written
from ..sources.tables import table
from .retrieval import TASK_HITS, _tokens_sql, kept_terms, term_table, tokens

# Words that a widened query leaves out.
WIDENING_STOPS = ("and", "or", "the", "a", "an", "to", "of", "in", "for", "with", "on")


# ---------------------------------------------------------------- recall
def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"))


def widened(text: Column) -> Column:
    """The first three useful terms of a query outside its quoted parts."""
    bare = F.regexp_replace(F.lower(text), r"'.*?'|\".*?\"", " ")
    return F.slice(F.filter(_terms(bare), lambda t: ~t.isin(*WIDENING_STOPS)), 1, 3)


def recall(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str) -> DataFrame:
    """``query_key``, ``key``, ``widened``: texts with all terms of a query; where there is none, those with any of its widened terms.

    Texts and queries meet on terms, each pair once a term; the second search runs only for queries whose first is empty.
    """
    index = docs.select(key, F.explode(F.array_distinct(_terms(F.col(text)))).alias("term"))
    all_of = F.array_distinct(_terms(F.col(query_text)))
    q = queries.select(query_key, query_text, F.size(all_of).alias("wanted"), F.explode(all_of).alias("term"))
    met = index.join(q, "term").groupBy(query_key, key, "wanted").agg(F.count("*").alias("n"))
    exact = met.where("n = wanted").select(query_key, key)
    rest = queries.join(exact.select(query_key).distinct(), query_key, "left_anti")
    any_of = rest.select(query_key, F.explode(F.array_distinct(widened(F.col(query_text)))).alias("term"))
    wide = index.join(any_of, "term").select(query_key, key).distinct()
    return exact.withColumn("widened", F.lit(False)).unionByName(wide.withColumn("widened", F.lit(True)))


_QUERIES_SQL = "SELECT item_id, CASE item_id % 3 WHEN 0 THEN text WHEN 1 THEN array_to_string(string_split(text, ' ')[1:3], ' ') ELSE '\"quoted part\" the ' || text END AS q FROM benchmark"


@query(
    "recall_with_widening",
    f"""
    WITH q AS ({_QUERIES_SQL}), t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS term FROM documents),
    w AS (SELECT item_id, q, list_distinct(regexp_extract_all(lower(q), '[a-z0-9_]+')) AS all_of FROM q), e AS (SELECT item_id, doc_id FROM (SELECT item_id, len(all_of) AS wanted, unnest(all_of) AS term FROM w) JOIN t USING (term) GROUP BY item_id, doc_id, wanted HAVING count(*) = wanted),
    r AS (SELECT item_id, list_filter(regexp_extract_all(regexp_replace(lower(q), '''.*?''|".*?"', ' ', 'g'), '[a-z0-9_]+'), lambda x: NOT list_contains([{", ".join(f"'{s}'" for s in WIDENING_STOPS)}], x))[1:3] AS any_of FROM q WHERE item_id NOT IN (SELECT item_id FROM e)),
    f AS (SELECT DISTINCT item_id, doc_id FROM (SELECT item_id, unnest(list_distinct(any_of)) AS term FROM r) JOIN t USING (term))
    SELECT item_id, widened, count(*) AS n, min(doc_id) AS first FROM (SELECT *, false AS widened FROM e UNION ALL SELECT *, true FROM f) GROUP BY 1, 2
    """,
)
def recall_with_widening(spark, sf_dir):
    cut = F.split("text", " ")
    q = F.when(F.col("item_id") % 3 == 0, F.col("text")).when(F.col("item_id") % 3 == 1, F.array_join(F.slice(cut, 1, 3), " ")).otherwise(F.concat(F.lit('"quoted part" the '), "text"))
    found = recall(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", q.alias("q")), "doc_id", "text", "item_id", "q")
    return found.groupBy("item_id", "widened").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def stemmed_search(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, index: DataFrame | None = None) -> DataFrame:
    """``query_key``, ``key`` of texts that have every stemmed term of a query; a query without terms finds nothing.

    The index is cut to terms that are asked for and dealt by texts to tasks of about ``TASK_HITS`` hits, where they are counted.
    """
    terms = F.array_distinct(tokens(F.col(query_text)))
    q = queries.select(query_key, F.size(terms).alias("wanted"), F.explode(terms).alias("term"))
    index = term_table(docs, key, text) if index is None else index
    wanted = index.select(key, "term").join(q.select("term").distinct(), "term", "left_semi")
    asked = q.groupBy("term").agg(F.count("*").alias("n"))
    q, hits = written(q, "asked"), wanted.join(asked, "term").agg(F.sum("n")).first()[0] or 0
    met = dealt(wanted, hits, key, task_rows=TASK_HITS).join(q, "term")
    return met.groupBy(query_key, key, "wanted").agg(F.count("*").alias("n")).where("n = wanted").select(query_key, key)


@query(
    "stemmed_conjunctive_search",
    f"""
    WITH q AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:3], ' ') AS q FROM benchmark), w AS (SELECT item_id, list_distinct({_tokens_sql("q")}) AS all_of FROM q),
    t AS (SELECT doc_id, unnest(list_distinct({_tokens_sql("text")})) AS term FROM documents)
    SELECT item_id, doc_id FROM (SELECT item_id, len(all_of) AS wanted, unnest(all_of) AS term FROM w) JOIN t USING (term) GROUP BY item_id, doc_id, wanted HAVING count(*) = wanted
    """,
)
def stemmed_conjunctive_search(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("q"))
    d = table(spark, sf_dir, "documents")
    return stemmed_search(d, q, "doc_id", "text", "item_id", "q", index=kept_terms(d, "doc_id", "text"))


# ---------------------------------------------------------------- outlines
def fit_to_budget(ranked: DataFrame, order: list, size: str, budget: int) -> DataFrame:
    """The longest run of the best rows whose sizes (1 at least) sum up to the budget; the best row alone if even it is too large.

    No more than ``budget`` rows can fit, so that the running sum is over a bounded page and not over the table.
    """
    page = ranked.orderBy(*order).limit(max(1, budget))
    w = Window.orderBy(*order)
    out = page.withColumns({"upto": F.sum(F.greatest(F.col(size), F.lit(1))).over(w), "place": F.row_number().over(w).cast("long")})
    return out.where((F.col("upto") <= budget) | (F.col("place") == 1))


@query(
    "outline_within_budget",
    """
    WITH d AS (SELECT p_brand AS file, count(*) AS calls, CAST(ceil(sum(len(p_name) + 1) / 4) AS BIGINT) AS tokens FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    r AS (SELECT *, CAST(sum(greatest(tokens, 1)) OVER (ORDER BY calls DESC, file) AS BIGINT) AS upto, row_number() OVER (ORDER BY calls DESC, file) AS place FROM d)
    SELECT file, calls, tokens, upto, place FROM r WHERE upto <= (SELECT CAST(sum(tokens) // 3 AS BIGINT) FROM d) OR place = 1
    """,
)
def outline_within_budget(spark, sf_dir):
    """The most used files whose outlines fit in a third of the tokens of all."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    d = l.groupBy(F.col("p_brand").alias("file")).agg(F.count("*").alias("calls"), F.ceil(F.sum(F.length("p_name") + 1) / 4).alias("tokens"))
    budget = d.agg(F.expr("sum(tokens) div 3")).first()[0] or 0
    return fit_to_budget(d, [F.desc("calls"), F.asc("file")], "tokens", budget)


# ---------------------------------------------------------------- windows of lines
def _plain(text: str) -> str:
    return "\n".join(re.sub(r"\s+", " ", line).strip() for line in text.splitlines())


def _longest(a: str, b: str, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest run in both stretches, the earliest in ``a`` and then in ``b``: what ``SequenceMatcher.find_longest_match`` gives without junk, by substring search."""
    at, other, size = alo, blo, 0
    i = alo
    while i + size < ahi:
        found = b.find(a[i : i + size + 1], blo, bhi)
        if found >= 0:
            low, high = size + 1, min(ahi - i, bhi - blo)  # a run of low characters is there: the longest one that is, by halving
            while low < high:
                mid = (low + high + 1) // 2
                if (j := b.find(a[i : i + mid], blo, bhi)) >= 0:
                    low, found = mid, j
                else:
                    high = mid - 1
            at, other, size = i, found, low
        i += 1
    return at, other, size


def _ratio(a: str, b: str) -> float:
    """``SequenceMatcher(None, a, b, autojunk=False).ratio()``."""
    matched, left = 0, [(0, len(a), 0, len(b))]
    while left:
        alo, ahi, blo, bhi = left.pop()
        i, j, size = _longest(a, b, alo, ahi, blo, bhi)
        if size:
            matched += size
            if alo < i and blo < j:
                left.append((alo, i, blo, j))
            if i + size < ahi and j + size < bhi:
                left.append((i + size, ahi, j + size, bhi))
    return 2.0 * matched / (len(a) + len(b)) if a or b else 1.0


def best_window(content: str, wanted: str, floor: float = 0.9, margin: float = 0.02) -> tuple[int, int, float] | None:
    """First line, last line and similarity of the run of lines most like ``wanted``, white space aside.

    Windows have as many lines as ``wanted``. None below ``floor``, or if another window that does not overlap comes
    within ``margin`` of the best. Cheap upper bounds of the similarity, by lengths and by counts of characters, spare most
    windows the full comparison, and equal windows are compared once.
    """
    lines, target = _plain(content).split("\n"), _plain(wanted)
    n = max(1, len(target.split("\n")))
    counts, known, found = Counter(target), {}, []
    for start in range(max(1, len(lines) - n + 1)):
        window = "\n".join(lines[start : start + n])
        both = len(window) + len(target)
        if both and 2.0 * min(len(window), len(target)) / both < floor:
            continue
        if window not in known:
            bound = 2.0 * (counts & Counter(window)).total() / both if both else 1.0
            known[window] = _ratio(window, target) if bound >= floor else 0.0
        if (ratio := known[window]) >= floor:
            found.append((ratio, start))
    if not found:
        return None
    ratio, start = max(found, key=lambda x: (x[0], -x[1]))
    if any(abs(other - start) >= n and ratio - r <= margin for r, other in found):
        return None
    return start + 1, min(start + n, len(lines)), ratio


def _best_windows(content: pd.Series, wanted: pd.Series) -> pd.DataFrame:
    found = [best_window(c or "", w or "") if w else None for c, w in zip(content, wanted, strict=True)]
    return pd.DataFrame([f or (None, None, None) for f in found], columns=["first", "last", "similarity"]).astype({"first": "Int64", "last": "Int64", "similarity": "float64"})


@query("fuzzy_windows")
def fuzzy_windows(spark, sf_dir):
    """Where the second line of each text, with one letter changed, is found again."""
    find = F.pandas_udf(_best_windows, "first long, last long, similarity double")
    second = F.get(F.split("text", "\n"), F.lit(1))
    d = table(spark, sf_dir, "documents").where(F.length(second) > 20).select("doc_id", find("text", F.concat(F.lit("#"), F.substr(second, F.lit(2)))).alias("f"))
    return d.select("doc_id", "f.first", "f.last", F.round("f.similarity", 6).alias("similarity"))


# ---------------------------------------------------------------- small functions
def bounded_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance, null above ``most``; the comparison stops there."""
    found = F.levenshtein(a, b, most)
    return F.when(found >= 0, found)


@query("bounded_edit_distance", "SELECT p_partkey, CASE WHEN levenshtein(p_name, p_type) <= 12 THEN levenshtein(p_name, p_type) END AS distance FROM part")
def bounded_edit_distance(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", bounded_distance(F.col("p_name"), F.col("p_type"), 12).cast("long").alias("distance"))


def minified(text: Column) -> Column:
    """JSON without the white space between its parts: keys keep their order and numbers their form. What is no JSON stays as it is."""
    return F.when(is_json(text), F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|\s+', "$1")).otherwise(text)


_SPACED = """CASE WHEN event_id % 5 = 4 THEN props || ' }' ELSE '{ "z y": ' || props || ' , "a" : [ 1.0,2.50 , "x \\" : " ],' || chr(10) || ' "e": ' || event_id || ' }' END"""


@query(
    "minified_json",
    rf"""SELECT event_id, CASE WHEN json_valid(x) THEN regexp_replace(x, '("(?:[^"\\]|\\.)*")|\s+', '\1', 'g') ELSE x END AS small, length(x) AS n FROM (SELECT event_id, {_SPACED} AS x FROM events)""",
)
def minified_json(spark, sf_dir):
    """The properties of events inside larger objects with white space in and between strings, and some that are no JSON."""
    spaced = F.expr(_SPACED.replace('\\"', '\\\\"'))
    return table(spark, sf_dir, "events").select("event_id", minified(spaced).alias("small"), F.length(spaced).cast("long").alias("n"))


def _blake(texts: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else hashlib.blake2b(t.encode(), digest_size=16).hexdigest() for t in texts])


@query("blake_digests")
def blake_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(_blake, "string")("text").alias("digest"))
