"""Session and content operators: prefix search, path rules, ranges of lines, churn, expansion, selection, compression."""

import json
import re

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.scalars import words, zero
from ..registry import query
from ..sources.tables import table
from .text import REDACTIONS, spans_of
from .windows import greedy_pack


def match_query(text: Column, wanted: str) -> Column:
    """A quoted phrase as it stands; bare words as prefixes that must all be there; anything else as one phrase."""
    if len(wanted) > 2 and wanted[0] == wanted[-1] == '"':
        return F.contains(F.lower(text), F.lit(wanted[1:-1].lower()))
    terms = re.findall(r"\w+", wanted.lower())
    if not terms:
        return F.contains(F.lower(text), F.lit(wanted.lower()))
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.rlike(F.lower(text), F.lit(rf"\b{re.escape(t)}"))
    return hit


@query("prefix_match_search", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '\blicens') AND regexp_matches(lower(text), '\bapach')")
def prefix_match_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(match_query(F.col("text"), "licens apach")).select("doc_id")


@query(
    "match_snippets",
    r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), p AS (SELECT doc_id, w, list_position(list_transform(w, lambda x: lower(x) = 'license,'), true) AS p FROM w)
    SELECT doc_id, array_to_string(w[greatest(p - 5, 1) : p - 1], ' ') || ' [[' || w[p] || ']] ' || array_to_string(w[p + 1 : p + 6], ' ') AS snippet FROM p WHERE p > 0
    """,
)
def match_snippets(spark, sf_dir):
    """The first match with up to five words before and six after it, marked."""
    w = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("license,"))).select("doc_id", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("w"))
    p = w.withColumn("p", F.array_position(F.transform("w", F.lower), "license,").cast("int")).where("p > 0")
    start = F.greatest(F.col("p") - 5, F.lit(1))
    before, after = F.slice("w", start, F.col("p") - start), F.slice("w", F.col("p") + 1, F.lit(6))
    return p.select("doc_id", F.concat(F.array_join(before, " "), F.lit(" [["), F.element_at("w", F.col("p")), F.lit("]] "), F.array_join(after, " ")).alias("snippet"))


@query(
    "deleted_symbol_search",
    "SELECT p_partkey FROM part WHERE (lower(coalesce(p_name, '')) LIKE '%part 1%' OR lower(coalesce(p_type, '')) LIKE '%part 1%' OR lower(coalesce(p_brand, '')) LIKE '%#1%') AND p_size >= 10",
)
def deleted_symbol_search(spark, sf_dir):
    like = lambda c, s: F.like(F.lower(F.coalesce(c, F.lit(""))), F.lit(s))
    return table(spark, sf_dir, "part").where((like("p_name", "%part 1%") | like("p_type", "%part 1%") | like("p_brand", "%#1%")) & (F.col("p_size") >= 10)).select("p_partkey")


# Components that mark a path's kind.
GENERATED = r"(^|/)(dist|build|node_modules|vendor|generated|__pycache__)(/|$)|\.min\.(js|css)$"
DOCS = r"(^|/)docs?(/|$)|\.(md|rst)$"
TESTS = r"(^|/)tests?(/|$)|(^|/)test_[^/]*$|_test\.[^/]*$"


@query(
    "path_kinds",
    f"WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages) SELECT page_id, regexp_matches(p, '{GENERATED}') AS generated, regexp_matches(p, '{DOCS}') AS docs, regexp_matches(p, '{TESTS}') AS tests FROM p",
)
def path_kinds(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("p"))
    return p.select("page_id", *[F.rlike("p", F.lit(x)).alias(n) for n, x in (("generated", GENERATED), ("docs", DOCS), ("tests", TESTS))])


@query("line_range", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def line_range(spark, sf_dir):
    """Lines 2 to 4; a range may end after the text does."""
    lines = F.split("text", "\n", -1)
    return table(spark, sf_dir, "documents").where(F.size(lines) >= 2).select("doc_id", F.array_join(F.slice(lines, 2, 3), "\n").alias("lines"))


@query("store_metrics", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def store_metrics(spark, sf_dir):
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query(
    "file_churn",
    "WITH t AS (SELECT max(l_shipdate) AS now FROM lineitem) SELECT l_suppkey AS file, count(*) FILTER (l_shipdate >= now - INTERVAL 90 DAY) AS commits, round(least(1, count(*) FILTER (l_shipdate >= now - INTERVAL 90 DAY) / 20.0), 6)::DOUBLE AS churn, count(DISTINCT l_returnflag) AS authors FROM lineitem, t GROUP BY 1",
)
def file_churn(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    now = F.broadcast(l.agg(F.max("l_shipdate").alias("now")))
    recent = F.count_if(F.expr("l_shipdate >= now - INTERVAL 90 DAY"))
    return l.join(now).groupBy(F.col("l_suppkey").alias("file")).agg(recent.alias("commits"), F.round(F.least(F.lit(1.0), recent / 20.0), 6).alias("churn"), F.count_distinct("l_returnflag").alias("authors"))


@query(
    "relevance_expansion",
    """
    WITH s AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS term FROM conversations WHERE turn < 4), q AS (SELECT DISTINCT conv_id, term FROM s WHERE turn = 0),
    c AS (SELECT conv_id, term, count(*) AS n FROM s WHERE turn > 0 AND (conv_id, term) NOT IN (SELECT conv_id, term FROM q) GROUP BY 1, 2)
    SELECT conv_id, term, n, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, term) AS place FROM c) WHERE place <= 3
    """,
)
def relevance_expansion(spark, sf_dir):
    """Three terms that the first spans add to the query, by count and then alphabetically."""
    s = table(spark, sf_dir, "conversations").where("turn < 4").select("conv_id", "turn", F.explode(words(F.col("text"), "[a-z0-9]{3,}")).alias("term"))
    c = s.groupBy("conv_id", "term").agg(F.count("*").alias("n"), F.min("turn").alias("first")).where("first > 0").drop("first")
    w = Window.partitionBy("conv_id").orderBy(F.desc("n"), "term")
    return c.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")


@query(
    "chunk_selection",
    r"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM documents),
    s AS (SELECT doc_id, no, length(line) AS cost, 10 * (contains(lower(line), 'the')::INT + contains(lower(line), 'and')::INT) + len(regexp_extract_all(lower(line), 'the|and')) AS score FROM l WHERE line <> ''),
    r AS (SELECT doc_id, list(CAST(cost AS BIGINT) ORDER BY -score, no) AS costs FROM s GROUP BY 1), p AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, costs), lambda a, c: CASE WHEN a % 1000000 + c <= 600 THEN a + c + 1000000 ELSE a END) AS acc FROM r)
    SELECT doc_id, acc % 1000000 AS chars, acc // 1000000 AS chunks FROM p
    """,
)
def chunk_selection(spark, sf_dir):
    """Lines by terms covered (ten points each) and occurrences, as many as fit in 600 characters."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("no", "line")).where("line <> ''")
    low = F.lower("line")
    score = 10 * (F.contains(low, F.lit("the")).cast("int") + F.contains(low, F.lit("and")).cast("int")) + F.regexp_count(low, F.lit("the|and"))
    item = F.struct((-score).alias("rank"), F.col("no"), F.length("line").cast("long").alias("cost"))
    return l.groupBy("doc_id").agg(greedy_pack(F.array_sort(F.collect_list(item)), 600).alias("p")).select("doc_id", F.col("p.used").alias("chars"), F.size("p.kept").cast("long").alias("chunks"))


@query("head_and_tail", "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 200) || ' ... ' || right(text, 200) ELSE text END AS shown FROM documents")
def head_and_tail(spark, sf_dir):
    """The short form where it saves enough, else the text."""
    short = F.concat(F.left("text", F.lit(200)), F.lit(" ... "), F.right("text", F.lit(200)))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length("text") > 500, short).otherwise(F.col("text")).alias("shown"))


@query("event_floor", "SELECT user_id, min(ts) AS floor_ts, max(ts) AS last_ts, greatest(count(*) - 50, 0) AS evicted FROM events GROUP BY 1")
def event_floor(spark, sf_dir):
    """How many events a retention of 50 has evicted; the floor is the first event's time."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("floor_ts"), F.max("ts").alias("last_ts"), F.greatest(F.count("*") - 50, F.lit(0)).alias("evicted"))


@query("weak_success_probability", "SELECT c_mktsegment AS bucket, count(*) AS n, CASE WHEN count(*) >= 10 THEN round((count(*) FILTER (c_acctbal > 3000) + 1) / (count(*) + 2), 6) END AS p FROM customer GROUP BY 1")
def weak_success_probability(spark, sf_dir):
    """Laplace-smoothed success of a bucket, null with too few samples."""
    n = F.count("*")
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("bucket")).agg(n.alias("n"), F.when(n >= 10, F.round((F.count_if(F.col("c_acctbal") > 3000) + 1) / (n + 2), 6)).alias("p"))


# ---------------------------------------------------------------- JSON redaction and event dedup (sequential in a session)
_RULES = [(re.compile(p), m, spans_of(p, m)) for p, m in REDACTIONS]


def _without_spans(value: str, mark: str, first: str, kinds) -> str:
    """Each span from an opener to the next closer of its kind as the mark; a kind whose closer was not found once is not looked for again."""
    kinds, out, at = [(re.compile(first + rest), re.compile(closer)) for rest, closer in kinds], [], 0
    found = [opener.search(value) for opener, _ in kinds]
    while any(found):
        i = min((m.start(), i) for i, m in enumerate(found) if m)[1]
        opener, closer = kinds[i]
        end = closer.search(value, found[i].end())
        if end is None:
            found[i] = None
            continue
        out += [value[at : found[i].start()], mark]
        at = end.end()
        found = [m if m is None or m.start() >= at else o.search(value, at) for m, (o, _) in zip(found, kinds, strict=True)]
    return "".join([*out, value[at:]])


def redact_json(line: str | None) -> str | None:
    """String values of a JSON line redacted, keys untouched; a line that is no JSON is redacted as text."""

    def clean(value):
        if isinstance(value, str):
            for pattern, mark, spans in _RULES:
                value = pattern.sub(mark, value) if spans is None else _without_spans(value, mark, *spans)
            return value
        if isinstance(value, list):
            return [clean(v) for v in value]
        return {k: clean(v) for k, v in value.items()} if isinstance(value, dict) else value

    if line is None:
        return None
    try:
        return json.dumps(clean(json.loads(line)), ensure_ascii=False)
    except ValueError:
        return clean(line)


def _redact_json(lines: pd.Series) -> pd.Series:
    return lines.map(redact_json)


@query("json_redaction")
def json_redaction(spark, sf_dir):
    clean = F.pandas_udf(_redact_json, "string")
    line = F.to_json(F.struct("role", "text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", clean(line).alias("line"))


@query(
    "compressed_events",
    """
    WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.8 ELSE 0.4 END AS score, CAST(1 + event_id % 9 AS BIGINT) AS cost, event_type = 'error' AND value > 100 AS keystone FROM events),
    r AS (SELECT user_id, list(cost ORDER BY NOT keystone, -score, event_id) AS costs FROM s GROUP BY 1), p AS (SELECT user_id, list_reduce(list_prepend(0::BIGINT, costs), lambda a, c: CASE WHEN a % 1000000 + c <= 80 THEN a + c + 1000000 ELSE a END) AS acc FROM r)
    SELECT user_id, acc % 1000000 AS used, acc // 1000000 AS kept FROM p
    """,
)
def compressed_events(spark, sf_dir):
    """Keystones first, then by score, into a budget."""
    e = table(spark, sf_dir, "events")
    score = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "purchase", 0.8).otherwise(0.4)
    other = ~((F.col("event_type") == "error") & (F.col("value") > 100))
    item = F.struct(other.alias("other"), (-score).alias("rank"), "event_id", (1 + F.col("event_id") % 9).cast("long").alias("cost"))
    return e.groupBy("user_id").agg(greedy_pack(F.array_sort(F.collect_list(item)), 80).alias("p")).select("user_id", zero("p.used").alias("used"), F.size("p.kept").cast("long").alias("kept"))
