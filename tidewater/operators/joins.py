"""Joins, filters, set operations and top-k.

Range and as-of joins are written without a nested loop: intervals are spread over fixed buckets for an equi join, or
both sides are united and a running window carries values over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, words, zero
from ..registry import query
from ..shared import dealt
from ..sources.tables import table
from .ranking import gram_search


# ---------------------------------------------------------------- join helpers
def range_join(points: DataFrame, at: str, spans: DataFrame, start: str, end: str, keys: list[str], width: int) -> DataFrame:
    """Points within [start, end] of spans with equal ``keys``: spans are exploded to the buckets of ``width`` that they touch."""
    cell = lambda c: F.floor(F.col(c) / width)
    spread = spans.withColumn("_cell", F.explode(F.sequence(cell(start), cell(end))))
    joined = points.withColumn("_cell", cell(at)).join(spread, [*keys, "_cell"])
    return joined.where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_cell")


def as_of_sum(events: DataFrame, probes: DataFrame, key: str, at: str, amount: str, strict: bool) -> DataFrame:
    """``probes`` with ``before``: the sum of earlier events of the key (those at the same instant too unless ``strict``)."""
    side = 1 if strict else 0  # at one instant, strict probes come before the events
    e = events.select(key, at, F.col(amount).alias("_amount"), F.lit(side).alias("_side"), F.lit(False).alias("_probe"), *[F.lit(None).cast(t).alias(c) for c, t in probes.dtypes if c not in (key, at)])
    p = probes.withColumns({"_amount": F.lit(0.0), "_side": F.lit(1 - side), "_probe": F.lit(True)})
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(p).withColumn("before", F.sum("_amount").over(w))
    return both.where("_probe").drop("_amount", "_side", "_probe")


def merge_intervals(spans: DataFrame, key: str, start: str, end: str, gap: int) -> DataFrame:
    """Intervals of a key whose start is at most ``gap`` after the furthest end so far become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("_new", F.coalesce((F.col(start) > reach + gap).cast("int"), F.lit(1))).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


# ---------------------------------------------------------------- joins
@query(
    "route_success",
    "SELECT o_orderpriority AS route, count(*) AS n, round(sum(l_extendedprice), 4) AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def route_success(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("route")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 4).alias("cost"))


@query(
    "files_left_join_symbols",
    "SELECT n_name AS language, count(DISTINCT s_suppkey) AS files, count(DISTINCT c_custkey) AS symbols FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 9000 LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 GROUP BY 1",
)
def files_left_join_symbols(spark, sf_dir):
    """Counted on each side before the join, so that the two sides do not multiply."""
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").groupBy("s_nationkey").agg(F.count_distinct("s_suppkey").alias("files"))
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count_distinct("c_custkey").alias("symbols"))
    n = table(spark, sf_dir, "nation")
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").join(c, n.n_nationkey == c.c_nationkey, "left").select(F.col("n_name").alias("language"), zero("files").alias("files"), zero("symbols").alias("symbols"))


@query("unsynced_rows", "SELECT c_custkey, c_name FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority LIKE '1%' AND o_totalprice > 200000 WHERE o_orderkey IS NULL")
def unsynced_rows(spark, sf_dir):
    """Customers without a large urgent order."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_orderpriority LIKE '1%' AND o_totalprice > 200000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query(
    "host_filter_semi_join",
    "SELECT event_id, user_id, event_type FROM events WHERE (event_type = 'signup' AND props LIKE '%1}') OR user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 150)",
)
def host_filter_semi_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of_host = e.where("event_type = 'signup' AND value > 150").select(F.col("user_id").alias("host_user")).distinct().withColumn("hit", F.lit(True))
    joined = e.join(of_host, e.user_id == of_host.host_user, "left")
    return joined.where("hit OR (event_type = 'signup' AND props LIKE '%1}')").select("event_id", "user_id", "event_type")


@query(
    "reference_edges",
    """
    WITH d AS (SELECT DISTINCT l_partkey AS name, l_suppkey AS file FROM lineitem WHERE l_linenumber = 1), r AS (SELECT l_partkey AS name, l_suppkey AS file FROM lineitem WHERE l_linenumber <> 1)
    SELECT r.file AS src, d.file AS dst, count(*) AS weight FROM r JOIN d ON r.name = d.name AND r.file <> d.file GROUP BY 1, 2
    """,
)
def reference_edges(spark, sf_dir):
    """References to definitions (first lines) of the same name in other files; references are counted before the join."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("file"), "l_linenumber")
    d = l.where("l_linenumber = 1").select("name", F.col("file").alias("dst")).distinct()
    r = l.where("l_linenumber <> 1").groupBy("name", F.col("file").alias("src")).agg(F.count("*").alias("n"))
    return r.join(d, "name").where("src <> dst").groupBy("src", "dst").agg(F.sum("n").alias("weight"))


@query(
    "range_join_latest_start",
    """
    WITH p AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(floor(l_quantity * 10) AS BIGINT) AS pos FROM lineitem),
    s AS (SELECT s_suppkey, s_suppkey % 40 * 10 AS a, s_suppkey % 40 * 10 + 150 AS b FROM supplier)
    SELECT l_orderkey, l_linenumber, pos, window_start FROM (SELECT l_orderkey, l_linenumber, pos, a AS window_start, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, pos ORDER BY a DESC) AS r
      FROM p JOIN s ON s_suppkey = l_suppkey AND pos BETWEEN a AND b) WHERE r = 1
    """,
)
def range_join_latest_start(spark, sf_dir):
    """Rows in a window of their supplier; of several windows the one that starts last."""
    p = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("key"), "l_orderkey", "l_linenumber", F.floor(F.col("l_quantity") * 10).alias("pos"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") % 40 * 10).alias("a"), (F.col("s_suppkey") % 40 * 10 + 150).alias("b"))
    hit = range_join(p, "pos", s, "a", "b", ["key"], 100)
    return hit.groupBy("l_orderkey", "l_linenumber", "l_partkey", "key", "pos").agg(F.max("a").alias("window_start")).drop("l_partkey", "key")


_AS_OF = """
    WITH e AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type <> 'view'), p AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view')
    SELECT p.event_id, round(coalesce((SELECT sum(e.value) FROM e WHERE e.user_id = p.user_id AND e.ts {0} p.ts), 0), 6) AS before FROM p
"""


def _as_of(spark, sf_dir, strict):
    e = table(spark, sf_dir, "events")
    out = as_of_sum(e.where("event_type <> 'view'"), e.where("event_type = 'view'").select("user_id", "ts", "event_id"), "user_id", "ts", "value", strict)
    return out.select("event_id", F.round("before", 6).alias("before"))


@query("as_of_sum_strict", _AS_OF.format("<"))
def as_of_sum_strict(spark, sf_dir):
    return _as_of(spark, sf_dir, True)


@query("as_of_sum_inclusive", _AS_OF.format("<="))
def as_of_sum_inclusive(spark, sf_dir):
    return _as_of(spark, sf_dir, False)


@query(
    "host_full_outer",
    "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS host, coalesce(c.n, 0) AS counts, s.last_import FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9500 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, max(s_suppkey) AS last_import FROM supplier GROUP BY 1) s ON c_nationkey = s_nationkey",
)
def host_full_outer(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9500").groupBy(F.col("c_nationkey").alias("host")).agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("host")).agg(F.max("s_suppkey").alias("last_import"))
    return c.join(s, "host", "full_outer").select("host", zero("n").alias("counts"), "last_import")


@query(
    "live_union_imported",
    "SELECT doc_id, 'live' AS origin FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'imported' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
)
def live_union_imported(spark, sf_dir):
    live = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit("live").alias("origin"))
    rest = table(spark, sf_dir, "documents").select("doc_id").join(live, "doc_id", "left_anti").withColumn("origin", F.lit("imported"))
    return live.unionByName(rest)


@query(
    "enclosing_symbol",
    """
    WITH c AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS file, CAST(l_quantity AS BIGINT) AS line FROM lineitem),
    s AS (SELECT p_partkey AS symbol, p_partkey % 100 + 1 AS file, p_size % 30 AS a, p_size % 30 + 5 + p_partkey % 17 AS b FROM part)
    SELECT id, file, line, symbol FROM (SELECT id, c.file, line, symbol, row_number() OVER (PARTITION BY id, c.file, line ORDER BY b - a, a, symbol) AS r FROM c JOIN s ON c.file = s.file AND line BETWEEN a AND b) WHERE r = 1
    """,
)
def enclosing_symbol(spark, sf_dir):
    """The innermost symbol whose span holds a line: shortest span, then earliest start."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("file"), F.col("l_quantity").cast("long").alias("line"))
    start = F.col("p_size") % 30
    s = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), (F.col("p_partkey") % 100 + 1).alias("file"), start.cast("long").alias("a"), (start + 5 + F.col("p_partkey") % 17).alias("b"))
    hit = range_join(c, "line", s, "a", "b", ["file"], 16)
    return hit.groupBy("id", "file", "line").agg(F.min_by("symbol", F.struct(F.col("b") - F.col("a"), "a", "symbol")).alias("symbol"))


def containing(docs: DataFrame, blocks: DataFrame, key: str, text: str, block_key: str, block: str) -> DataFrame:
    """(``block_key``, ``key``) of texts that contain a block.

    A block of three words and more has words that any text with it holds whole, all but the first and the last: texts
    and blocks meet on the longest of these, and only for such pairs is the text fetched. Shorter blocks are looked up by
    their grams. Null and empty blocks are in no text.
    """
    cut = F.split(block, " ")
    inner = F.filter(F.slice(cut, 2, F.greatest(F.size(cut) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    anchored = blocks.select(block_key, block, F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("word"))
    anchors = anchored.where("word IS NOT NULL")
    d = docs.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word")).join(anchors.select("word").distinct(), "word", "left_semi")
    pairs = d.join(anchors, "word").select(block_key, block, key)
    hit = pairs.join(docs.select(key, text), key).where(F.contains(text, block)).select(block_key, key)
    short = anchored.where("word IS NULL").select(block_key, block)
    return hit.unionByName(gram_search(docs, short, key, text, block).join(short, block).select(block_key, key))


_BLOCKS_SQL = "SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, split_part(text, ' ', 1) FROM benchmark UNION ALL SELECT item_id + 2000000, split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3) FROM benchmark"


@query("block_usage_containment", f"SELECT item_id, count(doc_id) AS n FROM ({_BLOCKS_SQL}) b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def block_usage_containment(spark, sf_dir):
    """In how many texts a block occurs: whole passages, their first words, and pairs of words."""
    word = lambda i: F.get(F.split("text", " "), F.lit(i))
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    short = b.select(F.col("item_id") + 1_000_000, word(0)).union(b.select(F.col("item_id") + 2_000_000, F.concat(word(1), F.lit(" "), word(2))))
    b = b.union(short).withColumnRenamed("text", "block")
    hit = containing(table(spark, sf_dir, "documents"), b, "doc_id", "text", "item_id", "block").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n"))
    return b.select("item_id").join(hit, "item_id", "left").select("item_id", zero("n").alias("n"))


# ---------------------------------------------------------------- sets
@query(
    "padded_union",
    "SELECT n_nationkey AS id, n_name AS name, NULL::DOUBLE AS amount FROM nation UNION ALL SELECT s_nationkey, NULL, s_acctbal FROM supplier",
)
def padded_union(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_acctbal").alias("amount"))
    return n.unionByName(s, allowMissingColumns=True)


@query("distinct_union", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def distinct_union(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return l.where("toxic = 1").select("doc_id").union(l.where("quality = 0").select("doc_id")).distinct()


@query("intersect_and_except", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def intersect_and_except(spark, sf_dir):
    k = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("k"))
    return k("customer", "c_nationkey").intersect(k("supplier", "s_nationkey")).exceptAll(table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("k")))


@query(
    "token_set_jaccard",
    """
    WITH t AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(p_type), '[a-z0-9]+')) AS b FROM part)
    SELECT p_partkey, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 6) AS similarity FROM t
    """,
)
def token_set_jaccard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(jaccard(words(F.col("p_name")), words(F.col("p_type")), 1.0), 6).alias("similarity"))


# ---------------------------------------------------------------- filters
def conjunction(df: DataFrame, **conditions: Column | None) -> DataFrame:
    """Each condition that is given narrows ``df``; those that are None do not."""
    for condition in conditions.values():
        if condition is not None:
            df = df.where(condition)
    return df


@query("optional_filters", "SELECT event_id FROM events WHERE event_type = 'click' AND value >= 25 AND event_type <> 'session-auto-record'")
def optional_filters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return conjunction(e, kind=F.col("event_type") == "click", least=F.col("value") >= 25, user=None, auto=F.col("event_type") != "session-auto-record").select("event_id")


@query(
    "superset_tags",
    "WITH t AS (SELECT o_custkey, list(DISTINCT o_orderpriority) AS tags FROM orders GROUP BY 1) SELECT o_custkey FROM t WHERE list_has_all(tags, ['1-URGENT', '5-LOW'])",
)
def superset_tags(spark, sf_dir):
    t = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("tags"))
    return t.where(F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("5-LOW")), F.col("tags"))) == 0).select("o_custkey")


@query(
    "valid_at_instant",
    """
    WITH v AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts END AS valid_at, CASE WHEN event_id % 4 > 0 THEN ts + INTERVAL 5 DAY END AS invalid_at FROM events)
    SELECT event_id FROM v WHERE coalesce(valid_at <= TIMESTAMP '2024-01-12', true) AND coalesce(TIMESTAMP '2024-01-12' < invalid_at, true)
    """,
)
def valid_at_instant(spark, sf_dir):
    """Half-open validity; an open end holds for ever."""
    t = F.expr("TIMESTAMP_NTZ '2024-01-12'")
    v = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("valid_at"), F.when(F.col("event_id") % 4 > 0, F.expr("ts + INTERVAL 5 DAY")).alias("invalid_at"))
    return v.where(F.coalesce(F.col("valid_at") <= t, F.lit(True)) & F.coalesce(t < F.col("invalid_at"), F.lit(True))).select("event_id")


@query(
    "content_search_with_context",
    r"""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents)
    SELECT doc_id, CAST(no AS BIGINT) AS line_no, prev_line, line AS hit, next_line FROM (SELECT *, lag(substr(line, 1, 200)) OVER w AS prev_line, lead(substr(line, 1, 200)) OVER w AS next_line FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY no))
    WHERE regexp_matches(line, '(?i)licen[cs]ed? under|token = ')
    """,
)
def content_search_with_context(spark, sf_dir):
    """Lines that match, numbered from 1, with a line of context on each side. Neighbours come from the array of lines, without a shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("lines"))
    hit = d.select("doc_id", "lines", F.posexplode("lines").alias("at", "hit")).where(F.rlike("hit", F.lit("(?i)licen[cs]ed? under|token = ")))
    near = lambda k: F.substring(F.get("lines", F.col("at") + k), 1, 200)
    return hit.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), near(-1).alias("prev_line"), "hit", near(1).alias("next_line"))


@query(
    "merged_intervals",
    """
    WITH s AS (SELECT l_suppkey AS key, CAST(l_orderkey AS BIGINT) AS a, CAST(l_orderkey + l_quantity AS BIGINT) AS b FROM lineitem), w AS (SELECT *, max(b) OVER (PARTITION BY key ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM w)
    SELECT key, min(a) AS a, max(b) AS b, count(*) AS n FROM i GROUP BY key, island
    """,
)
def merged_intervals(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    s = l.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").cast("long").alias("a"), (F.col("l_orderkey") + F.col("l_quantity")).cast("long").alias("b"))
    return merge_intervals(dealt(s, l.count(), "key"), "key", "a", "b", 3)


# ---------------------------------------------------------------- sort, limit, top-k
@query("page_by_offset", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def page_by_offset(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20)


@query(
    "top_k_per_class",
    """
    SELECT class, key, n, place FROM (SELECT l_returnflag AS class, l_partkey AS key, count(*) AS n, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_partkey) AS place FROM lineitem GROUP BY 1, 2) WHERE place <= CASE class WHEN 'A' THEN 15 WHEN 'N' THEN 10 ELSE 20 END
    """,
)
def top_k_per_class(spark, sf_dir):
    counted = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("class"), F.col("l_partkey").alias("key")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("class").orderBy(F.desc("n"), "key")
    most = F.when(F.col("class") == "A", 15).when(F.col("class") == "N", 10).otherwise(20)
    # the constant bound lets Spark cut each group before the shuffle
    return counted.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20").where(F.col("place") <= most)


@query(
    "cheapest_with_hysteresis",
    """
    WITH c AS (SELECT l_suppkey % 10 AS phase, l_suppkey AS model, avg(l_extendedprice) AS cost, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 20), b AS (SELECT phase, min(model) AS incumbent FROM c GROUP BY 1),
    r AS (SELECT c.*, row_number() OVER (PARTITION BY phase ORDER BY cost, model) AS place FROM c)
    SELECT r.phase, CASE WHEN r.cost < i.cost * 0.9 THEN r.model ELSE i.model END AS chosen, round(r.cost, 4) AS best_cost, round(i.cost, 4) AS incumbent_cost FROM r JOIN b ON r.phase = b.phase JOIN c i ON i.phase = b.phase AND i.model = b.incumbent WHERE r.place = 1
    """,
)
def cheapest_with_hysteresis(spark, sf_dir):
    """The cheapest model of a phase replaces the incumbent only if it is cheaper by a tenth."""
    c = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("phase"), F.col("l_suppkey").alias("model")).agg(F.avg("l_extendedprice").alias("cost"), F.count("*").alias("n")).where("n >= 20")
    g = c.groupBy("phase").agg(F.min_by(F.struct("model", "cost"), F.struct("cost", "model")).alias("r"), F.min_by(F.struct("model", "cost"), "model").alias("i"))
    chosen = F.when(F.col("r.cost") < F.col("i.cost") * 0.9, F.col("r.model")).otherwise(F.col("i.model"))
    return g.select("phase", chosen.alias("chosen"), F.round("r.cost", 4).alias("best_cost"), F.round("i.cost", 4).alias("incumbent_cost"))


@query(
    "stable_demotion",
    """
    WITH h AS (SELECT source, doc_id, n_chars > 3000 AS is_doc, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97, doc_id) AS pos FROM documents), c AS (SELECT *, sum(CASE WHEN is_doc AND pos <= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY pos) AS docs FROM h)
    SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY is_doc AND pos <= 20 AND docs > 5, pos) AS place FROM c WHERE pos <= 20
    """,
)
def stable_demotion(spark, sf_dir):
    """At most a quarter of the head window are docs; the others of it follow the rest, in their order."""
    w = Window.partitionBy("source")
    h = table(spark, sf_dir, "documents").select("source", "doc_id", (F.col("n_chars") > 3000).alias("is_doc"), F.row_number().over(w.orderBy(F.col("n_chars") % 97, "doc_id")).alias("pos")).where("pos <= 20")
    c = h.withColumn("docs", F.sum(F.col("is_doc").cast("int")).over(w.orderBy("pos")))
    return c.select("source", "doc_id", F.row_number().over(w.orderBy(F.col("is_doc") & (F.col("docs") > 5), "pos")).cast("long").alias("place"))


@query("eviction_victims", "SELECT user_id, last_hit, hits FROM (SELECT user_id, max(ts) AS last_hit, count(*) AS hits FROM events GROUP BY 1) ORDER BY last_hit, hits, user_id LIMIT 25")
def eviction_victims(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_hit"), F.count("*").alias("hits")).orderBy("last_hit", "hits", "user_id").limit(25)


@query(
    "last_activity_order",
    "SELECT o_orderkey, coalesce(ended, updated, o_orderdate) AS active FROM (SELECT o_orderkey, o_orderdate, max(l_shipdate) FILTER (l_linestatus = 'F') AS ended, max(l_shipdate) AS updated FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) ORDER BY active DESC, o_orderkey LIMIT 30",
)
def last_activity_order(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("ended"), F.max("l_shipdate").alias("updated"))
    o = table(spark, sf_dir, "orders")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left").select("o_orderkey", F.coalesce("ended", "updated", "o_orderdate").alias("active")).orderBy(F.desc("active"), "o_orderkey").limit(30)
