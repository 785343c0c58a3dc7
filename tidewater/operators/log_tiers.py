"""Folding of long outputs, tier by tier: repeated blocks of lines, phases of progress, tables, and records of JSON.

An output is the lines of one ``key`` by ``position``. Each tier takes and gives such lines, numbered anew from 1, and leaves an output as
it is where the folded form would not be shorter. A text is one window of lines; what recurs is found by comparing a line
with the one some places below, never by comparing all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_json
from ..registry import query
from ..shared import dealt
from ..sources.tables import table
from .compaction import DIAGNOSTICS

# Words that begin a line of progress, and lines that only part a table's head from its rows.
PROGRESS = (
    r"(?i)^\s*(?:\[[^]]+\]\s*)?(downloading|fetching|resolving|compiling|building|installing|linking|bundling|transpiling|"
    r"generating|checking|copying|extracting|unpacking|uploading|processing)\b"
)
SEPARATOR = r"^\s*(?:[-=+|:]\s*){4,}$"
WIDTHS, LEAST_REPEATS = (2, 3, 4, 5, 6), 3
LEAST_PHASE = 8
LEAST_TABLE, TABLE_HEAD, TABLE_TAIL = 32, 10, 6
LEAST_RECORDS, MOST_SHOWN = 24, 40
#: Lines of a task where outputs are dealt by hand, about.
TASK_LINES = 200_000


def diagnostic(line: Column) -> Column:
    return F.coalesce(F.rlike(line, F.lit(f"(?i){DIAGNOSTICS}")), F.lit(False))


def numbered(lines: DataFrame, key: str, position: str, line: str) -> DataFrame:
    """``key``, ``n`` from 1, ``line``; a null line is empty."""
    return lines.select(key, F.row_number().over(Window.partitionBy(key).orderBy(position)).alias("n"), F.coalesce(line, F.lit("")).alias("line"))


def if_shorter(before: DataFrame, after: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The lines of ``after`` (``key``, ``at``, ``line``), for each output whose text becomes shorter; else those of ``before``.

    With ``total``, the number of lines before, tasks are dealt by it."""
    size = lambda df, name: df.groupBy(key).agg(F.sum(F.length("line") + 1).alias(name))
    better = size(before, "a").join(size(after, "b"), key).where("b < a").select(key)
    kept = after.join(better, key).select(key, "at", "line").unionByName(before.join(better, key, "left_anti").select(key, F.struct(F.col("n").alias("n"), F.lit(0).alias("k")).alias("at"), "line"))
    if total is not None:
        kept = dealt(kept, total, key, task_rows=TASK_LINES)
    return kept.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).cast("long").alias("n"), "line")


def _at(n, k=0) -> Column:
    return F.struct(F.col(n).alias("n") if isinstance(n, str) else n.alias("n"), F.lit(k).alias("k")).alias("at")


# ---------------------------------------------------------------- repeated blocks
def repeats(rows: DataFrame, key: str) -> DataFrame:
    """``key``, ``first``, ``width``, ``times``: blocks of two to six lines that follow themselves three times or more.

    From the top down, the smallest width that fits at a line counts, and the search goes on behind the last repeat. A width
    fits where as many lines in a row as two blocks have equal those one block below; such stretches are found by lags, and
    only stretches that overlap are looked at together. Blocks with a diagnosis do not count.
    """
    w = Window.partitionBy(key).orderBy("n")
    fits = F.filter(F.array(*(F.when(F.lead("line", d).over(w) == F.col("line"), F.lit(d)) for d in WIDTHS)), lambda d: d.isNotNull())
    hits = rows.select(key, "n", diagnostic(F.col("line")).alias("bad"), fits.alias("fits")).select(key, "n", "bad", F.explode("fits").alias("width"))
    by_width = Window.partitionBy(key, "width").orderBy("n")
    stretch = hits.withColumn("s", F.col("n") - F.row_number().over(by_width)).groupBy(key, "width", "s").agg(F.min("n").alias("first"), F.count("*").cast("int").alias("run"), F.max("bad").alias("bad"))
    stretch = stretch.where(~F.col("bad") & (F.col("run") >= (LEAST_REPEATS - 1) * F.col("width"))).withColumn("end", F.col("first") + F.col("run") + F.col("width"))
    order = Window.partitionBy(key).orderBy("first", "width")
    apart = F.coalesce(F.col("first") >= F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    groups = stretch.withColumn("g", F.sum(apart.cast("int")).over(order)).groupBy(key, "g").agg(F.array_sort(F.collect_list(F.struct("first", "width", "run"))).alias("s"))
    none = F.array().cast("array<struct<first: int, width: int, times: int>>")

    def step(state, _):
        at = lambda x: F.greatest(x["first"], state["pos"])
        left = lambda x: x["run"] - (at(x) - x["first"])
        able = F.filter("s", lambda x: left(x) >= (LEAST_REPEATS - 1) * x["width"])
        best = F.array_min(F.transform(able, lambda x: F.struct(at(x).alias("first"), x["width"].alias("width"), (1 + F.floor(left(x) / x["width"])).cast("int").alias("times"))))
        return F.when(best.isNull(), state).otherwise(F.struct((best["first"] + best["width"] * best["times"]).alias("pos"), F.concat(state["picks"], F.array(best)).alias("picks")))

    # each stretch is taken once at most
    taken = F.aggregate("s", F.struct(F.lit(0).alias("pos"), none.alias("picks")), step)["picks"]
    return groups.select(key, F.explode(taken).alias("p")).select(key, "p.*")


def fold_blocks(lines: DataFrame, key: str, position: str, line: str) -> DataFrame:
    """Blocks that follow themselves stay once, with a note of how often they did."""
    rows = numbered(lines, key, position, line)
    gone = repeats(rows, key).select(key, "width", "times", F.explode(F.sequence(F.col("first") + F.col("width"), F.col("first") + F.col("width") * F.col("times") - 1)).alias("n"), (F.col("first") + F.col("width")).alias("note_at"))
    met = rows.join(gone, [key, "n"], "left").where(F.col("width").isNull() | (F.col("n") == F.col("note_at")))
    note = F.concat(F.lit("... ("), F.col("times") - 1, F.lit(" repeated "), "width", F.lit("-line blocks; "), (F.col("times") - 1) * F.col("width"), F.lit(" lines omitted) ..."))
    return if_shorter(rows, met.select(key, _at("n"), F.when(F.col("width").isNull(), F.col("line")).otherwise(note).alias("line")), key)


# ---------------------------------------------------------------- phases of progress
def fold_progress(lines: DataFrame, key: str, position: str, line: str, total: int | None = None) -> DataFrame:
    """Of eight or more lines of one phase in a row the first and last two stay, with a note between."""
    rows = numbered(lines, key, position, line)
    w = Window.partitionBy(key).orderBy("n")
    phase = F.when(~diagnostic(F.col("line")), F.nullif(F.lower(F.regexp_extract("line", PROGRESS, 1)), F.lit("")))
    marked = rows.withColumn("phase", phase)
    new = F.col("phase").isNull() | ~F.coalesce(F.lag("phase").over(w) == F.col("phase"), F.lit(False))
    marked = marked.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(w))
    whole = Window.partitionBy(key, "run")
    placed = marked.withColumns({"size": F.count("*").over(whole), "i": F.row_number().over(whole.orderBy("n"))})
    long = (F.col("size") >= LEAST_PHASE) & F.col("phase").isNotNull()
    placed = placed.where(~long | (F.col("i") <= 3) | (F.col("i") > F.col("size") - 2))
    note = F.concat(F.lit("... ("), F.col("size") - 4, F.lit(" "), "phase", F.lit(" progress lines omitted) ..."))
    return if_shorter(rows, placed.select(key, _at("n"), F.when(long & (F.col("i") == 3), note).otherwise(F.col("line")).alias("line")), key, total)


# ---------------------------------------------------------------- tables
def table_shape(line: Column) -> Column:
    """``kind`` and ``columns`` of a line that looks like a row; null for others and for separators."""
    trimmed = F.regexp_replace(line, r"^\s+|\s+$", "")
    pipes, tabs, gaps = F.length(line) - F.length(F.replace(line, F.lit("|"))), F.length(line) - F.length(F.replace(line, F.lit("\t"))), F.size(F.split(trimmed, r"\s{2,}"))
    shape = lambda kind, n: F.struct(F.lit(kind).alias("kind"), n.cast("int").alias("columns"))
    return F.when((trimmed == "") | F.rlike(line, F.lit(SEPARATOR)), None).when(pipes >= 2, shape("pipe", pipes + 1)).when(tabs >= 2, shape("tab", tabs + 1)).when(gaps >= 3, shape("spaces", gaps))


def sample_tables(lines: DataFrame, key: str, position: str, line: str, budget: int) -> DataFrame:
    """Of an output beyond the budget, three quarters of whose 32 or more lines have one shape, the first ten and last six lines stay.

    The shape that most lines have counts, the one seen first if several do. An output with a diagnosis stays whole.
    """
    rows = numbered(lines, key, position, line)
    marked = rows.withColumn("shape", table_shape(F.col("line")))
    size = marked.groupBy(key).agg(F.count("*").alias("lines"), F.sum(F.length("line") + 1).alias("chars"), F.max(diagnostic(F.col("line"))).alias("bad"))
    shapes = marked.where("shape IS NOT NULL").groupBy(key, "shape").agg(F.count("*").alias("c"), F.min("n").alias("first"))
    best = shapes.groupBy(key).agg(F.max(F.struct("c", (-F.col("first")).alias("f"), "shape")).alias("b"))
    long = size.join(best, key).where((F.col("chars") - 1 > budget) & (F.col("lines") >= LEAST_TABLE) & ~F.col("bad") & (F.col("b.c") >= F.floor(F.col("lines") * 0.75)) & (F.col("lines") - TABLE_HEAD - TABLE_TAIL > 8))
    met = rows.join(long.select(key, "lines", F.col("b.shape.columns").alias("columns")), key, "left")
    met = met.where(F.col("lines").isNull() | (F.col("n") <= TABLE_HEAD + 1) | (F.col("n") > F.col("lines") - TABLE_TAIL))
    note = F.concat(F.lit("... ("), F.col("lines") - TABLE_HEAD - TABLE_TAIL, F.lit(" table rows omitted; shape="), "columns", F.lit(" cols) ..."))
    return if_shorter(rows, met.select(key, _at("n"), F.when(F.col("lines").isNotNull() & (F.col("n") == TABLE_HEAD + 1), note).otherwise(F.col("line")).alias("line")), key)


# ---------------------------------------------------------------- records of JSON
def sample_records(lines: DataFrame, key: str, position: str, line: str, budget: int, total: int | None = None) -> DataFrame:
    """Of an output beyond the budget that is 24 or more lines of JSON objects and arrays, the first three, the last two and those with a diagnosis stay behind a note.

    It stays whole if more than 40 lines would.
    """
    rows = numbered(lines, key, position, line)
    full = rows.where(F.trim("line") != "")
    w = Window.partitionBy(key).orderBy("n")
    full = full.withColumns({"i": F.row_number().over(w), "records": F.count("*").over(Window.partitionBy(key))})
    shown = (F.col("i") <= 3) | (F.col("i") > F.col("records") - 2) | diagnostic(F.col("line"))
    is_record = F.rlike("line", F.lit(r"^\s*[{\[]")) & is_json(F.col("line"))
    size = rows.groupBy(key).agg(F.sum(F.length("line") + 1).alias("chars"))
    fit = full.groupBy(key).agg(F.count("*").alias("all"), F.count_if(is_record).alias("ok"), F.count_if(shown).alias("shown")).join(size, key)
    fit = fit.where((F.col("chars") - 1 > budget) & (F.col("all") >= LEAST_RECORDS) & (F.col("ok") == F.col("all")) & (F.col("shown") <= MOST_SHOWN)).select(key, "all", "shown")
    note = F.concat(F.lit("... ("), F.col("all") - F.col("shown"), F.lit(" NDJSON records omitted; "), "shown", F.lit("/"), "all", F.lit(" shown) ..."))
    after = full.where(shown).join(fit, key).select(key, _at("n", 1), "line").unionByName(fit.select(key, _at(F.lit(0)), note.alias("line")))
    return if_shorter(rows, after.unionByName(rows.join(fit, key, "left_anti").select(key, _at("n", 1), "line")), key, total)


# ---------------------------------------------------------------- queries
_WIDE = ", ".join(f"({w})" for w in WIDTHS)


def _blocks_sql(lines: str) -> str:
    """The walk from the top down, a step at a time; ``lines`` gives k, n, line."""
    stop = DIAGNOSTICS.replace("'", "''")
    return f"""
    WITH RECURSIVE l AS ({lines}), c AS (SELECT k, max(n) AS last FROM l GROUP BY 1),
    e AS (SELECT a.k, a.n, w, CASE WHEN b.line = a.line THEN NULL ELSE a.n END AS miss, regexp_matches(a.line, '(?i){stop}') AS bad FROM l a CROSS JOIN (VALUES {_WIDE}) t(w) LEFT JOIN l b ON b.k = a.k AND b.n = a.n + w),
    r AS (SELECT k, n, w, min(miss) OVER (PARTITION BY k, w ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - n AS run FROM e),
    d AS (SELECT k, n, bad, coalesce(max(CASE WHEN bad THEN n END) OVER (PARTITION BY k ORDER BY n), 0) AS last_bad FROM e WHERE w = 2),
    f AS (SELECT r.k, r.n, w, 1 + run // w AS times FROM r JOIN d ON d.k = r.k AND d.n = r.n + r.w - 1 WHERE run >= 2 * w AND last_bad < r.n),
    g AS (SELECT k, n, min(w) AS w, arg_min(times, w) AS times FROM f GROUP BY 1, 2),
    walk AS (SELECT k, CAST(1 AS BIGINT) AS n FROM c UNION ALL SELECT walk.k, CAST(walk.n + coalesce(g.w * g.times, 1) AS BIGINT) FROM walk JOIN c USING (k) LEFT JOIN g ON g.k = walk.k AND g.n = walk.n WHERE walk.n < last),
    p AS (SELECT g.* FROM walk JOIN g USING (k, n)),
    o AS (SELECT l.k, l.n, CASE WHEN p.n IS NULL THEN line ELSE '... (' || (times - 1) || ' repeated ' || w || '-line blocks; ' || ((times - 1) * w) || ' lines omitted) ...' END AS line
      FROM l LEFT JOIN p ON p.k = l.k AND l.n >= p.n + w AND l.n < p.n + w * times WHERE p.n IS NULL OR l.n = p.n + w),
    s AS (SELECT k FROM (SELECT k, sum(len(line) + 1) AS b FROM o GROUP BY 1) JOIN (SELECT k, sum(len(line) + 1) AS a FROM l GROUP BY 1) USING (k) WHERE b < a)
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) AS n, line FROM (SELECT * FROM o WHERE k IN (SELECT k FROM s) UNION ALL SELECT k, n, line FROM l WHERE k NOT IN (SELECT k FROM s))
    """


@query("repeated_blocks", _blocks_sql("SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE event_type WHEN 'click' THEN 'pressed a button on the page' WHEN 'error' THEN 'an error, again' ELSE 'looked at a page for a while' END AS line FROM events"))
def repeated_blocks(spark, sf_dir):
    """A user's events as lines of an output: one line for clicks, one for errors, one for all else."""
    said = F.when(F.col("event_type") == "click", "pressed a button on the page").when(F.col("event_type") == "error", "an error, again").otherwise("looked at a page for a while")
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("at"), said.alias("line"))
    return fold_blocks(e, "user_id", "at", "line").withColumnRenamed("user_id", "k")


@query(
    "folded_document_blocks",
    "SELECT k, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY n)) AS digest FROM ("
    + _blocks_sql("SELECT doc_id AS k, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents")
    + ") GROUP BY 1",
)
def folded_document_blocks(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = fold_blocks(lines, "doc_id", "pos", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")
    return out.groupBy(F.col("doc_id").alias("k")).agg(F.count("*").alias("lines"), F.md5(text).alias("digest"))


@query(
    "folded_progress",
    """
    WITH l AS (SELECT user_id, row_number() OVER w AS n, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'Fetching ' || event_id ELSE '[' || event_id % 7 || '] compiling unit ' || event_id END AS line, CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 'fetching' ELSE 'compiling' END AS phase FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    g AS (SELECT *, sum(CASE WHEN phase = was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS run FROM (SELECT *, lag(phase) OVER (PARTITION BY user_id ORDER BY n) AS was FROM l)),
    p AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS size, row_number() OVER (PARTITION BY user_id, run ORDER BY n) AS i FROM g),
    o AS (SELECT user_id, n, CASE WHEN phase IS NOT NULL AND size >= 8 AND i = 3 THEN '... (' || (size - 4) || ' ' || phase || ' progress lines omitted) ...' ELSE line END AS line FROM p WHERE phase IS NULL OR size < 8 OR i <= 3 OR i > size - 2),
    s AS (SELECT user_id FROM (SELECT user_id, sum(len(line) + 1) AS b FROM o GROUP BY 1) JOIN (SELECT user_id, sum(len(line) + 1) AS a FROM l GROUP BY 1) USING (user_id) WHERE b < a)
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS n, line FROM (SELECT * FROM o WHERE user_id IN (SELECT user_id FROM s) UNION ALL SELECT user_id, n, line FROM l WHERE user_id NOT IN (SELECT user_id FROM s))
    """,
)
def folded_progress(spark, sf_dir):
    """A user's events as a build: errors fail, purchases fetch, all else compiles."""
    said = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", F.concat(F.lit("Fetching "), "event_id")).otherwise(F.concat(F.lit("["), F.col("event_id") % 7, F.lit("] compiling unit "), "event_id"))
    e = table(spark, sf_dir, "events")
    total = e.count()
    return fold_progress(dealt(e.select("user_id", F.struct("ts", "event_id").alias("at"), said.alias("line")), total, "user_id", task_rows=TASK_LINES), "user_id", "at", "line", total)


_ROW = "CASE WHEN l_suppkey % 4 = 3 AND l_linenumber > 3 THEN 'a line of prose' WHEN l_suppkey % 3 = 0 THEN l_orderkey || '|' || l_partkey || '|' || l_quantity::INT WHEN l_suppkey % 3 = 1 THEN l_orderkey || '  ' || l_partkey || '   ' || l_returnflag ELSE l_orderkey || chr(9) || l_partkey || chr(9) || l_linestatus END"


@query(
    "sampled_tables",
    f"""
    WITH l AS (SELECT l_suppkey AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n, {_ROW} AS line FROM lineitem),
    c AS (SELECT k, count(*) AS lines, sum(len(line) + 1) - 1 AS chars, count(*) FILTER (line NOT LIKE '%prose') AS same FROM l GROUP BY 1),
    f AS (SELECT k, lines FROM c WHERE chars > 2000 AND lines >= 32 AND same >= CAST(floor(lines * 0.75) AS BIGINT))
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) AS n, CASE WHEN f.k IS NOT NULL AND n = 11 THEN '... (' || (lines - 16) || ' table rows omitted; shape=3 cols) ...' ELSE line END AS line FROM l LEFT JOIN f USING (k) WHERE f.k IS NULL OR n <= 11 OR n > lines - 6
    """,
)
def sampled_tables(spark, sf_dir):
    """A supplier's lines as a table, by pipes, gaps or tabs; every fourth supplier has prose between."""
    row = F.expr(_ROW.replace("l_quantity::INT", "CAST(l_quantity AS INT)"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("at"), row.alias("line"))
    return sample_tables(lines, "k", "at", "line", 2000)


@query(
    "sampled_records",
    """
    WITH l AS (SELECT user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN '{"failed":' || event_id || '}' WHEN user_id % 6 = 1 AND event_id % 50 = 0 THEN 'no json' ELSE props END AS line FROM events),
    b AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY k) AS records FROM l WINDOW w AS (PARTITION BY k ORDER BY n)),
    m AS (SELECT *, i <= 3 OR i > records - 2 OR line LIKE '%failed%' AS shown FROM b),
    f AS (SELECT k, count(*) AS total, count(*) FILTER (shown) AS s FROM m GROUP BY 1 HAVING sum(len(line) + 1) - 1 > 200 AND total >= 24 AND s <= 40 AND bool_and(line <> 'no json')),
    o AS (SELECT m.k, n, line FROM m JOIN f USING (k) WHERE shown UNION ALL SELECT k, 0, '... (' || (total - s) || ' NDJSON records omitted; ' || s || '/' || total || ' shown) ...' FROM f),
    z AS (SELECT k FROM (SELECT k, sum(len(line) + 1) AS b FROM o GROUP BY 1) JOIN (SELECT k, sum(len(line) + 1) AS a FROM l GROUP BY 1) USING (k) WHERE b < a)
    SELECT k, row_number() OVER (PARTITION BY k ORDER BY n) AS n, line FROM (SELECT * FROM o WHERE k IN (SELECT k FROM z) UNION ALL SELECT k, n, line FROM l WHERE k NOT IN (SELECT k FROM z))
    """,
)
def sampled_records(spark, sf_dir):
    """A user's properties as lines of JSON, some of which tell of a failure and, for some users, are no JSON."""
    line = F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), F.concat(F.lit('{"failed":'), "event_id", F.lit("}"))).when((F.col("user_id") % 6 == 1) & (F.col("event_id") % 50 == 0), "no json").otherwise(F.col("props"))
    e = table(spark, sf_dir, "events")
    total = e.count()
    return sample_records(dealt(e.select(F.col("user_id").alias("k"), F.struct("ts", "event_id").alias("at"), line.alias("line")), total, "k", task_rows=TASK_LINES), "k", "at", "line", 200, total)
