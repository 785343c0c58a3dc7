"""Typed summaries: what kind of text it is, and the shape of JSON, CSV, logs and Markdown, of one text or of a whole table.

Shapes of a table are sketches that merge: a row for each path and type with counts, added up before the shuffle. A JSON text is
parsed once; its nodes are unfolded level by level in one pass, as deep as the deepest text goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_json
from ..registry import query
from ..sources.tables import table
from .compaction import DIAGNOSTICS

# Kinds by the end of a file's name.
KINDS = {
    "markdown": "md markdown mdx rst", "json": "json", "structured": "yaml yml toml ini cfg conf", "csv": "csv tsv", "log": "log",
    "code": "py js ts tsx jsx mjs cjs go rs java c h cpp cc hpp rb php cs swift kt scala sh sql",
}
SHOWN_KEYS = 12
#: Runs of so many equal lines count as one line of a log.
LEAST_RUN = 3


def kind_of(text: Column, path: Column) -> Column:
    """The kind of a text by its path's end, else by how it begins or whether it has a heading; ``prose`` if nothing tells."""
    end = F.regexp_extract(F.lower(F.coalesce(path, F.lit(""))), r"[^/]\.([a-z0-9]+)$", 1)
    out = F.when(F.lit(False), "")
    for kind, ends in KINDS.items():
        out = out.when(end.isin(ends.split()), kind)
    return out.when(F.rlike(text, F.lit(r"^\s*[{\[]")), "json").when(F.rlike(text, F.lit(r"(?m)^#{1,6}\s+\S")), "markdown").otherwise("prose")


# ---------------------------------------------------------------- JSON
def type_of(v: Column) -> Column:
    """The type of a variant: object, array, str, int, float, bool or null; null where there is no value."""
    s = F.schema_of_variant(v)  # a whole number beyond a long is a decimal without places, and so is 1.0, which is shorter
    return (
        F.when(F.startswith(s, F.lit("OBJECT")), "object").when(F.startswith(s, F.lit("ARRAY")), "array").when(s == "STRING", "str").when((s == "BIGINT") | F.rlike(s, F.lit(r"^DECIMAL\((?:19|[23]\d),0\)$")), "int")
        .when(s == "BOOLEAN", "bool").when(s == "VOID", "null").when(s.isNotNull(), "float")
    )


def depth_of(text: Column) -> Column:
    """How many containers that hold something stand around a JSON text's deepest value."""
    bare = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', "0"), r"\{\s*\}|\[\s*\]", "0")
    open_or_shut = F.regexp_extract_all(bare, F.lit(r"([{}\[\]])"))
    move = lambda s, b: F.struct((s["d"] + F.when(b.isin("{", "["), 1).otherwise(-1)).alias("d"), F.greatest(s["most"], s["d"] + F.when(b.isin("{", "["), 1).otherwise(-1)).alias("most"))
    return F.aggregate(open_or_shut, F.struct(F.lit(0).alias("d"), F.lit(0).alias("most")), move)["most"]


def _object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string, variant>")


def _array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def json_reports(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``shape``, ``depth``, ``samples`` of each text that is JSON: keys in their order with types, or the length and first type of an array, and the first three values.

    A text with a key twice in one object is not taken for JSON here.
    """
    rows = texts.select(key, F.col(text).alias("t"), F.when(is_json(F.col(text)), F.try_parse_json(text)).alias("v")).where("v IS NOT NULL")
    rows = rows.select(key, "t", "v", type_of(F.col("v")).alias("type"), depth_of(F.col("t")).alias("depth"), F.when(F.rlike("t", F.lit(r"^\s*\{")), F.json_object_keys("t")).alias("keys"), _object(F.col("v")).alias("o"), _array(F.col("v")).alias("a"))
    shown = F.array_join(F.transform(F.slice("keys", 1, SHOWN_KEYS), lambda k: F.concat(k, F.lit(": "), F.coalesce(type_of(F.element_at("o", k)), F.lit("null")))), ", ")
    more = F.when(F.size("keys") > SHOWN_KEYS, F.concat(F.lit(", …(+"), F.size("keys") - SHOWN_KEYS, F.lit(" more)"))).otherwise("")
    deep = F.concat(F.lit(", max depth "), "depth")
    of_object = F.concat(F.lit("object, "), F.size("keys"), F.lit(" top-level key(s) ["), shown, more, F.lit("]"), deep)
    of_array = F.concat(F.lit("array of "), F.size("a"), F.lit(" item(s) (element type: "), F.coalesce(type_of(F.get("a", F.lit(0))), F.lit("empty")), F.lit(")"), deep)
    shape = F.when(F.col("type") == "object", of_object).when(F.col("type") == "array", of_array).otherwise(F.concat(F.lit("scalar ("), "type", F.lit(")")))
    values = F.when(F.col("type") == "object", F.transform(F.slice("keys", 1, 3), lambda k: F.element_at("o", k))).when(F.col("type") == "array", F.slice("a", 1, 3)).otherwise(F.array("v"))
    short = lambda x: F.when(F.length(F.to_json(x)) > 200, F.concat(F.left(F.to_json(x), F.lit(200)), F.lit("…"))).otherwise(F.to_json(x))
    return rows.select(key, shape.alias("shape"), "depth", F.transform(values, short).alias("samples"))


def json_sketch(texts: DataFrame, text: str, example: int = 80) -> DataFrame:
    """``path``, ``type``, ``n``, ``example`` (the smallest, cut) over all texts that are JSON; array items are ``[]``."""
    rows = texts.select(F.col(text).alias("t"), F.when(is_json(F.col(text)), F.try_parse_json(text)).alias("v")).where("v IS NOT NULL")
    deepest = rows.agg(F.max(depth_of(F.col("t")))).head()[0] or 0
    node = lambda path, v: F.struct(path.alias("path"), type_of(v).alias("type"), F.left(F.to_json(v), F.lit(example)).alias("example"), v.alias("v"))
    nothing = F.lit(None).cast("variant")
    level = rows.select(node(F.lit("$"), F.col("v")).alias("x")).select("x.*")
    for _ in range(deepest):
        # a node stands for itself from now on, and its children are unfolded next
        own = F.array(F.struct("path", "type", "example", nothing.alias("v")))
        fields = F.transform(F.map_entries(_object(F.col("v"))), lambda e: node(F.concat(F.col("path"), F.lit("."), e["key"]), e["value"]))
        items = F.transform(_array(F.col("v")), lambda e: node(F.concat(F.col("path"), F.lit("[]")), e))
        unfolded = F.when(F.col("type") == "object", F.concat(own, fields)).when(F.col("type") == "array", F.concat(own, items)).otherwise(own)
        level = level.select(F.explode(F.when(F.col("v").isNull(), own).otherwise(unfolded)).alias("x")).select("x.*")
    return level.groupBy("path", "type").agg(F.count("*").alias("n"), F.min("example").alias("example"))


# ---------------------------------------------------------------- CSV
def fields_of(line: Column, delimiter: str = ",") -> Column:
    """Fields of a line, without the quotes around them; doubled quotes inside become one."""
    d = "\\" + delimiter
    # the line gets a delimiter in front, so that every field follows one
    found = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'{d}("(?:[^"]|"")*+"|[^{d}]*)'), F.lit(1))
    return F.transform(found, lambda f: F.when(F.startswith(f, F.lit('"')) & (F.length(f) > 1), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def csv_columns(texts: DataFrame, key: str, text: str, delimiter: str = ",") -> DataFrame:
    """``key``, ``column`` (from 1), ``name``, ``n``, ``filled``, ``type``, ``least``, ``most``: a row for each column of each text, whose first line is the head.

    The type is int, float or str by what all filled fields are, null if none is; rows may be shorter than the head. A quoted field
    ends with its line.
    """
    lines = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r?\n")).alias("n", "line"))
    head = lines.where((F.col("n") == 0) & (F.col("line") != "")).select(key, fields_of(F.col("line"), delimiter).alias("head"))
    body = lines.where((F.col("n") > 0) & (F.col("line") != "")).select(key, F.posexplode(fields_of(F.col("line"), delimiter)).alias("at", "x")).withColumn("x", F.nullif("x", F.lit("")))
    number = F.col("x").try_cast("double")
    sums = body.groupBy(key, "at").agg(F.count("*").alias("n"), F.count("x").alias("filled"), F.count(F.col("x").try_cast("bigint")).alias("ints"), F.count(number).alias("floats"), F.min("x").alias("least"), F.max("x").alias("most"), F.min(number).alias("low"), F.max(number).alias("high"))
    kind = F.when(F.coalesce("filled", F.lit(0)) == 0, None).when(F.col("ints") == F.col("filled"), "int").when(F.col("floats") == F.col("filled"), "float").otherwise("str")
    named = head.select(key, F.posexplode("head").alias("at", "name")).join(sums, [key, "at"], "left")
    numeric = kind.isin("int", "float")
    return named.select(key, (F.col("at") + 1).alias("column"), "name", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("filled", F.lit(0)).alias("filled"), kind.alias("type"), F.when(numeric, F.col("low").cast("string")).otherwise(F.col("least")).alias("least"), F.when(numeric, F.col("high").cast("string")).otherwise(F.col("most")).alias("most"))


# ---------------------------------------------------------------- logs
def log_reports(texts: DataFrame, key: str, text: str, context: int = 2) -> DataFrame:
    """``key``, ``lines``, ``folded`` (lines once runs of equal ones are two), ``tracebacks``, ``anomalies``, ``last`` (anomaly, cut), ``shown`` (lines within ``context`` of an anomaly).

    A run of three or more equal lines is one line and a note; a run of blank lines is one blank line.
    """
    lines = texts.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("p", "line"))
    w = Window.partitionBy(key).orderBy("p")
    runs = lines.withColumn("r", F.sum(F.when(F.lag("line").over(w) == F.col("line"), 0).otherwise(1)).over(w)).groupBy(key, "r").agg(F.count("*").alias("n"), F.first("line").alias("line"))
    blank = F.trim("line") == ""
    copies = F.when(F.col("n") < LEAST_RUN, F.array_repeat("line", F.col("n").cast("int"))).when(blank, F.array("line")).otherwise(F.array("line", F.concat(F.lit("... (line repeated "), "n", F.lit(" times) ..."))))
    folded = runs.select(key, "r", "n", F.posexplode(copies).alias("_k", "line"))
    odd = F.rlike("line", F.lit(f"(?i){DIAGNOSTICS}"))
    order = Window.partitionBy(key).orderBy("r", "_k")
    near = F.max(odd).over(order.rowsBetween(-context, context))
    marked = folded.select(key, "line", F.row_number().over(order).alias("at"), odd.alias("odd"), near.alias("near"), F.when(F.col("_k") == 0, F.col("n")).otherwise(0).alias("n"))
    return marked.groupBy(key).agg(
        F.sum("n").alias("lines"), F.count("*").alias("folded"), F.count_if(F.rlike("line", F.lit(r"(?i)^Traceback \(most recent call last\)"))).alias("tracebacks"), F.count_if("odd").alias("anomalies"),
        F.max_by(F.left(F.trim("line"), F.lit(200)), F.when(F.col("odd"), F.col("at"))).alias("last"), F.count_if("near").alias("shown"),
    )


# ---------------------------------------------------------------- Markdown
def heading_gists(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``at`` (the heading's line from 1, 0 for what comes before any), ``level``, ``heading``, ``gist``: the first two sentences below each heading."""
    lines = texts.select(key, F.posexplode(F.split(text, "\r?\n")).alias("p", "raw")).select(key, (F.col("p") + 1).alias("p"), F.regexp_replace("raw", r"\s+$", "").alias("line"))
    is_head = F.rlike("line", F.lit(r"^#{1,6}\s+\S"))
    w = Window.partitionBy(key).orderBy("p")
    owned = lines.withColumn("at", F.coalesce(F.last(F.when(is_head, F.col("p")), True).over(w), F.lit(0)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~is_head & (F.trim("line") != ""), F.struct("p", F.trim("line").alias("t"))))), lambda x: x.t), " ")
    g = owned.groupBy(key, "at").agg(F.max(F.when(is_head, F.col("line"))).alias("h"), body.alias("body"))
    flat = F.trim(F.regexp_replace("body", r"\s+", " "))
    gist = F.array_join(F.slice(F.split(flat, r"(?<=[.!?])\s+"), 1, 2), " ")
    found = g.select(key, "at", F.length(F.regexp_extract("h", "^(#+)", 1)).alias("level"), F.regexp_replace("h", r"^#+\s+", "").alias("heading"), gist.alias("gist"))
    return found.where((F.col("at") > 0) | (F.col("gist") != ""))


# ---------------------------------------------------------------- queries
_EVENT_JSON = """CASE WHEN event_id % 3 = 0 THEN '{"user": ' || user_id || ', "props": ' || props || ', "tags": ["' || event_type || '", 1.5, null, true]}' WHEN event_id % 3 = 1 THEN '[' || props || ', ' || user_id || ']' ELSE props END"""


@query(
    "json_sketch",
    f"""
    WITH t AS (SELECT event_id, user_id, event_type, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
    n AS (SELECT '$' AS path, CASE WHEN event_id % 3 = 1 THEN 'array' ELSE 'object' END AS type FROM t
      UNION ALL SELECT '$.' || CASE WHEN event_id % 3 = 0 THEN 'user' ELSE 'k' END, 'int' FROM t WHERE event_id % 3 <> 1
      UNION ALL SELECT unnest(['$.props', '$.props.k', '$.tags', '$.tags[]', '$.tags[]', '$.tags[]', '$.tags[]']), unnest(['object', 'int', 'array', 'str', 'float', 'null', 'bool']) FROM t WHERE event_id % 3 = 0
      UNION ALL SELECT unnest(['$[]', '$[].k', '$[]']), unnest(['object', 'int', 'int']) FROM t WHERE event_id % 3 = 1)
    SELECT path, type, count(*) AS n FROM n GROUP BY 1, 2
    """,
)
def json_sketch_query(spark, sf_dir):
    """Paths and types in the properties of all events, some of them inside objects and arrays."""
    return json_sketch(table(spark, sf_dir, "events").select(F.expr(_EVENT_JSON).alias("t")), "t").select("path", "type", "n")


@query(
    "json_shapes",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'object, 3 top-level key(s) [user: int, props: object, tags: array], max depth 2' WHEN 1 THEN 'array of 2 item(s) (element type: object), max depth 2' ELSE 'object, 1 top-level key(s) [k: int], max depth 1' END AS shape,
      CASE event_id % 3 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN replace(props, ' ', '') ELSE json_extract_string(props, '$.k') END AS first_sample FROM events
    """,
)
def json_shapes(spark, sf_dir):
    found = json_reports(table(spark, sf_dir, "events").select("event_id", F.expr(_EVENT_JSON).alias("t")), "event_id", "t")
    return found.select("event_id", "shape", F.get("samples", F.lit(0)).alias("first_sample"))


_ORDER_LINE = "l_linenumber || ',\"' || l_returnflag || ', \"\"' || l_linestatus || '\"\"\",' || l_quantity || ',' || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END"


@query(
    "csv_columns",
    """
    WITH n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linenumber % 2 <> 0) AS odd, min(l_linenumber) AS a, max(l_linenumber) AS b, min(l_returnflag || ', "' || l_linestatus || '"') AS c, max(l_returnflag || ', "' || l_linestatus || '"') AS d, min(l_quantity) AS e, max(l_quantity) AS f,
      min(l_partkey) FILTER (l_linenumber % 2 <> 0) AS g, max(l_partkey) FILTER (l_linenumber % 2 <> 0) AS h FROM lineitem GROUP BY 1)
    SELECT l_orderkey, unnest([1, 2, 3, 4]) AS "column", unnest(['line', 'flags', 'quantity', 'part, maybe']) AS name, n, unnest([n, n, n, odd]) AS filled, unnest(['int', 'str', 'float', CASE WHEN odd > 0 THEN 'int' END]) AS type,
      unnest([CAST(CAST(a AS DOUBLE) AS VARCHAR), c, CAST(e AS VARCHAR), CAST(CAST(g AS DOUBLE) AS VARCHAR)]) AS least, unnest([CAST(CAST(b AS DOUBLE) AS VARCHAR), d, CAST(f AS VARCHAR), CAST(CAST(h AS DOUBLE) AS VARCHAR)]) AS most FROM n
    """,
)
def csv_columns_query(spark, sf_dir):
    """An order's lines as a CSV text, with quoted fields and empty ones."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_ORDER_LINE).alias("line"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x.line), "\n")  # an order has few lines
    texts = l.groupBy("l_orderkey").agg(F.concat(F.lit('line,flags,quantity,"part, maybe"\n'), rows, F.lit("\n")).alias("t"))
    return csv_columns(texts, "l_orderkey", "t")


@query(
    "log_reports",
    f"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS line FROM documents),
    g AS (SELECT *, sum(CASE WHEN line = was THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY p) AS was FROM l)),
    n AS (SELECT doc_id, r, count(*) AS n, any_value(line) AS line FROM g GROUP BY 1, 2),
    f AS (SELECT doc_id, r, n, k, CASE WHEN n >= 3 AND k = 1 THEN '... (line repeated ' || n || ' times) ...' ELSE line END AS line FROM n, generate_series(0, CASE WHEN n < 3 THEN n - 1 WHEN trim(line) = '' THEN 0 ELSE 1 END) s(k)),
    m AS (SELECT *, regexp_matches(line, '(?i){DIAGNOSTICS.replace("'", "''")}') AS odd FROM f),
    o AS (SELECT *, max(odd) OVER (PARTITION BY doc_id ORDER BY r, k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, row_number() OVER (PARTITION BY doc_id ORDER BY r, k) AS pos FROM m)
    SELECT doc_id, CAST(sum(CASE WHEN k = 0 THEN n ELSE 0 END) AS BIGINT) AS lines, count(*) AS folded, count(*) FILTER (regexp_matches(line, '(?i)^Traceback \\(most recent call last\\)')) AS tracebacks, count(*) FILTER (odd) AS anomalies, md5(arg_max(left(trim(line), 200), pos) FILTER (odd)) AS last, count(*) FILTER (near) AS shown FROM o GROUP BY 1
    """,
)
def log_reports_query(spark, sf_dir):
    return log_reports(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("last", F.md5("last"))


@query(
    "text_kinds",
    r"""
    SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'markdown' WHEN 1 THEN 'structured' WHEN 2 THEN 'code' WHEN 3 THEN 'log' ELSE CASE WHEN regexp_matches(text, '^\s*[{\[]') THEN 'json' WHEN regexp_matches(text, '(^|\n)#{1,6}\s+\S') THEN 'markdown' ELSE 'prose' END END AS kind FROM documents
    """,
)
def text_kinds(spark, sf_dir):
    path = F.element_at(F.array(*(F.lit(x) for x in ("a/b.MD", "x.toml", "src/m.py", "run.log", "no_end", ".md", None))), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", kind_of(F.col("text"), path).alias("kind"))


@query(
    "heading_gists",
    r"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS raw FROM documents),
    h AS (SELECT doc_id, p, CASE WHEN p % 4 = 2 AND trim(raw) <> '' THEN '## ' || raw ELSE raw END AS line FROM l),
    c AS (SELECT doc_id, p, rtrim(line) AS line, regexp_matches(rtrim(line), '^#{1,6}\s+\S') AS head FROM h), o AS (SELECT *, coalesce(max(CASE WHEN head THEN p END) OVER (PARTITION BY doc_id ORDER BY p), 0) AS pos FROM c),
    g AS (SELECT doc_id, pos, max(line) FILTER (head) AS h, coalesce(trim(regexp_replace(string_agg(trim(line), ' ' ORDER BY p) FILTER (NOT head AND trim(line) <> ''), '\s+', ' ', 'g')), '') AS body FROM o GROUP BY 1, 2),
    s AS (SELECT *, string_split(regexp_replace(body, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM g)
    SELECT doc_id, pos AS "at", CAST(len(regexp_extract(h, '^(#+)', 1)) AS INTEGER) AS level, md5(regexp_replace(h, '^#+\s+', '')) AS heading, md5(array_to_string(parts[1:2], ' ')) AS gist FROM s WHERE pos > 0 OR body <> ''
    """,
)
def heading_gists_query(spark, sf_dir):
    """Documents with every fourth line as a heading."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when(((i + 1) % 4 == 2) & (F.trim(x) != ""), F.concat(F.lit("## "), x)).otherwise(x))
    found = heading_gists(table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("t")), "doc_id", "t")
    return found.withColumns({"heading": F.md5("heading"), "gist": F.md5("gist")})
