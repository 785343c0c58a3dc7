"""Pruning of lines by information, folding of recurring messages and long lines, maps by community, recall in sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import LOG_MARKS, log_signature, marked_sql, token_estimate
from ..registry import query
from ..shared import dealt
from ..sources.tables import table

# Tokens of a line, and phrases whose lines are never pruned.
LINE_TOKENS = r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\sA-Za-z0-9_]"
KEYSTONES = r"\b(only\s+(if|when|for|on)|unless|except|must\s+not|should\s+not|cannot|never|always|return|raise|assert|yield|if|elif|else|with|try|finally)\b"
# Starts of log lines that may be folded, and words of lines that may not.
LOG_STARTS = (
    r"^\s*(?:\[?(?:trace|debug|info|notice|warn(?:ing)?|error|fatal)\]?[: ]|\d{4}-\d{2}-\d{2}|\d{1,2}:\d{2}|"
    r"(?:downloading|downloaded|fetching|fetched|resolving|resolved|compiling|compiled|building|built|installing|installed|"
    r"linking|bundling|transpiling|generating|generated|checking|checked|copying|extracting|unpacking|uploading|uploaded|processing|processed)\b)"
)
DIAGNOSTICS = (
    r"\b(error|exception|traceback|fatal|panic|warning|deprecated|denied|refused|failed|failure|segfault|deadlock|cannot|can't|unable to|"
    r"undefined reference|not found|timed out|timeout|out of memory|oom|killed|permission|conflict)\b"
)


# ---------------------------------------------------------------- pruning
#: Bytes of lines of a task that counts their tokens, about.
TASK_BYTES = 16_000_000


def _by_line(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Lines dealt by their keys to tasks of about ``TASK_BYTES``: what is counted of a line afterwards is counted where it lies."""
    size = lines.agg(F.sum(F.octet_length(line))).first()[0] or 0
    return dealt(lines.select(*keys, line), size, *keys, task_rows=TASK_BYTES)


def line_signals_of(lines: DataFrame, keys: list[str], line: str, is_dealt: bool = False) -> DataFrame:
    """``keys``, ``n`` (tokens) and ``signal``: entropy and mean rarity of a line's tokens with a term for its length.

    Lines are shuffled and not their tokens, whose rows are many times larger; ``is_dealt`` says that they are dealt by their keys.
    """
    lines = lines if is_dealt else _by_line(lines, keys, line)
    words = lines.select(*keys, F.explode(F.regexp_extract_all(F.col(line), F.lit(f"({LINE_TOKENS})"))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias("c"))
    log = F.log2(F.col("c"))
    sums = words.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * log).alias("weighed"), F.avg(log).alias("mean"))
    n = F.col("n")
    return sums.select(*keys, "n", ((F.log2(n) - F.col("weighed") / n + F.log2(n) - F.col("mean") + F.log2(n + 1)) * F.log2(n + 2)).alias("signal"))


_LINES_SQL = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


@query(
    "line_signals",
    f"""
    WITH w AS (SELECT doc_id, pos, w, count(*) AS c FROM (SELECT doc_id, pos, unnest(regexp_extract_all(line, '{LINE_TOKENS}')) AS w FROM ({_LINES_SQL})) GROUP BY ALL),
    s AS (SELECT doc_id, pos, CAST(sum(c) AS BIGINT) AS n, sum(c * log2(c)) AS weighed, avg(log2(c)) AS mean FROM w GROUP BY 1, 2)
    SELECT doc_id, pos, n, round((log2(n) - weighed / n + log2(n) - mean + log2(n + 1)) * log2(n + 2), 6) AS signal FROM s
    """,
)
def line_signals(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", (F.col("pos") + 1).cast("long"))
    return line_signals_of(lines, ["doc_id", "pos"], "line").withColumn("signal", F.round("signal", 6))


def pruned_lines(lines: DataFrame, key: str, position: str, line: str, share: float) -> DataFrame:
    """The lines of each ``key`` that stay when it is cut to ``share`` of its tokens: all with a keystone, then by signal what still fits.

    A text within its target stays whole. What is folded in order of signal is one array of sizes for each text, not its lines.
    """
    own = _by_line(lines, [key, position], line)
    rows = own.join(line_signals_of(own, [key, position], line, is_dealt=True), [key, position], "left")
    rows = rows.withColumns({"n": F.coalesce("n", F.lit(0)), "signal": F.coalesce("signal", F.lit(0.0)), "_stone": F.coalesce(F.rlike(line, F.lit(f"(?i){KEYSTONES}")), F.lit(False))})
    item = F.struct((-F.round("signal", 9)).alias("s"), F.col(position).alias("at"), "n")
    held = rows.groupBy(key).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("_stone"), F.col("n")).otherwise(0)).alias("fixed"), F.array_sort(F.collect_list(F.when(~F.col("_stone"), item))).alias("x"))
    target = F.floor(F.col("all") * share)
    start = F.struct((target - F.col("fixed")).alias("left"), F.array().cast("array<boolean>").alias("kept"))
    fold = F.aggregate("x", start, lambda a, x: F.struct(F.when(x["n"] <= a["left"], a["left"] - x["n"]).otherwise(a["left"]).alias("left"), F.concat(a["kept"], F.array(x["n"] <= a["left"])).alias("kept")))["kept"]
    told = held.select(key, F.explode(F.arrays_zip("x", F.when(F.col("all") <= target, F.transform("x", lambda x: F.lit(True))).otherwise(fold).alias("kept"))).alias("z")).where("z.kept").select(key, F.col("z.x.at").alias(position))
    stones = rows.where("_stone").select(key, position)
    return lines.join(stones.unionByName(told), [key, position], "left_semi")


@query(
    "pruned_documents",
    f"""
    WITH l AS ({_LINES_SQL}), w AS (SELECT doc_id, pos, w, count(*) AS c FROM (SELECT doc_id, pos, unnest(regexp_extract_all(line, '{LINE_TOKENS}')) AS w FROM l) GROUP BY ALL),
    s AS (SELECT doc_id, pos, CAST(sum(c) AS BIGINT) AS n, sum(c * log2(c)) AS weighed, avg(log2(c)) AS mean FROM w GROUP BY 1, 2),
    r AS (SELECT l.doc_id, l.pos, line, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 0 ELSE (log2(n) - weighed / n + log2(n) - mean + log2(n + 1)) * log2(n + 2) END AS signal, regexp_matches(line, '(?i){KEYSTONES}') AS stone FROM l LEFT JOIN s USING (doc_id, pos)),
    t AS (SELECT doc_id, CAST(floor(sum(n) * 0.5) AS BIGINT) AS target, sum(n) AS total, CAST(coalesce(sum(n) FILTER (stone), 0) AS BIGINT) AS fixed, count(*) AS lines, count(*) FILTER (stone) AS stones, coalesce(CAST(sum(len(line)) FILTER (stone) AS BIGINT), 0) AS chars, list((n * 100000000 + len(line))::BIGINT ORDER BY round(signal, 9) DESC, pos) FILTER (NOT stone) AS x FROM r GROUP BY 1),
    f AS (SELECT *, CASE WHEN x IS NULL THEN [0, 0, 0] WHEN total <= target THEN [0, len(x), list_sum(list_transform(x, lambda v: v % 100000000))] ELSE list_reduce(list_prepend([target - fixed, 0, 0], list_transform(x, lambda v: [v])), lambda a, v: CASE WHEN v[1] // 100000000 <= a[1] THEN [a[1] - v[1] // 100000000, a[2] + 1, a[3] + v[1] % 100000000] ELSE a END) END AS y FROM t)
    SELECT doc_id, CAST(chars + y[3] + greatest(stones + y[2] - 1, 0) AS BIGINT) AS n_chars, CAST(stones + y[2] AS BIGINT) AS kept, CAST(lines - stones - y[2] AS BIGINT) AS dropped FROM f
    """,
)
def pruned_documents(spark, sf_dir):
    """Documents pruned towards half of their tokens."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    kept = pruned_lines(lines, "doc_id", "pos", "line", 0.5).groupBy("doc_id").agg(F.sum(F.length("line")).alias("c"), F.count("*").alias("k"))
    counts = lines.groupBy("doc_id").agg(F.count("*").alias("lines")).join(kept, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return counts.select("doc_id", (zero("c") + F.greatest(zero("k") - 1, F.lit(0))).cast("long").alias("n_chars"), zero("k").alias("kept"), (F.col("lines") - zero("k")).alias("dropped"))


# ---------------------------------------------------------------- log compaction
def fold_recurring(lines: DataFrame, key: str, position: str, line: str, least: int = 8) -> DataFrame:
    """Lines of each ``key`` with messages that recur ``least`` times or more, volatile parts aside, folded.

    First and last occurrence stay; the second becomes a note of how many were between them, the others go. Lines with a
    diagnosis and lines that do not look like a log stay as they are.
    """
    may = F.col(line).rlike(f"(?i){LOG_STARTS}") & ~F.col(line).rlike(f"(?i){DIAGNOSTICS}")
    marked = lines.withColumn("_sig", F.when(may, log_signature(F.col(line))))
    counts = marked.where("_sig <> ''").groupBy(key, "_sig").agg(F.count("*").alias("_n"), F.min(position).alias("_first"), F.max(position).alias("_last")).where(F.col("_n") >= least)
    joined = marked.join(counts, [key, "_sig"], "left")
    inner = joined.where(F.col("_n").isNotNull() & (F.col(position) > F.col("_first")) & (F.col(position) < F.col("_last")))
    second = inner.groupBy(key, "_sig", "_n").agg(F.min(position).alias(position))
    notes = second.select(key, position, F.concat(F.lit("... (message recurred "), F.col("_n") - 2, F.lit(" intermediate times) ...")).alias(line))
    whole = joined.where(F.col("_n").isNull() | (F.col(position) == F.col("_first")) | (F.col(position) == F.col("_last"))).select(key, position, line)
    return whole.unionByName(notes)


_EVENT_LINE = "CASE WHEN event_type = 'error' THEN 'error: ' ELSE 'info: ' END || event_type || CASE WHEN event_id % 50 = 0 THEN ' failed' ELSE '' END || ' took ' || (event_id % 97) || ' ms'"


@query(
    "recurring_messages",
    f"""
    WITH l AS (SELECT user_id, event_id, {_EVENT_LINE} AS line FROM events),
    m AS (SELECT *, CASE WHEN regexp_matches(line, '(?i){LOG_STARTS}') AND NOT regexp_matches(line, '(?i){DIAGNOSTICS.replace("'", "''")}') THEN trim(regexp_replace({marked_sql("line", LOG_MARKS)}, '\\s+', ' ', 'g')) END AS sig FROM l),
    w AS (SELECT *, count(*) OVER (PARTITION BY user_id, sig) AS n, row_number() OVER (PARTITION BY user_id, sig ORDER BY event_id) AS r FROM m)
    SELECT user_id, event_id, CASE WHEN sig IS NULL OR n < 8 OR r IN (1, n) THEN line ELSE '... (message recurred ' || (n - 2) || ' intermediate times) ...' END AS line FROM w WHERE sig IS NULL OR n < 8 OR r IN (1, 2, n)
    """,
)
def recurring_messages(spark, sf_dir):
    return fold_recurring(table(spark, sf_dir, "events").select("user_id", "event_id", F.expr(_EVENT_LINE).alias("line")), "user_id", "event_id", "line")


def bounded_line(line: Column, budget: int) -> Column:
    """A line within the limit that follows from the budget: both ends, with the length and digest of the whole."""
    limit = max(800, min(4000, budget // 2))
    head, tail = int(limit * 0.58), int(limit * 0.30)
    note = F.concat(F.lit(" [... "), F.length(line) - head - tail, F.lit(" chars omitted; sha256="), F.left(F.sha2(line, 256), F.lit(12)), F.lit(" ...] "))
    return F.when(F.length(line) <= limit, line).otherwise(F.concat(F.left(line, F.lit(head)), note, F.right(line, F.lit(tail))))


@query(
    "bounded_lines",
    f"""SELECT doc_id, pos, CASE WHEN len(line) <= 800 THEN line ELSE line[:463] || ' [... ' || (len(line) - 703) || ' chars omitted; sha256=' || sha256(line)[:12] || ' ...] ' || line[-240:] END AS line FROM ({_LINES_SQL})""",
)
def bounded_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), bounded_line(F.col("line"), 1600).alias("line"))


# ---------------------------------------------------------------- maps
def community(path: Column, deep: tuple[str, ...] = ("tests", "frontend", "landing", "services", "integrations", "benchmarks")) -> Column:
    """The first folder of a path, the first two below folders that hold many things, ``root`` for a file without a folder."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) <= 1, "root").when((F.size(parts) >= 3) & F.get(parts, F.lit(0)).isin(*deep), F.concat_ws("/", F.slice(parts, 1, 2))).otherwise(F.get(parts, F.lit(0)))


def full_map(symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``path``, ``kind``, ``community``, ``degree``) and edges (``src``, ``dst``, ``kind``) of a repository.

    ``symbols``: ``symbol``, ``path``; ``edges``: ``src``, ``dst`` of symbols. A file holds its symbols; edges count once.
    """
    symbol = lambda c: F.concat(F.lit("symbol:"), F.col(c))
    file = F.concat(F.lit("file:"), F.col("path"))
    holds = symbols.select(file.alias("src"), symbol("symbol").alias("dst"), F.lit("contains").alias("kind"))
    known = symbols.select("symbol")
    inside = edges.where("src <> dst").join(known.withColumnRenamed("symbol", "src"), "src", "left_semi").join(known.withColumnRenamed("symbol", "dst"), "dst", "left_semi")
    all_edges = holds.unionByName(inside.select(symbol("src").alias("src"), symbol("dst").alias("dst"), F.lit("calls").alias("kind"))).distinct()
    degree = all_edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    nodes = symbols.select(file.alias("id"), "path", F.lit("file").alias("kind")).distinct().unionByName(symbols.select(symbol("symbol").alias("id"), "path", F.lit("symbol").alias("kind")))
    return nodes.join(degree, "id", "left").select("id", "path", "kind", community(F.col("path")).alias("community"), F.coalesce("degree", F.lit(0)).alias("degree")), all_edges


_PATH = "CASE p_partkey % 4 WHEN 0 THEN 'm' || p_size || '.py' WHEN 1 THEN 'src/' || p_brand || '/m.py' WHEN 2 THEN 'tests/' || p_brand || '/m' || p_size || '.py' ELSE 'tests/m.py' END"


@query(
    "repository_map",
    f"""
    WITH s AS (SELECT p_partkey AS symbol, {_PATH} AS path FROM part), e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey AND l_suppkey IN (SELECT symbol FROM s) AND l_partkey IN (SELECT symbol FROM s)),
    a AS (SELECT DISTINCT 'file:' || path AS src, 'symbol:' || symbol AS dst FROM s UNION ALL SELECT 'symbol:' || src, 'symbol:' || dst FROM e), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM a UNION ALL SELECT dst FROM a) GROUP BY 1),
    n AS (SELECT DISTINCT 'file:' || path AS id, path, 'file' AS kind FROM s UNION ALL SELECT 'symbol:' || symbol, path, 'symbol' FROM s)
    SELECT id, path, kind, CASE WHEN len(string_split(path, '/')) <= 1 THEN 'root' WHEN len(string_split(path, '/')) >= 3 AND path LIKE 'tests/%' THEN string_split(path, '/')[1] || '/' || string_split(path, '/')[2] ELSE string_split(path, '/')[1] END AS community, coalesce(degree, 0) AS degree FROM n LEFT JOIN d USING (id)
    """,
)
def repository_map(spark, sf_dir):
    """Parts as symbols, and their suppliers' numbers as those that call them."""
    symbols = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("symbol"), F.expr(_PATH).alias("path"))
    return full_map(symbols, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))[0]


# ---------------------------------------------------------------- recall in sections
def recall_sections(sections: list[tuple[str, DataFrame]], by: str, most: int = 5, budget: int = 3000) -> DataFrame:
    """``by``, ``section``, ``place``, ``text``: the best rows of each section while the sum of tokens is within the budget.

    Sections are frames of (``by``, ``at``, ``text``), dearest first; larger ``at`` is better. The first row of the first
    section, the anchor, always stays. Each ``by`` has at most ``most`` rows a section when the sums are run.
    """
    parts = []
    for rank, (name, rows) in enumerate(sections):
        w = Window.partitionBy(by).orderBy(F.desc("at"), "text")
        parts.append(rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select(by, F.lit(rank).alias("_r"), F.lit(name).alias("section"), "place", "text"))
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    upto = F.sum(token_estimate(F.col("text"))).over(Window.partitionBy(by).orderBy("_r", "place"))
    return united.withColumn("_upto", upto).where((F.col("_upto") <= budget) | ((F.col("_r") == 0) & (F.col("place") == 1))).select(by, "section", "place", "text")


@query(
    "symbol_recall",
    """
    WITH a AS (SELECT p_partkey AS symbol, 0 AS r, 'definition' AS section, p_size AS "at", p_name || ' ' || p_type AS text FROM part UNION ALL
      SELECT l_partkey, 1, 'traces', l_orderkey, 'order ' || l_orderkey || ' line ' || l_linenumber FROM lineitem UNION ALL
      SELECT l_partkey, 2, 'tests', l_suppkey, 'returned ' || l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_returnflag = 'R'),
    b AS (SELECT *, row_number() OVER (PARTITION BY symbol, r ORDER BY "at" DESC, text) AS place FROM a QUALIFY place <= 5),
    c AS (SELECT *, sum(ceil(len(text) / 4)) OVER (PARTITION BY symbol ORDER BY r, place) AS upto FROM b)
    SELECT symbol, section, place, text FROM c WHERE upto <= 40 OR (r = 0 AND place = 1)
    """,
)
def symbol_recall(spark, sf_dir):
    p, l = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    definition = p.select(F.col("p_partkey").alias("symbol"), F.col("p_size").alias("at"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    traces = l.select(F.col("l_partkey").alias("symbol"), F.col("l_orderkey").alias("at"), F.concat(F.lit("order "), "l_orderkey", F.lit(" line "), "l_linenumber").alias("text"))
    tests = l.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("at"), F.concat(F.lit("returned "), "l_orderkey", F.lit("/"), "l_linenumber").alias("text"))
    return recall_sections([("definition", definition), ("traces", traces), ("tests", tests)], "symbol", budget=40)
