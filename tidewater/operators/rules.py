"""Findings, symbol histories, failure lessons, model names and prices, and the job queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ERROR_MARKS, error_fingerprint, marked_sql
from ..registry import query
from ..sources.tables import table


# ---------------------------------------------------------------- scope and models
def in_scope(agent: Column, tags: Column, who: str) -> Column:
    """Rows of one agent, and those tagged for any."""
    return F.coalesce(agent == who, F.lit(False)) | F.coalesce(F.array_contains(tags, "agent:any"), F.lit(False))


@query("scope_filter", "SELECT doc_id FROM documents WHERE coalesce(source = 'web', false) OR (doc_id % 7 = 0 AND coalesce(lang <> 'de', false))")
def scope_filter(spark, sf_dir):
    tags = F.when(F.col("doc_id") % 7 == 0, F.when(F.col("lang") != "de", F.array(F.col("lang"), F.lit("agent:any")))).otherwise(F.array(F.col("lang")))
    return table(spark, sf_dir, "documents").where(in_scope(F.col("source"), tags, "web")).select("doc_id")


# Names that stand for no model, vendors by prefix in their order.
PLACEHOLDERS = ("", "_default", "<synthetic>")
VENDORS = {"claude": "Anthropic", "gpt": "OpenAI", "o1": "OpenAI", "o3": "OpenAI", "o4": "OpenAI", "gemini": "Google", "mistral": "Mistral"}


def is_placeholder(model: Column) -> Column:
    return F.trim(F.coalesce(model, F.lit(""))).isin(*PLACEHOLDERS)


def vendor_of(model: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for prefix, vendor in VENDORS.items():
        out = out.when(F.startswith(F.lower(model), F.lit(prefix)), vendor)
    return out.otherwise("Unknown")


def price_rows(models: DataFrame, model: str, prices: DataFrame) -> DataFrame:
    """Each distinct name of ``models`` with ``priced_as``, ``price`` and ``approximate``.

    Names are tried in this order: as they stand, without their vendor path, with dots as dashes, without a trailing date
    and a trailing ``-preview`` or ``-latest``; then the known name that shares the longest run of dash-separated parts
    from the start (one at least; the last by name among equals). Placeholders and unknown names cost nothing.
    """
    m = F.col(model)
    tail = F.element_at(F.split(m, "/"), -1)
    dashed = F.replace(tail, F.lit("."), F.lit("-"))
    undated = F.regexp_replace(dashed, r"-\d{8}$|-\d{4}-\d{2}-\d{2}$", "")
    plain = F.regexp_replace(undated, "-(preview|latest)$", "")
    tries = models.select(model).distinct().select(model, F.posexplode(F.array(m, tail, dashed, undated, plain)).alias("step", "name"))
    p = prices.select(F.col("model").alias("priced_as"), "price")
    exact = tries.join(p, tries["name"] == p["priced_as"]).groupBy(model).agg(F.min_by(F.struct("priced_as", "price"), "step").alias("hit"))
    part = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "-"))), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(F.split(c, "-"), 1, i), "-").alias("start")))
    starts = lambda df, c: df.withColumn("part", F.explode(part(F.col(c)))).select("*", "part.n", "part.start")
    unmatched = tries.where("step = 4").join(exact, model, "left_anti").where(~is_placeholder(m))
    near = starts(unmatched, "name").join(starts(p, "priced_as").select("start", "priced_as", "price"), "start")
    near = near.groupBy(model).agg(F.max_by(F.struct("priced_as", "price"), F.struct("n", "priced_as")).alias("hit"))
    found = exact.withColumn("approximate", F.lit(False)).unionByName(near.withColumn("approximate", F.lit(True)))
    out = models.select(model).distinct().join(found, model, "left")
    return out.select(model, "hit.priced_as", F.coalesce("hit.price", F.lit(0.0)).alias("price"), F.coalesce("approximate", F.lit(False)).alias("approximate"))


# Names and prices for the query below.
_MODELS = ("claude-opus-4-7", "anthropic/claude-opus-4-7", "claude-opus-4.7-20260416", "gpt-5-mini-latest", "gpt-5-nano", "gemini-9-ultra-preview", "mistral", "<synthetic>", "o3", "other-model")
_PRICES = (("claude-opus-4-7", 5.0), ("gpt-5-mini", 0.25), ("gpt-5", 1.25), ("gemini-2-pro", 1.0), ("gemini-2-flash", 0.1), ("o3", 2.0))
_NAMES_SQL = f"list_value({', '.join(repr(m) for m in _MODELS)})"


@query(
    "model_prices",
    f"""
    WITH u AS (SELECT {_NAMES_SQL}[event_id % {len(_MODELS)} + 1] AS model, count(*) AS n FROM events GROUP BY 1), p(priced_as, price) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _PRICES)}),
    a AS (SELECT *, string_split(model, '/')[-1] AS tail FROM u), b AS (SELECT *, replace(tail, '.', '-') AS dashed FROM a),
    c AS (SELECT *, regexp_replace(dashed, '-[0-9]{{8}}$|-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', '') AS undated FROM b), d AS (SELECT *, regexp_replace(undated, '-(preview|latest)$', '') AS plain FROM c),
    e AS (SELECT d.*, coalesce((SELECT priced_as FROM p WHERE priced_as = model), (SELECT priced_as FROM p WHERE priced_as = tail), (SELECT priced_as FROM p WHERE priced_as = dashed), (SELECT priced_as FROM p WHERE priced_as = undated), (SELECT priced_as FROM p WHERE priced_as = plain)) AS hit FROM d),
    s AS (SELECT priced_as, i, array_to_string(string_split(priced_as, '-')[1:i], '-') AS start FROM (SELECT priced_as, unnest(range(1, len(string_split(priced_as, '-')) + 1)) AS i FROM p)),
    n AS (SELECT model, arg_max(priced_as, i * 1000 + ascii(priced_as) + 0.001 * ascii(priced_as[10:])) AS near FROM e JOIN s ON e.plain = s.start OR starts_with(e.plain, s.start || '-') WHERE hit IS NULL AND model NOT IN ('', '_default', '<synthetic>') GROUP BY 1)
    SELECT model, n, coalesce(hit, near) AS priced_as, coalesce(price, 0) AS price, hit IS NULL AND near IS NOT NULL AS approximate, model IN ('', '_default', '<synthetic>') AS placeholder,
      CASE WHEN starts_with(model, 'claude') THEN 'Anthropic' WHEN starts_with(model, 'gpt') OR starts_with(model, 'o3') THEN 'OpenAI' WHEN starts_with(model, 'gemini') THEN 'Google' WHEN starts_with(model, 'mistral') THEN 'Mistral' ELSE 'Unknown' END AS vendor
    FROM e LEFT JOIN n USING (model) LEFT JOIN p ON p.priced_as = coalesce(hit, near)
    """,
)
def model_prices(spark, sf_dir):
    """What each model name is priced as, whose it is, and whether it names a model at all."""
    named = table(spark, sf_dir, "events").select(F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("event_id") % len(_MODELS) + 1).cast("int")).alias("model"))
    used = named.groupBy("model").agg(F.count("*").alias("n"))
    priced = price_rows(used, "model", spark.createDataFrame(_PRICES, "model string, price double"))
    return used.join(priced, "model").select("*", is_placeholder(F.col("model")).alias("placeholder"), vendor_of(F.col("model")).alias("vendor"))


# ---------------------------------------------------------------- findings
def merge_findings(findings: DataFrame) -> DataFrame:
    """One finding for each (``rule``, ``file``, ``line``), the first by ``place``; ordered by severity, file, line, rule."""
    severity = F.coalesce(F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low", "info"))), F.col("severity")), F.lit(0))
    first = findings.groupBy("rule", "file", "line").agg(F.min_by(F.struct("severity", "scanner"), "place").alias("f")).select("rule", "file", "line", "f.*")
    return first.withColumn("order", F.when(severity == 0, 99).otherwise(severity - 1).cast("long")).orderBy("order", "file", "line", "rule")


# Rules for the query below, in the order in which their scanners run.
_RULES = (("credential", "high", r"(?i)(password|secret|token)\s*[:=]", "rules"), ("license", "low", "Apache License", "rules"), ("credential", "critical", r"(?i)password\s*[:=]", "taint"), ("mail", "notice", "@[a-z]+[.]", "taint"))


@query(
    "security_findings",
    f"""
    WITH l AS (SELECT doc_id AS file, string_split(text, '{chr(10)}') AS t FROM documents), n AS (SELECT file, unnest(t) AS txt, CAST(unnest(range(1, len(t) + 1)) AS BIGINT) AS line FROM l),
    f AS ({" UNION ALL ".join(f"SELECT '{r}' AS rule, file, line, '{s}' AS severity, '{w}' AS scanner, {i} AS place FROM n WHERE regexp_matches(txt, '{p}')" for i, (r, s, p, w) in enumerate(_RULES))}),
    o AS (SELECT rule, file, line, arg_min(severity, place) AS severity, arg_min(scanner, place) AS scanner FROM f GROUP BY 1, 2, 3)
    SELECT *, CAST(CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 99 END AS BIGINT) AS "order" FROM o
    """,
)
def security_findings(spark, sf_dir):
    """Findings of two scanners over all lines; where both report a rule for a line, the first one's stays."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "txt"))
    hits = F.array(*[F.when(F.rlike("txt", F.lit(p)), F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), F.lit(w).alias("scanner"), F.lit(i).alias("place"))) for i, (r, s, p, w) in enumerate(_RULES)])
    found = lines.select("file", (F.col("at") + 1).cast("long").alias("line"), F.explode(F.array_compact(hits)).alias("f")).select("file", "line", "f.*")
    return merge_findings(found)


# ---------------------------------------------------------------- symbols
@query(
    "edge_resolution",
    """
    WITH r AS (SELECT DISTINCT o_orderkey AS src, o_custkey AS home, substr(o_orderpriority, 1, 1) || '-' || (o_orderkey % 40) AS name FROM orders),
    d AS (SELECT DISTINCT o_custkey AS home, substr(o_orderpriority, 1, 1) || '-' || (o_orderkey % 40) AS name, min(o_orderkey) AS dst FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1, 2),
    u AS (SELECT name, min(dst) AS dst FROM d GROUP BY 1 HAVING count(*) <= 3),
    e AS (SELECT r.src, CASE WHEN d.dst IS NOT NULL THEN 'local' WHEN u.dst IS NOT NULL THEN 'unique' ELSE 'unresolved' END AS tier, coalesce(d.dst, u.dst) AS dst FROM r LEFT JOIN d USING (home, name) LEFT JOIN u ON u.name = r.name)
    SELECT tier, count(*) AS n, count(DISTINCT dst) AS targets FROM e GROUP BY 1
    """,
)
def edge_resolution(spark, sf_dir):
    """References resolved by tiers: in their own file, else by a name that few files define, else not; counts by tier."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("home"), F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), F.col("o_orderkey") % 40).alias("name"))
    refs = o.select(F.col("o_orderkey").alias("src"), "home", "name").distinct()
    defined = o.where("o_orderkey % 3 = 0").groupBy("home", "name").agg(F.min("o_orderkey").alias("local"))
    known = defined.groupBy("name").agg(F.min("local").alias("far"), F.count("*").alias("n")).where("n <= 3").drop("n")
    e = refs.join(defined, ["home", "name"], "left").join(known, "name", "left")
    tier = F.when(F.col("local").isNotNull(), "local").when(F.col("far").isNotNull(), "unique").otherwise("unresolved")
    return e.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("local", "far")).alias("targets"))


def graveyard(changes: DataFrame, keys: list[str], order: str, dead: Column) -> DataFrame:
    """``keys`` whose last change buried them, with when, and how often they had been changed before."""
    last = changes.groupBy(*keys).agg(F.max_by(dead, order).alias("dead"), F.max(order).alias("buried_at"), F.count("*").alias("changes"))
    return last.where("dead").drop("dead")


@query(
    "symbol_graveyard",
    "SELECT user_id, p AS name, buried_at, changes FROM (SELECT user_id, props AS p, arg_max(event_type = 'error', event_id) AS dead, max(event_id) AS buried_at, count(*) AS changes FROM events GROUP BY 1, 2) WHERE dead",
)
def symbol_graveyard(spark, sf_dir):
    """Symbols that were deleted and not added again."""
    e = table(spark, sf_dir, "events").withColumnRenamed("props", "name")
    return graveyard(e, ["user_id", "name"], "event_id", F.col("event_type") == "error")


# ---------------------------------------------------------------- lessons
def lesson_clusters(traces: DataFrame, least: int = 3, evidence: int = 8) -> DataFrame:
    """Candidates from failed traces (``domain``, ``error``, ``trace``) that share a domain and an error fingerprint.

    A cluster of ``least`` traces becomes a candidate; the newest ``evidence`` traces are its evidence. Groups are counted
    first, so that no more than the evidence of a group is ever held together.
    """
    f = traces.where("error IS NOT NULL AND error <> ''").withColumn("fingerprint", error_fingerprint(F.col("error")))
    sizes = f.groupBy("domain", "fingerprint").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    newest = Window.partitionBy("domain", "fingerprint").orderBy(F.desc("trace"))
    some = f.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= evidence)
    return sizes.join(some.groupBy("domain", "fingerprint").agg(F.sort_array(F.collect_list("trace")).alias("evidence")), ["domain", "fingerprint"])


_ERROR_SQL = "'Cannot open /tmp/' || user_id || ': code ' || (event_id % 3) || ' in ' || event_type"


@query(
    "lesson_candidates",
    f"""
    WITH f AS (SELECT user_id % 4 AS domain, substr({marked_sql(f"lower({_ERROR_SQL})", ERROR_MARKS)}, 1, 260) AS fingerprint, event_id AS trace FROM events WHERE event_type IN ('error', 'signup')),
    r AS (SELECT *, count(*) OVER (PARTITION BY domain, fingerprint) AS n, row_number() OVER (PARTITION BY domain, fingerprint ORDER BY trace DESC) AS place FROM f)
    SELECT domain, fingerprint, n, list(trace ORDER BY trace) AS evidence FROM r WHERE n >= 3 AND place <= 8 GROUP BY 1, 2, 3
    """,
)
def lesson_candidates(spark, sf_dir):
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    text = F.concat(F.lit("Cannot open /tmp/"), "user_id", F.lit(": code "), F.col("event_id") % 3, F.lit(" in "), "event_type")
    return lesson_clusters(e.select((F.col("user_id") % 4).alias("domain"), text.alias("error"), F.col("event_id").alias("trace")))


# ---------------------------------------------------------------- jobs
def reap(jobs: DataFrame, cutoff: Column) -> DataFrame:
    """Running jobs whose lease began before ``cutoff`` fail, or die if they have no attempt left."""
    lost = F.coalesce((F.col("status") == "running") & (F.col("locked_at") < cutoff), F.lit(False))
    status = F.when(lost, F.when(F.col("attempts") >= F.col("max_attempts"), "dead").otherwise("failed")).otherwise(F.col("status"))
    return jobs.withColumns({"status": status, "locked_at": F.when(~lost, F.col("locked_at")), "locked_by": F.when(~lost, F.col("locked_by")), "error": F.when(lost, "lease expired").otherwise(F.col("error"))})


def claim(jobs: DataFrame, worker: str, now: Column, many: int = 1) -> DataFrame:
    """The oldest ``many`` jobs that wait or failed and have an attempt left, as ``worker`` holds them from ``now`` on.

    Taking the first rows is a partial sort in every task; the table is not sorted as a whole.
    """
    ready = jobs.where("status IN ('pending', 'failed') AND attempts < max_attempts").orderBy("created_at", "id").limit(many)
    return ready.withColumns({"status": F.lit("running"), "attempts": F.col("attempts") + 1, "locked_by": F.lit(worker), "locked_at": now, "error": F.lit(None).cast("string")})


_JOBS_SQL = """
    SELECT o_orderkey AS id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'running' ELSE 'failed' END AS status, o_orderkey % 4 AS attempts, 3 AS max_attempts,
      CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS locked_at FROM orders
"""


@query(
    "leased_jobs",
    f"""
    WITH j AS ({_JOBS_SQL}), r AS (SELECT id, created_at, CASE WHEN status = 'running' AND locked_at < TIMESTAMP '1995-06-01' THEN CASE WHEN attempts >= max_attempts THEN 'dead' ELSE 'failed' END ELSE status END AS status, attempts, max_attempts FROM j)
    SELECT id, attempts + 1 AS attempts, 'running' AS status, 'w1' AS locked_by FROM r WHERE status IN ('pending', 'failed') AND attempts < max_attempts ORDER BY created_at, id LIMIT 25
    """,
)
def leased_jobs(spark, sf_dir):
    """Jobs with an expired lease are freed, then one worker claims the oldest 25."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "running").otherwise("failed")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), (F.col("o_orderkey") % 4).alias("attempts"), F.lit(3).alias("max_attempts"))
    running = F.col("status") == "running"
    jobs = jobs.withColumns({"locked_at": F.when(running, F.col("created_at")), "locked_by": F.when(running, "w0"), "error": F.lit(None).cast("string")})
    at = lambda day: F.to_timestamp_ntz(F.lit(f"{day} 00:00:00"), F.lit("yyyy-MM-dd HH:mm:ss"))
    return claim(reap(jobs, at("1995-06-01")), "w1", at("1995-06-02"), 25).select("id", "attempts", "status", "locked_by")


# ---------------------------------------------------------------- watched folders and cached windows
def to_ingest(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (``path``, ``mtime``) never seen, or changed since a run that succeeded or skipped them; failures are tried again."""
    done = seen.where("outcome IN ('success', 'skipped')").groupBy("path").agg(F.max_by("mtime", "at").alias("known"))
    return listing.join(done, "path", "left").where("known IS NULL OR known <> mtime").select("path", "mtime", F.col("known").isNull().alias("fresh"))


@query(
    "files_to_ingest",
    """
    WITH listing AS (SELECT p_name || '-' || p_partkey AS path, p_size AS mtime FROM part), seen AS (SELECT p_name || '-' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN p_size - 1 ELSE p_size END AS mtime, CASE p_partkey % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' ELSE 'success' END AS outcome FROM part WHERE p_partkey % 4 > 0)
    SELECT l.path, l.mtime, s.path IS NULL AS fresh FROM listing l LEFT JOIN (SELECT * FROM seen WHERE outcome <> 'failed') s USING (path) WHERE s.path IS NULL OR s.mtime <> l.mtime
    """,
)
def files_to_ingest(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("path", F.concat("p_name", F.lit("-"), "p_partkey"))
    outcome = F.when(F.col("p_partkey") % 5 == 0, "failed").when(F.col("p_partkey") % 5 == 1, "skipped").otherwise("success")
    mtime = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") - 1).otherwise(F.col("p_size"))
    seen = p.where("p_partkey % 4 > 0").select("path", mtime.alias("mtime"), outcome.alias("outcome"), F.lit(1).alias("at"))
    return to_ingest(p.select("path", F.col("p_size").alias("mtime")), seen)


def bump(cached: DataFrame, arrived: DataFrame, windows: dict[str, int], now: Column) -> DataFrame:
    """Cached totals (``window``, ``n``, ``total``) with each arrived row (``ts``, ``value``) added to every window that covers it."""
    days = F.datediff(now, "ts")
    inside = F.array_compact(F.array(*[F.when((days >= 0) & (days < n), F.lit(name)) for name, n in windows.items()]))
    rows = arrived.select(F.explode(inside).alias("window"), F.lit(1).cast("long").alias("n"), F.col("value").alias("total"))
    return cached.select("window", "n", "total").unionByName(rows).groupBy("window").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


_WINDOWS = {"today": 1, "week": 7, "month": 30}


@query(
    "bumped_windows",
    " UNION ALL ".join(f"SELECT '{k}' AS \"window\", count(*) AS n, round(sum(value), 6) AS total FROM events WHERE datediff('day', CAST(ts AS DATE), DATE '2024-01-30') BETWEEN 0 AND {n - 1}" for k, n in _WINDOWS.items()),
)
def bumped_windows(spark, sf_dir):
    """Totals cached from all but the newest events, brought up to date by those alone, equal a full count."""
    e, now = table(spark, sf_dir, "events").select("event_id", "ts", "value"), F.to_date(F.lit("2024-01-30"))
    new = F.col("event_id") % 10 == 0
    empty = spark.createDataFrame([(k, 0, 0.0) for k in _WINDOWS], "window string, n long, total double")
    cached = bump(empty, e.where(~new), _WINDOWS, now)
    return bump(cached, e.where(new), _WINDOWS, now).select("window", "n", F.round("total", 6).alias("total"))
