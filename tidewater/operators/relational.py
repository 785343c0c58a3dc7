"""Relational analytics over sessions, usage rows and telemetry: sums, histograms, rollups, drift, reducers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ERROR_MARKS, bucket, days_of, error_fingerprint, marked_sql, zero
from ..registry import query
from ..sources.tables import table


@query(
    "daily_event_rollup",
    """
    SELECT *, row_number() OVER (ORDER BY total_value DESC, day) AS value_rank FROM (
      SELECT CAST(ts AS DATE) AS day, count(*) AS n_events, count(DISTINCT user_id) AS n_users,
        round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate, round(sum(value), 6) AS total_value
      FROM events GROUP BY 1)
    """,
)
def daily_event_rollup(spark, sf_dir):
    daily = (
        table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.round(F.avg((F.col("event_type") == "error").cast("double")), 6).alias("error_rate"), F.round(F.sum("value"), 6).alias("total_value"))
    )
    # one row a day: the global rank is over a few rows
    return daily.withColumn("value_rank", F.row_number().over(Window.orderBy(F.desc("total_value"), "day")).cast("long"))


@query(
    "global_summary",
    """
    SELECT count(*) AS n, round(coalesce(sum(l_extendedprice), 0), 4) AS cost, round(coalesce(avg(l_discount), 0), 4) AS mean_discount,
      round(coalesce(avg(l_quantity), 0), 1) AS mean_quantity,
      round(coalesce(sum(CASE WHEN l_quantity < 0 THEN l_tax END), 0), 4) AS nothing
    FROM lineitem
    """,
)
def global_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count("*").alias("n"), F.round(zero(F.sum("l_extendedprice")), 4).alias("cost"), F.round(zero(F.avg("l_discount")), 4).alias("mean_discount"),
        F.round(zero(F.avg("l_quantity")), 1).alias("mean_quantity"), F.round(zero(F.sum(F.when(F.col("l_quantity") < 0, F.col("l_tax")))), 4).alias("nothing"),
    )


@query(
    "sums_by_provider",
    """
    SELECT l_returnflag AS provider, count(*) AS n, round(sum(l_quantity), 4) AS tokens, round(sum(l_extendedprice), 4) AS cost, round(sum(l_extendedprice * l_discount), 4) AS saved
    FROM lineitem GROUP BY 1
    """,
)
def sums_by_provider(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("provider")).agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("tokens"), F.round(F.sum("l_extendedprice"), 4).alias("cost"), F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("saved")
    )


@query(
    "status_histogram",
    """
    SELECT o_orderstatus AS status, count(*) AS n, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS domains FROM orders GROUP BY 1
    """,
)
def status_histogram(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("domains"))


@query(
    "json_field_sums",
    """
    SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k_sum, count(json_extract_string(props, '$.missing')) AS n_missing
    FROM events GROUP BY 1
    """,
)
def json_field_sums(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"), F.count(F.get_json_object("props", "$.missing")).alias("n_missing"))


def collapse_duplicates(rows: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """The row with the largest rank tuple of each group; one shuffle, with partial aggregation before it."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*rank)).alias("best")).select(*keys, "best.*")


_SESSIONS = """
  SELECT user_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY value DESC, event_id DESC) AS r FROM events
"""


def best_sessions(spark, sf_dir) -> DataFrame:
    """One session for each user and day, the duplicate of best rank; those without usage are dropped."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "event_type", "event_id", "value")
    return collapse_duplicates(e, ["user_id", "day"], [F.col("value"), F.col("event_id")]).where(F.col("value") > 0)


@query("collapse_duplicates", f"SELECT user_id, day, hour, event_type, event_id, value FROM ({_SESSIONS}) WHERE r = 1 AND value > 0")
def collapse_duplicates_query(spark, sf_dir):
    return best_sessions(spark, sf_dir)


@query(
    "analytics_dashboard",
    f"""
    WITH s AS (SELECT * FROM ({_SESSIONS}) WHERE r = 1 AND value > 0), facets AS (
      SELECT 'daily' AS facet, CAST(day AS VARCHAR) AS key, count(*) AS n, round(sum(value), 6) AS cost FROM s GROUP BY 2
      UNION ALL SELECT 'hourly', CAST(hour AS VARCHAR), count(*), round(sum(value), 6) FROM s GROUP BY 2
      UNION ALL SELECT 'model', event_type, count(*), round(sum(value), 6) FROM s GROUP BY 2
      UNION ALL SELECT 'session', CAST(event_id AS VARCHAR), count(*), round(sum(value), 6) FROM s GROUP BY 2
      UNION ALL SELECT 'monthly', 'projection', count(DISTINCT day), round(sum(value) * 30 / count(DISTINCT day), 6) FROM s
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY cost DESC, key) AS place FROM facets)
    SELECT * FROM ranked WHERE facet IN ('daily', 'hourly') OR place <= CASE facet WHEN 'model' THEN 3 ELSE 20 END
    """,
)
def analytics_dashboard(spark, sf_dir):
    """All facets in one pass over the base: each session is exploded to its facet keys, then summed once."""
    s = best_sessions(spark, sf_dir)
    key = lambda facet, c: F.struct(F.lit(facet).alias("facet"), c.cast("string").alias("key"))
    keyed = s.withColumn("f", F.explode(F.array(key("daily", F.col("day")), key("hourly", F.col("hour")), key("model", F.col("event_type")), key("session", F.col("event_id")))))
    facets = keyed.groupBy("f.facet", "f.key").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("cost"))
    days = s.agg(F.count_distinct("day").alias("n"), F.sum("value").alias("v")).select(F.lit("monthly").alias("facet"), F.lit("projection").alias("key"), "n", F.round(F.col("v") * 30 / F.col("n"), 6).alias("cost"))
    ranked = facets.unionByName(days).withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("cost"), "key")).cast("long"))
    return ranked.where(F.col("facet").isin("daily", "hourly") | (F.col("place") <= F.when(F.col("facet") == "model", 3).otherwise(20)))


@query(
    "rollup_by_model",
    """
    SELECT o_orderpriority AS model, count(DISTINCT o_orderkey) AS sessions, count(*) AS entries, round(sum(l_quantity), 4) AS tokens,
      round(sum(l_quantity * l_discount) / nullif(sum(l_quantity), 0) * 100, 6) AS hit_pct
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1
    """,
)
def rollup_by_model(spark, sf_dir):
    """Sessions count once a model; the share of cached tokens is 0 over nothing."""
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.count_distinct("o_orderkey").alias("sessions"), F.count("*").alias("entries"), F.round(F.sum("l_quantity"), 4).alias("tokens"),
        F.round(F.try_divide(F.sum(F.col("l_quantity") * F.col("l_discount")), F.sum("l_quantity")) * 100, 6).alias("hit_pct"),
    )


@query(
    "attributed_totals",
    """
    WITH s AS (SELECT l_orderkey, count(DISTINCT CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS models, min(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END) AS one, sum(l_quantity) AS q FROM lineitem GROUP BY 1)
    SELECT CASE WHEN models = 1 THEN one ELSE 'mixed' END AS attributed, count(*) AS sessions, round(sum(q), 4) AS tokens FROM s GROUP BY 1
    """,
)
def attributed_totals(spark, sf_dir):
    """A session is attributed to its model if it has one only; the placeholder ('N') has no vote but its tokens count."""
    real = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(real).alias("models"), F.min(real).alias("one"), F.sum("l_quantity").alias("q"))
    return s.groupBy(F.when(F.col("models") == 1, F.col("one")).otherwise("mixed").alias("attributed")).agg(F.count("*").alias("sessions"), F.round(F.sum("q"), 4).alias("tokens"))


@query(
    "telemetry_summary",
    """
    SELECT count(*) AS n_events, count(DISTINCT user_id) AS n_sessions, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (event_type = 'error') AS errors,
      count(*) FILTER (event_type = 'purchase') AS purchases, round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 6) AS purchase_value,
      round(count(*) FILTER (event_type = 'click') / nullif(count(*) FILTER (event_type IN ('click', 'view')), 0), 6) AS hit_rate,
      count(*) FILTER (value < 10) AS bucket_low, count(*) FILTER (value >= 10 AND value < 50) AS bucket_mid, count(*) FILTER (value >= 50) AS bucket_high
    FROM events
    """,
)
def telemetry_summary(spark, sf_dir):
    kind = lambda *k: F.col("event_type").isin(*k)
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_sessions"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_if(kind("error")).alias("errors"),
        F.count_if(kind("purchase")).alias("purchases"), F.round(zero(F.sum(F.when(kind("purchase"), F.col("value")))), 6).alias("purchase_value"),
        F.round(F.try_divide(F.count_if(kind("click")), F.count_if(kind("click", "view"))), 6).alias("hit_rate"),
        F.count_if(F.col("value") < 10).alias("bucket_low"), F.count_if((F.col("value") >= 10) & (F.col("value") < 50)).alias("bucket_mid"), F.count_if(F.col("value") >= 50).alias("bucket_high"),
    )


@query(
    "most_common_props",
    """
    SELECT event_type, k, n, place FROM (
      SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, min(event_id)) AS place FROM events GROUP BY 1, 2)
    WHERE place <= 20
    """,
)
def most_common_props(spark, sf_dir):
    """Counter.most_common(20) for each event type; ties by first insertion."""
    counted = table(spark, sf_dir, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    w = Window.partitionBy("event_type").orderBy(F.desc("n"), "first")
    return counted.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 20").drop("first")


@query(
    "bucket_counts",
    """
    SELECT CASE WHEN value < 1 THEN 'lt_1' WHEN value < 5 THEN '1_5' WHEN value < 25 THEN '5_25' WHEN value < 100 THEN '25_100' ELSE 'ge_100' END AS bucket, count(*) AS n FROM events GROUP BY 1
    """,
)
def bucket_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(bucket(F.col("value"), [1, 5, 25, 100]).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "session_day_buckets",
    """
    WITH b AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS tokens, count(*) FILTER (event_type = 'error') AS errors, max_by(value, event_id) FILTER (event_type = 'purchase') AS last_purchase FROM events GROUP BY 1, 2)
    SELECT user_id, day, n, round(tokens, 6) AS tokens, errors, last_purchase, round(tokens / nullif(sum(tokens) OVER (PARTITION BY user_id), 0) * 100, 6) AS carry_share FROM b
    """,
)
def session_day_buckets(spark, sf_dir):
    """Measures by session and UTC day; the latest snapshot of a kind wins; 100 units of carry are split by token share."""
    b = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("n"), F.sum("value").alias("tokens"), F.count_if(F.col("event_type") == "error").alias("errors"),
        F.max_by(F.when(F.col("event_type") == "purchase", F.col("value")), F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("last_purchase"),
    )
    share = F.try_divide(F.col("tokens"), F.sum("tokens").over(Window.partitionBy("user_id")))
    return b.select("user_id", "day", "n", F.round("tokens", 6).alias("tokens"), "errors", "last_purchase", F.round(share * 100, 6).alias("carry_share"))


@query(
    "trailing_windows",
    """
    WITH last AS (SELECT max(ts) AS t FROM events)
    SELECT n_days, count(*) AS n, round(sum(value), 6) AS total FROM (VALUES (1), (7), (30)) d(n_days), last, events
    WHERE CAST(ts AS DATE) >= CAST(t - n_days * INTERVAL 1 DAY AS DATE) GROUP BY 1
    """,
)
def trailing_windows(spark, sf_dir):
    """Totals of the last n days; the start rounds down to a day, so that n + 1 days can take part."""
    e = table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("t")).withColumn("n_days", F.explode(F.array(*map(F.lit, (1, 7, 30)))))
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    # three rows against one row a day
    return daily.join(F.broadcast(last), F.expr("day >= date_sub(to_date(t), n_days)")).groupBy("n_days").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 6).alias("total"))


@query(
    "dense_daily_totals",
    """
    WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1), b AS (SELECT min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events)
    SELECT CAST(g AS DATE) AS day, coalesce(n, 0) AS n, round(coalesce(v, 0), 6) AS total FROM b, generate_series(lo, hi, INTERVAL 1 DAY) s(g) LEFT JOIN d ON d.day = CAST(g AS DATE)
    WHERE CAST(g AS DATE) > lo AND CAST(g AS DATE) < hi
    """,
)
def dense_daily_totals(spark, sf_dir):
    """Days without rows count 0; both ends of the range are open."""
    e = table(spark, sf_dir, "events")
    days = days_of(e.agg(F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))).where("day > lo and day < hi").select("day")
    d = e.where("event_type = 'purchase'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("c"), F.sum("value").alias("v"))
    return days.join(d, "day", "left").select("day", zero("c").cast("long").alias("n"), F.round(zero("v"), 6).alias("total"))


@query(
    "session_savings",
    """
    WITH s AS (SELECT user_id, sum(value) FILTER (event_type = 'click') AS saved_rows, count(*) FILTER (event_type = 'view') AS unpriced, sum(value) FILTER (event_type = 'signup') AS routing,
      sum(value) FILTER (event_type = 'error') AS carry, sum(value) FILTER (event_type = 'purchase') AS cost FROM events GROUP BY 1),
    t AS (SELECT user_id, coalesce(saved_rows, 0) + unpriced * 0.5 + coalesce(routing, 0) AS saved, coalesce(carry, 0) AS carry, coalesce(cost, 0) AS cost FROM s)
    SELECT user_id, round(saved, 6) AS saved, round(carry, 6) AS carry, round(saved / nullif(saved + carry + cost, 0) * 100, 6) AS saved_pct FROM t
    """,
)
def session_savings(spark, sf_dir):
    """Row savings, unpriced rows at a rate and routing are saved; carry stands beside them and only in the quotient."""
    of = lambda k: F.sum(F.when(F.col("event_type") == k, F.col("value")))
    s = table(spark, sf_dir, "events").groupBy("user_id").agg((zero(of("click")) + F.count_if(F.col("event_type") == "view") * 0.5 + zero(of("signup"))).alias("saved"), zero(of("error")).alias("carry"), zero(of("purchase")).alias("cost"))
    pct = F.try_divide(F.col("saved"), F.col("saved") + F.col("carry") + F.col("cost")) * 100
    return s.select("user_id", F.round("saved", 6).alias("saved"), F.round("carry", 6).alias("carry"), F.round(pct, 6).alias("saved_pct"))


@query(
    "insight_opportunities",
    """
    WITH s AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, coalesce(sum(value) FILTER (event_type = 'view'), 0) AS read_cost, sum(value) AS cost FROM events GROUP BY 1, 2),
    t AS (SELECT count(*) AS sessions, count(*) FILTER (cost > 0 AND read_cost / cost > 0.3) AS heavy, count(*) FILTER (errors > 0) AS failed, count(DISTINCT user_id) AS machines FROM s)
    SELECT 'read_cost' AS rule, heavy AS evidence, heavy > 5 AS fires FROM t
    UNION ALL SELECT 'errors', failed, failed >= 5 AND failed > 0.1 * sessions FROM t
    UNION ALL SELECT 'machines', machines, machines > 1 FROM t
    """,
)
def insight_opportunities(spark, sf_dir):
    s = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), zero(F.sum(F.when(F.col("event_type") == "view", F.col("value")))).alias("read_cost"), F.sum("value").alias("cost"))
    t = s.agg(F.count("*").alias("sessions"), F.count_if((F.col("cost") > 0) & (F.try_divide("read_cost", "cost") > 0.3)).alias("heavy"), F.count_if(F.col("errors") > 0).alias("failed"), F.count_distinct("user_id").alias("machines"))
    return t.select(F.inline(F.array(
        F.struct(F.lit("read_cost").alias("rule"), F.col("heavy").alias("evidence"), (F.col("heavy") > 5).alias("fires")),
        F.struct(F.lit("errors").alias("rule"), F.col("failed").alias("evidence"), ((F.col("failed") >= 5) & (F.col("failed") > 0.1 * F.col("sessions"))).alias("fires")),
        F.struct(F.lit("machines").alias("rule"), F.col("machines").alias("evidence"), (F.col("machines") > 1).alias("fires")),
    )))


@query(
    "weekly_drift",
    """
    WITH last AS (SELECT max(ts) AS t FROM events), p AS (
      SELECT event_type AS domain, CASE WHEN ts > t - INTERVAL 7 DAY THEN 'current' WHEN ts > t - INTERVAL 14 DAY THEN 'prior' END AS period, value FROM events, last),
    g AS (SELECT domain, period, count(*) AS n, avg(CASE WHEN value >= 20 THEN 1.0 ELSE 0.0 END) AS rate FROM p WHERE period IS NOT NULL GROUP BY GROUPING SETS ((domain, period), (period)))
    SELECT coalesce(c.domain, p2.domain, 'all') AS domain, coalesce(c.n, 0) AS n_current, coalesce(p2.n, 0) AS n_prior, round(c.rate, 6) AS rate_current, round(p2.rate, 6) AS rate_prior, round((c.rate - p2.rate) * 100, 6) AS drift_points
    FROM (SELECT * FROM g WHERE period = 'current') c FULL JOIN (SELECT * FROM g WHERE period = 'prior') p2 ON coalesce(c.domain, 'all') = coalesce(p2.domain, 'all')
    """,
)
def weekly_drift(spark, sf_dir):
    """Pass rate of this week and the week before, by domain and overall; a rate over nothing stays null."""
    e = table(spark, sf_dir, "events")
    last = F.broadcast(e.agg(F.max("ts").alias("t")))
    period = F.expr("CASE WHEN ts > t - INTERVAL 7 DAY THEN 'current' WHEN ts > t - INTERVAL 14 DAY THEN 'prior' END")
    p = e.join(last).withColumn("period", period).where("period IS NOT NULL")
    in_ = lambda name, c: F.when(F.col("period") == name, c)
    ok = (F.col("value") >= 20).cast("double")
    g = p.withColumn("domain", F.explode(F.array("event_type", F.lit("all")))).groupBy("domain").agg(
        F.count(in_("current", F.lit(1))).alias("n_current"), F.count(in_("prior", F.lit(1))).alias("n_prior"), F.avg(in_("current", ok)).alias("a"), F.avg(in_("prior", ok)).alias("b"))
    return g.select("domain", "n_current", "n_prior", F.round("a", 6).alias("rate_current"), F.round("b", 6).alias("rate_prior"), F.round((F.col("a") - F.col("b")) * 100, 6).alias("drift_points"))


@query(
    "all_validations_pass",
    """
    SELECT o_orderpriority AS domain, count(*) AS traces, count(*) FILTER (ok) AS passed FROM orders JOIN (SELECT l_orderkey, bool_and(l_discount <= 0.08) AS ok FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1
    """,
)
def all_validations_pass(spark, sf_dir):
    """A trace passes if all of its validations do; traces without any take no part."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_discount") <= 0.08).alias("ok"))
    return table(spark, sf_dir, "orders").join(v, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_orderpriority").alias("domain")).agg(F.count("*").alias("traces"), F.count_if("ok").alias("passed"))


@query(
    "grouped_failures",
    """
    SELECT l_returnflag AS domain, l_linestatus AS check_name, count(*) AS n, count(DISTINCT l_suppkey) AS n_files, CAST(min(l_suppkey) AS BIGINT) AS first_file FROM lineitem WHERE l_discount > 0.08 GROUP BY 1, 2
    """,
)
def grouped_failures(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_discount > 0.08").groupBy(F.col("l_returnflag").alias("domain"), F.col("l_linestatus").alias("check_name")).agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_files"), F.min("l_suppkey").alias("first_file"))


@query(
    "route_outcomes",
    """
    SELECT * FROM (SELECT o_orderpriority AS model, o_orderstatus AS phase, count(*) AS n, CAST(sum(CASE WHEN o_totalprice < 150000 THEN 1 ELSE 0 END) AS BIGINT) AS successes, round(avg(o_totalprice), 4) AS mean_cost FROM orders GROUP BY 1, 2)
    ORDER BY n DESC, model, phase LIMIT 50
    """,
)
def route_outcomes(spark, sf_dir):
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model"), F.col("o_orderstatus").alias("phase")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") < 150000).alias("successes"), F.round(F.avg("o_totalprice"), 4).alias("mean_cost"))
    return g.orderBy(F.desc("n"), "model", "phase").limit(50)


@query(
    "success_table",
    """
    SELECT c_mktsegment AS verb, c_nationkey AS size, count(*) AS n, CASE WHEN count(*) >= 5 THEN round(avg(CASE WHEN c_acctbal > 4000 THEN 1.0 ELSE 0.0 END), 6) END AS p FROM customer WHERE c_acctbal >= 0 GROUP BY 1, 2
    """,
)
def success_table(spark, sf_dir):
    """Success share of each bucket, null below the least number of samples; rows with a warning take no part."""
    return table(spark, sf_dir, "customer").where("c_acctbal >= 0").groupBy(F.col("c_mktsegment").alias("verb"), F.col("c_nationkey").alias("size")).agg(
        F.count("*").alias("n"), F.when(F.count("*") >= 5, F.round(F.avg((F.col("c_acctbal") > 4000).cast("double")), 6)).alias("p"))


@query(
    "queue_health",
    """
    WITH t AS (SELECT max(o_orderdate) AS now FROM orders)
    SELECT count(*) FILTER (o_orderstatus = 'O') AS pending, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS done,
      count(*) FILTER (o_orderstatus = 'P' AND o_orderdate < now - INTERVAL 30 DAY) AS lease_expired FROM orders, t
    """,
)
def queue_health(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    now = F.broadcast(o.agg(F.max("o_orderdate").alias("now")))
    is_ = lambda s: F.col("o_orderstatus") == s
    return o.join(now).agg(F.count_if(is_("O")).alias("pending"), F.count_if(is_("P")).alias("running"), F.count_if(is_("F")).alias("done"), F.count_if(is_("P") & F.expr("o_orderdate < now - INTERVAL 30 DAY")).alias("lease_expired"))


@query(
    "cache_stats",
    "SELECT source AS tool, count(*) AS entries, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, max(n_chars) AS largest, count(DISTINCT lang) AS langs FROM documents GROUP BY 1",
)
def cache_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tool")).agg(F.count("*").alias("entries"), F.sum(F.octet_length("text")).alias("bytes"), F.max("n_chars").alias("largest"), F.count_distinct("lang").alias("langs"))


@query(
    "baseline_deltas",
    """
    SELECT user_id AS op, count(*) AS n, round(min_by(value, event_id), 6) AS first_cost, round(max_by(value, event_id), 6) AS last_cost, round(min_by(value, event_id) * count(*) - sum(value), 6) AS would_have_saved,
      round(max_by(value, event_id) - max_by(prev, event_id), 6) AS vs_previous
    FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY 1
    """,
)
def baseline_deltas(spark, sf_dir):
    """First, last and previous cost of each operation; the first one is the baseline for all."""
    e = table(spark, sf_dir, "events").withColumn("prev", F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")))
    first, last = F.min_by("value", "event_id"), F.max_by("value", "event_id")
    return e.groupBy(F.col("user_id").alias("op")).agg(
        F.count("*").alias("n"), F.round(first, 6).alias("first_cost"), F.round(last, 6).alias("last_cost"), F.round(first * F.count("*") - F.sum("value"), 6).alias("would_have_saved"),
        F.round(last - F.max_by("prev", "event_id"), 6).alias("vs_previous"),
    )


@query(
    "failure_clusters",
    f"""
    WITH f AS (SELECT user_id, substr({marked_sql("lower('Error at /srv/' || event_type || '/run.py line ' || user_id || ' key ' || md5(event_type) || ' \"x 1\"')", ERROR_MARKS)}, 1, 260) AS fingerprint FROM events WHERE event_type <> 'view')
    SELECT fingerprint, count(*) AS n, count(DISTINCT user_id) AS sessions, round(least(0.95::DOUBLE, 0.45::DOUBLE + 0.08::DOUBLE * count(*)), 6) AS confidence FROM f GROUP BY 1 HAVING count(*) >= 2
    """,
)
def failure_clusters(spark, sf_dir):
    message = F.concat(F.lit("  Error\tat /srv/"), "event_type", F.lit("/run.py line "), "user_id", F.lit(" key "), F.md5("event_type"), F.lit(' "x 1"'))
    f = table(spark, sf_dir, "events").where("event_type <> 'view'").withColumn("fingerprint", error_fingerprint(message))
    return f.groupBy("fingerprint").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("sessions"), F.round(F.least(F.lit(0.95), 0.45 + 0.08 * F.count("*")), 6).alias("confidence")).where("n >= 2")


@query(
    "vote_reducer",
    """
    WITH v AS (SELECT l_orderkey AS task, lower(trim(l_returnflag)) AS answer, l_linenumber AS pos FROM lineitem), c AS (SELECT task, answer, count(*) AS votes, min(pos) AS first FROM v GROUP BY 1, 2),
    r AS (SELECT *, sum(votes) OVER (PARTITION BY task) AS voters, row_number() OVER (PARTITION BY task ORDER BY votes DESC, first, answer) AS place FROM c)
    SELECT task, CAST(voters AS BIGINT) AS voters, CAST(voters // 2 + 1 AS BIGINT) AS quorum, answer AS plurality, votes, CASE WHEN votes >= voters // 2 + 1 THEN answer END AS consensus FROM r WHERE place = 1
    """,
)
def vote_reducer(spark, sf_dir):
    """Plurality of normalised answers, first seen wins a tie; a consensus needs more than half."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.lower(F.trim("l_returnflag")).alias("answer")).agg(F.count("*").alias("votes"), F.min("l_linenumber").alias("first"))
    best = c.groupBy("task").agg(F.sum("votes").alias("voters"), F.min_by(F.struct("answer", "votes"), F.struct(-F.col("votes"), "first", "answer")).alias("b"))
    quorum = (F.floor(F.col("voters") / 2) + 1).cast("long")
    return best.select("task", "voters", quorum.alias("quorum"), F.col("b.answer").alias("plurality"), F.col("b.votes").alias("votes"), F.when(F.col("b.votes") >= quorum, F.col("b.answer")).alias("consensus"))


@query(
    "union_reducer",
    """
    SELECT l_partkey AS signature, count(*) AS duplicates, count(DISTINCT l_suppkey) AS contributors, CAST(min_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS BIGINT) AS first_child FROM lineitem GROUP BY 1
    """,
)
def union_reducer(spark, sf_dir):
    """The first finding of each signature, with how many there were and from how many."""
    order = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("signature")).agg(F.count("*").alias("duplicates"), F.count_distinct("l_suppkey").alias("contributors"), F.min_by("l_orderkey", order).alias("first_child"))


@query(
    "best_reducer",
    """
    WITH s AS (SELECT s_nationkey AS run, s_suppkey AS child, CASE WHEN s_acctbal > 5000 THEN 100 WHEN s_acctbal > 0 THEN -30 ELSE -60 END + 15 * (s_suppkey % 4) - 25 * (s_suppkey % 3) - 0.2 * least(s_suppkey % 70, 50) AS score, s_suppkey % 4 AS passes, s_suppkey % 70 AS files FROM supplier)
    SELECT run, CAST(child AS BIGINT) AS winner, CAST(round(score, 6) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(score, 6) DESC, passes DESC, files, child) AS r FROM s) WHERE r = 1
    """,
)
def best_reducer(spark, sf_dir):
    """Unmeasured fitness: status, passes, failures and files touched; ties by passes, then fewest files."""
    key = F.col("s_suppkey")
    score = F.when(F.col("s_acctbal") > 5000, 100).when(F.col("s_acctbal") > 0, -30).otherwise(-60) + 15 * (key % 4) - 25 * (key % 3) - 0.2 * F.least(key % 70, F.lit(50))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("run"), key.alias("child"), F.round(score, 6).alias("score"), (key % 4).alias("passes"), (key % 70).alias("files"))
    best = s.groupBy("run").agg(F.max_by(F.struct("child", "score"), F.struct("score", "passes", -F.col("files"), -F.col("child"))).alias("b"))
    return best.select("run", F.col("b.child").alias("winner"), "b.score")


@query(
    "latency_quantiles",
    """
    WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(max(CASE WHEN i = CAST(floor(0.95 * (n - 1)) AS BIGINT) THEN value END), 6) AS p95_floor FROM s GROUP BY 1
    """,
)
def latency_quantiles(spark, sf_dir):
    """Both percentile rules: linear interpolation, and the value at the floor of the index."""
    w = Window.partitionBy("event_type")
    s = table(spark, sf_dir, "events").select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    return s.groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"), F.round(F.max(F.when(F.col("i") == F.floor(0.95 * (F.col("n") - 1)), F.col("value"))), 6).alias("p95_floor"))


@query("latest_per_source", "SELECT source, max(doc_id) AS latest, count(*) AS n FROM documents GROUP BY 1")
def latest_per_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("latest"), F.count("*").alias("n"))


@query("session_model_sums", "SELECT user_id AS session, event_type AS model, count(*) AS n, round(sum(value), 6) AS cost FROM events GROUP BY 1, 2")
def session_model_sums(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("cost"))


@query(
    "session_report",
    """
    SELECT user_id AS session, epoch(max(ts) - min(ts)) AS seconds, count(DISTINCT event_type) AS n_vendors, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) WHEN count(DISTINCT event_type) = 0 THEN 'Unknown' ELSE 'mixed' END AS vendor,
      round(coalesce(sum(value) FILTER (event_type = 'purchase'), 0), 6) AS output_cost, round(coalesce(sum(value) FILTER (event_type <> 'purchase'), 0), 6) AS input_cost FROM events GROUP BY 1
    """,
)
def session_report(spark, sf_dir):
    n = F.count_distinct("event_type")
    seconds = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6
    part = lambda c: F.round(zero(F.sum(F.when(c, F.col("value")))), 6)
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("session")).agg(
        seconds.alias("seconds"), n.alias("n_vendors"), F.when(n == 1, F.min("event_type")).when(n == 0, "Unknown").otherwise("mixed").alias("vendor"),
        part(F.col("event_type") == "purchase").alias("output_cost"), part(F.col("event_type") != "purchase").alias("input_cost"),
    )


@query("cube_and_rollup", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(grouping(l_returnflag, l_linestatus) AS BIGINT) AS level FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_and_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))
