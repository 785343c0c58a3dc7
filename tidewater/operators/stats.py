"""Statistical decision rules: Wilson bounds, non-inferiority, smoothed risks, expected values."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import words
from ..registry import query
from ..sources.tables import table


def wilson(passed: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Wilson interval of a share; (0, 1) over nothing."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    p = F.try_divide(passed.cast("double"), n)
    scale = 1 + z * z / n
    middle, half = (p + z * z / (2 * n)) / scale, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    some = n > 0
    return F.when(some, F.greatest(middle - half, F.lit(0.0))).otherwise(0.0), F.when(some, F.least(middle + half, F.lit(1.0))).otherwise(1.0)


_Z = NormalDist().inv_cdf(0.975)


@query(
    "non_inferiority",
    f"""
    WITH a AS (SELECT l_returnflag AS task, l_linestatus AS arm, count(*) AS n, count(*) FILTER (l_discount < 0.06) AS ok FROM lineitem WHERE l_returnflag <> 'X' GROUP BY 1, 2),
    w AS (SELECT *, ok / n AS p, (ok / n + {_Z * _Z} / (2 * n)) / (1 + {_Z * _Z} / n) AS mid, {_Z} * sqrt(ok / n * (1 - ok / n) / n + {_Z * _Z} / (4.0 * n * n)) / (1 + {_Z * _Z} / n) AS half FROM a),
    j AS (SELECT x.task, x.p - y.p AS delta, (x.mid - x.half) - (y.mid + y.half) AS lo, (x.mid + x.half) - (y.mid - y.half) AS hi FROM w x JOIN w y ON x.task = y.task AND x.arm = 'F' AND y.arm = 'O')
    SELECT task, round(delta, 6) AS delta, round(lo, 6) AS delta_low, round(hi, 6) AS delta_high, CASE WHEN lo >= -0.05 THEN 'pass' WHEN hi < -0.05 THEN 'fail' ELSE 'inconclusive' END AS verdict FROM j
    """,
)
def non_inferiority(spark, sf_dir):
    """The arm's share against the other's: bounds of the difference from the two intervals, margin five points."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("task")).agg(*[
        f(F.when(F.col("l_linestatus") == arm, c)).alias(name)
        for arm, k in (("F", "x"), ("O", "y")) for name, f, c in ((f"n_{k}", F.count, F.lit(1)), (f"ok_{k}", F.sum, (F.col("l_discount") < 0.06).cast("long")))
    ]).where("n_x > 0 AND n_y > 0")
    (xl, xh), (yl, yh) = wilson(F.col("ok_x"), F.col("n_x")), wilson(F.col("ok_y"), F.col("n_y"))
    lo, hi = xl - yh, xh - yl
    verdict = F.when(lo >= -0.05, "pass").when(hi < -0.05, "fail").otherwise("inconclusive")
    return rows.select("task", F.round(F.col("ok_x") / F.col("n_x") - F.col("ok_y") / F.col("n_y"), 6).alias("delta"), F.round(lo, 6).alias("delta_low"), F.round(hi, 6).alias("delta_high"), verdict.alias("verdict"))


@query(
    "calibrated_route",
    """
    WITH s AS (SELECT o_orderpriority AS model, count(*) AS n, count(*) FILTER (o_totalprice > 300000) AS fails, avg(o_totalprice) / 1000 AS direct FROM orders GROUP BY 1)
    SELECT model, round((fails + 0.3 * 4) / (n + 4), 6) AS p_fail, round(direct + (fails + 0.3 * 4) / (n + 4) * 250, 4) AS expected, n >= 20 AS enough FROM s
    """,
)
def calibrated_route(spark, sf_dir):
    """Failure share smoothed to a prior of four samples; expected cost is direct cost and escalation times that share."""
    s = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 300000).alias("fails"), (F.avg("o_totalprice") / 1000).alias("direct"))
    p = (F.col("fails") + 0.3 * 4) / (F.col("n") + 4)
    return s.select("model", F.round(p, 6).alias("p_fail"), F.round(F.col("direct") + p * 250, 4).alias("expected"), (F.col("n") >= 20).alias("enough"))


@query(
    "cache_tier_value",
    """
    WITH g AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), p AS (SELECT user_id, count(gap) AS n, avg(CASE WHEN gap > 300 AND gap <= 3600 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END) AS p FROM g GROUP BY 1)
    SELECT user_id, round(p * 0.9 - 0.75, 6) AS value_of_hour, n >= 3 AND p * 0.9 - 0.75 > 0 AS choose_hour FROM p
    """,
)
def cache_tier_value(spark, sf_dir):
    from pyspark.sql import Window

    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.col("ts")) / 1e6
    g = table(spark, sf_dir, "events").select("user_id", gap.alias("gap"))
    p = g.groupBy("user_id").agg(F.count("gap").alias("n"), F.avg(F.when(F.col("gap").isNotNull(), ((F.col("gap") > 300) & (F.col("gap") <= 3600)).cast("double"))).alias("p"))
    value = F.col("p") * 0.9 - 0.75
    return p.select("user_id", F.round(value, 6).alias("value_of_hour"), ((F.col("n") >= 3) & (value > 0)).alias("choose_hour"))


@query(
    "task_complexity",
    """
    WITH c AS (SELECT conv_id, turn, round(0.20 * CASE WHEN role = 'user' THEN 1.0 WHEN role = 'system' THEN 0.2 ELSE 0.5 END + 0.15 * least(length(text) / 50.0 / 50, 1) + 0.10 * least(length(text) / 800.0 + 0.1 * (length(text) - length(replace(text, '?', ''))), 1) + 0.10 * least(turn / 5.0, 1), 6) AS score FROM conversations)
    SELECT conv_id, turn, score, CASE WHEN score < 0.33 THEN 'simple' WHEN score < 0.67 THEN 'moderate' ELSE 'complex' END AS label FROM c
    """,
)
def task_complexity(spark, sf_dir):
    """Weighted, saturating signals to a label."""
    n = F.length("text")
    marks = n - F.length(F.replace("text", F.lit("?"), F.lit("")))
    kind = F.when(F.col("role") == "user", 1.0).when(F.col("role") == "system", 0.2).otherwise(0.5)
    one = F.lit(1.0)
    score = F.round(0.20 * kind + 0.15 * F.least(n / 50.0 / 50, one) + 0.10 * F.least(n / 800.0 + 0.1 * marks, one) + 0.10 * F.least(F.col("turn") / 5.0, one), 6)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", score.alias("score")).withColumn("label", F.when(F.col("score") < 0.33, "simple").when(F.col("score") < 0.67, "moderate").otherwise("complex"))


@query(
    "matched_incident",
    """
    WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations), i AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, item_id % 12 AS n FROM benchmark),
    s AS (SELECT conv_id, turn, item_id, len(list_intersect(c.w, i.w)) / len(list_distinct(list_concat(c.w, i.w))) + least(0.4, n / 20.0) AS score FROM c, i WHERE len(list_intersect(c.w, i.w)) > 0)
    SELECT conv_id, turn, item_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY round(score, 9) DESC, item_id) AS r FROM s) WHERE r = 1
    """,
)
def matched_incident(spark, sf_dir):
    """The known incident with most words in common, more often seen ones first. Pairs meet on a shared word."""
    own = lambda t, key: table(spark, sf_dir, t).select(*key, F.array_distinct(words(F.col("text"))).alias("w"))
    c = own("conversations", ["conv_id", "turn"]).select("conv_id", "turn", F.size("w").alias("nc"), F.explode("w").alias("word"))
    i = own("benchmark", ["item_id"]).select("item_id", F.size("w").alias("ni"), F.explode("w").alias("word"))
    shared = c.join(i, "word").groupBy("conv_id", "turn", "item_id", "nc", "ni").agg(F.count("*").alias("both"))
    score = F.col("both") / (F.col("nc") + F.col("ni") - F.col("both")) + F.least(F.lit(0.4), F.col("item_id") % 12 / 20.0)
    best = shared.withColumn("score", score).groupBy("conv_id", "turn").agg(F.max_by(F.struct("item_id", "score"), F.struct(F.round("score", 9), -F.col("item_id"))).alias("b"))
    return best.select("conv_id", "turn", F.col("b.item_id").alias("item_id"), F.round("b.score", 6).alias("score"))


