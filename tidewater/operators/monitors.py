"""Monitors of a trajectory: six signs that a run of steps goes wrong, each a number from 0 to 1.

A step is a row. What a sign looks at is a window over a log's steps, its last few rows, or the first and last place where
a phrase is met; texts of a whole log never come together. Phrases may reach from a step into the next ones, as
far as a phrase is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, words
from ..registry import query
from ..sources.tables import table

# Weights of the monitors, the surest first, and the score from which one fires.
MONITOR_WEIGHTS = {"claim_contradiction": 0.30, "semantic_loop": 0.25, "verification_skip": 0.15, "cyclic_compression": 0.10, "late_sprawl": 0.10, "silent_topic_drift": 0.10}
FIRES = 0.40
# Phrases of conclusions, of checks, of claims with their opposites, and of work beside the task.
CONCLUSIONS = (r"\b(done|complete[d]?|finished|fixed|solved|resolved)\b", r"\b(the (answer|solution|fix) is)\b", r"\b(therefore|thus|so the)\b")
CHECKS = (
    r"\b(test|verify|confirm|assert|validate)\b", r"\b(ran|run) (the )?tests?\b", r"\b(I |let me )(check|confirm|verify|validate)\b",
    r"\b(make sure|double.check|ensure)\b", r"\bresult[s]?\s+(show|indicate|confirm)\b",
)
OPPOSITES = (
    (r"\b(it works|working correctly|no error)\b", r"\b(error|fail|broken|doesn.t work)\b"),
    (r"\b(does not exist|missing|not found)\b", r"\b(exists|found|present)\b"),
    (r"\bI (will|would|should|can)\b", r"\bI (cannot|can.t|won.t|shouldn.t|must not)\b"),
    (r"\b(always|never|all|none)\b", r"\b(sometimes|occasionally|some|few)\b"),
)
SIDE_WORK = (r"\b(also|additionally|while I.m at it|and also|furthermore)\b", r"\b(I noticed|I see that|by the way|incidentally)\b", r"\b(refactor|clean up|improve|optimize|restructure)\b")
#: Steps, and characters of each, into which a phrase may reach.
REACH = (4, 64)


def _any(text: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out |= F.rlike(text, F.lit(f"(?i){p}"))
    return out


def _bigrams(text: Column) -> Column:
    w = words(text)
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1))))


def trajectory_scores(steps: DataFrame, log: str, at: str, text: str) -> DataFrame:
    """``log``, the six monitors, ``composite`` (their weighted sum) and ``failure_type`` (the weightiest that fires, null for none).

    The first row of a log is its task and no step, unless it stands alone. A null text is empty.
    """
    w, whole = Window.partitionBy("log").orderBy("at"), Window.partitionBy("log")
    rows = steps.select(F.col(log).alias("log"), F.col(at).alias("at"), F.coalesce(text, F.lit("")).alias("text")).withColumns({"i": F.row_number().over(w) - 1, "rows": F.count("*").over(whole)})
    tasks = rows.where("i = 0").select("log", F.array_distinct(words(F.col("text"))).alias("wanted"))
    s = rows.where("i > 0 OR rows = 1").withColumns({"k": F.greatest("i", F.lit(1)), "n": F.greatest(F.col("rows") - 1, F.lit(1))})
    s = s.withColumn("late", F.col("k") > F.greatest(F.lit(1), F.floor(F.col("n") / 2)))
    half = Window.partitionBy("log", "late").orderBy("k")
    ahead = F.array_join(F.transform(F.collect_list("text").over(half.rowsBetween(1, REACH[0])), lambda t: F.left(t, F.lit(REACH[1]))), " ")
    near = F.concat_ws(" ", "text", F.nullif(ahead, F.lit("")))
    met = {f"side{j}": _any(near, [p]) for j, p in enumerate(SIDE_WORK)}
    met |= {f"claim{j}": _any(F.col("text"), [a]) for j, (a, _) in enumerate(OPPOSITES)} | {f"against{j}": _any(F.col("text"), [b]) for j, (_, b) in enumerate(OPPOSITES)}
    s = s.withColumns(met)
    kinds = lambda when: sum((F.max(F.when(when, F.col(f"side{j}")).otherwise(False)).cast("int") for j in range(len(SIDE_WORK))), F.lit(0))
    against = sum((F.coalesce(F.max(F.when(F.col(f"against{j}"), F.col("k"))) > F.min(F.when(F.col(f"claim{j}"), F.col("k"))), F.lit(False)).cast("int") for j in range(len(OPPOSITES))), F.lit(0))
    told = s.groupBy("log", "n").agg(F.least(F.lit(1.0), 0.4 * against).alias("claim_contradiction"), F.least(F.lit(1.0), 0.3 * F.greatest(F.lit(0), kinds(F.col("late")) - kinds(~F.col("late")))).alias("sprawl"))
    # the last six steps of a log at most
    last = s.where(F.col("k") > F.col("n") - 6).select("log", F.struct("k", "text", _bigrams(F.col("text")).alias("b")).alias("x"))
    page = told.join(last.groupBy("log").agg(F.array_sort(F.collect_list("x")).alias("x")), "log").join(tasks, "log")
    tail = lambda many: F.slice("x", F.greatest(F.size("x") - many + 1, F.lit(1)), many)
    four = tail(4)
    loops = F.flatten(F.transform(four, lambda p: F.transform(F.filter(four, lambda q: (q["k"] < p["k"]) & (q["text"] != p["text"])), lambda q: jaccard(p["b"], q["b"], 0.0))))
    end = F.array_join(F.transform(tail(3), lambda x: x["text"]), " ")
    first, final = F.element_at("x", 1), F.element_at("x", -1)
    seen = words(end)
    drift = F.when(F.size("wanted") > 0, 0.9 * (1 - F.size(F.array_intersect("wanted", seen)) / F.size("wanted"))).otherwise(0.0)
    out = page.select(
        "log", F.coalesce(F.array_max(loops), F.lit(0.0)).alias("semantic_loop"), F.when(F.col("n") >= 3, F.least(F.lit(1.0), 1.5 * jaccard(first["b"], final["b"], 0.0))).otherwise(0.0).alias("cyclic_compression"), drift.alias("silent_topic_drift"),
        F.when(_any(end, CONCLUSIONS) & ~_any(end, CHECKS), 0.8).otherwise(0.0).alias("verification_skip"), "claim_contradiction", F.when(F.col("n") > 1, F.col("sprawl")).otherwise(0.0).alias("late_sprawl"),
    )
    fired = F.coalesce(*(F.when(F.col(m) >= FIRES, m) for m in MONITOR_WEIGHTS))
    return out.select(F.col("log").alias(log), *(m for m in out.columns if m != "log"), sum((k * F.col(m) for m, k in MONITOR_WEIGHTS.items()), F.lit(0.0)).alias("composite"), fired.alias("failure_type"))


def _sql_any(text: str, patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '(?i){p}')" for p in patterns) + ")"


def _sql() -> str:
    halves = lambda late: " + ".join(f"coalesce(regexp_matches(string_agg(text, ' ' ORDER BY k) FILTER ({late}), '(?i){p}'), false)::INT" for p in SIDE_WORK)
    against = " + ".join(f"coalesce(max(CASE WHEN {_sql_any('text', [b])} THEN k END) > min(CASE WHEN {_sql_any('text', [a])} THEN k END), false)::INT" for a, b in OPPOSITES)
    grams = "list_distinct(list_transform(w[1:len(w) - 1], lambda x, i: x || ' ' || w[i + 1]))"
    overlap = "CASE WHEN len(list_distinct(p.b || q.b)) = 0 THEN 0 ELSE len(list_intersect(p.b, q.b)) / len(list_distinct(p.b || q.b)) END"
    weighted = " + ".join(f"{k}::DOUBLE * {m}" for m, k in MONITOR_WEIGHTS.items())
    fired = "CASE " + " ".join(f"WHEN {m} >= {FIRES} THEN '{m}'" for m in MONITOR_WEIGHTS) + " END"
    rounded = ", ".join(f"round({m}, 6) AS {m}" for m in MONITOR_WEIGHTS)
    return f"""
    WITH r AS (SELECT conv_id, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS rows FROM conversations),
    s AS (SELECT conv_id, text, greatest(i, 1) AS k, greatest(rows - 1, 1) AS n, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM r WHERE i > 0 OR rows = 1),
    b AS (SELECT conv_id, k, n, text, {grams} AS b FROM s), t AS (SELECT conv_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS wanted FROM r WHERE i = 0),
    g AS (SELECT conv_id, any_value(n) AS n, least(1, 0.4::DOUBLE * ({against})) AS claim_contradiction, least(1, 0.3::DOUBLE * greatest(0, ({halves("k > greatest(1, n // 2)")}) - ({halves("k <= greatest(1, n // 2)")}))) AS sprawl, string_agg(text, ' ' ORDER BY k) FILTER (k > n - 3) AS last FROM s GROUP BY 1),
    l AS (SELECT p.conv_id, max({overlap}) AS semantic_loop FROM b p JOIN b q ON p.conv_id = q.conv_id AND q.k < p.k AND q.k > q.n - 4 AND p.text <> q.text GROUP BY 1),
    c AS (SELECT p.conv_id, least(1, 1.5::DOUBLE * ({overlap})) AS cyclic_compression FROM b p JOIN b q ON p.conv_id = q.conv_id AND q.k = q.n AND p.k = greatest(1, p.n - 5) WHERE p.n >= 3),
    m AS (SELECT conv_id, coalesce(semantic_loop, 0) AS semantic_loop, coalesce(cyclic_compression, 0) AS cyclic_compression, claim_contradiction, CASE WHEN n > 1 THEN sprawl ELSE 0 END AS late_sprawl,
      CASE WHEN len(wanted) > 0 THEN 0.9::DOUBLE * (1 - len(list_intersect(wanted, regexp_extract_all(lower(last), '[a-z0-9]+'))) / len(wanted)) ELSE 0 END AS silent_topic_drift, CASE WHEN {_sql_any("last", CONCLUSIONS)} AND NOT {_sql_any("last", CHECKS)} THEN 0.8::DOUBLE ELSE 0 END AS verification_skip
      FROM g JOIN t USING (conv_id) LEFT JOIN l USING (conv_id) LEFT JOIN c USING (conv_id))
    SELECT conv_id, {rounded}, round({weighted}, 6) AS composite, {fired} AS failure_type FROM m
    """


@query("trajectory_monitors", _sql())
def trajectory_monitors(spark, sf_dir):
    """Conversations as trajectories, their first turn as the task."""
    found = trajectory_scores(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return found.select("conv_id", *(F.round(m, 6).alias(m) for m in (*MONITOR_WEIGHTS, "composite")), "failure_type")
