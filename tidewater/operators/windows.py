"""Analytic functions: running totals with caps and resets, gaps, islands, anomaly scores, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, log_signature, words
from ..registry import query
from ..sources.tables import table

_FIRST = Window.unboundedPreceding


def capped_running_credit(rows: DataFrame, keys: list[str], order: list[str], amount: str, cap: float) -> DataFrame:
    """``credit``: what each row still adds under the cap, oldest first; the row that reaches it adds a part."""
    before = F.coalesce(F.sum(amount).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, -1)), F.lit(0.0))
    return rows.withColumn("credit", F.least(F.greatest(F.lit(cap) - before, F.lit(0.0)), F.col(amount)))


def segments(rows: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """``segment``: how many rows up to this one satisfy ``starts``."""
    return rows.withColumn("segment", F.sum(starts.cast("int")).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(_FIRST, 0)))


@query(
    "capped_carry_credit",
    """
    WITH g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events),
    b AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id, segment ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
    SELECT event_id, CAST(segment AS BIGINT) AS segment, round(least(greatest(120 - before, 0), value), 6) AS credit FROM b
    """,
)
def capped_carry_credit(spark, sf_dir):
    """Running credit of a session under a cap, from the start again after each compaction."""
    g = segments(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup")
    return capped_running_credit(g, ["user_id", "segment"], ["event_id"], "value", 120.0).select("event_id", "segment", F.round("credit", 6).alias("credit"))


@query(
    "reset_cumulative_cliff",
    """
    WITH g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM events)
    SELECT event_id, round(total, 6) AS total, total >= 200 AS over_cliff FROM (SELECT event_id, sum(value) OVER (PARTITION BY user_id, segment ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM g)
    """,
)
def reset_cumulative_cliff(spark, sf_dir):
    g = segments(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") == "signup")
    total = F.sum("value").over(Window.partitionBy("user_id", "segment").orderBy("event_id").rowsBetween(_FIRST, 0))
    return g.withColumn("t", total).select("event_id", F.round("t", 6).alias("total"), (F.col("t") >= 200).alias("over_cliff"))


@query(
    "access_gap_share",
    """
    WITH g AS (SELECT user_id, epoch(ts) - epoch(lag(ts) OVER w) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(gap) AS gaps, round(avg(CASE WHEN gap > 300 AND gap <= 3600 THEN 1.0 WHEN gap IS NOT NULL THEN 0.0 END), 6) AS share FROM g WHERE back <= 64 GROUP BY 1
    """,
)
def access_gap_share(spark, sf_dir):
    """Of the last 64 gaps between accesses, the share between 5 and 60 minutes."""
    w = Window.partitionBy("user_id")
    gap = F.timestamp_diff("MICROSECOND", F.lag("ts").over(w.orderBy("ts", "event_id")), F.col("ts")) / 1e6
    g = table(spark, sf_dir, "events").select("user_id", gap.alias("gap"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("back")).where("back <= 64")
    inside = F.when(F.col("gap").isNotNull(), ((F.col("gap") > 300) & (F.col("gap") <= 3600)).cast("double"))
    return g.groupBy("user_id").agg(F.count("gap").alias("gaps"), F.round(F.avg(inside), 6).alias("share"))


@query(
    "rolling_z_score",
    """
    WITH b AS (SELECT user_id, CAST(event_id // 500 AS BIGINT) AS batch, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), f AS (SELECT user_id, min(batch) AS lo FROM b GROUP BY 1), m AS (SELECT max(batch) AS hi FROM b),
    d AS (SELECT f.user_id, g AS batch, coalesce(n, 0) AS n FROM f, m, generate_series(lo, hi) s(g) LEFT JOIN b ON b.user_id = f.user_id AND b.batch = g),
    z AS (SELECT *, avg(n) OVER w AS mean, stddev_pop(n) OVER w AS sd, count(*) OVER w AS c FROM d WINDOW w AS (PARTITION BY user_id ORDER BY batch ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT user_id, batch, round(CASE WHEN c >= 5 AND sd >= 0.01 THEN (n - mean) / sd END, 4) AS z, CASE WHEN c >= 5 AND sd >= 0.01 AND abs((n - mean) / sd) >= 3.5 THEN 'critical' WHEN c >= 5 AND sd >= 0.01 AND abs((n - mean) / sd) >= 2.5 THEN 'warn' END AS level FROM z
    """,
)
def rolling_z_score(spark, sf_dir):
    """Calls per batch against the last 50 batches, this one included; batches without calls count 0 from a tool's first one on."""
    b = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 500).alias("batch")).agg(F.count("*").cast("double").alias("c"))
    last = F.broadcast(b.agg(F.max("batch").alias("hi")))
    d = b.groupBy("user_id").agg(F.min("batch").alias("lo")).join(last).select("user_id", F.explode(F.sequence("lo", "hi")).alias("batch"))
    d = d.join(b, ["user_id", "batch"], "left").select("user_id", "batch", F.coalesce("c", F.lit(0.0)).alias("n"))
    w = Window.partitionBy("user_id").orderBy("batch").rowsBetween(-49, 0)
    d = d.select("user_id", "batch", "n", F.avg("n").over(w).alias("mean"), F.stddev_pop("n").over(w).alias("sd"), F.count("*").over(w).alias("c"))
    z = F.when((F.col("c") >= 5) & (F.col("sd") >= 0.01), (F.col("n") - F.col("mean")) / F.col("sd"))
    return d.select("user_id", "batch", F.round(z, 4).alias("z"), F.when(F.abs(z) >= 3.5, "critical").when(F.abs(z) >= 2.5, "warn").alias("level"))


@query(
    "burst_detection",
    """
    SELECT event_id, event_type, n FROM (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN count(*) FILTER (event_type = 'click') OVER w WHEN 'view' THEN count(*) FILTER (event_type = 'view') OVER w WHEN 'error' THEN count(*) FILTER (event_type = 'error') OVER w
      WHEN 'signup' THEN count(*) FILTER (event_type = 'signup') OVER w ELSE count(*) FILTER (event_type = 'purchase') OVER w END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) WHERE n >= 5
    """,
)
def burst_detection(spark, sf_dir):
    """The same tool at least 5 times in the last 10 events of a session."""
    last = F.collect_list("event_type").over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-9, 0))
    same = F.size(F.filter("recent", lambda t: t == F.col("event_type"))).cast("long")
    return table(spark, sf_dir, "events").withColumn("recent", last).select("event_id", "event_type", same.alias("n")).where("n >= 5")


@query(
    "event_scores",
    """
    WITH w AS (SELECT event_id, event_type, lead(event_type) OVER s AS nxt, row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY event_id) AS rep, count(*) OVER (PARTITION BY user_id) - row_number() OVER s AS back FROM events WINDOW s AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, round(CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.8 ELSE 0.4 END * CASE WHEN nxt = 'error' THEN 1.5 ELSE 1 END * CASE WHEN rep > 1 THEN 0.5 ELSE 1 END * (0.5 + 0.5 * exp(-back / 20.0)), 6) AS score FROM w
    """,
)
def event_scores(spark, sf_dir):
    """Kind weight, times 1.5 right before an error, times 0.5 for a repeat, times a recency factor counted from the end."""
    s = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.lead("event_type").over(s).alias("nxt"), F.row_number().over(Window.partitionBy("user_id", "event_type", F.floor("value")).orderBy("event_id")).alias("rep"),
        (F.count("*").over(Window.partitionBy("user_id")) - F.row_number().over(s)).alias("back"),
    )
    kind = F.when(F.col("event_type") == "error", 1.0).when(F.col("event_type") == "purchase", 0.8).otherwise(0.4)
    score = kind * F.when(F.col("nxt") == "error", 1.5).otherwise(1.0) * F.when(F.col("rep") > 1, 0.5).otherwise(1.0) * (0.5 + 0.5 * F.exp(-F.col("back") / 20.0))
    return e.select("event_id", F.round(score, 6).alias("score"))


def ewma(values: Column, alpha: float = 0.2, start: float = 0.5) -> Column:
    """Exponentially weighted mean of an ordered array."""
    return F.aggregate(values, F.lit(start), lambda m, x: m * (1 - alpha) + x * alpha)


@query(
    "ewma_by_domain",
    """
    SELECT source AS domain, round(list_reduce(list_prepend(0.5::DOUBLE, list(quality::DOUBLE ORDER BY l.doc_id)), lambda m, x: m * 0.8::DOUBLE + x * 0.2::DOUBLE), 6) AS prior FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1
    """,
)
def ewma_by_domain(spark, sf_dir):
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda s: s.quality.cast("double"))
    return l.groupBy(F.col("source").alias("domain")).agg(F.round(ewma(ordered), 6).alias("prior"))


@query(
    "replay_episodes",
    """
    WITH k AS (SELECT user_id, event_id, event_type FROM events WHERE event_type <> 'view'), r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM k)
    SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS calls, count(*) FILTER (event_type = 'click') AS greps FROM r WHERE event_type <> 'purchase' GROUP BY 1, 2 HAVING count(*) >= 2 AND count(*) FILTER (event_type = 'click') >= 1
    """,
)
def replay_episodes(spark, sf_dir):
    """Runs between breakers, transparent kinds left out; a run counts with two calls, one of them a search."""
    k = segments(table(spark, sf_dir, "events").where("event_type <> 'view'"), ["user_id"], ["event_id"], F.col("event_type") == "purchase")
    runs = k.where("event_type <> 'purchase'").groupBy("user_id", F.col("segment").alias("run")).agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "click").alias("greps"))
    return runs.where("calls >= 2 AND greps >= 1")


@query(
    "adjacent_batches",
    """
    WITH c AS (SELECT *, coalesce(CASE WHEN event_type <> lag(event_type) OVER w THEN 1 ELSE 0 END, 1) AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
    SELECT user_id, event_type, min(event_id) AS first_event, count(*) AS n FROM i GROUP BY user_id, event_type, island HAVING count(*) >= 2
    """,
)
def adjacent_batches(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    cut = F.coalesce(F.col("event_type") != F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(True))
    i = segments(e.withColumn("cut", cut), ["user_id"], ["event_id"], F.col("cut"))
    return i.groupBy("user_id", "event_type", "segment").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n")).where("n >= 2").drop("segment")


@query(
    "folded_log_runs",
    """
    WITH l AS (SELECT user_id, event_id, event_type || ' took ' || event_id || 'ms at ' || CAST(round(value) AS BIGINT) || '% of 12:30:' || (10 + event_id % 50) AS line, event_type || ' took <duration> at <percent> of <time>' AS sig FROM events),
    c AS (SELECT *, CASE WHEN sig = lag(sig) OVER w THEN 0 ELSE 1 END AS cut FROM l WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM c),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS len, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS pos FROM i)
    SELECT event_id, line, CASE WHEN len >= 4 THEN len - 2 ELSE 0 END AS folded FROM n WHERE len < 4 OR pos = 1 OR pos = len
    """,
)
def folded_log_runs(spark, sf_dir):
    """Adjacent lines with one volatile signature: of four or more only the first and the last stay."""
    line = F.concat("event_type", F.lit(" took "), "event_id", F.lit("ms at "), F.round("value").cast("long"), F.lit("% of 12:30:"), 10 + F.col("event_id") % 50)
    l = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line")).withColumn("sig", log_signature(F.col("line")))
    cut = F.coalesce(F.col("sig") != F.lag("sig").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(True))
    i = segments(l.withColumn("cut", cut), ["user_id"], ["event_id"], F.col("cut"))
    w = Window.partitionBy("user_id", "segment")
    n = i.withColumns({"len": F.count("*").over(w), "pos": F.row_number().over(w.orderBy("event_id"))})
    return n.where("len < 4 OR pos = 1 OR pos = len").select("event_id", "line", F.when(F.col("len") >= 4, F.col("len") - 2).otherwise(0).cast("long").alias("folded"))


@query(
    "trailing_similarity",
    """
    WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM conversations)
    SELECT a.conv_id, a.turn, round(max(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END), 6) AS most
    FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 3 GROUP BY 1, 2
    """,
)
def trailing_similarity(spark, sf_dir):
    """The largest word Jaccard of a step with one of the three before it; neighbours come from a window, not a join."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(words(F.col("text"))).alias("w"))
    near = F.collect_list(F.struct("turn", "w")).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(-3, -1))
    t = t.withColumn("near", near).where(F.size("near") > 0)
    return t.select("conv_id", "turn", F.round(F.array_max(F.transform("near", lambda s: jaccard(F.col("w"), s.w, 0.0))), 6).alias("most"))


def greedy_pack(ranked: Column, budget: int) -> Column:
    """Kept items of an ordered array of structs with ``cost``: one that does not fit is skipped, later ones are still tried."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.slice(ranked, 1, 0).alias("kept"))
    step = lambda a, x: F.when(
        a.used + x.cost <= budget, F.struct((a.used + x.cost).alias("used"), F.concat(a.kept, F.array(x)).alias("kept"))
    ).otherwise(a)
    return F.aggregate(ranked, start, step)


@query(
    "greedy_budget_packing",
    """
    WITH r AS (SELECT conv_id, list(CAST(ceil(length(text) / 4.0) AS BIGINT) ORDER BY turn DESC) AS costs FROM conversations GROUP BY 1),
    p AS (SELECT conv_id, list_reduce(list_prepend(0::BIGINT, costs), lambda a, c: CASE WHEN a % 1000000 + c <= 400 THEN a + c + 1000000 ELSE a END) AS acc FROM r)
    SELECT conv_id, acc % 1000000 AS used, acc // 1000000 AS kept FROM p
    """,
)
def greedy_budget_packing(spark, sf_dir):
    """Newest turns first into a budget of tokens."""
    cost = F.ceil(F.length("text") / 4).cast("long")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("turn")).alias("rank"), cost.alias("cost"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(greedy_pack(ranked, 400).alias("p")).select("conv_id", F.col("p.used").alias("used"), F.size("p.kept").cast("long").alias("kept"))


@query(
    "burn_rate_and_runway",
    """
    WITH d AS (SELECT user_id, event_id, value, value - lag(value) OVER w AS rate, CASE WHEN value < lag(value) OVER w THEN 1 ELSE 0 END AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
    s AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM d), l AS (SELECT *, max(segment) OVER (PARTITION BY user_id) AS last_segment FROM s),
    b AS (SELECT user_id, max_by(value, event_id) AS now, quantile_cont(rate, 0.5) FILTER (reset = 0 AND rate IS NOT NULL) AS burn FROM l WHERE segment = last_segment GROUP BY 1)
    SELECT user_id, round(burn, 6) AS burn, CASE WHEN burn > 0 THEN round(least(greatest((300 - now) / burn, 0), 1000), 4) END AS runway FROM b
    """,
)
def burn_rate_and_runway(spark, sf_dir):
    """Median of the rates since the last drop, and how many steps it leaves."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    prev = F.lag("value").over(w)
    d = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.col("value") - prev).alias("rate"), F.coalesce(F.col("value") < prev, F.lit(False)).alias("reset"))
    s = segments(d, ["user_id"], ["event_id"], F.col("reset")).withColumn("last", F.max("segment").over(Window.partitionBy("user_id"))).where("segment = last")
    b = s.groupBy("user_id").agg(F.max_by("value", "event_id").alias("now"), F.percentile(F.when(~F.col("reset"), F.col("rate")), 0.5).alias("burn"))
    runway = F.when(F.col("burn") > 0, F.round(F.least(F.greatest((300 - F.col("now")) / F.col("burn"), F.lit(0.0)), F.lit(1000.0)), 4))
    return b.select("user_id", F.round("burn", 6).alias("burn"), runway.alias("runway"))


@query(
    "transcript_keep_last",
    """
    SELECT conv_id, role, min(turn) AS first_turn, max(turn) AS last_turn, max_by(length(text), turn) AS chars, count(*) AS versions FROM conversations GROUP BY 1, 2
    """,
)
def transcript_keep_last(spark, sf_dir):
    """The last version of each message counts; its time stays that of the first."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.max_by(F.length("text"), "turn").alias("chars"), F.count("*").alias("versions"))
