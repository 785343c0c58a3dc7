"""Composite ranking and decision operators: hybrid recall, rule scores, trigram search, pricing, classification, drift."""

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import jaccard, words, zero
from ..registry import query
from ..shared import dealt, shared_folder, written
from ..sources.tables import table
from .graph import bounded_bfs, supplier_edges
from .retrieval import _BM25_SQL, blended, pair_cosines, search_documents, top_k
from .windows import greedy_pack


@query(
    "passage_hybrid",
    _BM25_SQL + """
    , v AS (SELECT vec_id, embedding::DOUBLE[] AS e, count(*) OVER () AS many FROM embeddings),
    h AS (SELECT r.item_id, r.doc_id, 0.6::DOUBLE * least(greatest(list_cosine_similarity(p.e, q.e), 0), 1) + 0.4::DOUBLE * score / max(score) OVER (PARTITION BY item_id) AS s
      FROM r JOIN v p ON p.vec_id = r.doc_id % p.many JOIN v q ON q.vec_id = r.item_id % q.many)
    SELECT item_id, doc_id, round(s, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(s, 9) DESC, doc_id) AS place FROM h) WHERE place <= 5
    """,
)
def passage_hybrid(spark, sf_dir):
    """0.6 of the clamped cosine of passage and query and 0.4 of BM25 over its largest; vectors are dealt to both by their ids."""
    scored = search_documents(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings")
    many = vectors.count()
    of = lambda name, key: table(spark, sf_dir, name).select(key).join(vectors, F.col(key) % many == F.col("vec_id")).select(key, F.col("embedding").alias("vector"))
    pairs = pair_cosines(scored, of("documents", "doc_id"), of("benchmark", "item_id"), "doc_id", "item_id").where("known")
    found = blended(pairs, "item_id").select("item_id", "doc_id", F.col("total").alias("score"))
    return top_k(found, "item_id", "score", "doc_id", 5).withColumn("score", F.round("score", 6))


@query(
    "block_rule_score",
    """
    SELECT doc_id, round(0.30 * (source = 'src1')::INT + 0.25 * regexp_matches(lang, '^e')::INT + 0.20 * (contains(text, 'the')::INT + contains(text, 'and')::INT) / 2.0 + 0.15 * contains(text, 'token')::INT + 0.10 * quality, 6)::DOUBLE AS score FROM documents JOIN labels USING (doc_id)
    """,
)
def block_rule_score(spark, sf_dir):
    """Weighted domain, scope, triggers, failures and history; scope is a glob turned into a pattern."""
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    triggers = F.array(F.lit("the"), F.lit("and"))
    hit = F.size(F.filter(triggers, lambda t: F.contains("text", t))) / F.size(triggers)
    one = lambda c: c.cast("int")
    score = 0.30 * one(F.col("source") == "src1") + 0.25 * one(F.rlike("lang", F.lit("^e"))) + 0.20 * hit + 0.15 * one(F.contains("text", F.lit("token"))) + 0.10 * F.col("quality")
    return x.select("doc_id", F.round(score, 6).alias("score"))


@query(
    "symbol_score",
    """
    WITH t AS (SELECT p_partkey, lower(p_name) AS n, string_split(lower(p_name), ' ') AS w, p_size, p_brand FROM part), m AS (SELECT *, len(list_filter(w, lambda x: x IN ('part', '1', '12'))) AS k FROM t)
    SELECT p_partkey, round(20.0 * k / 3 + CASE WHEN starts_with(n, 'part') THEN 24 ELSE 0 END + CASE WHEN k > 1 THEN 28 + 6 * k + 12 * (k - 1) ELSE 9 * k END + 30 * p_size / 50.0 - CASE WHEN contains(lower(p_brand), '13') THEN 90 ELSE 0 END, 6)::DOUBLE AS score FROM m
    """,
)
def symbol_score(spark, sf_dir):
    """An additive score of coverage, prefix, name matches, centrality and a penalty, in one expression."""
    wanted = F.array(*map(F.lit, ("part", "1", "12")))
    name = F.lower("p_name")
    k = F.size(F.filter(F.split(name, " "), lambda x: F.array_contains(wanted, x)))
    score = 20.0 * k / 3 + F.when(F.startswith(name, F.lit("part")), 24).otherwise(0) + F.when(k > 1, 28 + 6 * k + 12 * (k - 1)).otherwise(9 * k) + 30 * F.col("p_size") / 50.0 - F.when(F.contains(F.lower("p_brand"), F.lit("13")), 90).otherwise(0)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query(
    "knapsack_by_density",
    """
    WITH r AS (SELECT c_nationkey, list(CAST(1 + c_custkey % 37 AS BIGINT) ORDER BY -((c_acctbal + 1000) / (1 + c_custkey % 37)), c_custkey) AS costs FROM customer GROUP BY 1), p AS (SELECT c_nationkey, list_reduce(list_prepend(0::BIGINT, costs), lambda a, c: CASE WHEN a % 1000000 + c <= 150 THEN a + c + 1000000 ELSE a END) AS acc FROM r)
    SELECT c_nationkey AS source, acc % 1000000 AS used, acc // 1000000 AS kept FROM p
    """,
)
def knapsack_by_density(spark, sf_dir):
    """Greedy by utility per token; the source bonus is the same for every block and so changes nothing."""
    cost = 1 + F.col("c_custkey") % 37
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.struct((-(F.col("c_acctbal") + 1000) / cost).alias("rank"), F.col("c_custkey").alias("tie"), cost.cast("long").alias("cost")).alias("x"))
    return c.groupBy(F.col("c_nationkey").alias("source")).agg(greedy_pack(F.array_sort(F.collect_list("x")), 150).alias("p")).select("source", F.col("p.used").alias("used"), F.size("p.kept").cast("long").alias("kept"))


def exact_knapsack(costs: list[int], gains: list[float], budget: int) -> list[int]:
    """The most valuable choice within the budget, by dynamic programming over the budget."""
    best, chosen = [0.0] * (budget + 1), [[] for _ in range(budget + 1)]
    for i, (c, g) in enumerate(zip(costs, gains, strict=True)):
        for room in range(budget, c - 1, -1):
            if best[room - c] + g > best[room] + 1e-12:
                best[room], chosen[room] = best[room - c] + g, [*chosen[room - c], i]
    return chosen[budget]


@query("knapsack_exact")
def knapsack_exact(spark, sf_dir):
    """The best set of turns for 60 tokens in each conversation; one conversation is one small problem."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        costs = [max(1, math.ceil(len(t or "") / 40)) for t in pdf.text]
        picks = exact_knapsack(costs, [len(set((t or "").split())) for t in pdf.text], 60)
        return pd.DataFrame({"conv_id": pdf.conv_id.iloc[picks].to_numpy(), "turn": pdf.turn.iloc[picks].to_numpy()})

    return table(spark, sf_dir, "conversations").groupBy("conv_id").applyInPandas(solve, "conv_id long, turn long")


def _grams(word: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a word, in time that grows with its length only."""
    c = F.split(word, "")
    run = lambda i: F.concat(*[F.get(c, i + j) for j in range(size)])
    return F.when(F.length(word) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.length(word) - size), run))).otherwise(F.array().cast("array<string>"))


def gram_search(docs: DataFrame, needles: DataFrame, key: str, text: str, needle: str = "needle") -> DataFrame:
    """(``needle``, ``key``) of texts that contain a needle.

    The longest piece of a needle between spaces must be in some word of the text. Pieces meet the vocabulary, each word
    once however many texts have it, on their trigrams (shorter ones as a gram of their own length): all of a piece's
    grams must be there, then the word is looked at, then the text. A needle of spaces alone is in the texts with as long a
    row of spaces. Null and empty needles match nothing.
    """
    longest = F.array_max(F.transform(F.filter(F.split(needle, " "), lambda w: F.length(w) > 0), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    n = needles.select(needle, longest.alias("piece")).where("piece IS NOT NULL").distinct()
    c = F.col("piece")
    of = F.when(F.length(c) == 1, _grams(c, 1)).when(F.length(c) == 2, _grams(c, 2)).otherwise(_grams(c, 3))
    pieces = n.select("piece").distinct().withColumn("g", of).select("piece", F.size("g").alias("all"), F.explode("g").alias("gram"))
    words_of = docs.select(key, F.explode(F.array_distinct(F.split(text, " "))).alias("word")).where("word <> ''")
    index = words_of.select("word").distinct().select("word", F.explode(F.concat(*[_grams(F.col("word"), size) for size in (1, 2, 3)])).alias("gram"))
    hit = index.join(pieces, "gram").groupBy("piece", "word", "all").agg(F.count("*").alias("n")).where("n = all").where(F.contains("word", "piece"))
    found = words_of.join(hit.select("piece", "word"), "word").select("piece", key).distinct().join(n, "piece")
    met = found.select(needle, key).join(docs.select(key, text), key).where(F.contains(text, needle)).select(needle, key).distinct()
    blank = needles.where(F.rlike(needle, F.lit("^ +$"))).select(needle, F.length(needle).alias("n")).distinct()
    sizes = F.broadcast(blank.agg(F.collect_set("n").alias("sizes")))  # one row, a number for each length
    longest = F.array_max(F.transform(F.regexp_extract_all(text, F.lit("( +)")), F.length))
    spaced = docs.select(key, longest.alias("row")).where("row > 0").join(sizes).select(key, F.explode(F.filter("sizes", lambda n: n <= F.col("row"))).alias("n"))
    return met.unionByName(spaced.join(blank, "n").select(needle, key))


@query("trigram_index_search", "SELECT n AS needle, doc_id FROM (VALUES ('Apache License'), ('password='), ('idiot'), ('qu'), ('Z')) v(n) JOIN documents ON contains(text, n)")
def trigram_index_search(spark, sf_dir):
    needles = spark.createDataFrame([("Apache License",), ("password=",), ("idiot",), ("qu",), ("Z",)], "needle string")
    return gram_search(table(spark, sf_dir, "documents"), needles, "doc_id", "text")


@query(
    "search_verdicts",
    """
    WITH q AS (SELECT user_id, event_id, event_type, CASE WHEN value > 30 THEN 1 ELSE 0 END AS hits FROM events), s AS (SELECT *, sum(hits) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seg FROM q),
    e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, seg ORDER BY event_id) - CASE WHEN seg > 0 THEN 1 ELSE 0 END AS streak FROM s)
    SELECT event_id, CASE WHEN hits > 0 THEN 'found' WHEN event_type = 'signup' THEN 'dark' WHEN streak >= 3 THEN 'absent' ELSE 'missed' END AS verdict FROM e
    """,
)
def search_verdicts(spark, sf_dir):
    """Found, dark if a channel is off, absent after enough empty searches of one area since its last hit, else missed."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    q = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("value") > 30).cast("int").alias("hits"))
    s = q.withColumn("seg", F.sum("hits").over(w))
    streak = F.row_number().over(Window.partitionBy("user_id", "event_type", "seg").orderBy("event_id")) - (F.col("seg") > 0).cast("int")
    verdict = F.when(F.col("hits") > 0, "found").when(F.col("event_type") == "signup", "dark").when(F.col("streak") >= 3, "absent").otherwise("missed")
    return s.withColumn("streak", streak).select("event_id", verdict.alias("verdict"))


# Keyword rules of commit classes in their order, and what a conventional prefix stands for.
COMMIT_RULES = (
    ("revert", r"\brevert(s|ed|ing)?\b|^revert\b|this reverts commit"),
    ("rename", r"\bren(ame|aming)\b|\bmov(e|ed|ing)\b"),
    ("perf", r"\bperf\b|\bperformance\b|\boptimi[sz]e?(s|d|ing)?\b|\bspeed ?up\b|\bfaster\b"),
    ("bugfix", r"\bfix(es|ed|ing)?\b|\bbug\b|\bhotfix\b|\bpatch\b|\bregression\b|\bcrash\b"),
    ("refactor", r"\brefactor(s|ed|ing)?\b|\bcleanup\b|\btidy\b|\bsimplif(y|ies|ied)\b"),
    ("docs", r"\bdocs?\b|\bdocumentation\b|\breadme\b|\bchangelog\b"),
    ("test", r"\btests?\b|\bunit ?test\b|\bcoverage\b|\bpytest\b|\bspec\b"),
    ("feature", r"\bfeat\b|\bfeature\b|\badd(s|ed|ing)?\b|\bimplement(s|ed|ing)?\b|\bintroduce(s|d)?\b|\bsupport\b"),
    ("chore", r"\bchore\b|\bbump\b|\bdeps?\b|\bdependenc(y|ies)\b|\bci\b|\bbuild\b|\brelease\b"),
)
COMMIT_PREFIXES = {"feat": "feature", "fix": "bugfix", "perf": "perf", "refactor": "refactor", "docs": "docs", "test": "test", "chore": "chore", "build": "chore", "ci": "chore", "revert": "revert", "style": "refactor"}
DOC_FILE = r"\.(md|markdown|rst|txt)$|/docs/"
TEST_FILE = r"(^|/)test_[^/]*$|_test\.py$|\.(test|spec)\.[^/]*$|/tests?/"


def commit_class(message: Column, files: Column | None = None) -> Column:
    """A struct of class and confidence.

    In this order: a known conventional prefix of the first line, an explicit revert anywhere, the first keyword rule that
    the first line meets, what all ``files`` are, else chore. A null or blank message leaves it to the files.
    """
    whole = F.lower(F.coalesce(F.trim(message), F.lit("")))
    subject = F.substring_index(whole, "\n", 1)
    both = lambda c, p: F.struct((c if isinstance(c, Column) else F.lit(c)).alias("class"), F.lit(p).alias("confidence"))
    known = F.create_map(*[F.lit(x) for pair in COMMIT_PREFIXES.items() for x in pair])
    prefix = F.try_element_at(known, F.regexp_extract(subject, r"^([a-z]+)(?:\([^)]*\))?!?:", 1))
    out = F.when(prefix.isNotNull(), both(prefix, 0.9)).when(F.contains(whole, F.lit("this reverts commit")), both("revert", 0.85))
    for name, pattern in COMMIT_RULES:
        out = out.when(F.rlike(subject, F.lit(pattern)), both(name, 0.6))
    if files is not None:
        some = F.size(files) > 0
        every = lambda pattern: some & F.forall(files, lambda f: F.rlike(F.lower(f), F.lit(pattern)))
        out = out.when(every(DOC_FILE), both("docs", 0.5)).when(every(TEST_FILE), both("test", 0.5))
    return out.otherwise(both("chore", 0.2))


# Messages and files by event type, for the query below.
_COMMITS = {
    "click": ("fix(ui): button\nthis reverts commit 1", "src/a.py"), "view": ("Adds a page\nand fixes a bug", "src/b.py"), "error": ("Undo\nThis reverts commit 12", "c.py"),
    "signup": ("Prefixed: misc", "docs/tests/a.md"), "purchase": ("misc", "pkg/tests/x.py"),
}
_PREFIX_SQL = "regexp_extract(s, '^([a-z]+)(?:\\([^)]*\\))?!?:', 1)"
_COMMIT_SQL = f"""
    WITH m AS (SELECT event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v[0].lower()}'" for k, v in _COMMITS.items())} END AS m, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _COMMITS.items())} END AS f FROM events),
    s AS (SELECT *, split_part(m, '{chr(10)}', 1) AS s FROM m),
    c AS (SELECT CASE {" ".join(f"WHEN {_PREFIX_SQL} = '{k}' THEN '{v}|0.9'" for k, v in COMMIT_PREFIXES.items())} WHEN contains(m, 'this reverts commit') THEN 'revert|0.85'
      {" ".join(f"WHEN regexp_matches(s, '{p}') THEN '{n}|0.6'" for n, p in COMMIT_RULES)} WHEN regexp_matches(f, '{DOC_FILE}') THEN 'docs|0.5' WHEN regexp_matches(f, '{TEST_FILE}') THEN 'test|0.5' ELSE 'chore|0.2' END AS c FROM s)
    SELECT split_part(c, '|', 1) AS class, CAST(split_part(c, '|', 2) AS DOUBLE) AS confidence, count(*) AS n FROM c GROUP BY 1, 2
"""


@query("commit_classes", _COMMIT_SQL)
def commit_classes(spark, sf_dir):
    of = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in _COMMITS.items() for x in (k, v[i])]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(commit_class(of(0), F.array(of(1))).alias("c")).groupBy("c.class", "c.confidence").agg(F.count("*").alias("n"))


@query(
    "documentation_gaps",
    "WITH r AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS token FROM documents) SELECT doc_id, count(*) AS gaps FROM r WHERE lower(token) NOT IN (SELECT lower(n_name) FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT 'the') GROUP BY 1",
)
def documentation_gaps(spark, sf_dir):
    """References without a symbol of that name, counted once for each document and token."""
    d = table(spark, sf_dir, "documents")
    r = d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)")))).alias("token"))
    known = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("k")).union(table(spark, sf_dir, "region").select(F.lower("r_name"))).union(spark.createDataFrame([("the",)], "k string")).distinct()
    return r.join(known, F.lower("token") == F.col("k"), "left_anti").groupBy("doc_id").agg(F.count("*").alias("gaps"))


# ---------------------------------------------------------------- pricing
# Last-resort rates, USD for a million tokens.
FALLBACK_RATES = {"input": 3.0, "output": 15.0, "cache_read": 0.30, "cache_write": 3.75}


def tiered_cost(tokens: Column, tiers: list[tuple[int, float]]) -> Column:
    """Progressive tiers of (upper bound, rate a million); the last bound is open."""
    parts, low = [], 0
    for bound, rate in tiers:
        upper = tokens if bound < 0 else F.least(tokens, F.lit(bound))
        parts.append(F.greatest(upper - low, F.lit(0)) * rate / 1e6)
        low = bound
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


@query(
    "priced_usage",
    """
    WITH r AS (SELECT 'click' AS id, 2.0::DOUBLE AS input UNION ALL SELECT 'view', 0.5::DOUBLE), u AS (SELECT event_type, CAST(floor(value * 10000) AS BIGINT) AS tokens FROM events)
    SELECT event_type AS model, round(sum(tokens * coalesce(input, 3.0::DOUBLE) / 1e6), 4) AS flat, round(sum(least(tokens, 200000) * 3.0::DOUBLE / 1e6 + greatest(tokens - 200000, 0) * 6.0::DOUBLE / 1e6), 4) AS tiered, bool_and(input IS NULL) AS fallback FROM u LEFT JOIN r ON id = event_type GROUP BY 1
    """,
)
def priced_usage(spark, sf_dir):
    """Rates by model with a fallback, and the progressive form with two tiers."""
    rates = F.broadcast(spark.createDataFrame([("click", 2.0), ("view", 0.5)], "id string, input double"))
    u = table(spark, sf_dir, "events").select("event_type", F.floor(F.col("value") * 10000).alias("tokens"))
    x = u.join(rates, F.col("event_type") == F.col("id"), "left")
    return x.groupBy(F.col("event_type").alias("model")).agg(
        F.round(F.sum(F.col("tokens") * F.coalesce("input", F.lit(FALLBACK_RATES["input"])) / 1e6), 4).alias("flat"), F.round(F.sum(tiered_cost(F.col("tokens"), [(200_000, 3.0), (-1, 6.0)])), 4).alias("tiered"), F.bool_and(F.col("input").isNull()).alias("fallback"))


@query(
    "rewrite_break_even",
    "SELECT l_suppkey AS prefix, count(*) AS uses, round(sum(l_quantity) * 0.25 / nullif(count(*) * 0.9, 0), 6) AS break_even, sum(l_quantity) * 0.25 < count(*) * 0.9 * 8 AS worth_it FROM lineitem GROUP BY 1",
)
def rewrite_break_even(spark, sf_dir):
    """How many reads pay for a rewrite."""
    cost, gain = F.sum("l_quantity") * 0.25, F.count("*") * 0.9
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("prefix")).agg(F.count("*").alias("uses"), F.round(F.try_divide(cost, gain), 6).alias("break_even"), (cost < gain * 8).alias("worth_it"))


@query(
    "evidence_still_valid",
    "WITH t AS (SELECT max(o_orderdate) AS now FROM orders), m AS (SELECT o_orderkey, o_orderdate, md5(o_orderpriority || o_orderstatus) AS fp FROM orders), n AS (SELECT o_orderkey, md5(o_orderpriority || CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END) AS fp FROM orders) SELECT m.o_orderkey, CASE WHEN m.fp <> n.fp THEN 'changed' WHEN o_orderdate < now - INTERVAL 365 DAY THEN 'expired' ELSE 'valid' END AS state FROM m JOIN n USING (o_orderkey), t",
)
def evidence_still_valid(spark, sf_dir):
    """Evidence may be reused while its fingerprint is unchanged and its time has not run out."""
    o = table(spark, sf_dir, "orders")
    now = F.broadcast(o.agg(F.max("o_orderdate").alias("now")))
    m = o.select("o_orderkey", "o_orderdate", F.md5(F.concat("o_orderpriority", "o_orderstatus")).alias("fp"))
    n = o.select("o_orderkey", F.md5(F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")))).alias("fp_now"))
    state = F.when(F.col("fp") != F.col("fp_now"), "changed").when(F.expr("o_orderdate < now - INTERVAL 365 DAY"), "expired").otherwise("valid")
    return m.join(n, "o_orderkey").join(now).select("o_orderkey", state.alias("state"))


# ---------------------------------------------------------------- duplicate clusters and events
@query("duplicate_clusters")
def duplicate_clusters(spark, sf_dir):
    """Seed-anchored clusters: in id order each item not yet taken takes all later ones with word Jaccard of 0.75 or more.

    Pairs meet on a shared word of their rarest ones (a pair that alike must share one of the first quarter plus one in
    order of rarity), are verified, and the greedy pass runs on the links of each connected group.
    """
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.array_distinct(words(F.col("text"))).alias("w"))
    df = d.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    ranked = d.select("id", F.explode("w").alias("word")).join(df, "word").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda s: s.word).alias("w"))
    ranked.write.parquet(path := shared_folder(spark, "ranked"))
    ranked = spark.read.parquet(path)
    prefix = ranked.select("id", "w", F.explode(F.slice("w", 1, (F.size("w") - F.ceil(F.size("w") * 0.75) + 1).cast("int"))).alias("word"))
    a, b = prefix.alias("a"), prefix.alias("b")
    pairs = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("seed"), F.col("b.id").alias("member"), F.col("a.w").alias("wa"), F.col("b.w").alias("wb")).dropDuplicates(["seed", "member"])
    links = pairs.where(jaccard(F.col("wa"), F.col("wb"), 0.0) >= 0.75).select("seed", "member")
    # an item is a seed if no smaller seed takes it: settled in rounds, each of which decides all with no undecided smaller neighbour
    links.write.parquet(path := shared_folder(spark, "links"))
    links = spark.read.parquet(path)
    undecided, taken = d.select("id"), None
    while undecided.limit(1).count():
        waiting = links.join(undecided.withColumnRenamed("id", "seed"), "seed", "left_semi").select(F.col("member").alias("id")).distinct()
        seeds = undecided.join(waiting, "id", "left_anti").select(F.col("id").alias("seed"))
        got = seeds.join(links, "seed").join(undecided.withColumnRenamed("id", "member"), "member", "left_semi").groupBy("member").agg(F.min("seed").alias("seed"))
        step = got.select("seed", "member").unionByName(seeds.select("seed", F.col("seed").alias("member")))
        step.write.parquet(path := shared_folder(spark, "clusters"))
        step = spark.read.parquet(path)
        taken = step if taken is None else taken.unionByName(step)
        undecided.join(step.select(F.col("member").alias("id")), "id", "left_anti").write.parquet(path := shared_folder(spark, "undecided"))
        undecided = spark.read.parquet(path)
    return taken if taken is not None else spark.createDataFrame([], "seed long, member long")


def degrees_within(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``node``, ``depth``, ``degree`` of the nodes within ``depth`` steps of ``seeds`` either way; ``edges``: ``src``, ``dst``, each once.

    Edges are written once for all steps and dealt by rows where they are joined; the walk makes nodes distinct, edges it need not.
    """
    e = written(edges, "edges")
    rows = e.count()
    both = dealt(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), 2 * rows, "src")
    near = bounded_bfs(both, seeds, depth)
    kept = written(near.select("node"), "near")
    inner = dealt(e, rows, "src").join(kept.withColumnRenamed("node", "src"), "src", "left_semi")
    inner = dealt(inner, rows, "dst").join(kept.withColumnRenamed("node", "dst"), "dst", "left_semi")
    degree = inner.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return near.join(degree, "node", "left").select("node", "depth", zero("degree").alias("degree"))


@query(
    "neighbourhood_degrees",
)
def neighbourhood_degrees(spark, sf_dir):
    """Nodes within two steps of a seed either way, with their degree among these nodes."""
    return degrees_within(supplier_edges(spark, sf_dir).select("src", "dst"), spark.createDataFrame([(1,)], "node long"), 2)


def columnar_encode(rows: list[dict]) -> dict:
    """Rows of a result page as columns: a legend of repeated strings, and which fields each row has."""
    columns = list(dict.fromkeys(k for r in rows for k in r))
    counts: dict[str, int] = {}
    for r in rows:
        for v in r.values():
            if isinstance(v, str):
                counts[v] = counts.get(v, 0) + 1
    legend = [v for v, n in counts.items() if n > 1 and len(v) > 3]
    place = {v: i for i, v in enumerate(legend)}
    data = {c: [{"#": place[r[c]]} if isinstance(r.get(c), str) and r[c] in place else r.get(c) for r in rows if c in r] for c in columns}
    return {"columns": columns, "legend": legend, "present": {c: [c in r for r in rows] for c in columns}, "data": data, "n": len(rows)}


def columnar_decode(page: dict) -> list[dict]:
    out: list[dict] = [{} for _ in range(page["n"])]
    for c in page["columns"]:
        values = iter(page["data"][c])
        for row, there in zip(out, page["present"][c], strict=True):
            if there:
                v = next(values)
                row[c] = page["legend"][v["#"]] if isinstance(v, dict) and "#" in v else v
    return out


def search_mode(text: str) -> str:
    """Identifiers go to the lexical index, sentences to the hybrid one."""
    return "lexical" if re.fullmatch(r"[A-Za-z_][\w.:]*(\(\))?", text.strip()) else "hybrid"
