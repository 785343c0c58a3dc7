"""Retrieval: tokenising, BM25 in its variants, vector similarity, rank fusion, diversity, metrics.

Queries are tables too, so that many are answered in one job: terms are exploded on both sides and meet in an equi join.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine
from ..registry import query
from ..shared import dealt, kept, written
from ..sources.tables import table

# Stopwords and suffixes (the first that matches goes) of the tokenizer.
STOPWORDS = """a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought
in on at to for of with by from up about into through during self cls none true false not no and or but if then else return import pass
def class lambda yield assert raise except finally try as del global nonlocal async await""".split()
SUFFIXES = ("ing", "tion", "ation", "ness", "ment", "ity", "ly", "ed", "er", "s")


def stem(word: Column) -> Column:
    out = F.when(F.lit(False), word)
    for suffix in SUFFIXES:
        out = out.when((F.length(word) > len(suffix) + 3) & F.endswith(word, F.lit(suffix)), F.substr(word, F.lit(1), F.length(word) - len(suffix)))
    return out.otherwise(word)


def kept_words(text: Column) -> Column:
    """Words of letters and digits that start with a letter, camel case cut, without stopwords."""
    cut = F.lower(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"))
    found = F.regexp_extract_all(cut, F.lit("([a-z][a-z0-9]*)"))
    return F.filter(found, lambda t: (F.length(t) >= 2) & ~t.isin(STOPWORDS))


def tokens(text: Column) -> Column:
    """The kept words of a text, stemmed."""
    return F.transform(kept_words(text), stem)


#: Bytes of text of a task that makes an index, and hits of a task that sums scores, about.
TASK_BYTES, TASK_HITS = 16_000_000, 2_000_000


def term_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``term``, ``tf``, ``dl``: the inverted index, to be written once and read by each search.

    Texts are dealt by their key first, so that their words are counted and their lengths summed where they are cut;
    stopwords go and stems are made after words are exploded, where the compiled stage does it. A task has about
    ``TASK_BYTES`` of text, however large the table. ``key`` must differ for all rows.
    """
    cut = F.lower(F.regexp_replace(F.col(text), "([a-z])([A-Z])", "$1 $2"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    word = dealt(docs.select(key, text), size, key, task_rows=TASK_BYTES).select(key, F.explode(F.regexp_extract_all(cut, F.lit("([a-z][a-z0-9]*)"))).alias("_w"))
    word = word.where((F.length("_w") >= 2) & ~F.col("_w").isin(STOPWORDS)).select(key, stem(F.col("_w")).alias("term"))
    tf = word.groupBy(key, "term").agg(F.count("*").alias("tf"))
    return tf.withColumn("dl", F.sum("tf").over(Window.partitionBy(key)))


def kept_terms(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The ``term_table`` of a table as it was read, written once for all searches until its files change."""
    return kept(lambda: term_table(docs, key, text), docs.select(key, text), f"terms-{key}-{text}")


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, query_key: str, query_text: str, k1: float = 1.5, b: float = 0.75, index: DataFrame | None = None) -> DataFrame:
    """``query_key``, ``key``, ``score`` of all pairs with a term in common, ``met`` (different terms in common) and ``asked`` (different terms of the query that some text has).

    Repeated query terms count again; the mean length is at least 1; terms with idf <= 0 add nothing. With ``index`` (a
    written ``term_table``) texts are not cut again.
    """
    index = term_table(docs, key, text) if index is None else index
    # the number of documents needs no text, and the sum of lengths is that of the counts: texts are cut once
    total = index.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    stats = F.broadcast(docs.agg(F.count("*").alias("n")).join(total).select("n", F.greatest(F.col("total") / F.greatest("n", F.lit(1)), F.lit(1.0)).alias("avgdl")))  # one row
    q = queries.select(query_key, F.explode(tokens(F.col(query_text))).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    wanted = index.join(q.select("term").distinct(), "term", "left_semi")  # other terms never reach the sums below
    df = wanted.groupBy("term").agg(F.count("*").alias("df")).join(stats)
    idf = df.withColumn("idf", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)).where("idf > 0")
    # a term's queries and weights go out together: few rows, for terms that are asked for
    weighed = q.join(idf, "term").withColumn("asked", F.count("*").over(Window.partitionBy(query_key)))
    # a document's hits are summed where its terms are dealt; documents of one term added up over all queries are the number of hits
    weighed = written(weighed, "weights")
    hits = weighed.agg(F.sum("df")).first()[0] or 0
    hit = dealt(wanted, hits, key, task_rows=TASK_HITS).join(weighed, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy(query_key, key).agg(F.sum(part).alias("score"), F.count("*").alias("met"), F.max("asked").alias("asked"))


def search_documents(spark, sf_dir) -> DataFrame:
    """BM25 of all items over all documents, on the kept index."""
    d = table(spark, sf_dir, "documents")
    return bm25(d, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", index=kept_terms(d, "doc_id", "text"))


def top_k(scored: DataFrame, by: str, score: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.round(score, 9).desc(), key)
    return scored.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= k)


_STEM_SQL = "CASE " + " ".join(f"WHEN len(t) > {len(s) + 3} AND ends_with(t, '{s}') THEN substr(t, 1, len(t) - {len(s)})" for s in SUFFIXES) + " ELSE t END"


def _tokens_sql(text: str) -> str:
    cut = f"regexp_extract_all(lower(regexp_replace({text}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[a-z][a-z0-9]*')"
    stop = ", ".join(f"'{s}'" for s in STOPWORDS)
    return f"list_transform(list_filter({cut}, lambda t: len(t) >= 2 AND NOT list_contains([{stop}], t)), lambda t: {_STEM_SQL})"


_BM25_SQL = f"""
    WITH c AS (SELECT doc_id, {_tokens_sql("text")} AS t FROM documents), s AS (SELECT count(*) AS n, greatest(avg(len(t)), 1) AS avgdl FROM c),
    i AS (SELECT doc_id, term, dl, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM c) GROUP BY 1, 2, 3),
    q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens_sql("text")}) AS term FROM benchmark) GROUP BY 1, 2),
    d AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM i, s GROUP BY term, n),
    r AS (SELECT item_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM i JOIN d USING (term) JOIN q USING (term), s WHERE idf > 0 GROUP BY 1, 2)
"""


@query("bm25_top10", _BM25_SQL + "SELECT item_id, doc_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM r) WHERE place <= 10")
def bm25_top10(spark, sf_dir):
    scored = search_documents(spark, sf_dir)
    return top_k(scored, "item_id", "score", "doc_id", 10).select("item_id", "doc_id", F.round("score", 6).alias("score"), "place")


@query("bm25_normalised_by_max", _BM25_SQL + "SELECT item_id, doc_id, round(score / max(score) OVER (PARTITION BY item_id), 6) AS share FROM r QUALIFY share >= 0.8")
def bm25_normalised_by_max(spark, sf_dir):
    """The passage variant: scores over the best one of the query."""
    scored = search_documents(spark, sf_dir)
    best = scored.groupBy("item_id").agg(F.max("score").alias("best"))  # one row for each query
    return scored.join(best, "item_id").select("item_id", "doc_id", F.round(F.col("score") / F.col("best"), 6).alias("share")).where("share >= 0.8")


@query(
    "tokenised_lengths",
    f"SELECT doc_id, CAST(len({_tokens_sql('text')}) AS BIGINT) AS n_terms FROM documents",
)
def tokenised_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_terms"))


_COS = "list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))"


@query(
    "exact_knn",
    f"""
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, vec_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS place FROM s WHERE score > 0) WHERE place <= 10
    """,
)
def exact_knn(spark, sf_dir):
    """Each vector whose id is a multiple of 100 against all others: queries in blocks, partial top-k in each batch."""
    return knn(table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0"), 10)


#: Vectors of a block and queries of a wave, about; a task has one of each.
VECTOR_BLOCK, QUERY_BLOCK = 65_536, 4096


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, *within: str, positive: bool = True) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: for each query the ``k`` best cosines of its own ``within`` and a few more, other ids only.

    ``vectors``: ``within``, ``vec_id`` (long), ``vector``; ``queries``: ``within``, ``query_id`` (long), ``vector``; lengths are equal within. Both sides are
    dealt to blocks and waves by hashes, every block meets every wave in one task, and only the best of each leave it.
    ``positive`` leaves out cosines of 0 and less. The vector of length zero has cosine 0 with all.
    """
    blocks, waves = (max(1, math.ceil(df.count() / size)) for df, size in ((vectors, VECTOR_BLOCK), (queries, QUERY_BLOCK)))
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # both sides may come from one frame
    left = vectors.where("vector IS NOT NULL").select(*fresh(*within, "vec_id", "vector"), part(blocks, "vec_id", "vector").alias("block"), numbers(waves, "wave"))
    right = queries.where("vector IS NOT NULL").select(*fresh(*within, "query_id", "vector"), part(waves, "query_id", "vector").alias("wave"), numbers(blocks, "block"))

    def units(t: pa.Table) -> np.ndarray:
        x = t.column("vector").combine_chunks()
        x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            own, ids, x, q = a.column("vec_id").to_numpy(), b.column("query_id").to_numpy(), units(a), units(b)
            for first in range(0, len(ids), 128):
                s = q[first : first + 128] @ x.T
                s[ids[first : first + 128, None] == own[None, :]] = -2.0
                m = min(k + 8, s.shape[1])
                top = np.argpartition(-s, m - 1, axis=1)[:, :m]
                score = np.take_along_axis(s, top, 1)
                at = np.nonzero(score > (0 if positive else -2.0))
                found.append((ids[first + at[0]], own[top[at]], score[at]))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    keys = (*within, "block", "wave")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scan, "query_id long, vec_id long, score double")


#: Pairs of a group whose cosines are worked out in one product of blocks, about.
PAIR_BLOCK = 1_000_000


def pair_cosines(pairs: DataFrame, vectors: DataFrame, queries: DataFrame, key: str, query_key: str) -> DataFrame:
    """``pairs`` (``query_key``, ``key``, ``score``, ids long) with ``near``, the clamped cosine of their vectors, and ``known``: both ids have a row.

    ``vectors``: ``key``, ``vector``; ``queries``: ``query_key``, ``vector``; ids are different. Rows of a block of keys and a wave of queries meet in
    one task, where each vector comes once and not with each pair. ``near`` is 0 where a vector is null, has a null component or another
    length than the other, or has length zero; where a cosine is no number it is 1, as numbers are ordered.
    """
    n, m = vectors.count(), queries.count()
    waves = max(1, math.ceil(m / QUERY_BLOCK))
    blocks = max(1, math.ceil(n * min(m, QUERY_BLOCK) / PAIR_BLOCK))
    part = lambda c, n, name: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(n)).cast("int").alias(name)
    each = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    fine = F.when(F.size(F.array_compact("vector")) == F.size("vector"), F.col("vector").cast("array<double>")).alias("vector")
    left = pairs.select(F.col(query_key).cast("long").alias("q"), F.col(key).cast("long").alias("k"), F.col("score").cast("double").alias("score"), part(key, blocks, "block"), part(query_key, waves, "wave"))
    own = vectors.select(F.lit(False).alias("asks"), F.col(key).cast("long").alias("id"), fine, part(key, blocks, "block")).select("*", each(waves, "wave"))
    asked = queries.select(F.lit(True).alias("asks"), F.col(query_key).cast("long").alias("id"), fine, part(query_key, waves, "wave")).select("*", each(blocks, "block"))

    def side(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
        """Ids in order, the lengths of their vectors (-1 for none), vectors of length one."""
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        v = t.column("vector").combine_chunks()
        sizes = v.value_lengths().fill_null(-1).to_numpy()
        return t.column("id").to_numpy(), sizes, v

    def units(v: pa.Array, at: np.ndarray) -> np.ndarray:
        x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        k, q = a.column("k").to_numpy(), a.column("q").to_numpy()
        near, known = np.zeros(len(k)), np.zeros(len(k), bool)
        asks = b.column("asks").to_numpy()
        if len(k) and asks.any() and not asks.all():
            (ids, size, v), (qids, qsize, qv) = side(b.filter(pa.array(~asks))), side(b.filter(pa.array(asks)))
            i, j = np.minimum(np.searchsorted(ids, k), len(ids) - 1), np.minimum(np.searchsorted(qids, q), len(qids) - 1)
            known = (ids[i] == k) & (qids[j] == q)
            for d in set(size.tolist()) & set(qsize.tolist()) - {-1, 0}:
                rows, columns = np.flatnonzero(size == d), np.flatnonzero(qsize == d)
                at, cat = np.full(len(ids), -1), np.full(len(qids), -1)
                at[rows], cat[columns] = np.arange(len(rows)), np.arange(len(columns))
                mine = np.flatnonzero(known & (size[i] == d) & (qsize[j] == d))
                mine = mine[np.argsort(at[i[mine]], kind="stable")]
                y = units(qv, columns).T
                for first in range(0, len(rows), 1024):
                    u = mine[slice(*np.searchsorted(at[i[mine]], [first, first + 1024]))]
                    near[u] = (units(v, rows[first : first + 1024]) @ y)[at[i[u]] - first, cat[j[u]]]
        near = np.where(np.isnan(near), 1.0, np.clip(near, 0.0, 1.0))
        return pa.table({"q": q, "k": k, "score": a.column("score"), "near": near, "known": known})

    met = left.groupBy("block", "wave").cogroup(own.unionByName(asked).groupBy("block", "wave")).applyInArrow(scan, "q long, k long, score double, near double, known boolean")
    return met.select(F.col("q").alias(query_key), F.col("k").alias(key), "score", "near", "known")


def blended(pairs: DataFrame, query_key: str) -> DataFrame:
    """``pairs`` with ``total``, 0.6 of ``near`` and 0.4 of ``score`` over the largest one of the query; written once, so that the largest is an aggregate and no sort."""
    pairs = written(pairs, "blend")
    best = pairs.groupBy(query_key).agg(F.max("score").alias("best"))  # a row for each query
    return pairs.join(F.broadcast(best), query_key).withColumn("total", 0.6 * F.col("near") + 0.4 * F.col("score") / F.col("best"))


def knn(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id``, ``vec_id``, ``score``, ``place``: the ``k`` best positive cosines, other ids only."""
    named = lambda df, name: df.select(F.col(id_column).cast("long").alias(name), F.col(vector_column).alias("vector"))
    found = cosine_top(named(vectors, "vec_id"), named(queries, "query_id"), k)
    return top_k(found, "query_id", "score", "vec_id", k).withColumn("score", F.round("score", 6))


@query(
    "cosine_to_centroid",
    """
    WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), u AS (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY 1)
    SELECT vec_id, round(list_cosine_similarity(v.e, c.e), 6) AS score FROM v JOIN c USING (label)
    """,
)
def cosine_to_centroid(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    c = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s.x).alias("mean"))
    return v.join(c, "label").select("vec_id", F.round(cosine(F.col("embedding"), F.col("mean")), 6).alias("score"))


def rrf(lists: list[tuple[DataFrame, float]], by: str, key: str, k: int = 60, first: int = 1) -> DataFrame:
    """Weighted reciprocal rank fusion of lists of (``by``, ``key``, ``place`` from 1); ``first`` 0 is the 0-based variant."""
    parts = [df.select(by, key, (F.lit(float(w)) / (F.lit(k) + F.col("place") - 1 + first)).alias("part")) for df, w in lists]
    united = parts[0]
    for p in parts[1:]:
        united = united.unionByName(p)
    return united.groupBy(by, key).agg(F.sum("part").alias("score"))


_LISTS_SQL = """
    WITH a AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents), b AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id * 7919) % 1009, doc_id) AS place FROM documents)
"""


@query(
    "weighted_rrf",
    _LISTS_SQL + "SELECT source, doc_id, round(sum(w / (60 + place)), 9) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM a WHERE place <= 20 UNION ALL SELECT *, 0.5::DOUBLE FROM b WHERE place <= 20) GROUP BY 1, 2",
)
def weighted_rrf(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ranked = lambda *o: d.select("source", "doc_id", F.row_number().over(Window.partitionBy("source").orderBy(*o)).alias("place")).where("place <= 20")
    lexical, semantic = ranked(F.desc("n_chars"), "doc_id"), ranked((F.col("doc_id") * 7919) % 1009, "doc_id")
    return rrf([(lexical, 1.0), (semantic, 0.5)], "source", "doc_id").withColumn("score", F.round("score", 9))


@query(
    "composite_rank",
    """
    WITH x AS (SELECT doc_id, n_chars % 40 / 4.0 AS bm25, doc_id % 50 AS age, quality, lang FROM documents JOIN labels USING (doc_id))
    SELECT doc_id, round((0.45 * bm25 / (bm25 + 3) + 0.25 * exp(-age * ln(2) / 30) + 0.20 * quality + 0.10 * 0.5) * CASE WHEN lang = 'en' THEN 1.15 ELSE 1 END * CASE WHEN doc_id % 11 = 0 THEN 0.2 ELSE 1 END, 6) AS score FROM x
    """,
)
def composite_rank(spark, sf_dir):
    """Soft-normalised BM25, recency, success and a base; a bonus for the domain, a penalty for dead ends."""
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    s, age = F.col("n_chars") % 40 / 4.0, F.col("doc_id") % 50
    score = (0.45 * s / (s + 3) + 0.25 * F.exp(-age * math.log(2) / 30) + 0.20 * F.col("quality") + 0.10 * 0.5) * F.when(F.col("lang") == "en", 1.15).otherwise(1.0) * F.when(F.col("doc_id") % 11 == 0, 0.2).otherwise(1.0)
    return x.select("doc_id", F.round(score, 6).alias("score"))


@query("idf_weight_clamp", "SELECT p_partkey, round(least(8, greatest(0.3, 4 * p_retailprice / 1000)), 6) AS weight FROM part")
def idf_weight_clamp(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.least(F.lit(8.0), F.greatest(F.lit(0.3), 4 * F.col("p_retailprice") / 1000)), 6).alias("weight"))


@query(
    "token_window_chunks",
    """
    WITH t AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM documents), c AS (SELECT doc_id, w, CASE WHEN len(w) <= 800 THEN 1 ELSE CAST(ceil((len(w) - 400) / 320.0) AS BIGINT) + 1 END AS n FROM t WHERE len(w) > 0)
    SELECT doc_id, CAST(i AS BIGINT) AS chunk, CASE WHEN n = 1 THEN len(w) ELSE least(400, len(w) - i * 320) END AS n_words, md5(array_to_string(CASE WHEN n = 1 THEN w ELSE w[i * 320 + 1 : i * 320 + 400] END, ' ')) AS digest FROM c, generate_series(0, n - 1) s(i)
    """,
)
def token_window_chunks(spark, sf_dir):
    """Texts of up to 800 words whole, longer ones in windows of 400 that overlap by 80."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    n = F.when(F.size("w") <= 800, F.lit(1)).otherwise(F.ceil((F.size("w") - 400) / 320.0).cast("int") + 1)
    c = t.withColumn("n", n).select("doc_id", "w", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    chunk = F.when(F.col("n") == 1, F.col("w")).otherwise(F.slice("w", F.col("i") * 320 + 1, F.lit(400)))
    return c.select("doc_id", F.col("i").cast("long").alias("chunk"), F.size(chunk).cast("long").alias("n_words"), F.md5(F.array_join(chunk, " ")).alias("digest"))


@query(
    "retrieval_metrics",
    _BM25_SQL + """
    , p AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS place FROM r), g AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    m AS (SELECT g.item_id, count(*) AS gold, count(*) FILTER (place <= 5) AS hits, min(place) AS first, sum(CASE WHEN place <= 5 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg FROM g LEFT JOIN p ON p.item_id = g.item_id AND p.doc_id = g.doc_id GROUP BY 1),
    z AS (SELECT *, (SELECT sum(1 / log2(x + 1)) FROM generate_series(1, least(gold, 5)) s(x)) AS idcg FROM m)
    SELECT count(*) AS queries, round(avg(hits / gold), 6) AS recall_at_5, round(avg(hits / 5), 6) AS precision_at_5, round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(dcg / idcg), 6) AS ndcg_at_5 FROM z
    """,
)
def retrieval_metrics(spark, sf_dir):
    """Recall, precision, MRR and nDCG of BM25, the gold being the documents that contain the query text."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    scored = written(search_documents(spark, sf_dir).withColumn("score", F.round("score", 9)), "scored")
    # a document that holds the passage has its words, but for those cut at both ends: texts of few pairs are looked at
    able = scored.where(F.col("met") >= F.col("asked") - 2).select("item_id", "doc_id", "score")
    gold = able.join(b.withColumnRenamed("text", "passage"), "item_id").join(d.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id", "score")
    gold = written(gold, "gold")
    # only the first five places and that of the best gold are asked for: the rows before it are counted, no list is sorted as a whole
    order = lambda score: F.struct(-F.col(score), F.col("doc_id"))
    best = gold.groupBy("item_id").agg(F.min(order("score")).alias("best"))
    first = scored.join(F.broadcast(best), "item_id").groupBy("item_id").agg((F.count_if(order("score") < F.col("best")) + 1).alias("first"))  # a row for each query
    five = top_k(scored, "item_id", "score", "doc_id", 5).select("item_id", "doc_id", "place")
    own = gold.join(five, ["item_id", "doc_id"], "left")
    m = own.groupBy("item_id").agg(F.count("*").alias("gold"), F.count("place").alias("hits"), F.sum(F.when(F.col("place") <= 5, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg")).join(first, "item_id")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("gold"), F.lit(5)).cast("int")), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1))
    return m.withColumn("idcg", ideal).agg(
        F.count("*").alias("queries"), F.round(F.avg(F.col("hits") / F.col("gold")), 6).alias("recall_at_5"), F.round(F.avg(F.col("hits") / 5), 6).alias("precision_at_5"), F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.avg(F.col("dcg") / F.col("idcg")), 6).alias("ndcg_at_5"))


@query(
    "line_window_search",
    r"""
    WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS no, lower(unnest(string_split(text, chr(10)))) AS line FROM documents),
    s AS (SELECT doc_id, no, 2 * (contains(line, 'apache')::INT + contains(line, 'license')::INT) + regexp_matches(line, '\bapache\b')::INT + regexp_matches(line, '\blicense\b')::INT AS score FROM l)
    SELECT doc_id, CAST(no AS BIGINT) AS line_no, greatest(no - 2, 1) AS first_line, CAST(score AS BIGINT) AS score FROM s WHERE score > 0
    """,
)
def line_window_search(spark, sf_dir):
    """Two points for each term in a line, one more for a whole word; the window starts two lines before."""
    l = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).withColumn("line", F.lower("raw"))
    score = sum((2 * F.contains("line", F.lit(t)).cast("int") + F.rlike("line", F.lit(rf"\b{t}\b")).cast("int") for t in ("apache", "license")), F.lit(0))
    return l.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), F.greatest(F.col("at") - 1, F.lit(1)).cast("long").alias("first_line"), score.cast("long").alias("score")).where("score > 0")


# ---------------------------------------------------------------- sequential ranking of a bounded page
def mmr(scores: list[float], sets: list[set], k: int, trade: float = 0.7) -> list[int]:
    """Maximal marginal relevance over a page of candidates, best first; the earliest wins a tie."""
    left, out = list(range(len(scores))), []
    while left and len(out) < k:
        def gain(i):
            near = max((len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1.0 for j in out), default=0.0)
            return trade * scores[i] - (1 - trade) * near
        best = max(left, key=lambda i: (gain(i), -i)) if out else left[0]
        out.append(best)
        left.remove(best)
    return out


@query("mmr_diversified")
def mmr_diversified(spark, sf_dir):
    """Five of the 30 best documents for each query, by relevance less overlap with those already chosen."""
    b, d = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    # written, the page is known to be short: it goes to the texts, and only texts on it are cut
    page = written(top_k(search_documents(spark, sf_dir), "item_id", "score", "doc_id", 30).select("item_id", "doc_id", "score", "place"), "page")
    texts = d.select("doc_id", "text").join(page.select("doc_id").distinct(), "doc_id", "left_semi")
    page = page.join(texts.select("doc_id", F.array_distinct(tokens(F.col("text"))).alias("terms")), "doc_id")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        top = pdf.score.max() or 1.0
        picks = mmr((pdf.score / top).tolist(), [set(t) for t in pdf.terms], 5)
        return pd.DataFrame({"item_id": pdf.item_id.iloc[picks].to_numpy(), "doc_id": pdf.doc_id.iloc[picks].to_numpy(), "pick": np.arange(1, len(picks) + 1)})

    # 30 rows for each query at most
    return page.groupBy("item_id").applyInPandas(choose, "item_id long, doc_id long, pick long")


def feature_hash(text: str, dim: int = 64) -> list[float]:
    """Signed hashed counts of words and, at a quarter of the weight, of character 3-grams; length 1."""
    import re

    out = np.zeros(dim)
    found = re.findall(r"[a-zA-Z0-9_]+", (text or "").lower())
    joined = "_".join(found)
    for items, weight, byte in ((found, 1.0, 4), ((joined[i : i + 3] for i in range(len(joined) - 2)), 0.25, 5)):
        for item in items:
            digest = hashlib.sha256(item.encode()).digest()
            out[int.from_bytes(digest[:4], "big") % dim] += weight if digest[byte] & 1 else -weight
    length = np.linalg.norm(out)
    return (out / length if length else out).tolist()


def _embed(texts: pd.Series) -> pd.Series:
    return texts.map(feature_hash)


@query("feature_hash_embeddings")
def feature_hash_embeddings(spark, sf_dir):
    embed = F.pandas_udf(_embed, "array<double>")
    return table(spark, sf_dir, "benchmark").select("item_id", embed("text").alias("vector"))
