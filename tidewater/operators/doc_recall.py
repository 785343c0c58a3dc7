"""Documents cut along their headings, and recalled by vectors or, where there are none, by words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..shared import dealt, written
from ..sources.tables import table
from .retrieval import cosine_top

HEADING = r"^(#{1,6})\s+(.*\S)\s*$"
#: A section beyond this is cut at blank lines.
MOST_CHARS = 1200
INTRO = "(intro)"


def _pieces(body: Column) -> Column:
    """Paragraphs of a section together up to ``MOST_CHARS``; one longer paragraph stands alone."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("held"), F.lit(0).alias("size"))

    def add(s, p):
        more = F.length(p) + 2
        full = (s["size"] + more > MOST_CHARS) & (F.size(s["held"]) > 0)
        done = F.when(full, F.concat(s["done"], F.array(F.array_join(s["held"], "\n\n")))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, F.array(p)).otherwise(F.concat(s["held"], F.array(p))).alias("held"), F.when(full, more).otherwise(s["size"] + more).alias("size"))

    cut = F.aggregate(F.split(body, "\n\n"), state, add, lambda s: F.concat(s["done"], F.array(F.array_join(s["held"], "\n\n"))))
    stripped = F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(F.length(body) <= MOST_CHARS, F.filter(F.array(body), lambda x: x != "")).otherwise(stripped)


def heading_chunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``line`` (of the section's heading, from 1), ``piece`` (from 0), ``path`` (``A > B``), ``text``.

    A line's headings are, of each level, the last one since a higher heading. What stands before any heading is under
    ``(intro)``; sections without text have no row.
    """
    lines = texts.select(F.col(key).alias("_key"), F.posexplode(F.split(text, "\r?\n")).alias("n", "line")).withColumn("n", F.col("n") + 1)
    lines = lines.withColumns({"level": F.length(F.regexp_extract("line", HEADING, 1)), "title": F.regexp_extract("line", HEADING, 2)})
    w = Window.partitionBy("_key").orderBy("n")
    lines = lines.withColumns({f"at{i}": F.max(F.when(F.col("level") == i, F.struct("n", "title"))).over(w) for i in range(1, 7)})
    parts, above = [], F.lit(0)
    for i in range(1, 7):
        here = F.coalesce(F.col(f"at{i}.n"), F.lit(0))
        parts.append(F.when(here > above, F.col(f"at{i}.title")))
        above = F.greatest(above, here)
    path = F.concat_ws(" > ", *parts)
    placed = lines.select("_key", "n", "line", "level", F.greatest(above, F.lit(1)).alias("start"), (above > 0).alias("headed"), path.alias("path"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("n", "line")))), lambda x: x.line), "\n")  # a section is a part of one text
    sections = placed.groupBy("_key", "start", "headed").agg(F.max("path").alias("path"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("body"))
    cut = sections.select("_key", F.col("start").alias("line"), F.when(F.col("headed"), F.col("path")).otherwise(INTRO).alias("path"), F.posexplode(_pieces(F.col("body"))).alias("piece", "text"))
    return cut.select(F.col("_key").alias(key), "line", "piece", "path", "text")


#: Characters of the chunks of a block, and words and queries of a wave, about; a task has one of each.
CHUNK_BLOCK, WAVE_WORDS, WAVE_QUERIES = 1 << 24, 1 << 14, 1024
#: Cells of a matrix of chunks by words.
MOST_CELLS = 1 << 22
#: ASCII letters, digits and underscores, letters lowered; all other bytes part words.
_WORD_BYTES = bytes(b if chr(b).isalnum() or b == 95 else 32 for b in bytes(range(128)).lower()) + b" " * 128


def lexical_top(chunks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``chunk``, ``score``: for each query the ``k`` chunks with the largest share of its words and a few more, shares above zero only.

    ``chunks``: ``chunk`` (long), ``text``; ``asked``: ``query_id``, ``w`` (its distinct words, lowered). Nearly every chunk has a word of nearly every query,
    so pairs are no rows: both sides are dealt to blocks and waves by hashes, as in ``cosine_top``, counts of words in common
    are products of matrices, and only the best of each block leave it. Equal shares go by ``chunk``.
    """
    asked = asked.where(F.size("w") > 0)
    n, m = asked.agg(F.sum(F.size("w")), F.count("*")).first()
    size = chunks.agg(F.sum(F.length("text"))).first()[0]
    blocks, waves = max(1, math.ceil((size or 0) / CHUNK_BLOCK)), max(1, math.ceil((n or 0) / WAVE_WORDS), math.ceil(m / WAVE_QUERIES))
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    part = lambda n, c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = chunks.where("text IS NOT NULL").select(F.col("chunk").cast("long").alias("chunk"), F.col("text").cast("binary").alias("text"), part(blocks, "chunk").alias("block"), numbers(waves, "wave"))
    right = asked.select("query_id", "w", part(waves, "query_id").alias("wave"), numbers(blocks, "block"))

    def scan(a: pa.Table, b: pa.Table) -> pa.Table:
        own, size = a.column("chunk").to_numpy(), a.num_rows
        asks, found = [[w.encode() for w in ws] for ws in b.column("w").to_pylist()], []
        order = np.empty(size, np.int64)  # smaller chunks have larger numbers
        order[np.argsort(-own, kind="stable")] = np.arange(size)
        numbered = np.argsort(order)
        together = max(1, 4 * MOST_CELLS // max(1, len({w for ws in asks for w in ws})))  # all of the wave, if its words are not very many
        for first in range(0, len(asks) if size else 0, together):
            some = asks[first : first + together]
            place = {w: i for i, w in enumerate({w for ws in some for w in ws})}
            known, step = frozenset(place), max(1, MOST_CELLS // max(len(place), len(some)))
            has, best = np.zeros((len(some), len(place)), np.float32), np.zeros((len(some), k), np.int64)
            for i, ws in enumerate(some):
                has[i, [place[w] for w in ws]] = 1
            for start in range(0, size, step):
                held = [known.intersection(t.translate(_WORD_BYTES).split()) for t in a.column("text").slice(start, step).to_pylist()]
                rows = np.repeat(np.arange(len(held)), [len(x) for x in held])
                holds = np.zeros((len(held), len(place)), np.float32)
                holds[rows, np.fromiter((place[w] for x in held for w in x), np.int64, len(rows))] = 1
                ranked = (has @ holds.T).astype(np.int64) * size + order[start : start + step]  # by count, then by chunk
                best = np.partition(np.concatenate([best, ranked], 1), -k, 1)[:, -k:]
            who, at = np.nonzero(best >= size)
            count, number = np.divmod(best[who, at], size)
            found.append((first + who, own[numbered[number]], count / np.array([len(ws) for ws in some])[who]))
        who, chunk, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"query_id": b.column("query_id").take(pa.array(who)), "chunk": chunk, "score": score})

    # a task has a few blocks, however large the table
    left, right = (dealt(df, blocks * waves, "block", "wave", task_rows=1) for df in (left, right))
    met = left.groupBy("block", "wave").cogroup(right.groupBy("block", "wave"))
    return met.applyInArrow(scan, f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk long, score double")


def chunk_recall(chunks: DataFrame, queries: DataFrame, query_key: str, query_text: str, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, k: int = 5) -> DataFrame:
    """``query_key``, ``chunk``, ``score``, ``mode`` and ``place`` of the best ``k`` chunks for each query.

    ``chunks``: ``chunk`` (long, also their order), ``path``, ``text``; they are read more than once. Where a query has a vector and some chunk has one of the same
    ``embedder`` and ``dim``, cosines decide; else the share of the query's words that a chunk or its path has, above zero.
    ``vectors``: ``chunk``, ``embedder``, ``dim``, ``vector``; ``query_vectors``: ``query_key`` instead.
    """
    words = lambda t: F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit("([a-zA-Z0-9_]+)")), F.lower))
    asked = queries.select(F.col(query_key).alias("query_id"), words(F.col(query_text)).alias("w"))
    found = None
    if vectors is not None and query_vectors is not None:
        stamp = ("embedder", "dim")
        usable = vectors.where((F.col("dim") > 0) & (F.size("vector") == F.col("dim")))
        q = query_vectors.where((F.col("dim") > 0) & (F.size("vector") == F.col("dim"))).select(*stamp, F.col(query_key).cast("long").alias("query_id"), "vector")
        # ids of chunks and queries are of different kinds: a query's own id is no chunk's
        scored = cosine_top(usable.select(*stamp, (-F.col("chunk") - 1).alias("vec_id"), "vector"), q, k, *stamp, positive=False)
        found = scored.select("query_id", (-F.col("vec_id") - 1).alias("chunk"), "score", F.lit("vector").alias("mode"))
        asked = asked.join(q.join(usable.select(*stamp).distinct(), [*stamp], "left_semi").select("query_id").distinct(), "query_id", "left_anti")
    lexical = lexical_top(chunks.select("chunk", F.concat_ws(" ", "path", "text").alias("text")), asked, k).withColumn("mode", F.lit("lexical"))
    found = lexical if found is None else found.unionByName(lexical)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk"))
    return found.withColumn("place", place.cast("long")).where(F.col("place") <= k).select(F.col("query_id").alias(query_key), "chunk", "score", "mode", "place")


# ---------------------------------------------------------------- queries
_HEADED = "CASE WHEN p % 4 = 2 AND trim(raw) <> '' THEN CASE p % 3 WHEN 0 THEN '# ' WHEN 1 THEN '## ' ELSE '#### ' END || raw ELSE raw END"
_CHUNKS_SQL = rf"""
    h AS (SELECT doc_id, p, {_HEADED} AS line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS raw FROM documents)),
    v AS (SELECT *, len(regexp_extract(line, '^(#{{1,6}})\s+(.*\S)\s*$', 1)) AS lv, regexp_extract(line, '^(#{{1,6}})\s+(.*\S)\s*$', 2) AS title FROM h),
    w AS (SELECT *, {", ".join(f"coalesce(max(CASE WHEN lv = {i} THEN p END) OVER x, 0) AS p{i}, last_value(CASE WHEN lv = {i} THEN title END IGNORE NULLS) OVER x AS t{i}" for i in range(1, 7))} FROM v WINDOW x AS (PARTITION BY doc_id ORDER BY p)),
    s AS (SELECT doc_id, greatest(1, p1, p2, p3, p4, p5, p6) AS start, greatest(p1, p2, p3, p4, p5, p6) > 0 AS headed, concat_ws(' > ', {", ".join(f"CASE WHEN p{i} > {'greatest(' + ', '.join(f'p{j}' for j in range(1, i)) + ')' if i > 1 else '0'} THEN t{i} END" for i in range(1, 7))}) AS path, p, line, lv FROM w),
    c AS (SELECT doc_id, start AS line, CASE WHEN headed THEN max(path) ELSE '{INTRO}' END AS path, regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (lv = 0), ''), '^\s+|\s+$', '', 'g') AS text FROM s GROUP BY doc_id, start, headed)
"""


def _headed_documents(spark, sf_dir) -> DataFrame:
    """Documents with every fourth line as a heading of the first, second or fourth level."""
    lines = F.transform(F.split("text", "\n"), lambda raw, i: F.when(((i + 1) % 4 == 2) & (F.trim(raw) != ""), F.concat(F.when((i + 1) % 3 == 0, "# ").when((i + 1) % 3 == 1, "## ").otherwise("#### "), raw)).otherwise(raw))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


@query("heading_paths", f"WITH {_CHUNKS_SQL} SELECT doc_id, line, md5(path) AS path, CAST(len(text) AS BIGINT) AS chars FROM c WHERE text <> ''")
def heading_paths(spark, sf_dir):
    """The path and length of each section, pieces of one section put together again."""
    cut = heading_chunks(_headed_documents(spark, sf_dir), "doc_id", "text")
    whole = cut.groupBy("doc_id", "line", "path").agg(F.sum(F.length("text")).alias("sum"), F.count("*").alias("n"))
    return whole.select("doc_id", F.col("line").cast("long").alias("line"), F.md5("path").alias("path"), (F.col("sum") + 2 * (F.col("n") - 1)).alias("chars"))


@query(
    "heading_recall",
    f"""WITH {_CHUNKS_SQL}, k AS (SELECT doc_id * 1000000 + line * 1000 AS chunk, path, text, doc_id FROM c WHERE text <> ''),
    e AS (SELECT chunk, label, embedding FROM (SELECT chunk, doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk) AS r FROM k) JOIN embeddings ON vec_id = doc_id WHERE r = 1 AND label % 3 > 0),
    q AS (SELECT item_id, text, label, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id AND item_id % 2 = 0),
    a AS (SELECT item_id, chunk, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score, 'vector' AS mode FROM q JOIN e USING (label)),
    t AS (SELECT item_id, len(w) AS n, unnest(w) AS word FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM q WHERE item_id NOT IN (SELECT item_id FROM a))),
    u AS (SELECT chunk, unnest(list_distinct(regexp_extract_all(lower(path || ' ' || text), '[a-z0-9_]+'))) AS word FROM k),
    l AS (SELECT item_id, chunk, count(*) / n AS score, 'lexical' AS mode FROM t JOIN u USING (word) GROUP BY item_id, chunk, n)
    SELECT item_id, chunk, round(score, 6) AS score, mode, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, chunk) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM l) QUALIFY place <= 5""",
)
def heading_recall(spark, sf_dir):
    """Sections of documents for each item; even items have a vector, first sections have one of two in three labels, which stand for embedders."""
    cut = heading_chunks(_headed_documents(spark, sf_dir), "doc_id", "text")
    sections = cut.groupBy("doc_id", "line", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda x: x.text), "\n\n").alias("text"))
    # cut once: their number, the first ones and all words are asked for one after the other
    chunks = written(sections.select((F.col("doc_id") * 1_000_000 + F.col("line") * 1000).alias("chunk"), "doc_id", "path", "text"), "chunks")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("embedder"), F.size("embedding").alias("dim"), F.col("embedding").alias("vector"))
    firsts = chunks.groupBy("doc_id").agg(F.min("chunk").alias("chunk"))
    vectors = firsts.join(e, F.col("doc_id") == F.col("vec_id")).where("CAST(embedder AS INT) % 3 > 0").select("chunk", "embedder", "dim", "vector")
    items = table(spark, sf_dir, "benchmark")
    asked = items.where("item_id % 2 = 0").join(e, F.col("item_id") == F.col("vec_id")).select("item_id", "embedder", "dim", "vector")
    found = chunk_recall(chunks, items, "item_id", "text", vectors, asked)
    return found.withColumn("score", F.round("score", 6))
