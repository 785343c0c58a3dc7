"""The queries of this folder: thin digests of the operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import centroids, exact, langid, mixing, packing, periods, ppm, secrets, shards, simhash, topk, toxicity, vectors
from .common import WORD_REGEX, documents, fold_remainder, scratch_path

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_secrets(spark, sf_dir):
    return secret_digest(secrets.find_secrets(documents(spark, sf_dir)))


def secret_digest(found):
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.kind != "format")
    return found.select(
        F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"), count("format"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark, sf_dir):
    out = packing.pack(documents(spark, sf_dir), tokenizer_path())
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", F.col("sequence").alias("sequence_id"), "offset")


def op3_simhash(spark, sf_dir):
    out = simhash.near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


#: Batches in which the table arrives at the store, by a hash of the id.
ARRIVALS = 6


def arrivals(docs):
    return [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == i) for i in range(ARRIVALS)]


def op4_sharding(spark, sf_dir):
    """What the last manifest's shards hold after all batches have been appended and compacted, one after the other."""
    store = shards.shard(arrivals(documents(spark, sf_dir)), scratch_path(spark, "store"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text"), 256).alias("text_sha256"))


OP4_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def shard_manifest(spark, sf_dir):
    """The runs of the last manifest, with a small target so that small inputs show several tiers."""
    store = shards.ShardStore(spark, scratch_path(spark, "store"), target=8 << 20)
    store.append(documents(spark, sf_dir).repartition(24, "doc_id"))
    runs = store.compact()["runs"]
    return spark.createDataFrame([(r["id"], r["tier"], r["rows"], r["bytes"], len(r["files"])) for r in runs], "run string, tier int, n_rows long, n_bytes long, n_files int")


def op5_vector_dedup(spark, sf_dir):
    out = vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"), F.col("recall").alias("audit_recall"))


def score_documents(docs):
    held_out = fold_remainder("doc_id", 7) == 2
    out = ppm.score(docs, docs.where(~held_out))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op6_lm_scoring(spark, sf_dir):
    return score_documents(documents(spark, sf_dir))


def op7_toxicity(spark, sf_dir):
    docs, held_out = documents(spark, sf_dir), fold_remainder("doc_id", 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    out = toxicity.predict(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op8_mixing(spark, sf_dir):
    out = mixing.mix(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per_source AS (
  SELECT key, source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY key, source
), weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 3 AS most FROM per_source
), level AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(most) OVER w, 0) AS DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (
  SELECT *, most / weight <= level AS is_full, (SELECT arg_min(level, most / weight) FROM level WHERE most / weight > level) AS held FROM level
), targets AS (
  SELECT key, source_size, CASE WHEN is_full THEN CAST(most AS DOUBLE) ELSE weight * held END AS target,
    (CAST(('0x' || substr(md5('mix-' || key), 1, 5)) AS BIGINT) + 0.5::DOUBLE) / 1048576 AS off FROM held
), ranked AS (
  SELECT doc_id, size, source_size, target, off, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS copies,
    row_number() OVER (PARTITION BY key ORDER BY size, doc_id NULLS FIRST) AS r
  FROM sizes JOIN targets USING (key)
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(r * copies + off) - floor((r - 1) * copies + off)) AS BIGINT) AS taken FROM ranked
"""


def op9_langid(spark, sf_dir):
    docs = documents(spark, sf_dir)
    languages, matrix = langid.train(docs.where(fold_remainder("doc_id", 5) != 0))
    out = langid.predict(docs, languages, matrix)
    return out.select("doc_id", (fold_remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark, sf_dir):
    out = exact.exact_dedup(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP10_SQL = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256({_LOWER}) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY {_LOWER})
"""


def op11_centroids(spark, sf_dir):
    out = centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))


def op11_sql() -> str:
    """The rounds one after the other, on a row for each vector and place."""
    centres, parts = "s0", []
    for i in range(centroids.ROUNDS + 1):
        parts.append(f"""d{i} AS (SELECT v.r, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM v JOIN {centres} c USING (place) GROUP BY ALL),
        a{i} AS MATERIALIZED (SELECT r, min(distance) AS distance, arg_min(cluster, (distance, cluster)) AS cluster FROM d{i} GROUP BY r)""")
        if i < centroids.ROUNDS:
            parts.append(f"""m{i} AS (SELECT cluster, place, sum(x) AS total, count(*) AS n FROM a{i} JOIN v USING (r) GROUP BY ALL),
            s{i + 1} AS MATERIALIZED (SELECT c.cluster, c.place, CASE WHEN n IS NULL THEN c.x ELSE CAST((total - (total % n + n) % n) // n AS BIGINT) END AS x FROM {centres} c LEFT JOIN m{i} USING (cluster, place))""")
            centres = f"s{i + 1}"
    return f"""WITH kept AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), e) - 1 AS r, vec_id, e FROM (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)
    ), v AS MATERIALIZED (SELECT r, unnest(range(64)) AS place, unnest(e) AS x FROM kept),
    s0 AS MATERIALIZED (SELECT r AS cluster, place, x FROM v WHERE r < 40),
    {", ".join(parts)},
    told AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM {centres} GROUP BY cluster)
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM kept JOIN a{centroids.ROUNDS} USING (r) JOIN told USING (cluster)"""


def with_periods(docs):
    """Documents whose crc32 of the id ends in 0 become periodic from some word on; the others are left as they are."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    g = F.floor(h / 10)
    words = F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD_REGEX})"), F.lit(1)))
    cut = docs.select("doc_id", "text", g.alias("g"), words.alias("w")).withColumn("n", F.size("w"))
    cut = cut.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    cut = cut.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    unit = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark, sf_dir):
    return run_digest(periods.periodic_runs(with_periods(documents(spark, sf_dir))))


def run_digest(found):
    longest = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r.length).alias("shorter"), r.start.alias("start"), r.period.alias("period")))), F.lit(0))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    found = found.select("*", longest.alias("l"))
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), "l.start", (-F.col("l.shorter")).alias("length"), "l.period",
        F.floor(F.expr("(-1000 * l.shorter) div l.period")).alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


def op13_topk(spark, sf_dir):
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY rank <= 5
"""

QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_packing": op2_packing,
    "op3_simhash": op3_simhash,
    "op4_sharding": op4_sharding,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_langid": op9_langid,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_centroids": op11_centroids,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_topk": op13_topk,
    "shard_manifest": shard_manifest,
}
SQL = {
    "op4_sharding": OP4_SQL,
    "op8_mixing": OP8_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op11_centroids": op11_sql(),
    "op13_topk": OP13_SQL,
}
