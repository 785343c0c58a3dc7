"""Registered queries of sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from .connectors import active_branch, cap_records, insert_or_existing, latest_per_key, upsert, version_conflicts
from .tables import table


@query("latest_row_per_key", "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_row_per_key(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))
    return latest_per_key(e, ["user_id", "event_type"], ["event_id"])


@query(
    "interleaved_union",
    "SELECT conv_id, turn, 0 AS part, role FROM conversations UNION ALL SELECT c.conv_id, c.turn, 1, 'part' FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 WHERE p.role = 'user'",
)
def interleaved_union(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    p = c.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"))
    parts = c.select("conv_id", "turn").join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.lit(1).alias("part"), F.lit("part").alias("role"))
    return c.select("conv_id", "turn", F.lit(0).alias("part"), "role").unionByName(parts)


@query("capped_records", "SELECT doc_id, left(text, 100) AS text, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS text_length FROM documents")
def capped_records(spark, sf_dir):
    return cap_records(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 100).withColumn("text_length", F.col("text_length").cast("long"))


@query(
    "upserted_rows",
    "SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal, v FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY v DESC, side DESC) AS r FROM (SELECT c_custkey, c_acctbal, 1 AS v, 0 AS side FROM customer UNION ALL SELECT c_custkey, c_acctbal + 1, 1 + c_custkey % 2, 1 FROM customer WHERE c_acctbal > 5000)) WHERE r = 1",
)
def upserted_rows(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(1).cast("long").alias("v"))
    changes = c.where("c_acctbal > 5000").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), (1 + F.col("c_custkey") % 2).alias("v"))
    return upsert(c, changes, ["c_custkey"], "v").select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"), "v")


@query("insert_or_existing", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS dedup_hit FROM documents")
def insert_or_existing_query(spark, sf_dir):
    return insert_or_existing(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("version_conflicts", "SELECT p_partkey, expected_version FROM (SELECT p_partkey, p_size % 3 AS expected_version, p_size % 2 AS version FROM part) WHERE expected_version <> version")
def version_conflicts_query(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return version_conflicts(p.select("p_partkey", (F.col("p_size") % 2).alias("version")), p.select("p_partkey", (F.col("p_size") % 3).alias("expected_version")), "p_partkey")


@query(
    "active_branch",
    """
    WITH RECURSIVE t AS (SELECT conv_id AS session, turn AS pos, turn AS id, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN turn - 2 ELSE turn - 1 END AS parent FROM conversations),
    w AS (SELECT session, max_by(id, pos) AS id FROM t GROUP BY 1 UNION SELECT w.session, t.parent FROM w JOIN t ON t.session = w.session AND t.id = w.id WHERE t.parent IS NOT NULL)
    SELECT DISTINCT t.session, t.pos, t.id, t.parent FROM t JOIN w ON t.session = w.session AND t.id = w.id
    """,
)
def active_branch_query(spark, sf_dir):
    parent = F.when(F.col("turn") == 0, None).when(F.col("turn") % 3 == 0, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.col("turn").alias("id"), parent.alias("parent")).distinct()
    return active_branch(t)


@query("pages_by_domain", r"SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS domain, count(*) AS n, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages GROUP BY 1")
def pages_by_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("domain")).agg(F.count("*").alias("n"), F.sum(F.length("html")).alias("chars"))
