"""Sessions of agent hosts, files of a workspace under ignore rules, and commits, as tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.protocols import SOURCES
from ..registry import query
from .tables import table

_TRANSCRIPT = """type string, timestamp string, sessionId string, uuid string, isMeta boolean, isSidechain boolean, cwd string,
message struct<id: string, role: string, model: string, content: string, usage: struct<input_tokens: long, output_tokens: long, cache_read_input_tokens: long, cache_creation_input_tokens: long>>"""
_BLOCKS = "array<struct<type: string, text: string, id: string, name: string, tool_use_id: string, is_error: boolean>>"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """A row for each message of JSON-lines transcripts under ``path``, those of subagents too.

    A message that is written in several lines is one row: its last usage, the texts and tools of all its lines. Broken
    lines, lines without a session and lines the host marks as its own are left out. Contents may be text or blocks.
    """
    lines = spark.read.schema(_TRANSCRIPT).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)
    rows = lines.where("sessionId IS NOT NULL AND message IS NOT NULL AND NOT coalesce(isMeta, false)")
    content = F.col("message.content")
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, _BLOCKS))
    named = lambda kind, field: F.transform(F.filter(F.col("b"), lambda x: x.type == kind), lambda x: x[field])
    cut = rows.select(F.col("sessionId").alias("session"), F.coalesce("message.id", "uuid").alias("message"), F.to_timestamp("timestamp").alias("at"), F.coalesce("message.role", "type").alias("role"), F.col("message.model").alias("model"), F.coalesce("isSidechain", F.lit(False)).alias("subagent"), F.col("message.usage").alias("usage"), content.alias("content"), blocks.alias("b"))
    text = F.when(F.col("b").isNull(), F.col("content")).otherwise(F.concat_ws("\n", named("text", "text")))
    parts = cut.select("session", "message", "at", "role", "model", "subagent", "usage", text.alias("text"), F.coalesce(named("tool_use", "name"), F.array().cast("array<string>")).alias("tools"), F.coalesce(F.size(F.filter("b", lambda x: x.is_error)), F.lit(0)).alias("errors"))
    lines_of = F.array_sort(F.collect_list(F.struct("at", "text", "tools")))  # the lines of one message
    one = parts.groupBy("session", "message").agg(F.min("at").alias("at"), F.max_by("role", "at").alias("role"), F.max_by("model", "at").alias("model"), F.max("subagent").alias("subagent"), F.max_by("usage", "at").alias("usage"), lines_of.alias("l"), F.sum("errors").alias("errors"))
    return one.select("session", "message", "at", "role", "model", "subagent", "usage.*", F.concat_ws("\n", F.filter(F.transform("l", lambda x: x.text), lambda t: t != "")).alias("text"), F.flatten(F.transform("l", lambda x: x.tools)).alias("tools"), "errors")


SOURCES.put("transcripts", lambda: read_transcripts)


# ---------------------------------------------------------------- files
def ignore_regex(rule: str) -> str | None:
    """A rule of an ignore file as a pattern of relative paths; None for comments and blank lines, ``!`` aside."""
    rule = rule.rstrip().removeprefix("!")
    if not rule or rule.startswith("#"):
        return None
    folder, body = rule.endswith("/"), rule.strip("/")
    anchored = rule.startswith("/") or "/" in body
    out = ""
    for piece in re.findall(r"\*\*/|/\*\*$|\*|\?|\[[^\]]+\]|.", body):
        fixed = {"**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}.get(piece)
        out += fixed if fixed is not None else piece.replace("[!", "[^") if len(piece) > 1 else re.escape(piece)
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if folder else '(?:/.*)?'}$"


def not_ignored(files: DataFrame, path: str, rules: list[str]) -> DataFrame:
    """Files that the rules leave visible; the last rule that matches decides, ``!`` brings back."""
    ignored = F.lit(False)
    for rule in rules:
        if (pattern := ignore_regex(rule)) is not None:
            ignored = F.when(F.col(path).rlike(pattern), not rule.startswith("!")).otherwise(ignored)
    return files.where(~ignored)


@query(
    "visible_files",
    "SELECT p_partkey, path FROM (SELECT p_partkey, p_brand || '/' || p_type || CASE WHEN p_size > 25 THEN '.log' ELSE '.py' END AS path, p_size FROM part) WHERE NOT (path LIKE 'Brand#1_/%') AND (path NOT LIKE '%.log' OR path LIKE '%/PROMO%.log')",
)
def visible_files(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type", F.when(F.col("p_size") > 25, ".log").otherwise(".py")).alias("path"))
    return not_ignored(files, "path", ["# built", "*.log", "!**/PROMO*.log", "/Brand#1?/"])


# ---------------------------------------------------------------- commits
def commits_since(commits: DataFrame, limit: int, since: str | None = None, most_files: int = 50) -> DataFrame:
    """The newest ``limit`` commits after ``since``: no first commits, empty merges, huge changes or robots.

    ``commits``: ``sha``, ``at``, ``parents``, ``files``, ``message``, ``email``. A mark in the message keeps huge changes
    and robots. An unknown ``since`` stops nothing.
    """
    keep = F.contains(F.coalesce("message", F.lit("")), F.lit("[lineage:keep]"))
    robot = F.lower(F.coalesce("email", F.lit(""))).rlike(r"dependabot|renovate\[bot\]")
    wanted = commits.where((F.col("parents") > 0) & ~((F.col("parents") > 1) & (F.col("files") == 0)) & (keep | ((F.col("files") <= most_files) & ~robot)))
    if since is not None:
        last = F.broadcast(commits.where(F.col("sha") == since).agg(F.max("at").alias("_last")))  # one row
        wanted = wanted.join(last).where(F.col("_last").isNull() | (F.col("at") > F.col("_last"))).drop("_last")
    return wanted.orderBy(F.desc("at"), "sha").limit(limit)


_COMMITS = "CAST(o_orderkey AS STRING) AS sha, o_orderdate AS at, o_orderkey % 3 AS parents, o_orderkey % 60 AS files, CASE WHEN o_orderkey % 11 = 0 THEN 'x [lineage:keep]' ELSE 'x' END AS message, CASE WHEN o_custkey % 5 = 0 THEN 'Dependabot@x' ELSE 'a@x' END AS email"


@query(
    "commit_history",
    f"""WITH c AS (SELECT {_COMMITS.replace(" AS at,", ' AS "at",')} FROM orders) SELECT sha, parents, files, message, email FROM c WHERE parents > 0 AND NOT (parents > 1 AND files = 0) AND (message LIKE '%keep]' OR (files <= 50 AND email = 'a@x')) AND "at" > (SELECT max("at") FROM c WHERE sha = '1') ORDER BY "at" DESC, sha LIMIT 100""",
)
def commit_history(spark, sf_dir):
    """The hundred newest orders, taken as commits, after the first one."""
    return commits_since(table(spark, sf_dir, "orders").selectExpr(*_COMMITS.replace(", CASE", "|CASE").replace(", o_", "|o_").split("|")), 100, "1").drop("at")
