"""Sessions of two more agent hosts as tables: event logs with cumulative token counters, and chat logs of several kinds.

A session's lines are one ordered log. State that lines change, such as the model in use, is carried along by windows over
the session; results of calls are paired with calls by id, or in order of arrival where there is none; nothing is
collected. Broken lines are passed over, events that are written twice count once.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.protocols import SOURCES
from ..registry import query
from .tables import table

# Names under which hosts write an event's identity and its token counts.
IDENTITY = ("id", "event_id", "eventId", "uuid", "message_id", "messageId", "call_id", "callId")
CHAT_IDENTITY = ("id", "event_id", "eventId", "messageId", "message_id", "toolCallId", "spanId", "traceId")
INPUT = ("input_tokens", "inputTokens", "prompt_tokens", "promptTokens")
OUTPUT = ("output_tokens", "outputTokens", "completion_tokens", "completionTokens")
REASONING = ("reasoning_output_tokens", "reasoningOutputTokens", "reasoning_tokens", "reasoningTokens")
CACHED = ("cached_input_tokens", "cachedInputTokens", "cache_read_tokens", "cacheReadTokens")
CACHE_WRITE = ("cache_creation_input_tokens", "cacheCreationInputTokens", "cache_write_tokens", "cacheWriteTokens")
OUTPUT_DETAILS = ("reasoning_tokens", "reasoningTokens", "reasoning_output_tokens", "reasoningOutputTokens")
INPUT_DETAILS = ("cached_tokens", "cachedTokens", "cache_read_tokens", "cacheReadTokens")
# What a host puts around a user's own words.
SYSTEM_PREFIXES = (
    "<user_instructions>", "<environment_context>", "<permissions instructions>", "<permissions_instructions>", "# AGENTS.md instructions",
    "AGENTS.md instructions", "<local-command", "<ide_", "<thinking>",
)
REQUEST = r"(?is)#+\s*(?:My request for Codex|My request|Request|Task|Prompt)[^:\n]*:\s*\n+(.+?)(?=\n#+\s|\z)"
REQUEST_ENDS = ("<INSTRUCTIONS>", "<environment_context>", "## Current Date:", "## Context", "```")
PATCHED_FILE = r"(?im)^\*\*\*\s+(?:Update|Add|Delete|Move|Rename)\s+File:\s+(.+)$"
ABSOLUTE_PATH = r"((?:[A-Za-z]:[\\/]|/)[^\s\"'`<>()\[\]{}]+)"
#: A file is recognised by one of its first events.
RECOGNISED_WITHIN = 20
#: Microseconds between the starts of a transcript and of its parent, at most.
PARENT_WITHIN = 8 * 3600 * 1_000_000

ZERO = ("input", "output", "reasoning", "cached", "cache_write")


def log(*queue: str, upto: int | None = None):
    """The session's events in order, or those of a part of it; with ``upto`` the rows up to that many after the current one."""
    w = Window.partitionBy("session", *queue).orderBy("place")
    return w if upto is None else w.rowsBetween(Window.unboundedPreceding, upto)


class Sessions(NamedTuple):
    """``sessions``: a row each; ``usage``: a row for each count of tokens that is billed; ``tools``: a row for each session
    and tool; ``commands``: a row for each command; ``files``: a row for each session and file."""

    sessions: DataFrame
    usage: DataFrame
    tools: DataFrame
    commands: DataFrame
    files: DataFrame


def session_lines(spark: SparkSession, path: str, session: Callable[[Column], Column]) -> DataFrame:
    """``session``, ``file``, ``place``, ``line`` of the files under ``path``; ``session`` makes the session of a file's address.

    Large files are split, so that a line's place is its split's start and its number there.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    file = F.col("_metadata.file_path")
    place = F.struct(file.alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return raw.select(session(file).alias("session"), F.regexp_extract(file, r"([^/]+)$", 1).alias("file"), place.alias("place"), F.col("value").alias("line")).where(F.trim("line") != "")


# ---------------------------------------------------------------- columns
def _strings(names) -> str:
    return ", ".join(f"`{n}`: string" for n in names)


def _whole(text: Column) -> Column:
    return F.coalesce(text.try_cast("double").cast("long"), F.lit(0))


def _first_count(box: Column, names) -> Column:
    return F.coalesce(*(F.nullif(_whole(box[n]), F.lit(0).cast("long")) for n in names), F.lit(0).cast("long"))


_USAGE = f"struct<{_strings((*INPUT, *OUTPUT, *REASONING, *CACHED, *CACHE_WRITE))}, " + ", ".join(
    f"`{n}`: struct<{_strings(f)}>" for n, f in (("output_tokens_details", OUTPUT_DETAILS), ("outputTokensDetails", OUTPUT_DETAILS), ("input_tokens_details", (*INPUT_DETAILS, *CACHE_WRITE)), ("inputTokensDetails", (*INPUT_DETAILS, *CACHE_WRITE)))
) + ">"


def token_counts(raw: Column) -> Column:
    """``input``, ``output``, ``reasoning`` (part of the output), ``cached`` (part of the input) and ``cache_write`` of a host's usage object, as JSON text."""
    u = F.from_json(raw, _USAGE)
    inner = lambda own, snake, camel, names: F.coalesce(F.nullif(_first_count(u, own), F.lit(0).cast("long")), F.nullif(_first_count(u[snake], names), F.lit(0).cast("long")), _first_count(u[camel], names))
    out = _first_count(u, OUTPUT)
    reasoning = F.least(inner(REASONING, "output_tokens_details", "outputTokensDetails", OUTPUT_DETAILS), out)
    cached = inner(CACHED, "input_tokens_details", "inputTokensDetails", INPUT_DETAILS)
    written = inner(CACHE_WRITE, "input_tokens_details", "inputTokensDetails", CACHE_WRITE)
    return F.struct(_first_count(u, INPUT).alias("input"), out.alias("output"), reasoning.alias("reasoning"), cached.alias("cached"), written.alias("cache_write"))


def _any(counts: Column) -> Column:
    return F.coalesce(sum((counts[n] for n in ZERO), F.lit(0)) != 0, F.lit(False))


def human_part(text: Column) -> Column:
    """What a user typed, without what the host has put around it; empty if nothing is left."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    asked = F.regexp_replace(F.regexp_extract(t, REQUEST, 1), r"^\s+|\s+$", "")
    for end in REQUEST_ENDS:
        asked = F.regexp_replace(F.substring_index(asked, end, 1), r"^\s+|\s+$", "")
    system = F.lit(False)
    for p in SYSTEM_PREFIXES:
        system |= F.startswith(t, F.lit(p))
    context = (F.length(t) > 2000) & (F.contains(t, F.lit("<INSTRUCTIONS>")) | F.contains(t, F.lit("# AGENTS.md")))
    return F.when((F.length(t) < 1000) & ~F.startswith(t, F.lit("<")), t).when(F.rlike(t, F.lit(REQUEST)), asked).when(system | context, "").otherwise(t)


def prompt_tokens(text: Column) -> Column:
    return F.when(text == "", F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4)))


def counted_once(events: DataFrame, identity: Column) -> DataFrame:
    """Events of an identity once, at their first place; others once where the same line follows itself."""
    first = F.row_number().over(Window.partitionBy("session", "_id").orderBy("place"))
    once = events.withColumn("_id", identity).withColumn("_n", F.when(F.col("_id").isNotNull(), first)).where("_n IS NULL OR _n = 1")
    was = F.lag(F.struct("_id", "line")).over(log())
    again = F.col("_id").isNull() & was.isNotNull() & was["_id"].isNull() & (was["line"] == F.col("line"))
    return once.withColumn("_again", F.coalesce(again, F.lit(False))).where("NOT _again").drop("_n", "_again")


def _identity(boxes, names, space: Column) -> Column:
    """The space and the first of ``names`` in the first of ``boxes`` that has one; null if none has."""
    found = F.coalesce(*(F.nullif(F.trim(b[n]), F.lit("")) for b in boxes for n in names))
    return F.when(found.isNotNull(), F.concat_ws(":", space, found))


def _first_in_order(condition: Column, value: Column) -> Column:
    return F.min_by(F.when(condition, value), F.when(condition, F.col("place")))


def in_arrival_order(events: DataFrame, opens: Column, closes: Column, *queue: str) -> DataFrame:
    """Adds ``_pair``: the number of the opening event that a closing one takes from the queue, null where the queue is empty; on opening events their own number.

    The queue, one for each session and ``queue``, is empty at a closing event whose balance of openings and closings is
    below all before it.
    """
    upto, before = log(*queue, upto=0), log(*queue, upto=-1)
    known = events.withColumn("_b", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(upto))
    low = F.least(F.lit(0), F.coalesce(F.min("_b").over(before), F.lit(0)))
    known = known.withColumn("_taken", F.when(closes, F.col("_b") >= low))
    number = F.when(opens, F.sum(F.when(opens, 1).otherwise(0)).over(upto)).when(F.col("_taken"), F.sum(F.when(F.col("_taken"), 1).otherwise(0)).over(upto))
    return known.withColumn("_pair", number).drop("_b", "_taken")


def _summed(usage: DataFrame) -> DataFrame:
    """Totals of each session, and its model if there is only one; ``auto`` is no model."""
    named = F.when(~F.col("model").isin("", "auto"), F.col("model"))
    g = usage.groupBy("session").agg(*(F.sum(n).alias(n) for n in ZERO), F.count_distinct(named).alias("n_models"), F.max(named).alias("model"))
    return g.withColumn("model", F.when(F.col("n_models") == 1, F.col("model")))


# ---------------------------------------------------------------- event logs
_PAYLOAD = f"struct<type: string, {_strings(IDENTITY)}, timestamp: string, model: string, model_id: string, cwd: string, message: string, info: struct<last_token_usage: string, total_token_usage: string>, command: string, exit_code: string, changes: string, invocation: struct<server: string, tool: string>, name: string, arguments: string, input: string, summary: string, text: string>"
_EVENT = f"type string, _type string, {_strings(IDENTITY).replace(': string', ' string')}, timestamp string, model string, model_id string, modelId string, cwd string, role string, content string, usage string, name string, function struct<name: string>, arguments string, summary string, text string, payload {_PAYLOAD}, _broken string"
_ARGUMENTS = "struct<cmd: string, command: string, patch: string>"


def event_logs(lines: DataFrame) -> Sessions:
    """Sessions of an event log in either of its two formats, told apart by the first events of each.

    ``lines``: ``session``, ``place`` (anything that sorts), ``line``. The model is the one of the last turn before. Where one
    model is used, the last cumulative counter is the session's usage, else each turn's own count; cached input is no input.
    """
    e = F.from_json("line", _EVENT, {"columnNameOfCorruptRecord": "_broken"})
    parsed = lines.where(F.ltrim("line").startswith("{")).withColumn("e", e).where("e._broken IS NULL").select("session", "place", F.trim("line").alias("line"), "e")
    kind = F.col("e.type")
    decisive = F.when(kind == "session_meta", "events").when(kind.isin("message", "reasoning", "function_call", "function_call_output"), "flat").when(kind.isNull() & F.col("e.id").isNotNull() & F.col("e.timestamp").isNotNull(), "flat")
    parsed = parsed.withColumns({"_d": decisive, "_n": F.row_number().over(log())})
    whole = Window.partitionBy("session")
    parsed = parsed.withColumn("format", F.coalesce(F.min_by("_d", F.when(F.col("_d").isNotNull() & (F.col("_n") <= RECOGNISED_WITHIN), F.col("place"))).over(whole), F.lit("events"))).drop("_d", "_n")
    p = F.col("e.payload")
    space = F.concat_ws(":", F.coalesce(F.nullif(kind, F.lit("")), "e._type", F.lit("")), F.nullif(p["type"], F.lit("")))
    ev = counted_once(parsed, _identity((F.col("e"), p), IDENTITY, space))
    flat, sub = F.col("format") == "flat", p["type"]
    of = lambda outer, *inner: ~flat & (kind == outer) & (sub.isin(*inner) if inner else F.lit(True))

    # state along the log
    turn_model = F.when(of("turn_context"), F.nullif(p["model"], F.lit("")))
    meta_model = F.when(of("session_meta"), F.coalesce(F.nullif(p["model"], F.lit("")), F.nullif(p["model_id"], F.lit(""))))
    any_model = F.when(flat, F.coalesce(*(F.nullif(F.col(f"e.{n}"), F.lit("")) for n in ("model", "model_id", "modelId"))))
    carried = F.coalesce(F.last(F.coalesce(any_model, turn_model), True).over(log(upto=0)), F.first(meta_model, True).over(log(upto=0)), F.lit(""))
    count = token_counts(F.when(flat, F.col("e.usage")).otherwise(p["info"]["last_token_usage"]))
    total = F.when(F.ltrim(p["info"]["total_token_usage"]).startswith("{"), token_counts(p["info"]["total_token_usage"]))
    is_count = of("event_msg", "token_count")
    call = of("response_item", "function_call", "custom_tool_call") | (flat & (kind == "function_call"))
    name = F.when(flat, F.coalesce(F.nullif("e.name", F.lit("")), "e.function.name", F.lit("unknown"))).otherwise(F.coalesce(p["name"], F.when(sub == "custom_tool_call", "custom_tool").otherwise("")))
    arguments = F.from_json(F.when(flat, F.col("e.arguments")).otherwise(p["arguments"]), _ARGUMENTS)
    patch = F.when(name == "apply_patch", F.when(of("response_item", "custom_tool_call"), p["input"]).otherwise(arguments["patch"]))
    command = F.when(name.isin("exec_command", "shell_command"), F.coalesce(F.nullif(arguments["cmd"], F.lit("")), F.nullif(arguments["command"], F.lit(""))))
    id_of = F.when(~flat, F.nullif(p["call_id"], F.lit("")))
    ended = F.from_json(p["command"], "array<string>")
    end_command = F.when(of("event_msg", "exec_command_end"), F.nullif(F.coalesce(F.try_element_at(ended, F.lit(-1)), p["command"]), F.lit("")))
    changes = F.from_json(F.when(of("event_msg", "patch_apply_end"), p["changes"]), "map<string,string>")
    # a line is read into these columns once; what follows does not parse again
    ev = ev.select(
        "session", "place", "format", "e", carried.alias("model"), F.coalesce(turn_model, meta_model, any_model).isNotNull().alias("sets"), is_count.alias("is_count"), count.alias("count"),
        F.when(is_count, total).alias("total"), call.alias("call"), F.when(call, name).alias("tool"), F.when(call, patch).alias("patch"), F.when(call, command).alias("command"), id_of.alias("call_id"), end_command.alias("end_command"),
        F.when(F.size(changes) > 0, F.map_keys(changes)).alias("changed"), F.when(of("event_msg", "exec_command_end"), p["exit_code"].try_cast("int")).alias("exit_code"),
    )
    kind, p = F.col("e.type"), F.col("e.payload")
    flat = F.col("format") == "flat"

    # tokens
    counts = lambda c, source: (F.greatest(c["input"] - c["cached"], F.lit(0)).alias("input"), *(c[n].alias(n) for n in ZERO[1:]), F.lit(source).alias("source"))
    turns = ev.where(F.col("is_count") | (flat & (kind == "message") & (F.col("e.role") == "assistant"))).where((F.col("model") != "") | _any(F.col("count")))
    turns = turns.select("session", "place", "format", "model", *counts(F.col("count"), "turn"))
    last = ev.groupBy("session").agg(F.max_by("total", F.when(F.col("total").isNotNull(), F.col("place"))).alias("total"), F.count_distinct(F.when(F.col("sets") & ~flat, F.col("model"))).alias("seen"), F.max_by("model", "place").alias("model"), F.max("place").alias("place"), F.max("format").alias("format"), F.max("is_count").alias("any"))
    with_turns = turns.select("session").distinct().withColumn("has", F.lit(True))
    last = last.join(with_turns, "session", "left").where((F.col("format") == "events") & _any(F.col("total")) & ((F.col("seen") <= 1) | F.col("has").isNull()))
    totals = last.select("session", "place", "format", "model", *counts(F.col("total"), "total"))
    usage = turns.join(totals.select("session"), "session", "left_anti").unionByName(totals).drop("format")

    # calls and what ended them
    execs = F.col("call") & (F.coalesce("command", F.lit("")) != "") & ~flat
    patches = F.col("call") & (F.col("tool") == "apply_patch") & ~flat
    same_id = log("call_id", upto=-1)
    has_id = F.col("call_id").isNotNull()
    known = ev.withColumns({"exec_before": F.coalesce(F.max(F.when(has_id, execs)).over(same_id), F.lit(False)), "patch_before": F.coalesce(F.max(F.when(has_id, patches)).over(same_id), F.lit(False))})
    is_end, is_patched = F.col("end_command").isNotNull(), F.col("changed").isNotNull()
    known = in_arrival_order(known, execs & ~has_id, is_end & ~has_id).withColumnRenamed("_pair", "exec_pair")
    known = in_arrival_order(known, patches & ~has_id, is_patched & ~has_id).withColumnRenamed("_pair", "patch_pair")
    lone = is_end & F.when(has_id, ~F.col("exec_before")).otherwise(F.col("exec_pair").isNull())
    lone_patch = is_patched & F.when(has_id, ~F.col("patch_before")).otherwise(F.col("patch_pair").isNull())
    other = (~flat) & (kind == "event_msg") & (p["type"] == "mcp_tool_call_end")
    used = F.when(F.col("call"), F.col("tool")).when(lone, "shell").when(lone_patch, "patch").when(other, F.coalesce(p["invocation"]["tool"], F.lit("mcp")))
    # a turn's tokens are shared out among the calls since the last turn that had any
    spent = F.col("is_count") & ((F.col("count.input") != 0) | (F.col("count.output") != 0))
    dealt = known.withColumns({"used": used, "group": F.count_if(spent).over(log(upto=-1))})
    # arguments go in with the output of the turn, results come back with the input of it
    per = dealt.groupBy("session", "group").agg(F.count_if(F.col("call") & ~flat).alias("calls"), F.max(F.when(spent, F.col("count.input"))).alias("back"), F.max(F.when(spent, F.col("count.output"))).alias("sent"))
    per = per.where("calls > 0").select("session", "group", F.expr("sent div calls").alias("sent"), F.expr("back div calls").alias("back"))
    tools = dealt.where(used.isNotNull()).join(per, ["session", "group"], "left").groupBy("session", F.col("used").alias("tool")).agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.when(F.col("call"), F.col("sent"))), F.lit(0)).alias("in_tokens"), F.coalesce(F.sum(F.when(F.col("call"), F.col("back"))), F.lit(0)).alias("out_tokens"))
    ran = known.where(F.col("call") & (F.coalesce("command", F.lit("")) != "")).select("session", "place", F.substring("command", 1, 200).alias("command"), "call_id", "exec_pair")
    over = known.where(is_end & ~lone).select("session", F.col("call_id").alias("c"), F.col("exec_pair").alias("q"), F.col("exit_code"), F.substring("end_command", 1, 200).alias("as_run"))
    by_id = ran.where("call_id IS NOT NULL").join(over.where("c IS NOT NULL").withColumnRenamed("c", "call_id"), ["session", "call_id"], "left")
    in_turn = ran.where("call_id IS NULL").join(over.where("c IS NULL").withColumnRenamed("q", "exec_pair"), ["session", "exec_pair"], "left")
    shape = ("session", "place", F.coalesce("as_run", "command").alias("command"), "exit_code")
    commands = by_id.select(*shape).unionByName(in_turn.select(*shape)).unionByName(known.where(lone).select("session", "place", F.substring("end_command", 1, 200).alias("command"), "exit_code"))
    files = ev.select("session", F.explode(F.coalesce("changed", F.transform(F.regexp_extract_all("patch", F.lit(PATCHED_FILE)), F.trim), F.array().cast("array<string>"))).alias("file")).distinct()

    # what the user asked for; of the message that gives the task, nothing after the block that does
    blocks = F.from_json("e.content", "array<struct<type: string, text: string>>")
    texts = F.when(flat & (kind == "message") & (F.col("e.role") == "user"), F.transform(F.filter(blocks, lambda b: b.type.isin("input_text", "text")), lambda b: b.text)).when(~flat & (kind == "event_msg") & (p["type"] == "user_message"), F.array(p["message"]))
    said = ev.select("session", "place", "format", F.posexplode(texts).alias("block", "text")).withColumn("text", human_part(F.col("text")))
    at = F.struct("place", "block")
    first = F.min(F.when(F.col("text") != "", at)).over(whole)
    said = said.withColumn("_first", first)
    heard = ~((F.col("format") == "flat") & (F.col("place") == F.col("_first.place")) & (F.col("block") > F.col("_first.block")))
    asked = said.groupBy("session").agg(F.sum(F.when(F.coalesce(heard, F.lit(True)), prompt_tokens(F.col("text"))).otherwise(0)).alias("prompt_tokens"), F.max(F.when(at == F.col("_first"), F.substring("text", 1, 200))).alias("task"))
    own = ~flat & (kind == "session_meta")
    preamble = flat & kind.isNull() & F.col("e.id").isNotNull() & F.col("e.timestamp").isNotNull()
    moment = lambda c: c.try_cast("timestamp")
    where = F.when(own, F.nullif(p["cwd"], F.lit(""))).when(preamble, F.nullif("e.cwd", F.lit("")))
    box = lambda n: F.when(flat, F.col(f"e.{n}")).otherwise(p[n])
    thought = F.when(flat, kind == "reasoning").otherwise((kind == "response_item") & (p["type"] == "reasoning")) & ~F.coalesce(F.nullif(F.nullif(box("summary"), F.lit("")), F.lit("[]")), box("text"), F.lit("")).isin("")
    # the first folder of an event log counts, the last one of a flat log
    placed = ev.groupBy("session", "format").agg(
        F.coalesce(F.max_by(F.when(own, moment(p["timestamp"])), F.when(own & p["timestamp"].isNotNull(), F.col("place"))), _first_in_order(flat & F.col("e.timestamp").isNotNull(), moment(F.col("e.timestamp")))).alias("created_at"),
        _first_in_order(where.isNotNull(), where).alias("_a"), F.max_by(where, F.when(where.isNotNull(), F.col("place"))).alias("_b"), F.count_if(thought).alias("reasonings"),
    )
    placed = placed.select("session", "format", "created_at", F.when(F.col("format") == "flat", F.col("_b")).otherwise(F.col("_a")).alias("workspace"), "reasonings")
    sums = _summed(usage)
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    sessions = placed.join(sums, "session", "left").join(asked, "session", "left").select("session", "format", "created_at", "workspace", "task", zero("prompt_tokens"), *(zero(n) for n in ZERO), "model", zero("n_models"), "reasonings")
    return Sessions(sessions, usage, tools, commands, files)


def read_event_logs(spark: SparkSession, path: str) -> Sessions:
    """Event logs under ``path``; a session is the last five parts of a file's name."""
    stem = lambda file: F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)
    last = lambda file: F.when(F.size(F.split(stem(file), "-")) >= 5, F.substring_index(stem(file), "-", -5)).otherwise(stem(file))
    return event_logs(session_lines(spark, path, last))


# ---------------------------------------------------------------- chat logs
_CHAT_USAGE = "inputTokens: string, outputTokens: string, cacheReadTokens: string, cacheWriteTokens: string, reasoningTokens: string"
_CHAT_DATA = f"struct<{_strings(dict.fromkeys((*CHAT_IDENTITY, 'selectedModel', 'startTime', 'newModel', 'content', 'model', 'outputTokens', 'toolName', 'name', 'arguments', 'command', 'cmd', 'exit_code', 'code', 'ok', 'error_signature', 'path', 'test_id', 'passed')))}, toolRequests: array<struct<toolCallId: string, name: string>>, toolTelemetry: struct<metrics: struct<resultForLlmLength: string>>, compactionTokensUsed: struct<model: string, {_CHAT_USAGE}>, modelMetrics: map<string, struct<usage: struct<{_CHAT_USAGE}>>>>"
_CHAT_EVENT = f"type string, {_strings(CHAT_IDENTITY).replace(': string', ' string')}, timestamp string, data {_CHAT_DATA}, _broken string"
_PATHS = ("path", "file_path", "filePath")


def _chat_events(lines: DataFrame) -> DataFrame:
    e = F.from_json("line", _CHAT_EVENT, {"columnNameOfCorruptRecord": "_broken"})
    parsed = lines.where(F.ltrim("line").startswith("{")).withColumn("e", e).where("e._broken IS NULL").select("session", "place", F.trim("line").alias("line"), "e")
    ev = counted_once(parsed, _identity((F.col("e"), F.col("e.data")), CHAT_IDENTITY, F.coalesce("e.type", F.lit(""))))
    return ev.select("session", "place", "line", F.coalesce("e.type", F.lit("")).alias("kind"), F.col("e.timestamp").alias("at"), F.col("e.data").alias("d"))


def _chat_counts(u: Column) -> tuple[Column, ...]:
    names = ("inputTokens", "outputTokens", "reasoningTokens", "cacheReadTokens", "cacheWriteTokens")
    return tuple(_whole(u[n]).alias(z) for n, z in zip(names, ZERO, strict=True))


def chat_logs(lines: DataFrame) -> Sessions:
    """Sessions of chat logs; ``lines`` as for ``event_logs``. ``reasoning`` comes on top of the output here.

    The model is what a session starts with or changes to; where that is none or ``auto``, the first one that an answer, a
    call or a compaction names since. What is billed are the totals that a session writes as it ends; without these its
    compactions and answers.
    """
    ev = _chat_events(lines)
    k, d = F.col("kind"), F.col("d")
    real = lambda c: F.when(~F.coalesce(F.trim(c), F.lit("")).isin("", "auto"), F.trim(c))
    chosen = F.when(k == "session.start", F.nullif(d["selectedModel"], F.lit(""))).when(k == "session.model_change", F.nullif(d["newModel"], F.lit("")))
    named = F.when(k.isin("assistant.message", "tool.execution_complete"), real(d["model"])).when(k == "session.compaction_complete", real(d["compactionTokensUsed"]["model"]))
    ev = ev.withColumns({"_chosen": chosen, "_named": named}).withColumn("_era", F.count("_chosen").over(log(upto=0)))
    era = log("_era", upto=0)
    state = F.coalesce(real(F.first("_chosen", True).over(era)), F.first("_named", True).over(era), F.first("_chosen", True).over(era), F.lit(""))
    ev = ev.withColumn("model", state)

    def billed(rows, model, usage, source):
        return rows.select("session", "place", F.coalesce(model, F.lit("")).alias("model"), *usage, F.lit(source).alias("source"))

    nothing = [F.lit(0).cast("long").alias(n) for n in ZERO]
    answers = ev.where((k == "assistant.message") & (_whole(d["outputTokens"]) > 0))
    answers = billed(answers, F.coalesce(real(d["model"]), "model"), [nothing[0], _whole(d["outputTokens"]).alias("output"), *nothing[2:]], "answer")
    c = d["compactionTokensUsed"]
    compacted = billed(ev.where((k == "session.compaction_complete") & c.isNotNull()), F.coalesce(real(c["model"]), "model"), _chat_counts(c), "compaction")
    ends = ev.where(k == "session.shutdown").select("session", "place", F.explode("d.modelMetrics").alias("name", "m"))
    ends = billed(ends, F.col("name"), _chat_counts(F.col("m")["usage"]), "end")
    some = sum((F.col(n) for n in ZERO), F.lit(0)) != 0
    ends, layers = (x.where((F.col("model") != "") | some) for x in (ends, compacted.unionByName(answers)))
    usage = layers.join(ends.select("session").distinct(), "session", "left_anti").unionByName(ends)

    # tools: an answer's output is shared out among the calls it asks for; a call's result counts once
    asked = ev.where(k == "assistant.message").select("session", _whole(d["outputTokens"]).alias("sent"), F.size("d.toolRequests").alias("n"), F.explode("d.toolRequests").alias("t")).where("sent > 0")
    asked = asked.select("session", F.col("t.toolCallId").alias("call"), F.col("t.name").alias("tool"), F.expr("sent div n").alias("sent"))
    done = ev.where(k == "tool.execution_complete").groupBy("session", F.col("d.toolCallId").alias("call")).agg(F.min_by(F.floor(_whole(d["toolTelemetry"]["metrics"]["resultForLlmLength"]) / 4), "place").alias("got"))
    met = asked.join(done.where("call IS NOT NULL").withColumn("met", F.lit(True)), ["session", "call"], "left").where("tool IS NOT NULL OR met")
    tokens = met.groupBy("session", F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(F.sum("sent").alias("in_tokens"), F.sum(F.coalesce("got", F.lit(0))).alias("out_tokens"))
    started = F.when(k == "tool.execution_start", F.nullif(d["toolName"], F.lit(""))).when(k == "tool_call", F.nullif(d["name"], F.lit("")))
    calls = ev.where(started.isNotNull()).groupBy("session", started.alias("tool")).agg(F.count("*").alias("calls"))
    tools = calls.join(tokens, ["session", "tool"], "left").select("session", "tool", "calls", F.coalesce("in_tokens", F.lit(0)).alias("in_tokens"), F.coalesce("out_tokens", F.lit(0)).alias("out_tokens"))

    # commands: a result belongs to the first run of the same command that has none yet
    given = F.from_json("d.arguments", f"struct<{_strings((*_PATHS, 'command', 'cmd'))}>")
    tool = d["toolName"]
    command = F.when((k == "tool.execution_start") & tool.isin("bash", "read_bash"), F.coalesce(F.nullif(given["command"], F.lit("")), given["cmd"])).when(k == "command_result", F.coalesce(F.nullif(d["command"], F.lit("")), d["cmd"]))
    runs = ev.withColumn("command", F.nullif(F.substring(F.trim(command), 1, 200), F.lit(""))).where("command IS NOT NULL")
    runs = in_arrival_order(runs, F.col("kind") == "tool.execution_start", F.col("kind") == "command_result", "command")
    code = F.coalesce(d["exit_code"], d["code"]).try_cast("int")
    result = runs.where("kind = 'command_result'").select("session", "place", "command", "_pair", code.alias("exit_code"))
    begun = runs.where("kind <> 'command_result'").select("session", "place", "command", "_pair").join(result.where("_pair IS NOT NULL").drop("place"), ["session", "command", "_pair"], "left")
    commands = begun.unionByName(result.where("_pair IS NULL")).select("session", "place", "command", "exit_code")
    touched = F.when((k == "tool.execution_start") & tool.isin("edit", "create", "create_thunk", "view"), F.coalesce(*(F.nullif(given[n], F.lit("")) for n in _PATHS))).when(k.isin("file_edit", "file_revert"), F.nullif(d["path"], F.lit("")))
    files = ev.select("session", touched.alias("file")).where("file IS NOT NULL").distinct()

    # the first message is the task; one that only tells to follow a file gives way to the next of over 20 characters
    parts = F.from_json("d.content", "array<struct<text: string>>")
    text = F.when(F.ltrim(d["content"]).startswith("[") & parts.isNotNull(), F.array_join(F.transform(parts, lambda x: F.coalesce(x.text, F.lit(""))), " ")).otherwise(d["content"])
    said = ev.where(k == "user.message").withColumn("text", text).where("text <> ''").withColumn("_n", F.row_number().over(log()))
    able = (F.col("_n") == 1) | (F.length("text") > 20)
    plain = able & ~F.startswith("text", F.lit("Read and follow"))
    cut = F.substring("text", 1, 200)
    heard = said.groupBy("session").agg(F.sum(F.greatest(F.lit(1), F.floor(F.length("text") / 4))).alias("prompt_tokens"), F.coalesce(_first_in_order(plain, cut), F.max_by(F.when(able, cut), F.when(able, F.col("place")))).alias("task"))
    at = F.when(k == "session.start", F.coalesce(F.nullif(d["startTime"], F.lit("")), F.nullif("at", F.lit(""))))
    wrong = F.when((k == "command_result") & ~F.coalesce(d["ok"] == "true", F.lit(False)), F.nullif(d["error_signature"], F.lit("")))
    about = ev.groupBy("session").agg(
        _first_in_order(at.isNotNull(), at.try_cast("timestamp")).alias("created_at"), F.count_if(k == "session.compaction_complete").alias("compactions"), F.count_distinct(F.substring(wrong, 1, 200)).alias("errors"),
        F.count_if((k == "test_result") & d["test_id"].isNotNull()).alias("tests"), F.count_if((k == "test_result") & d["test_id"].isNotNull() & (d["passed"] == "true")).alias("tests_passed"),
    )
    zero = lambda n: F.coalesce(n, F.lit(0)).cast("long").alias(n)
    sessions = about.join(_summed(usage), "session", "left").join(heard, "session", "left").select("session", "created_at", "task", zero("prompt_tokens"), *(zero(n) for n in ZERO), "model", zero("n_models"), "compactions", "errors", "tests", "tests_passed")
    return Sessions(sessions, usage, tools, commands, files)


def read_chat_logs(spark: SparkSession, path: str) -> Sessions:
    """Chat logs under ``path``; a session is the folder that its files lie in."""
    return chat_logs(session_lines(spark, path, lambda file: F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)))


# ---------------------------------------------------------------- parents of transcripts
def plain_path(path: Column) -> Column:
    """Slashes one way and single, no last one, drives in capitals."""
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\+", "/"), "/+$", "")
    drive = F.rlike(slashed, F.lit("^[A-Za-z]:"))
    single = F.regexp_replace(slashed, "/+", "/")
    tail = F.regexp_replace(F.concat(F.lit("/"), F.substr(single, F.lit(3))), "/+", "/")
    return F.when(slashed == "", "/").when(drive, F.concat(F.upper(F.substring(slashed, 1, 1)), F.lit(":"), tail)).when(F.startswith(slashed, F.lit("/")), single).otherwise(slashed)


def transcript_paths(lines: DataFrame) -> DataFrame:
    """``session``, ``started_at``, ``path``: absolute paths in any string of a transcript's events."""
    start = F.from_json("line", "type string, timestamp string, data struct<startTime: string>")
    read = lines.where(F.expr("try_parse_json(line) IS NOT NULL")).withColumn("s", start)
    at = F.when(F.col("s.type") == "session.start", F.coalesce(F.nullif("s.data.startTime", F.lit("")), F.nullif("s.timestamp", F.lit(""))))
    started = read.groupBy("session").agg(_first_in_order(at.isNotNull(), at.try_cast("timestamp")).alias("started_at"))
    # strings lie between quotes; an escaped slash or quote inside them is undone before paths are looked for
    bare = F.regexp_replace(F.regexp_replace("line", r"\\\\", r"\\"), r"\\[nrt\"]", " ")
    found = read.select("session", F.explode(F.regexp_extract_all(bare, F.lit(ABSOLUTE_PATH))).alias("path"))
    found = found.select("session", plain_path(F.regexp_replace("path", r"[.,:;)\]}\"]+$", "")).alias("path")).distinct()
    return found.join(started, "session")


def parents_of(transcripts: DataFrame, parents: DataFrame) -> DataFrame:
    """``session``, ``parent``, ``workspace``: of the sessions whose folder holds one of a transcript's paths and that began within eight hours
    of it, the one with the longest folder, then the nearest in time, then the smallest name.

    ``transcripts``: ``session``, ``started_at``, ``path``; ``parents``: ``session``, ``created_at``, ``workspace``. A path meets
    a folder on one of the folders above it, in an equi join.
    """
    below = F.lower(plain_path(F.col("path")))
    parts = F.split(below, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    t = transcripts.where("started_at IS NOT NULL").select("session", "started_at", F.explode(F.array_distinct(above)).alias("folder")).distinct()
    t = t.withColumn("folder", F.when(F.col("folder") == "", "/").otherwise(F.col("folder")))
    p = parents.where("workspace <> ''").select(F.col("session").alias("parent"), "created_at", "workspace", F.lower(plain_path(F.col("workspace"))).alias("folder"))
    apart = F.abs(F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")))
    near = t.join(p, "folder").withColumn("apart", apart).where(apart <= F.lit(PARENT_WITHIN))
    best = F.min(F.struct((-F.length("folder")).alias("l"), F.col("apart").alias("d"), F.col("parent").alias("parent"), F.col("workspace").alias("workspace")))
    return near.groupBy("session").agg(best.alias("b")).select("session", "b.parent", "b.workspace")


# ---------------------------------------------------------------- debug logs
_DEBUG = f"type string, {_strings(CHAT_IDENTITY).replace(': string', ' string')}, ts double, name string, attrs struct<text: string, toolName: string, model: string, inputTokens: string, outputTokens: string>, data struct<{_strings(CHAT_IDENTITY)}>, _broken string"


def debug_days(lines: DataFrame) -> DataFrame:
    """A row for each ``session`` and UTC ``day`` of debug logs with a request to a model: tokens, requests, other files' requests, prompts, tool calls.

    ``lines``: ``session``, ``file``, ``place``, ``line``. Events without a time have a null day. The day's model is null where it has
    several or none.
    """
    e = F.from_json("line", _DEBUG, {"columnNameOfCorruptRecord": "_broken"})
    ev = lines.where(F.ltrim("line").startswith("{")).withColumn("e", e).where("e._broken IS NULL")
    key = F.coalesce(_identity((F.col("e"), F.col("e.data")), CHAT_IDENTITY, F.coalesce("e.type", F.lit(""))), F.concat(F.lit("raw:"), F.sha2(F.trim("line"), 256)))
    once = ev.withColumn("k", key).groupBy("session", "k").agg(F.min_by(F.struct("e", "file", "place"), F.struct("file", "place")).alias("x")).select("session", "x.*")
    kind, a = F.col("e.type"), F.col("e.attrs")
    at = F.when(F.col("e.ts") > 0, F.timestamp_micros((F.col("e.ts") * 1000).cast("long")))
    text, model = F.trim(F.coalesce(F.nullif(a["text"], F.lit("")), "e.name", F.lit(""))), F.coalesce(F.trim(a["model"]), F.lit(""))
    sent, got = _whole(a["inputTokens"]), _whole(a["outputTokens"])
    request = (kind == "llm_request") & ((sent != 0) | (got != 0) | (model != ""))
    said = (kind == "user_message") & (text != "")
    day = F.to_date(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")))
    g = once.withColumns({"at": at, "day": day}).groupBy("session", "day").agg(
        F.count_if(request).alias("requests"), F.count_if(request & (F.col("file") != "main.jsonl")).alias("side_requests"), F.sum(F.when(request, sent).otherwise(0)).alias("input"), F.sum(F.when(request, got).otherwise(0)).alias("output"),
        F.sum(F.when(said, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(0)).alias("prompt_tokens"), F.min_by(F.when(said, F.substring(text, 1, 200)), F.when(said, F.struct("file", "place"))).alias("task"),
        F.count_if((kind == "tool_call") & (F.coalesce(F.nullif(a["toolName"], F.lit("")), "e.name", F.lit("")) != "")).alias("tool_calls"), F.min("at").alias("first_at"),
        F.count_distinct(F.when(request & (model != ""), model)).alias("n_models"), F.max(F.when(request & (model != ""), model)).alias("model"),
    ).where("requests > 0")
    return g.withColumn("model", F.when(F.col("n_models") == 1, F.col("model")))


def read_debug_logs(spark: SparkSession, path: str) -> DataFrame:
    return debug_days(session_lines(spark, path, lambda file: F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)))


SOURCES.put("event_logs", lambda: read_event_logs)
SOURCES.put("chat_logs", lambda: read_chat_logs)
SOURCES.put("debug_logs", lambda: read_debug_logs)


# ---------------------------------------------------------------- queries: given tables written as logs, and read back
def _line(event: Column) -> Column:
    return F.to_json(event)


def _typed(kind: str, box: str, *fields: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.struct(*fields).alias(box))


def conversations_as_event_logs(turns: DataFrame) -> DataFrame:
    """Each conversation as an event log: users ask, assistants call a tool (written twice) and are counted, the model may change every third turn."""
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)
    t = t.withColumns({"all": F.sum(own).over(w), "all_cached": F.sum(F.expr("CASE WHEN role = 'assistant' THEN n div 4 ELSE 0 END")).over(w), "all_out": F.sum(F.expr("CASE WHEN role = 'assistant' THEN n div 2 ELSE 0 END")).over(w)})
    counts = lambda i, c, o: F.struct(i.alias("input_tokens"), c.alias("cached_input_tokens"), o.alias("output_tokens"))
    info = F.struct(counts(F.col("n"), F.expr("n div 4"), F.expr("n div 2")).alias("last_token_usage"), counts(F.col("all"), F.col("all_cached"), F.col("all_out")).alias("total_token_usage"))
    arguments = F.lit('{"cmd": "ls"}').alias("arguments")
    call = _line(_typed("response_item", "payload", F.lit("function_call").alias("type"), F.when(F.col("turn") % 2 == 0, "read").otherwise("exec_command").alias("name"), arguments, F.concat(F.lit("c"), "turn").alias("call_id")))
    said = F.col("role") == "assistant"
    lines = F.filter(
        F.array(
            F.when(F.col("turn") % 3 == 0, _line(_typed("turn_context", "payload", F.concat(F.lit("m"), (F.col("conv_id") + F.col("turn")) % 2).alias("model")))),
            F.when(F.col("role") == "user", _line(_typed("event_msg", "payload", F.lit("user_message").alias("type"), F.concat(F.lit("u "), F.substring("text", 1, 900)).alias("message")))),
            F.when(said, call), F.when(said, call),
            F.when(said, _line(_typed("event_msg", "payload", F.lit("token_count").alias("type"), info.alias("info")))),
        ),
        lambda x: x.isNotNull(),
    )
    return t.select(F.col("conv_id").alias("session"), "turn", F.posexplode(lines).alias("k", "line")).select("session", F.struct("turn", "k").alias("place"), "line")


@query(
    "event_log_sessions",
    r"""
    WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, len(coalesce(text, '')) AS n, CASE WHEN turn % 3 = 0 THEN 'm' || (conv_id + turn) % 2 END AS m FROM conversations),
    c AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), '') AS model FROM t),
    s AS (SELECT conv_id, count(DISTINCT m) AS seen, arg_max(model, turn) AS last, count(DISTINCT nullif(model, '')) FILTER (role = 'assistant') AS used, max(nullif(model, '')) FILTER (role = 'assistant') AS one, count(*) FILTER (role = 'assistant') AS a,
      coalesce(sum(n - n // 4) FILTER (role = 'assistant'), 0) AS input, coalesce(sum(n // 2) FILTER (role = 'assistant'), 0) AS output, coalesce(sum(n // 4) FILTER (role = 'assistant'), 0) AS cached,
      coalesce(sum(greatest(1, len(trim('u ' || left(text, 900), E' \t\r\n\f\v')) // 4)) FILTER (role = 'user'), 0) AS prompt_tokens, count(*) FILTER (role = 'assistant' AND turn % 2 = 1) AS runs, coalesce(sum(n // 2) FILTER (role = 'assistant' AND turn % 2 = 1), 0) AS run_tokens FROM c GROUP BY 1)
    SELECT conv_id, CASE WHEN input + output + cached > 0 AND seen <= 1 THEN nullif(last, '') WHEN used = 1 THEN one END AS model, CAST(input AS BIGINT) AS input, CAST(output AS BIGINT) AS output, CAST(cached AS BIGINT) AS cached, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, runs, CAST(run_tokens AS BIGINT) AS run_tokens FROM s
    WHERE a > 0 OR prompt_tokens > 0 OR seen > 0
    """,
)
def event_log_sessions(spark, sf_dir):
    got = event_logs(conversations_as_event_logs(table(spark, sf_dir, "conversations")))
    runs = got.tools.where("tool = 'exec_command'").select("session", F.col("calls").alias("runs"), F.col("in_tokens").alias("run_tokens"))
    out = got.sessions.join(runs, "session", "left")
    return out.select(F.col("session").alias("conv_id"), "model", "input", "output", "cached", F.col("prompt_tokens"), F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("run_tokens", F.lit(0)).alias("run_tokens"))


def conversations_as_chat_logs(turns: DataFrame) -> DataFrame:
    """Each conversation as a chat log: every third starts with no certain model, every fifth ends with totals, a system turn is a compaction."""
    t = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    c = F.col("conv_id")
    started = _typed("session.start", "data", F.when(c % 3 == 0, "auto").otherwise(F.concat(F.lit("c"), c % 3)).alias("selectedModel"))
    requests = F.array(F.struct(F.concat(F.lit("t"), "turn").alias("toolCallId"), F.lit("bash").alias("name"))).alias("toolRequests")
    answer = _typed("assistant.message", "data", F.when(F.col("turn") % 4 != 3, F.concat(F.lit("g"), F.col("turn") % 2)).alias("model"), F.col("n").alias("outputTokens"), requests)
    done = _typed("tool.execution_complete", "data", F.concat(F.lit("t"), "turn").alias("toolCallId"), F.struct(F.struct((F.col("n") * 3).alias("resultForLlmLength")).alias("metrics")).alias("toolTelemetry"))
    begun = _typed("tool.execution_start", "data", F.concat(F.lit("t"), "turn").alias("toolCallId"), F.lit("bash").alias("toolName"), F.struct(F.lit("make").alias("command")).alias("arguments"))
    compaction = _typed("session.compaction_complete", "data", F.struct(F.col("n").alias("inputTokens"), F.lit(5).alias("cacheReadTokens")).alias("compactionTokensUsed"))
    totals = _typed("session.shutdown", "data", F.create_map(F.lit("z"), F.struct(F.struct(F.lit(7).alias("inputTokens"), F.lit(3).alias("outputTokens")).alias("usage"))).alias("modelMetrics"))
    said = F.col("role") == "assistant"
    lines = F.filter(
        F.array(
            F.when(F.col("turn") == 0, _line(started)), F.when(F.col("role") == "user", _line(_typed("user.message", "data", F.col("text").alias("content")))), F.when(said, _line(answer)), F.when(said, _line(begun)), F.when(said, _line(done)), F.when(F.col("role") == "system", _line(compaction)),
            F.when((c % 5 == 0) & (F.col("turn") == 1), _line(totals)),
        ),
        lambda x: x.isNotNull(),
    )
    return t.select(F.col("conv_id").alias("session"), "turn", F.posexplode(lines).alias("k", "line")).select("session", F.struct("turn", "k").alias("place"), "line")


@query(
    "chat_log_sessions",
    """
    WITH t AS (SELECT conv_id, turn, role, len(coalesce(text, '')) AS n, CASE WHEN turn % 4 <> 3 THEN 'g' || turn % 2 END AS g FROM conversations),
    s AS (SELECT *, CASE WHEN role = 'assistant' AND g IS NOT NULL THEN g WHEN bool_or(turn = 0) OVER (PARTITION BY conv_id ORDER BY turn) AND conv_id % 3 > 0 THEN 'c' || conv_id % 3
      ELSE first_value(CASE WHEN role = 'assistant' THEN g END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) END AS model FROM t),
    b AS (SELECT conv_id, CASE WHEN model IS NULL AND bool_or(turn = 0) OVER (PARTITION BY conv_id ORDER BY turn) THEN 'auto' ELSE coalesce(model, '') END AS model, CASE role WHEN 'system' THEN n ELSE 0 END AS input, CASE role WHEN 'assistant' THEN n ELSE 0 END AS output, CASE role WHEN 'system' THEN 5 ELSE 0 END AS cached
      FROM s WHERE (role = 'assistant' AND n > 0) OR role = 'system'),
    e AS (SELECT DISTINCT conv_id FROM t WHERE conv_id % 5 = 0 AND turn = 1),
    u AS (SELECT * FROM b WHERE conv_id NOT IN (SELECT conv_id FROM e) UNION ALL SELECT conv_id, 'z', 7, 3, 0 FROM e),
    m AS (SELECT conv_id, sum(input) AS input, sum(output) AS output, sum(cached) AS cached, count(DISTINCT nullif(nullif(model, ''), 'auto')) AS n_models, max(nullif(nullif(model, ''), 'auto')) AS model FROM u GROUP BY 1),
    p AS (SELECT conv_id, sum(CASE WHEN role = 'user' AND n > 0 THEN greatest(1, n // 4) ELSE 0 END) AS prompt_tokens, count(*) FILTER (role = 'assistant') AS runs, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS asked, sum(CASE WHEN role = 'assistant' AND n > 0 THEN n * 3 // 4 ELSE 0 END) AS back, count(*) FILTER (role = 'system') AS compactions, count(*) FILTER (turn = 0 OR role IN ('user', 'assistant', 'system') OR (conv_id % 5 = 0 AND turn = 1)) AS lines FROM t GROUP BY 1)
    SELECT conv_id, CASE WHEN n_models = 1 THEN model END AS model, CAST(coalesce(input, 0) AS BIGINT) AS input, CAST(coalesce(output, 0) AS BIGINT) AS output, CAST(coalesce(cached, 0) AS BIGINT) AS cached, CAST(prompt_tokens AS BIGINT) AS prompt_tokens, compactions, runs, CAST(CASE WHEN runs > 0 THEN asked ELSE 0 END AS BIGINT) AS in_tokens, CAST(back AS BIGINT) AS out_tokens
    FROM p LEFT JOIN m USING (conv_id) WHERE lines > 0
    """,
)
def chat_log_sessions(spark, sf_dir):
    got = chat_logs(conversations_as_chat_logs(table(spark, sf_dir, "conversations")))
    out = got.sessions.join(got.tools.withColumnRenamed("calls", "runs").drop("tool"), "session", "left")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    return out.select(F.col("session").alias("conv_id"), "model", "input", "output", "cached", "prompt_tokens", "compactions", zero("runs"), zero("in_tokens"), zero("out_tokens"))


@query(
    "transcript_parents",
    """
    WITH t AS (SELECT event_id, ts, lower('/W/u' || user_id || '/d' || event_id % 3 || '/x.py') AS path FROM events WHERE event_type = 'view'),
    p AS (SELECT event_id AS parent, ts AS created_at, '/w/u' || user_id || CASE WHEN event_id % 2 = 0 THEN '/d' || event_id % 3 ELSE '' END AS folder FROM events WHERE event_type = 'signup'),
    m AS (SELECT t.event_id, parent, folder, row_number() OVER (PARTITION BY t.event_id ORDER BY len(folder) DESC, abs(epoch_us(created_at) - epoch_us(ts)), parent) AS r FROM t JOIN p ON starts_with(path, folder || '/') AND abs(epoch_us(created_at) - epoch_us(ts)) <= 28800000000)
    SELECT event_id, parent, folder AS workspace FROM m WHERE r = 1
    """,
)
def transcript_parents(spark, sf_dir):
    """Views as transcripts, signups as sessions in a folder of the user or below it."""
    e = table(spark, sf_dir, "events")
    user, deep = F.concat(F.lit("u"), "user_id"), F.concat(F.lit("/d"), F.col("event_id") % 3)
    start = F.struct(F.lit("session.start").alias("type"), F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("startTime")).alias("data"))
    line = F.to_json(F.struct(F.lit("tool").alias("type"), F.concat(F.lit("see (/W//"), user, deep, F.lit("/x.py).")).alias("text")))
    views = e.where("event_type = 'view'").select(F.col("event_id").alias("session"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.to_json(start).alias("line")), F.struct(F.lit(1).alias("place"), line.alias("line")))).alias("l")).select("session", "l.*")
    signups = e.where("event_type = 'signup'").select(F.col("event_id").alias("session"), F.col("ts").alias("created_at"), F.concat(F.lit("/w/"), user, F.when(F.col("event_id") % 2 == 0, deep).otherwise("")).alias("workspace"))
    return parents_of(transcript_paths(views), signups).withColumnRenamed("session", "event_id")


@query(
    "debug_log_days",
    """
    SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type IN ('purchase', 'click')) AS requests, count(*) FILTER (event_type = 'click') AS side_requests, CAST(sum(CASE WHEN event_type IN ('purchase', 'click') THEN event_id % 1000 + 1 ELSE 0 END) AS BIGINT) AS input,
      CAST(sum(CASE WHEN event_type IN ('purchase', 'click') THEN event_id % 7 ELSE 0 END) AS BIGINT) AS output, count(*) FILTER (event_type = 'error') AS tool_calls,
      CASE WHEN count(DISTINCT event_id % 2) FILTER (event_type IN ('purchase', 'click')) = 1 THEN max('m' || event_id % 2) FILTER (event_type IN ('purchase', 'click')) END AS model
    FROM events GROUP BY 1, 2 HAVING requests > 0
    """,
)
def debug_log_days(spark, sf_dir):
    """Purchases and clicks as requests of the main and a side file, each written twice; errors as tool calls."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("purchase", "click"), "llm_request").when(F.col("event_type") == "error", "tool_call").otherwise("user_message")
    attrs = F.struct(F.lit("run").alias("toolName"), F.concat(F.lit("m"), F.col("event_id") % 2).alias("model"), (F.col("event_id") % 1000 + 1).alias("inputTokens"), (F.col("event_id") % 7).alias("outputTokens"))
    line = F.to_json(F.struct(kind.alias("type"), F.col("event_id").alias("spanId"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("ts"), attrs.alias("attrs")))
    lines = e.select(F.col("user_id").alias("session"), F.when(F.col("event_type") == "click", "title.jsonl").otherwise("main.jsonl").alias("file"), F.col("event_id").alias("place"), F.explode(F.array_repeat(line, 2)).alias("line"))
    return debug_days(lines).select(F.col("session").alias("user_id"), "day", "requests", "side_requests", "input", "output", "tool_calls", "model")
