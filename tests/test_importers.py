"""Importers of agent sessions: files of both formats, and random logs against a walk through them line by line."""

import json
import random

from pyspark.sql import functions as F

from tidewater.plans.protocols import SOURCES
from tidewater.sources import importers


def frame(spark, logs):
    rows = [(name, i, x if isinstance(x, str) else json.dumps(x)) for name, lines in logs.items() for i, x in enumerate(lines)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "session string, place int, line string")


def call(name, call_id=None, **arguments):
    return {"type": "response_item", "payload": {"type": "function_call", "name": name, "arguments": json.dumps(arguments)} | ({"call_id": call_id} if call_id else {})}


def message(kind, **payload):
    return {"type": "event_msg", "payload": {"type": kind, **payload}}


def counted(last=None, total=None, n=0):
    return message("token_count", info={"last_token_usage": last, "total_token_usage": total}, id=f"n{n}")


def random_log(rng):
    out, total = [{"type": "session_meta", "payload": {"timestamp": "2026-01-02T03:04:05Z", "cwd": "/w", **({"model": "m0"} if rng.random() < 0.5 else {})}}], 0
    for i in range(rng.randrange(40)):
        r = rng.random()
        if r < 0.15:
            out.append({"type": "turn_context", "payload": {"model": f"m{rng.randrange(2)}"}})
        elif r < 0.4:
            out.append(call(rng.choice(["exec_command", "read"]), rng.choice([None, f"c{i}"]), cmd=f"run {i}"))
        elif r < 0.6:
            known = [x["payload"]["call_id"] for x in out if x["type"] == "response_item" and "call_id" in x["payload"]]
            out.append(message("exec_command_end", command=["sh", "-c", f"end {i}"], exit_code=rng.randrange(3)) | ({} if rng.random() < 0.5 or not known else {"call_id": ""}))
            if known and rng.random() < 0.5:
                out[-1]["payload"]["call_id"] = rng.choice(known)
        elif r < 0.8:
            a, b = rng.randrange(50), rng.randrange(20)
            total += a
            out.append(counted({"input_tokens": a, "output_tokens": b, "cached_input_tokens": a // 3}, {"input_tokens": total, "output_tokens": total // 2, "input_tokens_details": {"cached_tokens": total // 4}} if rng.random() < 0.7 else None, i))
        else:
            out.append(message("user_message", message=rng.choice(["hello there", "   ", "x" * 10]), id=f"u{i}"))
    return [y for x in out for y in ([x, x] if rng.random() < 0.2 else [x])]


def walked(lines):
    """The same log, a line at a time."""
    seen, before, model, models, turns, final = set(), None, "", set(), [], None
    tools, spent, waiting, commands, by_id, queue, prompts = {}, {}, [], [], {}, [], 0
    for ev in lines:
        p = ev["payload"]
        identity = next((v for v in (p.get("id"), p.get("call_id")) if v), None)
        if identity:
            if (ev["type"], p.get("type"), identity) in seen:
                continue
            seen.add((ev["type"], p.get("type"), identity))
            before = None
        elif ev == before:
            continue
        else:
            before = ev
        if ev["type"] == "session_meta":
            if p.get("model") and not model:
                model = p["model"]
                models.add(model)
        elif ev["type"] == "turn_context":
            model = p["model"]
            models.add(model)
        elif ev["type"] == "response_item":
            tools[p["name"]] = tools.get(p["name"], 0) + 1
            waiting.append(p["name"])
            if p["name"] == "exec_command":
                commands.append([json.loads(p["arguments"])["cmd"], None])
                if p.get("call_id"):
                    by_id[p["call_id"]] = len(commands) - 1
                else:
                    queue.append(len(commands) - 1)
        elif p["type"] == "token_count":
            u = p["info"]["last_token_usage"]
            turns.append((model, max(u["input_tokens"] - u["cached_input_tokens"], 0), u["output_tokens"]))
            if p["info"]["total_token_usage"]:
                t = p["info"]["total_token_usage"]
                final = (t["input_tokens"], t["output_tokens"], t["input_tokens_details"]["cached_tokens"])
            if waiting and (u["input_tokens"] or u["output_tokens"]):
                for w in waiting:
                    a, b = spent.get(w, (0, 0))
                    spent[w] = (a + u["output_tokens"] // len(waiting), b + u["input_tokens"] // len(waiting))
                waiting = []
        elif p["type"] == "user_message":
            prompts += max(1, len(p["message"].strip()) // 4) if p["message"].strip() else 0
        elif p["type"] == "exec_command_end":
            at = by_id.pop(p["call_id"], None) if p.get("call_id") else queue.pop(0) if queue else None
            if at is not None:
                commands[at] = [p["command"][-1], p["exit_code"]]
            else:
                commands.append([p["command"][-1], p["exit_code"]])
                tools["shell"] = tools.get("shell", 0) + 1
    turns = [t for t in turns if t[0] or t[1] or t[2]]
    if final and any(final) and (len(models) <= 1 or not turns):
        turns = [(model, max(final[0] - final[2], 0), final[1])]
    used = {t[0] for t in turns if t[0]}
    return (sum(t[1] for t in turns), sum(t[2] for t in turns), used.pop() if len(used) == 1 else None, prompts, sorted((k, v, *spent.get(k, (0, 0))) for k, v in tools.items()), sorted(map(str, commands)))


def test_random_event_logs(spark):
    rng = random.Random(7)
    logs = {f"s{i}": random_log(rng) for i in range(60)}
    got = importers.event_logs(frame(spark, logs))
    tools, commands = {}, {}
    for r in got.tools.collect():
        tools.setdefault(r.session, []).append((r.tool, r.calls, r.in_tokens, r.out_tokens))
    for r in got.commands.collect():
        commands.setdefault(r.session, []).append(str([r.command, r.exit_code]))
    for r in got.sessions.collect():
        assert (r.input, r.output, r.model, r.prompt_tokens, sorted(tools.get(r.session, [])), sorted(commands.get(r.session, []))) == walked(logs[r.session]), r.session
        assert r.workspace == "/w" and str(r.created_at) == "2026-01-02 03:04:05"


def test_event_log_files_of_both_formats(spark, tmp_path):
    events = [
        {"noise": 1}, {"type": "session_meta", "payload": {"timestamp": "2026-01-02T03:04:05Z", "cwd": "/w", "model": "m"}}, "broken {",
        message("user_message", message="<environment_context>x</environment_context>"),
        message("user_message", message="# Context\n" + "y" * 1200 + "\n## My request for Codex:\nmend it\n## Context\nz"),
        call("apply_patch", "p1", patch="*** Begin Patch\n*** Update File: /w/a.py\n@@\n*** Add File: /w/b.py"),
        message("patch_apply_end", call_id="p1", changes={"/w/a.py": {"unified_diff": "d"}}), message("patch_apply_end", changes={"/w/c.py": {}}),
        message("mcp_tool_call_end", invocation={"server": "s", "tool": "look"}), {"type": "response_item", "payload": {"type": "reasoning", "summary": "hm"}},
        counted({"input_tokens": 9}, {"input_tokens": 20, "output_tokens": 6, "cached_input_tokens": 5, "reasoning_output_tokens": 9}),
    ]
    flat = [
        {"id": "x", "timestamp": "2026-02-03T00:00:00Z", "cwd": "/v"}, {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "  "}, {"type": "input_text", "text": "do this please"}, {"type": "text", "text": "not counted"}]},
        {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "and that"}, {"type": "image"}, {"type": "text", "text": "too, please"}]},
        {"type": "function_call", "name": "shell_command", "arguments": {"command": "ls"}, "call_id": "q"}, {"type": "function_call", "function": {"name": "look"}, "model": "m9"},
        {"type": "message", "role": "assistant", "usage": {"prompt_tokens": 10, "completion_tokens": 4, "output_tokens_details": {"reasoning_tokens": 3}, "inputTokensDetails": {"cachedTokens": 2, "cacheWriteTokens": 1}}, "id": "a1"},
        {"type": "message", "role": "assistant", "usage": {"prompt_tokens": 10}, "id": "a1"}, {"type": "reasoning", "text": "so"},
    ]
    folder = tmp_path / "2026" / "01"
    folder.mkdir(parents=True)
    for name, lines in (("rollout-2026-01-02T03-04-05-aa-bb-cc-dd-ee.jsonl", events), ("plain.jsonl", flat)):
        (folder / name).write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n\n")
    got = SOURCES.get("event_logs")(spark, str(tmp_path))
    s = {r.session: r for r in got.sessions.collect()}
    a, b = s["aa-bb-cc-dd-ee"], s["plain"]
    assert (a.format, a.input, a.output, a.cached, a.reasoning, a.model, a.task, a.prompt_tokens, a.workspace, a.reasonings) == ("events", 15, 6, 5, 6, "m", "mend it", 1, "/w", 1)
    assert (b.format, b.input, b.output, b.cached, b.reasoning, b.cache_write, b.model, b.task, b.prompt_tokens, b.workspace, b.reasonings) == ("flat", 8, 4, 2, 3, 1, "m9", "do this please", 3 + 2 + 2, "/v", 1)
    assert str(b.created_at) == "2026-02-03 00:00:00"
    assert sorted((r.session[0], r.tool, r.calls) for r in got.tools.collect()) == [("a", "apply_patch", 1), ("a", "look", 1), ("a", "patch", 1), ("p", "look", 1), ("p", "shell_command", 1)]
    assert sorted(r.file for r in got.files.collect()) == ["/w/a.py", "/w/b.py", "/w/c.py"]
    assert [r.command for r in got.commands.collect()] == ["ls"]


def test_places_in_split_files(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(json.dumps({"type": "turn_context", "payload": {"model": f"m{i}"}}) + "\n" for i in range(3000)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = importers.session_lines(spark, str(tmp_path), lambda f: F.lit("s"))
        assert lines.rdd.getNumPartitions() > 5
        assert [json.loads(r.line)["payload"]["model"] for r in lines.orderBy("place").collect()] == [f"m{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def chat(kind, at=None, **data):
    return {"type": kind, "data": data} | ({"timestamp": at} if at else {})


def test_chat_logs(spark, tmp_path):
    one = [
        chat("session.start", "2026-03-04T05:06:07Z", selectedModel="auto"), chat("user.message", content="Read and follow x.md"), chat("user.message", content="short"), chat("user.message", content=[{"text": "mend the parser"}, {"text": "and test it"}]),
        chat("assistant.message", messageId="1", outputTokens=11, toolRequests=[{"toolCallId": "t1", "name": "bash"}, {"name": "view"}]), chat("tool.execution_start", toolCallId="t1", toolName="bash", arguments={"command": "make"}),
        chat("tool.execution_start", toolName="bash", arguments={"command": "make"}), chat("command_result", command="make", exit_code=2, ok=False, error_signature="E1"), chat("command_result", command="other", code="1", ok=True),
        chat("tool.execution_complete", toolCallId="t1", toolTelemetry={"metrics": {"resultForLlmLength": 41}}, model="g"), chat("assistant.message", messageId="1", outputTokens=11), chat("assistant.message", messageId="2", outputTokens=5),
        chat("session.compaction_complete", compactionTokensUsed={"inputTokens": 100, "outputTokens": 7, "reasoningTokens": 9, "cacheReadTokens": 3}), chat("tool.execution_start", toolName="edit", arguments={"filePath": "/a"}), chat("file_revert", path="/b"),
        chat("test_result", test_id="x", passed=True), chat("test_result", test_id="y", passed=False), {"type": "session.model_change", "data": {"newModel": "h"}}, "nonsense",
    ]
    two = [chat("session.start", startTime="2026-03-05T00:00:00", selectedModel="k"), chat("assistant.message", outputTokens=50), chat("session.shutdown", modelMetrics={"k": {"usage": {"inputTokens": 4, "outputTokens": 2}}, "l": {"usage": {"cacheWriteTokens": 8}}})]
    for name, lines in (("one", one), ("two", two)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "events.jsonl").write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    got = SOURCES.get("chat_logs")(spark, str(tmp_path))
    a, b = sorted(got.sessions.collect(), key=lambda r: r.session)
    assert (a.task, a.prompt_tokens, a.input, a.output, a.reasoning, a.cached, a.compactions, a.errors, a.tests, a.tests_passed) == ("mend the parser and test it", 5 + 1 + 6, 100, 23, 9, 3, 1, 1, 2, 1)
    # the first answer had no model yet, the second one has the one that the call named
    assert sorted((r.model, r.output) for r in got.usage.where("session = 'one'").collect()) == [("auto", 11), ("g", 5), ("g", 7)] and a.model == "g" and str(a.created_at) == "2026-03-04 05:06:07"
    assert (b.input, b.output, b.cache_write, b.model, b.n_models) == (4, 2, 8, None, 2)
    assert sorted((r.tool, r.calls, r.in_tokens, r.out_tokens) for r in got.tools.collect()) == [("bash", 2, 5, 10), ("edit", 1, 0, 0)]
    assert sorted((r.command, r.exit_code or 0) for r in got.commands.collect()) == [("make", 0), ("make", 2), ("other", 1)]
    assert sorted(r.file for r in got.files.collect()) == ["/a", "/b"]


def test_parents_and_paths(spark):
    shown = ["C:\\Work\\x\\", "c://Work//x", "//a//b/", "/", "rel/x"]
    df = spark.createDataFrame([(p,) for p in shown], "p string")
    assert [r[0] for r in df.select(importers.plain_path(F.col("p"))).collect()] == ["C:/Work/x", "C:/Work/x", "/a/b", "/", "rel/x"]
    lines = [("t", 0, json.dumps({"type": "session.start", "timestamp": "2026-01-01T10:00:00Z"})), ("t", 1, json.dumps({"a": {"b": ['see "/W/p/src/a.py", and C:\\Q\\z.']}})), ("u", 0, json.dumps({"x": "/W/p/y"}))]
    paths = importers.transcript_paths(spark.createDataFrame(lines, "session string, place int, line string"))
    assert {(r.session, r.path) for r in paths.collect() if r.session == "t"} >= {("t", "/W/p/src/a.py"), ("t", "C:/Q/z")}
    parents = spark.createDataFrame([("p1", "2026-01-01 09:00:00", "/w"), ("p2", "2026-01-01 17:59:00", "/w/P/"), ("p3", "2026-01-01 18:01:00", "/w/p/src"), ("p4", "2026-01-01 12:00:00", "/w/p"), ("p5", "2026-01-01 10:00:00", "/w/pp")], "session string, at string, workspace string").withColumn("created_at", F.col("at").cast("timestamp"))
    assert [tuple(r) for r in importers.parents_of(paths, parents).collect()] == [("t", "p4", "/w/p")]  # u has no start, p3 began too late


def test_debug_days(spark):
    e = lambda i, kind, ts, file="main.jsonl", **a: ("s", file, i, json.dumps({"type": kind, "ts": ts, "spanId": i, "attrs": a}))
    day = 86_400_000
    rows = [e(1, "llm_request", day, model="m", inputTokens=5, outputTokens=2), ("s", "main.jsonl", 9, e(1, "llm_request", day, model="m", inputTokens=5)[3]), e(2, "llm_request", day + 5, "title.jsonl", model="n", inputTokens=1), e(3, "user_message", 2 * day, text="x" * 9), e(4, "llm_request", 2 * day + 1, model="m"), e(5, "tool_call", 3 * day, toolName="t"), e(6, "llm_request", -1, model="m", outputTokens=4)]
    got = importers.debug_days(spark.createDataFrame(rows, "session string, file string, place int, line string")).collect()
    assert sorted((str(r.day), r.requests, r.side_requests, r.input, r.output, r.prompt_tokens, r.model or "-") for r in got) == [("1970-01-02", 2, 1, 6, 2, 0, "-"), ("1970-01-03", 1, 0, 0, 0, 2, "m"), ("None", 1, 0, 0, 4, 0, "m")]


def test_empty_logs(spark):
    empty = spark.createDataFrame([], "session string, file string, place int, line string")
    for got in (*importers.event_logs(empty), *importers.chat_logs(empty), importers.debug_days(empty)):
        assert got.count() == 0
