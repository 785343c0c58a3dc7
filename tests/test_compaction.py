import re
import json

from pyspark.sql import functions as F

from tidewater.operators import compaction
from tidewater.operators.compaction import bounded_line, community, fold_recurring, pruned_lines, recall_sections
from tidewater.sources.hosts import commits_since, ignore_regex, not_ignored, read_transcripts


def test_pruning_keeps_keystones_and_dense_lines(spark):
    text = "a a a a a a\nreturn x\nalpha beta gamma delta epsilon zeta\n\nnever"  # 15 tokens
    rows = [(1, i, line) for i, line in enumerate(text.split("\n"))] + [(2, 0, "")]
    lines = spark.createDataFrame(rows, "k long, p long, line string")
    kept = lambda share: sorted((r.k, r.p) for r in pruned_lines(lines, "k", "p", "line", share).collect())
    assert kept(1.0) == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    assert kept(0.6) == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 0)]
    assert [p for k, p in kept(0.0) if k == 1] == [1, 4]


def test_recurring_messages_fold(spark):
    lines = [(1, i, f"info: sent {i} bytes") for i in range(9)] + [(1, 20, "plain"), (1, 21, None), (2, 1, "info: sent 4 bytes")] + [(3, i, "info: failed") for i in range(9)]
    got = fold_recurring(spark.createDataFrame(lines, "k long, p long, line string"), "k", "p", "line").collect()
    kept = {(r.k, r.p): r.line for r in got if r.k < 3}
    assert kept == {(1, 0): "info: sent 0 bytes", (1, 1): "... (message recurred 7 intermediate times) ...", (1, 8): "info: sent 8 bytes", (1, 20): "plain", (1, 21): None, (2, 1): "info: sent 4 bytes"}
    assert sum(r.k == 3 for r in got) == 9


def test_small_columns(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(bounded_line(F.lit("x" * 800), 10)) == "x" * 800
    assert one(bounded_line(F.lit("x" * 801), 10)).startswith("x" * 463 + " [... 98 chars omitted; sha256=")
    assert [one(community(F.lit(p))) for p in ("a.py", "src/x/a.py", "tests/x/a.py", "tests/a.py")] == ["root", "src", "tests/x", "tests"]


def test_sections_under_a_budget(spark):
    df = lambda *rows: spark.createDataFrame([(1, i, t) for i, t in rows], "s long, at long, text string")
    got = recall_sections([("definition", df((1, "x" * 400))), ("traces", df((1, "old"), (2, "new")))], "s", budget=10)
    assert [(r.section, r.place) for r in got.collect()] == [("definition", 1)]
    got = recall_sections([("definition", df((1, "x"))), ("traces", df((1, "old"), (2, "new")))], "s", most=1)
    assert sorted((r.section, r.text) for r in got.collect()) == [("definition", "x"), ("traces", "new")]


def test_transcripts(spark, tmp_path):
    u = {"input_tokens": 1, "output_tokens": 2}
    line = lambda **k: json.dumps({"sessionId": "s", "type": "assistant", **k})
    (tmp_path / "subagents").mkdir()
    (tmp_path / "a.jsonl").write_text("\n".join([
        line(uuid="u1", type="user", timestamp="2024-01-01T00:00:00Z", message={"role": "user", "content": "hello"}),
        line(timestamp="2024-01-01T00:00:01Z", message={"id": "m", "role": "assistant", "model": "x", "content": [{"type": "text", "text": "one"}], "usage": u}),
        line(timestamp="2024-01-01T00:00:02Z", message={"id": "m", "role": "assistant", "model": "x", "content": [{"type": "tool_use", "id": "t", "name": "run"}], "usage": {**u, "output_tokens": 9}}),
        line(isMeta=True, message={"role": "user", "content": "no"}), "{broken", ""]))
    (tmp_path / "subagents" / "b.jsonl").write_text(line(uuid="u2", isSidechain=True, timestamp="2024-01-01T00:00:03Z", message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t", "is_error": True}]}))
    got = {r.message: r for r in read_transcripts(spark, str(tmp_path)).collect()}
    assert set(got) == {"u1", "m", "u2"} and got["u1"].text == "hello"
    assert (got["m"].text, got["m"].tools, got["m"].output_tokens) == ("one", ["run"], 9)
    assert (got["u2"].errors, got["u2"].subagent) == (1, True)


def test_ignore_rules(spark):
    paths = ["a.log", "x/a.log", "keep.log", "build/o.txt", "src/build/o.txt", "docs/a/b.md", "n1.py", "src/build"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    left = [r.path for r in not_ignored(df, "path", ["*.log", "!keep.log", "/build/", "docs/**", "n[0-9].py", "", "# c"]).collect()]
    assert left == ["keep.log", "src/build/o.txt", "src/build"] and ignore_regex("# c") is None


def test_commits(spark):
    rows = [("a", 1, 0, 1, "m", None), ("b", 2, 1, 1, "m", "x"), ("c", 3, 2, 0, "m", "x"), ("d", 4, 1, 99, None, "x"), ("e", 5, 1, 99, "[lineage:keep]", "x"), ("f", 6, 1, 1, "m", "renovate[bot]@x"), ("g", 7, 2, 3, "m", "x")]
    df = spark.createDataFrame(rows, "sha string, at long, parents long, files long, message string, email string")
    assert [r.sha for r in commits_since(df, 5).collect()] == ["g", "e", "b"]
    assert [r.sha for r in commits_since(df, 5, "b").collect()] == ["g", "e"] and [r.sha for r in commits_since(df, 1, "none").collect()] == ["g"]


def test_signals_shuffle_lines_only(spark, monkeypatch):
    """Tokens of a line are counted where the line lies: one exchange, of lines, and the same figures as by counting."""
    import math
    from collections import Counter

    lines = ["a b a 1 1 1 (x)", "", None, "  ", "one", "é é _a", "b " * 3000 + "c"]
    df = spark.createDataFrame(list(enumerate(lines)), "k long, line string")
    monkeypatch.setattr(compaction, "TASK_BYTES", 1_000)
    got = compaction.line_signals_of(df, ["k"], "line")
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    expected = {}
    for k, text in enumerate(lines):
        if found := re.findall(compaction.LINE_TOKENS, text or ""):
            c, n = Counter(found), len(found)
            entropy, mean = math.log2(n) - sum(v * math.log2(v) for v in c.values()) / n, sum(map(math.log2, c.values())) / len(c)
            expected[k] = (n, round((entropy + math.log2(n) - mean + math.log2(n + 1)) * math.log2(n + 2), 9))
    assert {r.k: (r.n, round(r.signal, 9)) for r in got.collect()} == expected
