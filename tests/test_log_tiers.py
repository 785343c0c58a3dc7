"""Folding of outputs against walks through the lines."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.operators import log_tiers
from tidewater.operators.compaction import DIAGNOSTICS


def frame(spark, texts):
    rows = [(k, 3 * i, line) for k, lines in texts.items() for i, line in enumerate(lines)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, "k string, p long, line string")


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.n)):
        assert r.n == len(out.setdefault(r.k, [])) + 1
        out[r.k].append(r.line)
    return out


def shorter(before, after):
    return after if len("\n".join(after)) < len("\n".join(before)) else before


def walked_blocks(lines):
    out, i = [], 0
    while i < len(lines):
        for w in range(2, 7):
            block = lines[i : i + w]
            times = 1
            while len(block) == w and lines[i + times * w : i + (times + 1) * w] == block:
                times += 1
            if times >= 3 and not any(re.search(DIAGNOSTICS, x, re.I) for x in block):
                out += [*block, f"... ({times - 1} repeated {w}-line blocks; {(times - 1) * w} lines omitted) ..."]
                i += w * times
                break
        else:
            out.append(lines[i])
            i += 1
    return shorter(lines, out)


def test_blocks_by_walking(spark):
    rng, texts = random.Random(11), {}
    for i in range(120):
        lines = []
        while len(lines) < rng.randrange(5, 60):
            unit = [rng.choice(["alpha line of some length", "beta line of some length", "gamma", "it failed", ""]) for _ in range(rng.randrange(1, 8))]
            lines += unit * rng.choice([1, 1, 2, 3, 4, 7])
        texts[f"t{i}"] = lines
    texts["same"] = ["one and the same line"] * 57
    texts["pairs then triples"] = ["a" * 30, "b" * 30] * 5 + ["a" * 30, "b" * 30, "c" * 30] * 4 + ["c" * 30] * 9
    got = result(log_tiers.fold_blocks(frame(spark, texts), "k", "p", "line"))
    assert got == {k: walked_blocks(v) for k, v in texts.items()}
    assert sum(got[k] != v for k, v in texts.items()) > 30


def test_blocks_of_few_different_lines(spark):
    texts = {}

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.sampled_from(["x" * 40, "y" * 40]), min_size=1, max_size=40))
    def gather(lines):
        texts[f"h{len(texts)}"] = lines

    gather()
    assert result(log_tiers.fold_blocks(frame(spark, texts), "k", "p", "line")) == {k: walked_blocks(v) for k, v in texts.items()}


def test_progress(spark):
    build = [f"[{i}] Compiling unit {i} of the project" for i in range(9)]
    texts = {"a": ["start", *build, "Linking x"], "b": build[:7], "c": [*build[:4], "compiling failed", *build[4:]], "d": [*build, *(f"linking {i}" for i in range(8))]}
    got = result(log_tiers.fold_progress(frame(spark, texts), "k", "p", "line"))
    note = "... (5 compiling progress lines omitted) ..."
    assert got["a"] == ["start", *build[:2], note, *build[-2:], "Linking x"] and got["b"] == texts["b"] and got["c"] == texts["c"]
    assert got["d"] == [*build[:2], note, *build[-2:], "linking 0", "linking 1", "... (4 linking progress lines omitted) ...", "linking 6", "linking 7"]


def test_tables(spark):
    rows = [f"{i} | name{i} | {i * i}" for i in range(40)]
    texts = {"pipes": ["a | b | c", "---|---|---", *rows], "short": rows[:31], "bad": [*rows, "error"], "mixed": [*rows[:20], *(f"prose {i}" for i in range(20))], "gaps": [f"{i}   x  y   z" for i in range(40)], "tie": [*(f"a|b|{i}" for i in range(30)), *(f"a\tb\t{i}" for i in range(10))]}
    got = result(log_tiers.sample_tables(frame(spark, texts), "k", "p", "line", 200))
    assert got["pipes"] == [*texts["pipes"][:10], "... (26 table rows omitted; shape=3 cols) ...", *rows[-6:]]
    assert got["gaps"][10] == "... (24 table rows omitted; shape=4 cols) ..." and len(got["gaps"]) == 17 and len(got["tie"]) == 17
    assert all(got[k] == texts[k] for k in ("short", "bad", "mixed"))


def test_records(spark):
    rows = [f'{{"number": {i}, "text": "value of the row"}}' for i in range(30)]
    texts = {"a": [*rows[:10], "", '{"x": "timed out"}', *rows[10:]], "b": rows[:23], "c": [*rows, "{broken"], "d": [*rows, "17"], "e": ['{"error": 1}'] * 45}
    got = result(log_tiers.sample_records(frame(spark, texts), "k", "p", "line", 300))
    assert got["a"] == ["... (25 NDJSON records omitted; 6/31 shown) ...", *rows[:3], '{"x": "timed out"}', *rows[-2:]]
    assert all(got[k] == texts[k] for k in "bcde")


def test_empty_output(spark):
    empty = frame(spark, {"a": ["x"]}).limit(0)
    for f in (log_tiers.fold_blocks, log_tiers.fold_progress):
        assert f(empty, "k", "p", "line").count() == 0
    for f in (log_tiers.sample_tables, log_tiers.sample_records):
        assert f(empty, "k", "p", "line", 10).count() == 0
