import random

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.operators import deltas


@given(st.lists(st.integers(0, 30), max_size=60))
def test_rising_runs(values):
    got = deltas.rising(values)
    assert got == sorted(got) and all(values[a] < values[b] for a, b in zip(got, got[1:]))
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert len(got) == max(best, default=0)


def test_hunks_give_the_new_text(spark):
    rng, rows = random.Random(4), []
    for k in range(150):
        old = [rng.choice(["a", "b", "", f"line {rng.randrange(40)}"]) for _ in range(rng.randrange(0, 40))]
        new = list(old)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = [f"new {rng.randrange(9)}" for _ in range(rng.randrange(3))]
        if rng.random() < 0.2:
            rng.shuffle(new)
        rows.append((k, old, new))
    got = deltas.line_hunks(spark.createDataFrame(rows, "k int, o array<string>, n array<string>"), "k", "o", "n").withColumn("again", deltas.applied(F.col("old"), F.col("hunks"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.again == r.new, r.k
        for h in r.hunks:
            assert h["lines"] == r.new[h["start"] - 1 : h["start"] - 1 + len(h["lines"])]
            assert not h["lines"] or not h["gone"] or h["lines"][0] != r.old[h["at"] - 1]  # nothing equal is left at a hunk's beginning
    assert all(not r.hunks for r in got if r.old == r.new)


def test_deltas(spark):
    text = [f"line number {i} of a long file" for i in range(200)]
    changed = [*text[:50], "changed", *text[51:120], *text[125:]]
    other = ["all", "else"] * 1500
    rows = [(1, 1, "\n".join(text)), (1, 2, "\n".join(changed)), (1, 3, "\n".join(changed)), (1, 4, "\n".join(other)), (1, 5, None), (2, 1, "short\ntext"), (2, 2, "short\ntexts")]
    got = {(r.f, r.t): r for r in deltas.deltas(spark.createDataFrame(rows, "f int, t int, x string"), ["f"], "t", "x").collect()}
    assert set(got) == {(1, 2), (1, 4), (2, 2)} and got[1, 4].delta is None and got[2, 2].delta is None
    assert [(h["at"], h["gone"], h["lines"]) for h in got[1, 2].hunks] == [(51, 1, ["changed"]), (121, 5, [])]
    assert got[1, 2].delta.startswith(f"[delta] 1 ({len(rows[1][2])} chars)") and got[1, 2].delta.endswith("@@ -121,5 +121,0 @@\n" + "\n".join("-" + x for x in text[120:125]))
