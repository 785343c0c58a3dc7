import random

import duckdb
import pandas as pd

from tidewater.llm import mixing
from tidewater.llm.queries import OP8_SQL


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def targets_by_rounds(sizes):
    """Targets by sharing again and again until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_targets_and_sampling(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["b", "a", "é", "Z", None, "tiny" if i % 40 == 0 else "b"]), "x") for i in range(1500)]
    rows += [(5000, None, "a", "x"), (5001, "", "empty", None), (None, "no id here", "a", "x"), (7, "again", "a", "x")]
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    expected = targets_by_rounds(sizes)
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    taken = {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6
        assert 0 <= r.times <= 3
        taken[r.source] = taken.get(r.source, 0) + r.times * r.size
    for s, t in expected.items():
        assert abs(taken[s] - t) <= 3 * 60
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) or sorted((str(r.id), r.size, r.times) for r in out if r.id != 7) == sorted((str(r.id), r.size, r.times) for r in again if r.id != 7)


def test_against_sql(spark):
    rng = random.Random(2)
    rows = [(i, "\t".join(["w"] * rng.randrange(0, 30)), rng.choice(["b", "a", None]), "x") for i in range(400)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "size"])  # noqa: F841
    expected = duckdb.sql(OP8_SQL).fetchall()
    got = [(r.id, r.size, r.source_size, r.target, r.size * r.times) for r in mixing.mix(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(expected)


def test_hot_size_and_empty_table(spark):
    rows = [(i, "a b c", "s", "x") for i in range(3000)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert sum(r.times for r in out) == 3000
    assert mixing.mix(frame(spark, [])).collect() == []


def test_hot_sizes_keep_the_order_of_ids(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(-9000, 9000) if i % 100 else None, " ".join(["w"] * rng.choice([2, 2, 2, 3])), rng.choice(["b", "a", None]), "x") for i in range(3000)]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "source", "size"]).astype({"doc_id": "Int64"})  # noqa: F841
    expected = duckdb.sql(OP8_SQL).fetchall()
    got = [(r.id, r.size, r.source_size, r.target, r.size * r.times) for r in mixing.mix(frame(spark, rows)).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    # rows of one id, source and size stand next to each other in either order
    assert sorted(got, key=order) == sorted(expected, key=order)
