import random

import numpy as np

from tidewater.operators import leaders
from tidewater.sources.tables import table


def walked(rows, near):
    """One row after the other: (id, leader)."""
    found, out = [], []
    unit = lambda v: None if v is None or None in v or not len(v) or not np.isfinite(v).all() or not np.any(v) else np.array(v) / np.linalg.norm(v)
    for i, domain, at, fingerprint, vector in sorted(rows, key=lambda r: (r[2], r[0])):
        u = unit(vector)
        for li, ld, lf, lu in found:
            if ld == domain and (lf == fingerprint if u is None or lu is None else len(u) == len(lu) and u @ lu >= near):
                out.append((i, li))
                break
        else:
            found.append((i, domain, fingerprint, u))
            out.append((i, i))
    return sorted(out)


def test_one_after_the_other(spark, monkeypatch):
    monkeypatch.setattr(leaders, "ROUND", 40)
    rng, gen = random.Random(8), np.random.default_rng(8)
    centres, rows = gen.normal(size=(60, 6)), []
    for i in range(500):
        v = centres[rng.randrange(60)] + gen.normal(size=6) * rng.choice([0.05, 0.3, 0.8])
        vector = rng.choice([None, [], [0.0] * 6, [float("nan")] * 6, [None] * 6, [1.0, 2.0]]) if rng.random() < 0.15 else [float(x) for x in v]
        rows.append((i, rng.choice(["a", "b", None]), rng.randrange(200), f"f{rng.randrange(25)}", vector))
    df = spark.createDataFrame(rows, "id long, domain string, at long, fingerprint string, vector array<double>").repartition(4)
    got = leaders.leader_clusters(df)
    assert sorted((r.id, r.leader) for r in got.collect()) == walked(rows, leaders.NEAR)
    assert leaders.leader_clusters(df.limit(0)).count() == 0
    sizes = {}
    for i, leader in walked(rows, leaders.NEAR):
        sizes.setdefault(leader, []).append(i)
    time = {r[0]: r[2] for r in rows}
    expected = sorted((k, len(v), sorted(sorted(v, key=lambda i: (time[i], i))[-8:])) for k, v in sizes.items() if len(v) >= 3)
    assert sorted((r.leader, r.n, r.evidence) for r in leaders.candidates(got).collect()) == expected and any(n > 8 for _, n, _ in expected)


def test_query(spark, sf="/root/testdata/sf0.001"):
    e = table(spark, sf, "embeddings").collect()
    clusters = {}
    for i, leader in walked([(r.vec_id, str(r.label % 2), r.vec_id, f"label {r.label}", None if r.vec_id % 7 == 0 else [float(x) for x in r.embedding]) for r in e], 0.5):
        clusters.setdefault(leader, []).append(i)
    got = leaders.lesson_leaders(spark, sf).collect()
    assert sorted((r.leader, r.n, r.evidence) for r in got) == sorted((k, len(v), v[-8:]) for k, v in clusters.items() if len(v) >= 3)
    assert got


def test_blocks_decide_as_single_products(spark, monkeypatch):
    """Rows of one task and one round meet leaders in blocks, some of them exactly at the limit; before, each met them one by one."""
    monkeypatch.setattr(leaders, "BLOCK", 7)
    gen = np.random.default_rng(3)
    base = np.array([[1.0, 0, 0, 0], [3.0, 4.0, 0, 0], [0, 0, 3.0, 4.0], [0.6, 0, 0.8, 0], [1.0, 1, 1, 1]])
    rows = [(i, "d", i, f"f{i % 9}", None if i % 11 == 0 else [float(x) for x in base[gen.integers(5)] * gen.choice([1.0, 2.0, -1.0]) + gen.choice([0.0, 1e-10, 0.4]) * gen.normal(size=4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, domain string, at long, fingerprint string, vector array<double>")
    assert sorted((r.id, r.leader) for r in leaders.leader_clusters(df, near=0.6).collect()) == walked(rows, 0.6)
    one, many = leaders.Leaders(0.6), [(d, f, leaders._unit(v)) for _, d, _, f, v in rows]
    for number, row in enumerate(many[:100]):
        one.add(number, *row)
    assert one.first(many).tolist() == [one.first([r])[0] for r in many]
