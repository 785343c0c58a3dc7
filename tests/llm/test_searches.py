"""Annulus k-means and the impact-ordered search against brute force."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from tidewater.llm import centroids, queries, topk
from tidewater.llm.integers import LARGEST

NAN, INF = float("nan"), float("inf")


def whole(v):
    return [max(-LARGEST, min(LARGEST, math.floor(256 * x))) for x in v]


def taking_part(rows, length=None):
    return [(i, whole(v)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and (length is None or len(v) == length)]


def brute_clusters(rows, k, rounds, dimension):
    kept = taking_part(rows, dimension)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(members[j]) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centres)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {}
    for _, d, j in last:
        inertia[j] = inertia.get(j, 0) + d
    return sorted(str((i, j, d, inertia[j], sum(inertia.values()), centres[j])) for i, d, j in last)


def brute_top(rows, every, k):
    kept = taking_part(rows)
    out = []
    for q, v in {(i, tuple(v)) for i, v in kept if i is not None and i % every == 0}:
        score = [(-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in kept if i != q]
        out += [(q, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(score)[:k], 1)]
    return sorted(map(str, out))


def make(n, dimension, seed, ties=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dimension)) * rng.choice([0.01, 0.2, 1.0], (n, 1))
    if ties:
        x = np.round(x * 4) / 256
    x[: n // 3] = x[0]  # a third of all rows are one vector
    rows = [(int(i), [float(v) for v in x[i]]) for i in range(n)]
    odd = [(9001, None), (9002, [NAN] * dimension), (9003, [None] + [1.0] * (dimension - 1)), (9004, [INF] * dimension), (9005, [1.0]), (9006, []), (None, rows[5][1]), (rows[7][0], rows[7][1]), (rows[8][0], rows[9][1])]
    return rows + odd


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, x int").repartition(3)


@pytest.mark.parametrize("ties", [False, True])
def test_clusters_by_brute_force(spark, ties):
    rows = make(300, 8, 1, ties)
    got = centroids.cluster(frame(spark, rows), k=12, dimension=8, rounds=3).collect()
    assert sorted(str((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid)) for r in got) == brute_clusters(rows, 12, 3, 8)


def test_huge_components_and_few_vectors(spark):
    rows = [(1, [1e30, -1e300]), (2, [1e30, 0.0]), (3, [-0.001, 5.0]), (3, [-0.001, 5.0])]
    got = centroids.cluster(frame(spark, rows), k=12, dimension=2, rounds=2).collect()
    assert sorted(str((r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid)) for r in got) == brute_clusters(rows, 12, 2, 2)
    got = topk.top_k(frame(spark, rows), every=1, k=2)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_top(rows, 1, 2)


def test_annulus_leaves_far_norms_out():
    c = np.array([[1, 0], [100, 0], [0, 100], [10_000, 0]], dtype=np.int64)
    x = np.array([[99, 1], [60, 60], [10_000, 1], [0, 0]], dtype=np.int64)
    number, distance = centroids.Annulus(c).nearest(x, np.array([1, 2, 3, 0]))
    assert number.tolist() == [1, 1, 3, 0] and distance.tolist() == [2, 5200, 1, 1]  # equal distances: the smaller number


def test_empty_tables(spark):
    empty = frame(spark, make(30, 4, 1)).limit(0)
    assert centroids.cluster(empty).collect() == [] and topk.top_k(empty, 2).collect() == []
    assert topk.top_k(frame(spark, [(1, [1.0]), (3, [2.0])]), 2).collect() == []


@pytest.mark.parametrize(("n", "block", "wave", "ties"), [(400, 16_384, 2_048, False), (400, 100, 7, True), (900, 300, 40, False)])
def test_top_k_by_brute_force(spark, monkeypatch, n, block, wave, ties):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "WAVE", wave)
    rows = make(n, 8, n + block, ties)
    got = topk.top_k(frame(spark, rows), every=10, k=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute_top(rows, 10, 4)


def test_index_stops_on_proof():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(20_000, 16)) * 256).astype(np.int64)
    index = topk.Index(x)
    for q in (x[0], -x[1], np.r_[x[2][:3], np.zeros(13, np.int64)]):
        rows = index.best(q, 5, np.array([0]))
        score = x @ q
        score[0] = -(1 << 60)
        assert set(np.argsort(-score, kind="stable")[:5]) <= set(rows.tolist()) and 0 not in rows and len(rows) < 2_000
    assert len(index.best(np.zeros(16, np.int64), 5, np.array([], np.int64))) == len(x)


@pytest.mark.parametrize("name", ["op11_centroids", "op13_topk"])
def test_against_sql(spark, sf, name):
    duckdb.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    result = duckdb.execute(queries.SQL[name])
    names = [d[0] for d in result.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, result.fetchall()))
