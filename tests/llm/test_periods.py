import hashlib
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from tidewater.llm import periods, queries


def brute(words):
    """(start, end, smallest period) of all runs by looking at every period."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        s = 0
        while s + p < n:
            e = s
            while e + p < n and words[e] == words[e + p]:
                e += 1
            if e > s and e + p - s >= max(12, 2 * p):
                found.setdefault((s, e + p), p)
            s = e + 1
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def runs(*texts):
    ids = {}
    coded = [[ids.setdefault(w, len(ids)) for w in t] for t in texts]
    flat = np.array([i for t in coded for i in t], dtype=np.int64)
    return periods.runs_of(flat, np.cumsum([0, *map(len, coded)]))


def planted(rng, n):
    words = [rng.choice("abcdefg" if rng.random() < 0.5 else "ab") for _ in range(n)]
    for _ in range(rng.randrange(4)):
        a, p, k = rng.randrange(n), rng.randrange(1, 12), rng.randrange(2, 40)
        unit = [rng.choice("abc") for _ in range(p)]
        words[a : a + k] = (unit * k)[:k]
    return words


def test_runs_by_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        texts = [planted(rng, rng.randrange(1, 160)) for _ in range(rng.randrange(1, 6))]
        assert runs(*texts) == [brute(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=70), st.lists(st.sampled_from("abc"), max_size=70))
def test_runs_of_few_words(a, b):
    assert runs(a, [], b) == [brute(a), [], brute(b)]


def test_special_words():
    for n in (11, 12, 13, 23, 24, 25, 200):
        assert runs(["x"] * n) == [brute(["x"] * n)]
    f = ["a", "ab"]
    while len(f[-1]) < 300:
        f.append(f[-1] + f[-2])
    assert runs(list(f[-1])) == [brute(list(f[-1]))]  # Fibonacci words are rich in runs
    t = ["ab"[bin(i).count("1") % 2] for i in range(256)]
    assert runs(t) == [brute(t)]
    distinct = [str(i) for i in range(500)]
    assert runs(distinct + distinct, distinct) == [[(0, 1000, 500)], []]


def test_z_function():
    assert periods.z_function(list("aabaaab")) == [7, 1, 0, 2, 3, 1, 0]


def test_operator_on_odd_texts(spark):
    long = ("lorem ipsum dolor " * 70_000).strip()
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 6), (4, "a b " * 6), (None, "x\x0b" * 12), (5, "A b " + "a b " * 12), (6, long)]
    df = spark.createDataFrame([(i, t, "e", 1) for i, t in rows], "doc_id long, text string, runs string, id int")
    got = {(r.id, r.n_words): ([tuple(x) for x in r.runs], r.collapsed) for r in periods.periodic_runs(df).collect()}
    assert got[1, 0] == got[2, 0] == got[3, 0] == ([], "")
    assert got[4, 12] == ([(0, 12, 2)], "a b") and got[None, 12] == ([(0, 12, 1)], "x")
    assert got[5, 14] == ([(2, 12, 1)], "A b a b")
    assert got[6, 210_000] == ([(0, 210_000, 3)], "lorem ipsum dolor")
    assert periods.periodic_runs(df).count() == len(rows) and periods.periodic_runs(df.limit(0)).collect() == []


def test_query_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(9_000 + i, t) for i, t in enumerate([None, "", "one", " a  b "] * 12)], "doc_id long, text string"))
    expected = []
    for r in docs.collect():
        words = (r.text or "").encode().split()
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        found = brute(words)
        best = min(((s - e, s, p) for s, e, p in found), default=None)
        gone = {i for s, e, p in found for i in range(s + p, e)}
        told = "".join(f"{s},{e - s},{p}\n" for s, e, p in found)
        expected.append((r.doc_id, len(found), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()))
    got = queries.run_digest(periods.periodic_runs(queries.with_periods(docs)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected))
    assert sum(e[1] > 0 for e in expected) >= 10
