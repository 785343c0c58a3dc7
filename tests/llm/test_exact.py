import hashlib
import random
from collections import defaultdict

import numpy as np

from tidewater.llm import exact
from tidewater.llm.exact import build_fuse_filter, probe_fuse_filter


def ascii_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_filter_has_no_false_negatives_and_few_false_positives():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(-(2**63), 2**63 - 1, n)
        data = build_fuse_filter(np.r_[keys, keys[:5]])
        assert probe_fuse_filter(data, keys).all()
        assert probe_fuse_filter(data, rng.integers(-(2**63), 2**63 - 1, 20_000)).mean() < 0.01
        assert len(data) < 1.3 * n + 300


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[ascii_lower(t or "")].append(i)
    out = []
    for i, t in rows:
        ids = groups[ascii_lower(t or "")]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(ascii_lower(t or "").encode()).hexdigest(), sum(x == keep for x in ids)))
    return sorted(map(str, out))


def run(spark, rows, **settings):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, keep_id int, digest string")
    got = exact.exact_dedup(df, **settings).collect()
    return sorted(str((r.id, r.keep_id, r.group_size, r.kept, bytes(r.digest).hex(), r.keep_rows)) for r in got)


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["Alpha", "alpha", "ÄLPHA", "älpha", "", None, "x" * 5000, "X" * 5000, "a b", "a  b"]
    rows = [(i, rng.choice(texts) if i % 3 else f"own {i}") for i in range(300)] + [(5, "Alpha"), (5, "Alpha"), (None, "alpha"), (None, "only null"), (None, "only null")]
    expected = brute(rows)
    for share in (0.0, 0.5, 1.0):
        assert run(spark, rows, snapshot_share=share) == expected


def test_empty(spark):
    assert run(spark, []) == []


def test_a_snapshot_is_kept_and_screens_a_later_batch(spark, tmp_path):
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    exact.Snapshot.write(exact.digests(table([(i, f"text {i}") for i in range(3000)])), f"file://{tmp_path}/s")
    stored = exact.Snapshot(spark, f"file://{tmp_path}/s")
    batch = exact._grouped(exact.digests(table([(i, f"TEXT {i}") for i in range(2900, 3900)])))
    found = {r.keep_id: r.maybe for r in exact.screen(batch, stored).collect()}
    assert all(found[i] for i in range(2900, 3000)) and sum(found.values()) < 130


def test_a_batch_far_larger_than_the_snapshot_is_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "BUCKET_KEYS", 40)
    rows = [(i, f"text {i % 700}") for i in range(1000)]
    for share in (0.0, 0.05, 0.6):
        assert run(spark, rows, snapshot_share=share) == brute(rows)


def test_bytes_are_compared(spark, monkeypatch):
    rows = [(1, "one"), (2, "ONE"), (3, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    digest = exact.digests(docs).where("id = 1").select("digest")
    for limit in (0, 100):
        monkeypatch.setattr(exact, "BROADCAST_KEYS", limit)
        exact.check_bytes(docs, digest.selectExpr("digest", "1L AS keep_id", "2L AS old_id"), "doc_id", "text")
    rows = [(b"a", b"one"), (b"a", b"one"), (b"b", b"one"), (b"b", b"two")]
    found = exact.differing_bytes(spark.createDataFrame(rows, "digest binary, data binary")).collect()
    assert [bytes(r.digest) for r in found] == [b"b"]
