"""Banded MinHash against the rule taken row by row."""

import hashlib
import random
import re

import pytest

from tidewater.operators import minhash
from tidewater.sources.tables import table


def plain_signature(tokens):
    rng = random.Random(1)
    a = [rng.randint(1, minhash.PRIME) for _ in range(128)]
    b = [rng.randint(0, minhash.PRIME) for _ in range(128)]
    hashes = [int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "little") for t in tokens]
    return [min(((x * h + y) % minhash.PRIME & minhash.MASK for h in hashes), default=minhash.MASK) for x, y in zip(a, b)]


def walked(rows):
    """(scope, rank) of what stays, scope by scope in rank order."""
    kept, out = {}, []
    for scope, rank, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        tokens = set(re.findall(r"[a-z0-9]+", (text or "").lower()))
        if len(tokens) >= 5:
            s = plain_signature(tokens)
            if any(sum(x == y for x, y in zip(s, k)) >= 96 for k in kept.get(scope, [])):
                continue
            kept.setdefault(scope, []).append(s)
        out.append((scope, rank))
    return sorted(out, key=str)


def test_signatures():
    texts = ["", None, "one", "The quick brown fox, 3 times", " ".join(map(str, range(20_000)))]
    got, sizes = minhash.signatures(texts)
    assert sizes.tolist() == [0, 0, 1, 6, 20_000]
    for row, text in zip(got.tolist(), texts):
        assert row == plain_signature(set(re.findall(r"[a-z0-9]+", (text or "").lower())))


def chains(seed, n):
    """Texts that drift: neighbours are alike, ends are not; and groups of copies."""
    rng, rows = random.Random(seed), []
    words = [f"w{i}" for i in range(400)]
    for scope in range(3):
        now = rng.sample(words, 40)
        for rank in range(n):
            for _ in range(rng.choice([0, 0, 1, 3, 8])):
                now[rng.randrange(40)] = rng.choice(words)
            if rng.random() < 0.05:
                now = rng.sample(words, 40)
            text = " ".join(now if rng.random() < 0.9 else now[:4])
            rows.append((scope, rank, text))
    return rows + [(0, 5000, None), (0, 5001, ""), (1, 5002, "A b C d e"), (1, 5003, "e D c b a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_rule_by_rule(spark, seed):
    rows = chains(seed, 120)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame([(s, r, t, "x") for s, r, t in rows], "s long, r long, t string, signature string").repartition(5)
    assert sorted((tuple(r) for r in minhash.keep_first(df, "r", "t", ["s"]).collect()), key=str) == walked(rows)
    assert minhash.keep_first(df.limit(0), "r", "t", ["s"]).count() == 0


def test_unlike_rows_that_meet_are_not_compared(spark, monkeypatch):
    met, compare = [], minhash._conflicts
    monkeypatch.setattr(minhash, "_conflicts", lambda pairs, sig: met.append(pairs.count()) or compare(pairs, sig))
    rng = random.Random(5)
    rows = [(i, " ".join([f"w{j}" for j in range(8)] + [f"v{rng.randrange(150)}" for _ in range(25)])) for i in range(60)]
    assert minhash.keep_first(spark.createDataFrame(rows, "r long, t string"), "r", "t").count() == 60
    assert sum(met) < 60  # of 1,770 pairs


def test_whole_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(0, r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = minhash.minhash_documents(spark, sf).collect()
    expected = walked(rows)
    assert sorted(r.doc_id for r in got) == sorted(r for _, r in expected)
    assert len(expected) < len(rows)
