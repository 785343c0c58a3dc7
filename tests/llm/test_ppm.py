import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewater.llm import ppm


def slow_ppm(training, order=4):
    """Counts by context, and a function for the log10 probability of a text."""
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for text in training:
        data = bytes([255] * order) + text.encode().lower() + b"\xff"
        for i in range(order, len(data)):
            for k in range(order + 1):
                counts[k][data[i - k : i]][data[i]] += 1

    def score(text):
        data = bytes([255] * order) + text.encode().lower() + b"\xff"
        total = 0.0
        for i in range(order, len(data)):
            excluded, p = set(), 1.0
            for k in range(order, -1, -1):
                here = counts[k].get(data[i - k : i])
                if not here:
                    continue
                left = {s: c for s, c in here.items() if s not in excluded}
                if not left:
                    continue
                den = sum(left.values()) + len(left)
                if data[i] in left:
                    p *= left[data[i]] / den
                    break
                p *= len(left) / den
                excluded |= set(here)
            else:
                p /= 257 - len(counts[0][b""]) if counts[0] else 257
            total += math.log10(p)
        return total

    return score


def brute(rows, modulus=7, rest=2):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % modulus == rest
    training = [t or "" for i, t in rows if not held(i)]
    tokens = lambda t: [*t.encode().lower().split(), "end"]
    c = Counter(w for t in training for w in tokens(t))
    n, v = sum(c.values()), len(c)
    score = slow_ppm(training)
    out = []
    for i, t in rows:
        w = tokens(t or "")
        out.append((i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 6), round(score(t or ""), 6)))
    return sorted(out, key=str)


def test_score_against_brute_force(spark):
    rng = random.Random(3)
    words = ["The", "the", "cat", "Überall", "éa", "x", "un", "known\x85", "12"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 30))) + rng.choice(["", "\n", " zz" + str(i)])) for i in range(150)]
    rows += [(900, None), (901, ""), (7, "repeated"), (7, "repeated"), (None, "no id \U0001f600")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    from tidewater.llm.queries import score_documents

    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_documents(df).collect()), key=str)
    assert got == brute(rows)


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.score(df, df.where("false")).collect()}
    assert abs(got[1].score - 3 * math.log10(1 / 257)) < 1e-9 and got[1].n_known == 0 and got[1].train_tokens == 0
    assert got[2].n_tokens == 1 and got[1].base_score == 0
    assert ppm.score(df.where("false"), df).collect() == []


def test_rare_grams_of_a_large_corpus_count(spark):
    rng = random.Random(5)
    # more than 2**21 bytes, with words and letters that occur once or twice in all
    training = [" ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=6000)) for _ in range(110)]
    training += [f"zephyr{i} qu{chr(0x4E00 + i)}x " + "".join(rng.choices("bcdfghjklm", k=12)) for i in range(200)]
    assert sum(len(t.encode()) for t in training) > 1 << 21
    asked = [*training[-200::20], "the zephyr9 quux", "bcdf cat \u4e07", "\u0416\u0416", ""]
    train = spark.createDataFrame([(t,) for t in training], "text string").repartition(4)
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id int, text string")
    score = slow_ppm(training)
    for settings in ({}, {"most": 40}):
        got = {r.doc_id: r.score for r in ppm.score(docs, train, **settings).collect()}
        assert all(abs(got[i] - score(t)) < 1e-6 for i, t in enumerate(asked)) and len(got) == len(asked)


def test_long_texts_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["a", "été", "the", "Token", "x" * 70, "中文"]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), n)) for n in (0, 3, 40, 200, 1)] + [None, "", "y" * 500, "z\n" * 90]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = {r.doc_id: r for r in ppm.score(df, df.where("doc_id % 2 = 0"), most=50).collect()}
    monkeypatch.setattr(ppm, "PIECE", 64)
    cut = {r.doc_id: r for r in ppm.score(df, df.where("doc_id % 2 = 0"), most=50).collect()}
    assert len(cut) == len(texts)
    for i, r in whole.items():
        assert tuple(cut[i])[:4] == tuple(r)[:4] and cut[i].base_score == pytest.approx(r.base_score, abs=1e-9) and cut[i].score == pytest.approx(r.score, abs=1e-9)


def test_pieces_hold_every_gram_once():
    data = np.frombuffer(("ab cd " * 30 + "e" * 50 + " f").encode(), np.uint8)
    offsets = np.array([0, 10, len(data)])
    whole = np.concatenate([p[4] for p in ppm.pieces(data, offsets, limit=10**6)])
    for limit in (1, 5, 33, 100):
        cut = list(ppm.pieces(data, offsets, limit=limit))
        assert np.array_equal(np.concatenate([p[4] for p in cut]), whole) and sum(p[6] * (p[1] - p[0]) for p in cut) == 2
        assert all(len(p[2]) <= max(limit, 52) for p in cut)
