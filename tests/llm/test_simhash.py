import random
import re

import numpy as np
import xxhash

from tidewater.llm import simhash


def slow_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    for text in ("", " \t\n", "one", "A b C", "a b c d", "a  b\x0bc d é\x85f G h i j k a b c d", "\x1ca b \x1dc"):
        assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_trie_links_are_all_pairs_within_budget():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) for b in base for _ in range(12)}
    prints = np.array(sorted(prints & ((1 << 64) - 1) for prints in prints), dtype=np.uint64)
    got = {(int(i), int(j)) for a, b in simhash.trie_links(prints, np.zeros(len(prints), int)) for i, j in zip(a, b)}
    assert got == {(i, j) for j in range(len(prints)) for i in range(j) if int(prints[i] ^ prints[j]).bit_count() <= 4}


def test_block_choices_find_every_pair():
    rng = random.Random(6)
    for n in (10, 10**8, 10**11):
        masks = [m for m, _ in simhash.block_choices(n)]
        for _ in range(500):
            x = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(x & m == 0 for m in masks)


def test_query_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 3, 40, 200]))) for _ in range(60)]
    rows = [(i, rng.choice(texts)) for i in range(80)]
    for i in range(80, 160):
        t = rng.choice(texts).split()
        t[rng.randrange(len(t))] = "changed"
        rows.append((i, " ".join(t)))
    rows += [(160, None), (161, ""), (162, "\n\t"), (163, "ONE two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string")
    got = {r.id: (r.fingerprint & (1 << 64) - 1, r.component) for r in simhash.near_duplicates(df).collect()}
    prints = [slow_print(t or "") for _, t in rows]
    assert got == {i: (p, c) for (i, _), p, c in zip(rows, prints, components(prints))}


def test_empty_null_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c d e"), (1, "q w e r t y"), (None, "a b c d e"), (None, "z z"), (2, "q w e r t y")], "doc_id long, text string")
    got = sorted((str(r.id), str(r.component)) for r in simhash.near_duplicates(df).collect())
    assert got == [("1", "1"), ("1", "1"), ("2", "1"), ("None", "1"), ("None", "None")]
