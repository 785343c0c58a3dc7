import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidewater.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check_plan(counts, capacity, **settings):
    plan = packing.plan_packing(counts, capacity, **settings)
    ranks, used = defaultdict(set), defaultdict(list)
    for length, first, n, sequence, per, offset in plan:
        for r in range(first, first + n):
            assert r not in ranks[length]
            ranks[length].add(r)
            k = r - first
            used[sequence + k // per].append((offset + k % per * length, length))
    assert {l: len(r) for l, r in ranks.items()} == {l: n for l, n in counts.items() if n}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_plan_is_gapless_and_tight():
    rng = random.Random(1)
    for capacity, n in ((20, 1), (20, 50), (100, 400), (2048, 5000)):
        for _ in range(3):
            counts = Counter(rng.randint(1, capacity) for _ in range(n))
            total = sum(l * m for l, m in counts.items())
            sequences = check_plan(dict(counts), capacity)
            assert sequences <= 1.03 * -(-total // capacity) + 8


def test_plan_finds_pairs_that_greedy_filling_misses():
    # 6 of each: perfect packing needs 6 sequences
    assert check_plan({51: 600, 27: 600, 22: 600}, 100, large=0.2) <= 610
    assert check_plan({34: 300, 33: 600}, 100, large=0.3) == 300
    assert check_plan({}, 100) == 0
    assert check_plan({100: 3}, 100) == 3


def test_word_encoder_equals_tokenizer():
    tok = Tokenizer.from_file(PATH)
    texts = ["", " ", "Hello, world's  end!\n\tÀé á ́b", "x" * 300, "don't 1234 <|endoftext|> a<|startoftext|>b \x1c\x85   ok", "İstanbul ΣΑΣ 中文字 힣", "a\r\nb"]
    got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(PATH).encode(texts)]
    assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_pack_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "de", "x"], k=rng.choice([0, 3, 40, 300, 5000])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "same"), (202, "same"), (None, "no id")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    out = packing.pack(df, PATH, keep_ids=True).collect()
    tok = Tokenizer.from_file(PATH)
    expected = Counter()
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for p in range(0, len(ids), 2048):
            piece = np.array(ids[p : p + 2048], "<u4").tobytes()
            expected[i, p // 2048, p, len(piece) // 4, zlib.crc32(piece), piece] += 1
    assert Counter((r.id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in out) == expected
    places = defaultdict(list)
    for r in out:
        places[r.sequence].append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_word_encoder_cuts_as_the_tokenizer_does():
    tok = Tokenizer.from_file(PATH)
    # one part without an end and one with two, were texts cut at blanks and line feeds only
    blanks = [[f"a{b}b one two three four", f"five x){b}(y six seven"] for b in "\t\v\f\r"]
    quotes = ["''s", "it.'s", "x-'ll y", "'''t"]
    for texts in (*blanks, quotes):
        got = [np.frombuffer(x, "<u4").tolist() for x in packing.WordEncoder(PATH).encode(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_encoder_on_quotes_code_and_control_characters():
    rng, tok, encoder = random.Random(5), Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    pieces = [*"abdstmrevlABS '\"()[]{};=.,:-_/\\\n\t\r0123<>|éÀßœ\x1c\x00$#@!\x0b\x0c~`^", "'s", "'re", "<|endoftext|>", "print(", "');", "'ll", "́", "中", "‍", "\xa0", "\x85", "İ"]
    for _ in range(20):
        texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(1000)]
        expected = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
        assert encoder.encode(texts) == expected
    texts = ["f('data')", "x='select'; y='drop'", "print('test')", "['section']", "the dogs (John)'s bowl", "\"'tis true"]
    assert encoder.encode(texts) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_idle_encoders_are_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "IDLE", 0.2)
    path = PATH
    encoder = packing.shared_encoder(path)
    assert packing.shared_encoder(path) is encoder
    time.sleep(1.0)
    assert path not in packing._encoders and packing.shared_encoder(path) is not encoder
