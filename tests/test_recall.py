import hashlib
import json
import random
import time

from pyspark.sql import functions as F

from tidewater.operators.joins import containing
from tidewater.operators.ranking import commit_class, gram_search
from tidewater.operators.recall import best_window, blake_digests, fit_to_budget, minified, widened
from tidewater.operators.rules import claim, price_rows, reap
from tidewater.operators.sessions import redact_json
from tidewater.operators.text import REDACTIONS, redact

SF = "/root/testdata/sf0.001"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_short_needles_and_blocks_are_found(spark):
    docs = spark.createDataFrame([(1, "alpha betagamma"), (2, "zz"), (3, None), (4, "the unmistakable end")], "k long, t string")
    needles = spark.createDataFrame([("al",), ("a",), ("alp",), ("a b",), ("zz",), ("",), (None,), ("none",), (" ",), (" ",), ("  ",)], "needle string")
    found = [(r.needle, r.k) for r in gram_search(docs, needles, "k", "t").collect()]
    assert set(found) == {("al", 1), ("a", 1), ("a", 4), ("alp", 1), ("a b", 1), ("zz", 2), (" ", 1), (" ", 4)} and len(found) == 8
    blocks = spark.createDataFrame([(1, "unmistakable"), (2, "alpha beta"), (3, "he unmistakable en"), (4, ""), (5, "not there at all")], "b long, block string")
    assert {(r.b, r.k) for r in containing(docs, blocks, "k", "t", "b", "block").collect()} == {(1, 4), (2, 1), (3, 4)}


def test_redaction_is_linear_and_whole(spark):
    key = "-----BEGIN PRIVATE KEY-----"
    text = f"a {key} x -----END RSA PRIVATE KEY----- b <think>no</think> c <thinking>d"
    assert one(spark, redact(F.lit(text))) == "a <redacted-private-key> b <redacted-hidden-reasoning> c <thinking>d"
    many = spark.createDataFrame([(key * 40_000,)], "t string")
    assert many.select(F.length(redact(F.col("t")))).first()[0] == 40_000 * len(key)


def plain(text):
    import re

    for pattern, mark in REDACTIONS:
        text = re.sub(pattern, mark, text)
    return text


def test_redaction_of_mixed_spans(spark):
    rng = random.Random(6)
    parts = ["<think>", "</think>", "<THINKING>", "</thinking>", "<thinking>", "-----BEGIN PRIVATE KEY-----", "-----END EC PRIVATE KEY-----", "x", "a@b.org ", "\n", "</think"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", redact(F.col("t")).alias("r")).collect()
    assert {r.i: r.r for r in got} == {i: plain(t) for i, t in enumerate(texts)}
    for t in texts:
        assert json.loads(redact_json(json.dumps({"<think>k</think>": [t, 1]}))) == {"<think>k</think>": [plain(t), 1]} and redact_json("{" + t) == plain("{" + t)


def test_redaction_of_mixed_spans_is_linear(spark):
    began = time.monotonic()
    hard = ["<think>" * 200_000 + "</thinking>", "<thinking>" * 200_000 + "</think>", "-----BEGIN PRIVATE KEY-----" * 40_000, "<think>a</thinking>" * 60_000]
    assert [len(redact_json(json.dumps([t]))) for t in hard] == [len(t) + 4 for t in hard]
    assert sorted(r[0] for r in spark.createDataFrame([(t,) for t in hard], "t string").select(F.length(redact(F.col("t")))).collect()) == sorted(map(len, hard))
    assert time.monotonic() - began < 20


def test_minified_keeps_order_and_numbers(spark):
    cases = {'{"b": 1.0, "a": [1, 2.50]}': '{"b":1.0,"a":[1,2.50]}', ' [ "a  b\\" c" ,\n\t1e5 ] ': '["a  b\\" c",1e5]', "{ broken": "{ broken", "[1 ] }": "[1 ] }", "1 , 2": "1 , 2", "1 ], [2": "1 ], [2", "[1 ,]": "[1 ,]", " 7 ": "7", "": "", '"x y"': '"x y"', "[" + '"y z", ' * 20_000 + "1]": "[" + '"y z",' * 20_000 + "1]"}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", minified(F.col("t")).alias("m")).collect()
    assert {r.t: r.m for r in got} == cases


def test_commit_class_uses_the_subject_and_the_files(spark):
    of = lambda m, *files: tuple(one(spark, commit_class(F.lit(m), F.array(*map(F.lit, files)).cast("array<string>"))))
    assert of("fix(ui)!: x") == ("bugfix", 0.9) and of("style: x") == ("refactor", 0.9)
    assert of("misc\n\nfixes a bug") == ("chore", 0.2) and of("wip\nThis reverts commit 1") == ("revert", 0.85)
    assert of("wip", "a.md", "x/docs/y.py") == ("docs", 0.5) and of("", "a/test_b.py") == ("test", 0.5) and of(None) == ("chore", 0.2)


def test_windows_budget_and_small_functions(spark):
    content = "one\n  two lines here\nthree of them\nfour"
    assert best_window(content, "two  lines hexe\nthree of them")[:2] == (2, 3)
    assert best_window(content, "nothing like it at all") is None and best_window("same line\nx\nsame line", "same line") is None
    rows = spark.createDataFrame([("a", 9, 60), ("b", 8, 50), ("c", 7, 30)], "f string, s int, n int")
    kept = lambda budget: [r.f for r in fit_to_budget(rows, [F.desc("s")], "n", budget).collect()]
    assert kept(110) == ["a", "b"] and kept(10) == ["a"] and kept(0) == ["a"]
    assert one(spark, minified(F.lit('{ "a" : [1, 2] }'))) == '{"a":[1,2]}' and one(spark, minified(F.lit("{no"))) == "{no"
    assert one(spark, widened(F.lit("find 'the lost' files in AND of the old tree"))) == ["find", "files", "old"]
    some = blake_digests(spark, SF).limit(1).first()
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id") == some.doc_id).first().text
    assert some.digest == hashlib.blake2b(text.encode(), digest_size=16).hexdigest()


def test_prices_and_jobs(spark):
    names = spark.createDataFrame([("a/m-1.5-20240101",), ("m-9",), ("_default",), (None,)], "model string")
    prices = spark.createDataFrame([("m-1-5", 2.0), ("m-2", 3.0)], "model string, price double")
    got = {r.model: (r.priced_as, r.price, r.approximate) for r in price_rows(names, "model", prices).collect()}
    assert got["a/m-1.5-20240101"] == ("m-1-5", 2.0, False) and got["m-9"] == ("m-2", 3.0, True) and got["_default"] == (None, 0.0, False)
    jobs = spark.createDataFrame([(1, 5, "running", 3, 3, 1, "w", None), (2, 4, "running", 1, 3, 1, "w", None), (3, 3, "pending", 0, 3, None, None, None)], "id int, created_at int, status string, attempts int, max_attempts int, locked_at int, locked_by string, error string")
    freed = reap(jobs, F.lit(2))
    assert {r.id: r.status for r in freed.collect()} == {1: "dead", 2: "failed", 3: "pending"}
    assert [(r.id, r.attempts, r.locked_by) for r in claim(freed, "n", F.lit(9), 2).orderBy("created_at").collect()] == [(3, 1, "n"), (2, 2, "n")]


def test_short_lists_are_written_before_they_meet_texts(spark, monkeypatch, sf="/root/testdata/sf0.001"):
    from tidewater.operators import fusion, retrieval

    made, write = {}, retrieval.written
    keep = lambda df, label: made.setdefault(label, write(df, label))
    for module in (retrieval, fusion):
        monkeypatch.setattr(module, "written", keep)
    retrieval.mmr_diversified(spark, sf)
    retrieval.retrieval_metrics(spark, sf)
    fusion.search_candidates(spark, sf)
    items = retrieval.table(spark, sf, "benchmark").count()
    assert 0 < made["page"].count() <= 30 * items and 0 < made["best"].count() <= fusion.CANDIDATES * items and 0 < made["gold"].count()


def test_hits_are_dealt_by_rows(spark, monkeypatch):
    """Hits of a conjunctive search go to as many tasks as their number needs; before, to as many as their compressed size did."""
    from tidewater.operators import recall

    monkeypatch.setattr(recall, "TASK_HITS", 10)
    asked = []
    monkeypatch.setattr(recall, "dealt", lambda df, rows, *keys, task_rows: (asked.append((rows, task_rows)), df.repartition(7, *keys))[1])
    docs = spark.createDataFrame([(i, "alpha beta gamma" if i % 2 else "alpha delta") for i in range(20)], "k int, t string")
    queries = spark.createDataFrame([(1, "alphas beta"), (2, "alpha"), (3, "the"), (4, "delta gamma")], "q int, s string")
    got = sorted(tuple(r) for r in recall.stemmed_search(docs, queries, "k", "t", "q", "s").collect())
    assert got == sorted([(1, i) for i in range(1, 20, 2)] + [(2, i) for i in range(20)])
    assert asked == [(20 + 20 + 10 + 10 + 10, 10)]  # alpha twice, beta, delta, gamma


def test_ratio_is_that_of_difflib():
    import difflib
    import random

    from tidewater.operators.recall import _ratio

    rng = random.Random(5)
    for _ in range(600):
        a, b = ("".join(rng.choice("ab c"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(40))) for _ in range(2))
        cut = rng.randrange(len(a) + 1)
        for x, y in ((a, b), (a, a[:cut] + "#" + a[cut + 1 :]), (a + b, b + a)):
            assert _ratio(x, y) == difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
