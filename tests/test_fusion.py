import pytest
from pyspark.sql import functions as F

from tidewater.operators.fusion import blend, bm25_by_other_corpus, bm25_by_snapshot, fuse_playbooks, pack_page, similar_facts
from tidewater.operators.monitors import trajectory_scores
from tidewater.operators.retrieval import tokens
from tidewater.plans.protocols import Embedder, Registry, ResultCache, Store, embedding_udf, first_answer
from tidewater.sources.tables import table


def test_unseen_terms_weigh_ln_2(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, None)], "k long, t string")
    q = spark.createDataFrame([(7, "alpha")], "q long, t string")
    none = spark.createDataFrame([], "t string")
    got = bm25_by_snapshot(docs, none, q, "k", "t", "q", "t").collect()
    assert len(got) == 1 and abs(got[0].score - 0.6931471805599453 * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 50))) < 1e-9


def test_other_corpus_gives_all_pairs(spark, sf="/root/testdata/sf0.001"):
    terms = lambda name, key: table(spark, sf, name).select(key, F.explode(tokens(F.col("text"))).alias("t")).distinct()
    met = terms("benchmark", "item_id").join(terms("documents", "doc_id"), "t").select("item_id", "doc_id").distinct()
    got = bm25_by_other_corpus(spark, sf)
    assert got.columns == ["item_id", "doc_id", "score"]
    assert sorted(map(tuple, got.select("item_id", "doc_id").collect())) == sorted(map(tuple, met.collect()))


def test_blend_and_fusion(spark):
    a = spark.createDataFrame([(1, 1, 2.0), (1, 2, -4.0)], "q long, k long, score double")
    b = spark.createDataFrame([(1, 1, 0.0)], "q long, k long, score double")
    assert {r.k: round(r.score, 6) for r in blend([a, b], "q", "k").collect()} == {1: 0.175, 2: -0.35}
    rows = [(1, 1, 0.5, 3, 1, 0.0, False, 0.5, 0.2, 0.4, 0.9), (1, 2, 0.9, 0, 0, None, True, 1.0, 0.0, 0.0, 0.41), (1, 3, 0.9, 9, 0, 0.0, False, 1.0, 1.0, 1.0, 0.4), (1, 4, 0.0, 0, 0, 1e6, False, 0.0, 0.0, 0.0, 0.5)]
    c = spark.createDataFrame(rows, "q long, k long, rrf double, successes long, failures long, age_days double, rescue boolean, prior double, rank double, cosine double, match double")
    got = {r.k: (r.place, round(r.score, 6)) for r in fuse_playbooks(c, "q", "k").collect()}
    assert got == {2: (1, 1.1), 1: (2, round(0.5 * (0.8 + 0.4 * 4 / 6) + 0.02 + 0.06, 6))}


def test_similar_facts_need_a_common_word(spark):
    f = spark.createDataFrame([(1, "red green"), (2, None), (3, "zzz")], "f long, t string")
    b = spark.createDataFrame([(5, "Green red red"), (6, "red blue"), (7, "")], "k long, t string")
    assert [(r.f, r.k, round(r.score, 4)) for r in similar_facts(f, b, "f", "t", "k", "t").orderBy("place").collect()] == [(1, 5, 1.0), (1, 6, 0.3333)]


def test_page_is_packed_in_stages():
    page = [{"id": i, "body": "x" * 40, "note": "y" * 40} for i in range(5)]
    assert pack_page(page, 10_000, ["id"], ["note"]) == (page, 0, pack_page(page, 10_000, [], [])[2])
    rows, dropped, _ = pack_page(page, 125, ["id"], ["note"])
    assert dropped == 2 and ["note" in r for r in rows] == [True, True, True, False, False]
    rows, dropped, size = pack_page(page, 1, ["id"], ["note"])
    assert rows == [{"id": 0}, {"id": 1}, {"id": 2}] and dropped == 5 + 2 + 2 + 3 and size > 1
    assert pack_page([], 5, [], []) == ([], 0, 0)


def test_monitors_of_phrases(spark):
    logs = {
        1: ["task", "it works", "there is an error, also by the way refactor this", "done"], 2: ["t", "error", "it works", "done, all verified; let me verify"], 3: ["one"],
        4: ["sort the list", "a b c d", "x", "y", "z", "w", "a b c d"], 5: ["t", "p q r s", "p q r t", None], 6: ["t", "x", "while I'm", "at it then"],
    }
    df = spark.createDataFrame([(k, i, t) for k, log in logs.items() for i, t in enumerate(log)], "k long, i long, t string")
    got = {r.k: r for r in trajectory_scores(df, "k", "i", "t").collect()}
    assert (got[1].claim_contradiction, got[1].verification_skip, round(got[1].late_sprawl, 6)) == (0.4, 0.8, 0.9)
    assert got[2].verification_skip == 0.0 and got[3].late_sprawl == 0.0 and got[3].silent_topic_drift == 0.0
    assert got[4].cyclic_compression == 1.0 and got[4].semantic_loop == 0.0 and round(got[4].silent_topic_drift, 6) == 0.9 and got[4].failure_type == "cyclic_compression"
    assert round(got[5].semantic_loop, 6) == 0.5 and got[5].failure_type == "semantic_loop" and round(got[5].composite, 6) == round(0.25 * 0.5 + 0.1 * 0.9 * (1 - 1), 6)
    assert round(got[6].late_sprawl, 6) == 0.3  # a phrase that goes on in the next step
    assert trajectory_scores(df.limit(0), "k", "i", "t").count() == 0


class Lengths:
    name, dim = "lengths", 2

    def embed(self, texts):
        return [[len(t), 1] for t in texts]


def test_what_can_be_plugged_in(spark):
    assert isinstance(Lengths(), Embedder)
    df = spark.createDataFrame([(1, "abc"), (2, None)], "k long, t string")
    assert [r.v for r in df.select("k", embedding_udf(Lengths())("t").alias("v")).orderBy("k").collect()] == [[3.0, 1.0], None]
    r = Registry("reducer")
    r.put("a", lambda: 1)
    r.get("a")
    r.put("a", lambda: 2)
    assert r.get("a") == 2 and r.names() == ["a"]
    with pytest.raises(KeyError):
        r.get("b")

    class Down:
        name = "down"

        def healthy(self):
            return False

    class Fails(Down):
        name = "fails"

        def healthy(self):
            raise OSError

    class Up(Down):
        name = "up"

        def healthy(self):
            return True

        def answer(self, question, **_):
            return df

    assert first_answer([Down(), Fails(), Up()], "?") == ("up", df) and first_answer([Down()], "?") is None


def test_store_and_cache(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("x") is None
    store.put("x", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"])
    store.put("x", spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string"), ["k"])
    assert sorted(map(tuple, store.read("x").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    cache, calls = ResultCache(spark), []
    key = cache.key("search", {"b": 1, "a": 2}, index="3")
    assert key == cache.key("search", {"a": 2, "b": 1}, index="3") != cache.key("search", {"a": 2, "b": 1}, index="4")
    for _ in range(2):
        assert cache.get(key, lambda: calls.append(1) or spark.range(3)).count() == 3
    assert len(calls) == 1
