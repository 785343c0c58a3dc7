"""Language ID and toxicity: held-out accuracy and edge cases."""

import random

from pyspark.sql import functions as F

from tidewater.llm import langid, toxicity
from tidewater.llm.common import fold_remainder


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    languages, matrix = langid.train(docs.where(fold_remainder("doc_id", 5) != 0))
    held = docs.where(fold_remainder("doc_id", 5) == 0)
    out = langid.predict(held, languages, matrix).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.9


def test_language_edges(spark):
    rows = [(i, "the of and this that " * 5, "en") for i in range(20)] + [(i, "der die das und nicht " * 5, "de") for i in range(20, 40)]
    rows += [(40, None, "en"), (41, "", "en"), (42, "123 !!", "de"), (43, "THE OF AND", None), (44, "und das nicht " * 200_000, None), (45, "\U0001d4d0", None), (43, "THE OF AND", None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42)] == ["und"] * 3 and got[40].score == 0
    assert got[43].lang_pred == "en" and got[44].lang_pred == "de" and got[45].lang_pred in ("en", "de")
    assert all(0 <= r.score <= 1 for r in got.values())
    empty = df.where("false")
    assert langid.identify(empty).collect() == []
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def corpus(n, seed=1):
    rng = random.Random(seed)
    ordinary = ["".join(rng.choices(["ther", "and", "ing", "tion", "ou", "en", "st"], k=rng.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(ordinary, k=rng.randrange(20, 120))
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = "vilk" + rng.choice(["ast", "orn", "ish", "ete", "um", "ox"]) if rng.random() < 0.6 else "grobble"
        docs.append((i, " ".join(words), "x"))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_held_out_and_rare_forms(spark):
    docs, labels = corpus(900)
    docs += [(9000, None, "x"), (9001, "", "x"), (9002, "12 !!", "x"), (9003, docs[1][1] + " vilkanza vilkora", "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int").where(F.col("doc_id") % 3 != 1)
    got = {r.doc_id: r for r in toxicity.detect(d, l).collect()}
    held = [(got[i].predicted, t) for i, t in labels if i % 3 == 1]
    assert sum(p == t for p, t in held) / len(held) > 0.97
    assert all(got[i].predicted == 0 and got[i].score == got[9000].score for i in (9000, 9001, 9002))
    assert got[9003].score > 0.7


def test_toxicity_without_labels(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.detect(d, none).collect()} == {0.5}
    assert all(r.predicted == 1 for r in toxicity.detect(d, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")).collect())
    assert toxicity.detect(d.where("false"), none).collect() == []


def test_toxicity_keeps_rare_grams_of_a_large_sample(spark):
    rng = random.Random(4)
    words = ["garden", "morning", "station", "kitchen", "window", "teacher"]
    # well over 2**21 occurrences of grams, among them an expression that four documents hold once each
    texts = [" ".join(rng.choices(words, k=3000)) + " blorptastic" * (i % 2) + " zvrqkulf" * (i in (41, 43, 45, 47)) for i in range(160)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    l = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id long, toxic int")
    shared, _ = toxicity.train(d, l)
    marked = toxicity.START + "zvrqkulf" + toxicity.STOP
    grams = [marked[a:b] for b in range(1, len(marked) + 1) for a in range(max(0, b - toxicity.ORDER), b)]
    assert (shared.value.table.find(toxicity.Model._keys_of(grams)) >= 0).all()
    assert shared.value.evidence(["zvrqkulf"])[0] > toxicity.STRONG


def test_language_id_against_a_dictionary(spark):
    import math
    from collections import Counter

    from tidewater.llm import langid

    factors = [int(x) for x in langid._FACTORS]

    def buckets(text):
        points = [ord(c) if c.isalpha() else 32 for c in f" {text.lower()} "]
        hashes = [0] * len(points)
        for n in langid.ORDERS:
            hashes = [(hashes[i] + points[i + n - 1]) * factors[n - 1] % 2**32 for i in range(len(points) - n + 1)]
            yield from (h >> 17 for i, h in enumerate(hashes) if points[i] + points[i + n - 1] != 64)
            hashes = [h ^ (h >> 15) for h in hashes]

    texts = {"xx": ["ab cd ef ab", "cd ab Ef, 12 ab"], "yy": ["gh ij kl", "ij gh kl kl ab", "GH ij"]}
    rows = [(10 * i + j, t, lang) for i, (lang, some) in enumerate(texts.items()) for j, t in enumerate(some)] + [(0, texts["xx"][0], "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, matrix = langid.train(docs)
    prior = Counter(lang for *_, lang in rows)
    counts = {lang: Counter(b for _, t, of in rows if of == lang for b in buckets(t)) for lang in languages}
    for text in ["ab cd", "gh", "kl ab ab", "zz", "ab " * 400, "ij, kl? gh!"]:
        score = []
        for lang in languages:
            total = sum(counts[lang].values()) + 0.5 * langid.BUCKETS
            score.append(math.log(prior[lang] / len(rows)) + sum(math.log((counts[lang][b] + 0.5) / total) for b in buckets(text)))
        n = len(list(buckets(text)))
        said, got = langid.score_texts([text.lower()], languages, matrix)
        best = score.index(max(score))
        assert said == [languages[best]]
        scale = min(n, langid.EVIDENCE) / n
        assert abs(got[0] - 1 / sum(math.exp((s - score[best]) * scale) for s in score)) < 1e-4


def test_long_texts_lose_no_gram_between_pieces(monkeypatch):
    import numpy as np

    from tidewater.llm import langid

    text = "wörter und Andere dinge, 12 x " * 40
    whole = np.bincount(langid._grams(next(iter(langid._chunks([text]))))[0], minlength=langid.BUCKETS)
    monkeypatch.setattr(langid, "_CHUNK", 7)
    pieces = sum(np.bincount(langid._grams(held)[0], minlength=langid.BUCKETS) for held in langid._chunks([text]))
    assert (whole == pieces).all()


def test_kneser_ney_against_dictionaries():
    import math
    from collections import Counter

    import numpy as np

    from tidewater.llm import toxicity as tox

    words = {0: Counter({"idiot": 3, "idiots": 1, "fool": 2}), 1: Counter({"order": 4, "ordinary": 2, "id": 1, "fools": 1, "é": 1})}
    seen = [Counter(), Counter()]
    for c, some in words.items():
        for word, n in some.items():
            marked = tox.START + word + tox.STOP
            for stop in range(1, len(marked) + 1):
                for start in range(max(0, stop - tox.ORDER), stop):
                    seen[c][marked[start:stop]] += n
    grams = sorted(seen[0].keys() | seen[1].keys())
    before = Counter(g[1:] for g in grams if len(g) > 1)
    counts = [seen[0], seen[1], before]
    model = tox.Model(grams, *(np.array([x[g] for g in grams]) for x in counts))
    letters = sum(len(g) == 1 for g in grams)

    def step(c, context, letter, lower):
        after = {g: counts[c][g] for g in grams if g[:-1] == context and counts[c][g] > 0}
        total = sum(after.values())
        if not total:
            return lower
        return (max(after.get(context + letter, 0) - tox.DISCOUNT, 0) + tox.DISCOUNT * len(after) * lower) / total

    def slow(word):
        marked, gain = tox.START + word + tox.STOP, 0.0
        for t in range(1, len(marked)):
            shared = 1 / (letters + 1)
            for k in range(1, min(tox.ORDER, t + 1) + 1):
                context = marked[t - k + 1 : t]
                if k in (tox.ORDER, t + 1):
                    gain += math.log(step(0, context, marked[t], shared)) - math.log(step(1, context, marked[t], shared))
                else:
                    shared = step(2, context, marked[t], shared)
        return gain

    asked = ["idiot", "idiotic", "fool", "fools", "order", "zz", "é", "ordinaryidiots", "i"]
    assert np.allclose(model.evidence(asked), [slow(w) for w in asked])
