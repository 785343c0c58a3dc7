import re

import corpus_pipeline
from tidewater.llm import mixing

from .test_simhash import components, slow_print


def make(spark):
    import random

    rng = random.Random(8)
    word = lambda: "".join(rng.choices(["the", "and", "of", "ing", "er", "on"], k=rng.randrange(1, 4)))
    rows = []
    for i in range(60):
        rows.append((i, " ".join(word() for _ in range(rng.randrange(30, 200))), "en", f"s{i % 3}", 0, "x"))
    rows += [(100 + i, rows[i][1].upper(), "en", "s1", 0, "y") for i in range(10)]
    rows += [(200 + i, rows[20 + i][1] + " changed", "en", None, 0, "z") for i in range(10)]
    rows += [(300, None, None, None, None, None), (301, "", "en", "s1", 0, "x"), (302, "123 456", "en", "s1", 0, "x"), (5, rows[5][1], "en", "s2", 0, "x"), (None, "the and of " * 20, "en", "s1", 0, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def test_stages_against_brute_force(spark, tmp_path):
    docs = make(spark)
    states = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, states[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        states.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for s in states[1:-1]:
        assert s.columns == docs.columns
    rows = [[tuple(r) for r in s.collect()] for s in states]
    # language ID: what has no letter goes, every clean document stays
    assert sorted(map(str, rows[1])) == sorted(str(r) for r in rows[0] if r[1] and re.search("[a-z]", r[1], re.I))
    # exact dedup: the largest id of each text
    best = {}
    for r in rows[1]:
        best[lower(r[1])] = max(best.get(lower(r[1]), -1), -1 if r[0] is None else r[0])
    assert sorted((lower(r[1]), -1 if r[0] is None else r[0]) for r in rows[2]) == sorted(best.items())
    # near dedup: the smallest id of each group
    order = sorted(rows[2], key=lambda r: (r[0] is None, r[0]))
    roots = components([slow_print(r[1]) for r in order])
    assert sorted(map(str, rows[3])) == sorted(str(order[i]) for i in set(roots))
    # mixing: as often as the operator takes each
    times = {r.id: r.times for r in mixing.mix(states[3]).collect()}
    assert sorted(map(str, rows[4])) == sorted(str(r) for r in rows[3] for _ in range(times[r[0]]))
    # packing: every row that is left has its pieces, with and without repeats
    assert sum(r.piece == 0 for r in states[5].collect()) == len(rows[4])


def test_run(spark, tmp_path):
    make(spark).drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_empty_tables_long_texts_repeated_rows_and_clashing_names(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, found string, size int, copy int, mix_times int, gone_id int, id int"
    text = "the and of ing er on " * 20
    own = ("d", "f", 1, 2, 3, 4, 5)
    rows = [(i, f"{text} the{'er' * i}", "en", "s1", 0, *own) for i in range(8)] + [(9, "the and ing " * 60_000, "en", "s2", 0, *own)]
    rows += [(3, "on of " * 30, "en", "s1", 0, *own), (3, "of on on " * 20, "en", "s1", 0, *own), (None, None, None, None, None, *own)]
    for k, some in enumerate((rows, [])):
        docs = spark.createDataFrame(some, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "pack_sequences" or out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{k}-{name}")
        assert (docs.count() > 0) == bool(some)
        if some:
            assert docs.where("doc_id = 9").count() > 0 and docs.where("doc_id IS NULL").count() == 0
