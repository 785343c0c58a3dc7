import re

import numpy as np

from tidewater.operators import doc_recall, retrieval


def walked(text):
    """Sections by a stack of headings."""
    out, stack, body, start = [], [], [], 1

    def close():
        if "\n".join(body).strip():
            out.append((start, " > ".join(t for _, t in stack) or "(intro)", "\n".join(body).strip()))

    for n, line in enumerate(text.split("\n"), 1):
        if m := re.match(doc_recall.HEADING, line):
            close()
            body, start = [], n
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
        else:
            body.append(line)
    close()
    return out


def test_paths(spark):
    texts = ["intro\n# A\n\n## B\ntext b\n#### D\ntext d\n## C \ntext c\n# E\n### F\ntext f\n####### no\n#no", "", "# only", "\n\n## x\na\n# y\nb\n## z\n\nc\n"]
    got = doc_recall.heading_chunks(spark.createDataFrame(list(enumerate(texts)), "n int, line string"), "n", "line").collect()
    for k, text in enumerate(texts):
        assert sorted((r.line, r.path, r.text) for r in got if r.n == k) == walked(text)


def test_long_sections(spark):
    body = "\n\n".join(f"p{i} " + "x" * (300 if i != 3 else 2000) for i in range(8))
    got = sorted(doc_recall.heading_chunks(spark.createDataFrame([(1, "# T\n" + body)], "k int, t string"), "k", "t").collect(), key=lambda r: r.piece)
    assert "\n\n".join(r.text for r in got) == body and [len(r.text) <= 1200 for r in got] == [True, False, True, True] and {r.path for r in got} == {"T"}


def test_recall_by_vectors_else_words(spark):
    chunks = spark.createDataFrame([(1, "Storage", "how rows are kept"), (2, "Search", "terms and Rows"), (3, "Other", "nothing")], "chunk long, path string, text string")
    queries = spark.createDataFrame([(1, "where are ROWS kept"), (2, "search rows"), (3, "???"), (4, "search rows")], "q long, t string")
    vectors = spark.createDataFrame([(1, "m", 2, [1.0, 0.0]), (2, "m", 2, [-1.0, 0.1]), (3, "old", 2, [1.0, 0.0]), (3, "m", 2, [])], "chunk long, embedder string, dim int, vector array<double>")
    asked = spark.createDataFrame([(1, "none", 2, [1.0, 0.0]), (2, "m", 2, [2.0, 0.0]), (4, "m", 0, [])], "q long, embedder string, dim int, vector array<double>")
    got = {}
    for r in doc_recall.chunk_recall(chunks, queries, "q", "t", vectors, asked).orderBy("q", "place").collect():
        got.setdefault(r.q, []).append((r.chunk, round(r.score, 3), r.mode))
    assert got == {1: [(1, 0.75, "lexical"), (2, 0.25, "lexical")], 2: [(1, 1.0, "vector"), (2, -0.995, "vector")], 4: [(2, 1.0, "lexical"), (1, 0.5, "lexical")]}


def test_cosines_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 70)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    x = np.random.default_rng(2).normal(size=(300, 6))
    x[7] = 0
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    got = {}
    for r in retrieval.knn(df, df.where("vec_id % 10 = 7"), 5).orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in range(17, 300, 10):
        s = u @ u[i]
        s[i] = -2
        assert got[i] == np.argsort(-s)[:5].tolist()
    assert 7 not in got


def test_words_in_blocks_and_waves(spark, monkeypatch):
    rng = np.random.default_rng(3)
    word = [f"w{i}" for i in range(30)] + ["É", "K_9", "naïve", "Kelvin"]
    texts = [" ".join(rng.choice(word, rng.integers(0, 25))) + rng.choice(["", ".X-y", " z"]) for _ in range(300)]
    asks = [" ".join(rng.choice(word, rng.integers(0, 9))) for _ in range(40)] + ["??", "W1 w1 w2"]
    chunks = spark.createDataFrame([(i * 7 % 301 - 90, "P", t) for i, t in enumerate(texts)] + [(999, None, None)], "chunk long, path string, text string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asks)], "q string, t string")
    cut = lambda t: {w.lower() for w in re.findall("[a-zA-Z0-9_]+", t)}
    wanted = {}
    for i, t in enumerate(asks):
        shares = sorted((-len(cut(t) & cut(f"P {x}")) / max(1, len(cut(t))), j * 7 % 301 - 90) for j, x in enumerate(texts))
        wanted |= {f"q{i}": [(c, -s) for s, c in shares[:3] if s < 0]} if shares[0][0] < 0 else {}
    for sizes in ({}, {"CHUNK_BLOCK": 900, "WAVE_WORDS": 50, "MOST_CELLS": 60}, {"WAVE_QUERIES": 5, "MOST_CELLS": 3}):
        for name, size in sizes.items():
            monkeypatch.setattr(doc_recall, name, size)
        df = doc_recall.chunk_recall(chunks, queries, "q", "t", k=3)
        assert "generate explode(w" not in df._jdf.queryExecution().toString().lower()  # words and pairs are no rows
        got = {}
        for r in df.orderBy("q", "place").collect():
            got.setdefault(r.q, []).append((r.chunk, r.score))
        assert got == wanted


def test_documents_are_cut_once(spark, sf="/root/testdata/sf0.001"):
    plan = doc_recall.heading_recall(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "embeddings.parquet" in plan
    assert plan.count("REPARTITION_BY_NUM") == 2  # blocks and waves are dealt to tasks by their number
