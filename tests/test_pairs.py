import random

import numpy as np
from pyspark.sql import functions as F

from tidewater.functions.scalars import cosine
from tidewater.operators import retrieval


def test_cosines_of_pairs_as_one_by_one(spark, monkeypatch):
    """Each vector meets the pairs of its block once: many blocks and waves, vectors of other lengths, none, zero, with nulls and NaN, ids without a row."""
    monkeypatch.setattr(retrieval, "PAIR_BLOCK", 300)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 7)
    rng, gen = random.Random(2), np.random.default_rng(2)
    odd = [None, [], [0.0] * 5, [float("nan")] * 5, [None] + [1.0] * 4, [1.0, 2.0]]
    vector = lambda: rng.choice(odd) if rng.random() < 0.3 else [float(x) for x in gen.normal(size=5)]
    keys = spark.createDataFrame([(i, vector()) for i in range(90)], "k long, vector array<float>")
    asks = spark.createDataFrame([(i, vector()) for i in range(20)], "q int, vector array<float>")
    pairs = spark.createDataFrame([(q, k, float(q + k)) for q in range(22) for k in range(95) if rng.random() < 0.6], "q int, k long, score double")
    got = retrieval.pair_cosines(pairs, keys, asks, "k", "q")
    near = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(F.least(F.greatest(cosine(F.col("a"), F.col("b")), F.lit(0.0)), F.lit(1.0)))
    expected = pairs.join(keys.withColumnRenamed("vector", "a").withColumn("x", F.lit(1)), "k", "left").join(asks.withColumnRenamed("vector", "b").withColumn("y", F.lit(1)), "q", "left").select("q", "k", "score", near.alias("near"), (F.col("x").isNotNull() & F.col("y").isNotNull()).alias("known"))
    rows = lambda df: sorted((r.q, r.k, r.score, round(r.near, 9), r.known) for r in df.collect())
    assert rows(got) == rows(expected)
    assert retrieval.pair_cosines(pairs, keys.limit(0), asks, "k", "q").where("known").count() == 0
    best = {q: max(s for a, _, s, _, _ in rows(got) if a == q) for q in range(22)}
    assert all(abs(r.total - 0.6 * r.near - 0.4 * r.score / best[r.q]) < 1e-12 for r in retrieval.blended(got, "q").collect())
