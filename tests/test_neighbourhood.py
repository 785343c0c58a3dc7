import random

from tidewater.operators import ranking


def test_degrees_within_two_steps(spark, monkeypatch):
    """Degrees as by hand, with edges dealt by rows: before, they went to tasks by compressed size."""
    dealt = []
    monkeypatch.setattr(ranking, "dealt", lambda df, rows, *keys: (dealt.append((rows, keys)), df.repartition(3, *keys))[1])
    rng = random.Random(4)
    edges = sorted({(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(110)) if a != b})
    got = ranking.degrees_within(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(1,)], "node long"), 2)
    depth = {1: 0}
    for d in (1, 2):
        for node in [x for pair in edges for x, y in (pair, pair[::-1]) if depth.get(y) == d - 1 and x not in depth]:
            depth.setdefault(node, d)
    inner = [pair for pair in edges if pair[0] in depth and pair[1] in depth]
    assert sorted(tuple(r) for r in got.collect()) == sorted((n, d, sum(n in pair for pair in inner)) for n, d in depth.items())
    assert dealt == [(2 * len(edges), ("src",)), (len(edges), ("src",)), (len(edges), ("dst",))]
