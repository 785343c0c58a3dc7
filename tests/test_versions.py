import threading

import pytest
from pyspark.sql import functions as F

from tidewater.plans.versions import StaleVersion, VersionedTable


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "k long, v string")


def test_two_writers_and_one_conflict(spark, tmp_path):
    store = VersionedTable(spark, f"{tmp_path}/t", ["k"])
    assert store.read() is None and store.versions() == []
    assert store.put(frame(spark, (1, "a"), (2, "b")), "one") == 1
    mine, yours = (store.read().where(f"k = {k}").withColumn("v", F.lit(f"new{k}")) for k in (1, 1))
    assert store.put_if_unchanged(mine, "one", "mine") == 2
    with pytest.raises(StaleVersion, match="'k': 1"):
        store.put_if_unchanged(yours, "two", "yours")
    with pytest.raises(StaleVersion):  # taken to be new, but it is there
        store.put_if_unchanged(frame(spark, (2, "x")).withColumn("version", F.lit(0)))
    assert store.put_if_unchanged(frame(spark, (3, "c")).withColumn("version", F.lit(0)), "two") == 3
    assert sorted(tuple(r) for r in store.read().collect()) == [(1, "new1", 2, "one"), (2, "b", 1, "one"), (3, "c", 3, "two")]
    assert sorted(tuple(r)[:2] for r in store.read(1).collect()) == [(1, "a"), (2, "b")]
    assert sorted((r.k, r.version, r.prev_v, r.new_v, r.actor, r.reason) for r in store.history("v").collect()) == [(1, 1, None, "a", "one", ""), (1, 2, "a", "new1", "one", "mine"), (2, 1, None, "b", "one", ""), (3, 3, None, "c", "two", "")]


def test_a_version_is_made_once(spark, tmp_path):
    store = VersionedTable(spark, f"{tmp_path}/t", ["k"])
    assert store._commit(frame(spark, (1, "a")).withColumn("version", F.lit(1)), 0, "", "") == 1
    with pytest.raises(StaleVersion):
        store._commit(frame(spark, (1, "b")).withColumn("version", F.lit(1)), 0, "", "")
    assert store.read().first().v == "a" and len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_racing_writers_lose_nothing(spark, tmp_path):
    stores = [VersionedTable(spark, f"{tmp_path}/t", ["k"]) for _ in range(4)]
    failed = []

    def write(i):
        try:
            for j in range(2):
                stores[i].put(frame(spark, (10 * i + j, "x"), (99, f"w{i}")), f"w{i}")
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed
    assert stores[0].versions() == list(range(1, 9)) and sorted(r.k for r in stores[0].read().collect()) == [0, 1, 10, 11, 20, 21, 30, 31, 99]
    assert stores[0].history("v").where("k = 99").count() == 8
    assert stores[0].vacuum(2, older_than=-1) == 6 and stores[0].versions() == [7, 8] and stores[0].read().count() == 9


def test_columns_may_be_added(spark, tmp_path):
    store = VersionedTable(spark, f"{tmp_path}/t", ["k"])
    store.put(frame(spark, (1, "a")))
    store.put(spark.createDataFrame([(2, "b", 5)], "k long, v string, extra long"))
    assert sorted((r.k, r.extra or 0) for r in store.read().collect()) == [(1, 0), (2, 5)]
    assert sorted((r.k, r.new_extra or 0) for r in store.history("extra").collect()) == [(1, 0), (2, 5)]
