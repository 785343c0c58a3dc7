import pytest

from tidewater.llm import shards


def fill(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id AS doc_id", "repeat(cast(id AS string), 40) AS text", "CASE WHEN id % 3 > 0 THEN 'é' END AS run")


def test_round_trip_tiers_and_versions(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=256 << 10, fanout=3)
    for k in range(7):
        store.append(fill(spark, 1500, 1500 * k).repartition(1))
    before = store.manifest()
    assert before["version"] == 7 and len(before["runs"]) == 7
    after = store.compact()
    assert len(after["runs"]) < 7 and store.candidates(after["runs"]) == []
    assert sum(r["rows"] for r in after["runs"]) == 10_500
    assert store.read().exceptAll(fill(spark, 10_500)).count() == 0 and store.read().count() == 10_500
    # an earlier version reads as before until it is removed
    assert store.read(3).count() == 4500
    assert store.vacuum() > 0 and store.read().count() == 10_500
    assert store.versions() == [after["version"]]


def test_a_version_is_committed_once(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(fill(spark, 10))
    now = store.manifest()
    with pytest.raises(shards.ManifestConflict):
        store.commit(now)
    assert store.manifest() == now
    # a writer that saw the old version goes on top of the new one
    seen, real = [], store.manifest

    def stale(version=None):
        if not seen:
            seen.append(1)
            return {"version": 0, "schema": None, "runs": []}
        return real(version)

    store.manifest = stale
    assert store.append(fill(spark, 5, 100))["version"] == 2
    store.manifest = real
    assert store.read().count() == 15


def test_other_columns_and_empty_tables(spark, tmp_path):
    store = shards.shard([fill(spark, 0)], f"file://{tmp_path}/e")
    assert store.read().columns == ["doc_id", "text", "run"] and store.read().count() == 0
    with pytest.raises(ValueError):
        store.append(spark.range(3))
    with pytest.raises(ValueError):
        shards.ShardStore(spark, f"file://{tmp_path}/none").read()


def test_runs_keep_their_real_sizes_and_full_ones_are_left_alone(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target=60_000, fanout=3)
    for k in range(9):
        store.append(fill(spark, 1000, 1000 * k).repartition(2))
    runs = store.compact()["runs"]
    sizes = {f"{p.parent.name}/{p.name}": p.stat().st_size for p in (tmp_path / "s/shards").rglob("*.parquet")}
    assert all(r["bytes"] == sum(sizes[f] for f in r["files"]) for r in runs)
    assert sum(r["rows"] for r in runs) == 9000 and store.read().distinct().count() == 9000
    full = {r["id"] for r in runs if r["bytes"] >= 30_000}
    store.append(fill(spark, 10, 20_000))
    assert full and full <= {r["id"] for r in store.compact()["runs"]}


def test_vacuum_takes_what_a_failed_write_left(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(fill(spark, 10))
    fill(spark, 5).write.parquet(f"file://{tmp_path}/s/shards/merged-lost")
    store.vacuum()
    assert (tmp_path / "s/shards/merged-lost").exists()  # it may be another writer's work in progress
    store.vacuum(orphan_seconds=0)
    assert not (tmp_path / "s/shards/merged-lost").exists() and store.read().count() == 10


def test_the_query_appends_compacts_and_commits(spark, tmp_path):
    from tidewater.llm.queries import ARRIVALS, arrivals

    docs = fill(spark, 300)
    store = shards.shard(arrivals(docs), f"file://{tmp_path}/s", fanout=4)
    assert store.manifest()["version"] > ARRIVALS  # a version for each arrival, and one for each merge
    assert len(store.manifest()["runs"]) < ARRIVALS and any("merged-" in r["id"] for r in store.manifest()["runs"])
    assert store.read().exceptAll(docs).count() == 0 and store.read().count() == 300
