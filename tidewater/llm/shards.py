"""Sharding by size-tiered compaction under versioned manifests, in DataFrame operations only.

An append writes what has arrived as small files that are never changed (each a run of its own) and commits a manifest
that lists them after all earlier ones. A compaction looks for tiers, runs within a factor of ``FANOUT`` of each other in
size, that have at least ``FANOUT`` runs, merges these into files of about the target size without a shuffle, and commits
a manifest in which the merged runs stand for their sources. Runs of half the target size or more are left alone. A merge
leaves at most half as many runs as it took, so that a compaction ends.

A manifest is a file ``v<number>.json``. It is written aside and then renamed to the next number, which fails if another
writer has taken that number: the commit is then tried again on top of the other's version. Readers take the highest
version and see all of it or nothing. Files that no kept version lists are removed by ``vacuum``, also those of writes
that failed before their commit, once these are old enough to be nobody's work in progress. Rename must not replace
an existing file (``FileContext`` guarantees that on HDFS and local disks; an object store needs a committer that does).
"""

from __future__ import annotations

import json
import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TARGET = 128 << 20
FANOUT = 4
#: Tiers count from this size.
SMALLEST = 64 << 10
#: Files that one job merges at most; more are merged by more jobs of the same compaction.
FILES_PER_JOB = 20_000
#: Merges that run side by side.
MERGES = 4
#: Files of no version are removed when they are so old.
ORPHAN_SECONDS = 86_400


class ManifestConflict(Exception):
    """Another writer has committed this version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # ------------------------------------------------------------ manifests
    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``version``, ``schema`` and ``runs``: each with ``id``, ``rows``, ``bytes``, ``tier`` and ``files``."""
        known = self.versions()
        if not known:
            return {"version": 0, "schema": None, "runs": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{known[-1] if version is None else version:08d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def commit(self, manifest: dict) -> None:
        """Make ``manifest`` its version, or raise ``ManifestConflict`` if that version exists."""
        jvm = self.spark._jvm
        aside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self._conf)
        never_replace = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            files.rename(aside, self._path(f"{self.root}/manifests/v{manifest['version']:08d}.json"), never_replace)
        except Exception as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise ManifestConflict(manifest["version"]) from error
            raise

    def _change(self, edit) -> dict:
        while True:
            manifest = edit(self.manifest())
            manifest["version"] += 1
            try:
                self.commit(manifest)
                return manifest
            except ManifestConflict:
                continue

    # ------------------------------------------------------------ runs
    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / SMALLEST, self.fanout)))

    def _write(self, df: DataFrame, name: str) -> list[dict]:
        """Write ``df``; a (file, rows, bytes) entry for each file that has rows."""
        folder = f"{self.root}/shards/{name}"
        df.write.parquet(folder)
        read = self.spark.read.schema(df.schema).parquet(folder)
        counted = read.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        return [{"file": f"{name}/{r.file}", "rows": r.rows, "bytes": r.bytes} for r in counted.collect()]  # as many as the manifest lists

    def _runs(self, files: list[dict]) -> list[dict]:
        """Each file as a run of its own, with its real size."""
        return [{"id": f["file"], "rows": f["rows"], "bytes": f["bytes"], "tier": self.tier(f["bytes"]), "files": [f["file"]]} for f in sorted(files, key=lambda f: f["file"])]

    def append(self, df: DataFrame) -> dict:
        """Each file of the arrival becomes a run; the manifest that has them is returned."""
        name = f"arrival-{uuid.uuid4().hex}"
        runs = self._runs(self._write(df, name))

        def edit(manifest):
            known = T.StructType.fromJson(manifest["schema"]) if manifest["schema"] else df.schema
            if [(f.name, f.dataType) for f in known] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError("the arrival's columns differ from those of the store")
            return manifest | {"schema": manifest["schema"] or df.schema.jsonValue(), "runs": manifest["runs"] + runs}

        return self._change(edit)

    def candidates(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of runs to merge: of one tier and below half the target, ``fanout`` of them at least."""
        tiers: dict[int, list[dict]] = {}
        for run in runs:
            if run["bytes"] < self.target / 2:
                tiers.setdefault(run["tier"], []).append(run)
        groups = []
        for _, found in sorted(tiers.items()):
            for start in range(0, len(found), FILES_PER_JOB):
                some = found[start : start + FILES_PER_JOB]
                if len(some) >= self.fanout:
                    groups.append(some)
        return groups

    def compact(self) -> dict:
        """Merge until no tier has ``fanout`` runs; each merge is a version of its own."""
        while True:
            manifest = self.manifest()
            groups = self.candidates(manifest["runs"])
            if not groups:
                return manifest
            with ThreadPoolExecutor(MERGES) as pool:
                list(pool.map(lambda group: self._merge(manifest, group), groups))

    def _merge(self, manifest: dict, group: list[dict]) -> None:
        size = sum(r["bytes"] for r in group)
        paths = [f"{self.root}/shards/{f}" for r in group for f in r["files"]]
        source = self.spark.read.schema(T.StructType.fromJson(manifest["schema"])).parquet(*paths)
        name = f"merged-{uuid.uuid4().hex}"
        # runs are of about one size: whole input splits go together, and no row is shuffled
        files = self._write(source.coalesce(max(1, int(size / self.target))), name)
        if sum(f["rows"] for f in files) != sum(r["rows"] for r in group):
            raise RuntimeError("a merge has lost or doubled rows; nothing was committed")
        gone, new = {r["id"] for r in group}, self._runs(files)

        def edit(now):
            if not gone <= {r["id"] for r in now["runs"]}:
                raise RuntimeError("another compaction has merged these runs; nothing was committed")
            return now | {"runs": [r for r in now["runs"] if r["id"] not in gone] + new}

        self._change(edit)

    # ------------------------------------------------------------ reading
    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version."""
        manifest = self.manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing has been appended yet")
        schema = T.StructType.fromJson(manifest["schema"])
        paths = [f"{self.root}/shards/{f}" for r in manifest["runs"] for f in r["files"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vacuum(self, keep: int = 1, orphan_seconds: float = ORPHAN_SECONDS) -> int:
        """Remove the files and manifests that none of the last ``keep`` versions needs; how many files went.

        Each write has a folder of its own. Folders that no version lists are left from writes that failed or lost their
        race; they go when they are older than ``orphan_seconds``.
        """
        known = self.versions()
        needed = {f for v in known[-keep:] for r in self.manifest(v)["runs"] for f in r["files"]}
        every = {f for v in known[:-keep] for r in self.manifest(v)["runs"] for f in r["files"]}
        for f in every - needed:
            self._fs.delete(self._path(f"{self.root}/shards/{f}"), False)
        for v in known[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}.json"), False)
        folders, holds, left = self._path(f"{self.root}/shards"), {f.split("/")[0] for f in needed}, {f.split("/")[0] for f in every}
        for status in self._fs.listStatus(folders) if self._fs.exists(folders) else []:
            name, old = status.getPath().getName(), time.time() - status.getModificationTime() / 1000 >= orphan_seconds
            if name not in holds and (name in left or old):
                self._fs.delete(status.getPath(), True)
        return len(every - needed)


def shard(batches: list[DataFrame], root: str, target: int = TARGET, fanout: int = FANOUT) -> ShardStore:
    """Append each batch to the store at ``root``; after each, compact and remove what the last version does not need.

    Columns of any names and types, nulls, repeated rows and texts of any length are kept as they are. An empty batch
    commits a version without runs of its own; a store of empty batches reads as an empty table with their columns.
    """
    store = ShardStore(batches[0].sparkSession, root, target, fanout)
    for batch in batches:
        store.append(batch)
        store.compact()
        store.vacuum()
    return store
