"""Tables with versions: each commit is a file that only one writer can make, and history is what versions differ in.

A commit's rows are written aside first. Then a file with the next number is renamed into place, which fails where another
writer has made that number: the writer that is late sees a conflict, or tries again on top of the other's version. A
reader takes a commit file and sees all of its version or nothing. No version is overwritten or changed.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..shared import shared_folder
from ..sources.tables import table


class StaleVersion(RuntimeError):
    """Another writer has committed the version that this one was about to make, or changed the rows it had read."""


class VersionedTable:
    """A keyed table in a folder that driver and executors share. Columns ``version`` and ``actor`` belong to the table."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str]):
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        path = self._path("commits")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def versions(self) -> list[int]:
        path = self._path("commits")
        if not self._fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(path) if s.getPath().getName().startswith("v"))

    def commit_of(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"commits/v{version:09d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows, the last one's by default; None if there is none."""
        known = self.versions()
        if not known:
            return None
        return self.spark.read.parquet(f"{self.folder}/data/{self.commit_of(known[-1] if version is None else version)['data']}")

    def _commit(self, rows: DataFrame, on: int, actor: str, reason: str) -> int:
        """Make version ``on + 1``; ``StaleVersion`` if there is one."""
        data = uuid.uuid4().hex
        rows.write.parquet(f"{self.folder}/data/{data}")
        aside = self._path(f"aside/{data}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps({"version": on + 1, "data": data, "actor": actor, "reason": reason, "at": time.time()}).encode()))
        stream.close()
        target = self._path(f"commits/v{on + 1:09d}.json")
        self._fs.mkdirs(target.getParent())
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            self._fs.delete(aside, False)
            self._fs.delete(self._path(f"data/{data}"), True)
            if "FileAlreadyExists" in str(error):
                raise StaleVersion(f"version {on + 1} of {self.folder} is another writer's") from error
            raise
        return on + 1

    def merged(self, rows: DataFrame, on: int, actor: str) -> DataFrame:
        """Version ``on`` with ``rows`` in place of those with the same keys; they and no others carry the next version."""
        marked = rows.withColumns({"version": F.lit(on + 1).cast("long"), "actor": F.lit(actor)})
        if not on:
            return marked
        kept = self.read(on).join(rows.select(*self.keys), self.keys, "left_anti")
        return kept.unionByName(marked, allowMissingColumns=True)

    def put(self, rows: DataFrame, actor: str = "", reason: str = "", attempts: int = 20) -> int:
        """Insert and replace by key on top of whatever is there, again if another writer was faster. Returns the version."""
        for _ in range(attempts):
            on = (self.versions() or [0])[-1]
            try:
                return self._commit(self.merged(rows, on, actor), on, actor, reason)
            except StaleVersion:
                continue
        raise StaleVersion(f"{attempts} other commits came first")

    def put_if_unchanged(self, rows: DataFrame, actor: str = "", reason: str = "") -> int:
        """As ``put``, for rows that carry the ``version`` they were read with (0: not there yet): ``StaleVersion`` if any has another one by now."""
        on = (self.versions() or [0])[-1]
        if on:
            now = self.read(on).select(*self.keys, F.col("version").alias("_now"))
            stale = rows.join(now, self.keys, "left").where(F.coalesce("version", F.lit(0)) != F.coalesce("_now", F.lit(0)))
        else:
            stale = rows.where(F.coalesce("version", F.lit(0)) != 0)
        first = stale.select(*self.keys).head()
        if first is not None:
            raise StaleVersion(f"{first.asDict()} has changed since it was read")
        return self._commit(self.merged(rows.drop("version", "actor"), on, actor), on, actor, reason)

    def commits(self) -> DataFrame:
        """``version``, ``actor``, ``reason``, ``at`` of each commit."""
        known = [self.commit_of(v) for v in self.versions()]
        return self.spark.createDataFrame([(c["version"], c["actor"], c["reason"], c["at"]) for c in known], "version long, actor string, reason string, at double")

    def history(self, *columns: str) -> DataFrame:
        """Keys, ``version``, ``actor``, ``reason`` and, for each of ``columns``, its value before (``prev_``) and since (``new_``).

        A row has an entry for each commit that wrote it. The version before is the last one below that wrote it, so that the
        entries of all versions are one union with a lag and no version is compared with another as a whole.
        """
        entries = None
        for v in self.versions():
            data = self.read(v)
            for c in columns:
                if c not in data.columns:
                    data = data.withColumn(c, F.lit(None))
            part = data.where(F.col("version") == v).select(*self.keys, "version", *columns)
            entries = part if entries is None else entries.unionByName(part)
        if entries is None:
            raise ValueError(f"{self.folder} has no version yet")
        w = Window.partitionBy(*self.keys).orderBy("version")
        told = entries.select(*self.keys, "version", *(F.lag(c).over(w).alias(f"prev_{c}") for c in columns), *(F.col(c).alias(f"new_{c}") for c in columns))
        return told.join(F.broadcast(self.commits().select("version", "actor", "reason")), "version")  # a row for each commit

    def vacuum(self, keep: int, older_than: float = 3600.0) -> int:
        """Remove all but the last ``keep`` versions, and rows of writes that never came to a commit; how many folders went."""
        known = self.versions()
        for v in known[:-keep]:
            self._fs.delete(self._path(f"commits/v{v:09d}.json"), False)
        wanted = {self.commit_of(v)["data"] for v in known[-keep:]}
        now, gone = time.time(), 0
        if self._fs.exists(self._path("data")):
            for s in self._fs.listStatus(self._path("data")):
                old = s.getModificationTime() / 1000 < now - older_than
                if s.getPath().getName() not in wanted and old:
                    self._fs.delete(s.getPath(), True)
                    gone += 1
        return gone


def _orders_in_three_commits(spark, sf_dir) -> VersionedTable:
    store = VersionedTable(spark, shared_folder(spark, "versions"), ["o_orderkey"])
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    store.put(o.where("o_orderstatus <> 'P'"), "load", "first")
    store.put(o.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") * 2), "double", "prices of every third")
    read = store.read().where("o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("X"))
    store.put_if_unchanged(read, "close", "every fifth")
    return store


_FIFTH = "o_orderkey % 5 = 0 AND (o_orderstatus <> 'P' OR o_orderkey % 3 = 0)"


@query(
    "versioned_orders",
    f"""
    SELECT o_orderkey, CASE WHEN {_FIFTH} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 6) AS o_totalprice,
      CAST(CASE WHEN {_FIFTH} THEN 3 WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS version FROM orders WHERE o_orderstatus <> 'P' OR o_orderkey % 3 = 0
    """,
)
def versioned_orders(spark, sf_dir):
    """Orders after three commits: a load, every third at twice its price, and every fifth closed if nobody changed it since."""
    return _orders_in_three_commits(spark, sf_dir).read().select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 6).alias("o_totalprice"), "version")


@query(
    "order_history",
    f"""
    WITH h AS (SELECT o_orderkey, 1 AS version, 'load' AS actor, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_orderstatus <> 'P' UNION ALL
      SELECT o_orderkey, 2, 'double', o_totalprice * 2, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
      SELECT o_orderkey, 3, 'close', CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END, 'X' FROM orders WHERE {_FIFTH})
    SELECT o_orderkey, CAST(version AS BIGINT) AS version, actor, round(lag(price) OVER w, 6) AS prev_o_totalprice, round(price, 6) AS new_o_totalprice, lag(status) OVER w AS prev_o_orderstatus, status AS new_o_orderstatus FROM h WINDOW w AS (PARTITION BY o_orderkey ORDER BY version)
    """,
)
def order_history(spark, sf_dir):
    found = _orders_in_three_commits(spark, sf_dir).history("o_totalprice", "o_orderstatus")
    return found.select("o_orderkey", "version", "actor", *(F.round(f"{p}_o_totalprice", 6).alias(f"{p}_o_totalprice") for p in ("prev", "new")), "prev_o_orderstatus", "new_o_orderstatus")
