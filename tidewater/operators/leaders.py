"""Clusters of failures by leaders: a row joins the first leader near it, or leads itself.

Rows are taken in order of time. A round takes the first rows that are still open, a bounded number, and finds the leaders
among them one after the other; all open rows that are near one of these leaders, wherever they are, join the first such
leader and are done. A leader's neighbourhood leaves in one pass, however large it is, and no pairs are formed.

Where few rows are near each other nearly all of them lead, and each meets all before it: that is quadratic, whatever is
done. Rows meet leaders as products of blocks, in tasks of a bounded number of rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..registry import query
from ..shared import dealt, written
from ..sources.tables import table

#: Cosine from which two failures are alike, failures of a candidate, failures kept as its evidence, rows of a round.
NEAR, LEAST, EVIDENCE, ROUND = 0.85, 3, 8, 8_000
#: Rows of a product with all leaders, rows of a task, and how far a product of blocks may be off a product of two vectors.
BLOCK, TASK_ROWS, OFF = 256, 5_000, 1e-9


class Leaders:
    """Leaders in order, by domain; ``first`` gives the number of the first one near each row, -1 where there is none."""

    def __init__(self, near: float):
        self.limit, self.bare, self.prints, self.vectors = near, {}, {}, {}

    def add(self, number: int, domain, fingerprint, unit: np.ndarray | None) -> None:
        if unit is None:
            self.bare.setdefault((domain, fingerprint), number)
        else:
            own = self.vectors.setdefault((domain, len(unit)), {"units": np.empty((16, len(unit))), "numbers": []})
            if len(own["numbers"]) == len(own["units"]):
                own["units"] = np.concatenate([own["units"], np.empty_like(own["units"])])
            own["units"][len(own["numbers"])] = unit
            own["numbers"].append(number)
        self.prints.setdefault((domain, fingerprint), number)

    def first(self, rows: list[tuple]) -> np.ndarray:
        """Rows (domain, fingerprint, unit): one without a vector meets leaders with its fingerprint; one with a vector those within the limit, and leaders without a vector by fingerprint."""
        out, alike = np.full(len(rows), -1), defaultdict(list)
        for i, (domain, fingerprint, unit) in enumerate(rows):
            out[i] = (self.prints if unit is None else self.bare).get((domain, fingerprint), -1)
            if unit is not None:
                alike[domain, len(unit)].append(i)
        for key, at in alike.items():
            if key in self.vectors:
                numbers = np.array(self.vectors[key]["numbers"])
                units = self.vectors[key]["units"][: len(numbers)]
                for k in range(0, len(at), BLOCK):
                    own = np.array(at[k : k + BLOCK])
                    close = self._close(np.stack([rows[i][2] for i in own]), units)
                    found = np.where(close.any(axis=1), numbers[close.argmax(axis=1)], -1)
                    out[own] = np.where((out[own] < 0) | ((found >= 0) & (found < out[own])), found, out[own])
        return out

    def _close(self, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
        s = rows @ units.T
        close = s >= self.limit
        for i, j in np.argwhere(np.abs(s - self.limit) <= OFF):  # one by one, so that no block's order of sums decides
            close[i, j] = units[j] @ rows[i] >= self.limit
        return close


def _unit(v) -> np.ndarray | None:
    """A vector of length one; None for none, for one of length zero and for one with a component that is no number."""
    x = None if v is None or None in v else np.asarray(v, dtype=np.float64)
    if x is None or not len(x) or not np.isfinite(x).all() or not (n := np.linalg.norm(x)):
        return None
    return x / n


def _rows(batch: pa.RecordBatch | pa.Table) -> list[tuple]:
    """(domain, fingerprint, unit) of a batch."""
    units = batch.column("unit")
    units = units.combine_chunks() if isinstance(units, pa.ChunkedArray) else units
    flat, ends = units.values.to_numpy(zero_copy_only=False), units.offsets.to_numpy()
    of = [flat[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], units.is_valid().to_pylist(), strict=True)]
    return list(zip(batch.column("domain").to_pylist(), batch.column("fingerprint").to_pylist(), of, strict=True))


def _leaders(ids: list[int], rows: list[tuple], near: float) -> tuple[Leaders, list[int]]:
    """The leaders among rows in order, and their ids: a block meets those before it at once, and its own one after the other."""
    leaders, of = Leaders(near), []
    for k in range(0, len(rows), BLOCK):
        own, fresh = rows[k : k + BLOCK], Leaders(near)
        met, begin = leaders.first(own), len(of)
        for i, row in enumerate(own):
            if met[i] < 0 and fresh.first([row])[0] < 0:
                fresh.add(len(of), *row)
                of.append((ids[k + i], row))
        for number in range(begin, len(of)):
            leaders.add(number, *of[number][1])
    return leaders, [i for i, _ in of]


def leader_clusters(failures: DataFrame, near: float = NEAR) -> DataFrame:
    """``id``, ``domain``, ``at``, ``leader``: the id of the row's leader, its own if it leads.

    ``failures``: ``id`` (long, different for all), ``domain`` (string), ``at`` (time), ``fingerprint`` (string), ``vector`` (null or of length zero if there is none). Times
    are ordered with ids; null domains are one domain. An empty table gives no rows.
    """
    fine = failures.select("id", F.col("domain").cast("string").alias("domain"), "at", "fingerprint", F.col("vector").cast("array<double>").alias("unit"))

    def units(batches):
        for b in batches:
            x = pa.array([None if (u := _unit(v)) is None else u.tolist() for v in b.column("unit").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], x], names=b.schema.names)

    fine = dealt(fine, failures.count(), "id", task_rows=TASK_ROWS)
    left, done = written(fine.mapInArrow(units, StructType([*fine.schema.fields[:-1], StructField("unit", ArrayType(DoubleType()))])), "open"), None
    while True:
        head = left.orderBy("at", "id").limit(ROUND).select("id", "domain", "fingerprint", "unit").toArrow()  # ROUND rows
        if not head.num_rows:
            return left.select("id", "domain", "at", F.col("id").alias("leader")) if done is None else done
        leaders, ids = _leaders(head.column("id").to_pylist(), _rows(head), near)

        def join(batches, leaders=leaders, ids=ids):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([ids[i] if i >= 0 else None for i in leaders.first(_rows(b))], pa.int64())], names=[*b.schema.names, "leader"])

        met = written(left.mapInArrow(join, StructType([*left.schema.fields, StructField("leader", LongType())])), "met")
        now = met.where("leader IS NOT NULL").select("id", "domain", "at", "leader")
        done = now if done is None else done.unionByName(now)
        left = met.where("leader IS NULL").drop("leader")


def candidates(clusters: DataFrame, least: int = LEAST, evidence: int = EVIDENCE) -> DataFrame:
    """``domain``, ``leader``, ``n`` and ``evidence`` (the newest ids, in order) of clusters with ``least`` rows or more."""
    sizes = clusters.groupBy("domain", "leader").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    newest = F.row_number().over(Window.partitionBy("domain", "leader").orderBy(F.desc("at"), F.desc("id")))
    some = clusters.withColumn("place", newest).where(F.col("place") <= evidence).groupBy("leader").agg(F.sort_array(F.collect_list("id")).alias("evidence"))
    return sizes.join(some, "leader").select("domain", "leader", "n", "evidence")


@query("lesson_leaders")
def lesson_leaders(spark, sf_dir):
    """Embeddings as failures in the order of their ids, two domains, a cosine of 0.5; every seventh has no vector and is met by its label."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("id"), (F.col("label") % 2).cast("string").alias("domain"), F.timestamp_seconds("vec_id").alias("at"), F.concat(F.lit("label "), "label").alias("fingerprint"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vector"))
    return candidates(leader_clusters(rows, near=0.5))
