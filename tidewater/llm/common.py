"""Helpers shared by the operators of this folder: shared scratch space, Arrow text access, graph components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_REGEX = r"[^\x20\x09-\x0D]+"

#: Maps each byte to itself, A-Z to a-z; applied to UTF-8 it lower-cases ASCII letters only.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_own_scratch: list[str] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset (tests, one machine) a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_scratch:
        keep = tempfile.TemporaryDirectory(prefix="tidewater-")
        atexit.register(keep.cleanup)
        _own_scratch.append(keep.name)
    return f"file://{_own_scratch[0]}"


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/tidewater/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by ``materialise`` that nothing will read again."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fold_remainder(id_column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_column).cast("string"), F.lit("")), "UTF-8")) % modulus


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and n+1 offsets; nulls count as empty. No copy is made."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if data is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values[offsets[i]:offsets[i+1]]`` in double; empty segments give 0."""
    out = np.zeros(len(offsets) - 1, dtype=np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], dtype=np.float64)
    return out


def slices(offsets: np.ndarray, limit: int = 4_000_000):
    """Ranges of consecutive texts with about ``limit`` bytes at most each (one longer text stands alone)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of an edge table of longs.

    Each round takes the smallest label among neighbours, then the label of that label, so that a
    chain of n nodes ends in about log2(n) rounds. Rounds are written to the shared folder; nothing but
    the number of changed labels comes to the driver. Loops and repeated edges are harmless.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b")
    both = materialise(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("parent"), F.col("component").alias("top"))
        step = step.join(up, step.component == up.parent, "left").select("node", "was", F.coalesce(F.least("component", "top"), "component").alias("component"))
        step = materialise(step, "labels")
        changed = step.where("was <> component").limit(1).count()
        discard(labels)
        labels = step.select("node", "component")
        if not changed:
            discard(both)
            return labels
