"""Exact dedup: binary-fuse filters over an immutable snapshot screen the digests of a new batch.

Texts are equal when their UTF-8 bytes are, after lower-casing A-Z only. Digests are computed once per row.
The snapshot's distinct digests are dealt to buckets of about ``BUCKET_KEYS`` keys, and each bucket gets a static
three-wise binary-fuse filter of 8-bit fingerprints. The new batch is first grouped by digest on its own, so that a text
which holds a third of the batch is one row from there on. Digests that the filter of their bucket rejects are new for
certain; the others join the snapshot's exact bucket, where the whole digest, the byte length and a second, independent
128-bit digest must agree, and the bytes of a text from either side are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, scratch_path, union_all

#: Snapshot keys in a bucket, on average: one filter is built from that many in one task.
BUCKET_KEYS = 50_000
#: Up to so many digests (5 MB of filter) are broadcast to screen texts for the comparison of bytes.
BROADCAST_KEYS = 1 << 22
_KEY = ["digest", "n_bytes", "second"]


# ---------------------------------------------------------------- binary-fuse filter
def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _slots(h: np.ndarray, segment: int, count: int) -> np.ndarray:
    """Three slots in three consecutive segments for each hash."""
    first = ((h >> np.uint64(32)) * np.uint64(segment * count)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(255)).astype(np.uint8)


def build_fuse_filter(keys: np.ndarray) -> bytes:
    """A filter without false negatives over 64-bit keys; repeated keys count once. About 1.15 bytes a key.

    Keys with a slot of their own are peeled off in rounds, all of a round at once; slots are then filled in the
    opposite order. A seed whose keys do not peel off entirely is replaced by the next one.
    """
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = len(keys)
    segment = 1 << int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))
    count = max(1, -(-int(round(n * factor)) // segment) - 2)
    size = (count + 2) * segment
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 % 2**64)
        at = _slots(h, segment, count)
        flat, index = at.ravel(), np.tile(np.arange(n, dtype=np.int64), 3)
        degree = np.bincount(flat, minlength=size)
        total = np.bincount(flat, weights=index, minlength=size).astype(np.int64)
        rounds, left = [], n
        while left:
            alone = np.flatnonzero(degree == 1)
            if not len(alone):
                break
            who, first = np.unique(total[alone], return_index=True)
            rounds.append((who, alone[first]))
            gone = at[:, who].ravel()
            degree -= np.bincount(gone, minlength=size)
            total -= np.bincount(gone, weights=np.tile(who, 3), minlength=size).astype(np.int64)
            left -= len(who)
        if left:
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for who, slot in reversed(rounds):
            a, b, c = at[:, who]
            table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c] ^ table[slot]
        return np.array([seed, segment, count], dtype=np.int64).tobytes() + table.tobytes()
    raise RuntimeError("no seed gave a filter")


def probe_fuse_filter(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    """True for each key that may be in the filter; false means that it is not."""
    seed, segment, count = np.frombuffer(filter_bytes[:24], dtype=np.int64).tolist()
    table = np.frombuffer(filter_bytes, dtype=np.uint8, offset=24)
    h = _mix(np.asarray(keys).astype(np.uint64), seed * 0x9E3779B97F4A7C15 % 2**64)
    a, b, c = _slots(h, segment, count)
    return (table[a] ^ table[b] ^ table[c]) == _prints(h)


# ---------------------------------------------------------------- Spark side
def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``digest`` (SHA-256), ``n_bytes``, ``second`` (XXH3-128) of each row's normalised text; null is empty."""

    def run(batches):
        for batch in batches:
            shas, sizes, seconds = [], [], []
            for text in batch.column(1):
                data = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower()
                shas.append(hashlib.sha256(data).digest())
                sizes.append(len(data))
                seconds.append(xxhash.xxh3_128_digest(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.binary()), pa.array(sizes, pa.int64()), pa.array(seconds, pa.binary())], ["id", *_KEY])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, "id long, digest binary, n_bytes long, second binary")


def with_digest(docs: DataFrame, name: str, text_column: str = "text") -> DataFrame:
    """``docs`` with the SHA-256 of each row's normalised text as column ``name``; only texts leave the engine."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([hashlib.sha256((t.as_buffer().to_pybytes() if t.is_valid else b"").lower()).digest() for t in texts], pa.binary())

    return docs.withColumn(name, F.arrow_udf(run, "binary")(F.col(text_column).cast("string")))


def _grouped(rows: DataFrame) -> DataFrame:
    """A row for each text: its key, number of rows, largest id and the number of rows with that id."""
    return (
        rows.groupBy(*_KEY, "id").agg(F.count("*").alias("n"))
        .groupBy(*_KEY).agg(F.sum("n").alias("group_size"), F.max(F.struct("id", "n")).alias("top"))
        .select(*_KEY, "group_size", F.col("top.id").alias("keep_id"), F.col("top.n").alias("keep_rows"))
    )


def _key64():
    """The first eight bytes of the digest as a long."""
    half = lambda a: F.conv(F.hex(F.substring("digest", a, 4)), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(5))


class Snapshot:
    """Texts seen so far, under ``root`` and never changed: a row for each text, and a filter for each bucket of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.groups = spark.read.parquet(f"{root}/groups")
        self.filters = spark.read.schema("bucket long, filter binary, buckets int").parquet(f"{root}/filters")
        self.buckets = self.filters.agg(F.max("buckets")).first()[0] or 1

    @classmethod
    def write(cls, rows: DataFrame, root: str) -> Snapshot:
        """The snapshot of ``rows`` (of ``digests``)."""
        _grouped(rows).write.parquet(f"{root}/groups")
        groups = rows.sparkSession.read.parquet(f"{root}/groups")
        buckets = 1 << max(0, int(np.ceil(np.log2(max(1, groups.count()) / BUCKET_KEYS))))

        def build(key, table):
            return pa.table({"bucket": [key[0].as_py()], "filter": pa.array([build_fuse_filter(table.column("key64").to_numpy())], pa.binary()), "buckets": pa.array([buckets], pa.int32())})

        dealt = groups.select(_key64().alias("key64")).withColumn("bucket", F.pmod("key64", F.lit(buckets)))
        dealt.groupBy("bucket").applyInArrow(build, "bucket long, filter binary, buckets int").write.parquet(f"{root}/filters")
        return cls(rows.sparkSession, root)


def screen(batch: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The batch's groups with ``maybe``: false where the snapshot certainly lacks the digest.

    A filter is handed out several times where the batch has many keys for each bucket of the snapshot.
    """
    parts = int(max(1, -(-batch.count() // (snapshot.buckets * BUCKET_KEYS))))
    rows = batch.withColumn("key64", _key64()).withColumns({"bucket": F.pmod("key64", F.lit(snapshot.buckets)), "part": F.pmod(F.xxhash64("key64"), F.lit(parts))})
    filters = snapshot.filters.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "filter")

    def probe(left, right):
        maybe = np.zeros(left.num_rows, bool)
        if right.num_rows and left.num_rows:
            maybe = probe_fuse_filter(right.column("filter")[0].as_py(), left.column("key64").to_numpy())
        return left.drop(["key64", "bucket", "part"]).append_column("maybe", pa.array(maybe))

    return rows.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInArrow(probe, batch.schema.add("maybe", "boolean"))


def differing_bytes(rows: DataFrame) -> DataFrame:
    """The digests under which rows (``digest``, ``data``) hold different bytes."""
    return rows.groupBy("digest").agg(F.min("data").alias("least"), F.max("data").alias("most")).where("least <> most").select("digest")


def check_bytes(docs: DataFrame, pairs: DataFrame, id_column: str, text_column: str) -> None:
    """Compare the normalised bytes of the two rows that ``pairs`` (``digest``, ``keep_id``, ``old_id``) names for each digest.

    Raises ``ValueError`` should two texts agree in both digests and in length but not in their bytes. Up to
    ``BROADCAST_KEYS`` digests, a filter over them keeps all other texts from being shuffled; beyond, the join does it alone.
    """
    wanted = materialise(pairs.select("digest", F.explode(F.array("keep_id", "old_id")).alias("of")).distinct(), "wanted")
    screening = None
    n = wanted.count()
    if not n:
        return
    if n <= BROADCAST_KEYS:
        one = wanted.select(_key64().alias("key64")).groupBy().applyInArrow(lambda t: pa.table({"filter": pa.array([build_fuse_filter(t.column("key64").to_numpy())], pa.binary())}), "filter binary")
        screening = docs.sparkSession.sparkContext.broadcast(bytes(one.first()[0]))
    kind = pa.struct([("digest", pa.binary()), ("data", pa.binary())])

    def run(texts: pa.Array) -> pa.Array:
        data = [(t.as_buffer().to_pybytes() if t.is_valid else b"").lower() for t in texts]
        shas = [hashlib.sha256(d).digest() for d in data]
        if screening is not None and shas:
            keys = np.frombuffer(b"".join([x[:8] for x in shas]), dtype=">i8").astype(np.int64)
            kept = probe_fuse_filter(screening.value, keys).tolist()
            shas, data = [x if k else None for x, k in zip(shas, kept, strict=True)], [x if k else None for x, k in zip(data, kept, strict=True)]
        return pa.StructArray.from_arrays([pa.array(shas, pa.binary()), pa.array(data, pa.binary())], fields=list(kind))

    found = F.arrow_udf(run, "digest binary, data binary").asNondeterministic()(F.col(text_column).cast("string"))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), found.alias("found")).where("found.digest IS NOT NULL").select("id", "found.*")
    both = rows.join(wanted, (rows["digest"] == wanted["digest"]) & rows["id"].eqNullSafe(wanted["of"]), "left_semi")
    if differing_bytes(both).limit(1).count():
        raise ValueError("two texts share their digests and length, but not their bytes")


def exact_groups(docs: DataFrame, rows: DataFrame, in_snapshot, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of equal texts over a snapshot and the batch that follows it; ``in_snapshot`` is a condition on ``rows``."""
    snapshot = Snapshot.write(rows.where(in_snapshot), scratch_path(docs.sparkSession, "snapshot"))
    batch = materialise(_grouped(rows.where(~in_snapshot)), "batch")
    screened = materialise(screen(batch, snapshot), "screened")
    fresh = screened.where("not maybe").drop("maybe")
    old = snapshot.groups.select(*_KEY, F.col("group_size").alias("old_size"), F.col("keep_id").alias("old_id"), F.col("keep_rows").alias("old_rows"))
    hit = materialise(screened.where("maybe").join(old, _KEY, "left"), "hit")
    check_bytes(docs, hit.where("old_size IS NOT NULL"), id_column, text_column)
    # nulls are smaller than any id here, as they are for max()
    newer = F.col("old_size").isNull() | F.coalesce(F.col("keep_id") > F.col("old_id"), F.col("keep_id").isNotNull() & F.col("old_id").isNull())
    same = F.col("old_size").isNotNull() & F.col("keep_id").eqNullSafe(F.col("old_id"))
    met = hit.select(
        *_KEY, (F.col("group_size") + F.coalesce("old_size", F.lit(0))).alias("group_size"),
        F.when(newer, F.col("keep_id")).otherwise(F.col("old_id")).alias("keep_id"),
        F.when(same, F.col("keep_rows") + F.col("old_rows")).when(newer, F.col("keep_rows")).otherwise(F.col("old_rows")).alias("keep_rows"),
    )
    rest = snapshot.groups.join(hit.select(*_KEY), _KEY, "left_anti")
    return union_all([fresh, met, rest.select(fresh.columns)])


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", snapshot_share: float = 0.75) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``keep_rows``, ``group_size``, ``kept``, ``digest``.

    Null and empty texts are equal. Null ids are smaller than any other; a group of null ids alone keeps null. Rows
    that repeat both id and text are one document: all of them have ``kept`` true, and ``keep_rows`` says how many they
    are. An empty table gives an empty result. Other columns are not read, so that their names cannot clash.
    ``snapshot_share`` of the ids (by hash) count as the snapshot, the rest as the batch that arrives; the result does
    not depend on it.
    """
    rows = materialise(digests(docs, id_column, text_column), "digests")
    in_snapshot = F.pmod(F.xxhash64("id"), F.lit(1000)) < int(1000 * snapshot_share)
    groups = exact_groups(docs, rows, in_snapshot, id_column, text_column)
    return rows.join(groups, _KEY).select("id", "keep_id", "keep_rows", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")
