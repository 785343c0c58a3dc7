"""Exact top-k by inner product over an impact-ordered index, a score at a time.

Vectors are whole numbers. The table is cut into blocks of at most ``BLOCK`` rows, and each block has an index of its own:
for every dimension its rows by component, cut into segments of nearly equal components. A query that has a positive
number in a dimension meets the segments from the largest component down, one with a negative number from the smallest
up, so that a segment's contribution over the least one possible is its impact: 0 or more.

All segments of all dimensions are processed by descending impact. Rows add up what is certain; what they can still gain
is bounded by the impacts of the next segments, and by how far components of one segment differ. Once no more than a few
rows can still be among the best k, which is a proof that the others cannot, these are rescored exactly from the vectors.
Without such a proof the index is processed to its end, and the rows that can still be among the best are rescored.

Index blocks are written to the shared folder. Queries are dealt to waves of about ``WAVE``; a task has one block and one
wave, and gives at most k rows for each of its queries, so no two tables are crossed row by row, and memory is bounded.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .integers import matrix, products, usable, whole

K = 5
#: Rows of a block (fewer if vectors are longer than 64), segments of a dimension, queries of a wave.
BLOCK, SEGMENTS, WAVE = 16_384, 64, 512
CELLS = BLOCK * 64
MOST_TASKS = 20_000
#: Times at which a proof is looked for, and rows that are rescored rather than bounded any further.
CHECKS, FEW = 12, 64


class Index:
    """The impact-ordered index of a block of vectors (a row each)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, d = x.shape
        low, high = x.min(axis=0), x.max(axis=0)
        level = (x - low) * SEGMENTS // (high - low + 1)
        self.rows = np.argsort(x, axis=0, kind="stable").T.astype(np.uint16 if n <= 1 << 16 else np.uint32)  # ascending, by dimension
        sizes = np.zeros((d, SEGMENTS), np.int64)
        np.add.at(sizes, (np.arange(d)[None, :].repeat(n, 0), level), 1)
        dim, part = np.nonzero(sizes)
        end = np.cumsum(sizes, axis=1)[dim, part]
        begin = end - sizes[dim, part]
        self.dim, self.begin, self.end = dim, begin, end
        self.least, self.most = x[self.rows[dim, begin], dim], x[self.rows[dim, end - 1], dim]
        self.low, self.high = low, high

    def best(self, q: np.ndarray, k: int, own: np.ndarray) -> np.ndarray:
        """Rows other than ``own`` that hold every one of the best k by inner product with ``q``, ties with the k-th too."""
        n = len(self.x)
        free = np.ones(n, bool)
        free[own] = False
        if n - len(own) <= max(k, FEW) or float(np.abs(q).sum()) * float(np.abs(self.x).max(initial=0)) * 4 >= 2.0**53:
            return np.flatnonzero(free)  # few rows, or sums that doubles do not hold
        size = np.abs(q)[self.dim].astype(np.float64)
        up = q[self.dim] > 0
        certain = np.where(up, self.least - self.low[self.dim], self.high[self.dim] - self.most) * size
        impact = np.where(up, self.most - self.low[self.dim], self.high[self.dim] - self.least) * size
        some = np.flatnonzero(size > 0)
        if not len(some):
            return np.flatnonzero(free)
        # descending impact; a dimension's own segments stay in their order
        some = some[np.lexsort((np.where(up[some], -self.begin[some], self.begin[some]), -impact[some]))]
        dim, impact, certain = self.dim[some], impact[some], certain[some]
        # what a row can gain in dimensions where it has not been met: the next segment's impact in each
        by = np.argsort(dim, kind="stable")
        after = np.zeros(len(some))
        same = dim[by[1:]] == dim[by[:-1]]
        after[by[:-1][same]] = impact[by[1:][same]]
        first = np.r_[True, ~same]
        gain = impact[by][first].sum() - np.cumsum(impact - after)
        spread = np.maximum.reduceat((impact - certain)[by], np.flatnonzero(first)).sum()
        score = np.zeros(n)
        score[own] = -np.inf
        begin, end = self.begin[some].tolist(), self.end[some].tolist()
        amount, dims, rows = self.end[some] - self.begin[some], dim.tolist(), self.rows
        step = -(-len(some) // CHECKS)
        possible = np.flatnonzero(free)
        for at in range(0, len(some), step):
            to = min(at + step, len(some))
            met = np.concatenate([rows[dims[i], begin[i] : end[i]] for i in range(at, to)])
            score += np.bincount(met, weights=np.repeat(certain[at:to], amount[at:to]), minlength=n)
            left = gain[to - 1] + spread
            if left < score.max() or to == len(some):
                limit = np.partition(score, n - k)[n - k] - left
                possible = np.flatnonzero((score >= limit) & free)
                if len(possible) <= FEW:
                    break
        return possible


def top_of_block(index: Index, ids: np.ndarray, nulls: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """For each query (place, rows, scores) of its best k rows, by score, then id, null ids last."""
    for i, q in enumerate(queries):
        rows = index.best(q, k, np.flatnonzero((ids == query_ids[i]) & ~nulls))
        score = products(index.x[rows], q[None, :])[:, 0]
        if len(rows) > k:
            keep = np.lexsort((ids[rows], nulls[rows], -score))[:k]
            rows, score = rows[keep], score[keep]
        yield i, rows, score


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """A row for each block: ids, which of them are null, vectors."""
    most = max(1, min(BLOCK, CELLS // max(width, 1)))

    def run(batches):
        held, count = [], 0

        def block():
            ids = pa.concat_arrays([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (ids.fill_null(0).to_numpy().tobytes(), np.packbits(nulls).tobytes(), x.astype(np.int32).tobytes())] + [pa.array([len(x)], pa.int32())], names=["ids", "nulls", "x", "n"])

        for b in batches:
            for first in range(0, b.num_rows, most):
                part = b.slice(first, most)
                if count and count + part.num_rows > most:
                    yield block()
                    held, count = [], 0
                held.append((part.column("id"), matrix(part.column("x"), width)))
                count += part.num_rows
        if count:
            yield block()

    return rows.mapInArrow(run, "ids binary, nulls binary, x binary, n int")


def top_k(vectors: DataFrame, every: int, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best k by inner product for each row whose id ``every`` divides.

    Components become floor(256 x), held within 2^25. All rows but those of the query's own id are candidates; equal scores
    go by the smaller id, a null id comes last. Vectors that are null or hold a null or non-finite component take no part;
    a shorter vector counts as filled up with zeros. Repeated rows are candidates each; a query that is repeated with the
    same vector is one query, with another vector each has its own list. Fewer candidates than k give all of them; an
    empty table, or no query, gives no rows. Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where(usable(F.col("v"))).select("id", whole(F.col("v")).alias("x"))
    width = rows.agg(F.max(F.size("x"))).head()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index = materialise(_blocks(rows, width).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = materialise(rows.where(F.col("id") % every == 0).distinct(), "asked")
    waves = max(1, math.ceil(asked.count() / WAVE))
    wave = F.pmod(F.xxhash64("id", "x"), F.lit(waves)).cast("int")
    buckets = max(1, index.count())  # of blocks: one each on average, a dozen at most
    dealt = asked.select("id", "x", F.xxhash64("x").alias("tag"), wave.alias("wave"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    copies = index.select("*", F.pmod(F.xxhash64("block"), F.lit(buckets)).cast("int").alias("bucket"), F.explode(F.sequence(F.lit(0), F.lit(waves - 1))).alias("wave"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        query_ids, tag = (right.column(c).combine_chunks().to_numpy() for c in ("id", "tag"))
        queries = matrix(right.column("x").combine_chunks(), width)
        for block in left.to_pylist() if len(queries) else []:
            n = block["n"]
            ids = np.frombuffer(block["ids"], np.int64)
            nulls = np.unpackbits(np.frombuffer(block["nulls"], np.uint8), count=n).astype(bool)
            x = np.frombuffer(block["x"], np.int32).reshape(n, width).astype(np.int64)
            for i, found, score in top_of_block(Index(x), ids, nulls, queries, query_ids, k):
                out.append(np.stack([np.full(len(found), query_ids[i]), np.full(len(found), tag[i]), ids[found], nulls[found], score]))
        told = np.concatenate(out, axis=1) if out else np.zeros((5, 0), np.int64)
        return pa.table({"query_id": told[0], "tag": told[1], "vec_id": pa.array(told[2], mask=told[3].astype(bool)), "score": told[4]})

    # a task for each bucket and wave: small inputs are dear here, so that they are not put together by their size
    tasks = min(4 * buckets * waves, MOST_TASKS)  # few of them get two by chance
    copies, dealt = (df.repartition(tasks, "bucket", "wave") for df in (copies, dealt))
    found = copies.groupBy("bucket", "wave").cogroup(dealt.groupBy("bucket", "wave")).applyInArrow(run, "query_id long, tag long, vec_id long, score long")
    found = materialise(found, "found")
    discard(index)
    discard(asked)
    place = F.row_number().over(Window.partitionBy("query_id", "tag").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
