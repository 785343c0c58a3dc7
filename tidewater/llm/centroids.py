"""k-means on whole-number vectors, each assigned by annulus search.

Centroids are sorted by norm. A vector at distance u from some centroid can only have its nearest one among those whose
norms differ from its own by u at most (triangle inequality): two binary searches find this annulus, and its centroids
are compared exactly, in whole numbers, those on the rim included. In the first round u comes from the centroid next
in norm; the number found then is stored with the vector, and that centroid gives u in all later rounds.

The vectors are written once in whole numbers. A round is one pass over them: tasks sum up by centroid, the sums (at most
k times the dimension) are added up by Spark, and the new centroids go out with the next round's tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise
from .integers import matrix, products, usable, whole

CLUSTERS, ROUNDS, DIMENSION = 40, 5, 64
#: Centroids of neighbouring norms that are compared in one step.
_STEP = 8
_LONGS = pa.list_(pa.int64())


class Annulus:
    def __init__(self, centroids: np.ndarray):
        """``centroids``: a row for each, numbered from 0."""
        self.centroids = centroids
        self.squares = np.einsum("ij,ij->i", centroids, centroids)
        self.order = np.argsort(self.squares, kind="stable")
        self.norms = np.sqrt(self.squares[self.order].astype(np.float64))

    def nearest(self, x: np.ndarray, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest centroid of each row, ties to the smaller number.

        ``guess``: a centroid for each row, whose distance bounds the search.
        """
        squares = np.einsum("ij,ij->i", x, x)
        norm = np.sqrt(squares.astype(np.float64))
        if guess is None:
            guess = self.order[np.minimum(np.searchsorted(self.norms, norm), len(self.norms) - 1)]
        number = guess.astype(np.int64)
        best = squares + self.squares[guess] - 2 * self._with_own(x, guess)
        bound = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (1 + norm + bound)  # far above what rounding can do to the norms: the rim stays in
        low = np.searchsorted(self.norms, norm - bound - slack, side="left")
        high = np.searchsorted(self.norms, norm + bound + slack, side="right")
        for first in range(0, len(self.order), _STEP):
            some = self.order[first : first + _STEP]
            rows = np.flatnonzero((low < first + len(some)) & (high > first))
            if not len(rows):
                continue
            d = squares[rows, None] + self.squares[some] - 2 * products(x[rows] if len(rows) < len(x) else x, self.centroids[some])
            for j, c in enumerate(some):
                inside = (low[rows] <= first + j) & (first + j < high[rows])
                better = inside & ((d[:, j] < best[rows]) | ((d[:, j] == best[rows]) & (c < number[rows])))
                best[rows[better]], number[rows[better]] = d[better, j], c
        return number, best

    def _with_own(self, x: np.ndarray, guess: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", x, self.centroids[guess])


def _assigned(rows: DataFrame, centroids: np.ndarray, dimension: int, id_type: str) -> DataFrame:
    """``id``, ``x``, ``cluster``, ``distance``; a column ``guess`` is used where there is one."""
    known = "guess" in rows.columns

    def run(batches):
        search = Annulus(centroids)
        for b in batches:
            x = matrix(b.column("x"), dimension)
            number, distance = search.nearest(x, b.column("guess").to_numpy().astype(np.int64) if known else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["id", "x", "cluster", "distance"])

    return rows.mapInArrow(run, f"id {id_type}, x array<long>, cluster int, distance long")


def _sums(state: DataFrame, centroids: np.ndarray, dimension: int) -> DataFrame:
    """One row for each task, centroid and place: the sum of the components there; at place ``dimension`` the vectors."""

    def run(batches):
        search, total = Annulus(centroids), np.zeros((len(centroids), dimension + 1), np.int64)
        for b in batches:
            x = matrix(b.column("x"), dimension)
            number, _ = search.nearest(x, b.column("guess").to_numpy().astype(np.int64))
            by = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[by]) > 0]) if len(by) else by
            total[number[by[first]], :dimension] += np.add.reduceat(x[by], first, axis=0) if len(by) else 0
            total[:, dimension] += np.bincount(number, minlength=len(centroids))
        some = np.flatnonzero(total[:, dimension])
        cluster, place = np.repeat(some, dimension + 1), np.tile(np.arange(dimension + 1), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(total[some].ravel())], names=["cluster", "place", "total"])

    return state.mapInArrow(run, "cluster int, place int, total long")


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, salt: str = "2:") -> DataFrame:
    """``id``, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid`` for each vector that takes part.

    Vectors that are null, hold a null or non-finite component or have another length than ``dimension`` take no part and
    have no row. Components become floor(256 x), held within 2^25. The first centroids are the vectors with the smallest
    SHA-256 of ``salt`` and id (a null id counts as the empty text; of equal ids the smaller vector comes first); where
    there are fewer than ``k``, each is one. Repeated rows count each. An empty table gives no rows. Other columns are not
    looked at. An inertia beyond a long is the largest long.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    rows = rows.where(usable(F.col("v")) & (F.size("v") == dimension)).select("id", whole(F.col("v")).alias("x"))
    id_type = rows.schema["id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    seeds = rows.orderBy(key, "x").limit(k).select("x").collect()  # k vectors
    if not seeds:
        return spark.createDataFrame([], f"id {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>")
    centroids = np.array([r.x for r in seeds], dtype=np.int64)
    first = _assigned(rows, centroids, dimension, id_type)
    state = materialise(first.select("id", "x", F.col("cluster").alias("guess")), "clusters")
    for _ in range(rounds):
        total = _sums(state, centroids, dimension).groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        found = {(r.cluster, r.place): int(r.total) for r in total.collect()}  # k times (dimension + 1) numbers
        centroids = centroids.copy()
        for c in range(len(centroids)):
            if (n := found.get((c, dimension), 0)) > 0:
                centroids[c] = [found[c, j] // n for j in range(dimension)]
    last = materialise(_assigned(state, centroids, dimension, id_type).drop("x"), "clusters")
    discard(state)
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = {r.cluster: int(r.total) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).select("cluster", F.least("total", most).alias("total")).collect()}
    whole_inertia = min(sum(sums.values()), (1 << 63) - 1)
    told = spark.createDataFrame([(c, sums.get(c, 0), whole_inertia, [int(v) for v in centroids[c]]) for c in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return last.join(F.broadcast(told), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")  # told: k rows
