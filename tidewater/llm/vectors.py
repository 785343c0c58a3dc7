"""Embedding near-dedup on a flat graph with robust pruning.

1. Equal vectors become one node. Nodes of one length are dealt to overlapping shards: each goes to the nearest centres
   of a small k-means, and shards that are too large are dealt again by centres of their own. A node gets ``OVERLAP``
   copies in all, however many levels there are. Centres travel as rows ahead of the rows they deal.
2. In each shard a node's nearest nodes and some random ones are pruned: a candidate goes if a kept neighbour is nearer
   to it, by the factor ``ALPHA``, than the node itself. Edges are made mutual.
3. A node's lists from all its shards are united, and each shard is searched with them: from the shard's medoid greedily
   towards each node until something within the range is met, then outwards through all that is within the range.
4. Every pair that comes out is verified in double precision. A pair that shares several shards counts in the first of
   them. A shard gives a sum for each node and one edge for each node, never all pairs.
5. A dense bunch, most of whose pairs are links or which k-means cannot cut, is one shard and compared as a whole: by pairs
   of its blocks, each in a task.
6. The recall is audited against a full scan for a bounded set of nodes, half of them nodes known to have links because
   signs of random projections brought them together with another; below ``LEAST_RECALL`` the overlap grows, and if that
   does not help all vectors are compared, block by block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialise, scratch_path

COSINE = 0.95
#: Range within which the search goes on, so that a pair below the limit can still lead to one above.
REACH = 0.90
OVERLAP = 4
SHARD = 1_500
BRANCHES = 256
SAMPLE_PER_CENTRE = 40
NEAREST, RANDOM, DEGREE = 40, 24, 24
ALPHA = 1.2
BEAM = 12
AUDIT = 200
LEAST_RECALL = 0.9
#: Rows that one set of centres deals at a time, and bytes of a block in the comparison of all vectors.
PIECE = 100_000
#: Mean cosine of all pairs from which a shard is a bunch: cutting it would part most links.
BUNCH = 0.92
#: Nodes of a block of a shard that is not cut.
DENSE_BLOCK = 8_192
SCAN_BYTES = 16 << 20
_BLOCK = 256


# ---------------------------------------------------------------- numpy side
def unpack(column) -> np.ndarray:
    """Rows of a binary column of float32 as doubles."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, "<f4").reshape(len(column), -1).astype(np.float64)


def by_length(column):
    """Rows of a binary column by their length: arrays of places, and unit vectors."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for length in np.unique(size):
        at = np.flatnonzero(size == length)
        yield int(length), at, units(unpack(column.take(pa.array(at))))


def units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def centres_of(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centres (of length 1) of a spherical k-means from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1)
        c = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], c)
    return c


def prune(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the robust-pruned graph of unit vectors, both directions."""
    n = len(x)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rng, k = np.random.default_rng(seed), min(NEAREST, n - 1)
    kept_from, kept_to = [], []
    for start in range(0, n, _BLOCK):
        rows = np.arange(start, min(start + _BLOCK, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        pool = np.concatenate([near, rng.integers(0, n, (len(rows), RANDOM))], axis=1)
        s = np.take_along_axis(sims, pool, 1)
        order = np.argsort(-s, axis=1, kind="stable")
        pool, s = np.take_along_axis(pool, order, 1), np.take_along_axis(s, order, 1)
        alive = s > -2
        distance = np.sqrt(np.maximum(2 - 2 * s, 0))
        vectors = x[pool].astype(np.float32)
        for _ in range(DEGREE):
            first = alive.argmax(axis=1)
            some = np.flatnonzero(alive[np.arange(len(rows)), first])
            if not len(some):
                break
            pick = first[some]
            kept_from.append(rows[some])
            kept_to.append(pool[some, pick])
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("ijk,ik->ij", vectors[some], vectors[some, pick]), 0))
            alive[some] &= ALPHA * between > distance[some]
            alive[some, pick] = False
    a, b = np.concatenate(kept_from), np.concatenate(kept_to)
    edges = np.unique(np.r_[a * n + b, b * n + a])
    return edges // n, edges % n


def _dots(x: np.ndarray, a: np.ndarray, b: np.ndarray, piece: int = 50_000) -> np.ndarray:
    """Products of rows ``a[i]`` and ``b[i]``, a bounded piece at a time."""
    out = np.empty(len(a), dtype=x.dtype)
    for i in range(0, len(a), piece):
        out[i : i + piece] = np.einsum("ij,ij->i", x[a[i : i + piece]], x[b[i : i + piece]])
    return out


def search(x: np.ndarray, begin: np.ndarray, to: np.ndarray, exact: np.ndarray):
    """Yields arrays (i, j) of pairs i != j with cosine >= ``COSINE``: i the query, j what its search meets.

    ``x``: unit vectors; neighbours of i are ``to[begin[i]:begin[i+1]]``; ``exact``: the vectors as they came.
    """
    n, x32 = len(x), x.astype(np.float32)
    lengths = np.sqrt(np.einsum("ij,ij->i", exact, exact))
    medoid = int((x @ x.mean(axis=0)).argmax())
    degree = int(np.diff(begin).max(initial=0))
    if not degree:
        return
    lists = np.full((n, degree), -1, dtype=np.int64)
    at = np.arange(len(to)) - np.repeat(begin[:-1], np.diff(begin))
    lists[np.repeat(np.arange(n), np.diff(begin)), at] = to
    for start in range(0, n, _BLOCK):
        query = np.arange(start, min(start + _BLOCK, n))
        q = len(query)
        seen = np.zeros((q, n), bool)
        seen[:, medoid] = True
        beam = np.full((q, BEAM), -1, dtype=np.int64)
        score = np.full((q, BEAM), -2.0, dtype=np.float32)
        beam[:, 0], score[:, 0] = medoid, x32[query] @ x32[medoid]
        done = np.zeros((q, BEAM), bool)
        active = np.arange(q)
        while len(active):
            # ends for a query when it has met its range, or has opened all of its beam
            open_score = np.where(done[active] | (beam[active] < 0), -3.0, score[active])
            best = open_score.argmax(axis=1)
            go = (open_score[np.arange(len(active)), best] > -3) & (score[active].max(axis=1) < COSINE)
            active, best = active[go], best[go]
            if not len(active):
                break
            done[active, best] = True
            near = lists[beam[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            row, col = np.nonzero(fresh)
            met = near[row, col]
            seen[active[row], met] = True
            value = np.full(near.shape, -2.0, dtype=np.float32)
            value[row, col] = _dots(x32, query[active[row]], met)
            all_ids = np.concatenate([beam[active], np.where(fresh, near, -1)], axis=1)
            all_scores = np.concatenate([score[active], value], axis=1)
            all_done = np.concatenate([done[active], np.zeros(near.shape, bool)], axis=1)
            top = np.argpartition(-all_scores, BEAM - 1, axis=1)[:, :BEAM]
            beam[active] = np.take_along_axis(all_ids, top, 1)
            score[active] = np.take_along_axis(all_scores, top, 1)
            done[active] = np.take_along_axis(all_done, top, 1)
        # outwards from what was met within the range, and from the query's own place in the graph
        within = np.zeros((q, n), bool)
        row, col = np.nonzero(score >= REACH)
        within[row, beam[row, col]] = True
        within[np.arange(q), query] = True
        row, node = np.nonzero(within)
        tried = within.copy()
        while len(row):
            grown_row, grown = [], []
            step = max(1, 500_000 // degree)  # a hub has many neighbours
            for i in range(0, len(row), step):
                near = lists[node[i : i + step]]
                r = np.repeat(row[i : i + step], degree)[near.ravel() >= 0]
                c = near.ravel()[near.ravel() >= 0]
                new = ~tried[r, c]
                pairs = np.unique(r[new] * n + c[new])
                r, c = pairs // n, pairs % n
                tried[r, c] = True
                good = _dots(x32, query[r], c) >= REACH
                grown_row.append(r[good])
                grown.append(c[good])
            row, node = np.concatenate(grown_row), np.concatenate(grown)
            within[row, node] = True
        row, node = np.nonzero(within)
        for i in range(0, len(row), 100_000):
            a, b = query[row[i : i + 100_000]], node[i : i + 100_000]
            cosine = _dots(exact, a, b) / (lengths[a] * lengths[b])
            good = (cosine >= COSINE) & (a != b)
            yield a[good], b[good]


# ---------------------------------------------------------------- Spark side
def _nodes(rows: DataFrame) -> DataFrame:
    """A row for each distinct valid vector: ``node``, ``copies``, ``data``."""
    distinct = rows.where("data IS NOT NULL").groupBy("data").agg(F.count("*").alias("copies"))
    return materialise(distinct.select(F.monotonically_increasing_id().alias("node"), "copies", "data"), "nodes")


def _valid(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``data``: the vector as float32 bytes, null unless it is non-zero and finite throughout."""

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            at = np.r_[0, np.cumsum(size)]
            flat = pc.fill_null(column.flatten(), math.nan).to_numpy(zero_copy_only=False).astype("<f4")
            bad = np.r_[0, np.cumsum(~np.isfinite(flat))]
            some = np.r_[0, np.cumsum(flat != 0)]
            good = (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
            data = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * 4).astype(np.int32)), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(pa.array(good), data, None)], ["id", "data"])

    rows = vectors.select(F.col(id_column).cast("long"), F.col(vector_column).cast("array<float>")).mapInArrow(run, "id long, data binary")
    return materialise(rows, "vectors")


def _widths(n: int, overlap: int) -> list[int]:
    """Copies made at each level; their product is ``overlap``, levels after these make one copy."""
    levels = math.log(max(1, n * overlap / (2 * SHARD)), BRANCHES)
    return [overlap] if levels <= 1 else [max(1, overlap // 2), 2]


def _centres(sample: DataFrame) -> DataFrame:
    """``shard`` and the bytes of its ``centres``, from the sampled rows of each shard with their ``k``; none for a bunch, which is not cut."""

    def fit(key, table):
        x = units(unpack(table.column("data").combine_chunks()))
        mean = x.mean(axis=0)
        if mean @ mean >= BUNCH:  # the mean cosine of all pairs
            return pa.table({"shard": pa.array([], pa.string()), "centres": pa.array([], pa.binary())})
        c = centres_of(x, min(table.column("k")[0].as_py(), len(x))).astype("<f4")
        return pa.table({"shard": [key[0].as_py()], "centres": pa.array([c.tobytes()], pa.binary())})

    return sample.select("shard", "data", "k").groupBy("shard").applyInArrow(fit, "shard string, centres binary")


def _deal(nodes: DataFrame, n: int, overlap: int) -> DataFrame:
    """``nodes`` once for each shard: with ``shard`` (a text) and, in the end, ``shards`` (all of the node's).

    A name starts with the length of the vectors in bytes. ``parent`` is the size of the shard that was dealt: a shard
    that keeps over nine tenths of it, or whose sample is a bunch, is not dealt again.
    """
    dealt = nodes.select("node", "copies", "data", F.length("data").cast("string").alias("shard"), F.lit(1 << 62).alias("parent"))
    widths, level = _widths(n, overlap), 0
    while True:
        width = widths[level] if level < len(widths) else 1
        sizes = dealt.groupBy("shard").agg(F.count("*").alias("m"), F.min("parent").alias("of"))
        large = sizes.where((F.col("m") > 2 * SHARD) & (F.col("m") <= 0.9 * F.col("of"))).select(
            "shard",
            "m",
            F.least(F.lit(BRANCHES), F.greatest(F.lit(2), F.ceil(F.col("m") * width / SHARD))).cast("int").alias("k"),
            F.ceil(F.col("m") / PIECE).cast("int").alias("pieces"),
        )
        large = materialise(large, "large")
        if large.isEmpty():
            break
        joined = dealt.join(large, "shard", "left")
        drawn = F.pmod(F.xxhash64("data"), F.lit(1 << 20)) / float(1 << 20) < F.col("k") * SAMPLE_PER_CENTRE / F.col("m")
        heads = materialise(_centres(joined.where(F.col("k").isNotNull() & drawn)), "centres").join(large, "shard")
        heads = heads.select(F.lit(-1).cast("long").alias("node"), F.lit(0).cast("long").alias("copies"), F.col("centres").alias("data"), "shard", F.col("m").alias("parent"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        rows = joined.where("k IS NOT NULL").select("node", "copies", "data", "shard", F.col("m").alias("parent"), F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"))
        ordered = rows.unionByName(heads).repartition("shard", "piece").sortWithinPartitions("shard", "piece", "node").drop("piece")

        def assign(batches, width=width):
            own, centre = None, None
            for batch in batches:
                if not batch.num_rows:
                    continue
                shards = np.array(batch.column("shard").to_pylist(), dtype=object)
                head = batch.column("node").to_numpy() == -1
                starts = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | head[1:]])
                rows, to = [], []
                for first, last in zip(starts, np.r_[starts[1:], len(shards)]):
                    if head[first]:
                        own = shards[first]
                        centre = np.frombuffer(batch.column("data")[int(first)].as_py(), "<f4").reshape(-1, int(own.split(".")[0]) // 4)
                        first += 1
                    if first == last:
                        continue
                    mine = np.arange(first, last)
                    if shards[first] != own:
                        rows.append(mine)
                        to += shards[mine].tolist()
                        continue
                    x = units(unpack(batch.column("data").slice(int(first), int(last - first))))
                    m = min(width, len(centre))
                    near = np.argpartition(-(x @ centre.T), m - 1, axis=1)[:, :m]
                    rows.append(np.repeat(mine, m))
                    to += [f"{own}.{j}" for j in near.ravel()]
                if rows:
                    out = batch.take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("node", "copies", "data")), pa.array(to, pa.string()), out.column("parent")], ["node", "copies", "data", "shard", "parent"])

        made = ordered.mapInArrow(assign, dealt.schema)
        rest = joined.where("k IS NULL").select(*dealt.columns)
        after = materialise(rest.unionByName(made), "dealt")
        if level:
            discard(dealt)
        dealt, level = after, level + 1
    all_shards = dealt.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
    return materialise(dealt.drop("parent").join(all_shards, "node"), "shards")


def _graph(dealt: DataFrame) -> DataFrame:
    """``node`` and its neighbours from all its shards."""

    def build(key, table):
        x = units(unpack(table.column("data").combine_chunks()))
        node = table.column("node").to_numpy()
        order = np.argsort(node)
        a, b = prune(x[order], len(node))
        return pa.table({"node": pa.array(node[order][a]), "near": pa.array(node[order][b])})

    edges = dealt.select("shard", "node", "data").groupBy("shard").applyInArrow(build, "node long, near long")
    return edges.groupBy("node").agg(F.collect_set("near").alias("near"))


def _classes(lists: list[list[str]], shard: str) -> tuple[np.ndarray, np.ndarray]:
    """A number for each node's set of bunches, and for each two numbers whether ``shard`` is the first that both sets hold: a pair counts there alone.

    Names of bunches come before all others, so that the other shards of two nodes do not matter; sets of bunches are few.
    """
    kinds: dict[tuple[str, ...], int] = {}
    of = np.array([kinds.setdefault(tuple(s for s in v if s.startswith("!")), len(kinds)) for v in lists])
    sets = [set(k) for k in kinds]
    first = np.array([[min(a & b) == shard for b in sets] for a in sets])
    return of, first


def _dense(dealt: DataFrame) -> DataFrame:
    """What ``_search_shards`` gives, for shards that no centres could cut, by comparing all their nodes.

    A shard's nodes are dealt to blocks of about ``DENSE_BLOCK`` by a hash, and two blocks (or one with itself) are a task, so
    that a bunch of nearly equal vectors is the work of many tasks of bounded memory, however large it is.
    """
    sizes = materialise(dealt.groupBy("shard").agg(F.ceil(F.count("*") / DENSE_BLOCK).cast("int").alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = dealt.join(sizes, "shard").withColumn("block", block)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.select("shard", "node", "copies", "data", "shards", "block", other.alias("other")).select("*", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    def compare(key, table):
        shard, low, high = (k.as_py() for k in key)
        table = table.take(pa.array(np.lexsort((table.column("node").to_numpy(), table.column("block").to_numpy()))))
        node, copies, at = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        exact = unpack(table.column("data").combine_chunks())
        x, lengths = units(exact), np.sqrt(np.einsum("ij,ij->i", exact, exact))
        of, first = _classes(table.column("shards").to_pylist(), shard)
        cut = int(np.searchsorted(at, high)) if high > low else 0
        left, right = (np.arange(cut), np.arange(cut, len(node))) if high > low else (np.arange(len(node)),) * 2
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        strips, hits = [left[i : i + _BLOCK] for i in range(0, len(left), _BLOCK)], []
        for rows in strips:
            cosine = x[rows] @ x[right].T
            hit = cosine >= COSINE
            a, b = np.nonzero(np.abs(cosine - COSINE) < 1e-9)  # what rounding could turn is worked out as in the search
            hit[a, b] = _dots(exact, rows[a], right[b]) / (lengths[rows[a]] * lengths[right[b]]) >= COSINE
            hit &= rows[:, None] != right[None, :]
            counted = hit & first[of[rows][:, None], of[right][None, :]]
            links[rows] += counted @ copies[right]
            if high > low:
                links[right] += counted.T @ copies[rows]
            hits.append(np.packbits(hit, axis=1))
        changed = True
        while changed:
            before = root.copy()
            for rows, packed in zip(strips, hits, strict=True):
                hit = np.unpackbits(packed, axis=1, count=len(right)).astype(bool)
                best = np.minimum(root[rows], np.where(hit, root[right][None, :], len(node)).min(axis=1, initial=len(node)))
                root[rows] = best
                root[right] = np.minimum(root[right], np.where(hit, best[:, None], len(node)).min(axis=0, initial=len(node)))
            changed = not np.array_equal(before, root)
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(node[root])})

    return materialise(rows.groupBy("shard", "low", "high").applyInArrow(compare, "node long, links long, root long"), "dense")


def _search_shards(dealt: DataFrame, graph: DataFrame) -> DataFrame:
    """``node``, ``links`` (copies of other nodes linked, of pairs that count in the shard), ``root`` for each shard."""

    def run(key, table):
        shard = key[0].as_py()
        order = np.argsort(table.column("node").to_numpy())
        table = table.take(pa.array(order))
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        exact = unpack(table.column("data").combine_chunks())
        near = table.column("near").to_pylist()
        counts = np.array([len(v or ()) for v in near])
        flat = np.array([t for v in near for t in (v or ())], dtype=np.int64)
        owner = np.repeat(np.arange(len(node)), counts)
        at = np.minimum(np.searchsorted(node, flat), len(node) - 1)
        here = node[at] == flat
        begin = np.r_[0, np.cumsum(np.bincount(owner[here], minlength=len(node)))]
        # places of the shards that a node shares with this one: a pair counts in the first shard of both
        names = {s: i for i, s in enumerate(sorted({t for v in table.column("shards").to_pylist() for t in v}))}
        lists = [[names[s] for s in v] for v in table.column("shards").to_pylist()]
        width = max(map(len, lists))
        mine = np.array([v + [-1 - i] * (width - len(v)) for i, v in enumerate(lists)])
        this = names[shard]
        links, root = np.zeros(len(node), np.int64), np.arange(len(node))
        for a, b in search(units(exact), begin, at[here], exact):
            for i in range(0, len(a), 100_000):
                x, y = mine[a[i : i + 100_000]], mine[b[i : i + 100_000]]
                common = np.where((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0), x[:, :, None], len(names)).min(axis=(1, 2))
                first = common == this
                np.add.at(links, a[i : i + 100_000][first], copies[b[i : i + 100_000][first]])
            while True:
                p, q = root[a], root[b]
                if (p == q).all():
                    break
                np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
                while (root[root] != root).any():
                    root = root[root]
        return pa.table({"node": pa.array(node), "links": pa.array(links), "root": pa.array(node[root])})

    rows = dealt.join(graph, "node", "left").select("shard", "node", "copies", "data", "shards", "near")
    return materialise(rows.groupBy("shard").applyInArrow(run, "node long, links long, root long"), "found")


def _together(nodes: DataFrame, n: int) -> DataFrame:
    """``node``, ``data`` of nodes that have a link: vectors next to each other in order of signs of random projections.

    It shares nothing with the graph, so what it meets is a fair draw for the audit; what it misses does not matter.
    """
    bits = int(min(30, max(1, math.log2(max(2, n / 8)))))

    def sign(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows, np.int64)
            for length, at, x in by_length(batch.column("data")):
                planes = np.random.default_rng(length).normal(size=(length // 4, bits))
                out[at] = (x @ planes > 0) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("data"), pa.array(out)], ["node", "data", "signs"])

    def compare(batches):
        for batch in batches:
            signs, hit = batch.column("signs").to_numpy(), np.zeros(batch.num_rows, bool)
            for _, at, x in by_length(batch.column("data")):
                for step in range(1, min(9, len(at))):
                    good = (np.einsum("ij,ij->i", x[:-step], x[step:]) >= COSINE) & (signs[at[:-step]] == signs[at[step:]])
                    hit[at[:-step][good]] = hit[at[step:][good]] = True
            yield batch.select(["node", "data"]).filter(pa.array(hit))

    signed = nodes.select("node", "data").mapInArrow(sign, "node long, data binary, signs long")
    size = F.length("data")
    return signed.repartitionByRange(size, "signs", "node").sortWithinPartitions(size, "signs", "node").mapInArrow(compare, "node long, data binary")


def _audit(nodes: DataFrame, n: int, found: DataFrame) -> float:
    """Share of the links of at most ``2 * AUDIT`` nodes, by a scan over all nodes, that the search has found.

    Half of the nodes are drawn from those ``_together`` meets, the others from all; where none has a link it is 1.
    """
    draw = F.xxhash64("data", F.lit(1))
    chosen = {}
    for some in (_together(nodes, n), nodes.select("node", "data")):
        for r in some.orderBy(draw, "node").limit(AUDIT).collect():
            chosen[r.node] = np.frombuffer(bytes(r.data), "<f4").astype(np.float64)
    if not chosen:
        return 1.0
    queries = {}
    for length in {len(v) for v in chosen.values()}:
        ids = [i for i, v in chosen.items() if len(v) == length]
        queries[4 * length] = (np.array(ids), units(np.stack([chosen[i] for i in ids])))
    shared = nodes.sparkSession.sparkContext.broadcast(queries)

    def scan(batches):
        total = {length: np.zeros(len(own), np.int64) for length, (own, _) in shared.value.items()}
        for batch in batches:
            node, copies = batch.column("node").to_numpy(), batch.column("copies").to_numpy()
            for length, at, x in by_length(batch.column("data")):
                if length not in total:
                    continue
                own, q = shared.value[length]
                for start in range(0, len(at), 4096):
                    part = at[start : start + 4096]
                    hit = (x[start : start + 4096] @ q.T >= COSINE) & (node[part][:, None] != own[None, :])
                    total[length] += (hit * copies[part][:, None]).sum(axis=0)
        for length, (own, _) in shared.value.items():
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[length])], ["node", "links"])

    true = nodes.mapInArrow(scan, "node long, links long").groupBy("node").agg(F.sum("links").alias("true"))
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    got = true.join(sums, "node", "left").agg(F.sum("true"), F.sum(F.least(F.coalesce("links", F.lit(0)), "true"))).first()
    return got[1] / got[0] if got[0] else 1.0


def _all_blocks(nodes: DataFrame, n: int) -> DataFrame:
    """What ``_search_shards`` gives, by comparing all nodes with one bounded block after another."""
    spark = nodes.sparkSession
    longest = nodes.agg(F.max(F.length("data"))).first()[0]
    blocks = -(-n * longest // SCAN_BYTES)
    tagged = materialise(nodes.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks))), "blocks")
    folder = scratch_path(spark, "scan")
    for b in range(blocks):
        held = {}
        for r in tagged.where(F.col("block") == b).collect():
            held.setdefault(len(r.data), []).append((r.node, r.copies, bytes(r.data)))
        block = {}
        for length, rows in held.items():
            x = np.frombuffer(b"".join(r[2] for r in rows), "<f4").reshape(len(rows), -1).astype(np.float64)
            block[length] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), units(x))
        shared = spark.sparkContext.broadcast(block)

        def scan(batches, shared=shared):
            for batch in batches:
                node = batch.column("node").to_numpy()
                for length, at, x in by_length(batch.column("data")):
                    if length not in shared.value:
                        continue
                    own, copies, y = shared.value[length]
                    for start in range(0, len(at), 512):
                        mine = node[at[start : start + 512]]
                        hit = (x[start : start + 512] @ y.T >= COSINE) & (mine[:, None] != own[None, :])
                        a, c = np.nonzero(hit)
                        names = np.r_[mine, own]
                        root, left, right = names.copy(), a, c + len(mine)
                        while (root[left] != root[right]).any():
                            low = np.minimum(root[left], root[right])
                            np.minimum.at(root, left, low)
                            np.minimum.at(root, right, low)
                        links = np.r_[(hit * copies[None, :]).sum(axis=1), np.zeros(len(own), np.int64)]
                        told = np.unique(np.r_[left, right])
                        yield pa.RecordBatch.from_arrays([pa.array(names[told]), pa.array(links[told]), pa.array(root[told])], ["node", "links", "root"])

        tagged.mapInArrow(scan, "node long, links long, root long").write.mode("append").parquet(folder)
        shared.destroy()
    discard(tagged)
    return spark.read.schema("node long, links long, root long").parquet(folder)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``links``, ``component`` (smallest id reachable), ``recall`` (of the audit).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors link with those
    of their own length. Equal vectors link with each other. Rows that repeat an id count each. Null ids are larger than
    any other; a row that links with nothing has its own id as its component. An empty table gives an empty result. Other
    columns are not read.
    """
    rows = _valid(vectors, id_column, vector_column)
    nodes = _nodes(rows)
    n, overlap = nodes.count(), OVERLAP
    while True:
        dealt = _deal(nodes, n, overlap)
        bunches = materialise(dealt.groupBy("shard").agg(F.count("*").alias("m")).where(F.col("m") > 2 * SHARD).select("shard", F.lit(True).alias("dense")), "bunches")
        if bunches.isEmpty():
            found = _search_shards(dealt, _graph(dealt))
        else:
            # a pair that shares a bunch counts there, where nothing is missed: its name comes before all others
            named = dealt.drop("shards").join(bunches, "shard", "left").withColumn("shard", F.when(F.col("dense"), F.concat(F.lit("!"), "shard")).otherwise(F.col("shard")))
            all_shards = named.groupBy("node").agg(F.sort_array(F.collect_set("shard")).alias("shards"))
            named = materialise(named.join(all_shards, "node"), "shards")
            thin = named.where("dense IS NULL")
            found = _search_shards(thin, _graph(thin)).unionByName(_dense(named.where("dense")))
        recall = _audit(nodes, n, found)
        if recall >= LEAST_RECALL:
            break
        if overlap >= 4 * OVERLAP:
            found, recall = _all_blocks(nodes, n), 1.0
            break
        overlap *= 2
    linked = connected_components(found.where("node <> root"), "node", "root").withColumnRenamed("node", "of")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(sums, "node", "left").join(linked, F.col("node") == F.col("of"), "left")
    known = known.select("data", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("class"))
    joined = materialise(rows.join(known, "data", "left"), "joined")
    smallest = joined.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("component"))
    return joined.join(smallest, "class", "left").select("id", F.coalesce("links", F.lit(0)).alias("links"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), F.lit(float(recall)).alias("recall"))
