"""SimHash near-dedup by a self-join of the binary trie of fingerprints.

Node pairs of the trie are walked together, from pairs of equal nodes at the top; each step goes down one bit and adds a
difference where the two children differ, and a pair that exceeds the budget of differing bits is dropped.

To spread the walk, the 64 bits are cut in blocks. Two fingerprints that differ in at most ``BUDGET`` bits agree on all
of ``equal`` blocks of ``BUDGET + equal``, so each choice of so many blocks gives one trie whose top levels hold those
blocks, where only equal nodes need to be paired: a bucket for each value of these blocks. The number of equal blocks
grows with the number of distinct fingerprints, so that buckets stay small.

Equal fingerprints are one leaf of the trie. A bucket gives one edge for each fingerprint to the first one it reaches
there, not all pairs; components then come from rounds of joins.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialise

WIDTH = 64
BUDGET = 4
SHINGLE = 4
SEED = 42
#: Fingerprints expected in a bucket.
BUCKET = 2048
#: Node pairs that are walked at once.
FRONTIER = 1_000_000


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority over the bits of the shingles' hashes, as an unsigned 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[len(words) - n :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, half = np.zeros(WIDTH, np.int64), n / 2
    for k in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + 65_536], stops[k : k + 65_536], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts > half, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``fingerprint`` (the 64 bits as a long) of each row."""

    def run(batches):
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", shingle) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["id", "fingerprint"])

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, "id long, fingerprint long")


# ---------------------------------------------------------------- trie walk
def trie_links(prints: np.ndarray, groups: np.ndarray, budget: int = BUDGET):
    """Yields arrays (i, j), i < j, of positions of all linked pairs within equal ``groups``; both arrays are sorted by
    (group, print) and prints are distinct within a group. A node is a range of positions that agree on all bits so far."""
    n = len(prints)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
    stops = np.r_[starts[1:], n]
    wide = stops - starts > 1
    stack = [(0, starts[wide], stops[wide], starts[wide], stops[wide], np.zeros(int(wide.sum()), np.int8))]
    while stack:
        depth, a0, a1, b0, b1, cost = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, *(x[half:] for x in (a0, a1, b0, b1, cost))), (depth, *(x[:half] for x in (a0, a1, b0, b1, cost)))]
            continue
        # two leaves: the rest of their bits at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = (i < j) & (np.bitwise_count(prints[i] ^ prints[j]) <= budget)
            yield i[near], j[near]
        rest = ~leaf
        if not rest.any():
            continue
        a0, a1, b0, b1, cost = (x[rest] for x in (a0, a1, b0, b1, cost))
        bit = np.uint64(WIDTH - 1 - depth)
        am, bm = _split(prints, a0, a1, bit), _split(prints, b0, b1, bit)
        same = a0 == b0
        grown = cost + 1
        pairs = [(a0, am, b0, bm, cost, None), (am, a1, bm, b1, cost, None), (a0, am, bm, b1, grown, None), (am, a1, b0, bm, grown, ~same)]
        parts = []
        for x0, x1, y0, y1, c, only in pairs:
            keep = (x0 < x1) & (y0 < y1) & (c <= budget)
            keep &= ~((x0 == y0) & (x1 - x0 == 1))
            if only is not None:
                keep &= only
            parts.append([x[keep] for x in (x0, x1, y0, y1, c)])
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


def _split(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """First position of each range whose bit is set; the range agrees on all higher bits."""
    lo, hi = lo.copy(), hi.copy()
    one = np.uint64(1)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        middle = (lo + hi) // 2
        up = open_ & ((prints[np.minimum(middle, len(prints) - 1)] >> bit) & one == 0)
        lo = np.where(up, middle + 1, lo)
        hi = np.where(open_ & ~up, middle, hi)


def smallest_linked(n: int, links) -> np.ndarray:
    """For each position the smallest one that it reaches by the links."""
    root = np.arange(n)
    for i, j in links:
        if not len(i):
            continue
        while True:
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


# ---------------------------------------------------------------- Spark side
def block_choices(n: int, budget: int = BUDGET, bucket: int = BUCKET) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of equal blocks its mask and its (lowest bit, width) pieces, for ``n`` distinct fingerprints."""
    equal = 1
    while equal < 4 and n >> (WIDTH * equal // (budget + equal)) > bucket:
        equal += 1
    edges = [round(i * WIDTH / (budget + equal)) for i in range(budget + equal + 1)]
    blocks = [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
    return [(sum(((1 << w) - 1) << a for a, w in chosen), list(chosen)) for chosen in combinations(blocks, equal)]


def fingerprint_edges(distinct: DataFrame, n: int, budget: int = BUDGET) -> DataFrame:
    """Edges (``a``, ``b``) that connect all linked ones of ``n`` distinct fingerprints."""
    choices = block_choices(n, budget)
    masks = [m - (1 << WIDTH) if m >> (WIDTH - 1) else m for m, _ in choices]
    dealt = distinct.select("fingerprint", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "top"))

    def run(batches):
        # a partition holds whole buckets
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        prints = table.column("fingerprint").to_numpy().view(np.uint64)
        choice, top = table.column("choice").to_numpy(), table.column("top").to_numpy()
        order = np.lexsort((prints, top, choice))
        prints, choice, top = prints[order], choice[order], top[order]
        new = np.r_[True, (choice[1:] != choice[:-1]) | (top[1:] != top[:-1])]
        root = smallest_linked(len(prints), trie_links(prints, np.cumsum(new), budget))
        linked = root < np.arange(len(root))
        names = prints.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[root[linked]])], ["a", "b"])

    # about a million rows to a partition, or as many partitions as the session asks for
    partitions = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(choices) // 1_000_000)
    return dealt.repartition(partitions, "choice", "top").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, budget: int = BUDGET) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fingerprint`` (long), ``component`` (smallest id reachable, itself included).

    Null and empty texts, and texts of white space, have fingerprint 0 and link like any other. Rows that repeat an id
    take part each with its own text. Null ids are larger than any other; a component of null ids alone is null. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = materialise(fingerprints(docs, id_column, text_column, shingle), "prints")
    distinct = materialise(rows.groupBy("fingerprint").agg(F.min("id").alias("id")), "distinct")
    linked = connected_components(fingerprint_edges(distinct, distinct.count(), budget), "a", "b")
    classes = linked.join(distinct, linked.node == distinct.fingerprint).select("fingerprint", F.col("component").alias("class"), "id")
    smallest = classes.groupBy("class").agg(F.min("id").alias("component"))
    members = classes.join(smallest, "class").select(F.col("fingerprint").alias("member"), "component")
    found = distinct.join(members, distinct.fingerprint == members.member, "left").select("fingerprint", F.coalesce("component", F.when(F.col("member").isNull(), F.col("id"))).alias("component"))
    return rows.join(found, "fingerprint").select("id", "fingerprint", "component")
