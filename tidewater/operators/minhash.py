"""Near-duplicates by MinHash signatures, the first in rank order kept.

Two rows are alike if 96 of their 128 least values are equal. A row goes if it is like one kept before it; that is not the same as
one row for each connected group. No pair is lost on the way:

1. Rows with the same signature are one, the first of them.
2. A signature is a set of 128 items (place, value). Rows that share 96 of them share one of the 33 rarest items of either, as
   far as the order by rarity is the same for all rows. These rarest items are the bands on which rows meet.
3. A row that is the first on all its bands is kept whatever else holds, and what is like it goes. This is done first,
   so that a large group of near copies is met once, by its first row, and does not meet itself pair by pair.
4. What is left meets on its bands, pairs are verified, and conflicts are settled in rounds: rows without a conflict
   with an earlier row stay, and what is in conflict with them goes.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..shared import written
from ..sources.tables import table

# The prime and mask of the permutations, their number, the share of equal values, and tokens below which a row is exempt.
PRIME, MASK, PERMUTATIONS, SEED = (1 << 61) - 1, (1 << 32) - 1, 128, 1
ALIKE, LEAST_TOKENS = 0.75, 5
#: Places in which two rows that are alike may differ, and buckets in which items are counted.
DIFFERENT, BUCKETS = PERMUTATIONS - int(np.ceil(ALIKE * PERMUTATIONS)), 1 << 18
#: Rounds in which rows that are first on all their bands are settled before pairs are formed.
FIRST_ROUNDS = 2
_TOKEN = re.compile(r"[a-z0-9]+")
_CHUNK = 8192


def permutations(n: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = random.Random(seed)
    a = [rng.randint(1, PRIME) for _ in range(n)]
    return np.array(a, np.uint64), np.array([rng.randint(0, PRIME) for _ in range(n)], np.uint64)


def permuted(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a h + b) mod 2^61 - 1, its last 32 bits, for all hashes (below 2^32) and permutations, within 64 bits."""
    h, p = hashes.astype(np.uint64)[:, None], np.uint64(PRIME)
    fold = lambda x: (x & p) + (x >> np.uint64(61))
    high = fold((a >> np.uint64(32)) * h)  # below 2^61 + 1
    high = ((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29))  # times 2^32: bits go round
    x = fold(fold(high) + fold((a & np.uint64(MASK)) * h) + b)
    return np.where(x >= p, x - p, x) & np.uint64(MASK)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of least values for each text (all ones for one without tokens), and the number of different tokens."""
    a, b = permutations()
    intern: dict[str, int] = {}
    sets = [{intern.setdefault(t, len(intern)) for t in _TOKEN.findall((x or "").lower())} for x in texts]
    hashes = np.array([int.from_bytes(hashlib.sha1(t.encode()).digest()[:4], "little") for t in intern], np.uint64)
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(texts), PERMUTATIONS), MASK, np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    flat = np.fromiter((t for s in sets for t in s), np.int64, int(sizes.sum()))
    for i in range(0, len(flat), _CHUNK):
        who = owner[i : i + _CHUNK]
        first = np.flatnonzero(np.r_[True, np.diff(who) > 0])
        at = who[first]
        out[at] = np.minimum(out[at], np.minimum.reduceat(permuted(hashes[flat[i : i + _CHUNK]], a, b), first, axis=0))
    return out.astype(np.int64), sizes


def _signed(texts: pd.Series) -> pd.DataFrame:
    values, sizes = signatures(texts.tolist())
    return pd.DataFrame({"signature": list(values), "tokens": sizes})


def alike(a: Column, b: Column) -> Column:
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    return equal >= int(np.ceil(ALIKE * PERMUTATIONS))


def bucket_counts(items: DataFrame) -> np.ndarray:
    """How many of ``items`` (one column of hashes) fall into each of ``BUCKETS``: numbers, not items, come to the driver."""
    found = items.groupBy(F.col(items.columns[0]).bitwiseAND(BUCKETS - 1).alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _bands(rows: DataFrame) -> DataFrame:
    """``id``, ``band``, ``x``, ``y``: the rarest items of each row, those that some other row has there too, and the last bits of its values.

    Rarity is that of an item's bucket, so a row finds its bands by itself and only these are shuffled, not all its items.
    """
    hashed = rows.select("id", "signature", "scope").select("id", "signature", F.transform("signature", lambda v, i: F.xxhash64("scope", i, v)).alias("items"))
    counts = rows.sparkSession.sparkContext.broadcast(bucket_counts(hashed.select(F.explode("items").alias("item"))))

    def rarest(items: pd.Series, signature: pd.Series) -> pd.DataFrame:
        m, s = (np.stack(c.to_list()) if len(c) else np.zeros((0, PERMUTATIONS), np.int64) for c in (items, signature))
        order = np.lexsort((m, counts.value[m & (BUCKETS - 1)]), axis=-1)[:, : DIFFERENT + 1]
        bits = np.packbits((s & 1).astype(np.uint8), axis=1).view(np.int64)
        return pd.DataFrame({"band": list(np.take_along_axis(m, order, 1)), "x": bits[:, 0], "y": bits[:, 1]})

    found = hashed.select("id", F.pandas_udf(rarest, "band array<long>, x long, y long")("items", "signature").alias("r"))
    met = F.count("*").over(Window.partitionBy("band"))
    return found.select("id", F.explode("r.band").alias("band"), "r.x", "r.y").withColumn("n", met).where("n > 1").drop("n")


def _meetings(early: DataFrame, late: DataFrame) -> DataFrame:
    """Pairs ``a``, ``id`` of ``_bands`` rows with a band in common, but for those that cannot be alike: equal values have equal last bits."""
    first = early.select(F.col("id").alias("a"), "band", F.col("x").alias("_x"), F.col("y").alias("_y"))
    differ = F.bit_count(F.col("x").bitwiseXOR(F.col("_x"))) + F.bit_count(F.col("y").bitwiseXOR(F.col("_y")))
    return first.join(late, "band").where((F.col("a") < F.col("id")) & (differ <= DIFFERENT)).select("a", "id").distinct()


def keep_first(rows: DataFrame, rank: str, text: str, by: list[str] | None = None) -> DataFrame:
    """The rows of ``by`` and ``rank`` (different for all rows of one ``by``; small is early) that are like none kept before them.

    Rows with fewer than five different tokens, null and empty texts among them, stay and compare with nothing.
    """
    spark, by = rows.sparkSession, by or []
    signed = rows.select(*by, rank, F.pandas_udf(_signed, "signature array<long>, tokens long")(text).alias("_x")).select(*by, rank, "_x.*")
    key = F.struct(*by, rank)
    signed = written(signed.select(key.alias("id"), F.struct(*by).alias("scope") if by else F.lit(0).alias("scope"), "signature", "tokens"), "signatures")
    exempt = signed.where(F.col("tokens") < LEAST_TOKENS).select("id")
    firsts = written(signed.where(F.col("tokens") >= LEAST_TOKENS).groupBy("scope", "signature").agg(F.min("id").alias("id")), "firsts")
    bands = written(_bands(firsts), "bands")
    sig = firsts.select("id", "signature")
    removed = firsts.select("id").limit(0)
    for _ in range(FIRST_ROUNDS):
        head = bands.withColumn("head", F.min("id").over(Window.partitionBy("band")))
        sure = head.groupBy("id").agg(F.max(F.col("head") < F.col("id")).alias("late")).where("NOT late").select("id")
        sure = written(sure, "sure")
        met = _meetings(bands.join(sure, "id"), bands)
        gone = written(_conflicts(met, sig).select("id").distinct(), "gone")
        bands = written(bands.join(sure.unionByName(gone), "id", "left_anti"), "bands")
        removed = removed.unionByName(gone)
    edges = written(_conflicts(_meetings(bands, bands), sig), "conflicts")
    while edges.limit(1).count():
        later = edges.select("id").distinct()
        stay = edges.select(F.col("a").alias("id")).distinct().join(later, "id", "left_anti")
        lost = edges.join(stay.withColumnRenamed("id", "a"), "a", "left_semi").select("id").distinct()
        lost = written(lost, "gone")
        removed = removed.unionByName(lost)
        settled = lost.unionByName(stay)
        edges = written(edges.join(settled.withColumnRenamed("id", "a"), "a", "left_anti").join(settled, "id", "left_anti"), "conflicts")
    out = firsts.select("id").join(removed, "id", "left_anti").unionByName(exempt)
    return out.select("id.*")


def _conflicts(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    """The pairs ``a``, ``id`` whose signatures are alike."""
    with_a = pairs.join(sig.select(F.col("id").alias("a"), F.col("signature").alias("_s")), "a")
    return with_a.join(sig, "id").where(alike(F.col("_s"), F.col("signature"))).select("a", "id")


@query("minhash_keep_first")
def minhash_keep_first(spark, sf_dir):
    """The turns of each conversation that resemble none kept before."""
    return keep_first(table(spark, sf_dir, "conversations"), "turn", "text", ["conv_id"])


@query("minhash_documents")
def minhash_documents(spark, sf_dir):
    """The documents that resemble none kept before, by id, over the whole table."""
    return keep_first(table(spark, sf_dir, "documents"), "doc_id", "text")
