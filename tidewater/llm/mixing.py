"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document has the same expected number of copies: target over size. Documents are ordered by size,
the expected copies are summed up along that order, one random offset per source is added, and a document is taken once
for each whole number that its stretch of the sum crosses. Ordering by size keeps what is taken close to the target: the
error is at most about the size of the largest document.

Expected copies are equal, so a prefix sum is a rank. Ranks come from counts: rows of a (source, size) group are ranked
in that group and the group's start is the count of all before it. Groups of over ``1/HOT`` of all rows (there are
``HOT`` at most, so they can be broadcast) are split by ranges of ids first, which leaves the order (size, id) as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_REGEX, materialise

#: Weights of the sources in code point order, null last, from the start again when they are used up.
WEIGHTS = (5, 2, 1)
#: A document is taken so many times at most.
MOST_COPIES = 3
HOT = 1024
_STEP = 32


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_REGEX)), F.lit(0)).cast("long")


def _source_key(column: Column) -> Column:
    """A key that is never null, for joins."""
    return F.coalesce(F.concat(F.lit("s"), column), F.lit("n"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """A row for each source: ``key``, ``source``, ``source_size``, ``target``, ``copies``, ``offset``.

    Sources share the total by weight; one whose share exceeds ``most`` times its size gets just that, and what is left
    is shared again. In the order of that limit over the weight, the sources that reach it come first, so one running
    sum finds them all.
    """
    per_source = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    weighed = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1)).cast("long"))
    weighed = weighed.withColumn("most", F.col("source_size") * most)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = weighed.withColumn("level", free / weight).withColumn("full", F.col("most") / F.col("weight") <= F.col("level"))
    # the level of the first source that is not full holds for all after it
    level = level.withColumn("held", F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything))
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("held"))
    part = F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), "key")), 1, 5), 16, 10).cast("double")
    return level.select(
        "key", "source", "source_size", target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("copies"),
        ((part + 0.5) / 1048576).alias("offset"),
    )


def _id_ranges(sizes: DataFrame, counts: DataFrame, limit: int) -> DataFrame:
    """For each group of over ``limit`` rows the ids that cut it in parts of about ``limit``: ``bounds``, and every ``_STEP``-th of them.

    Bounds are approximate quantiles. Wherever they lie, the parts follow each other in the order of ids.
    """
    hot = counts.where(F.col("n") > limit).select("key", "size", F.floor(HOT / F.ceil(F.col("n") / limit)).cast("int").alias("every"))
    cuts = F.percentile_approx("id", [i / HOT for i in range(1, HOT)], 10 * HOT)
    found = sizes.join(F.broadcast(hot), ["key", "size"]).groupBy("key", "size").agg(cuts.alias("cuts"), F.first("every").alias("every"))
    found = found.withColumn("bounds", F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % F.greatest("every", F.lit(1)) == 0)))
    return found.select("key", "size", "bounds", F.filter("bounds", lambda _, i: i % _STEP == _STEP - 1).alias("coarse"))


def _range_of(column: str) -> Column:
    """How many of ``bounds`` are smaller than the id; 0 for a null id and outside hot groups."""
    smaller = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col(column)))
    coarse = smaller("coarse") * _STEP
    return F.when(F.col("bounds").isNotNull() & F.col(column).isNotNull(), coarse + smaller(F.slice("bounds", coarse + 1, F.lit(_STEP)))).otherwise(0)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``source``, ``size``, ``source_size``, ``target``, ``times``.

    Null and empty texts have size 0; they stand first in their source and are taken like any other, which adds no
    words. Null is a source of its own, the last, and a null id stands before all others of its size. Rows that repeat an id are ranked one after the other, in any order,
    and may be taken a different number of times. A source without words has target 0 and nothing of it is taken.
    """
    sizes = docs.select(F.col(id_column).cast("long").alias("id"), F.col(source_column).cast("string").alias("source"), words_in(F.col(text_column).cast("string")).alias("size"))
    sizes = materialise(sizes.withColumn("key", _source_key(F.col("source"))), "sizes")
    counts = materialise(sizes.groupBy("key", "size").agg(F.count("*").alias("n")), "counts")
    rows = counts.agg(F.sum("n")).first()[0] or 0
    hot = materialise(_id_ranges(sizes, counts, max(rows // HOT, 100)), "hot")
    dealt = sizes.join(F.broadcast(hot), ["key", "size"], "left").withColumn("part", _range_of("id")).drop("bounds", "coarse")
    groups = dealt.groupBy("key", "size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("key", "size", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("key", "size", "part").orderBy("id")
    targets = source_targets(sizes, weights, most)
    ranked = dealt.withColumn("place", F.row_number().over(within)).join(starts, ["key", "size", "part"]).withColumn("rank", F.col("start") + F.col("place"))
    # sources are few, but nothing proves it: the engine picks the join
    out = ranked.join(targets.drop("source"), "key")
    up_to = lambda r: F.floor(r * F.col("copies") + F.col("offset"))
    return out.select("id", "source", "size", "source_size", "target", (up_to(F.col("rank")) - up_to(F.col("rank") - 1)).cast("int").alias("times"))
