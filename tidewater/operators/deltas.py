"""What has changed since a resource was last read: hunks of lines, and whether they are shorter than the whole.

Two reads are compared by their lines. Lines that occur once in each of them meet in an equi join on the line's hash; the
longest run of such lines that rises in both is what stays in place. Between its members equal lines at both ends go, and
what is left of a gap is a hunk. Applying the hunks to the old lines gives the new ones.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

#: A delta is sent for texts of so many characters or more, if it is no longer than this share of the text.
LEAST_CHARS, MOST_SHARE = 4096, 0.5


def rising(values: list[int]) -> list[int]:
    """Places of a longest strictly rising run of values."""
    tails: list[int] = []  # least last value of a run of each length
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        n = bisect_left(tails, v)
        tails[n : n + 1] = [v]
        at[n : n + 1] = [i]
        before.append(at[n - 1] if n else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _rising(lists: pd.Series) -> pd.Series:
    return lists.map(lambda v: rising(list(v)))


def _leading(a: Column, b: Column) -> Column:
    """How many items two arrays have in common at their beginning."""
    size = F.least(F.size(a), F.size(b))
    equal = F.transform(F.arrays_zip(F.slice(a, F.lit(1), size).alias("a"), F.slice(b, F.lit(1), size).alias("b")), lambda x: x["a"] == x["b"])
    first = F.array_position(equal, F.lit(False)).cast("int")
    return F.when(first > 0, first - 1).otherwise(size)


def line_hunks(pairs: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """``key``, ``old``, ``new`` (arrays of lines) and ``hunks``: ``at`` (line of the old text, from 1), ``gone`` (lines there), ``start`` (line of the new text) and ``lines``.

    ``key`` must differ for all rows.
    """
    pairs = pairs.select(F.col(key).alias("_key"), F.col(old).alias("old"), F.col(new).alias("new"))
    side = lambda name, p: pairs.select("_key", F.posexplode(name).alias(p, "line")).select("_key", p, F.xxhash64("line").alias("h")).groupBy("_key", "h").agg(F.min(p).alias(p), F.count("*").alias("n")).where("n = 1").drop("n")
    met = side("old", "i").join(side("new", "j"), ["_key", "h"]).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("i", "j"))).alias("m"))
    chosen = met.withColumn("k", F.pandas_udf(_rising, "array<int>")(F.transform("m", lambda x: x["j"])))
    kept = chosen.select("_key", F.transform("k", lambda k: F.get("m", k)).alias("m"))
    both = pairs.join(kept, "_key", "left").select("_key", "old", "new", F.coalesce("m", F.array().cast("array<struct<i: int, j: int>>")).alias("m"))
    # a hash may name two different lines; such a pair is no anchor
    m = F.filter("m", lambda x: F.get("old", x["i"]) == F.get("new", x["j"]))
    ends = lambda i, j: F.array(F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))
    anchors = F.concat(ends(F.lit(-1), F.lit(-1)), m, ends(F.size("old"), F.size("new")))
    both = both.withColumn("m", anchors)
    part = lambda name, a, b: F.slice(name, a + 2, b - a - 1)

    def gap(k):
        low, high = F.get("m", k), F.get("m", k + 1)
        a, b = part("old", low["i"], high["i"]), part("new", low["j"], high["j"])
        return F.struct((low["i"] + 2).alias("at"), (low["j"] + 2).alias("start"), a.alias("a"), b.alias("b"))

    gaps = F.filter(F.transform(F.sequence(F.lit(0), F.size("m") - 2), gap), lambda g: (F.size(g["a"]) > 0) | (F.size(g["b"]) > 0))
    both = both.select("_key", "old", "new", gaps.alias("g"))

    def trimmed(g):
        head = _leading(g["a"], g["b"])
        rest = lambda x: F.slice(x, head + 1, F.size(x) - head)
        tail = _leading(F.reverse(rest(g["a"])), F.reverse(rest(g["b"])))
        return F.struct((g["at"] + head).alias("at"), (F.size(g["a"]) - head - tail).alias("gone"), (g["start"] + head).alias("start"), F.slice(g["b"], head + 1, F.size(g["b"]) - head - tail).alias("lines"))

    hunks = F.filter(F.transform("g", trimmed), lambda h: (h["gone"] > 0) | (F.size(h["lines"]) > 0))
    return both.select(F.col("_key").alias(key), "old", "new", hunks.alias("hunks"))


def applied(old: Column, hunks: Column) -> Column:
    """The new lines: the old ones with each hunk's lines in place of those that are gone."""
    behind = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.get(hunks, k - 1)["at"] + F.get(hunks, k - 1)["gone"])
    parts = F.transform(hunks, lambda h, k: F.concat(F.slice(old, behind(k), h["at"] - behind(k)), h["lines"]))
    last = behind(F.size(hunks))
    return F.concat(F.flatten(parts), F.slice(old, last, F.size(old) - last + 1))


def deltas(reads: DataFrame, resource: list[str], order: str, text: str, least: int = LEAST_CHARS, share: float = MOST_SHARE) -> DataFrame:
    """``resource``, ``order``, ``old``, ``new``, ``hunks``, ``delta`` for each read whose text is not that of the read before.

    ``delta`` is what stands for the text, null where the whole is to be sent: it is short, or the delta is not much shorter.
    The first read of a resource has no row, nor has one whose text is null; an epoch belongs to ``resource``.
    """
    was = F.lag(text).over(Window.partitionBy(*resource).orderBy(order))
    key = F.struct(*resource, order)
    rows = reads.where(F.col(text).isNotNull()).select(key.alias("_key"), F.col(text).alias("_text"), was.alias("_was")).where("_was <> _text")
    cut = rows.select("_key", F.split("_was", "\n").alias("old"), F.split("_text", "\n").alias("new"))
    found = line_hunks(cut, "_key", "old", "new")
    mark = lambda sign, lines: F.transform(lines, lambda x: F.concat(F.lit(sign), x))
    body = F.transform("hunks", lambda h: F.array_join(F.concat(F.array(F.concat(F.lit("@@ -"), h["at"], F.lit(","), h["gone"], F.lit(" +"), h["start"], F.lit(","), F.size(h["lines"]), F.lit(" @@"))), mark("-", F.slice("old", h["at"], h["gone"])), mark("+", h["lines"])), "\n"))
    size = F.length(F.array_join("new", "\n"))
    told = F.concat(F.lit("[delta] "), F.concat_ws(":", *(F.col(f"_key.{c}").cast("string") for c in resource)), F.lit(" ("), size, F.lit(" chars), diff vs last read; force=true for full\n"), F.array_join(body, "\n"))
    return found.withColumn("delta", told).select("_key.*", "old", "new", "hunks", F.when((size >= least) & (F.length("delta") <= size * share), F.col("delta")).alias("delta"))


@query(
    "read_deltas",
    "SELECT conv_id, role, turn, md5(text) AS digest FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn) AS was FROM (SELECT conv_id, role, turn, replace(text, '. ', chr(10)) AS text FROM conversations WHERE text IS NOT NULL)) WHERE was <> text",
)
def read_deltas(spark, sf_dir):
    """What one role says in a conversation as reads of one resource, a sentence a line; each is rebuilt from the one before and its hunks."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.replace("text", F.lit(". "), F.lit("\n")).alias("text"))
    found = deltas(said, ["conv_id", "role"], "turn", "text")
    return found.select("conv_id", "role", "turn", F.md5(F.array_join(applied(F.col("old"), F.col("hunks")), "\n")).alias("digest"))


@query("document_deltas", "SELECT doc_id, md5(text) AS digest FROM (SELECT *, lag(text) OVER (PARTITION BY source ORDER BY doc_id) AS was FROM documents) WHERE was <> text")
def document_deltas(spark, sf_dir):
    """The documents of a source as reads of one resource, rebuilt from hunks."""
    found = deltas(table(spark, sf_dir, "documents"), ["source"], "doc_id", "text")
    return found.select("doc_id", F.md5(F.array_join(applied(F.col("old"), F.col("hunks")), "\n")).alias("digest"))
