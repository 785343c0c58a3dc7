"""LM scoring by prediction by partial matching, with a word unigram model beside it as the base.

Model: counts of the byte after each context of up to ``ORDER`` bytes, over all training texts (A-Z lower-cased, UTF-8,
an end mark after each). Every gram counted stays in the model, which is a written table and grows with the input. The
``GRAMS`` most frequent ones are broadcast with their probabilities; each document keeps its other grams as a list. What
these are worth is worked out where the trie is: dealt by the last two bytes of the context, all longer contexts and
their shorter ones come together, and of the orders below there are no more than the bytes and pairs of bytes.

A byte's probability is that of the longest known context in which it was seen. Each context gives as many counts to
escape as it has distinct bytes (escape method C). After an escape, bytes seen in the longer context are excluded from
the shorter one. Below the empty context all bytes never seen share what is left. All this is worked out per trie node
once: a byte that is frequent in its full context, as nearly all are, costs one look-up in a hash table.

Base: word counts over all training texts. Words that make up at least one ``HEAD``-th of all are broadcast (``HEAD`` at
most); each document keeps the other words as a list, and those are joined with the counts.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_LOWER, materialise, segment_sums, slices, text_buffer

ORDER = 4
#: Grams broadcast at most; the others are joined.
GRAMS = 1 << 20
#: Grams that are put into one trie, about.
TRIE = 100_000
HEAD = 1 << 17
END = 0xFF  # does not occur in UTF-8
ALPHABET = 257
#: Bytes of text that are looked up together; longer texts are cut.
PIECE = 4_000_000
_LOG10 = np.log(10.0)


# ---------------------------------------------------------------- look-up table
class HashTable:
    """Values for 64-bit keys, open addressing, looked up for whole arrays. Keys are below 2**63."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2.5))))
        size = 1 << self.bits
        self.keys = np.full(size + 64, -1, dtype=np.int64)
        self.values = np.zeros(size + 64, dtype=values.dtype)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            at = slot[todo]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of several, the last one stays
            won = self.keys[at] == keys[todo]
            self.values[at[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] += 1
            if len(todo) and slot[todo].max() >= len(self.keys):
                grown = len(self.keys)
                self.keys = np.concatenate([self.keys, np.full(grown, -1, np.int64)])
                self.values = np.concatenate([self.values, np.zeros(grown, values.dtype)])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for those that are not there."""
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, slot, -1)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            slot[todo] += 1
            at = np.minimum(slot[todo], len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[todo]
            found[todo[hit]] = at[hit]
            todo = todo[~hit & (there != -1) & (slot[todo] < len(self.keys) - 1)]
        return found


# ---------------------------------------------------------------- model
class Model:
    """Trie nodes as arrays. A gram of order k is k context bytes and a symbol, packed as one number."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        """``grams[k]``: packed grams of order k (sorted) and their counts; shorter ones include those of longer ones."""
        self.order = len(grams) - 1
        contexts, totals, kinds = [], [], []
        for keys, counts in grams:
            context, first = np.unique(keys >> 8, return_index=True)
            contexts.append(context)
            totals.append(np.add.reduceat(counts, first).astype(np.float64) if len(first) else np.zeros(0))
            kinds.append(np.diff(np.r_[first, len(keys)]).astype(np.float64))
        self.escape, self.below, self.rest = [], [], []
        start_den, down_den = [], []
        for k in range(self.order + 1):
            start_den.append(np.log(totals[k] + kinds[k]) if len(totals[k]) else np.zeros(0))
            self.escape.append(np.log(kinds[k]) - start_den[k])
            if not k:
                # one context, the empty one; nothing lies below but the bytes never seen
                self.below.append(np.zeros(len(contexts[0])))
                down_den.append(np.zeros(len(contexts[0])))
                continue
            # seen here and so excluded one order down: their counts there
            keys, _ = grams[k]
            shorter_keys, shorter_counts = grams[k - 1]
            mask = (1 << (8 * k)) - 1
            at = np.searchsorted(shorter_keys, keys & mask)
            owner = np.searchsorted(contexts[k], keys >> 8)
            gone = np.bincount(owner, weights=shorter_counts[at], minlength=len(contexts[k]))
            parent = np.searchsorted(contexts[k - 1], contexts[k] & (mask >> 8))
            left, kind = totals[k - 1][parent] - gone, kinds[k - 1][parent] - kinds[k]
            with np.errstate(divide="ignore"):
                den = np.where(kind > 0, np.log(left + kind), 0.0)
                step = np.where(kind > 0, np.log(kind) - den, 0.0)
            down_den.append(den)
            # all escapes from one order down to the bytes never seen
            self.below.append(step + self.below[k - 1][parent])
        never = max(1, ALPHABET - (len(grams[0][0]) if grams[0][0].size else 0))
        self.never = -np.log(never)
        self.contexts, self.down_den = contexts, down_den
        keys, counts = grams[self.order]
        top = np.log(counts) - start_den[self.order][np.searchsorted(contexts[self.order], keys >> 8)] if len(keys) else np.zeros(0)
        self.top = HashTable(keys, top.astype(np.float64))
        self.grams = [(k, np.log(c), start_den[i]) for i, (k, c) in enumerate(grams)]

    def log_probabilities(self, history: np.ndarray) -> np.ndarray:
        """Natural log of each packed (ORDER context bytes, byte)'s probability."""
        slot = self.top.find(history)
        out = self.top.values[slot]
        miss = np.flatnonzero(slot < 0)
        if len(miss):
            out[miss] = self._slow(history[miss])
        return out

    def _slow(self, history: np.ndarray) -> np.ndarray:
        n = len(history)
        out = np.full(n, self.never)
        found_at, longest = np.full(n, -1), np.full(n, -1)
        where = np.zeros((self.order + 1, n), np.int64)
        counts = np.zeros(n)
        for k in range(self.order + 1):
            if not len(self.contexts[k]):
                continue
            context = (history >> 8) & ((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context
            where[k], longest = at, np.where(known, k, longest)
            keys, logs, _ = self.grams[k]
            gram = history & ((1 << (8 * k + 8)) - 1)
            at = np.minimum(np.searchsorted(keys, gram), len(keys) - 1)
            hit = keys[at] == gram
            found_at, counts = np.where(hit, k, found_at), np.where(hit, logs[at], counts)
        for m in range(self.order + 1):
            for k in range(-1, m + 1):
                some = np.flatnonzero((longest == m) & (found_at == k))
                if not len(some):
                    continue
                if k == m:
                    out[some] = counts[some] - self.grams[m][2][where[m][some]]
                    continue
                value = self.escape[m][where[m][some]] + self.below[m][where[m][some]]
                if k >= 0:
                    value += counts[some] - self.down_den[k + 1][where[k + 1][some]] - self.below[k + 1][where[k + 1][some]]
                else:
                    value += self.never
                out[some] = value
        return out


def packed_history(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end mark, the packed context and byte; offsets of the texts in that."""
    n = len(offsets) - 1
    starts = offsets - offsets[0] + np.arange(n + 1)
    full = np.full(len(data) + n, END, dtype=np.uint8)
    full[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = ASCII_LOWER[data]
    # what stands before a text is always end marks
    padded = np.full(len(full) + order, END, dtype=np.uint8)
    padded[order:] = full
    packed = full.astype(np.int64)
    for back in range(1, order + 1):
        packed |= padded[order - back : len(padded) - back].astype(np.int64) << (8 * back)
    for into in range(order):
        # the first bytes of a text see only end marks before it, not the end of the text before
        at = starts[:-1] + into
        at = at[at < starts[1:]]
        for back in range(into + 1, order + 1):
            packed[at] |= END << (8 * back)
    return packed, starts


def _cut(data: np.ndarray, at: int, end: int, limit: int) -> int:
    """Where a piece of a text that begins at ``at`` ends: behind white space, within ``limit`` bytes unless one word is longer."""
    to = min(at + limit, end)
    if to == end:
        return end
    blank = lambda a, b: np.flatnonzero((data[a:b] == 32) | ((data[a:b] >= 9) & (data[a:b] <= 13)))
    if len(found := blank(at, to)):
        return at + int(found[-1]) + 1
    while to < end:
        if len(found := blank(to, min(to + limit, end))):
            return to + int(found[0]) + 1
        to = min(to + limit, end)
    return end


def pieces(data: np.ndarray, offsets: np.ndarray, order: int = ORDER, limit: int | None = None):
    """Yields (first, last, low, bounds, packed, starts, ends): texts ``first`` to ``last``, their bytes lower-cased with n+1 offsets, and as ``packed_history``.

    A text of more than ``limit`` bytes comes alone and in several pieces, each with the history of the one before; only the
    last one ``ends`` and has the end mark. Memory is bounded by the limit, or by the longest word.
    """
    limit = PIECE if limit is None else limit
    for first, last in slices(offsets, limit):
        a, b = int(offsets[first]), int(offsets[last])
        if b - a <= limit:
            bounds = offsets[first : last + 1] - a
            yield first, last, ASCII_LOWER[data[a:b]], bounds, *packed_history(data[a:b], bounds, order), True
            continue
        at = a
        while at < b:
            to, before = _cut(data, at, b, limit), min(order, at - a)
            packed, _ = packed_history(data[at - before : to], np.array([0, to - at + before]), order)
            packed = packed[before : before + to - at + (to == b)]
            yield first, last, ASCII_LOWER[data[at:to]], np.array([0, to - at]), packed, np.array([0, len(packed)]), to == b
            at = to


# ---------------------------------------------------------------- counting
def count_corpus(training: DataFrame, text_column: str, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(``gram``, ``n``) of the full order and (``word``, ``n``), over all rows."""

    def run(batches):
        words: Counter[bytes] = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(last):
            nonlocal grams, words
            if grams:
                keys = np.concatenate([k for k, _ in grams])
                counts = np.concatenate([c for _, c in grams])
                unique, at = np.unique(keys, return_inverse=True)
                grams = [(unique, np.bincount(at, weights=counts).astype(np.int64))]
                if last or len(unique) > 4_000_000:
                    for i in range(0, len(unique), 100_000):
                        k, c = unique[i : i + 100_000], grams[0][1][i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(len(k), pa.binary()), pa.array(c)], ["gram", "word", "n"])
                    grams = []
            if words and (last or len(words) > 500_000):
                items = list(words.items())
                words = Counter()
                for i in range(0, len(items), 100_000):
                    some = items[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.int64()), pa.array([w for w, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64())], ["gram", "word", "n"])

        held = 0
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for _, _, low, bounds, packed, _, _ in pieces(data, offsets, order):
                keys, counts = np.unique(packed, return_counts=True)
                grams.append((keys, counts))
                held += len(keys)
                # words never span two texts
                joined = np.full(len(low) + len(bounds) - 1, 32, dtype=np.uint8)
                joined[np.arange(len(low)) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = low
                words.update(joined.tobytes().split())
                if held > 4_000_000 or len(words) > 500_000:
                    yield from flush(False)
                    held = 0
        yield from flush(True)

    # one write for both kinds of count
    counted = materialise(training.select(F.col(text_column).cast("string")).mapInArrow(run, "gram long, word binary, n long"), "counted")
    total = lambda c: counted.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("n").alias("n"))
    return materialise(total("gram"), "grams"), materialise(total("word"), "words")


def frequent_grams(grams: DataFrame, most: int = GRAMS) -> tuple[HashTable, int]:
    """The most frequent grams, ``most`` at most, with the log of their probability; the number of all grams."""
    levels = grams.groupBy(F.floor(F.log2("n") * 8).alias("level")).agg(F.count("*"), F.min("n")).collect()
    least, distinct = 1 << 62, 0
    for _, count, low in sorted(map(tuple, levels), reverse=True):
        distinct += count
        least = low if distinct <= most else least
    # what follows a context is counted over all grams, rare ones too
    contexts = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg((F.sum("n") + F.count("*")).alias("all"))
    rows = grams.where(F.col("n") >= least).join(contexts, F.shiftright("gram", 8) == F.col("context")).select("gram", "n", "all").toArrow()
    keys, n, total = (rows.column(c).to_numpy() for c in ("gram", "n", "all"))
    return HashTable(keys.astype(np.int64), np.log(n) - np.log(total)), distinct


def _summed(keys: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Grams of order ``k`` (sorted) and their counts, from longer ones."""
    short, at = np.unique(keys & ((1 << (8 * k + 8)) - 1), return_inverse=True)
    return short, np.bincount(at, weights=counts, minlength=len(short)).astype(np.int64)


def probabilities(wanted: DataFrame, grams: DataFrame, distinct: int, order: int = ORDER) -> DataFrame:
    """``gram`` and ``log_p`` of each row of ``wanted`` (distinct grams, in the model or not), from all of ``grams``."""
    near = min(order, 2)
    # bytes and pairs of bytes: 2**16 rows at most
    rows = grams.groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * near)) - 1)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    keys, counts = rows.column("gram").to_numpy().astype(np.int64), rows.column("n").to_numpy()
    below = grams.sparkSession.sparkContext.broadcast([_summed(keys, counts, k) for k in range(near)])
    # all grams whose contexts end alike go to one trie
    trie = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << (8 * near)) - 1))), F.lit(-(-distinct // TRIE) or 1)).alias("trie")

    def work_out(_, known, asked):
        history = asked.column("gram").to_numpy()
        if not len(history):
            return pa.table({"gram": pa.array([], pa.int64()), "log_p": pa.array([], pa.float64())})
        keys, counts = known.column("gram").to_numpy(), known.column("n").to_numpy()
        model = Model(below.value + [_summed(keys, counts, k) for k in range(near, order + 1)])
        return pa.table({"gram": pa.array(history), "log_p": pa.array(model.log_probabilities(history))})

    return grams.select(trie, "gram", "n").groupBy("trie").cogroup(wanted.select(trie, "gram").groupBy("trie")).applyInArrow(work_out, "gram long, log_p double")


# ---------------------------------------------------------------- scoring
def score(docs: DataFrame, training: DataFrame, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",), order: int = ORDER, most: int = GRAMS) -> DataFrame:
    """The ``carry`` columns of each row of ``docs`` with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Null and empty texts have one token, the end, and the probability of an end mark at the start. With no training row
    nothing is known: all bytes are equally likely and each token has base probability 1 (one unseen kind for N = V = 0).
    Repeated rows are scored each. Texts beyond ``PIECE`` are scored in pieces that know what stands before them.
    """
    spark = docs.sparkSession
    grams, words = count_corpus(training, text_column, order)
    table, distinct = frequent_grams(grams, most)
    frequent = spark.sparkContext.broadcast(table)
    n_docs = training.count()
    n_words, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, vocabulary = n_words + n_docs, kinds + bool(n_docs)
    floor = np.log10(total + vocabulary + 1)
    common = words.where(F.col("n") >= max(1, -(-total // HEAD))).toArrow()
    logs = np.log10(common.column("n").to_numpy().astype(float) + 1)
    head = spark.sparkContext.broadcast(dict(zip(common.column("word").to_pylist(), logs.tolist(), strict=True)))
    end_log = float(np.log10(n_docs + 1))

    rows = docs.select(*[F.col(c) for c in carry], F.monotonically_increasing_id().alias("_row"), F.col(text_column).cast("string").alias("_text"))
    kept = len(carry) + 1
    schema = rows.drop("_text").schema.add("n_tokens", "long").add("n_known", "long").add("known_logs", "double").add("score", "double").add("rare", T.ArrayType(T.BinaryType())).add("rare_n", T.ArrayType(T.LongType()))
    schema = schema.add("missed", T.ArrayType(T.LongType())).add("missed_n", T.ArrayType(T.LongType())).add("ends", "boolean")
    names = [f.name for f in schema]

    def look_up(packed, starts):
        """Log-probabilities of frequent grams (0 for others), and the others of each text: offsets, grams, times."""
        if not distinct:
            return np.full(len(packed), -np.log(ALPHABET)), np.zeros(len(starts), np.int32), packed[:0], packed[:0]
        likely, bits = np.zeros(len(packed)), 8 * order + 8
        for i in range(0, len(packed), 500_000):
            slot = frequent.value.find(packed[i : i + 500_000])
            likely[i : i + 500_000] = np.where(slot < 0, np.nan, frequent.value.values[slot])
        at = np.flatnonzero(np.isnan(likely))
        likely[at] = 0.0
        owner = np.searchsorted(starts, at, side="right") - 1
        pairs, times = np.unique((owner << bits) | packed[at], return_counts=True)
        begin = np.r_[0, np.cumsum(np.bincount(pairs >> bits, minlength=len(starts) - 1))]
        return likely, begin.astype(np.int32), pairs & ((1 << bits) - 1), times

    def run(batches):
        known = head.value
        for whole in batches:
            data, offsets = text_buffer(whole.column(kept))
            held = np.zeros(4)  # what the pieces before of a long text came to
            for first, last, low, bounds, packed, starts, ends in pieces(data, offsets, order):
                likely, begin, missed, missed_n = look_up(packed, starts)
                raw = low.tobytes()
                n_tokens, n_known, sums, rare, rare_n = [], [], [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    tokens = raw[a:b].split()
                    values = list(map(known.get, tokens, repeat(0.0)))
                    unknown = Counter([t for t, v in zip(tokens, values, strict=True) if not v])
                    n_tokens.append(len(tokens) + ends)
                    n_known.append(len(tokens) - unknown.total() + (ends and bool(n_docs)))
                    sums.append(sum(values) + ends * end_log)
                    rare.append(list(unknown))
                    rare_n.append(list(unknown.values()))
                totals = np.array([n_tokens, n_known, sums, segment_sums(likely, starts) / _LOG10], dtype=np.float64)
                if len(bounds) == 2:
                    totals[:, 0] += held
                    held = np.zeros(4) if ends else totals[:, 0]
                columns = [pa.array(totals[0].astype(np.int64)), pa.array(totals[1].astype(np.int64)), pa.array(totals[2]), pa.array(totals[3]), pa.array(rare, pa.list_(pa.binary())), pa.array(rare_n, pa.list_(pa.int64()))]
                columns += [pa.ListArray.from_arrays(pa.array(begin), pa.array(x, pa.int64())) for x in (missed, missed_n)]
                yield pa.RecordBatch.from_arrays([*whole.slice(first, last - first).columns[:kept], *columns, pa.array([ends] * (last - first))], names)

    scored = materialise(rows.mapInArrow(run, schema), "scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("rare", "rare_n")).alias("pair")).select("_row", F.col("pair.rare").alias("word"), F.col("pair.rare_n").alias("times"))
    met = rare.join(words, "word").select("_row", "times", (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("logs"), F.lit(0.0).alias("gram_logs"))
    if distinct:
        missed = scored.select("_row", F.explode(F.arrays_zip("missed", "missed_n")).alias("pair")).select("_row", F.col("pair.missed").alias("gram"), F.col("pair.missed_n").alias("times"))
        values = probabilities(missed.select("gram").distinct(), grams, distinct, order)
        met = met.unionByName(missed.join(values, "gram").select("_row", F.lit(0).cast("long").alias("times"), F.lit(0.0).alias("logs"), (F.col("times") * F.col("log_p")).alias("gram_logs")))
    met = met.groupBy("_row").agg(F.sum("times").alias("more"), F.sum("logs").alias("more_logs"), F.sum("gram_logs").alias("gram_logs"))
    return scored.where("ends").join(met, "_row", "left").select(
        *carry, "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(floor))).alias("base_score"),
        (F.col("score") + F.coalesce("gram_logs", F.lit(0.0)) / F.lit(float(_LOG10))).alias("score"),
    )
