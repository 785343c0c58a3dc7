"""Best-fit packing of token sequences by a linear grouping scheme.

The plan needs nothing but the histogram of piece lengths, which has at most ``capacity`` rows whatever the input:

1. Large lengths are dealt, longest first, to groups of equal cardinality and rounded up to the longest of their group.
2. Configurations of the few rounded sizes that cover all groups with the fewest sequences come from column generation
   (each new configuration solves a knapsack over the prices of the last solution); whole multiples are used.
3. The actual pieces take the slots of their group, which frees the tokens that rounding had reserved.
4. Everything left, the small pieces above all, goes longest first to the tightest sequence where it fits.

A plan row says: pieces of a length with ranks from ``first`` on go to sequences from ``sequence`` on, ``per`` of them
to each, from ``offset`` on. The number of rows depends on the number of lengths only. Pieces are ranked within their
length by counts; the pieces of a length are dealt to parts by a hash first, so that a length that most pieces have
(that of full pieces does) is not ranked in one task.
"""

from __future__ import annotations

import os
import re
import threading
import time
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices, text_buffer

CAPACITY = 2048
#: Pieces from this share of the capacity on are large.
LARGE = 0.4
GROUPS = 256
END_OF_DOCUMENT = 0
#: Words, and parts of words, whose ids a worker remembers before it starts anew.
REMEMBERED_WORDS = 900_000
REMEMBERED_PARTS = 700_000
#: Seconds after which a worker that packs no more forgets them.
IDLE = 12.0
#: Characters that are tokenised at once.
TOGETHER = 1_000_000
PARTS = 1024
PLAN_COLUMNS = ("length", "first", "n", "sequence", "per", "offset")


# ---------------------------------------------------------------- tokens
class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, remembering words and the parts of words.

    The tokenizer never joins across white space, so a text's ids are those of its words, one after the other. It also
    never joins letters with other characters. Words of plain Latin letters and ASCII are therefore cut in such parts,
    and only parts not seen before are encoded, many in one call: a part holds no white space and is one of the tokenizer's
    own, so that it ends in one token that says so. Other words are encoded as they stand.
    """

    #: The tokenizer's own cut, for words of the characters in ``OTHER``'s complement.
    PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|[\W_]+")
    #: Characters (and the start of special tokens) for which words are not cut or lower-cased here.
    OTHER = re.compile("[^\\x00-\\x7fÀ-ÖØ-öø-ÿŒœ]|<\\|")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Whether a token ends a part.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.words) > REMEMBERED_WORDS:
            self.words = {"": b""}
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts = {}
        cut, plain, odd = [], set(), set()
        for text in texts:
            simple = "<|" not in text if text.isascii() else self.OTHER.search(text) is None
            words = (text.lower() if simple else text).replace("\n", " ")
            for blank in "\t\r\v\f":  # what else of ASCII the tokenizer takes for white space
                words = words.replace(blank, " ")
            words = words.split(" ")
            cut.append(words)
            (plain if simple else odd).update(words)
        # difference() goes through the fresh words, the operators and updates through all that are remembered
        plain = plain.difference(self.words)
        odd = odd.difference(self.words, plain)
        if plain:
            # most words are letters alone, or with one mark after them
            known, split, fresh = self.parts, [], set()
            for word in plain:
                if word.isalpha():
                    parts = (word,)
                elif word[:-1].isalpha() and not word[-1].isalnum():
                    parts = (word[:-1], word[-1])
                else:
                    parts = self.PARTS.findall(word)
                split.append(parts)
                fresh.update(parts)
            self._learn(fresh.difference(known))
            for word, parts in zip(plain, split, strict=True):
                self.words[word] = known[parts[0]] if len(parts) == 1 else b"".join([known[x] for x in parts])
        if odd:
            odd = list(odd)
            for word, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
                self.words[word] = np.array(got.ids, dtype="<u4").tobytes()
        return [b"".join(map(self.words.__getitem__, words)) for words in cut]

    def _learn(self, parts: set[str]) -> None:
        parts = list(parts)
        for start in range(0, len(parts), 50_000):
            some = parts[start : start + 50_000]
            got = self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(got.ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(ends) != len(some):  # a part was cut further: each on its own then
                found = [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            else:
                data = ids.tobytes()
                found = [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            self.parts.update(zip(some, found, strict=True))


_encoders: dict[str, WordEncoder] = {}
_used: dict[str, float] = {}


def _forget_idle() -> None:
    while _encoders:
        time.sleep(IDLE / 2)
        for path in [p for p, at in list(_used.items()) if time.monotonic() - at > IDLE]:
            _encoders.pop(path, None)
            _used.pop(path, None)


def shared_encoder(path: str) -> WordEncoder:
    """The encoder of this Python worker, which later tasks find with what it remembers, until it has not been used for ``IDLE`` seconds.

    A worker serves the tasks of other stages too, and their memory should not stand on top of this one's.
    """
    if path not in _encoders:
        first = not _encoders
        _encoders[path], _used[path] = WordEncoder(path), time.monotonic()
        if first:
            threading.Thread(target=_forget_idle, daemon=True).start()
    _used[path] = time.monotonic()
    return _encoders[path]


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked for, ``ids``."""
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches):
        encoder = shared_encoder(tokenizer_path)
        end = np.array([END_OF_DOCUMENT], dtype="<u4").tobytes()
        for batch in batches:
            offsets = text_buffer(batch.column(1))[1]
            for first, last in slices(offsets, TOGETHER):
                _used[tokenizer_path] = time.monotonic()
                part = batch.slice(first, last - first)
                rows = []
                for doc, data in zip(part.column(0).to_pylist(), encoder.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    data += end
                    for at in range(0, len(data), 4 * capacity):
                        piece = data[at : at + 4 * capacity]
                        rows.append((doc, at // (4 * capacity), at // 4, len(piece) // 4, zlib.crc32(piece), piece)[: 5 + keep_ids])
                yield _batch(rows, keep_ids)

    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).mapInArrow(run, schema)


def _batch(rows: list[tuple], keep_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names[: 5 + keep_ids])


# ---------------------------------------------------------------- plan
def _best_configuration(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity, by dynamic programming over the number of pieces."""
    value, picks = np.zeros(capacity + 1), []
    at = np.arange(capacity + 1)[None, :] - sizes[:, None]
    fits = at >= 0
    at = np.maximum(at, 0)
    for _ in range(capacity // int(sizes.min())):
        tried = np.where(fits, value[at] + price[:, None], -1.0)
        pick = tried.argmax(axis=0)
        best = np.take_along_axis(tried, pick[None, :], 0)[0]
        better = best > value + 1e-12
        if not better.any():
            break
        picks.append(np.where(better, pick, -1))
        value = np.where(better, best, value)
    found, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        g = pick[room]
        if g >= 0:
            found[g] += 1
            room -= int(sizes[g])
    return float(price @ found), found


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations (pieces of each size) with whole multiplicities: the linear optimum, rounded down."""
    n = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    amount = demand / np.diag(columns)
    for _ in range(20 * n + 100):
        price = np.linalg.solve(columns.T, np.ones(n))
        value, fresh = _best_configuration(price, sizes, capacity)
        if value <= 1 + 1e-7:
            break
        rate = np.linalg.solve(columns, fresh)
        positive = rate > 1e-9
        if not positive.any():
            break
        ratio = np.full(n, np.inf)
        ratio[positive] = amount[positive] / rate[positive]
        out = int(ratio.argmin())
        step = ratio[out]
        amount = np.maximum(amount - step * rate, 0)
        columns[:, out], amount[out] = fresh, step
    return [(columns[:, i].astype(int), int(amount[i] + 1e-9)) for i in range(n) if amount[i] >= 1 - 1e-9]


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Plan rows (see ``PLAN_COLUMNS``) for a histogram of lengths. Sequences are numbered from 0 without gaps."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    taken = dict.fromkeys(counts, 0)
    rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room left: runs of [first sequence, how many]
    sequences = counts.get(capacity, 0)
    if sequences:
        plan.append((capacity, 0, sequences, 0, 1, 0))
        taken[capacity] = sequences

    big = [[l, counts[l]] for l in sorted(counts, reverse=True) if capacity > l >= max(1, large * capacity) and counts[l]]
    total = sum(n for _, n in big)
    if total:
        share = -(-total // groups)
        queues: list[list[list[int]]] = [[]]
        held = 0
        for l, n in big:
            while n:
                m = min(n, share - held)
                queues[-1].append([l, m])
                held, n = held + m, n - m
                if held == share:
                    queues.append([])
                    held = 0
        merged: list[list[list[int]]] = []
        for q in filter(None, queues):
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1] += q
            else:
                merged.append(q)
        sizes = np.array([q[0][0] for q in merged])
        demand = np.array([sum(n for _, n in q) for q in merged], dtype=float)
        for configuration, times in configurations(sizes, demand, capacity):
            runs = [[sequences, times, 0]]  # first sequence, how many, tokens used
            sequences += times
            for g in np.repeat(np.arange(len(sizes)), configuration):
                runs = _fill(runs, merged[g], taken, plan)
            for first, n, used in runs:
                rooms[capacity - used].append([first, n])

    for l in sorted(counts, reverse=True):
        left = counts[l] - taken[l]
        room = l
        while left:
            while room <= capacity and not rooms[room]:
                room += 1
            if room > capacity:
                per = capacity // l
                fresh = -(-left // per)
                rooms[capacity].append([sequences, fresh])
                sequences += fresh
                room = capacity
            per = room // l
            first, n = rooms[room].pop()
            offset = capacity - room
            whole = min(n, left // per)
            if whole:
                plan.append((l, taken[l], whole * per, first, per, offset))
                taken[l] += whole * per
                left -= whole * per
                rooms[room - per * l].append([first, whole])
            if whole < n:
                rest = left % per if left < per else 0
                if rest:
                    plan.append((l, taken[l], rest, first + whole, rest, offset))
                    taken[l] += rest
                    left -= rest
                    rooms[room - rest * l].append([first + whole, 1])
                    whole += 1
                if whole < n:
                    rooms[room].append([first + whole, n - whole])
    return plan


def _fill(runs: list[list[int]], queue: list[list[int]], taken: dict[int, int], plan: list[tuple]) -> list[list[int]]:
    """Give each sequence of the runs the next piece of the queue, as far as it lasts."""
    out = []
    for first, n, used in runs:
        while n and queue:
            l, there = queue[0]
            m = min(n, there)
            plan.append((l, taken[l], m, first, 1, used))
            taken[l] += m
            out.append([first, m, used + l])
            first, n = first + m, n - m
            if m == there:
                queue.pop(0)
            else:
                queue[0][1] -= m
        if n:
            out.append([first, n, used])
    return out


# ---------------------------------------------------------------- Spark side
def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``) with ``sequence`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    limit = max(sum(counts.values()) // PARTS, 1000)
    parts = spark.createDataFrame([(l, -(-n // limit)) for l, n in counts.items()], "length long, parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64("id", "piece", "start", "ids_crc32"), "parts"))
    # capacity + PARTS rows at most
    sized = sorted((r[0], r[1], r[2]) for r in dealt.groupBy("length", "part").count().collect())
    starts, last, start = [], None, 0
    for l, part, n in sized:
        start = 0 if l != last else start
        starts.append((l, part, start))
        last, start = l, start + n
    starts = F.broadcast(spark.createDataFrame(starts, "length long, part long, first long"))
    within = Window.partitionBy("length", "part").orderBy("id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(within) - 1).join(starts, ["length", "part"])
    ranked = ranked.select(*pieces.columns, (F.col("first") + F.col("place")).alias("rank"))
    plan = np.array(sorted(plan_packing(counts, capacity)), dtype=np.int64).reshape(-1, len(PLAN_COLUMNS))
    shared = spark.sparkContext.broadcast(plan)
    schema = pieces.schema.add("sequence", "long").add("offset", "long")
    names = [f.name for f in schema]

    def run(batches):
        length, first, _, sequence, per, offset = shared.value.T
        keys = (length << 48) + first
        for batch in batches:
            l = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(keys, (l << 48) + rank, side="right") - 1
            along = rank - first[row]
            columns = [batch.column(c) for c in names[:-2]]
            columns += [pa.array(sequence[row] + along // per[row]), pa.array(offset[row] + along % per[row] * l)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, keep_ids: bool = False, **columns) -> DataFrame:
    """Every piece of every row of ``docs`` with its sequence and its offset there.

    Null and empty texts are one piece that holds the end of document alone. Rows that repeat an id are packed each on
    their own. Equal lengths are placed in the order of id, piece and checksum. An empty table gives an empty result.
    Other columns are not read. ``keep_ids`` adds each piece's ids (little-endian unsigned 32-bit).
    """
    pieces = materialise(tokenise(docs, tokenizer_path, capacity, keep_ids=keep_ids, **columns), "pieces")
    return place(pieces, capacity)
