"""Runs (maximal repetitions) of words by divide and conquer after Main and Lorentz.

Words become ids, so that equal words have equal ids. The texts of a batch lie one after the other, with a mark between
them that equals nothing. All are halved level by level; in a segment [lo, hi) with the midpoint m, a repetition that lies
in it and crosses m with period p shows at i = m + p or i = m - p: what matches forwards from m and i, and what matches
backwards before m and i, together make p words at least. Both lengths are Z-functions: of the right half followed by the
segment, and of the left half followed by the segment, reversed. What is found is extended to both sides over the whole
text, equal intervals are joined, and the smallest period stays.

Only segments that can hold a run get their Z-functions. Of the two matches one covers half the period and three words, so
the three words at m and those at the match's far end must recur at the same distance; this is looked up for all positions
of a level at once by hashes of three words, which can let a segment through for nothing but never hide one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_buffer

#: A run has this many words at least, and twice its period.
LEAST = 12
#: Places that are looked at in one step.
_PIECE = 1 << 18
#: Bytes of text that are searched together (one longer text stands alone).
_SLICE = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_OUT = "runs array<struct<start: long, length: long, period: long>>, n_words long, collapsed string"


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal the first ones; the whole length at place 0."""
    n = len(s)
    z = [0] * n
    z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(ids: list[int], lo: int, mid: int, hi: int):
    """Repetitions (start, end, period) inside [lo, hi) that cross ``mid``, two periods long at least."""
    right, left = ids[mid:hi], ids[lo:mid]
    # both Z-functions end with the segment; -1 stands between
    ahead = z_function([*right, -1, *ids[lo:hi]])[hi - mid + 1 :]  # ahead[j]: words that match from mid and from lo + j
    behind = z_function([*left[::-1], -1, *ids[lo:hi][::-1]])[mid - lo + 1 :] + [0]
    n, m = hi - lo, mid - lo
    for j in range(n):
        if j != m:
            period = abs(j - m)
            after, before = ahead[j], behind[n - j]  # behind[n - j]: words that match before mid and before lo + j
            if after + before >= period:
                yield lo + min(j, m) - before, lo + max(j, m) + after, period


def _doubtful(grams: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Places of the segments where three words recur at the distance and in the way that a run needs."""
    end = np.cumsum(hi - lo)
    total, last, found = int(end[-1]), len(grams) - 1, []
    for first in range(0, total, _PIECE):
        place = np.arange(first, min(first + _PIECE, total))
        owner = np.searchsorted(end, place, side="right")
        at, m = place - end[owner] + hi[owner], mid[owner]
        period = np.abs(at - m)
        # the longer of the two matches: half the period, and half of what a run of LEAST words leaves beside it
        need = np.maximum((np.maximum(period, LEAST - period) + 1) // 2, 3)
        forward = (period > 0) & (grams[at] == grams[m])
        backward = (period > 0) & (at >= 3) & (m >= 3) & (grams[np.maximum(at - 3, 0)] == grams[np.maximum(m - 3, 0)])
        some = np.flatnonzero(forward | backward)
        at, m, need, owner = at[some], m[some], need[some], owner[some]
        far = forward[some] & (grams[np.minimum(at + need - 3, last)] == grams[np.minimum(m + need - 3, last)])
        far |= backward[some] & (grams[np.maximum(at - need, 0)] == grams[np.maximum(m - need, 0)])
        found.append(np.unique(owner[far]))
    return np.unique(np.concatenate(found))


def runs_of(ids: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """All runs (start, end, period) of each text, by start, then period; text i has the ids ``ids[offsets[i]:offsets[i+1]]``.

    Ids are 0 or more. Places count from the text's own first word.
    """
    texts = len(offsets) - 1
    out: list[dict] = [{} for _ in range(texts)]
    # one mark that equals nothing after each text, three at the end
    begin = offsets[:-1] + np.arange(texts)
    marked = -2 - np.arange(len(ids) + texts + 3, dtype=np.int64)
    marked[np.arange(len(ids)) + np.repeat(np.arange(texts), np.diff(offsets))] = ids
    w = marked.astype(np.uint64)
    grams = w[:-2] * _MIX[0] ^ w[1:-1] * _MIX[1] ^ w[2:] * _MIX[2]
    lists: dict[int, list[int]] = {}
    lo, hi = begin.copy(), begin + np.diff(offsets)
    text = np.arange(texts)
    while True:
        big = hi - lo >= LEAST
        lo, hi, text = lo[big], hi[big], text[big]
        if not len(lo):
            break
        mid = (lo + hi) // 2
        for k in _doubtful(grams, lo, mid, hi):
            t = int(text[k])
            first = int(begin[t])
            if t not in lists:
                lists[t] = ids[offsets[t] : offsets[t + 1]].tolist()
            whole, found = lists[t], out[t]
            for s, e, p in crossing(whole, int(lo[k]) - first, int(mid[k]) - first, int(hi[k]) - first):
                if e - s < max(LEAST, 2 * p):
                    continue  # the segment that holds the whole run has it
                if (s == lo[k] - first or e == hi[k] - first) and not _maximal(whole, s, e, p):
                    continue  # goes on outside; a segment further up has the whole run
                if found.get((s, e), p) >= p:
                    found[s, e] = p
        lo, hi, text = np.r_[lo, mid], np.r_[mid, hi], np.r_[text, text]
    return [sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2])) for found in out]


def _maximal(ids: list[int], s: int, e: int, p: int) -> bool:
    return (s == 0 or ids[s - 1] != ids[s - 1 + p]) and (e == len(ids) or ids[e] != ids[e - p])


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for s, e, p in runs:
        edge[s + p] += 1
        edge[e] -= 1
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id``, ``runs`` (start and length in words, smallest period; by start, then period), ``n_words``, ``collapsed``.

    Words lie between the six ASCII white-space characters. ``collapsed`` is the text without what its runs repeat: a word
    goes if a run contains it after that run's first period; the rest is joined by single spaces. A null or empty text has
    no words, no runs and an empty ``collapsed``. A row for each row, repeated ones too; an empty table gives none. Other
    columns are not looked at. A text is one unit of work: it takes about 150 bytes a word in memory.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            data, at = text_buffer(b.column("text"))
            raw = data.tobytes()
            for first, last in slices(at, _SLICE):
                intern: dict[bytes, int] = {}
                words = [raw[at[i] : at[i + 1]].split() for i in range(first, last)]  # bytes are split at ASCII white space only
                offsets = np.cumsum([0, *map(len, words)])
                ids = np.fromiter((intern.setdefault(w, len(intern)) for ws in words for w in ws), np.int64, offsets[-1])
                found = runs_of(ids, offsets)
                collapsed = [
                    b" ".join(ws if not r else [w for w, keep in zip(ws, kept_words(len(ws), r), strict=True) if keep]).decode() for ws, r in zip(words, found, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("id").slice(first, last - first),
                        pa.array([[{"start": s, "length": e - s, "period": p} for s, e, p in r] for r in found], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                        pa.array(np.diff(offsets), pa.int64()), pa.array(collapsed, pa.string()),
                    ],
                    names=["id", "runs", "n_words", "collapsed"],
                )

    return rows.mapInArrow(run, f"id {id_type}, {_OUT}")
