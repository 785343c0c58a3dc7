"""Toxicity by two class-conditional Kneser-Ney models over the letters of words.

A word is its letters between two marks. Each class, toxic and ordinary, has a model of the next letter given up to
``ORDER - 1`` letters: class counts with absolute discounting on top, and below them Kneser-Ney continuation counts that
both classes share, so that a rare form of an expression gets its probability from the parts that it has in common with
others. A word's log-likelihood under the toxic model less that under the ordinary one is its evidence. A document is
described by that evidence: the sum over its length, the strongest words (over their own length and whole), and how many
strong ones there are over the document's length. A logistic function fitted on labelled documents kept apart from the
counts turns this into a probability.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ppm import HashTable

ORDER = 6
DISCOUNT = 0.75
#: Labelled documents of each class that are learnt from, chosen by a hash of the id (about; all where there are fewer).
DOCS_PER_CLASS = 6_000
#: Of these, one in so many fits the logistic function instead.
CALIBRATE = 3
THRESHOLD = 0.7
#: Evidence of a word from which it counts as strong.
STRONG = 3.0
REMEMBERED = 600_000
START, STOP = "\x02", "\x03"
_WORD = re.compile(r"[^\W\d_]+")
_PRIME = np.uint64(0x100000001B3)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


# ---------------------------------------------------------------- model
class Model:
    def __init__(self, grams: list[str], toxic: np.ndarray, ordinary: np.ndarray, continuations: np.ndarray):
        """Grams of 1 to ``ORDER`` letters with their counts in each class and the number of different letters before."""
        index = {g: i for i, g in enumerate(grams)}
        n = len(grams)
        context = np.array([index.get(g[:-1], n) for g in grams], dtype=np.int64) if n else np.zeros(0, np.int64)
        # the empty context is one more row
        self.counts = [np.r_[x, 0].astype(np.float64) for x in (toxic, ordinary, continuations)]
        single = np.array([len(g) == 1 for g in grams], dtype=bool) if n else np.zeros(0, bool)
        known = single | (context < n)
        self.totals = [np.bincount(context[known], weights=x[:-1][known], minlength=n + 1) for x in self.counts]
        self.kinds = [np.bincount(context[known], weights=x[:-1][known] > 0, minlength=n + 1).astype(np.float64) for x in self.counts]
        self.n = n
        self.letters = max(1, int(single.sum()))
        keys = self._keys_of(grams)
        self.table = HashTable(keys, np.arange(n, dtype=np.int64))

    @staticmethod
    def _keys_of(grams: list[str]) -> np.ndarray:
        if not grams:
            return np.zeros(0, np.int64)
        lengths = np.array([len(g) for g in grams])
        points = np.frombuffer("".join(g.rjust(ORDER, "\0") for g in grams).encode("utf-32-le"), dtype=np.uint32).reshape(-1, ORDER).astype(np.uint64)
        h = np.zeros(len(grams), np.uint64)
        for j in range(ORDER):
            real = ORDER - j <= lengths
            h = np.where(real, h * _PRIME + points[:, j] + np.uint64(1), h)
        return Model._finish(h, lengths)

    @staticmethod
    def _finish(h: np.ndarray, n) -> np.ndarray:
        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.asarray(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(1)).astype(np.int64)

    def evidence(self, words: list[str]) -> np.ndarray:
        """Toxic less ordinary log-likelihood of each word."""
        if not words:
            return np.zeros(0)
        marked = [START + w + STOP for w in words]
        lengths = np.array([len(w) for w in marked])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        total = len(points)
        inside = np.arange(total) - np.repeat(starts, lengths)  # letters before, the start mark included
        rows = np.full((ORDER + 1, total), self.n, dtype=np.int64)
        known = np.zeros((ORDER + 1, total), bool)
        known[0] = True
        h = np.zeros(total, np.uint64)
        for k in range(1, ORDER + 1):
            before = np.r_[np.uint64(0), h[:-1]]
            h = before * _PRIME + points + np.uint64(1)
            ok = np.flatnonzero(inside >= k - 1)
            slot = self.table.find(self._finish(h[ok], k))
            hit = slot >= 0
            rows[k, ok[hit]] = self.table.values[slot[hit]]
            known[k, ok[hit]] = True
        shared = np.full(total, 1.0 / (self.letters + 1))
        p = [shared, shared]
        for k in range(1, ORDER + 1):
            # the context is the gram of k - 1 letters that ends one letter earlier
            context = np.r_[self.n, rows[k - 1, :-1]] if k > 1 else np.full(total, self.n)
            there = np.r_[False, known[k - 1, :-1]] if k > 1 else np.ones(total, bool)
            full = inside == k - 1  # the whole word so far: nothing longer can follow
            top = (inside >= k - 1) & (full | (k == ORDER))
            for c in (0, 1):
                p[c] = np.where(top, self._step(c, rows[k], known[k], context, there, shared), p[c])
            shared = np.where((inside >= k - 1) & ~top, self._step(2, rows[k], known[k], context, there, shared), shared)
        gain = np.log(p[0]) - np.log(p[1])
        gain[starts] = 0.0  # the start mark itself
        return np.add.reduceat(gain, starts)

    def _step(self, c: int, row, known, context, there, lower) -> np.ndarray:
        total = self.totals[c][context]
        use = there & (total > 0)
        safe = np.where(use, total, 1.0)
        count = np.where(known, self.counts[c][row], 0.0)
        return np.where(use, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * self.kinds[c][context] * lower) / safe, lower)


def describe(texts: list[str | None], model: Model, known: dict[str, float]) -> np.ndarray:
    """Six numbers for each text; ``known`` remembers the evidence of words."""
    if len(known) > REMEMBERED:
        known.clear()
    cut = [words_of(t) for t in texts]
    fresh = list({w for words in cut for w in words}.difference(known))
    for i in range(0, len(fresh), 50_000):
        known.update(zip(fresh[i : i + 50_000], model.evidence(fresh[i : i + 50_000]).tolist(), strict=True))
    out = np.zeros((len(texts), 6))
    for row, words in enumerate(cut):
        if not words:
            continue
        gain = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        length = np.fromiter(map(len, words), np.float64, len(words)) + 1
        strong = gain > STRONG
        best = np.sort(gain)[-2:] if len(gain) > 1 else np.array([0.0, gain[0]])
        out[row] = (gain.sum() / length.sum(), best[1] / 10, best[0] / 10, (gain / length).max(), np.log1p(gain[strong].sum()), strong.mean() * 10)
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, toxic_share: float, ridge: float = 1e-2) -> np.ndarray:
    """Weights (the constant last) by Newton's method; the classes count as their shares among all labelled documents."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[-1] = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return w
    share = np.where(y == 1, toxic_share / (y == 1).sum(), (1 - toxic_share) / (y == 0).sum()) * len(y)
    penalty = ridge * np.eye(len(w))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (share * (p - y)) + penalty @ w
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


# ---------------------------------------------------------------- Spark side
def train(docs: DataFrame, labels: DataFrame, text_column: str = "text", label_column: str = "toxic", id_column: str = "doc_id", docs_per_class: int = DOCS_PER_CLASS):
    """The models and the logistic weights, from documents whose label is 0 or 1; others are left out.

    The sample is drawn from ``labels`` (``id_column``, ``label_column``) alone, about ``docs_per_class`` of each class, so
    that it can be broadcast to the documents and no text is shuffled.
    """
    known = labels.where(F.col(label_column).isin(0, 1)).select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label"))
    sizes = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    share = F.when(F.col("_label") == 1, min(1.0, docs_per_class / max(1, sizes.get(1, 0)))).otherwise(min(1.0, docs_per_class / max(1, sizes.get(0, 0))))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 20))
    drawn = F.broadcast(known.where(draw / float(1 << 20) < share))
    texts = docs.select(F.col(id_column).alias("_doc"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("_text"))
    sample = texts.join(drawn, F.col("_doc") == F.col("_id"))
    apart = F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(CALIBRATE)) == 0

    def count_words(batches):
        found = [Counter(), Counter()]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[label].update(words_of(text))
        words = list(found[0].keys() | found[1].keys())
        for i in range(0, len(words), 100_000):
            some = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *(pa.array([found[c][w] for w in some], pa.int64()) for c in (1, 0))], ["word", "toxic", "ordinary"])

    def count_grams(batches):
        toxic: Counter[str] = Counter()
        ordinary: Counter[str] = Counter()
        for batch in batches:
            for word, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                marked = START + word + STOP
                for stop in range(1, len(marked) + 1):
                    for start in range(max(0, stop - ORDER), stop):
                        gram = marked[start:stop]
                        toxic[gram] += a
                        ordinary[gram] += b
        grams = list(toxic)
        for i in range(0, len(grams), 100_000):
            some = grams[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([toxic[g] for g in some], pa.int64()), pa.array([ordinary[g] for g in some], pa.int64())], ["gram", "toxic", "ordinary"])

    words = sample.where(~apart).select("_text", "_label").mapInArrow(count_words, "word string, toxic long, ordinary long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    grams = words.mapInArrow(count_grams, "gram string, toxic long, ordinary long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    grams = grams.persist()
    # every gram counts, those seen once above all; the sample bounds how many there are
    # letters that can stand before a gram: how many longer grams end in it
    longer = grams.where(F.length("gram") > 1).groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("continuations"))
    got = grams.join(longer, "gram", "left").select("gram", "toxic", "ordinary", F.coalesce("continuations", F.lit(0)).alias("continuations")).toArrow()
    grams.unpersist()
    columns = [got.column(c).to_numpy() for c in ("toxic", "ordinary", "continuations")]
    model = Model(got.column("gram").to_pylist(), *columns)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def features(batches):
        known: dict[str, float] = {}
        for batch in batches:
            x = describe(batch.column(0).to_pylist(), shared.value, known)
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(x[:, i].copy()) for i in range(6))], ["label", *(f"x{i}" for i in range(6))])

    # a row for each document of the sample that was kept apart
    kept = sample.where(apart).select("_text", "_label").mapInArrow(features, "label int, " + ", ".join(f"x{i} double" for i in range(6))).toArrow()
    x = np.stack([kept.column(f"x{i}").to_numpy() for i in range(6)], axis=1) if kept.num_rows else np.zeros((0, 6))
    return shared, fit_logistic(x, kept.column("label").to_numpy(), sizes.get(1, 0) / max(1, sum(sizes.values())))


def predict(docs: DataFrame, trained, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns with ``score`` (0 to 1) and ``predicted`` (1 from ``THRESHOLD`` on)."""
    shared, weights = trained
    rows = docs.select(*[F.col(c) for c in carry], F.col(text_column).cast("string").alias("_text"))
    schema = rows.drop("_text").schema.add("score", "double")
    names = [f.name for f in schema]

    def run(batches):
        known: dict[str, float] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                x = describe(batch.column(len(carry)).to_pylist(), shared.value, known)
                score = 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ weights, -30, 30)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(score)], names)

    return rows.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def detect(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), **columns) -> DataFrame:
    """Train on those of ``docs`` that ``labels`` has, and score all of ``docs``.

    Null and empty texts, and texts without letters, get the score of no evidence. Documents without a label, or with one
    other than 0 and 1, are not learnt from; with labels of one class only the score is the same for all texts, near that
    class; with none it is 0.5. Rows that repeat an id are learnt from each. Empty tables give empty results.
    """
    return predict(docs, train(docs, labels, **columns), text_column=columns.get("text_column", "text"), carry=carry)
