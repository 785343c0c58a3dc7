"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; characters that are not letters become spaces. All 1- to 3-grams of characters are hashed to
``BUCKETS`` buckets. The log-probability matrix (buckets x languages) is broadcast: its size is fixed by the number of
buckets and of languages, and checked. Scoring works on whole Arrow batches in numpy: only the grams that occur are
looked up, and their rows are summed per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_buffer

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
#: The classifier is fitted on at most about so many documents of each language, chosen by a hash of the id.
TRAIN_DOCS_PER_LANGUAGE = 20_000
#: Above this many bytes the matrix is refused rather than broadcast.
MATRIX_LIMIT = 256 << 20
#: For the score, log-odds of more grams than this are scaled to the weight of so many: long texts do not all score 1.
EVIDENCE = 60.0
UNKNOWN = "und"
_CHUNK = 250_000
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    if not _letters:
        table = np.full(0x110000, 32, dtype=np.uint32)
        points = [i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
        table[points] = points
        _letters.append(table)
    return _letters[0]


def _chunks(texts: list[str]):
    """Lists of (index, piece, before) with about ``_CHUNK`` characters; a longer text comes in several pieces.

    Texts have a space on either side. A later piece starts with the ``before`` characters that lead up to it, so that
    the grams that end after these are, over all pieces, those of the whole text.
    """
    held, size, most = [], 0, max(ORDERS) - 1
    for i, text in enumerate(texts):
        text = f" {text} "
        for start in range(0, len(text), _CHUNK):
            before = min(most, start)
            piece = text[start - before : start + _CHUNK]
            if held and size + len(piece) > _CHUNK:
                yield held
                held, size = [], 0
            held.append((i, piece, before))
            size += len(piece)
    if held:
        yield held


def _grams(held: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every gram, owner (position in ``held``) of every gram, letters of each piece."""
    sizes = np.array([len(p) for _, p, _ in held])
    points = _letter_table()[np.frombuffer("".join([p for _, p, _ in held]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    owner = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
    own = np.ones(len(points), bool)
    for start, (_, _, before) in zip(np.cumsum(sizes) - sizes, held, strict=True):
        if before:
            own[start : start + before] = False
    letters = np.bincount(owner, weights=own & (points != 32), minlength=len(held)).astype(np.int64)
    buckets, owners = [], []
    shift = np.uint32(32 - int(np.log2(BUCKETS)))
    h = np.zeros(len(points), dtype=np.uint32)
    for n in ORDERS:
        h = (h[: len(points) - n + 1] + points[n - 1 :]) * _FACTORS[n - 1]
        # runs of spaces say nothing
        keep = own[n - 1 :] & (owner[: len(h)] == owner[n - 1 :]) & (points[: len(h)] + points[n - 1 :] != 64)
        buckets.append((h[keep] >> shift).astype(np.int32))
        owners.append(owner[: len(h)][keep])
        h = h ^ (h >> np.uint32(15))
    return np.concatenate(buckets), np.concatenate(owners), letters


def _lowered(column: pa.Array):
    """(first row, lower-cased texts) of consecutive rows that hold about ``_CHUNK`` bytes."""
    for first, last in slices(text_buffer(column)[1], _CHUNK):
        yield first, [(t or "").lower() for t in column.slice(first, last - first).to_pylist()]


def train(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", id_column: str = "doc_id", docs_per_language: int = TRAIN_DOCS_PER_LANGUAGE):
    """Languages (sorted) and the matrix of log probabilities, the prior as its last row.

    Rows with a null text or label are left out. Counts come from a sample of about ``docs_per_language`` documents for
    each language (all of them where there are fewer), the prior from all.
    """
    rows = labelled.where(F.col(text_column).isNotNull() & F.col(label_column).isNotNull())
    priors = {r[0]: r[1] for r in rows.groupBy(F.col(label_column)).count().toLocalIterator()}
    languages = sorted(priors)
    if not languages:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    if len(languages) * (BUCKETS + 1) * 4 > MATRIX_LIMIT:
        raise ValueError(f"{len(languages)} languages: the matrix would exceed {MATRIX_LIMIT} bytes")
    share = F.element_at(F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / priors[k]))]), F.col(label_column))
    uniform = F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 20)) / float(1 << 20)
    index = {k: i for i, k in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in batches:
            labels = batch.column(1).to_pylist()
            for first, texts in _lowered(batch.column(0)):
                for held in _chunks(texts):
                    buckets, owners, _ = _grams(held)
                    of = np.array([index[labels[first + i]] for i, _, _ in held])[owners]
                    total += np.bincount(of * BUCKETS + buckets, minlength=total.size).reshape(total.shape)
        who, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[who, bucket], pa.int64())], ["language", "bucket", "n"])

    sample = rows.where(uniform < share).select(F.col(text_column).cast("string"), F.col(label_column))
    # one row for each language and bucket at most, whatever the input
    got = sample.mapInArrow(count, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    np.add.at(counts, (got["bucket"].to_numpy(), got["language"].to_numpy()), got["n"].to_numpy())
    matrix = np.log(counts / counts.sum(axis=0))
    prior = np.log(np.array([priors[k] for k in languages], dtype=np.float64) / sum(priors.values()))
    return languages, np.vstack([matrix, prior]).astype(np.float32)


def score_texts(texts: list[str], languages: list[str], matrix: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each lower-cased text.

    The language is that of the largest log prior plus log-likelihood of all grams. The score is its posterior after all
    log-odds are scaled to the weight of ``EVIDENCE`` grams where there are more.
    """
    n, k = len(texts), len(languages)
    if not k:
        return [UNKNOWN] * n, np.zeros(n)
    total, grams, letters = np.zeros((n, k)), np.zeros(n), np.zeros(n, np.int64)
    for held in _chunks(texts):
        of = np.array([i for i, _, _ in held])
        buckets, owners, found = _grams(held)
        for j in range(k):
            np.add.at(total[:, j], of, np.bincount(owners, weights=matrix[:, j][buckets], minlength=len(held)))
        np.add.at(grams, of, np.bincount(owners, minlength=len(held)))
        np.add.at(letters, of, found)
    logits = total + matrix[-1]
    best = logits.argmax(axis=1)
    odds = (logits - logits.max(axis=1, keepdims=True)) * (np.minimum(grams, EVIDENCE) / np.maximum(grams, 1))[:, None]
    posterior = 1.0 / np.exp(odds).sum(axis=1)
    return [languages[b] if m else UNKNOWN for b, m in zip(best, letters, strict=True)], np.where(letters > 0, posterior, 0.0)


def classifier(spark: SparkSession, languages: list[str], matrix: np.ndarray):
    """A function from a text column to a struct of ``language`` and ``score``; rows themselves stay in the engine.

    A null text, or one without a letter, is ``und`` with 0. The function counts as non-deterministic, so that a filter on
    its result does not run it again.
    """
    model = spark.sparkContext.broadcast((languages, matrix))
    kind = pa.struct([("language", pa.string()), ("score", pa.float64())])

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, logs = model.value
        for column in columns:
            column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
            said, scores = [], []
            for _, texts in _lowered(column):
                a, b = score_texts(texts, known, logs)
                said += a
                scores.append(b)
            found = [pa.array(said, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))]
            yield pa.StructArray.from_arrays(found, fields=list(kind))

    return F.arrow_udf(run, "language string, score double").asNondeterministic()


def predict(docs: DataFrame, languages: list[str], matrix: np.ndarray, text_column: str = "text", carry: tuple[str, ...] = ("doc_id",), into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The ``carry`` columns with the language and its score; a null text, or one without a letter, is ``und`` with 0."""
    found = classifier(docs.sparkSession, languages, matrix)(docs[text_column].cast("string")).alias("_found")
    out = docs.select(*[docs[c] for c in carry], found)
    return out.select(*[out[c] for c in carry], out["_found"]["language"].alias(into[0]), out["_found"]["score"].alias(into[1]))


def identify(docs: DataFrame, training: DataFrame | None = None, carry: tuple[str, ...] = ("doc_id",), **columns) -> DataFrame:
    """Train on ``training`` (or on ``docs`` itself) and predict ``docs``.

    No labelled row at all: every text is ``und``. Empty tables give empty results. Long texts are scored whole, in
    pieces of bounded size between which no gram is lost. Ties go to the language that sorts first. Repeated rows get
    equal answers. Other columns than text, label, id and ``carry`` are not read.
    """
    return predict(docs, *train(docs if training is None else training, **columns), text_column=columns.get("text_column", "text"), carry=carry)
