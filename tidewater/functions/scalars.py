"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def zero(column) -> Column:
    """Null becomes 0, as sums over nothing are shown."""
    return F.coalesce(column, F.lit(0))


def bucket(value: Column, edges: list[int]) -> Column:
    """Label of the half-open bucket that holds ``value``; null and anything else falls in the last."""
    out = F.when(value < edges[0], f"lt_{edges[0]}")
    for low, high in zip(edges, edges[1:], strict=False):
        out = out.when(value < high, f"{low}_{high}")
    return out.otherwise(f"ge_{edges[-1]}")


def days_of(bounds: DataFrame) -> DataFrame:
    """A row for each day from ``lo`` to ``hi``."""
    return bounds.withColumn("day", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))))


# What varies in an error message (after lower-casing and collapsing white space), in this order.
ERROR_MARKS = (
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<id>"),
    (r"\b[0-9a-f]{8,}\b", "<hex>"),
    (r"\b\d+\b", "<n>"),
    (r"'.*?'|\".*?\"", "<quoted>"),
    (r"/[^\s:]+", "<path>"),
)
# What varies in a log line, in this order.
LOG_MARKS = (
    (r"\b\d{4}-\d{2}-\d{2}[T ][0-9:.+-]+Z?\b", "<time>"),
    (r"\b\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\b", "<time>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b", "<id>"),
    (r"(?i)\b(?:0x)?[0-9a-f]{8,64}\b", "<id>"),
    (r"(?i)\b\d+(?:\.\d+)?\s*(?:ns|us|µs|ms|s|sec|secs|seconds?|m|min|mins|minutes?|h|hrs?|hours?)\b", "<duration>"),
    (r"(?i)\b\d+(?:\.\d+)?\s*(?:[kmgtpe]?i?b|bytes?)\b", "<size>"),
    (r"\b\d+(?:\.\d+)?%", "<percent>"),
    (r"(?<![A-Za-z_])[-+]?\d+(?:\.\d+)?(?![A-Za-z_])", "<n>"),
)


def marked(text: Column, marks) -> Column:
    for pattern, mark in marks:
        text = F.regexp_replace(text, pattern, mark)
    return text


def marked_sql(text: str, marks) -> str:
    """The same for DuckDB, whose patterns cannot look around themselves."""
    for pattern, mark in marks:
        pattern = pattern.replace("(?<![A-Za-z_])", "").replace("(?![A-Za-z_])", "").replace("'", "''")
        text = f"regexp_replace({text}, '{pattern}', '{mark}', 'g')"
    return text


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value. The parser stops behind the first value; in an array and in an object of its own only an end may follow there."""
    alone = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")) == 1
    return F.coalesce(alone & F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def error_fingerprint(message: Column, limit: int = 260) -> Column:
    """A message without what varies: ids, hex numbers, whole numbers, quoted text and paths, white space collapsed."""
    return F.substring(marked(F.regexp_replace(F.lower(F.trim(message)), r"\s+", " "), ERROR_MARKS), 1, limit)


def log_signature(line: Column) -> Column:
    """A log line without its volatile parts, white space collapsed."""
    return F.trim(F.regexp_replace(marked(line, LOG_MARKS), r"\s+", " "))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def words(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Lower-case words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"))


def token_estimate(text: Column) -> Column:
    """Tokens estimated as a quarter of the characters, rounded up."""
    return F.ceil(F.length(text) / 4)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of two arrays as sets; ``both_empty`` is the value for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision, 0 if either has length zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)
