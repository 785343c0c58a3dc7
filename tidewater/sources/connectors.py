"""Sources and sinks: connection discovery, tolerant readers, upsert, replace-partition and export."""

import hashlib
import hmac
import json
import os
import re
from pathlib import Path
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Variables that name a connection, in the order in which they are looked up.
URL_KEYS = ("DATABASE_URL", "POSTGRES_URL", "POSTGRESQL_URL", "MYSQL_URL", "SQLITE_URL")
TIME_FIELDS = ("at", "updated_at", "created_at", "captured_at", "ts")


# ---------------------------------------------------------------- connections
def discover_url(env: dict[str, str], files: list[str] = ()) -> str | None:
    """The first connection URL of the environment, then of the given ``.env`` files."""
    for key in URL_KEYS:
        if env.get(key):
            return env[key]
    for name in files:
        if os.path.isfile(name):
            pairs = dict(re.findall(r"^\s*(?:export\s+)?(\w+)\s*=\s*[\"']?([^\"'\n]*)", Path(name).read_text(), re.M))
            if found := discover_url(pairs):
                return found
    return None


def dialect_of(url: str, alias: str | None = None) -> str:
    """An explicit alias, else the URL's scheme, else SQLite."""
    scheme = (alias or urlsplit(url).scheme or "sqlite").lower().split("+")[0]
    return {"postgresql": "postgres", "mariadb": "mysql", "sqlite3": "sqlite"}.get(scheme, scheme)


def mask_url(url: str) -> str:
    return re.sub(r"(://[^:/@]+:)[^@]*@", r"\1****@", url)


def checked_path(path: str, root: str) -> str:
    """``path`` if it lies in ``root`` once decoded and resolved."""
    plain = unquote(path)
    if "\0" in plain:
        raise ValueError("the path has a NUL in it")
    full = Path(root, plain).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} lies outside {root}")
    return str(full)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table over JDBC; the driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


# ---------------------------------------------------------------- readers
def read_ledger(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines; blank and broken ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def since(rows: DataFrame, instant: Column, fields: tuple[str, ...] = TIME_FIELDS) -> DataFrame:
    """Rows whose first time field that has a value is at ``instant`` or later."""
    there = [F.to_timestamp(c) for c in fields if c in rows.columns]
    return rows.where(F.coalesce(*there) >= instant) if there else rows.limit(0)


def recent_files(spark: SparkSession, path: str, after: str | None = None) -> DataFrame:
    """Files under ``path``, newest first."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if after:
        reader = reader.option("modifiedAfter", after)
    return reader.load(path).select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def bounded_corpus(files: DataFrame, most_files: int = 500, most_bytes: int = 250_000, total: int = 10_000_000) -> DataFrame:
    """Files up to a size, in the order of their paths, until the count or the total is reached."""
    w = Window.orderBy("path")
    small = files.where(F.col("length") <= most_bytes)
    return small.withColumns({"_n": F.row_number().over(w), "_sum": F.sum("length").over(w)}).where((F.col("_n") <= most_files) & (F.col("_sum") <= total)).drop("_n", "_sum")


def cap_records(rows: DataFrame, column: str, limit: int) -> DataFrame:
    """Long values are cut; the whole one's hash and length are kept beside them."""
    return rows.withColumns({f"{column}_sha256": F.sha2(column, 256), f"{column}_length": F.length(column), column: F.left(column, F.lit(limit))})


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def branch_of(ids: list, parents: list, positions: list) -> list[int]:
    """Places of the entries from the last one (by position) up to its root; a cycle ends where it closes."""
    at = {i: k for k, i in enumerate(ids)}
    here, out = ids[max(range(len(ids)), key=lambda k: positions[k])], []
    while here in at and at[here] not in out:
        out.append(at[here])
        here = parents[at[here]]
    return sorted(out)


def active_branch(entries: DataFrame) -> DataFrame:
    """Entries (``session``, ``pos``, ``id``, ``parent``) on the way from a session's last entry up to its root.

    Any depth and order of the parents; a session's log is one group, walked with a dictionary.
    """

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        parents = [None if pd.isna(p) else int(p) for p in pdf.parent]
        kept = pdf.iloc[branch_of(pdf.id.tolist(), parents, pdf.pos.tolist())]
        return kept.astype({"parent": "Int64"})

    return entries.select("session", "pos", "id", "parent").groupBy("session").applyInPandas(walk, "session long, pos long, id long, parent long")


# ---------------------------------------------------------------- sinks
def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables as one, the latest row of each key; changes win a tie."""
    both = current.withColumn("_side", F.lit(0)).unionByName(changes.withColumn("_side", F.lit(1)))
    return latest_per_key(both, keys, [order, "_side"]).drop("_side")


def insert_or_existing(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows with ``dedup_hit``: whether the table has the key already."""
    known = current.select(*keys).distinct().withColumn("dedup_hit", F.lit(True))
    return incoming.join(known, keys, "left").withColumn("dedup_hit", F.coalesce("dedup_hit", F.lit(False)))


def version_conflicts(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Changes whose expected version is not the current one."""
    now = current.select(key, F.col("version").alias("_now"))
    return changes.join(now, key, "left").where(F.col("expected_version") != F.coalesce("_now", F.lit(0))).drop("_now")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite just the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def export_bundle(tables: dict[str, DataFrame], path: str, secret: bytes) -> dict:
    """JSON files with a manifest of their content hashes and its HMAC. Hashes do not depend on the order of rows."""
    manifest = {}
    for name, df in sorted(tables.items()):
        df.write.mode("overwrite").json(f"{path}/{name}")
        line = F.xxhash64(F.to_json(F.struct(*sorted(df.columns))))
        n, total = df.agg(F.count("*"), F.coalesce(F.sum(line.cast("decimal(38,0)")), F.lit(0))).first()
        manifest[name] = {"rows": n, "digest": hashlib.sha256(f"{n}:{total}".encode()).hexdigest()}
    signature = hmac.new(secret, json.dumps(manifest, sort_keys=True).encode(), hashlib.sha256).hexdigest()
    return {"files": manifest, "signature": signature}


def spill(df: DataFrame, path: str, preview: int = 20) -> tuple[list, str]:
    """The whole result to a file, the first rows and the place to the caller."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).limit(preview).collect(), path
