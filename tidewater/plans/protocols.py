"""What other code can plug in: embedders, reducers, providers, retrievers, sources and stores; and cached results."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterable, Sequence
from typing import Protocol, runtime_checkable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder
from .versions import VersionedTable


@runtime_checkable
class Embedder(Protocol):
    name: str
    dim: int

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def embedding_udf(embedder: Embedder) -> Callable[[Column], Column]:
    """The embedder on Arrow batches; null stays null. Vectors of another length than ``dim`` are an error."""

    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        some = texts[texts.notna()]
        for i, v in zip(some.index, embedder.embed(some.tolist()), strict=True):
            if len(v) != embedder.dim:
                raise ValueError(f"{embedder.name} gave a vector of {len(v)} numbers, not {embedder.dim}")
            out[i] = [float(x) for x in v]
        return out

    return F.pandas_udf(run, "array<float>")


class Registry:
    """Names for functions, the last registration wins; made on first use."""

    def __init__(self, kind: str):
        self.kind, self._makers, self._made = kind, {}, {}

    def put(self, name: str, maker: Callable[[], object]) -> None:
        self._makers[name] = maker
        self._made.pop(name, None)

    def get(self, name: str):
        if name not in self._makers:
            raise KeyError(f"no {self.kind} named {name!r}; known: {', '.join(sorted(self._makers))}")
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._makers)


#: Grouped reducers (DataFrame, keys) -> DataFrame, and readers of a host's sessions (spark, path) -> DataFrame.
REDUCERS = Registry("reducer")
SOURCES = Registry("source")


class Provider(Protocol):
    name: str

    def healthy(self) -> bool: ...

    def answer(self, question: str, **options) -> DataFrame | None: ...


def first_answer(providers: Iterable[Provider], question: str, **options) -> tuple[str, DataFrame] | None:
    """The first healthy provider's answer and its name; one that fails or has none is passed over."""
    for p in providers:
        try:
            found = p.answer(question, **options) if p.healthy() else None
        except (AnalysisException, OSError, RuntimeError, ValueError):
            continue
        if found is not None:
            return p.name, found
    return None


class Retriever(Protocol):
    def retrieve(self, query: str, budget_tokens: int, max_items: int, seeds: Sequence[str] = ()) -> DataFrame: ...


class Store:
    """Tables in a folder by name, each with versions; a row put again under its key replaces the one before."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str, keys: list[str]) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder}/{name}", keys)

    def read(self, name: str) -> DataFrame | None:
        """The last version, None if there is none: a version whose writing failed, or that lost a race, is not seen."""
        rows = self.table(name, []).read()
        return rows if rows is None else rows.drop("version", "actor")

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Insert and replace by key. Two writers come one after the other, so that no row of either is lost."""
        self.table(name, keys).put(rows)


class ResultCache:
    """Results written once, by the digest of arguments and versions; other versions miss.

    With a folder that sessions share, what one has written is a hit for the others. A result whose writing failed is a miss.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, (folder or shared_folder(spark, "results")).rstrip("/")

    @staticmethod
    def key(tool: str, arguments: dict, **versions: str) -> str:
        return hashlib.sha256(json.dumps([tool, arguments, versions], sort_keys=True, default=str).encode()).hexdigest()

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        fs, done = self._path(f"{key}/_SUCCESS")
        if not fs.exists(done):
            make().write.mode("overwrite").parquet(f"{self.folder}/{key}")
        return self.spark.read.parquet(f"{self.folder}/{key}")

    def prune(self, older_than: float) -> int:
        """Remove results that were written more than so many seconds ago; how many went."""
        fs, root = self._path()
        old = [s.getPath() for s in (fs.listStatus(root) if fs.exists(root) else []) if s.getModificationTime() / 1000 < time.time() - older_than]
        for path in old:
            fs.delete(path, True)
        return len(old)
