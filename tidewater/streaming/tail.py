"""A streaming source that follows files which grow in place, by byte offsets.

Spark's own file source reads a file once and whole. Here an offset holds, for each file, how many bytes of whole lines have
been read; a batch reads what lies between two offsets, cut into pieces that tasks share. A last line without its end waits.
A file that has become shorter, or is gone, is void: a mark says so, and what is there now is read from its start.
"""

from __future__ import annotations

import io

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..registry import query
from ..shared import shared_folder
from ..sources.tables import table
from .folds import run_to_end

SCHEMA = "file string, start long, line string, void boolean"
#: Bytes of a task's piece, and of one look backwards for the end of the last whole line.
PIECE, LOOK = 32 << 20, 64 << 10
_ROWS = 10_000


class Piece(InputPartition):
    """Lines of ``file`` that start in [``first``, ``last``); ``cut`` says that a line may reach into it from before."""

    def __init__(self, file: str, first: int, last: int, cut: bool):
        self.file, self.first, self.last, self.cut = file, first, last, cut


class Void(InputPartition):
    def __init__(self, file: str):
        self.file = file


class LineTail(DataSource):
    """``spark.readStream.format("line_tail")`` with ``path``, a folder, and ``suffix``, the files of it that are followed."""

    @classmethod
    def name(cls) -> str:
        return "line_tail"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LineTailReader:
        return LineTailReader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("piece", PIECE)))


class LineTailReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, piece: int):
        self.path, self.suffix, self.piece, self.known = path, suffix, piece, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        out = {}
        for info in sorted((i for i in found if i.is_file and i.path.endswith(self.suffix)), key=lambda i: i.path):
            state = (info.size, info.mtime_ns)
            if self.known.get(info.path, (None, 0))[0] != state:
                self.known[info.path] = (state, _whole_lines(store, info.path, info.size))
            out[info.path] = self.known[info.path][1]
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out: list[InputPartition] = [Void(f) for f in sorted(start) if end.get(f, 0) < start[f]]
        for file, upto in sorted(end.items()):
            begin = start.get(file, 0) if start.get(file, 0) <= upto else 0
            for first in range(begin, upto, self.piece):
                out.append(Piece(file, first, min(first + self.piece, upto), first > begin))
        return out

    def read(self, partition: InputPartition):
        if isinstance(partition, Void):
            yield _batch(partition.file, [0], [None], True)
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        starts: list[int] = []
        lines: list[str] = []
        with store.open_input_file(partition.file) as raw, io.BufferedReader(raw, 1 << 20) as f:
            at = partition.first
            if partition.cut:
                f.seek(at - 1)
                at += len(f.readline()) - 1  # the rest of the line before
            else:
                f.seek(at)
            while at < partition.last and (line := f.readline()).endswith(b"\n"):
                if text := line.decode("utf-8", "replace").strip():
                    starts.append(at)
                    lines.append(text)
                at += len(line)
                if len(lines) == _ROWS:
                    yield _batch(partition.file, starts, lines, False)
                    starts, lines = [], []
        if lines:
            yield _batch(partition.file, starts, lines, False)


def _batch(file: str, starts: list[int], lines: list[str | None], void: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines), pa.string()), pa.array(starts, pa.int64()), pa.array(lines, pa.string()), pa.array([void] * len(lines))], names=["file", "start", "line", "void"])


def _whole_lines(store: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the end of the last whole line."""
    with store.open_input_file(path) as f:
        while size > 0:
            first = max(0, size - LOOK)
            f.seek(first)
            if (at := f.read(size - first).rfind(b"\n")) >= 0:
                return first + at + 1
            size = first
    return 0


# ---------------------------------------------------------------- frames
def tail_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl", piece: int = PIECE) -> DataFrame:
    """``file``, ``start`` (its byte), ``line``, ``void`` of the files below ``folder`` as they grow. Blank lines have no row."""
    spark.dataSource.register(LineTail)
    return spark.readStream.format("line_tail").option("path", folder).option("suffix", suffix).option("piece", piece).load()


def standing(rows: DataFrame) -> DataFrame:
    """Of rows with the ``epoch`` they came in, those that no later mark has made void; a line that came twice counts once."""
    marks = rows.where("void").groupBy("file").agg(F.max("epoch").alias("_since"))
    kept = rows.where("NOT void").join(marks, "file", "left").where(F.col("_since").isNull() | (F.col("epoch") >= F.col("_since")))
    return kept.groupBy("file", "start").agg(F.max_by("line", "epoch").alias("line"))


def follow(spark: SparkSession, folder: str, state: str, out: str, suffix: str = ".jsonl", piece: int = PIECE) -> DataFrame:
    """Read what the files have got since the last call with the same ``state``, and return all lines that stand, from ``out``."""
    return standing(run_to_end(tail_lines(spark, folder, suffix, piece), "append", state, out))


@query("tailed_events", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total, max(event_id) AS last_event FROM events GROUP BY 1")
def tailed_events(spark, sf_dir):
    """Events that arrive as lines of JSON in two goes; the second run goes on from where the first one ended."""
    landing, state, out = (shared_folder(spark, name) for name in ("tail", "state", "sink"))
    e = table(spark, sf_dir, "events")
    found = None
    for part in range(2):
        e.where(F.col("event_id") % 2 == part).select(F.to_json(F.struct("event_id", "user_id", "value")).alias("value")).write.text(f"{landing}/part{part}")
        found = follow(spark, landing, state, out, ".txt")
    v = found.select(F.from_json("line", "event_id long, user_id long, value double").alias("v")).select("v.*")
    return v.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"), F.max("event_id").alias("last_event"))
