"""Folders that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_leaving: dict[str, tuple] = {}

#: Rows of one task of a table dealt by ``dealt``, about.
TASK_ROWS = 500_000


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, on one machine, a temporary folder of this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _own:
            keep = tempfile.TemporaryDirectory(prefix="tidewater-")
            atexit.register(keep.cleanup)
            _own.append(keep.name)
        root = f"file://{_own[0]}"
    return f"{root.rstrip('/')}/tidewater"


def application_folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one; what is left there goes when the driver's process ends."""
    folder = f"{shared_root(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _leaving:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        _leaving[folder] = (path.getFileSystem(spark._jsc.hadoopConfiguration()), path)
        if len(_leaving) == 1:
            atexit.register(_remove_all)
    return folder


def _remove_all() -> None:
    for fs, path in _leaving.values():
        with contextlib.suppress(Exception):  # the JVM may be gone before the process
            fs.delete(path, True)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors share, for tables that this application alone needs."""
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a new shared folder and read back: worked out once, without the lineage before."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, *keys, task_rows: int = TASK_ROWS) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys`` to as many tasks as these need: a task stays as small on larger tables.

    Left to itself Spark joins parts up to a size that is counted compressed, many times less than what a sort of them holds.
    """
    return df.repartition(max(1, math.ceil(rows / task_rows)), *keys)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame made by ``written`` that nothing will read again."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def kept(make: Callable[[], DataFrame], source: DataFrame, label: str) -> DataFrame:
    """What ``make`` gives, written once for each state of ``source``'s files: their names, sizes and times are the key.

    ``source`` must be files as they were read, and ``make`` depend on them alone. Half-written results are not seen.
    """
    spark = source.sparkSession
    fs_of = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration())
    state = []
    for name in sorted(source.inputFiles()):
        status = fs_of(path := spark._jvm.org.apache.hadoop.fs.Path(name)).getFileStatus(path)
        state.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    folder = f"{shared_root(spark)}/{label}-{hashlib.sha256(chr(10).join(state).encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not fs_of(done).exists(done):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)
