"""Export of product events as log records, in files that are there after a commit and not before.

Each task writes its records to a file of its own aside. The commit, on the driver, moves the files of the tasks that won to
their place and then notes the batch as done; an abort removes them. A batch that is noted already is not written a second time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..registry import query
from ..shared import shared_folder
from ..sources.tables import table

SEVERITY = "DEBUG"


def record(name: str, properties: dict) -> dict:
    """An event as a log record: its name is the body, properties are attributes, lists and objects among them as JSON text."""
    flat = {k: json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list, tuple)) else v for k, v in properties.items()}
    return {"body": name, "severity_text": SEVERITY, "attributes": {"event.name": name, **flat}}


@dataclass
class Written(WriterCommitMessage):
    path: str
    rows: int


class EventExport(DataSource):
    """``df.write.format("event_export")`` with ``path``, a folder, and ``batch``, a name under which a rerun is known."""

    @classmethod
    def name(cls) -> str:
        return "event_export"

    def writer(self, schema, overwrite: bool) -> EventWriter:
        return EventWriter(self.options["path"].rstrip("/"), self.options["batch"])


class EventWriter(DataSourceWriter):
    """Rows hold ``event`` (a name) and ``props`` (JSON text, null for none); what is no object of JSON is the attribute ``value``."""

    def __init__(self, path: str, batch: str):
        self.path, self.batch, self.attempt = path, batch, uuid.uuid4().hex

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._store()
        aside, rows = f"{root}/aside/{self.attempt}", 0
        store.create_dir(aside, recursive=True)
        path = f"{aside}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.jsonl"
        with store.open_output_stream(path) as out:
            for row in iterator:
                try:
                    properties = json.loads(row.props) if row.props else {}
                except ValueError:
                    properties = row.props
                told = record(row.event, properties if isinstance(properties, dict) else {"value": properties})
                out.write((json.dumps(told, ensure_ascii=False, sort_keys=True) + "\n").encode())
                rows += 1
        return Written(path, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._store()
        done = f"{root}/batches/{self.batch}.json"
        if store.get_file_info(done).type == fs.FileType.NotFound:
            # a commit that ended half-way is done again from its start
            folder = f"{root}/records/{self.batch}"
            if store.get_file_info(folder).type != fs.FileType.NotFound:
                store.delete_dir(folder)
            store.create_dir(folder, recursive=True)
            store.create_dir(f"{root}/batches", recursive=True)
            files = [m for m in messages if m is not None and m.rows]
            for m in files:
                store.move(m.path, f"{folder}/{m.path.rsplit('/', 1)[1]}")
            with store.open_output_stream(f"{done}.{self.attempt}") as out:
                out.write(json.dumps({"files": len(files), "rows": sum(m.rows for m in files)}).encode())
            store.move(f"{done}.{self.attempt}", done)
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*self._store())

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/aside/{self.attempt}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/aside/{self.attempt}")


def export_events(events: DataFrame, path: str, batch: str) -> None:
    """Write ``event`` and ``props`` of all rows under ``path``; nothing if the batch is there already."""
    events.sparkSession.dataSource.register(EventExport)
    events.select("event", "props").write.format("event_export").option("path", path).option("batch", batch).mode("append").save()


def exported(spark: SparkSession, path: str) -> DataFrame:
    """``batch``, ``event``, ``attributes`` of all records; files aside and of unfinished batches are not read."""
    raw = spark.read.option("recursiveFileLookup", "true").text(f"{path}/records")
    done = spark.read.option("recursiveFileLookup", "true").text(f"{path}/batches").select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("batch")).distinct()
    r = raw.select(F.regexp_extract("_metadata.file_path", r"records/([^/]+)/", 1).alias("batch"), F.from_json("value", "body string, attributes map<string, string>").alias("r"))
    return r.join(done, "batch", "left_semi").select("batch", F.col("r.body").alias("event"), F.col("r.attributes").alias("attributes"))


@query("exported_events", "SELECT event_type AS event, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def exported_events(spark, sf_dir):
    """All events exported in two batches, one of which is sent a second time, and read back."""
    folder = shared_folder(spark, "export")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), "props")
    for batch in (0, 1, 0):
        export_events(e.where(F.col("event_id") % 2 == batch), folder, f"half-{batch}")
    found = exported(spark, folder)
    return found.groupBy("event").agg(F.count("*").alias("n"), F.sum(F.try_element_at("attributes", F.lit("k")).cast("long")).alias("k"))
