import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import event_export


def test_records():
    assert event_export.record("x", {"a": 1, "b": [1, "é"], "c": None}) == {"body": "x", "severity_text": "DEBUG", "attributes": {"event.name": "x", "a": 1, "b": '[1, "é"]', "c": None}}


def files(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_rerun_and_failure(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    rows = [("login", '{"a": 1, "b": {"c": 2}}'), ("click", None), ("odd", "[1]"), ("broken", "{x"), ("é", '{"u": "ü"}')]
    df = spark.createDataFrame(rows, "event string, props string").repartition(3)
    event_export.export_events(df, folder, "b1")
    before = files(tmp_path)
    event_export.export_events(df, folder, "b1")  # a rerun doubles nothing
    assert files(tmp_path) == before and not [f for f in before if "aside" in f]
    got = {r.event: r.attributes for r in event_export.exported(spark, folder).collect()}
    assert got == {"login": {"event.name": "login", "a": "1", "b": '{"c": 2}'}, "click": {"event.name": "click"}, "odd": {"event.name": "odd", "value": "[1]"}, "broken": {"event.name": "broken", "value": "{x"}, "é": {"event.name": "é", "u": "ü"}}
    bad = df.withColumn("event", F.when(F.col("event") == "odd", F.raise_error(F.lit("lost"))).otherwise(F.col("event")))
    with pytest.raises(Exception, match="lost"):
        event_export.export_events(bad, folder, "b2")
    assert files(tmp_path) == before  # a failed task leaves nothing
    event_export.export_events(df.limit(0), folder, "b3")
    assert event_export.exported(spark, folder).count() == 5 and json.loads((tmp_path / "out/batches/b3.json").read_text()) == {"files": 0, "rows": 0}


def test_half_done_commit_is_not_read(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    df = spark.createDataFrame([("a", None)], "event string, props string")
    event_export.export_events(df, folder, "b1")
    (tmp_path / "out/batches/b1.json").unlink()  # the driver died before it noted the batch
    event_export.export_events(df, folder, "b2")
    assert [r.batch for r in event_export.exported(spark, folder).collect()] == ["b2"]
    event_export.export_events(df, folder, "b1")
    assert sorted(r.batch for r in event_export.exported(spark, folder).collect()) == ["b1", "b2"]
