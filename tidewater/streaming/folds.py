"""Streaming folds: day buckets, keep-last messages, sessions and retention. Each equals its batch form on the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..shared import shared_folder as _folder


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events as they land in new files; ``ts`` as a timestamp, which watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def land(spark: SparkSession, sf_dir: str, files: int = 3) -> str:
    """The events table as several files in time order, as a feed would leave them."""
    folder = _folder(spark, "landing")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(folder)
    return folder


def run_to_end(stream: DataFrame, mode: str, state: str | None = None, out: str | None = None) -> DataFrame:
    """Run a stream over what is there and return its sink's table. Update mode keeps the last version of each key's row.

    With ``state`` and ``out`` of an earlier run the stream goes on where that one ended.
    """
    spark = stream.sparkSession
    out = out or _folder(spark, "sink")

    def put(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again after a failure replaces itself
        batch.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state or _folder(spark, "state")).trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema.add("epoch", "long")).option("recursiveFileLookup", "true").parquet(out)


def last_version(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


@query("stream_day_buckets", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_day_buckets(spark, sf_dir):
    """Tumbling day windows in update mode: an incremental sum per window and type, equal to a full recompute."""
    e = event_stream(spark, land(spark, sf_dir)).withWatermark("ts", "30 days")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    rows = last_version(run_to_end(g.select(F.col("w.start").alias("start"), "event_type", "n", "v"), "update"), ["start", "event_type"])
    return rows.select(F.to_date("start").alias("day"), "event_type", "n", F.round("v", 6).alias("total"))


@query("stream_keep_last", "SELECT user_id, event_type, max(event_id) AS last_event, round(max_by(value, event_id), 6) AS last_value, min(ts) AS first_seen FROM events GROUP BY 1, 2")
def stream_keep_last(spark, sf_dir):
    """The last row of each message replaces earlier ones; its first time stays."""
    e = event_stream(spark, land(spark, sf_dir))
    g = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("last_event"), F.max_by("value", "event_id").alias("v"), F.min("ts").alias("first_seen"))
    rows = last_version(run_to_end(g, "update"), ["user_id", "event_type"])
    return rows.select("user_id", "event_type", "last_event", F.round("v", 6).alias("last_value"), F.col("first_seen").cast("timestamp_ntz").alias("first_seen"))


@query(
    "stream_sliding_week",
    "SELECT CAST(d AS DATE) AS start_day, count(*) AS n, round(sum(value), 6) AS total FROM events, generate_series(CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(CAST(ts AS DATE) AS TIMESTAMP), INTERVAL 1 DAY) s(d) GROUP BY 1",
)
def stream_sliding_week(spark, sf_dir):
    e = event_stream(spark, land(spark, sf_dir)).withWatermark("ts", "30 days")
    g = e.groupBy(F.window("ts", "7 days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    rows = last_version(run_to_end(g.select(F.col("w.start").alias("start"), "n", "v"), "update"), ["start"])
    return rows.select(F.to_date("start").alias("start_day"), "n", F.round("v", 6).alias("total"))


@query("stream_dedup_within_epoch", "SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(DISTINCT props) AS n FROM events GROUP BY 1, 2, 3")
def stream_dedup_within_epoch(spark, sf_dir):
    """Content seen in the same session and day is dropped as it streams."""
    e = event_stream(spark, land(spark, sf_dir)).withColumn("day", F.to_date("ts"))
    rows = run_to_end(e.dropDuplicates(["user_id", "event_type", "day", "props"]).select("user_id", "event_type", "day", "props"), "append")
    return rows.groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"))


@query("stream_gap_sessions", "WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, k")
def stream_gap_sessions(spark, sf_dir):
    """Sessions that end after two hours of silence; the watermark never closes one while files are still landing."""
    e = event_stream(spark, land(spark, sf_dir), files_per_batch=100).withWatermark("ts", "365 days")
    g = e.groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n"))
    rows = run_to_end(g.select("user_id", "started", "n"), "complete")
    return last_version(rows, ["user_id", "started"]).select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), "n")


def refold_changed(spark: SparkSession, files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose size or time differs from what was folded before: only their sessions are folded again."""
    same = known.select("path", "length", "modificationTime")
    return files.join(same, ["path", "length", "modificationTime"], "left_anti")


def prune_old(buckets: DataFrame, day: str, keep_days: int) -> DataFrame:
    """Buckets of the last ``keep_days`` days before the latest."""
    last = F.broadcast(buckets.agg(F.max(day).alias("_last")))
    return buckets.join(last).where(F.col(day) >= F.date_sub("_last", keep_days)).drop("_last")
