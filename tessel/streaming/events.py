"""Structured streaming (an extension; the reference has no streams): event files to windows, deduplicated notifications and upserted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_notifications(events: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type"), delay: str = "1 day") -> DataFrame:
    """Events whose keys have not come within the delay; older state is dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def upsert_into(events: DataFrame, target: str, checkpoint: str, key: str = "user_id") -> StreamingQuery:
    """Appends each batch's last row for each key under its batch number; a batch that runs again writes over itself. Readers take the
    highest batch of a key (see ``latest``)."""

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct("ts", "event_id")).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str, key: str = "user_id") -> DataFrame:
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch"]), F.struct("ts", "batch", "event_id")).alias("r")).select("r.*")
