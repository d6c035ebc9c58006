"""The event feed as a stream of files: deduplicated in micro-batches, resumed by its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import scratch_path


def run_available(spark: SparkSession, source: DataFrame, keys: list[str], out: str, checkpoint: str, time: str | None = None, late: str = "31 days") -> None:
    """Process what is there, then stop; a second run with the same checkpoint takes up only new files.

    time, one of the keys, bounds the state: what is older than the newest time by more than late is
    not remembered, and rows as old as that are dropped when they come.
    """
    rows = source.withWatermark(time, late) if time else source
    stream = rows.dropDuplicates(keys).writeStream.format("parquet").option("checkpointLocation", checkpoint)
    stream.outputMode("append").trigger(availableNow=True).start(out).awaitTermination()


def deduped_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user_id, event_type, day) of the feed, by a stateful stream that is run twice: the second run adds nothing."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    feed = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    feed = feed.select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"))
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    for _ in range(2):
        run_available(spark, feed, ["user_id", "event_type", "day"], out, checkpoint, time="day")
    return spark.read.schema(feed.schema).parquet(out).withColumn("day", F.to_date("day").cast("string"))
