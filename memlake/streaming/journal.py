"""Streaming forms of the journal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.plans.shared import SharedStage
from memlake.streaming.stateful import DAY, PendingTurns, run_stateful


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of events as a stream, with a time that watermarks accept."""
    shape = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(shape).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and read its Parquet sink (append) or its last result (complete)."""
    spark = stream.sparkSession
    stage = SharedStage(spark, "stream")
    out, checkpoint = stage.path("out"), stage.path("checkpoint")
    if mode == "append":
        run = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        run = (stream.writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint)
               .outputMode(mode).trigger(availableNow=True).start())
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dedup(events: DataFrame, key: list[str], delay: str = "48 hours") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def open_without_close(opens: DataFrame, closes: DataFrame, key: str, within: str = "14 days", delay: str = "48 hours") -> DataFrame:
    """``(key, opened_at, closed_at)`` of two streams with ``(key, ts)``: each opening with every close of its key in the time after it.

    A stream-stream left outer join under two watermarks.  An opening that no
    close followed within the time comes out with a null ``closed_at`` once the
    slower watermark has passed that time; until then it is neither complete nor
    incomplete.  A close that comes in after that is not seen.  A close that is
    doubled gives its rows twice; openings without one are not touched by that.
    """
    left = opens.select(F.col(key).alias("key"), F.col("ts").alias("opened_at")).withWatermark("opened_at", delay)
    right = closes.select(F.col(key).alias("other"), F.col("ts").alias("closed_at")).withWatermark("closed_at", delay)
    near = (F.col("key") == F.col("other")) & (F.col("closed_at") >= F.col("opened_at")) & (F.col("closed_at") <= F.col("opened_at") + F.expr(f"INTERVAL {within}"))
    return left.join(right, near, "leftOuter").select("key", "opened_at", "closed_at")


def pending_turns(events: DataFrame, key: str, opens: str, closes: str, ttl_days: int = 14) -> DataFrame:
    """``(key, opened, closed, status)``: turns that complete, and, visibly, those that expire after ``ttl_days``.

    A turn opens with its first ``opens`` event and ends with the next
    ``closes`` event.  Timers run on event time.
    """
    turns = events.withWatermark("ts", "48 hours").select(F.col(key).cast("long").alias("key"), "ts", (F.col("event_type") == opens).alias("opens"), (F.col("event_type") == closes).alias("closes"))
    return run_stateful(turns, "key", PendingTurns(ttl_days * DAY), "key long, opened long, closed long, status string")
