"""Structured Streaming variants: throughput by time window, latest record per source, count blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from millrace.catalog import query
from millrace.session import scratch, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream; new files in the folder are new micro-batches."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 16).parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def throughput(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and sum by time window and type, with a watermark that bounds the state."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def latest_per_source(events: DataFrame) -> DataFrame:
    """The newest record of each user in state; every micro-batch gives the users that changed."""

    def update(key, batches, state):
        best = state.get if state.exists else (None, None, None)
        for pdf in batches:
            newest = pdf.sort_values(["us", "event_id"]).iloc[-1]
            found = (int(newest["us"]), int(newest["event_id"]), float(newest["value"]))
            if best[0] is None or found[:2] > tuple(best[:2]):
                best = found
        state.update(tuple(best))
        yield pd.DataFrame({"user_id": [key[0]], "us": [best[0]], "event_id": [best[1]], "value": [best[2]]})

    rows = events.select("user_id", F.unix_micros("ts").alias("us"), "event_id", "value")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, us long, event_id long, value double", "us long, event_id long, value double", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, mode: str, name: str) -> str:
    """Run a stream over what is there and write each micro-batch's rows under one path; returns the path.

    A batch overwrites its own folder, so one that is tried again isn't counted twice.
    """
    spark = stream.sparkSession
    path = scratch(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    running = stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).foreachBatch(keep).start()
    running.awaitTermination()
    return path


@query("stream_stats", "SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_stream_stats(spark, sf_dir):
    path = drain(throughput(event_stream(spark, sf_dir)), "update", "stream-stats")
    said = spark.read.parquet(path)
    newest = said.groupBy("window", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("r"))
    return newest.select(F.col("window.start").cast("timestamp_ntz").alias("bucket"), "event_type", "r.n", "r.total")


@query(
    "stream_stateful",
    "SELECT user_id, epoch_us(ts) AS us, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
def q_stream_stateful(spark, sf_dir):
    path = drain(latest_per_source(event_stream(spark, sf_dir)), "update", "stream-latest")
    return spark.read.parquet(path).groupBy("user_id").agg(F.max_by(F.struct("us", "event_id", "value"), "batch").alias("r")).select("user_id", "r.*")
