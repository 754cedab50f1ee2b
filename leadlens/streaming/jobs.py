"""Event streams: tail, dedupe, windows, idle runs and per-key state; each takes a streaming frame and gives one."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder's events file, or of such files in a folder, as a stream with a time that can have a watermark."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def deduped(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once, within the time that late rows are waited for; state older than that is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def per_window(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by tumbling (or sliding) window."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide) if slide else F.window("ts", size), by)
    out = rows.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("units"))
    return out.select(F.col("window.start").alias("start"), by, "n", F.col("units").cast("double").alias("units"))


def sessions(events: DataFrame, gap: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Spans of each user's events with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def counters(events: DataFrame) -> DataFrame:
    """A running count and furthest stage for each user, kept as state and sent on at every change."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, furthest = state.get if state.exists else (0, -1)
        order = {"view": 0, "click": 1, "search": 2, "cart": 3, "purchase": 4}
        for pdf in frames:
            n += len(pdf)
            furthest = max(furthest, int(pdf["event_type"].map(lambda x: order.get(x, -1)).max()))
        state.update((n, furthest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "furthest": [furthest]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, furthest int", "n long, furthest int", "update", GroupStateTimeout.NoTimeout)


def shared_folder(spark: SparkSession) -> str:
    """A folder that all executors see: spark.checkpoint.dir; only a session whose executors are threads of the driver may go without one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return base or tempfile.mkdtemp(prefix="leadlens-stream-")


def drained(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over what is there now and return what it gave out as a table of files; of complete results the last.

    State and rows lie in the shared folder of ``checkpoint``, or else in shared_folder().
    """
    spark = stream.sparkSession
    folder = f"{checkpoint or shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/rows/batch=-1")  # so that a stream without rows has a table
    run = stream.writeStream.foreachBatch(write).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def tail_into(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append what has come to a parquet folder, once each: a batch that is tried again replaces its own files."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
