"""Streams that arrive out of order: sources in slices, late rows and what a watermark does to them, threads with timers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from leadlens.streaming.jobs import shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def sliced(rows: DataFrame, slice_: Column, n: int) -> str:
    """Write ``rows`` as ``n`` deliveries, one after the other, into a new shared folder; ``slice_`` is from 0 to n - 1.

    A stream reads files in the order in which they came. Each delivery is one job over all partitions of the rows.
    """
    folder = f"{shared_folder(rows.sparkSession)}/slices-{uuid.uuid4().hex}"
    dealt = rows.withColumn("slice", slice_.cast("int"))
    for i in range(n):
        dealt.where(F.col("slice") == i).repartition(1).write.mode("append").parquet(folder)
    return folder


def delivered(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The deliveries of sliced() as a stream, one a batch."""
    rows = spark.readStream.schema(f"{schema}, slice int").option("maxFilesPerTrigger", 1).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def kept_in_time(stream: DataFrame, late: str, keys: list[str]) -> DataFrame:
    """The rows that aren't older than the watermark when they come, each key once."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def merged_in_time(first: DataFrame, second: DataFrame, late: str, keys: list[str]) -> DataFrame:
    """Two sources with a watermark each: Spark waits for the slower one, so that its rows aren't late by the other's clock."""
    both = first.withWatermark("ts", late).unionByName(second.withWatermark("ts", late))
    return both.dropDuplicatesWithinWatermark(keys)


class Threads(StatefulProcessor):
    """Message threads in event time: a follow-up after each delay without a reply, review at the limit, and an end.

    Rows wait in a list state until the watermark has passed them, so that they are taken by time in whatever order they
    came. The value state is (state, follow-ups, due); ``due`` is the time of the next follow-up, of the review, or of
    the end of a thread that is idle, at which its state is cleared. A timer stands at the next of both, the first row that
    waits or the due time: all that the watermark has passed is then taken at once. Times are microseconds.
    """

    def __init__(self, delay: timedelta, limit: int, idle: timedelta):
        self.delay, self.limit, self.idle = (int(x.total_seconds() * 1_000_000) if isinstance(x, timedelta) else x for x in (delay, limit, idle))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thread = handle.getValueState("thread", "state string, follow_ups int, due long")
        self.waiting = handle.getListState("waiting", "us long, row_id long, kind string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came = [(r.us, r.row_id, r.kind) for r in rows]
        self.waiting.appendList(came)
        self.handle.registerTimer(-(-min(came)[0] // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        before = self.thread.get()
        state, follow_ups, due = tuple(before) if before else (None, 0, None)
        out, done = [], 0
        while True:
            at = rows[done][0] if done < len(rows) else None
            if due is not None and due <= now and (at is None or due <= at):
                time, (state, follow_ups, due, step) = due, self.timed(state, follow_ups, due)
            elif at is not None and at <= now:
                time, (state, follow_ups, due, step) = at, self.message(state, follow_ups, due, at, rows[done][2])
                done += 1
            else:
                break
            if step:
                out.append((time, step))
        if done == len(rows):
            if rows:
                self.waiting.clear()
        elif done:
            self.waiting.put(rows[done:])
        if state is None:
            if before:
                self.thread.clear()
        elif not before or tuple(before) != (state, follow_ups, due):
            self.thread.update((state, follow_ups, due))
        if done < len(rows) or due is not None:
            self.handle.registerTimer(-(-min(([rows[done][0]] if done < len(rows) else []) + ([due] if due is not None else [])) // 1000))
        for time, step in out:
            yield Row(thread=key[0], us=time, step=step)

    def message(self, state: str | None, follow_ups: int, due: int | None, at: int, kind: str) -> tuple:
        """(state, follow-ups, due, step or None) after a message."""
        if kind == "out" and state in (None, "engaged", "review"):
            return "active", 0, at + self.delay, "sent"
        if kind == "in" and state == "active":
            return "engaged", follow_ups, at + self.idle, "replied"
        if kind == "booked" and state not in (None, "booked"):
            return "booked", follow_ups, at + self.idle, "booked"
        return state, follow_ups, due, None

    def timed(self, state: str, follow_ups: int, due: int) -> tuple:
        """The same after a due time."""
        if state != "active":
            return None, 0, None, "ended"
        if follow_ups < self.limit:
            return state, follow_ups + 1, due + self.delay, "follow_up"
        return "review", follow_ups, due + self.idle, "review"

    def close(self) -> None:
        pass


def thread_steps(messages: DataFrame, late: str, delay: timedelta, limit: int, idle: timedelta) -> DataFrame:
    """(thread, at, step) of message threads; ``messages`` streams thread, row_id, ts, kind (out, in, booked or other).

    Needs the RocksDB state store. Rows that are late by the watermark are dropped; what lies in the last ``late`` of
    the stream waits for rows to come. State of a thread ends ``idle`` after its last step.
    """
    rows = messages.withColumn("us", F.unix_micros("ts")).withWatermark("ts", late)
    out = rows.groupBy("thread").transformWithState(statefulProcessor=Threads(delay, limit, idle), outputStructType="thread long, us long, step string", outputMode="Append", timeMode="EventTime")
    return out.select("thread", F.timestamp_micros("us").alias("at"), "step")
