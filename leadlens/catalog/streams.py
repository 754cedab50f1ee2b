"""The event streams over the events table, run to its end."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.registry import Tables, query
from leadlens.streaming import jobs, late


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_tail_counts(t: Tables) -> DataFrame:
    return jobs.drained(jobs.event_stream(t.spark, t.folder).groupBy("event_type").count().withColumnRenamed("count", "n"), "complete")


@query("SELECT DISTINCT event_id FROM events")
def stream_dedupe(t: Tables) -> DataFrame:
    rows = jobs.event_stream(t.spark, t.folder)
    return jobs.drained(jobs.deduped(rows.union(rows), ["event_id"], "60 days").select("event_id"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS units FROM events GROUP BY 1, 2")
def stream_window_day(t: Tables) -> DataFrame:
    return jobs.drained(jobs.per_window(jobs.event_stream(t.spark, t.folder), "1 day"), "update").groupBy(F.col("start").cast("timestamp_ntz").alias("start"), "event_type").agg(F.max("n").alias("n"), F.max_by("units", "n").alias("units"))


@query("SELECT user_id, count(*) AS n, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'search' THEN 2 WHEN 'cart' THEN 3 WHEN 'purchase' THEN 4 ELSE -1 END) AS furthest FROM events GROUP BY 1")
def stream_user_state(t: Tables) -> DataFrame:
    return jobs.drained(jobs.counters(jobs.event_stream(t.spark, t.folder)), "update").groupBy("user_id").agg(F.max("n").alias("n"), F.max("furthest").alias("furthest"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 15 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(t: Tables) -> DataFrame:
    """All sessions, those that are still open at the end, too: complete results don't wait for the watermark."""
    rows = jobs.drained(jobs.sessions(jobs.event_stream(t.spark, t.folder)), "complete")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


#: Deliveries of the events in order of time; rows of a large value come that many deliveries later.
SLICES, BEHIND, LARGE = 6, 3, 90.0
#: How long late rows are waited for. Spark holds a batch's rows against the watermark that the batch before it began with.
LATE_DAYS = 5
#: The same in SQL: ``first`` is the delivery of a row's time, ``slice`` the one that it comes with, ``ms`` its milliseconds.
_SLICED_SQL = f"""r AS (SELECT event_id, user_id, event_type, value, ts, least({SLICES - 1}, CAST(floor({SLICES} * (epoch_us(ts) - lo) / (hi - lo + 1)) AS INT)) AS first FROM events, (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events) WHERE ts IS NOT NULL
), s AS (SELECT *, CASE WHEN value >= {LARGE} THEN least({SLICES - 1}, first + {BEHIND}) ELSE first END AS slice, value >= {LARGE} AS large, epoch_us(ts) // 1000 AS ms FROM r
)"""


def _first(events: DataFrame) -> DataFrame:
    """Events with ``first``, the delivery that their time belongs to: equal spans of time."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    nth = F.least(F.lit(SLICES - 1), F.floor(F.lit(SLICES) * (us - (lo or 0)) / ((hi or 0) - (lo or 0) + 1))).cast("int")
    return events.where("ts is not null").withColumn("first", nth)


def _counts(came: DataFrame, kept: DataFrame) -> DataFrame:
    k = kept.groupBy("slice").agg(F.count("*").alias("kept"))
    out = came.groupBy("slice").agg(F.count("*").alias("n")).join(k, "slice", "left")
    return out.select(F.col("slice").cast("long").alias("slice"), "n", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


@query(f"""WITH {_SLICED_SQL}, w AS (SELECT slice, max(max(ms)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - {LATE_DAYS * 86_400_000} AS mark FROM s GROUP BY slice)
SELECT CAST(s.slice AS BIGINT) AS slice, count(*) AS n, count(*) FILTER (mark IS NULL OR epoch_us(ts) > mark * 1000) AS kept, count(*) FILTER (epoch_us(ts) <= mark * 1000) AS dropped FROM s JOIN w ON w.slice = s.slice GROUP BY 1""")
def stream_late_rows(t: Tables) -> DataFrame:
    """Of each delivery, how many events came in time and how many behind the watermark of the deliveries before it."""
    events = _first(t.events)
    later = F.when(F.col("value") >= LARGE, F.least(F.lit(SLICES - 1), F.col("first") + BEHIND)).otherwise(F.col("first"))
    folder = late.sliced(events, later, SLICES)
    stream = late.delivered(t.spark, folder, jobs.EVENTS)
    kept = jobs.drained(late.kept_in_time(stream, f"{LATE_DAYS} days", ["event_id"]))
    return _counts(t.spark.read.parquet(folder), kept)


@query(f"""WITH {_SLICED_SQL}, n AS (SELECT unnest(range({SLICES})) AS slice
), w AS (
  SELECT n.slice, least(coalesce(max(CASE WHEN NOT large THEN ms END), 0), coalesce(max(CASE WHEN large THEN ms END), 0)) - {LATE_DAYS * 86_400_000} AS mark, count(s.slice) AS came
  FROM n LEFT JOIN s ON s.slice < n.slice - 1 GROUP BY n.slice)
SELECT CAST(s.slice AS BIGINT) AS slice, count(*) AS n, count(*) FILTER (came = 0 OR epoch_us(ts) > mark * 1000) AS kept, count(*) FILTER (came > 0 AND epoch_us(ts) <= mark * 1000) AS dropped FROM s JOIN w ON w.slice = s.slice GROUP BY 1""")
def stream_late_source(t: Tables) -> DataFrame:
    """The same deliveries as two sources, the large values as one that lags behind: the watermark is that of the slower one."""
    events = _first(t.events)
    large = F.col("value") >= LARGE
    fast = late.sliced(events.where(~large), F.col("first"), SLICES)
    slow = late.sliced(events.where(large), F.least(F.lit(SLICES - 1), F.col("first") + BEHIND), SLICES)
    kept = jobs.drained(late.merged_in_time(late.delivered(t.spark, fast, jobs.EVENTS), late.delivered(t.spark, slow, jobs.EVENTS), f"{LATE_DAYS} days", ["event_id"]))
    return _counts(t.spark.read.parquet(fast).unionByName(t.spark.read.parquet(slow)), kept)


#: Hours after which a follow-up goes out, follow-ups at most, days after which an idle thread ends.
DELAY_HOURS, LIMIT, IDLE_DAYS = 36, 2, 4
_MESSAGE_SQL = "CASE event_type WHEN 'view' THEN 'out' WHEN 'signup' THEN 'out' WHEN 'click' THEN 'in' WHEN 'purchase' THEN 'booked' ELSE 'other' END"


@query(f"""WITH RECURSIVE x AS (SELECT make_timestamp(1000 * (epoch_us(max(ts)) // 1000)) - INTERVAL {LATE_DAYS} DAY AS w FROM events
), e AS (SELECT user_id, ts, {_MESSAGE_SQL} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events, x WHERE ts <= w
), z AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS state, 0 AS n, CAST(NULL AS TIMESTAMP) AS due, CAST(NULL AS TIMESTAMP) AS happened, CAST(NULL AS VARCHAR) AS step, 0 AS k FROM e
  UNION ALL
  SELECT user_id, CASE WHEN fire THEN i ELSE i + 1 END,
    CASE WHEN fire THEN CASE WHEN state <> 'active' THEN NULL WHEN n < {LIMIT} THEN state ELSE 'review' END WHEN new = 'sent' THEN 'active' WHEN new = 'replied' THEN 'engaged' WHEN new = 'booked' THEN 'booked' ELSE state END,
    CASE WHEN fire THEN CASE WHEN state <> 'active' THEN 0 WHEN n < {LIMIT} THEN n + 1 ELSE n END WHEN new = 'sent' THEN 0 ELSE n END,
    CASE WHEN fire THEN CASE WHEN state <> 'active' THEN NULL WHEN n < {LIMIT} THEN due + INTERVAL {DELAY_HOURS} HOUR ELSE due + INTERVAL {IDLE_DAYS} DAY END WHEN new = 'sent' THEN next + INTERVAL {DELAY_HOURS} HOUR WHEN new IS NOT NULL THEN next + INTERVAL {IDLE_DAYS} DAY ELSE due END,
    CASE WHEN fire THEN due WHEN new IS NOT NULL THEN next END,
    CASE WHEN fire THEN CASE WHEN state <> 'active' THEN 'ended' WHEN n < {LIMIT} THEN 'follow_up' ELSE 'review' END ELSE new END, k + 1
  FROM (SELECT z.user_id, z.i, z.state, z.n, z.due, z.k, e.ts AS next, due IS NOT NULL AND due <= w AND (e.ts IS NULL OR due <= e.ts) AS fire,
    CASE WHEN kind = 'out' AND (state IS NULL OR state IN ('engaged', 'review')) THEN 'sent' WHEN kind = 'in' AND state = 'active' THEN 'replied' WHEN kind = 'booked' AND state <> 'booked' THEN 'booked' END AS new
    FROM z CROSS JOIN x LEFT JOIN e ON e.user_id = z.user_id AND e.i = z.i + 1) WHERE fire OR next IS NOT NULL)
SELECT user_id, happened, step FROM z WHERE step IS NOT NULL""")
def stream_thread_steps(t: Tables) -> DataFrame:
    """What happens in each user's thread, with timers in event time, up to the watermark that the events leave."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "out").when(F.col("event_type") == "click", "in").when(F.col("event_type") == "purchase", "booked").otherwise("other")
    events = _first(t.events)
    folder = late.sliced(events, F.col("first"), SLICES)
    stream = late.delivered(t.spark, folder, jobs.EVENTS).select(F.col("user_id").alias("thread"), F.col("event_id").alias("row_id"), "ts", kind.alias("kind"))
    with late.rocks(t.spark):
        steps = jobs.drained(late.thread_steps(stream, f"{LATE_DAYS} days", timedelta(hours=DELAY_HOURS), LIMIT, timedelta(days=IDLE_DAYS)))
    return steps.select(F.col("thread").alias("user_id"), F.col("at").cast("timestamp_ntz").alias("happened"), "step")
