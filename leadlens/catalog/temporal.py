"""Rules over time: rolling and daily usage, schedules, stages, idle runs, pauses."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.operators.scalars import add_months, retry_delay
from leadlens.plans.carriers import AS_OF
from leadlens.registry import Tables, query

NOW = "TIMESTAMP '2001-08-02'"
DAY_END = dt.datetime(2024, 1, 31)


@query("""SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS DOUBLE) AS used FROM events""")
def rolling_24h_usage(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("at").rangeBetween(-86_400_000_000, 0)
    return t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "user_id", F.sum(F.col("value").cast("decimal(18,4)")).over(w).cast("double").alias("used"))


@query("""SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS in_window FROM events""")
def sliding_60s(t: Tables) -> DataFrame:
    """Events of a type in the minute up to each. A minute's rows also stand in the next one, so that no window holds more than two."""
    rows = t.events.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("minute", F.floor(F.col("at") / 60_000_000))
    dealt = rows.select("event_id", "event_type", "at", "minute", F.explode(F.array("minute", F.col("minute") + 1)).alias("bucket"))
    w = Window.partitionBy("event_type", "bucket").orderBy("at").rangeBetween(-60_000_000, 0)
    return dealt.withColumn("in_window", F.count("*").over(w)).where("bucket = minute").select("event_id", "event_type", "in_window")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS calls, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) AS units FROM events GROUP BY 1, 2")
def daily_usage(t: Tables) -> DataFrame:
    return t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("calls"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("units"))


@query("SELECT user_id, CAST(coalesce(sum(CAST(value AS DECIMAL(18, 4))) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS tokens, CAST(greatest(0, 300 - coalesce(sum(CAST(value AS DECIMAL(18, 4))) FILTER (WHERE event_type = 'purchase'), 0)) AS DOUBLE) AS left FROM events GROUP BY 1".replace("AS left", 'AS "left"'))
def sum_tokens(t: Tables) -> DataFrame:
    tokens = F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,4)"))), F.lit(0).cast("decimal(28,4)"))
    return t.events.groupBy("user_id").agg(tokens.cast("double").alias("tokens"), F.greatest(F.lit(0).cast("decimal(28,4)"), 300 - tokens).cast("double").alias("left"))


@query(f"SELECT c_custkey, max(o_orderdate) AS last_run, max(o_orderdate) + INTERVAL (CASE c_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 24 END) HOUR AS next_run FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING max(o_orderdate) + INTERVAL (CASE c_custkey % 3 WHEN 0 THEN 6 WHEN 1 THEN 12 ELSE 24 END) HOUR <= TIMESTAMP '2001-07-01'")
def due_searches(t: Tables) -> DataFrame:
    last = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_run"))
    hours = F.when(F.col("c_custkey") % 3 == 0, 6).when(F.col("c_custkey") % 3 == 1, 12).otherwise(24)
    due = last.withColumn("next_run", F.col("last_run") + F.make_dt_interval(F.lit(0), hours))
    return due.where(F.col("next_run") <= F.lit(dt.datetime(2001, 7, 1)).cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'search' THEN 2 WHEN 'cart' THEN 3 WHEN 'purchase' THEN 4 ELSE -1 END) AS furthest FROM events GROUP BY 1) SELECT user_id, CASE furthest WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'search' WHEN 3 THEN 'cart' WHEN 4 THEN 'purchase' END AS stage FROM s""")
def stage_forward(t: Tables) -> DataFrame:
    """A stage only moves forward: the furthest of all is where it stands."""
    order = F.array(*map(F.lit, ["view", "click", "search", "cart", "purchase"]))
    furthest = F.max(F.array_position(order, F.col("event_type"))).cast("int")
    return t.events.groupBy("user_id").agg(furthest.alias("k")).select("user_id", F.try_element_at(order, F.when(F.col("k") > 0, F.col("k"))).alias("stage"))


@query("SELECT user_id, max(ts) AS last_seen, CASE WHEN max(ts) < TIMESTAMP '2024-01-29' THEN 'failed' ELSE 'running' END AS state FROM events GROUP BY 1")
def stale_runs(t: Tables) -> DataFrame:
    idle = F.max("ts") < F.lit(dt.datetime(2024, 1, 29)).cast("timestamp_ntz")
    return t.events.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.when(idle, "failed").otherwise("running").alias("state"))


@query("SELECT user_id, event_id AS paused_at FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS saved FROM events WHERE event_type = 'purchase') WHERE saved = 5")
def autopause(t: Tables) -> DataFrame:
    """The event that brings the number saved to the limit."""
    saved = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.where("event_type = 'purchase'").withColumn("saved", saved).where("saved = 5").select("user_id", F.col("event_id").alias("paused_at"))


@query("SELECT event_id, CAST(least(900, 60 * pow(2, event_id % 6)) AS INT) AS delay, ts + INTERVAL (CAST(least(900, 60 * pow(2, event_id % 6)) AS INT)) SECOND AS due FROM events WHERE event_id % 6 < 3")
def campaign_queue(t: Tables) -> DataFrame:
    """Attempts one to three wait longer each time; later ones aren't made."""
    attempt = F.col("event_id") % 6 + 1
    rows = t.events.where(attempt <= 3).withColumn("delay", retry_delay(attempt))
    return rows.select("event_id", "delay", (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("delay").cast("decimal(18,6)"))).alias("due"))


@query(f"SELECT o_orderkey, datediff('day', o_orderdate, {NOW}) AS days, datediff('day', o_orderdate, {NOW}) / CAST(30.44 AS DOUBLE) AS months, strftime(CAST(o_orderdate AS DATE) + CAST(floor(4.5 * 30.44) AS INT), '%Y-%m-%d') AS window_end FROM orders")
def days_months(t: Tables) -> DataFrame:
    days = F.datediff(F.lit(AS_OF), "o_orderdate")
    return t.orders.select("o_orderkey", days.cast("long").alias("days"), (days / F.lit(30.44)).alias("months"), F.date_format(add_months(F.to_date("o_orderdate"), 4.5), "yyyy-MM-dd").alias("window_end"))


@query(f"""SELECT o_custkey, CASE WHEN max(o_orderdate) IS NULL THEN 'capability_only' WHEN datediff('day', max(o_orderdate), {NOW}) <= 180 THEN 'recent' WHEN bool_or(o_orderstatus = 'O') THEN 'ongoing' ELSE 'historic' END AS activity FROM orders GROUP BY 1""")
def activity_status(t: Tables) -> DataFrame:
    last = F.max("o_orderdate")
    status = F.when(last.isNull(), "capability_only").when(F.datediff(F.lit(AS_OF), last) <= 180, "recent").when(F.bool_or(F.col("o_orderstatus") == "O"), "ongoing").otherwise("historic")
    return t.orders.groupBy("o_custkey").agg(status.alias("activity"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND datediff('day', o_orderdate, {NOW}) <= 180 THEN 90 WHEN o_orderstatus = 'O' THEN 85 WHEN o_orderstatus = 'F' AND datediff('day', o_orderdate, {NOW}) <= 180 THEN 80 WHEN datediff('day', o_orderdate, {NOW}) <= 540 THEN 75 ELSE 65 END AS priority FROM orders""")
def need_priority(t: Tables) -> DataFrame:
    age, status = F.datediff(F.lit(AS_OF), "o_orderdate"), F.col("o_orderstatus")
    p = F.when((status == "O") & (age <= 180), 90).when(status == "O", 85).when((status == "F") & (age <= 180), 80).when(age <= 540, 75).otherwise(65)
    return t.orders.select("o_orderkey", p.alias("priority"))


@query("""WITH w AS (SELECT o_orderkey, o_orderdate, unnest([{'k': 'engineering', 'a': 0, 'b': 3}, {'k': 'buying', 'a': 2, 'b': 9}, {'k': 'delivery', 'a': 6, 'b': 18}]) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')
SELECT o_orderkey, r.k AS step, CASE WHEN DATE '2001-08-02' > CAST(o_orderdate AS DATE) + CAST(floor(r.b * 30.44) AS INT) THEN 'done' WHEN DATE '2001-08-02' >= CAST(o_orderdate AS DATE) + CAST(floor(r.a * 30.44) AS INT) THEN 'now' ELSE 'next' END AS state FROM w""")
def window_steps(t: Tables) -> DataFrame:
    """Steps of a buying window from months after the award, and where each stands."""
    rules = [("engineering", 0, 3), ("buying", 2, 9), ("delivery", 6, 18)]
    day, today = F.to_date("o_orderdate"), F.lit(AS_OF.date())
    cells = [F.struct(F.lit(k).alias("step"), F.when(today > add_months(day, b), "done").when(today >= add_months(day, a), "now").otherwise("next").alias("state")) for k, a, b in rules]
    return t.orders.where("o_orderdate >= timestamp_ntz'2000-01-01'").select("o_orderkey", F.explode(F.array(*cells)).alias("x")).select("o_orderkey", "x.*")


@query("""WITH r AS (SELECT user_id, event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS fit, row_number() OVER (PARTITION BY user_id ORDER BY CAST(json_extract(props, '$.k') AS BIGINT) DESC, ts, event_id) AS r, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id) AS already FROM events)
SELECT user_id, event_id, fit FROM r WHERE r <= greatest(0, 15 - already)""")
def deferred_admission(t: Tables) -> DataFrame:
    """The best of each run, as many as are left after those already taken."""
    fit = F.get_json_object("props", "$.k").cast("long")
    w = Window.partitionBy("user_id")
    rows = t.events.select("user_id", "event_id", fit.alias("fit"), F.row_number().over(w.orderBy(fit.desc(), "ts", "event_id")).alias("r"), F.count_if(F.col("event_type") == "purchase").over(w).alias("already"))
    return rows.where(F.col("r") <= F.greatest(F.lit(0), 15 - F.col("already"))).select("user_id", "event_id", "fit")


@query("SELECT event_id, CAST((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 60 AS BIGINT) AS minutes FROM events".replace("CAST((epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 60 AS BIGINT)", "CAST(floor((floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)))) / 60 + 0.5) AS DOUBLE)"))
def run_minutes(t: Tables) -> DataFrame:
    sec = lambda c: F.unix_seconds(c.cast("timestamp"))
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_id", F.floor((sec(F.col("ts")) - sec(before)) / 60 + 0.5).cast("double").alias("minutes"))
