"""Small numeric and ordering rules as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days of a month wherever months are counted from days: fixed value.
MONTH_DAYS = 30.44


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - w) over an array, sorted first so that the result doesn't depend on the order of rows."""
    return 1 - F.aggregate(F.array_sort(weights), F.lit(1.0), lambda acc, w: acc * (1 - w))


def months_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(MONTH_DAYS)


def add_months(day: Column, months: float) -> Column:
    return F.date_add(day, int(months * MONTH_DAYS // 1))


def recency(days: Column, top: int = 4, half_life: int = 60) -> Column:
    return F.round(top * F.pow(F.lit(0.5), F.greatest(days, F.lit(0)) / half_life)).cast("int")


def bounded(x: Column, top: int) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(0)), F.lit(top))


def retry_delay(attempt: Column) -> Column:
    """Seconds before the next try: a minute, doubled each time, at most a quarter of an hour."""
    return F.least(F.lit(900), 60 * F.pow(F.lit(2), attempt - 1)).cast("int")


def compact_usd(x: Column) -> Column:
    """"$4.5m" and the like: one decimal from a million on, whole thousands below."""
    one = lambda v: F.regexp_replace(F.format_string("%.1f", F.round(v, 1)), r"\.0$", "")
    text = F.when(x >= 1e9, F.concat(F.lit("$"), one(x / 1e9), F.lit("bn"))).when(x >= 1e6, F.concat(F.lit("$"), one(x / 1e6), F.lit("m")))
    return text.when(x >= 1e3, F.concat(F.lit("$"), F.round(x / 1e3).cast("long").cast("string"), F.lit("k"))).when(x.isNotNull(), F.concat(F.lit("$"), F.round(x).cast("long").cast("string")))
