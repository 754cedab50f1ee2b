"""The newest row not after a time, for each row of another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, span: str = "month") -> DataFrame:
    """``left`` with ``value`` of the last row of ``right`` of the same key that isn't later; null if there is none.

    Both have ``key`` and ``at`` (a date); ``right`` has ``value`` too, and of rows of one key and day the largest value
    counts. Keys are split by ``span`` of time, so that one with many rows is no single task's: a span takes its first
    value from the spans before it, of which a row each is compared. Rows without key or time get null.
    """
    best = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.max(value).alias("_new"))
    part = F.date_trunc(span, at).alias("_part")
    rows = left.select(F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_row"), key, at, part, F.lit(1).alias("_side"), F.lit(None).cast(best.schema["_new"].dataType).alias("_new"))
    marks = best.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), key, at, part, F.lit(0).alias("_side"), "_new")
    within = F.last("_new", ignorenulls=True).over(Window.partitionBy(key, "_part").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0))
    both = rows.unionByName(marks).withColumn("_found", within).where("_side = 1")
    ends = best.groupBy(key, part).agg(F.max_by("_new", at).alias("_end"))
    parts = left.select(key, part).distinct().join(ends, [key, "_part"], "full")
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), before.alias("_before"))
    out = both.join(carried, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")), "left")
    return out.select("_row.*", F.coalesce("_found", "_before").alias(value))
