"""Exports and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions.textual import csv_cell as cell
from leadlens.operators.ranking import first_per

MOST_ROWS = 10_000


def csv_line(*cells: Column) -> Column:
    """Cells as a line: none that a spreadsheet would run, quotes doubled, those with quotes, commas or line breaks quoted; null is empty."""
    text = [cell(c.cast("string")) for c in cells]
    quoted = [F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit(""))) for c in text]
    return F.concat_ws(",", *quoted)


def csv(df: DataFrame, folder: str, most: int = MOST_ROWS) -> bool:
    """At most ``most`` rows as CSV with a header, quotes doubled, and no cell that a spreadsheet would run; whether rows were left out."""
    text: list[Column] = [cell(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    df.select(*text).limit(most).write.mode("overwrite").csv(folder, header=True, escape='"', quoteAll=False, lineSep="\n")
    return not df.offset(most).limit(1).isEmpty()


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key over both frames: of rows as new as each other, the change wins."""
    both = stored.withColumn("_change", F.lit(0)).unionByName(changes.withColumn("_change", F.lit(1)), allowMissingColumns=True)
    return first_per(both, keys, F.desc_nulls_last(order), F.desc("_change")).drop("_change")


def insert_absent(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key isn't stored, one for each key, the first in the order of all columns; null keys are equal."""
    on = [stored[k].eqNullSafe(new[k]) for k in keys]
    fresh = new.join(stored.select(*keys).distinct(), on, "left_anti")
    return first_per(fresh, keys, *(F.col(c) for c in new.columns))


__all__ = ["cell", "csv", "csv_line", "insert_absent", "upsert"]
