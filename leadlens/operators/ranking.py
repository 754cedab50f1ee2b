"""Ranking within groups: latest row, top k, fair interleaving, run lengths, greedy selection under quotas."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in a total order; unlike dropDuplicates it is always the same one."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def top_per(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """At most ``k`` rows of each key with their rank; Spark prunes each task to k rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col(rank) <= k)


def interleave(df: DataFrame, group: str, *order: Column) -> DataFrame:
    """Adds ``turn``: all groups' first rows come before any second one."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))


def run_lengths(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """Runs of equal values in the order of each key: keys, run (from 1), value, n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")
    runs = df.withColumn("_change", change).withColumn("run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return runs.groupBy(*keys, "run", value).agg(F.count("*").alias("n"))


def per_group(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """For rules in which a row that is passed over uses nothing up, so that a running sum can't stand for them.

    A group must fit a task: groups are one run's or one company's rows.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def greedy_quota(rows: pd.DataFrame, limits: list[dict[str, int]], k: int) -> pd.DataFrame:
    """Choose up to ``k`` rows in order, in passes with wider and wider limits for each value of a column."""
    taken: list[int] = []
    used: dict[tuple[str, object], int] = {}
    for limit in limits:
        for i, row in enumerate(rows.to_dict("records")):
            if len(taken) == k:
                break
            if i not in taken and all(used.get((c, row[c]), 0) < n for c, n in limit.items()):
                taken.append(i)
                for c in limit:
                    used[c, row[c]] = used.get((c, row[c]), 0) + 1
    return rows.iloc[taken].assign(place=range(1, len(taken) + 1))


def reserve(rows: pd.DataFrame, units: str, budget: float) -> pd.DataFrame:
    """In order of arrival: a request that would go over the budget is refused and uses nothing."""
    left, states = budget, []
    for u in rows[units]:
        ok = u <= left
        left -= u if ok else 0
        states.append("reserved" if ok else "exhausted")
    return rows.assign(state=states)
