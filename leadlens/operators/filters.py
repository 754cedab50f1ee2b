"""Filters as lists of predicates: a dimension that is left out is a predicate that isn't added. Values are literals, never text of a query."""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGES = {"24h": dt.timedelta(hours=24), "7d": dt.timedelta(days=7), "30d": dt.timedelta(days=30)}


def contains_text(col: str, needle: str) -> Column:
    """Case-insensitive substring; no character is special."""
    return F.contains(F.lower(F.col(col)), F.lit(needle.lower()))


def like_literal(text: str) -> str:
    """A text as a LIKE pattern that matches it alone, with backslash as the escape."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def within(col: str, age: str, as_of: dt.datetime) -> Column:
    """Not older than one of AGES before ``as_of``."""
    return F.col(col) >= F.lit(as_of - AGES[age])


def at_least(col: str, minimum: float | None, top: int = 100) -> Column | None:
    """``col`` reaches the floor of ``minimum``, at most ``top``; no predicate if the minimum isn't a positive number."""
    if minimum is None or not math.isfinite(minimum) or minimum <= 0:
        return None
    return F.col(col) >= F.lit(min(top, math.floor(minimum)))


def overlaps(col: str, values: list[str]) -> Column:
    return F.arrays_overlap(F.col(col), F.array(*map(F.lit, values)))


@dataclass(frozen=True)
class LeadFilter:
    """The optional conditions on leads; ``statuses`` falls back to the open ones unless a status is named or all are wanted."""

    text: str | None = None
    text_columns: tuple[str, ...] = ("buyer", "place")
    equal: dict[str, object] = field(default_factory=dict)
    one_of: dict[str, tuple] = field(default_factory=dict)
    holds: dict[str, str] = field(default_factory=dict)
    added: str | None = None
    min_score: float | None = None
    as_of: dt.datetime | None = None

    def predicates(self, omit: str | None = None) -> list[Column]:
        out = []
        if self.text and omit != "text":
            out.append(reduce(or_, (F.coalesce(contains_text(c, self.text), F.lit(False)) for c in self.text_columns)))
        out += [F.col(c) == F.lit(v) for c, v in self.equal.items() if c != omit]
        out += [F.col(c).isin(*v) for c, v in self.one_of.items() if c != omit]
        out += [F.array_contains(c, v) for c, v in self.holds.items() if c != omit]
        if self.added and omit != "added":
            out.append(within("created", self.added, self.as_of))
        score = at_least("score", self.min_score)
        if score is not None and omit != "score":
            out.append(score)
        return out

    def apply(self, df: DataFrame, omit: str | None = None) -> DataFrame:
        for p in self.predicates(omit):
            df = df.where(p)
        return df


def facets(df: DataFrame, wanted: LeadFilter, dims: list[str]) -> DataFrame:
    """(dim, value, n) of each dimension under all conditions but its own.

    One pass: a row carries a flag for each conditioned dimension, and counts for a dimension if all other flags hold.
    """
    base = LeadFilter(text=wanted.text, text_columns=wanted.text_columns, holds=wanted.holds, added=wanted.added, min_score=wanted.min_score, as_of=wanted.as_of)
    flags = {c: F.coalesce(F.col(c) == F.lit(v), F.lit(False)) for c, v in wanted.equal.items()}
    flags |= {c: F.coalesce(F.col(c).isin(*v), F.lit(False)) for c, v in wanted.one_of.items()}
    cells = []
    for d in dims:
        keep = F.lit(True)
        for c, flag in flags.items():
            if c != d:
                keep = keep & flag
        cells.append(F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value"), keep.alias("keep")))
    rows = base.apply(df).select(F.explode(F.array(*cells)).alias("x")).where("x.keep and x.value is not null")
    return rows.groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


def page(df: DataFrame, limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """A page of a sorted frame: 1 to ``most`` rows, offset not negative."""
    return df.offset(max(0, offset)).limit(max(1, min(most, limit)))


def keyset(df: DataFrame, key: str, after: object | None, limit: int = 500) -> DataFrame:
    """The next rows after a cursor, in the order of the key: no offset that grows."""
    return (df if after is None else df.where(F.col(key) > F.lit(after))).orderBy(key).limit(limit)
