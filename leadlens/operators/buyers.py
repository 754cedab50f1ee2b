"""Searching buyer records: conditions by dimension, facets under all other conditions, orders of the result.

A record has company_id, name, country, region, role, stage, fit, how_sure, tier, link, reach, industry, value, created,
trigger_kind, trigger_date, window_from, items and signals (arrays), found and slots (contacts), and rejected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_of(column: str, values: Iterable) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _any_of(column: str, values: Iterable) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


@dataclass(frozen=True)
class BuyerSearch:
    """What is asked for; a field that is left out asks for nothing, but for ``stage``, whose default hides companies that
    aren't buyers and records that the user has rejected."""

    places: tuple[str, ...] = ()
    not_places: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    not_roles: tuple[str, ...] = ()
    items: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    signal_days: int | None = None
    with_contacts: bool = False
    least_slots: int | None = None
    industries: tuple[str, ...] = ()
    least_value: float | None = None
    most_value: float | None = None
    like: dict | None = None
    companies: tuple[str, ...] = ()
    reach: tuple[str, ...] = ()
    stages: tuple[str, ...] = ()
    least_fit: float | None = None
    how_sure: tuple[str, ...] = ()
    text: str | None = None
    tiers: tuple[int, ...] = ()
    links: tuple[str, ...] = ()
    triggers: tuple[str, ...] = ()
    trigger_days: int | None = None
    undated: bool = False
    as_of: dt.date = field(default_factory=lambda: dt.date(2001, 8, 2))

    def likeness(self) -> Column:
        """How like a record is to ``like`` (role, items, country, industry): 3 for the role, 1 for each of the others."""
        ref = self.like or {}
        equal = lambda c, n: F.when(F.col(c) == F.lit(ref.get(c)), n).otherwise(0)
        shared = F.size(F.array_intersect("items", F.array(*map(F.lit, ref.get("items") or [""]))))
        return equal("role", 3) + shared + equal("country", 1) + equal("industry", 1)

    def conditions(self) -> dict[str, Column]:
        """The condition of each dimension that is asked for; 17 dimensions there are."""
        out: dict[str, list[Column]] = {}
        add = lambda dim, cond: out.setdefault(dim, []).append(cond)
        place = lambda v: F.coalesce((F.col("country") == v) | (F.col("region") == v), F.lit(False))
        age = F.datediff(F.lit(self.as_of), F.coalesce("trigger_date", "created"))
        if self.places:
            add("location", reduce(lambda a, b: a | b, map(place, self.places)))
        for v in self.not_places:
            add("location", ~place(v))
        if self.roles:
            add("roles", _one_of("role", self.roles))
        if self.not_roles:
            add("roles", ~_one_of("role", self.not_roles))
        if self.items:
            add("sell", _any_of("items", self.items))
        if self.signals:
            add("signals", _any_of("signals", self.signals))
        if self.signal_days:
            add("signals", F.coalesce(age <= self.signal_days, F.lit(False)))
        if self.with_contacts:
            add("contacts", F.col("found") > 0)
        if self.least_slots:
            add("contacts", F.col("slots") >= self.least_slots)
        if self.industries:
            add("industry", _one_of("industry", self.industries))
        if self.least_value is not None:
            add("value", F.coalesce(F.col("value") >= self.least_value, F.lit(False)))
        if self.most_value is not None:
            add("value", F.coalesce(F.col("value") <= self.most_value, F.lit(False)))
        if self.like:
            add("lookalike", (self.likeness() >= 4) & (F.col("company_id") != self.like["company_id"]))
        if self.companies:
            add("companyList", reduce(lambda a, b: a | b, (F.contains(F.lower("name"), F.lit(c.lower().strip())) for c in self.companies)))
        if self.reach:
            add("reach", _one_of("reach", self.reach))
        add("stage", _one_of("stage", self.stages) if self.stages else (F.col("stage") != "not_buyer") & ~F.col("rejected"))
        if self.least_fit:
            add("minFit", F.col("fit") >= self.least_fit)
        if self.how_sure:
            add("howSure", _one_of("how_sure", self.how_sure))
        for word in (self.text or "").lower().split():
            add("q", F.contains(F.lower(F.concat_ws("\n", "name", "role", "country", F.array_join("items", " "))), F.lit(word)))
        if self.tiers:
            add("tiers", _one_of("tier", self.tiers))
        if self.links:
            add("linkStatus", _one_of("link", self.links))
        if self.triggers:
            add("triggers", _one_of("trigger_kind", self.triggers))
        if self.undated:
            add("triggers", F.col("trigger_date").isNull())
        if self.trigger_days:
            add("triggers", F.coalesce(F.datediff(F.lit(self.as_of), "trigger_date").between(0, self.trigger_days), F.lit(False)))
        return {dim: reduce(and_, conds) for dim, conds in out.items()}

    def apply(self, records: DataFrame, omit: str | None = None) -> DataFrame:
        return records.where(reduce(and_, (c for d, c in self.conditions().items() if d != omit), F.lit(True)))


def representatives(records: DataFrame, group: str) -> DataFrame:
    """One record for each group, the fittest, then the latest, then the least id, with ``deals``, the number of its records."""
    order = F.struct("fit", "trigger_date", (-F.col("company_id")).alias("last"))
    return records.groupBy(group).agg(F.max_by(F.struct(*records.columns), order).alias("x"), F.count("*").alias("deals")).select("x.*", "deals")


def ordered(records: DataFrame, by: str, search: BuyerSearch | None = None) -> list[Column]:
    """The columns that records are ordered by: fit, window (open ones first, then the next to open), latest or likeness."""
    latest, fit, last = F.coalesce("trigger_date", "created").desc(), F.col("fit").desc(), F.col("company_id")
    today = F.lit((search or BuyerSearch()).as_of)
    window = F.when(F.col("window_from").isNull(), "9999").when(F.col("window_from") <= today, "0000").otherwise(F.col("window_from").cast("string"))
    return {"fit": [fit, latest, last], "window": [window, fit, last], "latest": [latest, fit, last], "likeness": [(search or BuyerSearch()).likeness().desc(), fit, last]}[by]


DIMENSIONS = ("location", "roles", "sell", "signals", "contacts", "industry", "value", "lookalike", "companyList", "reach", "stage", "minFit", "howSure", "q", "tiers", "linkStatus", "triggers")
