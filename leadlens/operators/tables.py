"""The table of leads: what a user asks of it by country, role, trigger, age, fit, product, words, company, contacts and activity."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableQuery:
    """Fields that are left out ask for nothing. ``age`` is `undated` or a number of days, ``contacts`` missing, found or
    validated, ``activity`` active or one of the activities. Rejected rows show only if they are asked for."""

    qualification: str | None = None
    show_rejected: bool = False
    country: str | None = None
    role: str | None = None
    trigger: str | None = None
    age: str | None = None
    fit: str | None = None
    product: str | None = None
    keyword: str | None = None
    text: str | None = None
    company: int | None = None
    contact_role: str | None = None
    contacts: str | None = None
    activity: str | None = None
    as_of: dt.date = field(default_factory=lambda: dt.date(2001, 8, 2))

    def conditions(self) -> list[Column]:
        """Over company_id, name, country, role, qualification, trigger_kind, trigger_date, stage, items, keyword, what, found, validated, contact_roles, activity."""
        c, out = F.col, []
        equal = {"country": self.country, "role": self.role, "trigger_kind": self.trigger, "stage": self.fit, "company_id": self.company}
        out += [c(k) == v for k, v in equal.items() if v is not None]
        out.append(c("qualification") == self.qualification if self.qualification else F.lit(True) if self.show_rejected else c("qualification") != "rejected")
        if self.age == "undated":
            out.append(c("trigger_date").isNull())
        elif self.age:
            out.append(F.date_diff(F.lit(self.as_of), "trigger_date").between(0, int(self.age)))
        if self.product:
            out.append(F.array_contains("items", self.product))
        if self.keyword:
            out.append(F.contains(F.lower("keyword"), F.lit(self.keyword.lower())))
        if self.text:
            out.append(F.contains(F.lower(F.concat_ws(" ", "name", "what", "trigger_kind")), F.lit(self.text.lower())))
        if self.contact_role:
            out.append(F.array_contains("contact_roles", self.contact_role))
        if self.contacts:
            out.append({"missing": c("found") == 0, "found": c("found") > 0, "validated": c("validated")}[self.contacts])
        if self.activity:
            out.append(c("activity").isin("recent", "ongoing") if self.activity == "active" else c("activity") == self.activity)
        return [F.coalesce(x, F.lit(False)) for x in out]

    def test(self) -> Column:
        return reduce(and_, self.conditions())

    def page(self, rows: DataFrame, by: str, descending: bool, page: int, size: int) -> DataFrame:
        """One page of the rows that pass, by a column (rows without it last), then by id, with the number of all in ``total``."""
        passed = rows.where(self.test())
        total = passed.agg(F.count("*").alias("total"))
        order = F.desc_nulls_last(by) if descending else F.asc_nulls_last(by)
        shown = passed.orderBy(order, "company_id").offset((page - 1) * size).limit(size)
        return shown.join(F.broadcast(total))
