"""From facts to signals, one for each event in the world, and from signals to candidates for leads."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Signals by which a company asks for bids, and by which it will buy.
BID = ["tender_released", "prequalification_opened", "vendor_registration_opened", "feed_awarded"]
SUPPLY = ["contract_awarded", "subcontract_awarded", "supply_order_announced", "approved_vendor_listed", "hiring_project_roles"]
#: Days before closing in which a tender closes soon.
SOON = (5, 21)
COLUMNS = ["type", "signal_date", "company_id", "project_id", "package_id", "tender_ref", "evidence_id"]


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {"type": "string", "signal_date": "date", "tender_ref": "string"}
    cell = lambda c: columns.get(c, F.col(c) if c in df.columns else F.lit(None)).cast(kinds.get(c, "long")).alias(c)
    return df.select(*map(cell, COLUMNS))


def projects(parties: DataFrame, edges: DataFrame, stages: DataFrame, tenders: DataFrame, as_of: dt.date) -> DataFrame:
    """type, signal_date, company_id, project_id, package_id, tender_ref and evidence_id of all events that facts of projects tell.

    parties: project_id, company_id, role, package_id, award_date, seen (the earliest evidence). edges: type, from_id, to_id,
    project_id, package_id, event_date, seen. stages: project_id, owner_id, stage, event_date, seen, tendered. tenders:
    project_id, buyer_id, package_id, ref, issued, closing, status, route. All have evidence_id. Events without a day of their
    own have that of their evidence, or today's.
    """
    today = F.lit(as_of)
    day = lambda *c: F.coalesce(*c, today)
    # Kinds of one table exclude each other: each table is read once, whatever number of kinds it has.
    under, has_day = F.col("role") == "subcontractor", F.col("award_date").isNotNull()
    won = F.when(under, "subcontract_awarded").when(F.col("role").isin("main_epc", "consortium_member", "supplier") & has_day, "contract_awarded")
    awarded = _rows(parties.where(won.isNotNull()), type=won, signal_date=F.when(under, day(F.col("award_date"), F.col("seen"))).otherwise(F.col("award_date")), **({"package_id": F.when(F.col("role") != "supplier", F.col("package_id"))} if "package_id" in parties.columns else {}))
    supplied, event_day = F.col("type") == "supplied_by", F.col("event_date")
    told = F.when(supplied & event_day.isNotNull(), "supply_order_announced").when(F.col("type") == "approved_vendor_of", "approved_vendor_listed")
    related = _rows(edges.where(told.isNotNull()), type=told, signal_date=F.when(supplied, event_day).otherwise(day(event_day, F.col("seen"))), company_id=F.when(supplied, F.col("from_id")).otherwise(F.col("to_id")))
    # A tender says more than the stage that it belongs to.
    reached = F.when(F.col("stage") == "feed", "feed_awarded").when(F.col("tendered"), None).when(F.col("stage") == "prequalification", "prequalification_opened").when(F.col("stage") == "epc_tender", "tender_released")
    at_stage = _rows(stages.where(reached.isNotNull()), type=reached, signal_date=day(F.col("event_date"), F.col("seen")), company_id=F.col("owner_id"))
    open_ = tenders.where(~F.col("status").isin("closed", "awarded", "cancelled") & (F.col("closing").isNull() | (F.col("closing") >= today)))
    route = F.when(F.col("route") == "prequal", "prequalification_opened").when(F.col("route") == "vendor_registration", "vendor_registration_opened").otherwise("tender_released")
    opened = _rows(open_, type=route, signal_date=day(F.col("issued")), company_id=F.col("buyer_id"), tender_ref=F.col("ref"))
    closing = _rows(open_.where(F.datediff("closing", today).between(*SOON)), type=F.lit("tender_closing_soon"), signal_date=today, company_id=F.col("buyer_id"), tender_ref=F.col("ref"))
    return reduce(DataFrame.unionByName, [awarded, related, at_stage, opened, closing])


def hiring(jobs: DataFrame, as_of: dt.date) -> DataFrame:
    """The same of job posts: project_id, company_id, posted, evidence_id."""
    return _rows(jobs, type=F.lit("hiring_project_roles"), signal_date=F.coalesce("posted", F.lit(as_of)))


def signals(parties: DataFrame, edges: DataFrame, stages: DataFrame, tenders: DataFrame, jobs: DataFrame, as_of: dt.date) -> DataFrame:
    """All events of projects() and hiring()."""
    return projects(parties, edges, stages, tenders, as_of).unionByName(hiring(jobs, as_of))


def fingerprint() -> Column:
    """The same for the same event: type, company, project, package, tender and month; what is missing leaves its place empty."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.sha1(F.concat_ws("|", *map(part, ("type", "company_id", "project_id", "package_id", "tender_ref")), F.date_format("signal_date", "yyyy-MM")))


def _each(parts: Sequence[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, map(made, parts))


def upserted(*parts: DataFrame) -> DataFrame:
    """One row for each event with the evidence of all its sources; a second source adds to the first and never makes a second row.

    Signals may come in several parts that have no event in common. A part whose facts are dealt by project_id isn't shuffled.
    """
    keys = [c for c in COLUMNS if c not in ("signal_date", "evidence_id")]

    def made(rows: DataFrame) -> DataFrame:
        # An event is its keys and its month: the longer fingerprint is made of each event once. What is told twice is one row before lists are made.
        told = rows.withColumn("month", F.trunc("signal_date", "month")).groupBy(*keys, "month", "evidence_id").agg(F.min("signal_date").alias("signal_date"))
        each = told.groupBy(*keys, "month").agg(F.min("signal_date").alias("signal_date"), F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
        return each.select(fingerprint().alias("fingerprint"), *keys, "signal_date", "evidence_ids")

    return _each(parts, made)


def named(*parts: DataFrame) -> DataFrame:
    """The events of upserted() that suggest leads, with their keys alone: what candidates() needs of them."""
    keys = [c for c in COLUMNS if c not in ("signal_date", "evidence_id")]
    suggest = F.col("company_id").isNotNull() & F.col("type").isin(*BID, *SUPPLY)
    return _each(parts, lambda rows: rows.where(suggest).select(*keys, F.trunc("signal_date", "month").alias("month")).distinct())


def candidates(events: DataFrame, packages: DataFrame | None) -> DataFrame:
    """kind, buyer_id, project_id, package_id and the number of signals of every lead that the events suggest.

    ``events``: a row for each. packages: project_id, package_id, owner_id (null if nobody's), each package once; None if no
    event is of a project. Calls for bids are leads on their own project. A buyer without a package is a lead on each package
    of the project that it or nobody owns; an award whose project has none stays one lead.
    """
    bid, supply = F.col("type").isin(*BID), F.col("type").isin(*SUPPLY)
    told = events.where(F.col("company_id").isNotNull() & (bid | supply)).withColumnRenamed("company_id", "buyer_id").withColumn("kind", F.when(bid, "bid").otherwise("supply_subcontract"))
    if packages is not None:
        # Leads that are open to packages meet them; the others pass once.
        open_ = supply & F.col("package_id").isNull()
        met = told.withColumn("open", open_).join(packages.select(F.col("project_id").alias("of"), F.col("package_id").alias("on"), "owner_id", F.lit(True).alias("met")), F.col("open") & (F.col("project_id") == F.col("of")), "left")
        told = met.where("met is null or owner_id is null or owner_id = buyer_id").withColumn("package_id", F.coalesce("package_id", "on"))
    return told.groupBy("kind", "buyer_id", "project_id", "package_id").agg(F.count("*").alias("signals"))
