"""The whole rubric: 19 parts of 5 criteria, 100 points. A part whose facts are unknown is null and counts as 0."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Criteria, their parts, and the most points of each.
PARTS = {"C1": {"p11": 10, "p12": 6, "p13": 5, "p14": 4}, "C2": {"p21": 8, "p22": 5, "p23": 4, "p24": 3}, "C3": {"p31": 6, "p32": 6, "p33": 5, "p34": 3}, "C4": {"p41": 8, "p42": 6, "p43": 4, "p44": 2}, "C5": {"p51": 6, "p52": 4, "p53": 5}}
MOST = {p: n for parts in PARTS.values() for p, n in parts.items()}


def _by(column: str, points: dict[str, int]) -> Column:
    """Points by a word; words that aren't listed, and null, are unknown."""
    out = F
    for word, n in points.items():
        out = out.when(F.col(column) == word, n)
    return out.otherwise(F.lit(None)) if points else F.lit(None)


def points(context: DataFrame) -> DataFrame:
    """Adds p11 to p53 to one row for each lead. The columns of the context, any of which may be null:

    core, adjacent; spec (within, unstated, outside, other); sector (own, related, other); size (within, above, below,
    below_min) and size_of (contract, project); kind (bid, supply), tender_open, stage, funding; award_months;
    deadline_days; latest_days; kinds_90d; authority (self, other), package_owner (self, other), typical; awarded,
    government_budget; similar, history; active, listed; rule_missing, rule_unknown; person, channel; closed_list;
    customer; rivals; delivery (served, country, outside).
    """
    c, yes = F.col, lambda name: F.coalesce(F.col(name), F.lit(False))
    bid, stage, months, days = c("kind") == "bid", F.coalesce(c("stage"), F.lit("")), c("award_months"), c("deadline_days")
    funding = F.coalesce(c("funding"), F.lit(""))
    bid_window = F.when(yes("tender_open") | stage.isin("prequalification", "epc_tender"), 8).when((stage == "feed") | (funding == "budgeted"), 5).when(stage.isin("concept", "feasibility") | (funding == "announced"), 2).otherwise(0)
    supply_window = F.when(stage == "commissioning", 0).when((months <= 9) | stage.isin("detailed_engineering", "procurement"), 8).when(months <= 18, 5).when(stage == "construction", 2).otherwise(0)
    buyer = F.when(bid & (c("authority") == "self"), 6).when(bid & c("authority").isNull(), None).when(c("package_owner") == "self", 6).when(c("package_owner") == "other", 0).when(yes("typical"), 3)
    contract = F.when(c("size").isNull(), None).when(c("size") == "within", 6).when(c("size") == "above", 4).otherwise(0)
    project = F.when(c("size").isNull(), None).when(c("size") != "below_min", 2).otherwise(0)
    made = {
        "p11": F.when(yes("core"), 10).when(yes("adjacent"), 6).otherwise(0),
        "p12": _by("spec", {"within": 6, "unstated": 3, "outside": 0, "other": 0}),
        "p13": F.coalesce(_by("sector", {"own": 5, "related": 3}), F.lit(0)),
        "p14": _by("size", {"within": 4, "above": 2, "below": 2, "below_min": 0}),
        "p21": F.when(bid, bid_window).otherwise(supply_window),
        "p22": F.when(days.isNull(), None).when(days.between(14, 90), 5).when(days.between(3, 13) | days.between(91, 180), 3).otherwise(0),
        "p23": F.when(c("latest_days").isNull(), 0).otherwise(F.round(4 * F.pow(F.lit(0.5), F.greatest(c("latest_days"), F.lit(0)) / 60))),
        "p24": F.when(c("kinds_90d") >= 2, 3).when(c("kinds_90d") == 1, 1).otherwise(0),
        "p31": buyer,
        "p32": F.when(yes("awarded") | funding.isin("fid", "awarded"), 6).when(yes("government_budget") | (funding == "budgeted"), 4).otherwise(1),
        "p33": F.when(c("similar") >= 3, 5).when(c("similar") >= 1, 3).when(c("history") >= 1, 1),
        "p34": F.when(yes("active") & yes("listed"), 3).when(yes("active"), 2).otherwise(1),
        "p41": F.when(yes("rule_missing"), 0).when(yes("rule_unknown"), 4).otherwise(8),
        "p42": F.when(yes("person"), 3).when(yes("channel"), 1),
        "p43": F.when(bid & yes("tender_open"), 4).when(~bid & (months < 18), 2).when(yes("closed_list"), 1),
        "p44": F.when(yes("customer"), 2).otherwise(0),
        "p51": F.when(c("size_of") == "contract", contract).otherwise(project),
        "p52": F.when(c("rivals").isNull(), None).when(c("rivals") <= 3, 4).when(c("rivals") <= 6, 2).otherwise(1),
        "p53": _by("delivery", {"served": 5, "country": 3, "outside": 1}),
    }
    return context.withColumns({p: made[p].cast("int") for p in MOST})


def totals(scored: DataFrame) -> DataFrame:
    """Adds the sum of each criterion (c1 to c5), score (0 to 100) and unknown, the parts without points."""
    sums = {k.lower(): reduce(add, (F.coalesce(p, F.lit(0)) for p in parts)) for k, parts in PARTS.items()}
    unknown = F.array_join(F.array_compact(F.array(*(F.when(F.col(p).isNull(), p) for p in MOST))), ",")
    return scored.withColumns(sums | {"unknown": unknown}).withColumn("score", reduce(add, map(F.col, sums)))
