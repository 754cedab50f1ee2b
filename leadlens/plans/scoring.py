"""Evidence to confidence, gates, rubric points, score and class, over any relations of the shapes named below.

Thresholds are fixed values of the rules; ``as_of`` is a parameter, so that results can be repeated.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.operators.scalars import months_between, noisy_or, recency

#: Fixed values.
TIER_WEIGHT = {"A": 0.85, "B": 0.7, "C": 0.5}
UNVERIFIED, SINGLE = 0.3, 0.75
FRESHNESS = ((90, 1.0), (365, 0.8))
STALE = 0.5
HIGH, MEDIUM = 0.8, 0.5
GENUINE, RESEARCH = 70, 55
LEAST_CERTAINTY = 0.85
AWARD_FRESH_MONTHS, AWARD_MAX_MONTHS = 9, 18
#: Rubric: sub-criterion and its most points.
RUBRIC = {"p11": 10, "p14": 4, "p21": 8, "p22": 5, "p23": 4, "p32": 6, "p33": 5, "p51": 6, "p52": 4}
CRITERIA = {"c1": ("p11", "p14"), "c2": ("p21", "p22", "p23"), "c3": ("p32", "p33"), "c5": ("p51", "p52")}


def evidence_weight(tier: Column, verified: Column, agreement: Column, age_days: Column) -> Column:
    """Trust in one piece of evidence: by source tier, quote check, agreement of two readings and age."""
    by_tier = reduce(lambda c, kv: c.when(tier == kv[0], kv[1]), TIER_WEIGHT.items(), F)
    fresh = reduce(lambda c, kv: c.when(age_days <= kv[0], kv[1]), FRESHNESS, F).otherwise(STALE)
    return by_tier * F.when(verified, 1.0).otherwise(UNVERIFIED) * fresh * F.when(agreement.isin("both", "rule"), 1.0).otherwise(SINGLE)


def confidence(evidence: DataFrame, certainty: DataFrame, key: str = "lead_id") -> DataFrame:
    """(key, confidence, band, publishers) from evidence (key, publisher, weight) and certainty (key, certainty).

    A publisher counts once, with its best weight; leads without evidence have confidence 0.
    """
    per_publisher = evidence.groupBy(key, "publisher").agg(F.max("weight").alias("weight"))
    joined = per_publisher.groupBy(key).agg(noisy_or(F.collect_list("weight")).alias("p"), F.count("*").alias("publishers"))
    value = F.floor(F.coalesce("p", F.lit(0.0)) * F.col("certainty") * 1000 + 0.5) / 1000
    band = F.when(F.col("confidence") >= HIGH, "high").when(F.col("confidence") >= MEDIUM, "medium").otherwise("low")
    return certainty.join(joined, key, "left").select(key, value.alias("confidence"), F.coalesce("publishers", F.lit(0)).alias("publishers")).withColumn("band", band)


def size_band(value: Column, least: float, low: float, high: float) -> Column:
    return F.when(value < least, "below_min").when(value < low, "below").when(value > high, "above").otherwise("within")


def points(facts: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Adds the rubric's columns. Facts: core, adjacent (boolean), value, kind (bid or supply), awarded, closing, latest (times),
    status, similar, history (counts), rivals (count or null). Null points mean unknown and count as 0."""
    now = F.lit(as_of)
    band = size_band(F.col("value"), 20_000, 50_000, 300_000)
    months = months_between(F.col("awarded"), now)
    days = F.datediff(F.col("closing"), now)
    supply = F.when(months <= AWARD_FRESH_MONTHS, 8).when(months <= AWARD_MAX_MONTHS, 5).otherwise(0)
    subs = {
        "p11": F.when(F.col("core"), 10).when(F.col("adjacent"), 6).otherwise(0),
        "p14": F.when(band == "within", 4).when(band.isin("above", "below"), 2).otherwise(0),
        "p21": F.when(F.col("kind") == "bid", F.when(days >= 0, 8).otherwise(0)).otherwise(supply),
        "p22": F.when(days.isNull(), None).when(days.between(14, 90), 5).when(days.between(3, 13) | days.between(91, 180), 3).otherwise(0),
        "p23": F.when(F.col("latest").isNull(), 0).otherwise(recency(F.datediff(now, F.col("latest")))),
        "p32": F.when(F.col("status") == "F", 6).when(F.col("status") == "P", 4).otherwise(1),
        "p33": F.when(F.col("similar") >= 3, 5).when(F.col("similar") >= 1, 3).when(F.col("history") >= 1, 1),
        "p51": F.when(band == "within", 6).when(band == "above", 4).otherwise(0),
        "p52": F.when(F.col("rivals").isNull(), None).when(F.col("rivals") <= 3, 4).when(F.col("rivals") <= 6, 2).otherwise(1),
    }
    return facts.withColumns({k: v.cast("int") for k, v in subs.items()})


def score(df: DataFrame) -> DataFrame:
    """Adds ``score``: the points as a share of what this rubric can give, 0 to 100, and ``unknown``: the sub-criteria without points."""
    total = reduce(add, (F.coalesce(c, F.lit(0)) for c in RUBRIC))
    unknown = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in RUBRIC)))
    return df.withColumn("score", F.round(100 * total / sum(RUBRIC.values())).cast("int")).withColumn("unknown", F.array_join(unknown, ","))


def top_reasons(k: int = 3) -> Column:
    """The names of the k best sub-criteria: most points, then the larger share of what it can give, then the rubric's order."""
    cells = [F.struct((-F.col(c)).alias("a"), (-F.col(c) / m).alias("b"), F.lit(i).alias("c"), F.lit(c).alias("name")) for i, (c, m) in enumerate(RUBRIC.items())]
    good = F.filter(F.array_sort(F.array(*cells)), lambda x: x.a < 0)
    return F.array_join(F.slice(F.transform(good, lambda x: x["name"]), 1, k), ",")


def gates(df: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Adds g1 to g6 (pass or fail) and g5_cap: one source of tier B alone caps the class instead of rejecting the lead.

    Needs certainty, core, adjacent, in_market, kind, awarded, closing, latest, publishers, tier_a, tier_b, gate_grade.
    """
    now = F.lit(as_of)
    fresh_award = months_between(F.col("awarded"), now) < AWARD_MAX_MONTHS
    days = F.datediff(F.col("closing"), now)
    bid = F.coalesce(days >= 3, F.datediff(now, F.col("latest")) < 60, F.lit(False))
    return df.withColumns(
        {
            "g1": F.col("certainty") >= LEAST_CERTAINTY,
            "g2": F.col("core") | F.col("adjacent"),
            "g3": F.col("in_market"),
            "g4": F.when(F.col("kind") == "bid", bid).otherwise(F.coalesce(fresh_award, F.lit(False))),
            "g5": (F.col("publishers") >= 2) | F.col("tier_a"),
            "g6": F.col("gate_grade"),
        }
    ).withColumn("g5_cap", ~F.col("g5") & F.col("tier_b"))


def classify(df: DataFrame) -> DataFrame:
    """Adds ``class``: rejected by any gate that doesn't only cap, else by score and band; a cap makes genuine leads research."""
    failed = ~(F.col("g1") & F.col("g2") & F.col("g3") & F.col("g4") & F.col("g6") & (F.col("g5") | F.col("g5_cap")))
    genuine = (F.col("score") >= GENUINE) & (F.col("band") == "high") & ~F.col("g5_cap")
    research = (F.col("score").between(RESEARCH, GENUINE - 1)) | ((F.col("score") >= GENUINE) & F.col("band").isin("high", "medium"))
    return df.withColumn("class", F.when(failed, "rejected").when(genuine, "genuine").when(research, "research").otherwise("watch"))
