"""Evidence, confidence, gates, rubric, classes and signals over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators.scalars import noisy_or, recency
from leadlens.plans import scoring as sc
from leadlens.plans.carriers import AS_OF
from leadlens.registry import Tables, query

NOW = "TIMESTAMP '2001-08-02'"

EVIDENCE_SQL = f"""evidence AS (
  SELECT l_orderkey AS lead_id, l_suppkey AS publisher, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'C' END AS tier, l_linestatus = 'F' AS verified, l_linenumber % 2 = 1 AS twice,
    CASE l_returnflag WHEN 'A' THEN CAST(0.85 AS DOUBLE) WHEN 'R' THEN CAST(0.7 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END * CASE WHEN l_linestatus = 'F' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END
    * CASE WHEN datediff('day', l_shipdate, {NOW}) <= 90 THEN CAST(1.0 AS DOUBLE) WHEN datediff('day', l_shipdate, {NOW}) <= 365 THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END
    * CASE WHEN l_linenumber % 2 = 1 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS weight FROM lineitem)"""
CONFIDENCE_SQL = f"""{EVIDENCE_SQL}, per AS (SELECT lead_id, publisher, max(weight) AS w FROM evidence GROUP BY 1, 2),
nor AS (SELECT lead_id, 1 - list_reduce(list_sort(list(w)), lambda a, x: a * (1 - x), CAST(1.0 AS DOUBLE)) AS p, count(*) AS publishers FROM per GROUP BY 1),
conf AS (SELECT o_orderkey AS lead_id, CASE WHEN c_acctbal >= 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS certainty, floor(coalesce(p, 0) * CASE WHEN c_acctbal >= 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END * 1000 + 0.5) / 1000 AS confidence, coalesce(publishers, 0) AS publishers
  FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nor ON lead_id = o_orderkey)"""
BAND_SQL = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END"


def evidence(t: Tables) -> DataFrame:
    tier = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B").otherwise("C")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("lead_id"),
        F.col("l_suppkey").alias("publisher"),
        tier.alias("tier"),
        (F.col("l_linestatus") == "F").alias("verified"),
        F.when(F.col("l_linenumber") % 2 == 1, "both").otherwise("single").alias("agreement"),
        F.datediff(F.lit(AS_OF), "l_shipdate").alias("age"),
    )
    return rows.withColumn("weight", sc.evidence_weight(F.col("tier"), F.col("verified"), F.col("agreement"), F.col("age")))


def certainty(t: Tables) -> DataFrame:
    value = F.when(F.col("c_acctbal") >= 0, 0.9).otherwise(0.6)
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("lead_id"), value.alias("certainty"))


@query(f"WITH {CONFIDENCE_SQL} SELECT lead_id, confidence, publishers, {BAND_SQL} AS band FROM conf")
def confidence_noisy_or(t: Tables) -> DataFrame:
    return sc.confidence(evidence(t), certainty(t))


def facts(t: Tables) -> DataFrame:
    """One row for each order with all that gates and rubric need; lines are read once and grouped once."""
    ev = evidence(t)
    proof = ev.groupBy("lead_id").agg(F.bool_or(F.col("tier") == "A").alias("tier_a"), F.bool_or(F.col("tier") == "B").alias("tier_b"), F.bool_or(F.col("verified") & (F.col("agreement") == "both")).alias("gate_grade"))
    lines = t.lineitem.join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("lead_id")).agg(
        F.bool_or(F.col("p_type").isin("ECONOMY", "SMALL")).alias("core"),
        F.bool_or(F.col("p_type") == "MEDIUM").alias("adjacent"),
        F.max("l_shipdate").alias("closing"),
        F.max(F.when(F.col("l_shipdate") <= F.lit(AS_OF), F.col("l_shipdate"))).alias("latest"),
        F.count_distinct("l_suppkey").alias("rivals"),
    )
    # Awards of the buyer in the five years before; the order itself isn't one of them.
    recent = t.orders.where(F.datediff(F.lit(AS_OF), "o_orderdate") / F.lit(30.44) <= 60)
    own = recent.groupBy("o_custkey").agg(F.count("*").alias("all"))
    alike = recent.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("same"))
    market = t.nation.where("n_regionkey in (0, 1, 2)").select("n_nationkey", F.lit(True).alias("market"))
    base = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(market), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    rows = base.select(F.col("o_orderkey").alias("lead_id"), "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("value"), F.col("o_orderdate").alias("awarded"), F.col("o_orderstatus").alias("status"), F.coalesce("market", F.lit(False)).alias("in_market"))
    self_in = (F.datediff(F.lit(AS_OF), "awarded") / F.lit(30.44) <= 60).cast("int")
    rows = rows.join(own, "o_custkey", "left").join(alike, ["o_custkey", "o_orderpriority"], "left").join(lines, "lead_id", "left").join(proof, "lead_id", "left")
    no = F.lit(False)
    rows = rows.withColumns({"history": F.coalesce("all", F.lit(0)) - self_in, "similar": F.coalesce("same", F.lit(0)) - self_in, "kind": F.when(F.col("status") == "F", "supply").otherwise("bid")})
    return rows.withColumns({c: F.coalesce(c, no) for c in ("core", "adjacent", "tier_a", "tier_b", "gate_grade")})


FACTS_SQL = f"""{CONFIDENCE_SQL}, proof AS (SELECT lead_id, bool_or(tier = 'A') AS tier_a, bool_or(tier = 'B') AS tier_b, bool_or(verified AND twice) AS gate_grade FROM evidence GROUP BY 1),
ln AS (SELECT l_orderkey AS lead_id, bool_or(p_type IN ('ECONOMY', 'SMALL')) AS core, bool_or(p_type = 'MEDIUM') AS adjacent, max(l_shipdate) AS closing, max(l_shipdate) FILTER (WHERE l_shipdate <= {NOW}) AS latest,
  count(DISTINCT l_suppkey) AS rivals FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
recent AS (SELECT * FROM orders WHERE datediff('day', o_orderdate, {NOW}) / 30.44 <= 60),
own AS (SELECT o_custkey, count(*) AS n FROM recent GROUP BY 1), alike AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM recent GROUP BY 1, 2),
facts AS (SELECT o.o_orderkey AS lead_id, o_totalprice AS value, o_orderdate AS awarded, o_orderstatus AS status, coalesce(n_regionkey IN (0, 1, 2), FALSE) AS in_market, CASE WHEN o_orderstatus = 'F' THEN 'supply' ELSE 'bid' END AS kind,
  coalesce(own.n, 0) - CAST(datediff('day', o_orderdate, {NOW}) / 30.44 <= 60 AS INT) AS history, coalesce(alike.n, 0) - CAST(datediff('day', o_orderdate, {NOW}) / 30.44 <= 60 AS INT) AS sim,
  coalesce(core, FALSE) AS core, coalesce(adjacent, FALSE) AS adjacent, closing, latest, rivals, coalesce(tier_a, FALSE) AS tier_a, coalesce(tier_b, FALSE) AS tier_b, coalesce(gate_grade, FALSE) AS gate_grade
  FROM orders o JOIN customer ON c_custkey = o.o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN own ON own.o_custkey = o.o_custkey LEFT JOIN alike ON alike.o_custkey = o.o_custkey AND alike.o_orderpriority = o.o_orderpriority
  LEFT JOIN ln ON ln.lead_id = o.o_orderkey LEFT JOIN proof ON proof.lead_id = o.o_orderkey),
sized AS (SELECT *, CASE WHEN value < 20000 THEN 'below_min' WHEN value < 50000 THEN 'below' WHEN value > 300000 THEN 'above' ELSE 'within' END AS size, datediff('day', {NOW}, closing) AS days, datediff('day', awarded, {NOW}) / 30.44 AS months FROM facts),
pts AS (SELECT *, CASE WHEN core THEN 10 WHEN adjacent THEN 6 ELSE 0 END AS p11, CASE WHEN size = 'within' THEN 4 WHEN size IN ('above', 'below') THEN 2 ELSE 0 END AS p14,
  CASE WHEN kind = 'bid' THEN CASE WHEN days >= 0 THEN 8 ELSE 0 END WHEN months <= 9 THEN 8 WHEN months <= 18 THEN 5 ELSE 0 END AS p21,
  CASE WHEN days IS NULL THEN NULL WHEN days BETWEEN 14 AND 90 THEN 5 WHEN days BETWEEN 3 AND 13 OR days BETWEEN 91 AND 180 THEN 3 ELSE 0 END AS p22,
  CASE WHEN latest IS NULL THEN 0 ELSE CAST(round(4 * pow(0.5, greatest(datediff('day', latest, {NOW}), 0) / CAST(60 AS DOUBLE))) AS INT) END AS p23,
  CASE status WHEN 'F' THEN 6 WHEN 'P' THEN 4 ELSE 1 END AS p32, CASE WHEN sim >= 3 THEN 5 WHEN sim >= 1 THEN 3 WHEN history >= 1 THEN 1 END AS p33,
  CASE size WHEN 'within' THEN 6 WHEN 'above' THEN 4 ELSE 0 END AS p51, CASE WHEN rivals IS NULL THEN NULL WHEN rivals <= 3 THEN 4 WHEN rivals <= 6 THEN 2 ELSE 1 END AS p52 FROM sized),
scored AS (SELECT *, CAST(round(100.0 * (p11 + p14 + p21 + coalesce(p22, 0) + p23 + p32 + coalesce(p33, 0) + p51 + coalesce(p52, 0)) / 52) AS INT) AS score FROM pts)"""


@query(f"WITH {FACTS_SQL} SELECT lead_id, p11, p14, p21, CAST(p22 AS DOUBLE) AS p22, p23, p32, CAST(p33 AS DOUBLE) AS p33, p51, CAST(p52 AS DOUBLE) AS p52, score, concat_ws(',', CASE WHEN p22 IS NULL THEN 'p22' END, CASE WHEN p33 IS NULL THEN 'p33' END, CASE WHEN p52 IS NULL THEN 'p52' END) AS unknown FROM scored")
def rubric_score(t: Tables) -> DataFrame:
    open_ended = ("p22", "p33", "p52")
    return sc.score(sc.points(facts(t), AS_OF)).select("lead_id", *(F.col(c).cast("double" if c in open_ended else "int").alias(c) for c in sc.RUBRIC), "score", "unknown")


GATES_SQL = f"""gated AS (SELECT s.*, certainty, confidence, publishers, {BAND_SQL} AS band, certainty >= 0.85 AS g1, core OR adjacent AS g2, in_market AS g3,
  CASE WHEN kind = 'bid' THEN coalesce(days >= 3, datediff('day', latest, {NOW}) < 60, FALSE) ELSE coalesce(months < 18, FALSE) END AS g4, publishers >= 2 OR tier_a AS g5, gate_grade AS g6,
  NOT (publishers >= 2 OR tier_a) AND tier_b AS g5_cap FROM scored s JOIN conf USING (lead_id))"""


@query(f"WITH {FACTS_SQL}, {GATES_SQL} SELECT lead_id, g1, g2, g3, g4, g5, g6, g5_cap FROM gated")
def gates(t: Tables) -> DataFrame:
    return _gated(t).select("lead_id", "g1", "g2", "g3", "g4", "g5", "g6", "g5_cap")


def _gated(t: Tables) -> DataFrame:
    sure = certainty(t)
    rows = facts(t).join(sc.confidence(evidence(t), sure), "lead_id").join(sure, "lead_id")
    return sc.gates(rows, AS_OF)


@query(f"""WITH {FACTS_SQL}, {GATES_SQL} SELECT lead_id, score, confidence, band, CASE WHEN NOT (g1 AND g2 AND g3 AND g4 AND g6 AND (g5 OR g5_cap)) THEN 'rejected' WHEN score >= 70 AND band = 'high' AND NOT g5_cap THEN 'genuine'
WHEN score BETWEEN 55 AND 69 OR (score >= 70 AND band IN ('high', 'medium')) THEN 'research' ELSE 'watch' END AS class FROM gated""")
def classify(t: Tables) -> DataFrame:
    return sc.classify(sc.score(sc.points(_gated(t), AS_OF))).select("lead_id", "score", "confidence", "band", "class")


@query(f"""WITH {FACTS_SQL}, cells AS (SELECT lead_id, unnest([{{'n': 'p11', 'p': p11, 'm': 10, 'i': 0}}, {{'n': 'p14', 'p': p14, 'm': 4, 'i': 1}}, {{'n': 'p21', 'p': p21, 'm': 8, 'i': 2}}, {{'n': 'p22', 'p': p22, 'm': 5, 'i': 3}}, {{'n': 'p23', 'p': p23, 'm': 4, 'i': 4}}, {{'n': 'p32', 'p': p32, 'm': 6, 'i': 5}},
{{'n': 'p33', 'p': p33, 'm': 5, 'i': 6}}, {{'n': 'p51', 'p': p51, 'm': 6, 'i': 7}}, {{'n': 'p52', 'p': p52, 'm': 4, 'i': 8}}]) AS c FROM scored),
r AS (SELECT lead_id, c.n AS n, row_number() OVER (PARTITION BY lead_id ORDER BY c.p DESC, c.p / CAST(c.m AS DOUBLE) DESC, c.i) AS r FROM cells WHERE c.p > 0)
SELECT lead_id, string_agg(n, ',' ORDER BY r) AS reasons FROM r WHERE r <= 3 GROUP BY 1""")
def top_reasons(t: Tables) -> DataFrame:
    return sc.points(facts(t), AS_OF).select("lead_id", sc.top_reasons().alias("reasons"))


@query("SELECT sha1(concat_ws('|', event_type, CAST(user_id AS VARCHAR), coalesce(nullif(CAST(json_extract(props, '$.k') AS BIGINT) % 5, 0)::VARCHAR, ''), strftime(ts, '%Y-%m'))) AS fingerprint, count(*) AS merged, min(ts) AS first, list_sort(list(event_id)) AS evidence_ids FROM events GROUP BY 1")
def signal_fingerprint(t: Tables) -> DataFrame:
    """Signals of one type, buyer, project and month are one, with the evidence of all; an empty slot keeps its place."""
    slot = F.coalesce(F.nullif(F.get_json_object("props", "$.k").cast("long") % 5, F.lit(0)).cast("string"), F.lit(""))
    key = F.sha1(F.concat_ws("|", "event_type", F.col("user_id").cast("string"), slot, F.date_format("ts", "yyyy-MM")))
    return t.events.groupBy(key.alias("fingerprint")).agg(F.count("*").alias("merged"), F.min("ts").alias("first"), F.array_sort(F.collect_list("event_id")).alias("evidence_ids"))


@query(f"SELECT o_custkey, count(DISTINCT o_orderpriority) AS kinds, CASE WHEN count(DISTINCT o_orderpriority) >= 2 THEN 3 WHEN count(DISTINCT o_orderpriority) = 1 THEN 1 ELSE 0 END AS points FROM orders WHERE datediff('day', o_orderdate, {NOW}) <= 90 GROUP BY 1")
def momentum_90d(t: Tables) -> DataFrame:
    kinds = t.orders.where(F.datediff(F.lit(AS_OF), "o_orderdate") <= 90).groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("kinds"))
    return kinds.withColumn("points", F.when(F.col("kinds") >= 2, 3).when(F.col("kinds") == 1, 1).otherwise(0))


@query(f"SELECT o_custkey, CAST(round(4 * pow(0.5, greatest(datediff('day', max(o_orderdate), {NOW}), 0) / CAST(60 AS DOUBLE))) AS INT) AS points FROM orders GROUP BY 1")
def recency_decay(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(recency(F.datediff(F.lit(AS_OF), F.max("o_orderdate"))).alias("points"))


@query(f"WITH s AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS sim, count(*) AS history FROM orders WHERE datediff('day', o_orderdate, {NOW}) / 30.44 <= 60 GROUP BY 1) SELECT o_custkey, CASE WHEN sim >= 3 THEN 5 WHEN sim >= 1 THEN 3 WHEN history >= 1 THEN 1 END AS points FROM s")
def track_record(t: Tables) -> DataFrame:
    s = t.orders.where(F.datediff(F.lit(AS_OF), "o_orderdate") / F.lit(30.44) <= 60).groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("similar"), F.count("*").alias("history"))
    return s.select("o_custkey", F.when(F.col("similar") >= 3, 5).when(F.col("similar") >= 1, 3).when(F.col("history") >= 1, 1).alias("points"))


@query(f"""WITH b AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS orders, count(o_orderkey) FILTER (WHERE datediff('day', o_orderdate, {NOW}) <= 180) AS recent, max(o_totalprice) AS top FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
s AS (SELECT c_custkey, CASE WHEN orders > 0 THEN 30 ELSE 0 END + CASE WHEN recent > 0 THEN 20 ELSE 0 END + CASE WHEN top >= 300000 THEN 15 ELSE 0 END + CASE WHEN orders >= 10 THEN 15 ELSE 0 END + CASE WHEN c_acctbal > 0 THEN 5 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 5 ELSE 0 END AS score FROM b)
SELECT c_custkey, score, CASE WHEN score >= 75 THEN 'High' WHEN score >= 45 THEN 'Medium' ELSE 'Low' END AS confidence FROM s""")
def simple_buyer_score(t: Tables) -> DataFrame:
    per = t.orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.datediff(F.lit(AS_OF), "o_orderdate") <= 180).alias("recent"), F.max("o_totalprice").alias("top"))
    rows = t.customer.join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    give = lambda cond, n: F.when(cond, n).otherwise(0)
    total = give(F.col("orders") > 0, 30) + give(F.col("recent") > 0, 20) + give(F.col("top") >= 300000, 15) + give(F.col("orders") >= 10, 15) + give(F.col("c_acctbal") > 0, 5) + give(F.col("c_acctbal") > 5000, 5)
    return rows.select("c_custkey", total.alias("score")).withColumn("confidence", F.when(F.col("score") >= 75, "High").when(F.col("score") >= 45, "Medium").otherwise("Low"))


@query(f"""WITH {EVIDENCE_SQL}, w AS (SELECT publisher, list_sort(list(weight)) AS ws FROM evidence WHERE verified GROUP BY 1) SELECT publisher, round(1 - list_reduce(ws[-3:], lambda a, x: a * (1 - x), CAST(1.0 AS DOUBLE)), 6) AS trust FROM w""")
def publisher_trust(t: Tables) -> DataFrame:
    best = F.slice(F.sort_array(F.collect_list("weight"), asc=False), 1, 3)
    return evidence(t).where("verified").groupBy("publisher").agg(F.round(noisy_or(best), 6).alias("trust"))
