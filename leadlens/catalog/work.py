"""Teams of buyers, proof of current work, and the verdict on a need."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators.asof import as_of
from leadlens.operators.selling import sell_items
from leadlens.operators.teams import Slot, team_slots
from leadlens.registry import Tables, query
from leadlens.sources.versions import Versions
from leadlens.streaming.jobs import shared_folder

#: Slots, special ones first, over segments as titles.
SLOTS = [
    Slot("procurement_head", ("BUILDING",), ("BUILDING",)),
    Slot("project_manager", ("MACHINERY", "BUILDING"), ("MACHINERY",)),
    Slot("engineer", ("AUTOMOBILE", "MACHINERY"), ("AUTOMOBILE", "MACHINERY")),
    Slot("buyer", ("HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"), ("HOUSEHOLD", "BUILDING")),
    Slot("anybody", (), ("FURNITURE", "MACHINERY", "HOUSEHOLD")),
]
#: A person is a customer; its company the suppliers' nation and the last digit of its balance in cents; nine in ten have a title.
_PEOPLE_SQL = """people AS (SELECT c_nationkey * 10 + CAST(abs(round(c_acctbal * 100)) AS BIGINT) % 10 AS company, c_custkey AS person, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS title, c_mktsegment AS role,
CASE WHEN c_acctbal >= 9500 THEN 'engineer' WHEN c_acctbal < -900 THEN 'procurement_head' END AS slot FROM customer)"""


def _team_sql() -> str:
    """One step after the other: each open slot takes the least person that nobody has taken."""
    n, out, last = len(SLOTS), ", s0 AS (SELECT DISTINCT company" + "".join(f", CAST(NULL AS BIGINT) AS p{i}" for i in range(len(SLOTS))) + " FROM people)", "s0"
    for turn in range(3):
        for i, s in enumerate(SLOTS):
            listed = lambda v: "(" + ", ".join(f"'{x}'" for x in v) + ")" if v else "('')"
            fits = (f"slot = '{s.name}'", f"title IN {listed(s.titles)}", f"title IS NULL AND role IN {listed(s.roles)}")[turn]
            free = " AND ".join(f"person IS DISTINCT FROM p{j}" for j in range(n))
            step = f"s{turn}_{i}"
            out += f", {step} AS (SELECT s.* REPLACE (coalesce(p{i}, least_one) AS p{i}) FROM {last} s LEFT JOIN (SELECT k.company, min(person) AS least_one FROM {last} k JOIN people q ON q.company = k.company AND {fits} AND {free} GROUP BY 1) c ON c.company = s.company)"
            last = step
    return out + "".join(f"{' UNION ALL ' if i else ' '}SELECT company, '{s.name}' AS slot, CAST(p{i} AS VARCHAR) AS person FROM {last}" for i, s in enumerate(SLOTS))


@query(f"WITH {_PEOPLE_SQL}{_team_sql()}")
def team_of_company(t: Tables) -> DataFrame:
    """Who fills each slot of each company's team."""
    cents = F.abs(F.round(F.col("c_acctbal") * 100)).cast("long")
    slot = F.when(F.col("c_acctbal") >= 9500, "engineer").when(F.col("c_acctbal") < -900, "procurement_head")
    people = t.customer.select((F.col("c_nationkey") * 10 + cents % 10).cast("long").alias("company"), F.col("c_custkey").cast("long").alias("person"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("title"), F.col("c_mktsegment").alias("role"), slot.alias("slot"))
    return team_slots(people, SLOTS).withColumn("person", F.col("person").cast("string"))


#: A large line of a supplier is proof of work, one that came back says that it stopped; of one day the stop counts.
_PROOF_SQL = """proof AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, max(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) AS kind, max(CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) * 10000000000 + arg_max(l_orderkey, (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END) * 10000000000 + l_orderkey) AS code FROM lineitem WHERE l_quantity >= 45 GROUP BY 1, 2)"""


def _proof(t: Tables) -> DataFrame:
    code = F.when(F.col("l_returnflag") == "R", 2).otherwise(1) * F.lit(10_000_000_000) + F.col("l_orderkey")
    return t.lineitem.where("l_quantity >= 45").select("l_suppkey", F.to_date("l_shipdate").alias("day"), code.alias("code"))


@query(f"""WITH {_PROOF_SQL}, l AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT l.l_orderkey, l.l_linenumber, l.l_suppkey, CASE WHEN code IS NULL THEN 'none' WHEN code >= 20000000000 THEN 'stopped' ELSE 'current' END AS state, CASE WHEN code < 20000000000 THEN CAST(code % 10000000000 AS VARCHAR) END AS proof
FROM l ASOF LEFT JOIN proof p ON p.l_suppkey = l.l_suppkey AND l.day >= p.day""")
def current_work(t: Tables) -> DataFrame:
    """For every line, whether its supplier is at work that day: by the newest proof not after it, unless that is a stop."""
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    out = as_of(lines, _proof(t), "l_suppkey", "day", "code", "year")
    code = F.col("code")
    state = F.when(code.isNull(), "none").when(code >= 20_000_000_000, "stopped").otherwise("current")
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", state.alias("state"), F.when(code < 20_000_000_000, (code % 10_000_000_000).cast("string")).alias("proof"))


#: The day of the verdict, months after which work needs a newer proof, months that a proof counts.
TODAY, WINDOW, PROOF_WINDOW = "2001-08-02", 24, 30


@query(f"""WITH {_PROOF_SQL}, w AS (SELECT l_orderkey, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS suppkey FROM lineitem GROUP BY 1
), o AS (SELECT o_orderkey, o_orderstatus, c_mktsegment, suppkey, CAST(o_orderdate AS DATE) AS day, DATE '{TODAY}' AS today, date_diff('day', CAST(o_orderdate AS DATE), DATE '{TODAY}') / 30.4375 AS age FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN w ON l_orderkey = o_orderkey
), p AS (SELECT o.*, code, date_diff('day', p.day, today) / 30.4375 AS proof_age FROM o ASOF LEFT JOIN proof p ON p.l_suppkey = o.suppkey AND o.today >= p.day
), r AS (SELECT o_orderkey, coalesce(code < 20000000000 AND proof_age <= {PROOF_WINDOW}, FALSE) AS working, list_filter([
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 'sells the item' END, CASE WHEN suppkey IS NULL THEN 'nobody does the work' END, CASE WHEN age > {WINDOW} AND NOT coalesce(code < 20000000000 AND proof_age <= {PROOF_WINDOW}, FALSE) THEN 'older than {WINDOW} months' END,
  CASE WHEN age < 0 THEN 'dated in the future' END, CASE WHEN o_orderstatus = 'F' AND NOT coalesce(code < 20000000000 AND proof_age <= {PROOF_WINDOW}, FALSE) THEN 'completed' END], lambda x: x IS NOT NULL) AS why, c_mktsegment FROM p)
SELECT o_orderkey, CASE WHEN len(why) > 0 THEN 'rejected' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'owner' ELSE 'lead' END AS verdict, array_to_string(why, '; ') AS reason, working FROM r""")
def judge_need(t: Tables) -> DataFrame:
    """The verdict on every order's need, with all reasons against it. Old or completed work counts if a proof shows that it goes on."""
    first = t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("l_suppkey"))
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    today = F.lit(TODAY).cast("date")
    # All verdicts are of one day: a supplier's newest proof by then, with its day, is one row.
    proof = _proof(t).where(F.col("day") <= today).groupBy("l_suppkey").agg(F.max(F.struct("day", "code")).alias("p"))
    rows = orders.join(proof, "l_suppkey", "left")
    months = lambda d: F.date_diff(today, d) / 30.4375
    age = months(F.to_date("o_orderdate"))
    working = F.coalesce((F.col("p.code") < 20_000_000_000) & (months(F.col("p.day")) <= PROOF_WINDOW), F.lit(False))
    why = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "FURNITURE", "sells the item"), F.when(F.col("l_suppkey").isNull(), "nobody does the work"), F.when((age > WINDOW) & ~working, f"older than {WINDOW} months"), F.when(age < 0, "dated in the future"), F.when((F.col("o_orderstatus") == "F") & ~working, "completed")))
    verdict = F.when(F.size("why") > 0, "rejected").when(F.col("c_mktsegment") == "HOUSEHOLD", "owner").otherwise("lead")
    return rows.select("o_orderkey", "c_mktsegment", why.alias("why"), working.alias("working")).select("o_orderkey", verdict.alias("verdict"), F.array_join("why", "; ").alias("reason"), "working")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type, value FROM events WHERE event_type <> 'error'), b AS (SELECT c_custkey AS lead, TIMESTAMP '2000-01-01' AS at_, CAST(0 AS BIGINT) AS event, 'new' AS state, c_acctbal AS score FROM customer),
a AS (SELECT user_id AS lead, max(ts) AS at_, arg_max(event_id, (ts, event_id)) AS event, arg_max(event_type, (ts, event_id)) AS state, arg_max(value, (ts, event_id)) AS score FROM e GROUP BY 1)
SELECT lead, at_ AS changed, event, state, score FROM a UNION ALL SELECT lead, at_, event, state, score FROM b WHERE lead NOT IN (SELECT lead FROM a)""")
def lead_table_upserts(t: Tables) -> DataFrame:
    """The lead table after batches of events, one for each kind: one batch comes twice, one inserts only what isn't there."""
    table = Versions(t.spark, f"{shared_folder(t.spark)}/leads-{uuid.uuid4().hex}", "lead long, changed timestamp_ntz, event long, state string, score double", ["lead"], 8)
    first = t.customer.select(F.col("c_custkey").cast("long").alias("lead"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("changed"), F.lit(0).cast("long").alias("event"), F.lit("new").alias("state"), F.col("c_acctbal").alias("score"))
    table.upsert(first, "customers", "changed")
    for kind in ("signup", "view", "click", "view", "purchase"):
        batch = t.events.where(F.col("event_type") == kind).select(F.col("user_id").alias("lead"), F.col("ts").cast("timestamp_ntz").alias("changed"), F.col("event_id").alias("event"), F.col("event_type").alias("state"), F.col("value").alias("score"))
        table.upsert(batch, kind, "changed")
    table.upsert(first.withColumn("state", F.lit("again")), "customers again", "changed", insert_only=True)
    return table.read()


#: What each segment plans to buy: group, item, fit, why, and the months after its newest order.
NEEDS = [
    ("BUILDING", 0, "STANDARD", "good", "Builders start with it", 0, 3), ("BUILDING", 1, "LARGE", "possible", "Later packages", 3, 9), ("BUILDING", 1, "STANDARD", "possible", "Again", 3, 9),
    ("MACHINERY", 0, "MEDIUM", "good", "Makers use it", 1, 6), ("MACHINERY", 1, "ECONOMY", "possible", "Spare parts", 6, 12),
    ("AUTOMOBILE", 0, "SMALL", "good", "Every line has it", 0, 2), ("AUTOMOBILE", 1, "PROMO", "possible", "Trials", 2, 8),
    ("HOUSEHOLD", 0, "PROMO", "possible", "Resale", 0, 12),
]
_BY_TYPE = "SELECT DISTINCT o_custkey AS buyer, p_type AS item FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE "


@query(f"""WITH rules(role, grp, item, fit, why, a, b) AS (VALUES {", ".join(map(str, NEEDS))}), buyers AS (SELECT c_custkey AS buyer, c_mktsegment AS role, day FROM customer LEFT JOIN (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS day FROM orders GROUP BY 1) ON o_custkey = c_custkey
), plan AS (SELECT buyer, item, arg_min(fit, grp) AS fit, arg_min(why, grp) AS why, min(grp) AS grp, arg_min(a, grp) AS a, arg_min(b, grp) AS b FROM buyers JOIN rules USING (role) GROUP BY 1, 2
), opening AS (SELECT role, arg_min(a, grp) AS oa, arg_min(b, grp) AS ob FROM rules GROUP BY 1), said AS ({_BY_TYPE} l_quantity >= 49), own AS ({_BY_TYPE} l_quantity >= 48 AND l_returnflag = 'R'
), every AS (SELECT buyer, item FROM plan UNION SELECT buyer, item FROM said UNION SELECT buyer, item FROM own
), r AS (SELECT e.buyer, e.item, day, p.item IS NOT NULL AS planned, s.item IS NOT NULL AS named, o.item IS NOT NULL AS made, p.fit AS pfit, p.why AS pwhy, p.grp AS pgrp, a, b, oa, ob FROM every e JOIN buyers USING (buyer) LEFT JOIN plan p ON p.buyer = e.buyer AND p.item = e.item LEFT JOIN said s ON s.buyer = e.buyer AND s.item = e.item
  LEFT JOIN own o ON o.buyer = e.buyer AND o.item = e.item LEFT JOIN opening USING (role)
), f AS (SELECT buyer, item, CASE WHEN made THEN 'competitor' WHEN named THEN 'good' ELSE pfit END AS fit, CASE WHEN made THEN 'They make it' WHEN planned AND named THEN pwhy || ', named in the source' WHEN planned THEN pwhy ELSE 'Named in the source' END AS why,
  CASE WHEN planned THEN a WHEN named AND NOT made THEN oa END AS first, CASE WHEN planned THEN b WHEN named AND NOT made THEN ob END AS last, coalesce(pgrp, CASE WHEN made OR oa IS NULL THEN 99 ELSE 0 END) AS grp, day FROM r)
SELECT buyer, item, fit, why, CAST(CAST(day + to_months(CAST(first AS INT)) AS DATE) AS VARCHAR) AS opens, CAST(CAST(day + to_months(CAST(last AS INT)) AS DATE) AS VARCHAR) AS closes, row_number() OVER (PARTITION BY buyer ORDER BY CASE fit WHEN 'good' THEN 1 WHEN 'possible' THEN 2 ELSE 3 END, grp, item) AS place FROM f""")
def items_to_sell(t: Tables) -> DataFrame:
    """What to sell to every customer: its segment's needs, what its large lines name, and what it makes itself."""
    rules = t.spark.createDataFrame(NEEDS, "role string, grp int, item string, fit string, why string, first int, last int")
    newest = t.orders.groupBy(F.col("o_custkey").alias("buyer")).agg(F.to_date(F.max("o_orderdate")).alias("trigger"))
    buyers = t.customer.select(F.col("c_custkey").alias("buyer"), F.col("c_mktsegment").alias("role")).join(newest, "buyer", "left")
    lines = t.lineitem.where("l_quantity >= 48").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("buyer"), F.col("p_type").alias("item"), "l_quantity", "l_returnflag")
    out = sell_items(buyers, rules, lines.where("l_quantity >= 49"), lines.where("l_returnflag = 'R'"))
    return out.withColumns({"opens": F.col("opens").cast("string"), "closes": F.col("closes").cast("string")})
