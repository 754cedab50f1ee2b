"""Buyer records over the star schema and the searches on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.operators.buyers import DIMENSIONS, BuyerSearch, ordered, representatives
from leadlens.operators.tables import TableQuery
from leadlens.registry import Tables, query

ROLES = {"BUILDING": "epc_contractor", "MACHINERY": "manufacturer", "AUTOMOBILE": "owner", "HOUSEHOLD": "distributor"}
ROLE_SQL = "CASE c_mktsegment WHEN 'BUILDING' THEN 'epc_contractor' WHEN 'MACHINERY' THEN 'manufacturer' WHEN 'AUTOMOBILE' THEN 'owner' WHEN 'HOUSEHOLD' THEN 'distributor' ELSE 'fabricator' END"

RECORDS_SQL = f"""o AS (SELECT o_custkey, max(o_totalprice) AS value, CAST(max(o_orderdate) AS DATE) AS trigger_date, CAST(min(o_orderdate) AS DATE) AS created, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS trigger_kind, list_sort(list(DISTINCT o_orderstatus)) AS signals, count(*) AS slots FROM orders GROUP BY 1),
i AS (SELECT o_custkey, list_sort(list(DISTINCT p_type)) AS items FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1), v AS (SELECT user_id, count(*) AS found FROM events GROUP BY 1),
records AS (SELECT c_custkey AS company_id, c_name AS name, n_name AS country, r_name AS region, {ROLE_SQL} AS role, CASE WHEN c_acctbal < 0 THEN 'not_buyer' WHEN c_acctbal < 3000 THEN 'watch' WHEN c_acctbal < 7000 THEN 'potential' ELSE 'high' END AS stage,
  CAST(greatest(0, floor(c_acctbal / 100)) AS BIGINT) AS fit, CASE c_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS how_sure, CAST(c_custkey % 3 + 1 AS INTEGER) AS tier, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'likely' ELSE 'possible' END AS link,
  CASE c_custkey % 5 WHEN 0 THEN 'allowed' WHEN 1 THEN 'blocked' ELSE 'consent_needed' END AS reach, lower(c_mktsegment) AS industry, value, created, trigger_kind, trigger_date, CASE c_custkey % 4 WHEN 3 THEN NULL ELSE trigger_date + CAST(c_custkey % 200 AS INTEGER) END AS window_from,
  coalesce(items, []) AS items, coalesce(signals, []) AS signals, coalesce(found, 0) AS found, coalesce(slots, 0) AS slots, c_custkey % 11 = 0 AS rejected
  FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN i ON i.o_custkey = c_custkey LEFT JOIN v ON user_id = c_custkey)"""


def records(t: Tables) -> DataFrame:
    """One record a customer; orders, lines and events are summed up by customer before they are joined."""
    at = F.struct("o_orderdate", "o_orderkey")
    deals = t.orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("value"), F.to_date(F.max("o_orderdate")).alias("trigger_date"), F.to_date(F.min("o_orderdate")).alias("created"), F.max_by("o_orderstatus", at).alias("trigger_kind"), F.array_sort(F.collect_set("o_orderstatus")).alias("signals"), F.count("*").alias("slots"))
    lines = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    items = lines.groupBy("o_custkey").agg(F.array_sort(F.collect_set("p_type")).alias("items"))
    seen = t.events.groupBy(F.col("user_id").alias("o_custkey")).agg(F.count("*").alias("found"))
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    rows = t.customer.withColumn("o_custkey", F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(deals, "o_custkey", "left").join(items, "o_custkey", "left").join(seen, "o_custkey", "left")
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    role = F.lit("fabricator")
    for segment, name in ROLES.items():
        role = F.when(F.col("c_mktsegment") == segment, name).otherwise(role)
    none = F.array().cast("array<string>")
    return rows.select(
        key.alias("company_id"), F.col("c_name").alias("name"), F.col("n_name").alias("country"), F.col("r_name").alias("region"), role.alias("role"),
        F.when(balance < 0, "not_buyer").when(balance < 3000, "watch").when(balance < 7000, "potential").otherwise("high").alias("stage"),
        F.greatest(F.lit(0), F.floor(balance / 100)).cast("long").alias("fit"),
        F.when(key % 3 == 0, "high").when(key % 3 == 1, "medium").otherwise("low").alias("how_sure"), (key % 3 + 1).cast("int").alias("tier"),
        F.when(key % 4 == 0, "confirmed").when(key % 4 == 1, "likely").otherwise("possible").alias("link"), F.when(key % 5 == 0, "allowed").when(key % 5 == 1, "blocked").otherwise("consent_needed").alias("reach"),
        F.lower("c_mktsegment").alias("industry"), "value", "created", "trigger_kind", "trigger_date", F.when(key % 4 != 3, F.date_add("trigger_date", (key % 200).cast("int"))).alias("window_from"),
        F.coalesce("items", none).alias("items"), F.coalesce("signals", none).alias("signals"), F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("slots", F.lit(0)).alias("slots"), (key % 11 == 0).alias("rejected"),
    )


LIKE = {"company_id": 1, "role": "epc_contractor", "country": None, "industry": "building", "items": ["PROMO", "STANDARD"]}
#: One search for each dimension, and what it says in SQL.
SEARCHES = {
    "location": (BuyerSearch(places=("ASIA",), not_places=("INDIA",)), "coalesce(country = 'ASIA' OR region = 'ASIA', FALSE) AND NOT coalesce(country = 'INDIA' OR region = 'INDIA', FALSE)"),
    "roles": (BuyerSearch(roles=("owner", "manufacturer")), "role IN ('owner', 'manufacturer')"),
    "sell": (BuyerSearch(items=("ECONOMY", "SMALL")), "list_has_any(items, ['ECONOMY', 'SMALL'])"),
    "signals": (BuyerSearch(signals=("P",), signal_days=400), "list_contains(signals, 'P') AND coalesce(datediff('day', coalesce(trigger_date, created), DATE '2001-08-02') <= 400, FALSE)"),
    "contacts": (BuyerSearch(with_contacts=True, least_slots=5), "found > 0 AND slots >= 5"),
    "industry": (BuyerSearch(industries=("building",)), "industry = 'building'"),
    "value": (BuyerSearch(least_value=100_000, most_value=400_000), "coalesce(value >= 100000 AND value <= 400000, FALSE)"),
    "lookalike": (BuyerSearch(like=LIKE), "CASE WHEN role = 'epc_contractor' THEN 3 ELSE 0 END + len(list_intersect(items, ['PROMO', 'STANDARD'])) + CASE WHEN industry = 'building' THEN 1 ELSE 0 END >= 4 AND company_id <> 1"),
    "companyList": (BuyerSearch(companies=("000001", " 77")), "contains(lower(name), '000001') OR contains(lower(name), '77')"),
    "reach": (BuyerSearch(reach=("allowed",)), "reach = 'allowed'"),
    "stage": (BuyerSearch(), "stage <> 'not_buyer' AND NOT rejected"),
    "minFit": (BuyerSearch(least_fit=40), "fit >= 40"),
    "howSure": (BuyerSearch(how_sure=("high", "medium")), "how_sure IN ('high', 'medium')"),
    "q": (BuyerSearch(text="Customer owner"), "contains(lower(concat_ws(chr(10), name, role, country, array_to_string(items, ' '))), 'customer') AND contains(lower(concat_ws(chr(10), name, role, country, array_to_string(items, ' '))), 'owner')"),
    "tiers": (BuyerSearch(tiers=(1, 3)), "tier IN (1, 3)"),
    "linkStatus": (BuyerSearch(links=("likely",)), "link = 'likely'"),
    "triggers": (BuyerSearch(triggers=("O", "P"), trigger_days=365), "trigger_kind IN ('O', 'P') AND coalesce(datediff('day', trigger_date, DATE '2001-08-02') BETWEEN 0 AND 365, FALSE)"),
}


@query(f"WITH {RECORDS_SQL} SELECT company_id, " + " || ".join(f"CASE WHEN {SEARCHES[d][1]} THEN '1' ELSE '0' END" for d in DIMENSIONS) + " AS passes FROM records")
def supersearch_filter(t: Tables) -> DataFrame:
    """Which of 17 searches, one for each dimension, every buyer passes."""
    flags = [F.when(F.coalesce(SEARCHES[d][0].conditions()[d], F.lit(False)), "1").otherwise("0") for d in DIMENSIONS]
    return records(t).select("company_id", F.concat(*flags).alias("passes"))


ASKED = BuyerSearch(places=("ASIA", "EUROPE"), not_roles=("distributor",), least_value=50_000, least_fit=10, tiers=(1, 2))
ASKED_SQL = {"location": "region IN ('ASIA', 'EUROPE')", "roles": "role <> 'distributor'", "value": "coalesce(value >= 50000, FALSE)", "stage": "stage <> 'not_buyer' AND NOT rejected", "minFit": "fit >= 10", "tiers": "tier IN (1, 2)"}


def _asked_sql(omit: str | None = None) -> str:
    return " AND ".join(f"({c})" for d, c in ASKED_SQL.items() if d != omit)


@query(f"WITH {RECORDS_SQL} SELECT 'roles' AS dim, role AS value, count(*) AS n FROM records WHERE {_asked_sql('roles')} GROUP BY 2 UNION ALL SELECT 'location', country, count(*) FROM records WHERE {_asked_sql('location')} AND country IS NOT NULL GROUP BY 2 UNION ALL SELECT 'tiers', CAST(tier AS VARCHAR), count(*) FROM records WHERE {_asked_sql('tiers')} GROUP BY 2")
def buyer_facets(t: Tables) -> DataFrame:
    """Counts of a dimension's values among the buyers that pass all other conditions: one pass, a row with a flag for each."""
    cond = {d: F.coalesce(c, F.lit(False)) for d, c in ASKED.conditions().items()}
    cells = []
    for dim, column in (("roles", "role"), ("location", "country"), ("tiers", "tier")):
        others = F.lit(True)
        for d, c in cond.items():
            others = others if d == dim else others & c
        cells.append(F.struct(F.lit(dim).alias("dim"), F.col(column).cast("string").alias("value"), others.alias("keep")))
    rows = records(t).select(F.explode(F.array(*cells)).alias("x")).where("x.keep and x.value is not null")
    return rows.groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS_SQL}, f AS (SELECT * FROM records WHERE {_asked_sql()}), w AS (SELECT *, CASE WHEN window_from IS NULL THEN '9999' WHEN window_from <= DATE '2001-08-02' THEN '0000' ELSE CAST(window_from AS VARCHAR) END AS win FROM f)
SELECT sort, company_id FROM (SELECT 'fit' AS sort, company_id, row_number() OVER (ORDER BY fit DESC, coalesce(trigger_date, created) DESC, company_id) AS r FROM f UNION ALL SELECT 'window', company_id, row_number() OVER (ORDER BY win, fit DESC, company_id) FROM w
UNION ALL SELECT 'latest', company_id, row_number() OVER (ORDER BY coalesce(trigger_date, created) DESC, fit DESC, company_id) FROM f) WHERE r <= 25""")
def sort_buyers(t: Tables) -> DataFrame:
    """The first page of a search in each order: by fit, by the window that is open or opens next, by the latest trigger."""
    found = ASKED.apply(records(t))
    pages = [found.orderBy(*ordered(found, by, ASKED)).limit(25).select(F.lit(by).alias("sort"), "company_id") for by in ("fit", "window", "latest")]
    return pages[0].union(pages[1]).union(pages[2])


@query(f"""WITH {RECORDS_SQL}, f AS (SELECT * FROM records WHERE {_asked_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY fit DESC, trigger_date DESC, company_id) AS best, count(*) OVER (PARTITION BY country) AS deals FROM f WHERE country IS NOT NULL AND trigger_date IS NOT NULL)
SELECT country, company_id, fit, deals FROM r WHERE best = 1""")
def representatives_by_place(t: Tables) -> DataFrame:
    """The strongest buyer of each place with the number of those that it stands for."""
    found = ASKED.apply(records(t)).where("country is not null and trigger_date is not null")
    return representatives(found, "country").select("country", "company_id", "fit", "deals")


@query(f"""WITH {RECORDS_SQL}, f AS (SELECT * FROM records WHERE role = 'owner' AND trigger_kind = 'O' AND coalesce(datediff('day', trigger_date, DATE '2001-08-02') BETWEEN 0 AND 365, FALSE) AND contains(lower(name), 'customer') AND found = 0 AND NOT rejected)
SELECT company_id, fit, value FROM f ORDER BY value DESC NULLS LAST, company_id LIMIT 25""")
def table_filter(t: Tables) -> DataFrame:
    """A table of leads by role, trigger, age, text and missing contacts, by value, one page."""
    asked = BuyerSearch(roles=("owner",), triggers=("O",), trigger_days=365, text="customer", stages=("not_buyer", "watch", "potential", "high"))
    rows = asked.apply(records(t)).where("found = 0 and not rejected")
    return rows.orderBy(F.desc_nulls_last("value"), "company_id").limit(25).select("company_id", "fit", "value")


@query(f"""WITH {RECORDS_SQL}, e AS (SELECT l_orderkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS flags FROM lineitem GROUP BY 1)
SELECT o_orderkey AS lead_id, name, country, role, stage, coalesce(lines, 0) AS lines, coalesce(suppliers, 0) AS suppliers, coalesce(quantity, 0) AS quantity, coalesce(flags, '') AS flags, slots - 1 AS other_leads, found FROM orders JOIN records ON company_id = o_custkey LEFT JOIN e ON l_orderkey = o_orderkey""")
def lead_detail(t: Tables) -> DataFrame:
    """All that is known of each lead in one row: the buyer, what was ordered from how many, its other leads and contacts."""
    lines = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_distinct("l_suppkey").alias("suppliers"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))
    rows = t.orders.select(F.col("o_orderkey").alias("lead_id"), F.col("o_custkey").alias("company_id")).join(records(t), "company_id").join(lines, F.col("lead_id") == F.col("l_orderkey"), "left")
    zero = lambda c, z=0: F.coalesce(c, F.lit(z)).alias(c)
    return rows.select("lead_id", "name", "country", "role", "stage", zero("lines"), zero("suppliers"), zero("quantity", 0.0), zero("flags", ""), (F.col("slots") - 1).alias("other_leads"), "found")


#: Records with what the table of leads asks for beside them.
_TABLE_SQL = f"""{RECORDS_SQL}, x AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS contact_roles, bool_or(event_type = 'purchase' AND value >= 400) AS validated FROM events GROUP BY 1
), rows_ AS (SELECT r.*, CASE WHEN r.rejected THEN 'rejected' WHEN r.fit >= 50 THEN 'approved' ELSE 'open' END AS qualification, industry AS keyword, concat_ws(' ', role, region) AS what, coalesce(contact_roles, []) AS contact_roles, coalesce(validated, FALSE) AS validated,
  CASE WHEN trigger_date IS NULL THEN 'none' WHEN datediff('day', trigger_date, DATE '2001-08-02') <= 90 THEN 'recent' WHEN datediff('day', trigger_date, DATE '2001-08-02') <= 365 THEN 'ongoing' ELSE 'past' END AS activity FROM records r LEFT JOIN x ON x.user_id = company_id)"""
#: A query for each predicate, and what it says in SQL.
TABLE_QUERIES = {
    "qualification": (TableQuery(qualification="rejected"), "qualification = 'rejected'"),
    "default": (TableQuery(), "qualification <> 'rejected'"),
    "country": (TableQuery(show_rejected=True, country="INDIA"), "country = 'INDIA'"),
    "role": (TableQuery(show_rejected=True, role="owner"), "role = 'owner'"),
    "trigger": (TableQuery(show_rejected=True, trigger="O"), "trigger_kind = 'O'"),
    "age": (TableQuery(show_rejected=True, age="180"), "datediff('day', trigger_date, DATE '2001-08-02') BETWEEN 0 AND 180"),
    "undated": (TableQuery(show_rejected=True, age="undated"), "trigger_date IS NULL"),
    "fit": (TableQuery(show_rejected=True, fit="potential"), "stage = 'potential'"),
    "product": (TableQuery(show_rejected=True, product="PROMO"), "list_contains(items, 'PROMO')"),
    "keyword": (TableQuery(show_rejected=True, keyword="BUILD"), "contains(lower(keyword), 'build')"),
    "text": (TableQuery(show_rejected=True, text="Owner Asia"), "contains(lower(concat_ws(' ', name, what, trigger_kind)), 'owner asia')"),
    "company": (TableQuery(show_rejected=True, company=77), "company_id = 77"),
    "contact_role": (TableQuery(show_rejected=True, contact_role="click"), "list_contains(contact_roles, 'click')"),
    "missing": (TableQuery(show_rejected=True, contacts="missing"), "found = 0"),
    "validated": (TableQuery(show_rejected=True, contacts="validated"), "validated"),
    "active": (TableQuery(show_rejected=True, activity="active"), "activity IN ('recent', 'ongoing')"),
}


def table_rows(t: Tables) -> DataFrame:
    """The records as the table of leads has them."""
    seen = t.events.groupBy(F.col("user_id").alias("company_id")).agg(F.array_sort(F.collect_set("event_type")).alias("contact_roles"), F.bool_or((F.col("event_type") == "purchase") & (F.col("value") >= 400)).alias("validated"))
    age = F.date_diff(F.lit("2001-08-02").cast("date"), "trigger_date")
    activity = F.when(age.isNull(), "none").when(age <= 90, "recent").when(age <= 365, "ongoing").otherwise("past")
    qualification = F.when(F.col("rejected"), "rejected").when(F.col("fit") >= 50, "approved").otherwise("open")
    rows = records(t).join(seen, "company_id", "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"qualification": qualification, "keyword": F.col("industry"), "what": F.concat_ws(" ", "role", "region"), "contact_roles": F.coalesce("contact_roles", none), "validated": F.coalesce("validated", F.lit(False)), "activity": activity})


@query(f"WITH {_TABLE_SQL} SELECT company_id, " + " || ".join(f"CASE WHEN coalesce({sql}, FALSE) THEN '1' ELSE '0' END" for _, sql in TABLE_QUERIES.values()) + " AS passes FROM rows_")
def table_predicates(t: Tables) -> DataFrame:
    """Which of the table's predicates each record passes, one digit each."""
    return table_rows(t).select("company_id", F.concat(*(F.when(q.test(), "1").otherwise("0") for q, _ in TABLE_QUERIES.values())).alias("passes"))


@query(f"""WITH {_TABLE_SQL}, f AS (SELECT * FROM rows_ WHERE qualification <> 'rejected' AND role = 'owner' AND list_contains(items, 'PROMO') AND found > 0 AND activity IN ('recent', 'ongoing'))
SELECT company_id, name, value, (SELECT count(*) FROM f) AS total FROM f ORDER BY value DESC NULLS LAST, company_id LIMIT 10 OFFSET 10""")
def table_page(t: Tables) -> DataFrame:
    """The second page of active owners with contacts, by value, and how many there are."""
    asked = TableQuery(role="owner", product="PROMO", contacts="found", activity="active")
    return asked.page(table_rows(t), "value", True, 2, 10).select("company_id", "name", "value", "total")
