"""Filters, joins, aggregates, windows, sorts, pages and set operations over the lead relations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.operators import filters as fl
from leadlens.operators import ranking as rk
from leadlens.operators.filters import LeadFilter
from leadlens.plans.carriers import AS_OF, LEADS_SQL, leads
from leadlens.registry import Tables, query
from leadlens.sources import sinks

WITH = f"WITH {LEADS_SQL}"
SHOWN = ["lead_id", "buyer", "segment", "place", "status", "score", "created"]
OPEN = LeadFilter(one_of={"status": ("O", "P")}, min_score=10)


@query(f"{WITH} SELECT lead_id, buyer, segment, place, status, score, created FROM leads WHERE status IN ('O', 'P') AND score >= 10 ORDER BY created DESC, score DESC, lead_id LIMIT 50 OFFSET 50")
def lead_list_latest(t: Tables) -> DataFrame:
    rows = OPEN.apply(leads(t)).orderBy(F.desc("created"), F.desc_nulls_last("score"), "lead_id")
    return fl.page(rows, 50, 50).select(SHOWN)


@query(f"{WITH} SELECT lead_id, buyer, segment, place, status, score, created FROM leads WHERE status IN ('O', 'P') AND score >= 10 AND segment = 'BUILDING' ORDER BY score DESC, created DESC, lead_id LIMIT 50")
def lead_list_score(t: Tables) -> DataFrame:
    rows = LeadFilter(equal={"segment": "BUILDING"}, one_of=OPEN.one_of, min_score=10).apply(leads(t))
    return fl.page(rows.orderBy(F.desc_nulls_last("score"), F.desc("created"), "lead_id"), 50).select(SHOWN)


@query(f"""{WITH}, c AS (SELECT l_orderkey, max(l_shipdate) AS closing FROM lineitem GROUP BY 1)
SELECT lead_id, closing, score FROM leads LEFT JOIN c ON l_orderkey = lead_id
ORDER BY closing IS NULL, closing < TIMESTAMP '2001-08-02', closing, score DESC, lead_id LIMIT 100""")
def lead_list_closing(t: Tables) -> DataFrame:
    closing = t.lineitem.groupBy(F.col("l_orderkey").alias("lead_id")).agg(F.max("l_shipdate").alias("closing"))
    rows = leads(t).join(closing, "lead_id", "left")
    past = F.col("closing") < F.lit(AS_OF).cast("timestamp_ntz")
    return rows.orderBy(F.col("closing").isNull(), past, F.asc_nulls_last("closing"), F.desc_nulls_last("score"), "lead_id").limit(100).select("lead_id", "closing", "score")


@query(f"{WITH} SELECT lead_id, buyer, place FROM leads WHERE contains(lower(buyer), '#00000001') OR contains(lower(place), 'an')")
def lead_text_search(t: Tables) -> DataFrame:
    place = LeadFilter(text="an", text_columns=("place",)).predicates()[0]
    buyer = LeadFilter(text="#00000001", text_columns=("buyer",)).predicates()[0]
    return leads(t).where(buyer | place).select("lead_id", "buyer", "place")


@query(r"SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%e\_%' ESCAPE '\' OR p_name ILIKE '%re%' ESCAPE '\'")
def like_escape(t: Tables) -> DataFrame:
    return t.part.where(fl.contains_text("p_name", "e_") | fl.contains_text("p_name", "re")).select("p_partkey", "p_name")


@query(f"{WITH} SELECT lead_id, created FROM leads WHERE created >= TIMESTAMP '2001-07-26'")
def leads_added_7d(t: Tables) -> DataFrame:
    as_of = AS_OF
    rows = LeadFilter(added="7d", as_of=as_of).predicates()[0]
    return leads(t).where(rows).select("lead_id", "created")


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS priorities FROM orders GROUP BY 1 HAVING list_has_any(list(o_orderpriority), ['1-URGENT', '2-HIGH'])")
def array_overlap_filter(t: Tables) -> DataFrame:
    rows = t.orders.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("priorities"))
    return rows.where(fl.overlaps("priorities", ["1-URGENT", "2-HIGH"]))


@query("""SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)""")
def in_list(t: Tables) -> DataFrame:
    rich = t.customer.where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.where(F.col("o_orderstatus").isin("O", "F")).join(rich, "o_custkey", "left_semi").select("o_custkey", "o_orderkey")


@query("""SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND nullif(a.o_orderpriority, '5-LOW') IS NOT DISTINCT FROM nullif(b.o_orderpriority, '5-LOW')
AND a.o_orderdate = b.o_orderdate AND a.o_orderkey < b.o_orderkey""")
def null_safe_eq(t: Tables) -> DataFrame:
    key = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.expr("nullif(o_orderpriority, '5-LOW')").alias("p"))
    a, b = key.alias("a"), key.alias("b")
    on = (F.col("a.o_custkey") == F.col("b.o_custkey")) & F.col("a.p").eqNullSafe(F.col("b.p")) & (F.col("a.o_orderdate") == F.col("b.o_orderdate")) & (F.col("a.o_orderkey") < F.col("b.o_orderkey"))
    return a.join(b, on).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query(r"SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '\b(red|green|small|large)\b', 'i')")
def regex_filter(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_name").rlike(r"(?i)\b(red|green|small|large)\b")).select("p_partkey", "p_name")


@query("""SELECT s_suppkey, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_discount > 0.08) THEN 'distributor'
WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 49) THEN 'fabricator' ELSE 'manufacturer' END AS role FROM supplier""")
def case_map(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.bool_or(F.expr("l_returnflag = 'R' AND l_discount > 0.08")).alias("returned"), F.bool_or(F.expr("l_quantity >= 49")).alias("large"))
    role = F.when(F.col("returned"), "distributor").when(F.col("large"), "fabricator").otherwise("manufacturer")
    return t.supplier.join(flags, "s_suppkey", "left").select("s_suppkey", role.alias("role"))


@query("""WITH p AS (SELECT o_orderkey, min(p_type) FILTER (WHERE l_linenumber = 1) AS first_type FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT coalesce(first_type, 'none') AS dim, count(*) AS n FROM p GROUP BY 1""")
def coalesce_dim(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_linenumber = 1").join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("p_type").alias("first_type"))
    return t.orders.join(lines, "o_orderkey", "left").groupBy(F.coalesce("first_type", F.lit("none")).alias("dim")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE lower(n_name) = 'nation_3' OR (length('ion_1') >= 3 AND contains(lower(n_name), 'ion_1')) OR CAST(n_nationkey AS VARCHAR) = '7'")
def location_match(t: Tables) -> DataFrame:
    wanted = F.lower("n_name")
    hit = (wanted == "nation_3") | F.contains(wanted, F.lit("ion_1")) | (F.col("n_nationkey").cast("string") == "7")
    return t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).where(hit).select("c_custkey", "c_nationkey")


FACET_DIMS = ["segment", "place", "status", "priority"]
FACET_FILTER = LeadFilter(equal={"segment": "BUILDING", "priority": "1-URGENT"}, one_of={"status": ("O", "P")}, min_score=5)


@query(f"{WITH}, b AS (SELECT * FROM leads WHERE score >= 5), " + """s AS (SELECT *, segment = 'BUILDING' AS s1, priority = '1-URGENT' AS s2, status IN ('O', 'P') AS s3 FROM b)
SELECT 'segment' AS dim, segment AS value, count(*) AS n FROM s WHERE s2 AND s3 GROUP BY segment
UNION ALL SELECT 'place', place, count(*) FROM s WHERE s1 AND s2 AND s3 AND place IS NOT NULL GROUP BY place
UNION ALL SELECT 'status', status, count(*) FROM s WHERE s1 AND s2 GROUP BY status
UNION ALL SELECT 'priority', priority, count(*) FROM s WHERE s1 AND s3 GROUP BY priority""")
def lead_facets(t: Tables) -> DataFrame:
    return fl.facets(leads(t), FACET_FILTER, FACET_DIMS)


@query("""SELECT count(*) AS leads, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-26') AS last_7d, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2001-07-03') AS last_30d,
count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE closing >= TIMESTAMP '2001-08-02' AND closing < TIMESTAMP '2001-08-16') AS closing_14d,
count(DISTINCT o_custkey) AS buyers FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS closing FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def overview_kpis(t: Tables) -> DataFrame:
    closing = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("closing"))
    day = lambda n: F.lit(AS_OF + dt.timedelta(days=n))
    return t.orders.join(closing, "o_orderkey", "left").agg(
        F.count("*").alias("leads"),
        F.count_if(F.col("o_orderdate") >= day(-7)).alias("last_7d"),
        F.count_if(F.col("o_orderdate") >= day(-30)).alias("last_30d"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.count_if((F.col("closing") >= day(0)) & (F.col("closing") < day(14))).alias("closing_14d"),
        F.count_distinct("o_custkey").alias("buyers"),
    )


@query("SELECT p_type AS product, count(*) AS n FROM (SELECT l_orderkey, unnest(list(DISTINCT p_type)) AS p_type FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) GROUP BY 1")
def product_facet(t: Tables) -> DataFrame:
    sets = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_type").alias("products"))
    return sets.select(F.explode("products").alias("product")).groupBy("product").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS class, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, class")
def group_count(t: Tables) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_returnflag").alias("class")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "class")


@query("""SELECT id FROM (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS id FROM events) WHERE id IS NOT NULL UNION SELECT l_orderkey FROM lineitem WHERE l_quantity > 49""")
def evidence_refs(t: Tables) -> DataFrame:
    named = t.events.select(F.get_json_object("props", "$.k").cast("long").alias("id")).where("id is not null")
    return named.union(t.lineitem.where("l_quantity > 49").select("l_orderkey")).distinct()


@query("""SELECT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size = 7 UNION SELECT l_orderkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 0
UNION SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""")
def touched_projects(t: Tables) -> DataFrame:
    by_part = t.lineitem.join(t.part.where("p_size = 7"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("id"))
    by_supplier = t.lineitem.join(t.supplier.where("s_acctbal < 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey")
    by_event = t.orders.join(t.events.where("event_type = 'purchase'"), F.col("o_custkey") == F.col("user_id"), "left_semi").select("o_orderkey")
    by_state = t.orders.where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'").select("o_orderkey")
    return by_part.union(by_supplier).union(by_event).union(by_state).distinct()


@query("""SELECT c_nationkey, c_custkey, rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank
FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)) WHERE rank <= 3""")
def not_contacted_topk(t: Tables) -> DataFrame:
    fresh = t.customer.join(t.events, F.col("c_custkey") == F.col("user_id"), "left_anti")
    return rk.top_per(fresh, ["c_nationkey"], 3, F.desc("c_acctbal"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_event_per_user(t: Tables) -> DataFrame:
    return rk.first_per(t.events, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1""")
def thread_stats(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.max_by("text", "turn").alias("last_text"))


@query("""SELECT c_custkey, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS orders, (SELECT min(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer""")
def correlated_scalar(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.min("o_orderdate").alias("first_order"))
    return t.customer.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), "first_order")


@query("""SELECT DISTINCT o_orderkey FROM orders JOIN (SELECT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey WHERE l_partkey IN (1, 2, 3, 5, 8, 13, 21) OR o_custkey IN (1, 2, 4)""")
def nested_loop_or_join(t: Tables) -> DataFrame:
    """A containment or key condition as two equi-joins and a union, never a loop over pairs."""
    lines = t.lineitem.select("l_orderkey", "l_partkey")
    by_part = lines.where(F.col("l_partkey").isin(1, 2, 3, 5, 8, 13, 21)).select(F.col("l_orderkey").alias("o_orderkey")).join(t.orders, "o_orderkey", "left_semi")
    by_buyer = t.orders.where(F.col("o_custkey").isin(1, 2, 4)).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")
    return by_part.union(by_buyer).distinct()


@query("""WITH b AS (SELECT o_custkey, bool_or(o_orderstatus = 'F') AS verified FROM orders GROUP BY 1)
SELECT c_nationkey, count(*) AS buyers, count(*) FILTER (WHERE verified) AS verified FROM b JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def nested_verified(t: Tables) -> DataFrame:
    per = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("verified"))
    return per.join(t.customer, "c_custkey").groupBy("c_nationkey").agg(F.count("*").alias("buyers"), F.count_if("verified").alias("verified"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, min(o_orderdate) AS first, max(o_orderdate) AS last, max(o_totalprice) AS top FROM orders GROUP BY 1")
def min_max_agg(t: Tables) -> DataFrame:
    month = F.date_format("o_orderdate", "yyyy-MM")
    return t.orders.groupBy(month.alias("month")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.max("o_totalprice").alias("top"))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS threads, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("threads"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R')) AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_returnflag = 'R') > 0")
def collect_set_agg(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"))


@query("""SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1""")
def json_agg(t: Tables) -> DataFrame:
    one = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.concat_ws(":", x.o_orderkey.cast("string"), x.o_orderstatus))
    return t.orders.groupBy("o_custkey").agg(F.array_join(one, ",").alias("orders"))


@query("""SELECT o_custkey, o_orderkey, deals FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS deals,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F' DESC, o_totalprice DESC, o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def group_rep(t: Tables) -> DataFrame:
    """One aggregate finds both the representative and the number of deals, without a sort of each group."""
    best = F.max_by(F.col("o_orderkey"), F.struct((F.col("o_orderstatus") != "F").alias("a"), "o_totalprice", "o_orderdate", (-F.col("o_orderkey")).alias("k")))
    return t.orders.groupBy("o_custkey").agg(best.alias("o_orderkey"), F.count("*").alias("deals"))


@query("SELECT lang, count(*) AS docs, count(DISTINCT source) AS sources, CAST(least(100, 16 * count(DISTINCT source) + 8 * count(DISTINCT lang)) AS BIGINT) AS diversity FROM documents GROUP BY 1")
def coverage_agg(t: Tables) -> DataFrame:
    sources = F.count_distinct("source")
    return t.documents.groupBy("lang").agg(F.count("*").alias("docs"), sources.alias("sources"), F.least(F.lit(100), 16 * sources + 8 * F.count_distinct("lang")).cast("long").alias("diversity"))


@query("SELECT s_nationkey, s_suppkey, turn FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier) ORDER BY turn, s_nationkey LIMIT 40")
def round_robin(t: Tables) -> DataFrame:
    rows = rk.interleave(t.supplier, "s_nationkey", F.desc("s_acctbal"), F.col("s_suppkey"))
    return rows.orderBy("turn", "s_nationkey").limit(40).select("s_nationkey", "s_suppkey", "turn")


@query("""SELECT user_id, CAST(run AS BIGINT) AS run, event_type, count(*) AS n FROM (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w
OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2, 3""")
def run_length_collapse(t: Tables) -> DataFrame:
    return rk.run_lengths(t.events, ["user_id"], "event_type", F.col("ts"), F.col("event_id"))


@query("SELECT o_custkey, o_orderkey, o_totalprice - before AS delta, r AS place FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 20")
def score_history(t: Tables) -> DataFrame:
    """The 20 newest values of each lead with the change from the one before, which may be older than the 20."""
    before = F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = t.orders.withColumn("before", before)
    last = rk.top_per(rows, ["o_custkey"], 20, F.desc("o_orderdate"), F.desc("o_orderkey"), rank="place")
    return last.select("o_custkey", "o_orderkey", (F.col("o_totalprice") - F.col("before")).alias("delta"), "place")


@query("SELECT event_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500")
def cursor_page(t: Tables) -> DataFrame:
    return fl.keyset(t.events, "event_id", 100).select("event_id", "event_type")


@query("SELECT s_suppkey, coalesce(v, CAST('-infinity' AS DOUBLE)) AS v FROM (SELECT s_suppkey, max(l_extendedprice) FILTER (WHERE l_discount = 0.1) AS v FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) ORDER BY v DESC, s_suppkey LIMIT 20")
def sort_table_missing_last(t: Tables) -> DataFrame:
    v = t.lineitem.where("l_discount = 0.1").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("v"))
    return t.supplier.join(v, "s_suppkey", "left").select("s_suppkey", F.coalesce("v", F.lit(float("-inf"))).alias("v")).orderBy(F.desc("v"), "s_suppkey").limit(20)


@query(f"{WITH} SELECT lead_id, status, value FROM leads ORDER BY CASE status WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, value DESC, lead_id LIMIT 60")
def case_order(t: Tables) -> DataFrame:
    bucket = F.when(F.col("status") == "O", 0).when(F.col("status") == "P", 1).otherwise(2)
    return leads(t).orderBy(bucket, F.desc("value"), "lead_id").limit(60).select("lead_id", "status", "value")


@query(f"{WITH}, r AS (SELECT * FROM leads WHERE lead_id = 1) SELECT l.lead_id, CAST((l.segment = r.segment) AS INT) * 3 + CAST((l.place = r.place) AS INT) * 2 + CAST((abs(l.value - r.value) / greatest(l.value, r.value) <= 0.25) AS INT) AS likeness FROM leads l, r WHERE l.lead_id <> 1 ORDER BY likeness DESC, lead_id LIMIT 50")
def sort_lookalike(t: Tables) -> DataFrame:
    """Likeness to one lead: its row is broadcast to all others."""
    rows = leads(t)
    one = rows.where("lead_id = 1").select(F.col("segment").alias("s"), F.col("place").alias("p"), F.col("value").alias("v")).limit(1)
    near = F.abs(F.col("value") - F.col("v")) / F.greatest("value", "v") <= 0.25
    likeness = (F.col("segment") == F.col("s")).cast("int") * 3 + (F.col("place") == F.col("p")).cast("int") * 2 + near.cast("int")
    return rows.where("lead_id != 1").join(F.broadcast(one)).select("lead_id", likeness.alias("likeness")).orderBy(F.desc("likeness"), "lead_id").limit(50)


@query("SELECT o_orderkey AS ref, 'order' AS kind FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT l_orderkey, 'line' FROM lineitem WHERE l_extendedprice > 90000")
def union_all(t: Tables) -> DataFrame:
    a = t.orders.where("o_totalprice > 300000").select(F.col("o_orderkey").alias("ref"), F.lit("order").alias("kind"))
    return a.unionByName(t.lineitem.where("l_extendedprice > 90000").select(F.col("l_orderkey").alias("ref"), F.lit("line").alias("kind")))


@query("""SELECT l_suppkey, list_sort(list_distinct(list_concat(coalesce(list(l_partkey) FILTER (WHERE l_returnflag = 'R'), []), coalesce(list(l_partkey) FILTER (WHERE l_discount = 0.1), [])))) AS parts FROM lineitem WHERE l_returnflag = 'R' OR l_discount = 0.1 GROUP BY 1""")
def array_union_distinct(t: Tables) -> DataFrame:
    some = t.lineitem.where("l_returnflag = 'R' or l_discount = 0.1").groupBy("l_suppkey")
    a, b = F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))), F.collect_set(F.when(F.col("l_discount") == 0.1, F.col("l_partkey")))
    return some.agg(F.array_sort(F.array_union(a, b)).alias("parts"))


@query("""SELECT c_nationkey, CAST(count(*) AS BIGINT) AS new_members FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT c_custkey, c_nationkey FROM customer JOIN events ON user_id = c_custkey) GROUP BY 1""")
def set_difference(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 0").join(t.events, F.col("c_custkey") == F.col("user_id"), "left_anti").groupBy("c_nationkey").agg(F.count("*").alias("new_members"))


@query("""SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'""")
def intersect(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'click'").select("user_id").intersect(t.orders.where("o_orderstatus = 'O'").select("o_custkey"))


@query("""SELECT lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS key, min(p_partkey) AS first, count(*) AS members FROM part GROUP BY 1""")
def dedupe_members(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower(F.regexp_replace("p_name", "[^a-zA-Z0-9]", "")).alias("key")).agg(F.min("p_partkey").alias("first"), F.count("*").alias("members"))


@query("""SELECT o_orderkey, n FROM (SELECT s.o_orderkey, count(*) AS n FROM orders s JOIN lineitem ON l_orderkey = s.o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_brand = 'Brand#11' GROUP BY 1) WHERE n >= 1""")
def inner_join(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part.where("p_brand = 'Brand#11'"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, count(l_orderkey) AS documents FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def left_outer_join(t: Tables) -> DataFrame:
    n = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("documents"))
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("SELECT a.s_suppkey, c.c_custkey FROM supplier a JOIN customer c ON regexp_replace(lower(a.s_name), '[^0-9]', '', 'g') = regexp_replace(lower(c.c_name), '[^0-9]', '', 'g')")
def normalised_key_join(t: Tables) -> DataFrame:
    digits = lambda c: F.regexp_replace(F.lower(c), "[^0-9]", "")
    return t.supplier.select("s_suppkey", digits("s_name").alias("k")).join(t.customer.select("c_custkey", digits("c_name").alias("k")), "k").select("s_suppkey", "c_custkey")


@query("""SELECT doc_id, word_count FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \t\n\r]+'), lambda x: x <> '')) AS word_count FROM documents)""")
def word_count(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != "")).cast("long").alias("word_count"))


@query("""WITH s AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r, lang, toxic FROM documents JOIN labels USING (doc_id)),
m AS (SELECT lang, CAST(count(*) FILTER (WHERE quality = 1 AND r <= 20) AS DOUBLE) / least(20, count(*)) AS precision20, CAST(count(*) FILTER (WHERE quality = 0) AS DOUBLE) / count(*) AS junk,
CAST(count(*) FILTER (WHERE quality = 1 AND r <= 20) AS DOUBLE) / nullif(count(*) FILTER (WHERE quality = 1), 0) AS recall, count(*) FILTER (WHERE toxic = 1 AND r <= 20) AS slips FROM s GROUP BY 1)
SELECT lang, round(precision20, 6) AS precision20, round(junk, 6) AS junk, round(recall, 6) AS recall, slips FROM m""")
def eval_precision_at_20(t: Tables) -> DataFrame:
    """Counts over all rows by one aggregate; only the best 20 of each language are ranked."""
    rows = t.documents.select("doc_id", "lang", "n_chars").join(t.labels, "doc_id")
    good = F.count_if(F.col("quality") == 1)
    all_ = rows.groupBy("lang").agg(F.count("*").alias("n"), good.alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    early = rk.top_per(rows, ["lang"], 20, F.desc("n_chars"), F.col("doc_id")).groupBy("lang").agg(good.alias("hits"), F.count_if(F.col("toxic") == 1).alias("slips"))
    return all_.join(early, "lang").select("lang", F.round(F.col("hits") / F.least(F.lit(20), "n"), 6).alias("precision20"), F.round(F.col("bad") / F.col("n"), 6).alias("junk"), F.round(F.try_divide("hits", "good"), 6).alias("recall"), "slips")


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 50) AS large, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS units, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50) AS high FROM events GROUP BY 1""")
def progress_rollup(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    units = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return t.events.groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("large"), units.alias("units"), F.count_distinct("user_id").alias("users"), F.count_if(k >= 50).alias("high"))


@query("""SELECT lane, doc_id, place FROM (SELECT CASE WHEN n_chars >= 4000 THEN 'long' WHEN n_chars >= 1000 THEN 'middle' ELSE 'short' END AS lane, doc_id, row_number() OVER (PARTITION BY CASE WHEN n_chars >= 4000 THEN 'long' WHEN n_chars >= 1000 THEN 'middle' ELSE 'short' END ORDER BY n_chars DESC, doc_id) AS place FROM documents)
WHERE place <= CASE lane WHEN 'long' THEN 25 WHEN 'middle' THEN 10 ELSE 20 END""")
def read_lanes(t: Tables) -> DataFrame:
    """At most a share of 50 pages for each lane."""
    lane = F.when(F.col("n_chars") >= 4000, "long").when(F.col("n_chars") >= 1000, "middle").otherwise("short")
    rows = rk.top_per(t.documents.withColumn("lane", lane), ["lane"], 25, F.desc("n_chars"), F.col("doc_id"), rank="place")
    most = F.when(F.col("lane") == "long", 25).when(F.col("lane") == "middle", 10).otherwise(20)
    return rows.where(F.col("place") <= most).select("lane", "doc_id", "place")


@query("SELECT o_custkey, o_orderkey, CAST(floor((r - 1) / 20) AS BIGINT) AS batch FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def candidate_batches(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return t.orders.select("o_custkey", "o_orderkey", F.floor((r - 1) / 20).cast("long").alias("batch"))


@query("""SELECT c_custkey AS list_id, count(DISTINCT o_orderkey) AS items FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def lead_lists(t: Tables) -> DataFrame:
    """Membership: unknown items aren't added, removed ones go."""
    items = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").join(t.lineitem.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return items.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left_semi").groupBy(F.col("o_custkey").alias("list_id")).agg(F.count_distinct("o_orderkey").alias("items"))


@query()
def greedy_quota_select(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", "source", "doc_id", "n_chars")
    limits = [{"source": 1}, {"source": 2}, {"source": 3}]

    def choose(pdf):
        return rk.greedy_quota(pdf.sort_values(["n_chars", "doc_id"], ascending=[False, True]), limits, 20)[["lang", "source", "doc_id", "place"]]

    # Later passes of the quota take at most three rows of a source: more than 20 of a source are never looked at.
    return rk.per_group(rk.top_per(rows, ["lang", "source"], 20, F.desc("n_chars"), F.col("doc_id")).drop("rank"), ["lang"], choose, "lang string, source string, doc_id long, place long")


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, CASE WHEN value <= 200 THEN 200 - value ELSE CAST(200 AS DOUBLE) END AS rest, value <= 200 AS ok FROM o WHERE n = 1
UNION ALL SELECT o.user_id, o.event_id, o.n, CASE WHEN o.value <= r.rest THEN r.rest - o.value ELSE r.rest END, o.value <= r.rest FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
SELECT user_id, event_id, CASE WHEN ok THEN 'reserved' ELSE 'exhausted' END AS state FROM r""")
def budget_reserve(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "ts", "value")
    return rk.per_group(rows, ["user_id"], lambda pdf: rk.reserve(pdf.sort_values(["ts", "event_id"]), "value", 200.0)[["user_id", "event_id", "state"]], "user_id long, event_id long, state string")


@query(f"""{WITH} SELECT CASE WHEN grouping(status) = 1 THEN 'all' ELSE status END AS status, CASE WHEN grouping(segment) = 1 THEN 'all' ELSE segment END AS segment, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS value
FROM leads GROUP BY CUBE (status, segment)""")
def grouping_sets(t: Tables) -> DataFrame:
    """Leads and their value by status, by segment, by both and over all, in one aggregate."""
    value = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    name = lambda c, out: F.when(F.grouping(c) == 1, "all").otherwise(F.col(c)).alias(out)
    return leads(t).cube("status", "segment").agg(F.count("*").alias("n"), value.alias("value"), name("status", "s"), name("segment", "g")).select(F.col("s").alias("status"), F.col("g").alias("segment"), "n", "value")


@query(f"""{WITH} SELECT lead_id, CAST(lead_id AS VARCHAR) || ',' || CASE WHEN contains(c, '"') OR contains(c, ',') THEN '"' || replace(c, '"', '""') || '"' ELSE c END || ',' || CAST(score AS VARCHAR) AS line
FROM (SELECT lead_id, score, CASE lead_id % 4 WHEN 0 THEN chr(39) || '=' || buyer WHEN 1 THEN 'Say "' || buyer || '"' WHEN 2 THEN buyer || ', ' || segment ELSE buyer END AS c FROM leads)""")
def csv_lines(t: Tables) -> DataFrame:
    """Leads as lines of a CSV file: formula signs disarmed, quotes doubled, cells with commas or quotes quoted."""
    case = F.col("lead_id") % 4
    name = F.when(case == 0, F.concat(F.lit("="), "buyer")).when(case == 1, F.concat(F.lit('Say "'), F.col("buyer"), F.lit('"'))).when(case == 2, F.concat_ws(", ", "buyer", "segment")).otherwise(F.col("buyer"))
    return leads(t).select("lead_id", sinks.csv_line(F.col("lead_id"), name, F.col("score")).alias("line"))


@query("""WITH sent AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(event_id) AS event_id, count(*) AS asked FROM events GROUP BY 1, 2, 3)
SELECT user_id, event_type, strftime(day, '%Y-%m-%d') AS day, event_id, asked FROM sent WHERE event_type <> 'view'""")
def outbox(t: Tables) -> DataFrame:
    """Messages to send: one for each key however often it was asked for, none for keys that are in the box already."""
    rows = t.events.select("user_id", "event_type", F.to_date("ts").cast("string").alias("day"), "event_id")
    once = rows.groupBy("user_id", "event_type", "day").agg(F.min("event_id").alias("event_id"), F.count("*").alias("asked"))
    boxed = rows.where("event_type = 'view'").select("user_id", "event_type", "day").distinct()
    return once.join(boxed, ["user_id", "event_type", "day"], "left_anti")


@query("""WITH s AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'click')
SELECT event_id, user_id, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS place FROM s WHERE before IS NULL OR ts - before > INTERVAL 6 HOUR""")
def scheduler_queue(t: Tables) -> DataFrame:
    """Each day's runs in order of arrival; one of a search that ran in the six hours before isn't queued."""
    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    fresh = t.events.where("event_type = 'click'").withColumn("before", before).where(F.col("before").isNull() | (F.col("ts") - F.col("before") > F.expr("interval 6 hours")))
    place = F.row_number().over(Window.partitionBy(F.to_date("ts")).orderBy("ts", "event_id"))
    return fresh.select("event_id", "user_id", place.cast("long").alias("place"))


@query("""WITH j AS (SELECT CASE WHEN o_totalprice >= 200000 THEN 'lead' ELSE 'rejected' END AS was, CASE WHEN o_totalprice >= 150000 AND o_orderstatus <> 'F' THEN 'lead' ELSE 'rejected' END AS now FROM orders)
SELECT was, now, count(*) AS n FROM j GROUP BY 1, 2""")
def replay(t: Tables) -> DataFrame:
    """Stored answers judged again under new rules, against what the old ones said."""
    price = F.col("o_totalprice")
    was = F.when(price >= 200000, "lead").otherwise("rejected")
    now = F.when((price >= 150000) & (F.col("o_orderstatus") != "F"), "lead").otherwise("rejected")
    return t.orders.groupBy(was.alias("was"), now.alias("now")).agg(F.count("*").alias("n"))


@query(f"""{WITH}, last AS (SELECT user_id AS buyer_id, arg_max(event_type, ts) AS latest, count(*) AS changes FROM events GROUP BY 1)
SELECT lead_id, CASE WHEN latest = 'purchase' THEN 'won' WHEN latest IS NOT NULL THEN 'working' ELSE status END AS status, coalesce(changes, 0) AS changes FROM leads LEFT JOIN last USING (buyer_id)""")
def lead_write(t: Tables) -> DataFrame:
    """The state of leads from a log that is only appended to: the newest change of each buyer counts, and how many there were."""
    last = t.events.groupBy(F.col("user_id").alias("buyer_id")).agg(F.max_by("event_type", "ts").alias("latest"), F.count("*").alias("changes"))
    status = F.when(F.col("latest") == "purchase", "won").when(F.col("latest").isNotNull(), "working").otherwise(F.col("status"))
    return leads(t).join(last, "buyer_id", "left").select("lead_id", status.alias("status"), F.coalesce("changes", F.lit(0)).alias("changes"))
