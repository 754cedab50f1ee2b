"""Names, roles, triggers, threads, claims and other rules of the domain, carried by the tables as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import fuzzy, names, textual
from leadlens.operators.ranking import first_per, interleave, top_per
from leadlens.plans.carriers import LEADS_SQL, leads
from leadlens.registry import Tables, query

VARIED_NAME = "c_name || CASE c_custkey % 5 WHEN 0 THEN ' (Alias ' || CAST(c_custkey AS STRING) || ')' WHEN 1 THEN ', or ALIAS ' || CAST(c_custkey AS STRING) WHEN 2 THEN ' Pvt Ltd Division' WHEN 3 THEN ', aka Alias ' || CAST(c_custkey AS STRING) || ' (Short ' || CAST(c_custkey AS STRING) || ')' ELSE '' END"


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN c_name || ' Pvt Ltd Division' ELSE c_name END AS main, CASE c_custkey % 5 WHEN 0 THEN 'Alias ' || c_custkey WHEN 1 THEN 'ALIAS ' || c_custkey WHEN 3 THEN 'Short ' || c_custkey || '|Alias ' || c_custkey ELSE '' END AS aliases FROM customer")
def name_parts(t: Tables) -> DataFrame:
    """Main names and the other names written beside them, one or two."""
    return t.customer.select("c_custkey", names.name_parts(F.expr(VARIED_NAME)).alias("p")).select("c_custkey", "p.main", F.array_join("p.aliases", "|").alias("aliases"))


@query("""WITH k AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) AS base FROM customer)
SELECT c_custkey, array_to_string(list_sort(CASE c_custkey % 5 WHEN 0 THEN [base, 'alias ' || c_custkey] WHEN 1 THEN [base, 'alias ' || c_custkey] WHEN 2 THEN [base || ' division', base] WHEN 3 THEN [base, 'alias ' || c_custkey, 'short ' || c_custkey] ELSE [base] END), '|') AS keys FROM k""")
def company_keys(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.array_join(F.array_sort(names.company_keys(F.expr(VARIED_NAME))), "|").alias("keys"))


@query("SELECT c_custkey, 'person ' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS key FROM customer")
def person_norm(t: Tables) -> DataFrame:
    title = F.when(F.col("c_custkey") % 3 == 0, "Dr. ").when(F.col("c_custkey") % 3 == 1, "ENGR ").otherwise("")
    return t.customer.select("c_custkey", names.person_key(F.concat(title, F.lit("Person-"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij"))).alias("key"))


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM (SELECT s_suppkey, lower(regexp_replace(s_name, '[^A-Za-z0-9]', '', 'g')) AS k FROM supplier) a
JOIN (SELECT s_suppkey, lower(regexp_replace(CASE s_suppkey % 2 WHEN 0 THEN s_name || ' LLC' ELSE '(x) ' || s_name END, '\\(x\\)| LLC|[^A-Za-z0-9]', '', 'g')) AS k FROM supplier) b ON a.k = b.k""".replace("\\\\", "\\"))
def same_company(t: Tables) -> DataFrame:
    """Two spellings of suppliers, joined by any key that they share."""
    key = lambda name: F.explode(names.company_keys(name)).alias("key")
    other = F.when(F.col("s_suppkey") % 2 == 0, F.concat("s_name", F.lit(" LLC"))).otherwise(F.concat(F.lit("(x) "), F.col("s_name")))
    a, b = t.supplier.select(F.col("s_suppkey").alias("a"), key(F.col("s_name"))), t.supplier.select(F.col("s_suppkey").alias("b"), key(other))
    return a.join(b, "key").select("a", "b").distinct()


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN abs(o_totalprice - o_totalprice * 1.005) <= 0.01 * o_totalprice * 1.005 WHEN 1 THEN false WHEN 2 THEN true ELSE true END AS agrees FROM orders WHERE o_totalprice > 0""")
def values_agree(t: Tables) -> DataFrame:
    """Two readings of a value: near numbers, days that differ, a month against its day, texts that differ by case."""
    case, price, day = F.col("o_orderkey") % 4, F.col("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd")
    kind = F.when(case == 0, "number").when(case.isin(1, 2), "date").otherwise("enum")
    a = F.when(case == 0, F.format_string("%.2f", price)).when(case.isin(1, 2), day).otherwise(F.col("o_orderpriority"))
    b = F.when(case == 0, F.format_string("%.2f", price * 1.005)).when(case == 1, F.lit("1990-01-01")).when(case == 2, F.substring(day, 1, 7)).otherwise(F.lower("o_orderpriority"))
    return t.orders.where("o_totalprice > 0").select("o_orderkey", fuzzy.values_agree(kind, a, b).alias("agrees"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pipe|steel plate' WHEN 1 THEN 'a very long phrase|very|long|phrase' ELSE 'valve' END AS terms
FROM (SELECT p_partkey FROM part)""".replace("'a very long phrase|very|long|phrase'", "'a very long phrase|a|very|long|phrase'"))
def query_terms(t: Tables) -> DataFrame:
    text = F.when(F.col("p_partkey") % 3 == 0, "Pipe, steel plate or the").when(F.col("p_partkey") % 3 == 1, "A very long phrase").otherwise("all; Valve / valve")
    return t.part.select("p_partkey", F.array_join(textual.query_terms(text), "|").alias("terms"))


@query("""SELECT o_orderkey, CAST(CASE WHEN d <= p + INTERVAL 3 DAY AND d <= DATE '2001-08-02' THEN d WHEN award THEN p END AS VARCHAR) AS award_date
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS p, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 - 2 AS INTEGER) AS d, o_orderstatus = 'F' AS award FROM orders)""")
def award_date(t: Tables) -> DataFrame:
    from leadlens.functions.dates import award_date as rule

    published = F.to_date("o_orderdate")
    text_date = F.date_add(published, (F.col("o_orderkey") % 9 - 2).cast("int"))
    return t.orders.select("o_orderkey", rule(text_date, published, F.col("o_orderstatus") == "F", F.lit("2001-08-02").cast("date")).cast("string").alias("award_date"))


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\"\\s*:\\s*(-?[0-9]+)', 1) AS BIGINT) AS k, CAST(regexp_extract(props, '\"k\"\\s*:\\s*(-?[0-9]+)', 1) AS BIGINT) IS NOT NULL AS has_k FROM events".replace("\\\\", "\\"))
def json_access(t: Tables) -> DataFrame:
    """A typed read of loose JSON: what is malformed or missing is null."""
    k = F.from_json("props", "k long")["k"]
    return t.events.select("event_id", k.alias("k"), k.isNotNull().alias("has_k"))


@query("""SELECT user_id, event_id, strength, place FROM (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS strength,
row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END DESC, ts DESC NULLS LAST, event_id DESC) AS place FROM events) WHERE place = 1""")
def strongest_trigger(t: Tables) -> DataFrame:
    """One trigger a user: strength, then date, then id."""
    strength = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    rows = t.events.select("user_id", "event_id", "ts", strength.alias("strength"))
    return top_per(rows, ["user_id"], 1, F.desc("strength"), F.desc_nulls_last("ts"), F.desc("event_id"), rank="place").select("user_id", "event_id", "strength", "place")


@query("""WITH o AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS asked, count(*) FILTER (WHERE role = 'assistant') AS answered,
CASE WHEN arg_max(role, turn) = 'user' THEN 'waiting' WHEN count(*) FILTER (WHERE role = 'assistant') = 0 THEN 'silent' ELSE 'replied' END AS state, count(*) FILTER (WHERE role = before) AS follow_ups FROM o GROUP BY conv_id""")
def thread_state(t: Tables) -> DataFrame:
    """Where each thread stands after its turns in order; a turn of the same side as the one before is a follow-up."""
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.select("conv_id", "turn", "role", before.alias("before"))
    answered = F.count_if(F.col("role") == "assistant")
    state = F.when(F.max_by("role", "turn") == "user", "waiting").when(answered == 0, "silent").otherwise("replied")
    return rows.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("asked"), answered.alias("answered"), state.alias("state"), F.count_if(F.col("role") == F.col("before")).alias("follow_ups"))


@query("""WITH j AS (SELECT event_id, user_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events WHERE event_type = 'click')
SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY floor(value) - 10 * (nth - 1) DESC, ts, event_id) AS place FROM j WHERE nth <= 2) WHERE place <= 20""")
def job_claim(t: Tables) -> DataFrame:
    """The next 20 jobs of a queue: priority less a penalty for each earlier job of the same run, at most two of a run, oldest first."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    jobs = t.events.where("event_type = 'click'").withColumn("nth", nth).where("nth <= 2")
    best = jobs.select("event_id", "ts", (F.floor("value") - 10 * (F.col("nth") - 1)).alias("rank")).orderBy(F.desc("rank"), "ts", "event_id").limit(20)
    return best.select("event_id", F.row_number().over(Window.orderBy(F.desc("rank"), "ts", "event_id")).cast("long").alias("place"))


ROLE_SQL = "CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN 'manufacturer' WHEN p_type = 'ECONOMY' THEN 'distributor' ELSE 'fabricator' END"


@query(f"""WITH r AS (SELECT l_suppkey, {ROLE_SQL} AS role, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT l_suppkey AS s_suppkey, role, n FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, role) AS place FROM r) WHERE place = 1""")
def buyer_type(t: Tables) -> DataFrame:
    """The role that most of a company's lines speak for; ties by name."""
    role = F.when(F.col("p_type").isin("PROMO", "STANDARD"), "manufacturer").when(F.col("p_type") == "ECONOMY", "distributor").otherwise("fabricator")
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("s_suppkey"), role.alias("role")).agg(F.count("*").alias("n"))
    return first_per(lines, ["s_suppkey"], F.desc("n"), F.col("role")).select("s_suppkey", "role", "n")


@query(f"""WITH {LEADS_SQL}, d AS (SELECT buyer_id, count(*) AS deals, sum(value) AS total, max(created) AS latest, list_sort(list(DISTINCT status)) AS statuses FROM leads GROUP BY 1),
v AS (SELECT user_id, count(*) AS events, max(ts) AS seen FROM events GROUP BY 1)
SELECT c_custkey AS buyer_id, c_name AS buyer, n_name AS place, coalesce(deals, 0) AS deals, round(coalesce(total, 0), 2) AS total, latest, array_to_string(coalesce(statuses, []), ',') AS statuses, coalesce(events, 0) AS events, seen
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN d ON d.buyer_id = c_custkey LEFT JOIN v ON v.user_id = c_custkey""")
def buyer_view(t: Tables) -> DataFrame:
    """One wide row a buyer: children are summed up by key before they are joined, so that nothing multiplies."""
    deals = leads(t).groupBy("buyer_id").agg(F.count("*").alias("deals"), F.sum("value").alias("total"), F.max("created").alias("latest"), F.array_sort(F.collect_set("status")).alias("statuses"))
    seen = t.events.groupBy(F.col("user_id").alias("buyer_id")).agg(F.count("*").alias("events"), F.max("ts").alias("seen"))
    buyers = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("buyer_id"), F.col("c_name").alias("buyer"), F.col("n_name").alias("place"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    wide = buyers.join(deals, "buyer_id", "left").join(seen, "buyer_id", "left")
    return wide.select("buyer_id", "buyer", "place", zero("deals"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"), "latest", F.coalesce(F.array_join("statuses", ","), F.lit("")).alias("statuses"), zero("events"), "seen")


@query(f"""WITH {LEADS_SQL}, f AS (SELECT * FROM leads WHERE region IN ('ASIA', 'EUROPE') AND value >= 100000),
r AS (SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY score DESC, created DESC, lead_id) AS best, count(*) OVER (PARTITION BY buyer_id) AS deals FROM f)
SELECT buyer_id, lead_id, score, deals FROM r WHERE best = 1 ORDER BY score DESC, lead_id LIMIT 50""")
def supersearch(t: Tables) -> DataFrame:
    """Filter, one representative a buyer with the number of its deals, best first, first page."""
    found = leads(t).where(F.col("region").isin("ASIA", "EUROPE") & (F.col("value") >= 100000))
    order = F.struct("score", "created", (-F.col("lead_id")).alias("last"))
    best = found.groupBy("buyer_id").agg(F.max_by(F.struct("lead_id", "score"), order).alias("best"), F.count("*").alias("deals"))
    return best.select("buyer_id", "best.lead_id", "best.score", "deals").orderBy(F.desc("score"), "lead_id").limit(50)


@query("""WITH s AS (SELECT p_type, l_suppkey, count(DISTINCT l_orderkey) AS deals FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), r AS (SELECT p_type, l_suppkey, deals, CASE WHEN deals >= 5 THEN 'confirmed' WHEN deals >= 2 THEN 'likely' ELSE 'possible' END AS tier,
row_number() OVER (PARTITION BY p_type ORDER BY deals DESC, l_suppkey) AS place FROM s) SELECT p_type, l_suppkey, deals, tier, place FROM r WHERE place <= 5""")
def supply_chain(t: Tables) -> DataFrame:
    """Up to five suppliers of each type of part, by the deals that speak for them."""
    deals = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_suppkey").agg(F.count_distinct("l_orderkey").alias("deals"))
    tier = F.when(F.col("deals") >= 5, "confirmed").when(F.col("deals") >= 2, "likely").otherwise("possible")
    return top_per(deals, ["p_type"], 5, F.desc("deals"), F.col("l_suppkey"), rank="place").select("p_type", "l_suppkey", "deals", tier.alias("tier"), F.col("place").cast("long").alias("place"))


@query("""WITH rules(id, least, points) AS (VALUES ('known_place', 1, 8), ('in_credit', 1, 8), ('active', 3, 4)), m AS (SELECT c_custkey, CAST(n_name IS NOT NULL AS INT) AS known_place, CAST(c_acctbal >= 0 AS INT) AS in_credit, coalesce(n, 0) AS active
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey), u AS (SELECT c_custkey, id, v FROM m UNPIVOT (v FOR id IN (known_place, in_credit, active)))
SELECT c_custkey, count(*) FILTER (WHERE v >= least) AS met, count(*) FILTER (WHERE v < least) AS missing, CAST(coalesce(sum(points) FILTER (WHERE v >= least), 0) AS BIGINT) AS points FROM u JOIN rules USING (id) GROUP BY 1""")
def checklist(t: Tables) -> DataFrame:
    """Rules met and missing for each buyer, from a rule table of a few rows."""
    rules = F.broadcast(t.spark.createDataFrame([("known_place", 1, 8), ("in_credit", 1, 8), ("active", 3, 4)], "id string, least int, points int"))
    active = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("active"))
    wide = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(active, "c_custkey", "left")
    facts = wide.select("c_custkey", F.col("n_name").isNotNull().cast("long").alias("known_place"), (F.col("c_acctbal") >= 0).cast("long").alias("in_credit"), F.coalesce("active", F.lit(0)).alias("active"))
    held = facts.unpivot("c_custkey", ["known_place", "in_credit", "active"], "id", "v").join(rules, "id")
    met = F.col("v") >= F.col("least")
    return held.groupBy("c_custkey").agg(F.count_if(met).alias("met"), F.count_if(~met).alias("missing"), F.coalesce(F.sum(F.when(met, F.col("points"))), F.lit(0)).alias("points"))


@query("""WITH a AS (SELECT l_suppkey AS company, p_type AS type, p_brand AS item, 'observed' AS source FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'), k AS (SELECT DISTINCT l_suppkey AS company, p_type AS type, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A')
SELECT DISTINCT company, type, item, source FROM a WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.company = a.company AND k.type = a.type AND k.item IS NOT DISTINCT FROM a.item)""")
def directory_sync(t: Tables) -> DataFrame:
    """Capabilities to add to a directory: observed ones that it doesn't hold yet."""
    key = ["company", "type", "item"]
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    rows = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("company"), F.col("p_type").alias("type"), F.col("p_brand").alias("item")).distinct()
    new, held = rows("R"), rows("A").withColumnsRenamed({k: f"held_{k}" for k in key})
    same = [F.col(k).eqNullSafe(F.col(f"held_{k}")) for k in key]
    return new.join(held, same, "left_anti").withColumn("source", F.lit("observed"))


@query("""WITH q AS (SELECT item_id, text FROM benchmark), s AS (SELECT source, lang, count(*) AS quotes, min(doc_id) AS first_doc, sum(n_chars) AS chars FROM documents GROUP BY 1, 2)
SELECT source, count(*) AS kinds, CAST(sum(quotes) AS BIGINT) AS quotes, min(first_doc) AS first_doc, arg_max(lang, quotes * 1000 + ascii(lang)) AS main_kind FROM s GROUP BY 1""".replace("WITH q AS (SELECT item_id, text FROM benchmark), s", "WITH s"))
def evidence_cards(t: Tables) -> DataFrame:
    """One card a source: its kinds of evidence, how many quotes, the first, and the most frequent kind."""
    kinds = t.documents.groupBy("source", "lang").agg(F.count("*").alias("quotes"), F.min("doc_id").alias("first_doc"))
    return kinds.groupBy("source").agg(F.count("*").alias("kinds"), F.sum("quotes").alias("quotes"), F.min("first_doc").alias("first_doc"), F.max_by("lang", F.col("quotes") * 1000 + F.ascii("lang")).alias("main_kind"))


@query("""SELECT status, found, contacted, back FROM (SELECT o_orderstatus AS status, count(DISTINCT o_custkey) AS found, count(DISTINCT user_id) AS contacted, count(DISTINCT CASE WHEN n >= 5 THEN user_id END) AS back
FROM orders LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = o_custkey GROUP BY 1)""")
def funnel(t: Tables) -> DataFrame:
    """From found to contacted to back, by status of the lead."""
    active = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = t.orders.select("o_orderstatus", "o_custkey").distinct().join(active, F.col("user_id") == F.col("o_custkey"), "left")
    return rows.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("o_custkey").alias("found"), F.count("user_id").alias("contacted"), F.count_if(F.col("n") >= 5).alias("back"))


@query("""SELECT c_custkey, n_name, place FROM (SELECT c_custkey, n_name, row_number() OVER (PARTITION BY n_name ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal >= 5000) WHERE place <= 2""")
def likely_buyers(t: Tables) -> DataFrame:
    """The two best rated of each place, above the least rating."""
    rows = t.customer.where("c_acctbal >= 5000").join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return top_per(rows, ["n_name"], 2, F.desc("c_acctbal"), F.col("c_custkey"), rank="place").select("c_custkey", "n_name", F.col("place").cast("long").alias("place"))


@query("""WITH t(kind, base) AS (VALUES ('notices', 100), ('news', 80), ('registry', 60)) SELECT n_name AS market, kind, base - r_regionkey * 10 AS priority, CASE WHEN base - r_regionkey * 10 >= 70 THEN 1 ELSE 2 END AS round FROM nation JOIN region ON r_regionkey = n_regionkey CROSS JOIN t""")
def source_plan(t: Tables) -> DataFrame:
    """A task for each market and kind of source, with priority and round; both sides are tables of a few rows."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(b).alias("base")) for k, b in (("notices", 100), ("news", 80), ("registry", 60))])
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("market"), "r_regionkey", F.explode(kinds).alias("t"))
    priority = F.col("t.base") - F.col("r_regionkey") * 10
    return rows.select("market", "t.kind", priority.alias("priority"), F.when(priority >= 70, 1).otherwise(2).alias("round"))


@query("""WITH n AS (SELECT p_partkey, p_name, lower(trim(p_name)) AS key FROM part) SELECT key, arg_max(p_name, p_partkey) AS spelling, count(*) AS entered FROM n GROUP BY 1""")
def own_products(t: Tables) -> DataFrame:
    """Products by normalised key, with the newest spelling."""
    return t.part.groupBy(F.lower(F.trim("p_name")).alias("key")).agg(F.max_by("p_name", "p_partkey").alias("spelling"), F.count("*").alias("entered"))


@query("""WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn, source FROM documents WHERE lang = 'en') SELECT doc_id, source, turn FROM p WHERE turn <= 3""")
def fair_reading_order(t: Tables) -> DataFrame:
    """Every source's next document before any source's one after; three rounds."""
    out = interleave(t.documents.where("lang = 'en'"), "source", F.desc("n_chars"), F.col("doc_id"))
    turn = next(c for c in out.columns if c not in t.documents.columns)
    return out.where(F.col(turn) <= 3).select("doc_id", "source", F.col(turn).cast("long").alias("turn"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9])(license|licensed)($|[^a-z0-9])') THEN 'license' WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z]') THEN 'contact' WHEN n_chars > 5000 THEN 'report' WHEN n_chars < 100 THEN 'snippet' ELSE 'article' END AS kind FROM documents""".replace("\\\\", "\\"))
def classify_page(t: Tables) -> DataFrame:
    text = F.col("text")
    kind = textual.decide(
        (F.lower(text).rlike("(^|[^a-z0-9])(license|licensed)($|[^a-z0-9])"), "license"),
        (text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "contact"),
        (F.col("n_chars") > 5000, "report"),
        (F.col("n_chars") < 100, "snippet"),
        otherwise="article",
    )
    return t.documents.select("doc_id", kind.alias("kind"))


@query("""WITH terms(term, market) AS (VALUES ('asia', 'A'), ('europe', 'E'), ('america', 'W')), n AS (SELECT n_nationkey, lower(n_name || ' ' || r_name) AS text FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT n_nationkey, array_to_string(list_sort(list(DISTINCT market)), ',') AS markets FROM n JOIN terms ON contains(text, term) GROUP BY 1""")
def detect_market(t: Tables) -> DataFrame:
    """Markets whose names occur in a text: the few names are columns of one expression, not a join of all with all."""
    text = F.lower(F.concat_ws(" ", "n_name", "r_name"))
    hits = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(term)), F.lit(m)) for term, m in (("asia", "A"), ("europe", "E"), ("america", "W"))]))
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array_join(F.array_sort(F.array_distinct(hits)), ",").alias("markets"))
    return rows.where("markets != ''")
