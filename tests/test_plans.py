"""Searches, signals and the rubric on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from leadlens.operators import extract
from leadlens.operators.buyers import DIMENSIONS, BuyerSearch, ordered, representatives
from leadlens.plans import rubric, signals

RECORD = "company_id long, name string, country string, region string, role string, stage string, fit long, how_sure string, tier int, link string, reach string, industry string, value double, created date, trigger_kind string, trigger_date date, window_from date, items array<string>, signals array<string>, found long, slots long, rejected boolean"
D = dt.date


def records(spark):
    one = (1, "Acme Pipes", "IN", "ASIA", "owner", "high", 80, "high", 1, "confirmed", "allowed", "water", 5e6, D(2001, 1, 1), "award", D(2001, 7, 1), D(2001, 9, 1), ["pipe", "valve"], ["won"], 2, 4, False)
    bare = (2, "Bare", None, None, "owner", "watch", 10, "low", 3, "possible", "blocked", None, None, D(2001, 1, 1), None, None, None, [], [], 0, 0, False)
    out = (3, "Cold", "AE", "ASIA", "maker", "not_buyer", 90, "low", 2, "likely", "allowed", "power", 1e6, D(2001, 8, 1), "award", D(2001, 8, 1), D(2001, 1, 1), ["pipe"], ["won"], 0, 1, False)
    return spark.createDataFrame([one, bare, out], RECORD)


def test_each_dimension(spark):
    like = {"company_id": 3, "role": "owner", "country": "IN", "industry": "water", "items": ["pipe"]}
    asked = {
        "location": BuyerSearch(places=("IN",)), "roles": BuyerSearch(not_roles=("maker",), roles=("owner",), places=("IN",)), "sell": BuyerSearch(items=("valve",)), "signals": BuyerSearch(signals=("won",), signal_days=60),
        "contacts": BuyerSearch(with_contacts=True), "industry": BuyerSearch(industries=("water",)), "value": BuyerSearch(least_value=2e6, most_value=9e6), "lookalike": BuyerSearch(like=like), "companyList": BuyerSearch(companies=("acme",)),
        "reach": BuyerSearch(reach=("allowed",), roles=("owner",)), "stage": BuyerSearch(stages=("high",)), "minFit": BuyerSearch(least_fit=50, roles=("owner",)), "howSure": BuyerSearch(how_sure=("high",)), "q": BuyerSearch(text="pipes OWNER"),
        "tiers": BuyerSearch(tiers=(1,)), "linkStatus": BuyerSearch(links=("confirmed",)), "triggers": BuyerSearch(triggers=("award",), trigger_days=40, roles=("owner",)),
    }
    assert tuple(asked) == DIMENSIONS
    df = records(spark)
    for dim, search in asked.items():
        assert dim in search.conditions() and [r.company_id for r in search.apply(df).collect()] == [1], dim
    assert {r.company_id for r in BuyerSearch().apply(df).collect()} == {1, 2} and {r.company_id for r in BuyerSearch().apply(df, omit="stage").collect()} == {1, 2, 3}
    assert [r.company_id for r in BuyerSearch(undated=True).apply(df).collect()] == [2]
    assert [r.company_id for r in df.orderBy(*ordered(df, "window")).collect()] == [3, 1, 2] and [r.company_id for r in df.orderBy(*ordered(df, "fit")).collect()] == [3, 1, 2]
    assert [(r.company_id, r.deals) for r in representatives(df.where("region is not null"), "region").collect()] == [(3, 2)]


def test_events_and_candidates(spark):
    day, as_of = D(2024, 5, 3), D(2024, 6, 1)
    none = lambda schema: spark.createDataFrame([], schema)
    parties = spark.createDataFrame([(1, 10, "main_epc", None, day, day, 1), (1, 10, "main_epc", None, D(2024, 5, 9), day, 2), (1, 11, "subcontractor", 5, None, day, 3), (2, 12, "supplier", 7, day, day, 4), (2, 13, "owner", None, day, day, 5)], "project_id long, company_id long, role string, package_id long, award_date date, seen date, evidence_id long")
    tenders = spark.createDataFrame([(3, 20, None, "T1", day, D(2024, 6, 10), "open", "prequal", 6), (3, 20, None, "T2", day, D(2024, 5, 1), "open", "x", 7), (3, 20, None, "T3", None, None, "closed", "x", 8)], "project_id long, buyer_id long, package_id long, ref string, issued date, closing date, status string, route string, evidence_id long")
    stages = spark.createDataFrame([(4, 30, "feed", None, day, True, 9), (4, 30, "epc_tender", day, day, True, 10), (5, 30, "epc_tender", day, day, False, 11)], "project_id long, owner_id long, stage string, event_date date, seen date, tendered boolean, evidence_id long")
    edges = none("type string, from_id long, to_id long, project_id long, package_id long, event_date date, seen date, evidence_id long")
    events = signals.upserted(signals.signals(parties, edges, stages, tenders, none("project_id long, company_id long, posted date, evidence_id long"), as_of))
    got = sorted((r.type, r.company_id, str(r.signal_date), r.evidence_ids) for r in events.collect())
    assert got == [("contract_awarded", 10, "2024-05-03", [1, 2]), ("contract_awarded", 12, "2024-05-03", [4]), ("feed_awarded", 30, "2024-05-03", [9]), ("prequalification_opened", 20, "2024-05-03", [6]), ("subcontract_awarded", 11, "2024-05-03", [3]), ("tender_closing_soon", 20, "2024-06-01", [6]), ("tender_released", 30, "2024-05-03", [11])]
    packages = spark.createDataFrame([(1, 5, 11), (1, 6, None), (1, 8, 10)], "project_id long, package_id long, owner_id long")
    leads = {(r.kind, r.buyer_id, r.project_id, r.package_id) for r in signals.candidates(events, packages).collect()}
    supply = "supply_subcontract"
    assert leads == {("bid", 20, 3, None), ("bid", 30, 4, None), ("bid", 30, 5, None), (supply, 10, 1, 6), (supply, 10, 1, 8), (supply, 11, 1, 5), (supply, 12, 2, None)}


def test_rubric(spark):
    assert sum(rubric.MOST.values()) == 100 and len(rubric.MOST) == 19
    full = {"core": True, "spec": "within", "sector": "own", "size": "within", "size_of": "contract", "kind": "bid", "tender_open": True, "deadline_days": 30, "latest_days": 0, "kinds_90d": 2, "authority": "self", "awarded": True, "similar": 3, "active": True, "listed": True, "person": True, "customer": True, "rivals": 2, "delivery": "served"}
    kinds = {"core": "boolean", "adjacent": "boolean", "spec": "string", "sector": "string", "size": "string", "size_of": "string", "kind": "string", "tender_open": "boolean", "stage": "string", "funding": "string", "award_months": "double", "deadline_days": "int", "latest_days": "int", "kinds_90d": "int", "authority": "string", "package_owner": "string", "typical": "boolean", "awarded": "boolean", "government_budget": "boolean", "similar": "int", "history": "int", "active": "boolean", "listed": "boolean", "rule_missing": "boolean", "rule_unknown": "boolean", "person": "boolean", "channel": "boolean", "closed_list": "boolean", "customer": "boolean", "rivals": "int", "delivery": "string"}
    df = spark.createDataFrame([tuple(full.get(k) for k in kinds), tuple("supply" if k == "kind" else None for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))
    best, bare = rubric.totals(rubric.points(df)).orderBy(F.desc("score")).collect()
    assert (best.score, best.unknown) == (97, "") and (best.c1, best.c2, best.c3, best.c4, best.c5) == (25, 20, 20, 17, 15)
    assert bare.score == 10 and bare.unknown == "p12,p14,p22,p31,p33,p42,p43,p51,p52,p53"


def test_facts(spark):
    texts = {
        "Acme Pipes has awarded Zeta Works an EPC contract worth USD 450 million on 3 March 2024.": ("awarded", "Acme Pipes", "Zeta Works", "main_epc", 450_000_000, "2024-03-03"),
        "Zeta Works bagged a Rs 2.34 crore pipe order from Acme Gas. It was signed on 2024-05-06.": ("awarded", "Acme Gas", "Zeta Works", "supplier", 281_928, "2024-05-06"),
        "UAE's Emarat subcontracted the piping works to Zeta Works.": ("awarded", "Emarat", "Zeta Works", "subcontractor", None, None),
        "Acme Gas has invited bids for a plant. Tender No: AB-12/7. Bids are due by 5 June 2024.": ("epc_tender", "Acme Gas", None, None, None, None),
        "Nothing happened.": ("unknown", None, None, None, None, None),
    }
    df = extract.facts(spark.createDataFrame([(t,) for t in texts], "t string"), "t", F.col("t"))
    got = {r.t: (r.stage, r.awarder, r.awardee, r.role, r.usd, r.award_date) for r in df.collect()}
    assert got == texts
    tender = df.where("stage = 'epc_tender'").first()
    assert (tender.tender_ref, tender.closing_date) == ("AB-12/7", "2024-06-05")


def test_candidates_read_their_facts_few_times(spark, sf_dir):
    from leadlens.catalog import queries

    reads = lambda name: queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("l_shipdate")
    scans = lambda name: queries()[name](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString().count("lineitem.parquet")
    assert reads("signal_upsert") and scans("signal_upsert") <= 2 and scans("build_candidates") <= 5


def test_events_stay_where_their_order_lies(spark, sf_dir):
    """Orders' events are grouped, and meet their packages, without a shuffle or a list of their own: only tables are dealt, by order."""
    from leadlens.catalog import queries

    for name in ("build_candidates", "signal_upsert"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert dealt and not [line for line in dealt if "project_id" in line or "l_suppkey" in line or "fingerprint" in line], name


def test_candidates_of_odd_lines(spark, sf_dir, tmp_path):
    import duckdb

    from leadlens.catalog import oracle_sql, queries

    con, tables = duckdb.connect(), ("lineitem", "orders", "events")
    for name in tables:
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    con.execute("UPDATE lineitem SET l_suppkey = NULL WHERE l_orderkey % 7 = 0 AND l_linenumber < 3")
    con.execute("UPDATE lineitem SET l_orderkey = NULL WHERE l_orderkey % 11 = 0")
    con.execute("UPDATE lineitem SET l_partkey = 1 WHERE l_orderkey % 5 = 0")
    con.execute("INSERT INTO lineitem SELECT * FROM lineitem WHERE l_orderkey % 3 = 0")
    con.execute("UPDATE orders SET o_custkey = NULL WHERE o_orderkey % 17 = 0")
    con.execute("UPDATE events SET user_id = NULL WHERE event_id % 9 = 0")
    for name in tables:
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    for name in ("build_candidates", "signal_upsert"):
        want = sorted(con.execute(oracle_sql()[name]).fetchall(), key=str)
        assert sorted(map(tuple, queries()[name](spark, str(tmp_path)).collect()), key=str) == want, name


def test_named_events_give_the_same_candidates(spark):
    rows = spark.createDataFrame([("tender_released", D(2024, 5, d), 1, 2, None, "T", d) for d in (1, 2, 31)] + [("contract_awarded", D(2024, m, 3), 4, 2, None, None, m) for m in (1, 2)] + [("hiring_project_roles", D(2024, 1, 1), 4, None, None, None, 9), ("tender_closing_soon", D(2024, 1, 1), 4, 2, None, None, 9), ("contract_awarded", D(2024, 1, 1), None, 2, 7, None, 9)], "type string, signal_date date, company_id long, project_id long, package_id long, tender_ref string, evidence_id long")
    packages = spark.createDataFrame([(2, 7, None), (2, 8, 4), (2, 9, 1)], "project_id long, package_id long, owner_id long")
    got = [sorted(map(tuple, signals.candidates(made(rows), packages).collect()), key=str) for made in (signals.upserted, signals.named)]
    assert got[0] == got[1] == sorted([("bid", 1, 2, None, 1), ("supply_subcontract", 4, 2, 7, 2), ("supply_subcontract", 4, 2, 8, 2), ("supply_subcontract", 4, None, None, 1)], key=str)
