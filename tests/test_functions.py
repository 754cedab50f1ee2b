import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from leadlens.functions import dates, evidence, fuzzy, money, names, rules, textual, urls
from leadlens.operators import ranking as rk
from leadlens.operators.filters import LeadFilter, at_least, like_literal
from leadlens.operators.resolve import resolve_companies
from leadlens.operators.scalars import compact_usd, noisy_or, retry_delay
from leadlens.sources import readers, sinks


def one(spark, column, *values):
    names_ = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'string' if isinstance(v, str) or v is None else 'double'}" for n, v in zip(names_, values, strict=True))
    return spark.createDataFrame([tuple(values)], schema).select(column(*map(F.col, names_)).alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("USD 450 million", (450e6, "USD", 450_000_000)), ("Rs 1,250 crore", (1.25e10, "INR", 150_602_410)), ("35000000 NOK", (35e6, "NOK", 3_333_333)), ("no sum", None), ("", None), (None, None)])
def test_parse_money(spark, text, want):
    got = one(spark, money.parse_money, text)
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("text", "want"), [("on 2026-08-12", "2026-08-12"), ("12th August 2026", "2026-08-12"), ("Aug. 3, 2026", "2026-08-03"), ("03/04/2026", "2026-04-03"), ("by March 2027", "2027-03-01"), ("2026-13-01", None), ("1980-01-01", None), ("never", None), (None, None)])
def test_parse_date(spark, text, want):
    assert one(spark, dates.parse_date, text) == want


@pytest.mark.parametrize(("name", "want"), [("Société Générale S.A.", "societe generale s a"), ("The Acme & Sons Co. Ltd.", "acme and sons"), ("Limited", "limited"), ("Foo (Holding) LLC", "foo"), (None, None)])
def test_company_key(spark, name, want):
    assert one(spark, names.company_key, name) == want


def test_names(spark):
    assert tuple(one(spark, names.name_parts, "Big Oil Co. (Biggy)")) == ("Big Oil Co.", ["Biggy"])
    assert tuple(one(spark, names.name_parts, "East Pipes, or EPIC")) == ("East Pipes", ["EPIC"])
    assert tuple(one(spark, names.name_parts, 'East Pipes, or "EPIC" (Easty)')) == ("East Pipes", ["Easty", "EPIC"])
    assert [tuple(one(spark, names.name_parts, n)) for n in ("Plain, Ltd.", "(Odd)", "A (B) C")] == [("Plain, Ltd.", []), ("(Odd)", []), ("A (B) C", [])]
    assert set(one(spark, names.company_keys, "Saudi Arabian Oil Co. (Saudi Aramco)")) == {"saudi arabian oil", "saudi aramco", "known:aramco"}
    assert [one(spark, names.tidy_company, n) for n in ("Wednesday.GMDA", "UAE's Emarat", "Dubai-based Acme;", "The UAE", "Saudi Arabia", "Acme")] == ["GMDA", "Emarat", "Acme", None, None, "Acme"]
    assert one(spark, names.display_name, "East Pipes, or EPIC") == "East Pipes (EPIC)"
    assert one(spark, names.variant_key, "Welding Corp Associate Unit") == "welding"
    assert set(one(spark, names.company_keys, "Big Oil Division (Biggy)")) == {"big oil division", "big oil", "biggy"}
    assert one(spark, names.person_key, "Dr. José  O'Neil") == "jose o neil"
    assert one(spark, names.project_key, "The Red Sea Project - Phase 2") == "red sea 2"


@pytest.mark.parametrize(("a", "b", "want"), [("same", "same", 100), ("", "x", 0), ("example pipelines", "example pipelines india", 100), ("kitten", "sitting", 57)])
def test_token_set_ratio(spark, a, b, want):
    assert one(spark, fuzzy.token_set_ratio, a, b) == want


def test_values_agree(spark):
    agree = lambda k, a, b: one(spark, fuzzy.values_agree, k, a, b)
    assert agree("number", "1,000", "1009") and not agree("number", "1000", "1020")
    assert agree("date", "2026-08", "2026-08-12") and not agree("date", "2026-08-11", "2026-08-12")
    assert agree("enum", "Open", "open") and not agree("enum", "open", None)


@pytest.mark.parametrize(("url", "want"), [("https://WWW.Foo.com/a/?utm_source=x&b=1#top", "https://foo.com/a/?b=1"), ("https://foo.com/a/", "https://foo.com/a"), ("https://foo.com", "https://foo.com/"), ("not a url ", "not a url")])
def test_canonical(spark, url, want):
    assert one(spark, urls.canonical, url) == want


@pytest.mark.parametrize(("url", "want"), [("https://energy.a.indiatimes.com/x", "indiatimes.com"), ("https://x.y.co.uk", "y.co.uk"), ("https://foo.com", "foo.com"), ("nonsense", "unknown")])
def test_publisher(spark, url, want):
    assert one(spark, urls.publisher, url) == want


def test_dates(spark):
    day = lambda t: [(d.y, d.m, d.d) for d in one(spark, dates.dates_in, t)]
    assert day("15 March 2026, then 2026-03 and April 1st, 2027 or 3/4/2025; 2026-01-10") == [(2026, 3, 15), (2026, 3, None), (2027, 4, 1), (2025, 4, 3), (2026, 1, 10)]
    backed = lambda v, q: one(spark, dates.date_backed, v, q)
    month, exact = "The tender closes in March 2026", "Bids are due by 15 March 2026"
    assert [backed(v, month) for v in ("15 March 2026", "2026-03-15", "March 2026", "2026-03", "April 2026")] == [False, False, True, True, False]
    assert [backed(v, exact) for v in ("2026-03-15", "2026-03-16", "5 March 2026", "March 2026")] == [True, False, False, True]


def test_dates_are_found_by_one_pattern(spark):
    assert [(d.y, d.m, d.d) for d in one(spark, dates.dates_in, "15 March 2024-05-06, No. 2024-01-02-03 of 7 th. of May 2023")] == [(2024, 3, 15), (2024, 5, 6), (2024, 1, 2), (2023, 5, 7)]
    assert one(spark, dates.dates_in, None) == [] and one(spark, dates.parse_date, "X-2024-05-06 1st May 2020") == "2020-05-01"
    plan = spark.range(1).select(dates.dates_in(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan  # no window is made for each token


def test_a_backed_date_is_read_once(spark):
    df = spark.createDataFrame([("2026-03-15", "due by 15 March 2026"), ("soon", "due Soon"), (None, "x")], "v string, q string")
    out = df.select(evidence.value_backed(F.col("v"), F.col("q"), F.lit("date")).alias("b"))
    assert [r.b for r in out.collect()] == [True, True, False]
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 2 * df.select(dates.dates_in(F.col("v")))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all")


def test_money_behind_signs_of_two_units(spark):
    assert [(m.currency, m.amount) for m in (one(spark, money.parse_money, t) for t in ("😀😀 USD 5 million", "é 7 bn EUR", "x USD 1,200"))] == [("USD", 5e6), ("EUR", 7e9), ("USD", 1200.0)]


def test_numbers(spark):
    backed = lambda v, q: one(spark, money.number_backed, v, q)
    assert backed("14,500,000,000", "valued at Rs 1,450 crore") and backed("24", "120 km of 24-inch") and not backed("25", "24-inch")
    assert not backed("USD 1.2 billion", "1.2 km of pipe") and backed("USD 1,200 million", "a USD 1.2 billion order")
    assert not backed("EUR 1.2 billion", "a USD 1.2 billion order") and not backed("120 km 36-inch", "120 km of 24-inch")


DOC = "Example Infra Projects Ltd has received an EPC order from Example Gas Transmission Ltd.\nThe order is valued at Rs 1,450 crore. It covers   120 km of 24-inch API 5L X65 line pipe, per the “filing”."


def test_quotes(spark):
    how = lambda q: one(spark, evidence.found_quote, DOC, q).how
    assert how("an EPC order from Example Gas") == "exact" and how('covers 120 KM of 24-inch API 5L X65 line pipe, per the "filing"') == "same"
    assert how("Example Infra Projects Ltd has recieved an EPC order from Example Gas Transmission Ltd") == "near" and how("awarded to Example Pipes") == "none" and how("") == "none"
    assert one(spark, evidence.original_quote, DOC, 'covers 120 km of 24-INCH') == "covers   120 km of 24-inch" and one(spark, evidence.original_quote, DOC, 'per the "filing"') == "per the “filing”"
    assert one(spark, evidence.value_backed, "Gas Transmission", "an order from Example Gas  transmission ltd", "name") and not one(spark, evidence.value_backed, "X70", "API 5L X65", "text")


def test_sentences(spark):
    text = "Acme Ltd. won it. Mr. Khan said so! It has 5.5 km.\nLast line"
    assert one(spark, evidence.sentences, text) == ["Acme Ltd. won it.", "Mr. Khan said so!", "It has 5.5 km.", "Last line"]
    around = lambda a, b: one(spark, lambda c: evidence.sentence_around(c, F.lit(a), F.lit(b)), text)
    assert around(18, 26) == "Mr. Khan said so!" and around(0, 20) == "Acme Ltd. won it. Mr. Khan said so!"
    long = "A " + "word " * 200 + "here the quote stands " + "more " * 200
    cut = one(spark, lambda c: evidence.sentence_around(c, F.lit(long.index("quote")), F.lit(long.index("quote") + 5)), long)
    assert "here the quote stands" in cut and len(cut) <= 420 and long.find(cut) > 0 and cut.split(" ")[0] == "word"


def test_attribution(spark):
    assert one(spark, evidence.names_company, "by ACME-Pipes, Ltd. today", "Acme Pipes Ltd") and not one(spark, evidence.names_company, "AcmePipesLtdx", "Acme Pipes Ltd")
    text = "Acme Pipes builds lines. It installs valves in Oman. Zeta Works fabricates tanks."
    about = lambda q: one(spark, lambda c: evidence.attributed(c, F.lit(q), F.lit("Acme Pipes"), F.lit("Acme Pipes builds lines.")), text)
    assert about("builds lines") == "Acme Pipes builds lines." and about("It installs valves in Oman.") == "Acme Pipes builds lines. It installs valves in Oman."
    assert about("Zeta Works fabricates tanks") is None and about("tanks") is None


def test_rules(spark):
    assert [one(spark, rules.buying_role, x) for x in ("Head of Procurement", "Projects Director", "CEO", "Piping Engineer", "Clerk", None)] == ["procurement_lead", "project_director", "executive", "technical_evaluator", "other", "other"]
    assert [one(spark, rules.seniority, x) for x in ("Chief Procurement Officer", "Head of Projects", "Team lead", "Clerk", None)] == ["executive", "director", "manager", "specialist", None]
    assert [one(spark, rules.junk_name, x) for x in ("Acme Pipes", "Gas Expo 2026", "Ministry of Energy", "UAE", "x", "Top 10 EPC firms", "www.acme.com")] == [None, "event", "government", "place", "length", "headline", "address"]
    kind = lambda u, t, x="": one(spark, rules.page_kind, u, t, x)
    assert kind("https://www.reuters.com/a", "x") == "article" and kind("https://acme.com/", "Steel") == "company_site" and kind("https://acme.com/x", "Top 10 firms") == "roundup"
    assert kind("https://acme.com/filings/1", None) == "filing" and kind("https://x.com/", "Contract award notice") == "tender_notice" and kind("ftp://x.com/", None) == "junk"
    got = one(spark, rules.spec, 'API5L X 65 pipe, 610 mm, iso3183')
    assert (got.grades, got.standards, got.inches) == (["X65"], ["API 5L", "ISO 3183"], 24.0)
    assert one(spark, rules.number_forms, "heat exchanger") == ["heat exchanger", "heat exchangers"] and one(spark, rules.number_forms, "boxes") == ["boxes", "box"] and one(spark, rules.number_forms, "api 660") == ["api 660"]
    assert [str(one(spark, rules.dateline, x)) for x in ("Menu\nDubai, Mar. 5, 2024 - Acme won", "5 March 2024\nText", "On 5 March 2024 it won", "Feb 30, 2024")] == ["2024-03-05", "2024-03-05", "None", "None"]
    score = lambda t: one(spark, lambda c: rules.material_score(c, F.lit("line pipe"), F.array(F.lit("linepipe"), F.lit("steel line pipe")), F.array(F.lit("api 5l"))), t)
    assert [score(t) for t in ("line pipe", "pipe to api 5l", "some linepipe here", "pipe", "valve pipes")] == [100, 90, 68, 45, 18]


def test_texts(spark):
    assert one(spark, textual.match_form, "“Quoted”  –  Text") == '"quoted" - text'
    assert one(spark, textual.clean, " a  b \n\n\n c ") == "a b\nc"
    assert one(spark, lambda c: textual.has_term(c, "pipe"), "a Pipe, here") and not one(spark, lambda c: textual.has_term(c, "pipe"), "pipeline")
    assert one(spark, textual.query_terms, "line pipe, valves and all flanges for hot water") == ["line pipe", "valves", "all flanges for hot water", "flanges", "hot", "water"]
    assert [x.start for x in one(spark, lambda c: textual.chunks(c, 1000), "y" * 1200)] == [0, 500, 1000]
    assert one(spark, textual.csv_cell, "=1+1") == "'=1+1"
    assert one(spark, money.numbers_in, "2 lakh and 1,500 of 3.5 million") == [2e5, 1500.0, 3.5e6]


def test_scalars(spark):
    assert one(spark, lambda c: noisy_or(F.array(c, F.lit(0.5))), 0.5) == 0.75
    assert [one(spark, lambda c: retry_delay(c), float(n)) for n in (1, 2, 9)] == [60, 120, 900]
    assert [one(spark, compact_usd, x) for x in (4_500_000.0, 1_200.0, 3e9, 12.0)] == ["$4.5m", "$1k", "$3bn", "$12"]


def test_filters(spark):
    df = spark.createDataFrame([("a%b", "x", 50, "O"), ("axb", None, 5, "F"), (None, "A%", 99, "O")], "buyer string, place string, score int, status string")
    assert LeadFilter(text="A%").apply(df).count() == 2
    assert LeadFilter(min_score=50.9, one_of={"status": ("O",)}).apply(df).count() == 2
    assert LeadFilter(min_score=float("nan")).apply(df).count() == 3 and at_least("score", 0) is None
    assert LeadFilter(equal={"status": "F"}).apply(df, omit="status").count() == 3
    assert like_literal("50%_\\") == "50\\%\\_\\\\"


def test_greedy_and_reserve():
    rows = pd.DataFrame({"d": ["a", "a", "b", "a"], "n": [1, 2, 3, 4]})
    assert rk.greedy_quota(rows, [{"d": 1}, {"d": 2}], 3)["n"].tolist() == [1, 3, 2]
    assert rk.reserve(pd.DataFrame({"u": [5, 7, 4]}), "u", 10)["state"].tolist() == ["reserved", "exhausted", "reserved"]


def test_upserts(spark):
    stored = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, at int")
    changes = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "k int, v string, at int")
    assert {tuple(r) for r in sinks.upsert(stored, changes, ["k"], "at").collect()} == {(1, "c", 2), (2, "b", 5), (3, "e", 1)}
    assert {r.k for r in sinks.insert_absent(stored, changes.union(changes), ["k"]).collect()} == {3}


def test_resolve(spark):
    companies = spark.createDataFrame([(1, "Acme Pipes Ltd", "IN"), (2, "Zeta Valves", "AE")], "company_id long, name string, country string")
    mentions = spark.createDataFrame([("m1", "ACME Pipes", "IN"), ("m2", "Zeta Valves International", "AE"), ("m3", "Nobody", "AE"), ("m4", None, None)], "mention_id string, name string, country string")
    got = {r.mention_id: (r.company_id, r.certainty) for r in resolve_companies(mentions, companies).collect()}
    assert got == {"m1": (1, 0.9), "m2": (2, 0.85), "m3": (None, 0.6), "m4": (None, 0.6)}


def test_readers(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"notices": [{"publication-number": "1-2026", "buyer-name": "City", "winner-name": ["A", "B"], "value": 5.5, "deadline": "2026-10-01"}]}')
    assert readers.notices(spark, str(tmp_path / "n.json")).first().winners == ["A", "B"]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>Pipe award won</title><link>https://n.example.com/c?url=https%3A%2F%2Fa.example.org%2Fx</link></item><item><title>pipe award won!</title><link>https://b.example.com/y</link></item></channel></rss>")
    feed = readers.feed(spark, str(tmp_path / "f.xml"))
    assert {r.url for r in feed.collect()} == {"https://a.example.org/x", "https://b.example.com/y"}
    assert readers.story_cap(feed, 1).count() == 1
    assert one(spark, lambda c: readers.fill_dates(c, dt.date(2026, 1, 31)), "from {{date:-1}} to {{date:+1}}") == "from 2026-01-30 to 2026-02-01"
    pages = spark.createDataFrame([("https://a.org/private/x",), ("https://a.org/private/open",), ("https://b.org/",)], "url string")
    rules = spark.createDataFrame([("a.org", "/private", False), ("a.org", "/private/open", True)], "host string, path string, allow boolean")
    assert {r.url for r in readers.allowed(pages, rules).collect()} == {"https://a.org/private/open", "https://b.org/"}
    sinks.csv(spark.createDataFrame([("=x", 1)], "a string, b int"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().a == "'=x"
