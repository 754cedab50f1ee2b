"""Facts read from sentences token by token."""

import random

from pyspark.sql import functions as F

from leadlens.functions import dates, money
from leadlens.operators import extract


def sides(text):
    r = extract.read(text)
    return r.awardee, r.role, r.awarder


def test_awards():
    assert sides("Desco Infratech In Focus After Securing Rs2.34 Crore Gas Pipeline Contract From Adani Total Gas") == ("Desco Infratech", "main_epc", "Adani Total Gas")
    assert sides("Man Industries shares surge 10% on securing Rs 600.5 crore pipe orders from GAIL") == ("Man Industries", "supplier", "GAIL")
    assert sides("Jindal SAW bags Rs 1,200 crore order for supply of line pipes.") == ("Jindal SAW", "supplier", None)
    assert sides("Wednesday.GMDA awards contract for 200MLD water pipeline to Larsen Infra Projects.") == ("Larsen Infra Projects", "main_epc", "GMDA")
    assert sides("Acme Gas, which runs the Delta Network, has awarded Zeta Works an EPC contract for valves.") == ("Zeta Works", "main_epc", "Acme Gas")
    assert sides("Dubai-based Emarat was awarded a package by the Zeta Authority.") == ("Emarat", "main_epc", "Zeta Authority")
    assert sides("A consortium of Acme and Zeta won the order from Beta Oil.") == ("Acme and Zeta", "consortium_member", "Beta Oil")
    assert sides("Mr. Khan signed the order on 5 May 2024.")[0] is None and sides("Nothing was awarded.")[0] is None and sides("")[0] is None


def test_parents():
    r = extract.read("Welspun Corp's associate firm wins a steel pipe contract from Aramco")
    assert (r.awardee, r.parent, r.role) == (None, "Welspun Corp", None)
    r = extract.read("Welspun Corp's associate EPIC bags a steel pipe contract from Aramco.")
    assert (r.awardee, r.parent, r.awarder) == ("EPIC", "Welspun Corp", "Aramco")
    r = extract.read("EPIC, a subsidiary of Welspun Corp, has won an order from Aramco.")
    assert (r.awardee, r.parent, r.awarder) == ("EPIC", "Welspun Corp", "Aramco")


def test_tenders_people_projects():
    r = extract.read("Acme Gas has invited bids for the Delta Water Pipeline. Tender No. AB-12/7 closes on 5 June 2024.")
    assert (r.issuer, r.ref, r.closing, r.day, r.project) == ("Acme Gas", "AB-12/7", True, "2024-06-05", "Delta Water Pipeline")
    assert extract.read("Write to Anna Berg, Procurement Manager, or Head of Contracts Omar Said.").people == [{"name": "Anna Berg", "title": "Procurement Manager"}, {"name": "Omar Said", "title": "Head of Contracts"}]
    assert extract.read("Omar Said (Project Director) was there.").people == [{"name": "Omar Said", "title": "Project Director"}]
    assert extract.read("The Gas Pipeline Project is new.").project is None
    assert not extract.read("The manager of it spoke.").people


def test_long_runs_are_linear():
    import time

    began = time.perf_counter()
    extract.read("Aa Bb Cc, " * 20_000 + "won")
    extract.read("Aa " * 60_000 + "won an order from " + "Bb of " * 20_000)
    assert time.perf_counter() - began < 5


def test_same_days_and_amounts_as_columns(spark):
    rng, texts = random.Random(5), []
    bits = ["5 March 2024", "March 5th, 2024", "2024-03-05", "05/03/2024", "March 2024", "3rd of May. 1999", "RF-2024-12-05", "1990-01-01", "32 May 2001", "USD 5 million", "$1,200.5", "Rs 2.34 crore", "7 bn EUR", "SAR46 Million", "USD 90 billion", "12", "word", "may", "sept. 9 2003"]
    for _ in range(400):
        texts.append(" ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))))
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dates.parse_date(F.col("t")).alias("day"), money.plausible_usd(money.parse_money(F.col("t"))).alias("usd"))
    for r in df.collect():
        assert (extract.day_of(r.t), extract.usd_of(r.t)) == (r.day, r.usd), r.t


def test_tender_numbers_are_no_days(spark):
    df = spark.createDataFrame([("Tender No: RF-2024-12. Due 2024-12.",), ("RF-1995-10-11 of 1990-05-06",)], "t string")
    found = [[(d.y, d.m, d.d) for d in r.d] for r in df.select(dates.dates_in(F.col("t")).alias("d")).collect()]
    assert found == [[(2024, 12, None)], [(1990, 5, 6)]]


def test_mentions(spark):
    text = "Beta Oil said little.\nAcme Gas has awarded Zeta Works a contract. Zeta Works subcontracted the piping works to Pipe Makers. Anna Berg, Project Manager, agreed."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = {(r.id, r.name): (r.role, r.place) for r in extract.mentions(df, "id", F.col("t")).collect()}
    assert got == {(1, "Acme Gas"): ("owner", 1), (1, "Zeta Works"): ("main_epc", 1), (1, "Pipe Makers"): ("subcontractor", 2), (1, "Anna Berg"): ("person", 3)}
    assert [r.stage for r in extract.facts(df, "id", F.col("t")).orderBy("id").collect()] == ["awarded", "unknown", "unknown"]


def test_facts_read_their_texts_once(spark, tmp_path):
    texts = [(1, "Acme Gas has awarded Zed Steel a pipe order.\nTender No: RF-1/A."), (2, None), (3, "Nothing.")]
    spark.createDataFrame(texts, "id long, t string").write.parquet(f"{tmp_path}/t")
    out = extract.facts(spark.read.parquet(f"{tmp_path}/t"), "id", F.col("t"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert [(r.id, r.stage, r.awardee, r.tender_ref) for r in out.orderBy("id").collect()] == [(1, "awarded", "Zed Steel", "RF-1/A"), (2, "unknown", None, None), (3, "unknown", None, None)]


def test_led_amounts_are_those_of_the_pattern():
    for text in ("worth US$5 mn", "1,USD 5", "Rs. 30 crore and $2", "USDD5 EUR7", "USD  5", "12 and 13", "$$4bn", "rm3", "x SAR\n9 lakh"):
        led = extract._LED.search(text)
        assert (extract._led(text) or [None])[0] == (led or [None])[0]
