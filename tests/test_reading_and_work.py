"""Focused texts, dictionaries, page identity, teams, as-of joins and versioned tables against plain versions."""

import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from leadlens.operators import dictionary, identity
from leadlens.operators.asof import as_of
from leadlens.operators.focus import Focus, focus_text
from leadlens.operators.teams import Slot, team_slots
from leadlens.sources.versions import Conflict, Versions

FOCUS = Focus({30: ("won",), 20: ("epc",), 10: ("build",)}, ("pump", "valve"), limit=400, head=20, shortest=15, line=(60, 8))


def plain_focus(text, f):
    words = lambda p: set(re.findall(r"[^\W_]+", p.lower()))
    worth = lambda p: max([k for k, v in f.points.items() if words(p) & set(v)], default=0)
    parts = re.split("\n+", text)
    about = [bool(words(p) & set(f.about)) for p in parts]
    ranked = sorted((-worth(p), n) for n, p in enumerate(parts) if worth(p) and len(p) >= f.shortest and any(about[max(0, n - 1) : n + 2]))
    if not ranked:
        lines, offset = text.split("\n"), 0
        for line in lines:
            if len(line) >= f.line[0] and len(re.split(r"\s+", line)) >= f.line[1] and worth(line):
                start = max(0, offset - 200)
                return ((lines[0] + "\n" if start else "") + text[start : start + f.stretch])[: f.limit]
            offset += len(line) + 1
        return text[: f.stretch][: f.limit]
    out, seen = text[: f.head], set()
    for _, n in ranked:
        for k in (n, n - 1, n + 1):
            if 0 <= k < len(parts) and k not in seen and len(parts[k]) >= 10 and len(out) + len(parts[k]) + 1 <= f.limit:
                seen.add(k)
                out += "\n" + parts[k]
    return out


def test_focus(spark):
    rng = random.Random(7)
    words = ["won", "EPC", "build", "pump", "valve", *["some", "other", "words", "of", "text", "é"] * 3]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 2, 6, 20, 40]))) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    texts += ["", "\n\n", "x" * 3000, "no " * 400, "\n".join(["short"] * 60 + ["they build " + "long " * 20])]
    got = {r.t: r.f for r in spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", focus_text(F.col("t"), FOCUS).alias("f")).collect()}
    assert got.pop(None) is None
    assert got == {t: plain_focus(t, FOCUS) for t in texts} and all(len(f) <= FOCUS.limit for f in got.values())


def test_dictionary(spark):
    phrases = [("a", "line pipe"), ("a", "API 5L"), ("b", "gate valve"), ("c", "pump"), ("d", "heat exchanger tube")]
    texts = ["Line-pipes were laid", "a linepipe", "in line  pipe", "line, pipe", "pipe line", "headline pipe", "GATE VALVES!", "gatevalve", "pumps; api 5l.", "pumping", "heatexchanger tubes", "heat exchangertube", "he at exchanger tube", "", None, "xpump"]
    forms = {p: re.compile(r"(?<![^\W_])" + r"[\s-]?".join(map(re.escape, p.lower().split(" "))) + r"s?(?![^\W_])") for _, p in phrases}
    want = {(i, item, p) for i, t in enumerate(texts) for item, p in phrases if forms[p].search((t or "").lower())}
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    found = dictionary.hits(df, "id", F.col("t"), spark.createDataFrame(phrases, "item string, phrase string"))
    assert {(r.id, r["item"], r.phrase) for r in found.collect()} == want
    assert found.count() == len(want)


def test_one_long_line_is_linear(spark):
    import time

    words = " ".join(f"w{i}" for i in range(30_000))
    df = spark.createDataFrame([(1, words + " gate valves " + words), (2, words)], "id long, t string")
    began = time.perf_counter()
    got = dictionary.items_in(df, "id", F.col("t"), spark.createDataFrame([("b", "gate valve")], "item string, phrase string")).collect()
    assert [(r.id, r["item"]) for r in got] == [(1, "b")] and time.perf_counter() - began < 60


def test_kinds_of_work(spark):
    uses = [("lng", "lng", True), ("lng", "terminal", True), ("lng", "tank", False), ("lng", "regas", False), ("bare", "boiler", False)]
    df = spark.createDataFrame([(0, "An LNG export terminal."), (1, "LNG here. A terminal there."), (2, "Tanks and regas"), (3, "a tank"), (4, "boilers")], "id long, t string")
    got = dictionary.works_in(df, "id", F.col("t"), spark.createDataFrame(uses, "item string, phrase string, core boolean"))
    assert {(r.id, r["item"]) for r in got.collect()} == {(0, "lng"), (2, "lng")}


@pytest.mark.parametrize(
    ("url", "title", "text", "want"),
    [
        ("https://www.sjsenersol.com/x", "Piping Fabrication - UAE", "we are sjs enersol and SJS Enersol builds", "SJS Enersol"),
        ("https://atlas.example.com", "Home | Atlas Electrical Contracting LLC", "", "Atlas Electrical Contracting LLC"),
        ("https://maec.com.sa/s", "Services : MAEC Contracting Company", "", "MAEC Contracting Company"),
        ("https://news.example.com", "Acme Group wins order", "", None),
        ("https://acmegroup.com/careers/1", "Acme Group Holding", "", None),
        ("https://linkedin.com/company/acme", "Acme Group", "", None),
        ("https://abcdefgh.com", "Pipe bends", "Ab Cd Ef G H and abcdefgh", None),
        ("https://abcdefgh.com", "Pipe bends", "Ab, Cd-Ef GH", "Ab, Cd-Ef GH"),
        ("not a url", None, None, None),
    ],
)
def test_page_company(spark, url, title, text, want):
    df = spark.createDataFrame([(url, title, text)], "u string, t string, x string")
    assert df.select(identity.page_company(F.col("u"), F.col("t"), F.col("x"))).first()[0] == want


def test_page_identity_with_words_that_go_on(spark, tmp_path):
    import duckdb

    from leadlens.catalog import oracle_sql, queries

    texts = ["The respond", "of THE RES theres", "there's The res, The respond", "the res Theres", "The ſtheres The reſ", "Th-E  r!es?", "T h e r es", "& The res&", "xThe res"]
    pages = [(i, "https://www.theres.com/x", f"<p>{t}</p>") for i, t in enumerate(texts)] + [(90, "https://tank1.com/", "Tan\u212a 12 and Tank 1"), (91, None, None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.letters, r.company) for r in queries()["page_identity"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r[1:] for r in con.sql(oracle_sql()["page_identity"]).fetchall()}
    assert got[0] == ("theres", "The res")


def test_teams(spark):
    rng = random.Random(3)
    slots = [Slot("head", ("h",), ("h",)), Slot("mid", ("m", "h"), ("m",)), Slot("any", ("h", "m", "x"), ("x", "m")), Slot("none", (), ())]
    people = [(c, i * 10 + c, rng.choice(["h", "m", "x", None]), rng.choice(["h", "m", "x", None]), rng.choice([None] * 6 + ["any", "none", "mid"])) for c in range(30) for i in range(rng.randint(0, 7))]
    want = {}
    for c in {p[0] for p in people}:
        own, filled = sorted(p for p in people if p[0] == c), {}
        tests = (lambda p, s: p[4] == s.name, lambda p, s: p[2] is not None and p[2] in s.titles, lambda p, s: p[2] is None and p[3] in s.roles)
        for fits in tests:
            for s in slots:
                if s.name not in filled:
                    one = next((p[1] for p in own if p[1] not in filled.values() and fits(p, s)), None)
                    if one is not None:
                        filled[s.name] = one
        want |= {(c, s.name): filled.get(s.name) for s in slots}
    got = team_slots(spark.createDataFrame(people, "company long, person long, title string, role string, slot string"), slots).collect()
    assert {(r.company, r.slot): r.person for r in got} == want and len(got) == len(want)


def test_as_of(spark):
    rng, day = random.Random(9), lambda: date(2020, 1, 1) + timedelta(rng.randint(0, 800))
    left = [(i, rng.choice([1, 2, 3, None]), day() if rng.random() < 0.95 else None) for i in range(300)]
    right = [(rng.choice([1, 2, None]), day(), rng.randint(0, 9)) for _ in range(80)]
    right += [(1, right[0][1], 99), (1, None, 5)]
    got = as_of(spark.createDataFrame(left, "id long, k long, d date"), spark.createDataFrame(right, "k long, d date, v long"), "k", "d", "v")
    want = {i: max(((d, v) for key, d, v in right if k is not None and key == k and d is not None and t is not None and d <= t), default=(None, None))[1] for i, k, t in left}
    assert {r.id: r.v for r in got.collect()} == want and got.columns == ["id", "k", "d", "v"]
    assert as_of(spark.createDataFrame(left, "id long, k long, d date"), spark.createDataFrame([], "k long, d date, v long"), "k", "d", "v").where("v is null").count() == 300


def test_versions(spark, tmp_path):
    table = Versions(spark, str(tmp_path / "t"), "k long, at int, v string", ["k"], buckets=4)
    assert table.read().count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "k long, at int, v string")
    content = lambda: {r.k: (r["at"], r.v) for r in table.read().collect()}
    assert table.upsert(rows((1, 1, "a"), (2, 1, "b"), (2, 3, "c"), (None, 1, "x")), "one", "at")
    assert content() == {1: (1, "a"), 2: (3, "c")}
    assert not table.upsert(rows((1, 9, "again")), "one", "at")  # tried again
    table.upsert(rows((1, 1, "tie"), (2, 2, "old"), (3, 1, "new")), "two", "at")
    table.upsert(rows((1, 9, "no"), (4, 1, "yes")), "three", "at", insert_only=True)
    table.upsert(rows(), "empty", "at")
    assert content() == {1: (1, "tie"), 2: (3, "c"), 3: (1, "new"), 4: (1, "yes")}
    # A writer that began from the same manifest as another one fails and leaves the table as it is.
    number, manifest = table._manifest()
    with pytest.raises(Conflict):
        table._commit(number, manifest)
    assert content()[3] == (1, "new") and not [p for p in (tmp_path / "t" / "manifests").iterdir() if "draft" in p.name and p.suffix != ".crc"]
