"""The supply tree's rules one by one; late rows and thread timers."""

from datetime import date, datetime, timedelta

from leadlens.catalog import queries
from leadlens.operators.supply import supply_tree
from leadlens.streaming.late import Threads

BUYS = {"epc": ["pipe", "valve"], "pipe": ["steel"], "valve": [], "steel": []}


def tree(spark, relations, manual=(), companies=(), project=1):
    base = [("A", ["epc"], "SA", "GCC"), ("B", ["pipe"], "SA", "GCC"), ("C", ["pipe"], "AE", "GCC"), ("D", ["pipe"], "QA", "GCC"), ("E", ["pipe"], "US", "AM"), ("V", ["valve"], "AE", "GCC"), ("W", ["valve"], "SA", "GCC"), ("S", ["steel"], "US", "AM")]
    made = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    out = supply_tree(made([("r", "A", "epc", project)], "root string, company string, type string, project long"), made([*base, *companies], "company string, types array<string>, place string, region string"), made(relations, "buyer string, supplier string, project long, day date"), made(manual, "parent string, type string, company string, action string, at int"), BUYS)
    return {r.node: (r.company, r.link, r.parent) for r in out.collect()}


def test_links_and_quota(spark):
    day = date(2024, 1, 1)
    rows = [("A", c, 2, day + timedelta(n)) for n, c in enumerate("BCDE")] + [("A", "B", 1, day), ("B", "A", 1, day), ("B", "C", 3, day)]
    got = tree(spark, rows)
    # Of this deal first, then the newest earlier ones, three at most; the valve maker comes from the directory, of the same country first.
    assert [got[f"t2:pipe{x}"][:2] for x in ("", ":2", ":3")] == [("B", "confirmed"), ("E", "likely"), ("D", "likely")] and "t2:pipe:4" not in got
    assert got["t2:valve"] == ("W", "possible", "t1")
    # B's children: never A, who stands above; C is a pipe maker, which B doesn't buy, and still its supplier; steel is open in its region.
    assert got["t3:pipe:pipe"] == ("C", "likely", "t2:pipe") and got["t3:pipe:steel"] == (None, "not_identified", "t2:pipe")
    # A node of a type that buys nothing isn't expanded.
    assert not [n for n in got if n.startswith("t3:valve")]


def test_manual_links(spark):
    day = date(2024, 1, 1)
    rows = [("A", "B", 1, day), ("A", "C", 2, day)]
    got = tree(spark, rows, [("A", "pipe", "B", "removed", 1), ("A", "valve", "V", "set", 1), ("A", "pipe", "D", "removed", 1), ("A", "pipe", "D", "set", 2)])
    # Removed for the type; set by hand; of two actions the later one holds.
    assert {got[n][0] for n in ("t2:pipe", "t2:pipe:2")} == {"C", "D"} and "t2:pipe:3" not in got
    assert got["t2:valve"][:2] == ("V", "confirmed")
    # A company that is set for one type isn't a supplier of another.
    assert tree(spark, rows, [("A", "valve", "B", "set", 1)])["t2:valve"][0] == "B" and tree(spark, rows, [("A", "valve", "B", "set", 1)])["t2:pipe"][0] == "C"


def test_directory_takes_nobody_twice(spark):
    both = [("X", ["valve", "pipe"], "SA", "GCC")]
    got = tree(spark, [("A", "S", 9, date(2024, 1, 1))], companies=both)
    assert got["t2:pipe"][0] == "B" and got["t2:valve"][0] == "W" and got["t2:steel"][:2] == ("S", "likely")
    only = tree(spark, [], [("A", "pipe", c, "removed", 1) for c in "BCD"] + [("A", "valve", c, "removed", 1) for c in "VW"], companies=both)
    assert only["t2:pipe"][0] == "X" and only["t2:valve"] == (None, "not_identified", "t1")


def test_no_company_below_itself(spark, sf_dir):
    rows = {(r.root, r.node): r for r in queries()["supply_chain_tree"](spark, sf_dir).collect()}
    for (root, _), r in rows.items():
        seen, up = [], r
        while up is not None:
            seen += [up.company] * (up.company is not None)
            up = rows.get((root, up.parent))
        assert len(seen) == len(set(seen))


def test_late_rows_are_dropped(spark, sf_dir):
    alone = {r.slice: r.dropped for r in queries()["stream_late_rows"](spark, sf_dir).collect()}
    merged = {r.slice: r.dropped for r in queries()["stream_late_source"](spark, sf_dir).collect()}
    assert sum(alone.values()) > sum(merged.values()) and alone[0] == alone[1] == 0


def test_thread_rules():
    hour = 3_600_000_000
    t = Threads(timedelta(hours=2), 1, timedelta(hours=10))
    assert t.message(None, 0, None, 0, "in") == (None, 0, None, None)
    assert t.message(None, 0, None, 0, "out") == ("active", 0, 2 * hour, "sent")
    assert t.timed("active", 0, 2 * hour) == ("active", 1, 4 * hour, "follow_up")
    assert t.timed("active", 1, 4 * hour) == ("review", 1, 14 * hour, "review")
    assert t.message("active", 1, 4 * hour, 3 * hour, "in") == ("engaged", 1, 13 * hour, "replied")
    assert t.message("active", 1, 4 * hour, 3 * hour, "out") == ("active", 1, 4 * hour, None)
    assert t.timed("engaged", 1, 13 * hour) == (None, 0, None, "ended") and t.message("booked", 0, 1, 2, "booked")[3] is None


def test_thread_steps_in_any_order(spark, tmp_path):
    """Rows of a batch in any order, and a row that comes a batch later but in time, are taken by time."""
    from leadlens.streaming import jobs, late

    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = [(1, 2, at(5), "in", 0), (1, 1, at(0), "out", 1), (2, 3, at(1), "out", 0), (3, 5, at(200), "x", 2), (3, 6, at(201), "x", 3)]
    df = spark.createDataFrame(rows, "thread long, row_id long, ts timestamp, kind string, s int")
    stream = late.delivered(spark, late.sliced(df, df.s, 4), "thread long, row_id long, ts timestamp, kind string")
    with late.rocks(spark):
        out = jobs.drained(late.thread_steps(stream, "20 hours", timedelta(hours=8), 1, timedelta(hours=40)))
    got = sorted((r.thread, int((r["at"] - at(0)).total_seconds() // 3600), r.step) for r in out.collect())
    assert got == [(1, 0, "sent"), (1, 5, "replied"), (1, 45, "ended"), (2, 1, "sent"), (2, 9, "follow_up"), (2, 17, "review"), (2, 57, "ended")]


def test_a_thread_has_one_timer_for_all_rows_that_came():
    from leadlens.streaming.late import Threads

    calls = []

    class State:
        def __getattr__(self, name):
            return lambda *a: calls.append((name, a))

    t = Threads(36, 2, 96)
    t.handle = t.waiting = t.thread = State()
    rows = [type("R", (), {"us": us, "row_id": i, "kind": "out"})() for i, us in enumerate((9_000, 5_500, 7_000))]
    assert list(t.handleInputRows((1,), iter(rows), None)) == []
    assert [c for c in calls if c[0] == "registerTimer"] == [("registerTimer", (6,))]


def test_tree_of_odd_lines_and_what_it_stores(spark, sf_dir, tmp_path):
    """Lines whose part or supplier isn't known, without a number, or with a part that is there twice; what is stored is a few bytes a line."""
    import subprocess

    import duckdb

    from leadlens.catalog import oracle_sql

    con = duckdb.connect()
    for name in ("lineitem", "part", "supplier", "orders", "nation"):
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    con.execute("UPDATE lineitem SET l_partkey = 1000000 + l_partkey WHERE l_partkey % 3 = 0")
    con.execute("UPDATE lineitem SET l_suppkey = 7000 WHERE l_orderkey % 5 = 0 AND l_linenumber = 2")
    con.execute("UPDATE lineitem SET l_suppkey = NULL WHERE l_orderkey % 7 = 0 AND l_linenumber = 1")
    con.execute("UPDATE lineitem SET l_orderkey = NULL WHERE l_orderkey % 11 = 0")
    con.execute("INSERT INTO part SELECT * FROM part WHERE p_partkey % 4 = 1")
    for name in ("lineitem", "part", "supplier", "orders", "nation"):
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    want = sorted(con.execute(oracle_sql()["supply_chain_tree"]).fetchall(), key=str)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path / "steps"))
    size = lambda: int(subprocess.run(["du", "-sb", spark.sparkContext.getCheckpointDir().removeprefix("file:")], capture_output=True, text=True).stdout.split()[0])
    before = size()
    got = queries()["supply_chain_tree"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == want and {r[6] for r in want} >= {"confirmed", "likely"}
    assert size() - before < 60 * con.execute("SELECT count(*) FROM lineitem").fetchone()[0]
