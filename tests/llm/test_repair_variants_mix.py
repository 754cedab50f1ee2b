"""Conversation repair, spelling variants and mixing against plain versions and DuckDB."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from tests.llm.helpers import frame, rows

from leadlens.llm import mixing, queries, repair, variants

NAMES = ["op11_conversation_repair", "op12_spelling_variants", "op13_entropy_balanced_mix"]


def plain(v):
    if isinstance(v, float):
        return None if v != v else int(v) if v == int(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"create view {f[:-8]} as select * from '{sf_dir}/{f}'")
    got = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert Counter(tuple(map(plain, r)) for r in got.select(*cols).collect()) == Counter(tuple(map(plain, r)) for r in want.select(*cols).fetchall())


# Conversation repair


def cheapest(turns):
    """(cost, edits) by trying every edit string of increasing cost; turns are (letter, fault)."""

    def walk(i, state, ins):
        if i == len(turns) and state in (0, 3):
            yield 0, ""
        for role in "ua":
            if ins < 2 and (state, role) in repair.GRAMMAR:
                for c, e in walk(i, repair.GRAMMAR[state, role], ins + 1):
                    yield c + 3, "I" + e
        if i < len(turns):
            letter, fault = turns[i]
            for c, e in walk(i + 1, state, 0):
                yield c + 4, "D" + e
            if fault in "-t":
                more = 3 if fault == "t" else 0
                if (state, letter) in repair.GRAMMAR:
                    for c, e in walk(i + 1, repair.GRAMMAR[state, letter], 0):
                        yield c + more, "K" + e
                for role in "ua":
                    if (state, role) in repair.GRAMMAR:
                        for c, e in walk(i + 1, repair.GRAMMAR[state, role], 0):
                            yield c + 3 + more, "R" + e

    return min(walk(0, 0, 0))


def best(ways):
    return min(ways[0][e] for e in repair.ENDS if e in ways[0])


def test_shortest_paths():
    for n in range(4):
        for turns in itertools.product(itertools.product("sua?", "-tb"), repeat=n):
            assert best(repair.reduced("".join(a + b for a, b in turns))) == cheapest(turns)


def test_reductions_are_associative():
    rng = random.Random(2)
    for _ in range(200):
        turns = [rng.choice("sua?") + rng.choice("---tbd") for _ in range(rng.randint(2, 9))]
        cut = rng.randint(1, len(turns) - 1)
        whole = repair.reduced("".join(turns))
        assert repair.joined(repair.reduced("".join(turns[:cut])), repair.reduced("".join(turns[cut:]))) == whole


def brute_conversations(data):
    """By the contract's words, for turns of different numbers or equal rows."""
    out = {}
    for conv in {c for c, *_ in data}:
        turns = []
        for c, turn, role, text, *_ in data:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            turns += [] if h == 0 else [row, row] if h == 3 else [row]
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\x0b\x0c\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
            seen.add((role, text))
        letters = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "?" for r in turns]
        numbers = [r[0] for r in turns if r[0] is not None]
        cost, audit = best(repair.reduced("".join(a + b for a, b in zip(letters, faults, strict=True))))
        lines, i, state = [], 0, 0
        for x in audit:
            if x == "I":
                letter, text = ("a", "") if state == 2 else ("u", "")
                lines.append(f"{repair.ROLES[letter]}:")
            else:
                _, role, text = turns[i]
                i += 1
                if x == "D":
                    continue
                letter = role[0] if x == "K" else "a" if state == 2 else "u"
                lines.append(f"{role if x == 'K' else repair.ROLES[letter]}:{text}")
            state = repair.GRAMMAR[state, letter]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


CONV = "conv_id long, turn long, role string, text string, audit string, part int, digest string, letter string, c long, of long, h int, copy int"


def conversations(n=120, seed=4):
    rng, out = random.Random(seed), []
    says = ["Yes.", "No!", "what now", "", " \n", None, "Same words.", "é ☃?", "x" * 3000 + "."]
    for c in [*range(n), None]:
        turns = sorted(rng.sample(range(12), rng.randint(1, 9)))
        for t in turns:
            out.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(says) if rng.random() < 0.5 else f"line {rng.random()}.", "x", 1, "d", "l", 1, 2, 3, 4))
    return [*out, (500, None, "user", "no number.", *out[0][4:]), (500, 3, "assistant", "a number.", *out[0][4:]), (500, 3, "assistant", "a number.", *out[0][4:]), (500, 9, "assistant", "a number.", *out[0][4:])]


def test_conversations(spark, monkeypatch):
    data = conversations()
    for chunk in (4096, 3):  # chunks across which conversations go on
        monkeypatch.setattr(repair, "CHUNK_ROWS", chunk)
        got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in repair.audit_conversations(spark.createDataFrame(data, CONV)).collect()}
        assert got == brute_conversations(data)
    assert repair.audit_conversations(spark.createDataFrame([], CONV)).count() == 0


def test_long_conversation(spark, monkeypatch):
    """One conversation with most rows, in several ranges and chunks; repaired rows keep the grammar."""
    monkeypatch.setattr(repair, "CHUNK_ROWS", 50)
    rng = random.Random(6)
    data = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 400)} words{rng.choice('.?, ')}", "x", 1, "d", "l", 1, 2, 3, 4) for t in range(1500)] + conversations(5)
    got = {r.conv_id: tuple(r)[1:] for r in repair.audit_conversations(spark.createDataFrame(data, CONV)).collect()}
    assert got == brute_conversations(data)
    turns = repair.damaged(spark.createDataFrame(data, CONV))
    audited = repair.audits(turns)
    messages = repair.repaired(turns, audited).where("conv_id = 1").orderBy("place").collect()
    assert [r.place for r in messages] == list(range(len(messages)))
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in messages))


# Spelling variants


def brute_variants(data):
    count = Counter()
    for i, t, *_ in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            count[run] += len(run) >= 6
    words = {w: n for w, n in count.items() if n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        like = sorted((-words[v], v) for v in words if v != w and near(w, v))
        form[w] = like[0][1] if like and -like[0][0] >= 5 * n else None
        out[w] = [form[w], None, n, len(like), words[form[w]] if form[w] else None]
    for w in out:
        end = w
        while form[end]:
            end = form[end]
        out[w][1] = end
    return {w: tuple(v) for w, v in out.items()}


def lexicon(seed=3):
    """Words with their variants at several frequencies, chains of forms, anagrams, repeated letters and accents."""
    rng, texts = random.Random(seed), []
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "straßen", "listen", "silent"]
    weights = {}
    for w in base:
        weights[w] = rng.choice([5, 30, 200])
        for _ in range(4):
            k = rng.randrange(len(w))
            v = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abÿ") + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:]])
            weights[v] = rng.choice([5, 6, 30, 150])
    bag = [w for w, n in weights.items() for _ in range(n)]
    rng.shuffle(bag)
    for i in range(0, len(bag), 40):
        texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in bag[i : i + 40]))
    return [(i, t, "en", "s", 0, 0, 0, 0, "l", 0, 0, 0, "k", 0, 0) for i, t in enumerate(texts)]


def test_spelling_variants(spark):
    data = [*lexicon(), *rows(), (None, "Wortreich " * 7 + "wortreih " * 5 + "x" * 50_000, *rows()[0][2:]), *rows()[:3]]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(frame(spark, data)).collect()}
    want = brute_variants(data)
    assert got == want
    assert any(form and root != form for form, root, *_ in want.values())
    assert variants.spelling_variants(frame(spark, data[:0])).count() == 0


def test_pairs_once(spark):
    words = spark.createDataFrame([(w, 5) for w in ("abcabc", "abcab", "abcabd", "bcabca", "abbabc", "aaaaaa", "aaaaa", "baaaaa")], "word string, n long")
    pairs = [(r.word, r.near) for r in variants.near_words(words).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {x for a, b in [("abcabc", "abcab"), ("abcabc", "abcabd"), ("abcab", "abcabd"), ("abcabc", "abbabc"), ("aaaaaa", "aaaaa"), ("aaaaaa", "baaaaa"), ("aaaaa", "baaaaa")] for x in ((a, b), (b, a))}


# Mixing


def targets(sizes):
    """Water-filling as the contract says it, by source in order."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            open_.remove(s)
        left -= sum(out[s] for s in full)
    return out


def mixed_data():
    rng = random.Random(8)
    out = []
    for i in range(400):
        out.append((i, " ".join(["word"] * rng.choice([0, 1, 3, 10, 60, 61, 62, 500])), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None]), 1, 2, 3, 4, "l", 5, 6, 7, "key", 9, 10))
    return [*out, (None, "w " * 30_000, *out[0][2:]), (7, None, *out[0][2:]), *out[:20], (900, None, "en", "nothing", *out[0][4:])]


def test_mix(spark):
    data = mixed_data()
    df = frame(spark, data).withColumnsRenamed({"part": "copies", "h": "place", "rep": "of", "node": "size"})
    out = mixing.mix_sources(df).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = Counter()
    for _, t, _, s, *_ in data:
        total[s] += size(t)
    want = targets(total)
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6)) for r in out) == Counter((i, size(t), total[s], round(want[s], 6)) for i, t, _, s, *_ in data)
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in out)
    by = Counter()
    for r in out:
        by[r.source_size, round(r.target, 6)] += r.taken
    for s, t in total.items():
        assert abs(by[t, round(want[s], 6)] - want[s]) <= 2
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(df.repartition(7)).collect()))
    assert mixing.mix_sources(frame(spark, data[:0])).count() == 0


def test_mix_in_buckets(spark, monkeypatch):
    """Copies don't depend on the buckets in which equal sizes are counted."""
    df = frame(spark, mixed_data())
    whole = sorted(map(str, mixing.mix_sources(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    assert sorted(map(str, mixing.mix_sources(df).collect())) == whole


def test_rates_are_tilted(spark):
    """Rates solve the dual: log(rate / (2 - rate)) is proportional to the size, and the words reach the target."""
    from pyspark.sql import functions as F

    for target in (40.0, 900.0, 1010.0, 1500.0, 2019.9):
        cells = spark.createDataFrame([(0, 1, 10, 0.1), (0, 10, 20, 1.0), (0, 100, 8, 10.0)], "place long, size long, n long, x double")
        sources = spark.createDataFrame([(0, 1010, target)], "place long, source_size long, target double")
        tilt = mixing.tilts(cells, sources).first().tilt
        given = cells.select(F.sum(F.col("n") * F.col("size") * 2 / (1 + F.exp(-tilt * F.col("x"))))).first()[0]
        assert given == pytest.approx(target, rel=1e-9)
