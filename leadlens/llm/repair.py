"""Conversation structure repair by weighted finite-state composition.

A conversation's turns are an input acceptor, a chain of role initials with their faults. An edit transducer keeps,
reroles, deletes and inserts turns at a cost; a grammar acceptor takes the role sequences `(s?(ua)+)?`. Their
composition is expanded state by state as the shortest path reaches it, in topological order: by turn, then by
insertions since the last turn. Weights are pairs of cost and edit string, compared in this order.

A conversation may be of any length: its turns lie in ranges, a chunk of turns is reduced to the best weights between
each two states of the grammar, and these reductions are folded (they are associative). Only flags, digests and edits
take part; texts are shuffled once, when edits are applied to them in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import Batches, saved, slices, tidy

#: The role grammar: (state, role initial) to state; where a conversation may end.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
START, ENDS, STATES = 0, (0, 3), 4
#: Cost of edits; what a truncated turn that stays costs more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Insertions in a row: the grammar's only cycle has two steps, so that a third would come back to a state at a cost.
INSERTIONS = 2
#: Turns reduced at a time, and the most turns of a chunk whose reduction is remembered.
CHUNK_ROWS, SHORT = 4096, 16

Weight = tuple[int, str]
#: By entry state: the best weight to each state that can be reached.
Reduction = tuple[dict[int, Weight], ...]

_SPACE = " \t\n\x0b\x0c\r"


def arcs(letter: str, fault: str) -> Iterator[tuple[str, int, str]]:
    """What the edit transducer does with a turn: (label, cost, output); the output is empty where the turn goes."""
    yield "D", DELETE, ""
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        yield "K", KEEP + more, letter
        for role in ROLES:
            yield "R", REROLE + more, role


def _relax(reached: dict[int, Weight], state: int | None, weight: Weight) -> None:
    if state is not None and (state not in reached or weight < reached[state]):
        reached[state] = weight


def _inserted(reached: dict[int, Weight]) -> dict[int, Weight]:
    """Also the states that up to INSERTIONS inserted turns lead to."""
    out, last = dict(reached), reached
    for _ in range(INSERTIONS):
        step: dict[int, Weight] = {}
        for state, (cost, path) in last.items():
            for role in ROLES:
                _relax(step, GRAMMAR.get((state, role)), (cost + INSERT, path + "I"))
        for state, weight in step.items():
            _relax(out, state, weight)
        last = step
    return out


def reduced(turns: str) -> Reduction:
    """The best weights through a chunk, given as letter and fault of each turn.

    A path's string may grow at its end: of equal cost, none is the beginning of another, as that other would have
    only insertions more, at a cost.
    """
    out = []
    for start in range(STATES):
        reached: dict[int, Weight] = {start: (0, "")}
        for i in range(0, len(turns), 2):
            step: dict[int, Weight] = {}
            for state, (cost, path) in _inserted(reached).items():
                for label, more, letter in arcs(turns[i], turns[i + 1]):
                    _relax(step, GRAMMAR.get((state, letter)) if letter else state, (cost + more, path + label))
            reached = step
        out.append(_inserted(reached))
    return tuple(out)


_remembered = lru_cache(1 << 15)(reduced)


def joined(a: Reduction, b: Reduction) -> Reduction:
    """The reduction of two chunks in a row."""
    out = []
    for ways in a:
        reached: dict[int, Weight] = {}
        for middle, (cost, path) in ways.items():
            for state, (more, rest) in b[middle].items():
                _relax(reached, state, (cost + more, path + rest))
        out.append(reached)
    return tuple(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the checksum of `conv_id:turn`: dropped, emptied, unpunctuated, repeated, reroled turns.

    Null roles and texts, and nulls in the checksum, count as one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.where("h != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy"))
    return out.drop("copy")


def _order() -> list[Column]:
    """Turns by number, null first; equal numbers by role and digest of the text."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def tagged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, letter and fault (b, d, t or -) of each turn; a copy of the turn before is marked later."""
    end = F.expr(f"trim(TRAILING '{_SPACE}' FROM text)")
    whole = F.right(end, F.lit(1)).isin(".", "!", "?")
    letter = F.substring("role", 1, 1)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", _digest(), F.when(letter.isin("s", "u", "a"), letter).otherwise("?").alias("letter"), (end == "").alias("blank"), whole.alias("whole"))
    at = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn"))
    firsts = rows.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1")
    same = rows["conv_id"].eqNullSafe(F.col("c")) & (rows["role"] == F.col("r")) & (rows["digest"] == F.col("d"))
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNotNull() & (at > F.col("first")), "d").when(~F.col("whole"), "t").otherwise("-")
    return rows.join(firsts, same, "left").select("conv_id", "turn", "role", "digest", "letter", fault.alias("fault"))


CHUNK = "part int, seq long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<int>, paths array<string>"
_FLAT = [(a, b) for a in range(STATES) for b in range(STATES)]


def _chunks(batches: Batches) -> Batches:
    part, seq, kind, held, seen = TaskContext.get().partitionId(), 0, None, None, None
    names = [x.split(" ")[0] for x in CHUNK.split(", ")]

    def closed(c: dict) -> dict:
        turns = "".join(c.pop("symbols"))
        ways = (_remembered if len(turns) <= 2 * SHORT else reduced)(turns)
        c["costs"], c["paths"] = [ways[a][b][0] if b in ways[a] else -1 for a, b in _FLAT], [ways[a][b][1] if b in ways[a] else "" for a, b in _FLAT]
        return c

    def batch(done: list[dict]) -> pa.RecordBatch:
        kinds = {"conv_id": kind, "part": pa.int32(), "first": pa.string(), "last": pa.string(), "costs": pa.list_(pa.int32()), "paths": pa.list_(pa.string())}
        return pa.record_batch({k: pa.array([c[k] for c in done], kinds.get(k, pa.int64())) for k in ["conv_id", *names]})

    for b in batches:
        done, kind = [], b.schema.field("conv_id").type
        for conv, turn, role, digest, letter, fault in zip(*(b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "digest", "letter", "fault")), strict=True):
            if held and (held["conv_id"] != conv or held["n"] == CHUNK_ROWS):
                done.append(closed(held))
                held = None
            if not held:
                held = {"conv_id": conv, "part": part, "seq": seq, "n": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": letter, "last": None, "low": None, "high": None, "turns": 0, "symbols": []}
                seq += 1
            if fault != "b" and seen == (conv, turn, role, digest):
                fault = "d"
            seen = (conv, turn, role, digest)
            held["n"] += 1
            for name, mark in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
                held[name] += fault == mark
            held["illegal"] += held["last"] is not None and held["last"] + letter not in ("su", "ua", "au")
            held["last"] = letter
            if turn is not None:
                held["low"] = turn if held["low"] is None else held["low"]
                held["turns"] += held["high"] != turn
                held["high"] = turn
            held["symbols"].append(letter + fault)
        if done:
            yield batch(done)
    if held:
        yield batch([closed(held)])


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _folded(batches: Batches) -> Batches:
    """A row for each conversation from its chunks in order; reductions are joined like the digits of a binary counter."""
    names = [x.split(" ")[0] for x in AUDIT.split(", ")]
    kind, c, stack = None, None, []

    def closed() -> dict:
        while len(stack) > 1:
            n, right = stack.pop()
            stack[-1] = (stack[-1][0] + n, joined(stack[-1][1], right))
        ends = stack.pop()[1][START]
        c["cost"], c["audit"] = min(ends[e] for e in ENDS if e in ends)
        c["gaps"] = c["high"] - c["low"] + 1 - c["turns"] if c["high"] is not None else 0
        return c

    def batch(done: list[dict]) -> pa.RecordBatch:
        return pa.record_batch({k: pa.array([d[k] for d in done], {"conv_id": kind, "audit": pa.string()}.get(k, pa.int64())) for k in ["conv_id", *names]})

    for b in batches:
        done, kind = [], b.schema.field("conv_id").type
        for row in b.to_pylist():
            if c and c["conv_id"] != row["conv_id"]:
                done.append(closed())
                c = None
            if not c:
                c = {k: row[k] for k in ("conv_id", "blank", "duplicate", "truncated", "illegal", "last", "low", "high", "turns")}
            else:
                for k in ("blank", "duplicate", "truncated", "illegal"):
                    c[k] += row[k]
                c["illegal"] += c["last"] + row["first"] not in ("su", "ua", "au")
                c["last"] = row["last"]
                if row["turns"]:
                    c["turns"] += row["turns"] - (c["high"] == row["low"])
                    c["low"] = row["low"] if c["low"] is None else c["low"]
                    c["high"] = row["high"]
            ways = tuple({z: (row["costs"][STATES * a + z], row["paths"][STATES * a + z]) for z in range(STATES) if row["costs"][STATES * a + z] >= 0} for a in range(STATES))
            stack.append((1, ways))
            while len(stack) > 1 and stack[-1][0] >= stack[-2][0]:
                n, right = stack.pop()
                stack[-1] = (stack[-1][0] + n, joined(stack[-1][1], right))
        if done:
            yield batch(done)
    if c:
        yield batch([closed()])


def audits(turns: DataFrame) -> DataFrame:
    """For each conversation that has turns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (its cheapest edits' initials)."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = saved(tagged(turns)).repartitionByRange(F.asc_nulls_first("conv_id"), *_order()).sortWithinPartitions(F.asc_nulls_first("conv_id"), *_order())
    chunks = rows.mapInArrow(tidy(_chunks), f"conv_id {kind}, {CHUNK}")
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(tidy(_folded), f"conv_id {kind}, {AUDIT}")


def _applied(batches: Batches) -> Batches:
    conv, edits, at, state, place, kind = None, "", 0, START, 0, None

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate((kind, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text", "edit"])

    def made(out: list[tuple], label: str, role: str | None = None, text: str = "") -> None:
        nonlocal state, place
        role = role if label == "K" else next(name for letter, name in ROLES.items() if (state, letter) in GRAMMAR)
        state = GRAMMAR[state, role[0]]
        out.append((conv, place, role, text, label))
        place += 1

    def insertions(out: list[tuple]) -> None:
        nonlocal at
        while at < len(edits) and edits[at] == "I":
            made(out, "I")
            at += 1

    for whole in batches:
        kind = whole.schema.field("conv_id").type
        for b in slices(whole, "text"):
            out: list[tuple] = []
            for c, audit, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "audit", "role", "text")), strict=True):
                if audit is not None:
                    insertions(out)
                    conv, edits, at, state, place = c, audit, 0, START, 0
                    continue
                insertions(out)
                if edits[at] != "D":
                    made(out, edits[at], role, text)
                at += 1
            if out:
                yield batch(out)
    last: list[tuple] = []
    insertions(last)
    if last:
        yield batch(last)


def repaired(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """The turns as their audits have it: conv_id, place (0, 1, ...), role, text, edit (K, R or I).

    The rows of a conversation lie together in their order. They pass through one task, one at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.lit(None).cast("string").alias("audit"), F.col("turn").cast("long").alias("turn"), "role", _digest(), "text")
    first = audited.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit("").alias("text"))
    both = rows.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    return both.mapInArrow(tidy(_applied), f"conv_id {kind}, place long, role string, text string, edit string")


def _hashed(batches: Batches) -> Batches:
    conv, h, kind = None, None, None
    for whole in batches:
        kind, done = whole.schema.field("conv_id").type, []
        for b in slices(whole, "text"):
            for c, place, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "place", "role", "text")), strict=True):
                if not place:
                    if h:
                        done.append((conv, h.hexdigest()))
                    conv, h = c, hashlib.sha256()
                h.update(f"{chr(10) if place else ''}{role}:{text}".encode())
        if done:
            yield pa.record_batch([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
    if h:
        yield pa.record_batch([pa.array([conv], kind), pa.array([h.hexdigest()])], ["conv_id", "repaired_sha256"])


def digests(messages: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what repaired() returns: its `role:text` by line."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    return messages.mapInArrow(tidy(_hashed), f"conv_id {kind}, repaired_sha256 string")


def audit_conversations(conversations: DataFrame) -> DataFrame:
    """Damage, audit and repair: a row for every conv_id, with the digest of the repaired conversation.

    Takes conv_id, turn, role, text; other columns may have any name. A null conv_id is a conversation; null turns come
    first and count for no gap; null roles and texts are one space. Turns of one number go by role and text digest; rows
    that repeat are duplicates. Texts and conversations of any length count whole. A conversation that lost all its
    turns has zeros, an empty audit and the digest of nothing. An empty table gives no rows.
    """
    turns = damaged(conversations)
    audited = saved(audits(turns))
    sums = digests(repaired(turns, audited)).withColumnRenamed("conv_id", "c")
    everyone = conversations.select("conv_id").distinct()
    a = audited.withColumnRenamed("conv_id", "of")
    out = everyone.join(a, everyone["conv_id"].eqNullSafe(a["of"]), "left")
    out = out.join(sums, out["conv_id"].eqNullSafe(sums["c"]), "left")
    zeros = [F.coalesce(k, F.lit(0)).alias(k) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
