"""Facts from press texts by rules: who awarded what to whom, tenders, people, projects; each with its sentence.

Spark cuts texts into sentences and keeps those with a cue. Each is read once as tokens: name runs are found, and a verb
of giving, getting or asking decides which of them is on which side. Sentences are then gathered by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.functions import dates, evidence, money, names

#: Verbs of giving work, of getting it, of getting it if the other side is named, and of asking for bids.
GIVES = {"awarded", "awards", "subcontracted", "subcontracts", "let"}
GETS = {"won", "wins", "win", "secured", "secures", "securing", "bagged", "bags", "bagging", "received", "receives", "receiving", "clinched", "clinches", "clinching", "landed", "lands", "landing"}
SIGNS = {"gets", "getting", "signs", "signed", "signing", "inks", "inked"}
ASKS = {"invited", "invites", "issued", "issues", "floated", "floats", "released", "releases", "launched", "launches", "announced", "announces"}
#: What is given or got, what is asked for, and words for a part of a company.
WORK = {"contract", "contracts", "order", "orders", "package", "packages", "subcontract", "subcontracts", "scope", "work", "works"}
BIDS = {"tender", "tenders", "e-tender", "e-tenders", "bids", "proposals", "proposal", "quotations", "interest"}
UNITS = {"unit", "units", "arm", "associate", "associates", "subsidiary", "subsidiaries", "affiliate", "jv"}
#: Words that make a pipe order or contract a supply, as do orders of pipes and valves.
SUPPLY = {"supply", "supplies", "supplying", "manufacture", "manufactures", "manufacturing", "manufactured"}
GOODS, DEALS = {"pipe", "pipes", "linepipe", "linepipes", "valve", "valves"}, {"order", "orders", "contract", "contracts", "deal", "deals"}
#: Words of headlines that are no part of names however they are written.
HEADLINE = GIVES | GETS | SIGNS | UNITS | {"contract", "contracts", "order", "orders", "from", "by", "for", "in", "on", "after", "focus", "worth", "to", "the", "a", "an", "with", "at", "shares", "share", "stock", "surge", "surges", "jumps", "gains", "rises", "rallies", "soars", "up", "over", "crore", "lakh", "million", "billion", "mn", "bn", "firm"}
#: Words that end a project's name, and those that don't make one alone.
PROJECT = {"project", "pipeline", "scheme", "system", "plant", "expansion", "development", "upgrade", "network", "line", "facility", "complex", "programme", "program", "replacement", "terminal", "refinery"}
PLAIN = PROJECT | {"gas", "water", "oil", "crude", "steel", "new", "pipelines", "projects", "transmission", "distribution", "city"}
#: Last and earlier words of titles.
POSTS = {"manager", "director", "head", "officer", "lead", "engineer", "secretary", "coordinator", "ceo", "chairman", "president"}
FIELDS = {"senior", "deputy", "chief", "general", "assistant", "regional", "group", "procurement", "project", "projects", "package", "contract", "contracts", "tender", "tenders", "purchase", "purchasing", "supply", "chain", "managing", "technical", "commercial", "construction", "engineering", "operations", "pipeline", "piping", "executive", "financial", "vice"}
#: Words that are written large but name nobody.
NOBODY = {"the", "a", "an", "it", "its", "this", "that", "these", "he", "she", "they", "we", "our", "company", "epc", "government", "ministry", "tender", "bids", "project"}
AUXILIARY = {"has", "had", "have", "been", "was", "were", "also", "recently"}
JOINERS = {"and", "of", "&"}
#: Words between a name and its verb in headlines ("in focus after", "shares surge 10% on").
GAP = 7

_TOKEN = re.compile(r"[^\W_]+(?:[&'’./-][^\W_]+)*|[^\w\s]")
_PLACES = {p.lower() for p in names.PLACES}
_DAYS = {d.lower() for d in names.WEEKDAYS}
_OWNER = re.compile("['’]s$")
#: Joined tables: words that decide an award, words before a giver, words that begin no name, words of titles.
_VERBS, _GIVERS, _NO_START = GIVES | GETS | SIGNS, {"from", "by", "with"}, NOBODY - {"company", "ministry", "government"} | _DAYS
_TITLES = FIELDS | POSTS | {"of", "and"}


@dataclass
class Read:
    """What one sentence says."""

    awarder: str | None = None
    awardee: str | None = None
    role: str | None = None
    parent: str | None = None
    issuer: str | None = None
    ref: str | None = None
    project: str | None = None
    usd: int | None = None
    day: str | None = None
    dated: bool = False
    closing: bool = False
    people: list[dict[str, str]] = field(default_factory=list)


class Sentence:
    """A sentence as tokens with their places, and the runs of tokens that are names."""

    def __init__(self, text: str):
        self.text = text
        self.words = _TOKEN.findall(text)
        self.low = [w.lower() for w in self.words]
        self.has = set(self.low)

    # Most sentences need no names: what only they need is made when it is asked for.
    @cached_property
    def spans(self) -> list[tuple[int, int]]:
        return [m.span() for m in _TOKEN.finditer(self.text)]

    @cached_property
    def ends(self) -> dict[int, tuple[int, int]]:
        return {run[1]: run for run in self.runs}

    @cached_property
    def starts(self) -> dict[int, tuple[int, int]]:
        return {run[0]: run for run in self.runs}

    @cached_property
    def runs(self) -> list[tuple[int, int]]:
        low, n = self.low, len(self.words)
        large = [w[0].isupper() for w in self.words]
        long = [x for w, x in zip(self.words, large, strict=True) if len(w) >= 4 and w.isalpha()]
        if len(long) >= 4 and sum(long) >= 0.7 * len(long):  # a headline
            large = [x and w not in HEADLINE for w, x in zip(low, large, strict=True)]
        out, i = [], 0
        while i < n:
            if not large[i]:
                i += 1
                continue
            j = i + 1
            while j < n and (large[j] or (low[j] in JOINERS and j + 1 < n and large[j + 1])):
                j += 1
            a = i
            while a < j and low[a] in _NO_START:
                a += 1
            if a < j:
                out.append((a, j))
            i = j
        return out

    def name(self, run: tuple[int, int] | None) -> str | None:
        """A run as it is written, without a place or a possessive around it; none if it names nobody."""
        if run is None:
            return None
        a, b = run
        while a < b:
            low = self.low[a]
            owner = _OWNER.split(low)[0]
            if b - a > 1 and (low.endswith(("-based", "-run", "-owned", "-listed")) or (owner != low and owner in _PLACES)):
                a += 1
            else:
                break
        out = _OWNER.sub("", self.text[self.spans[a][0] : self.spans[b - 1][1]])
        day, _, rest = out.partition(".")
        out = rest if rest and day.lower() in _DAYS else out
        return out if len(out) >= 2 and out.lower() not in NOBODY and out.lower() not in _PLACES else None

    def run_from(self, i: int) -> tuple[int, int] | None:
        """The run that begins at a token, or after "the" there."""
        while i < len(self.words) and self.low[i] == "the":
            i += 1
        return self.starts.get(i)

    def after(self, words: set[str], i: int) -> tuple[int, int] | None:
        """The first run that follows one of the words from a token on."""
        return next((run for k in range(i, len(self.words)) if self.low[k] in words and (run := self.run_from(k + 1))), None)

    def find(self, words: set[str], i: int, most: int = 1_000_000) -> int | None:
        return next((k for k in range(i, min(len(self.words), i + most)) if self.low[k] in words), None)

    def subject(self, verb: int) -> tuple[tuple[int, int] | None, tuple[int, int] | None]:
        """(subject, parent) of a verb: the name before it, before an aside between commas, or before a headline's few words."""
        e = verb
        while e and self.low[e - 1] in AUXILIARY:
            e -= 1
        if e and self.words[e - 1] == ",":
            comma = next((k for k in range(e - 2, -1, -1) if self.words[k] == ","), None)
            if comma is not None and comma in self.ends:
                aside = self.find(UNITS, comma, e - comma)
                return self.ends[comma], self.after({"of"}, aside) if aside is not None else None
        last = next((r for r in reversed(self.runs) if r[1] <= e), None)
        if last is None:
            return None, None
        gap = range(last[1], e)
        if len(gap) > GAP or any(self.words[k] != "%" and not self.words[k][0].isalnum() for k in gap):
            return None, None
        if any(self.low[k] in UNITS for k in gap):
            return None, last
        k = last[0] - 1
        return last, self.ends.get(k) if k >= 0 and self.low[k] in UNITS and k in self.ends else None


def role_of(low: list[str]) -> str:
    """What an award makes of who gets it, by its words: subcontractor, supplier, consortium_member or main_epc."""
    pairs = set(zip(low, low[1:], strict=False))
    goods = any(a in GOODS and (b in DEALS or (b == "supply" and c in DEALS)) for a, b, c in zip(low, low[1:], [*low[2:], ""], strict=False))
    if any(w.startswith("subcontract") for w in low):
        return "subcontractor"
    if (goods or not SUPPLY.isdisjoint(low) or ("purchase", "order") in pairs or ("order", "for") in pairs) and pairs.isdisjoint({("epc", "contract"), ("epc", "order")}):
        return "supplier"
    return "consortium_member" if "consortium" in low else "main_epc"


def _award(s: Sentence, out: Read) -> bool:
    if s.has.isdisjoint(_VERBS) or (s.has.isdisjoint(WORK) and s.has.isdisjoint(GIVES)):
        return False
    for v, word in enumerate(s.low):
        if word not in _VERBS or (word in SIGNS and s.has.isdisjoint(_GIVERS)):
            continue
        passive = v > 0 and s.low[v - 1] in ("been", "was", "were")
        if word in GETS or word in SIGNS or (word in GIVES and passive):
            work = s.find(WORK, v + 1)
            if work is None:
                continue
            who, parent = s.subject(v)
            giver = s.after(_GIVERS, work)
            if (who is None and parent is None) or (giver is None and word in SIGNS):
                continue
        else:
            giver, parent = s.subject(v)
            who = s.run_from(v + 1)
            if who is None or s.find(WORK, who[1]) is None:
                who = s.after({"to"}, v + 1)
            if giver is None or who is None:
                continue
        out.awardee, out.awarder, out.parent = s.name(who), s.name(giver), s.name(parent)
        if out.awardee or out.parent:
            out.role = role_of(s.low) if out.awardee else None
            return True
    return False


def _tender(s: Sentence, out: Read) -> None:
    if s.has.isdisjoint(ASKS) or s.has.isdisjoint(BIDS):
        return
    for v, word in enumerate(s.low):
        if word in ASKS and s.find(BIDS, v + 1, 6) is not None:
            out.issuer = s.name(s.subject(v)[0])
            return


_CALLS, _NUMBERED = {"tender", "bid", "rfq", "rfp", "enquiry", "inquiry"}, {"no", "number", "ref", "reference"}
_CODE = re.compile("[A-Z][A-Z0-9]*(?:[-/][A-Z0-9]+)+")


def _reference(s: Sentence) -> str | None:
    if s.has.isdisjoint(_CALLS) or s.has.isdisjoint(_NUMBERED):
        return None
    for k, word in enumerate(s.low):
        if word in _CALLS and k + 1 < len(s.low) and s.low[k + 1] in _NUMBERED:
            code = next((w for w in s.words[k + 2 : k + 5] if w not in (".", ":", "#")), "")
            if _CODE.fullmatch(code.upper()):
                return code
    return None


def _people(s: Sentence) -> list[dict[str, str]]:
    """Names beside titles: "Name, Title", "Name (Title)" and "Title Name"."""
    out, k = [], 0
    if s.has.isdisjoint(POSTS):
        return out
    titles = []
    while k < len(s.words):
        j = k
        while j < len(s.words) and s.low[j] in _TITLES and (s.words[j][0].isupper() or s.low[j] in ("of", "and")):
            j += 1
        while j > k and s.low[j - 1] in ("of", "and"):
            j -= 1
        if any(s.low[x] in POSTS for x in range(k, j)) and s.low[k] not in ("of", "and"):
            titles.append((k, j))
        k = max(j, k + 1)
    person = lambda a, b: 2 <= b - a <= 3 and all(w[0].isupper() and w[1:].islower() for w in s.words[a:b])
    for a, b in titles:
        before = a - 1
        while before >= 0 and s.low[before] in ("the", "its", "company's"):
            before -= 1
        run = s.ends.get(before) if before > 0 and s.words[before] in (",", "(") else None
        if run is None or not person(*run):
            whole = next((r for r in s.runs if r[0] <= a and b < r[1]), None)
            run = (b, whole[1]) if whole and whole[1] > b else s.starts.get(b)
        if run and person(*run):
            at = lambda x, y: s.text[s.spans[x][0] : s.spans[y - 1][1]]
            out.append({"name": at(*run), "title": at(a, b)})
    return out


def _project(s: Sentence) -> str | None:
    if s.has.isdisjoint(PROJECT):
        return None
    for a, b in s.runs:
        stop = next((k for k in range(b, a, -1) if s.low[k - 1] in PROJECT), None)
        if stop and stop - a >= 2 and not all(w in PLAIN for w in s.low[a:stop]):
            return s.text[s.spans[a][0] : s.spans[stop - 1][1]]
    return None


_LED, _TRAILED = re.compile(money.LED), re.compile(money.TRAILED)
#: A currency and what may part it from a number behind it; no such is longer than MARK_LENGTH.
_MARK, _DIGITS, _MARK_LENGTH = re.compile(rf"(?i){money._any([*money.USD_RATE, *money.ALIASES])}\s?\Z"), re.compile("[0-9]+"), 1 + max(map(len, [*money.USD_RATE, *money.ALIASES]))


def _led(text: str) -> re.Match | None:
    """_LED.search(), which would try every currency at every character: only what stands before digits is tried."""
    for digits in _DIGITS.finditer(text):
        mark = _MARK.search(text, max(0, digits.start() - _MARK_LENGTH), digits.start())
        if mark:
            return _LED.match(text, mark.start())
    return None


def usd_of(text: str) -> int | None:
    """The first amount of a text in US dollars, as money.parse_money() has it; none above what a single award can be."""
    led, trailed = _led(text), _TRAILED.search(text)
    if not led and not trailed:
        return None
    if led and (not trailed or led.start() <= trailed.start()):
        mark, number, scale = led.groups()
    else:
        number, scale, mark = trailed.groups()
    currency = money.ALIASES.get(mark.upper(), mark.upper())
    usd = float(number.replace(",", "")) * money.SCALE.get((scale or "").lower(), 1.0) * money.USD_RATE[currency]
    return int(usd + 0.5) if usd <= money.PLAUSIBLE else None


_YEAR, _PARTS, _STOPPED = re.compile("[0-9]{4}"), re.compile("[0-9]+|[a-z]+|[-/.]"), re.compile(r"([a-z])\.")
_MONTHS = {m: i + 1 for i, m in enumerate(dates.MONTHS)}
#: The most exact form, with no other number or sign before it: no other date of the text can come first.
_EXACT = re.compile("[^0-9./-]*([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9])")


def day_of(text: str) -> str | None:
    """The date of a text, as dates.parse_date() has it: of several the most exact form, then the first."""
    if not _YEAR.search(text):
        return None
    exact = _EXACT.match(text)
    if exact:
        return _day(*map(int, exact.groups()))
    tokens = [x for x in _PARTS.findall(_STOPPED.sub(r"\1 ", text.lower())) if x not in dates.FILLERS]
    n = len(tokens)
    size = [len(x) if x[0] in "0123456789" else 0 for x in tokens] + [0] * 5
    month = lambda i: _MONTHS.get(tokens[i][:3], 0) if i < n else 0
    sign = lambda i, signs: i < n and tokens[i] in signs
    found = []
    for i, x in enumerate(tokens):
        if size[i]:
            if size[i] == 4 and size[i + 2] == 2 and size[i + 4] == 2 and (i == 0 or tokens[i - 1] not in "-/.") and sign(i + 1, "-") and sign(i + 3, "-"):
                found.append((1, i, int(x), int(tokens[i + 2]), int(tokens[i + 4])))
            elif size[i] > 2:
                continue
            elif size[i + 2] == 4 and month(i + 1):
                found.append((2, i, int(tokens[i + 2]), month(i + 1), int(x)))
            elif size[i + 4] == 4 and 1 <= size[i + 2] <= 2 and sign(i + 1, "/.") and sign(i + 3, "/."):
                found.append((4, i, int(tokens[i + 4]), int(tokens[i + 2]), int(x)))
        elif size[i + 1] and (m := month(i)):
            if size[i + 1] <= 2 and size[i + 2] == 4:
                found.append((3, i, int(tokens[i + 2]), m, int(tokens[i + 1])))
            elif size[i + 1] == 4 and not (i and 1 <= size[i - 1] <= 2):
                found.append((5, i, int(tokens[i + 1]), m, 1))
    if not found:
        return None
    return _day(*min(found)[2:])


def _day(y: int, m: int, d: int) -> str | None:
    return f"{y:04d}-{m:02d}-{d:02d}" if dates.OLDEST < y < dates.NEWEST and 1 <= m <= 12 and 1 <= d <= 31 else None


#: Pairs of words by which a sentence has a closing date, or the day of an award, and the words of which each has one.
_CLOSES = {("closing", "date"), ("due", "date"), ("bid", "due"), ("last", "date"), ("are", "due"), ("closes", "on"), ("close", "on"), ("be", "submitted")}
_DATES, _SIGNED = {("received", "on"), ("announced", "on"), ("of", "award")}, {"signed", "awarded", "dated"}
_PAIRED = {b for _, b in _CLOSES | _DATES}


def read(text: str, people: bool = True) -> Read:
    """What a sentence says; without ``people`` neither persons nor projects are looked for."""
    s, out = Sentence(text), Read()
    if not _award(s, out):
        _tender(s, out)
    out.ref = _reference(s)
    if people:
        out.people, out.project = _people(s), _project(s)
    paired, signed = not s.has.isdisjoint(_PAIRED), not s.has.isdisjoint(_SIGNED)
    if (paired or signed or "deadline" in s.has) and any([len(w) >= 4 and w[0].isdigit() for w in s.words]):
        pairs = set(zip(s.low, s.low[1:], strict=False)) if paired else set()
        out.closing = "deadline" in s.has or not pairs.isdisjoint(_CLOSES)
        out.dated = signed or not pairs.isdisjoint(_DATES)
    if out.awardee:
        out.usd = usd_of(text)
    if out.awardee or out.dated or out.closing:
        out.day = day_of(text)
    return out


READ = "awarder string, awardee string, role string, parent string, issuer string, ref string, project string, usd long, day string, dated boolean, closing boolean, people array<struct<name:string,title:string>>"
#: A sentence without any of these words says nothing that read() looks for.
CUES = sorted(GIVES | GETS | SIGNS | ASKS | {"tender", "bid", "rfq", "rfp", "enquiry", "inquiry", "due", "date", "dated", "deadline", "submitted", "award", "close", "closes"} | PROJECT | POSTS)


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"usd": pa.int64(), "dated": pa.bool_(), "closing": pa.bool_(), "people": pa.list_(pa.struct([("name", pa.string()), ("title", pa.string())]))}
    for b in batches:
        found = [vars(read(t)) for t in b.column("sentence").to_pylist()]
        cells = {k: pa.array([f[k] for f in found], kinds.get(k, pa.string())) for k in vars(Read())}
        yield pa.RecordBatch.from_arrays([*b.columns, *cells.values()], names=[*b.schema.names, *cells])


#: What facts() takes from a text: each group from the first sentence that has it, with that sentence's place.
_FIRST = {"award": ("place", "sentence", "awarder", "awardee", "role", "usd", "day"), "asked": ("place", "sentence", "issuer"), "dated": ("place", "day"), "ref": ("place", "ref"), "closing": ("place", "day")}
_KINDS = {"place": ("int", pa.int32()), "usd": ("long", pa.int64())}
_TEXT = ("string", pa.string())
FIRST = ", ".join(f"{g}_{c} {_KINDS.get(c, _TEXT)[0]}" for g, cs in _FIRST.items() for c in cs)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The groups of _FIRST of every text, given as the list of its sentences behind its key."""
    for b in batches:
        cells = _first_of(b.column(1))
        yield pa.RecordBatch.from_arrays([b.column(0), *cells.values()], names=[b.schema.names[0], *cells])


def _first_of(texts: pa.Array) -> dict[str, pa.Array]:
    rows: dict[str, list[tuple | None]] = {g: [] for g in _FIRST}
    for sentences in texts.to_pylist():
        got: dict[str, tuple] = {}
        for place, t in enumerate(sentences or ()):
            r = read(t, people=False)
            if r.awardee and "award" not in got:
                got["award"] = (place, t, r.awarder, r.awardee, r.role, r.usd, r.day)
            if r.issuer and "asked" not in got:
                got["asked"] = (place, t, r.issuer)
            if r.dated and "dated" not in got:
                got["dated"] = (place, r.day)
            if r.ref and "ref" not in got:
                got["ref"] = (place, r.ref)
            if r.closing and "closing" not in got:
                got["closing"] = (place, r.day)
        for g, out in rows.items():
            out.append(got.get(g))
    return {f"{g}_{c}": pa.array([None if x is None else x[k] for x in rows[g]], _KINDS.get(c, _TEXT)[1]) for g, cs in _FIRST.items() for k, c in enumerate(cs)}


def _spread(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key`` and _text. Reading costs far more than moving a text: all cores take part, also where the rows come from a few small partitions."""
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.select(key, text.alias("_text")).repartition(tasks, key)


def sentence_facts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """A row for each sentence with a cue: ``key``, place, sentence and what it says."""
    cues = F.array(*map(F.lit, CUES))
    spread = _spread(df, key, text)
    cut = spread.select(key, F.posexplode(evidence.sentences(F.col("_text"))).alias("place", "sentence"))
    kept = cut.where(F.arrays_overlap(F.split(F.lower("sentence"), "[^a-z]+"), cues))
    return kept.mapInArrow(_reads, f"{key} {df.schema[key].dataType.simpleString()}, place int, sentence string, {READ}")


def mentions(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, name, role, place, title: each name once a text, with the role that says most, from the first sentence that has it.

    A parent of who got the work is neither side of the award.
    """
    rank = {"main_epc": 5, "subcontractor": 5, "supplier": 5, "consortium_member": 4, "owner": 3, "parent": 2, "person": 1}
    rows = sentence_facts(df, key, text)
    one = lambda name, role, title=None: F.struct(name.alias("name"), role.alias("role"), (F.lit(None).cast("string") if title is None else title).alias("title"))
    giver = F.when(F.col("role") == "subcontractor", "main_epc").when(F.col("role") == "supplier", "unknown").otherwise("owner")
    every = F.concat(F.array(one(F.col("awarder"), giver), one(F.col("awardee"), F.col("role")), one(F.col("parent"), F.lit("parent")), one(F.col("issuer"), F.lit("owner"))), F.transform("people", lambda p: one(p["name"], F.lit("person"), p["title"])))
    each = rows.select(key, "place", F.explode(every).alias("m")).where("m.name is not null").select(key, "place", "m.*")
    points = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]), F.col("role")), F.lit(0))
    best = F.min(F.struct((-points).alias("points"), "place", "name", "role", "title"))
    return each.groupBy(key, F.lower("name").alias("_key")).agg(best.alias("b")).select(key, "b.name", "b.role", "b.place", "b.title")


def facts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """``key``, stage, awarder, awardee, role, usd, award_date, tender_ref, closing_date, quote of each text; what isn't said is null."""
    # A text is one row on its way to Python and back, whatever number of sentences it has.
    cut = _spread(df, key, text).select(key, evidence.sentences(F.col("_text")).alias("sentences"))
    read_ = cut.mapInArrow(_firsts, f"{key} {df.schema[key].dataType.simpleString()}, {FIRST}")
    first = lambda g, cs: F.min(F.when(F.col(f"{g}_place").isNotNull(), F.struct(*(F.col(f"{g}_{c}").alias(c) for c in cs)))).alias(g)
    out = read_.groupBy(key).agg(*(first(g, cs) for g, cs in _FIRST.items()))
    award, asked = F.col("award"), F.col("asked")
    stage = F.when(award.isNotNull(), "awarded").when(asked.isNotNull(), "epc_tender").otherwise("unknown")
    return out.select(key, stage.alias("stage"), F.when(award.isNotNull(), award["awarder"]).otherwise(asked["issuer"]).alias("awarder"), award["awardee"].alias("awardee"), award["role"].alias("role"), award["usd"].alias("usd"), F.when(award.isNotNull(), F.coalesce(award["day"], F.col("dated.day"))).alias("award_date"), F.col("ref.ref").alias("tender_ref"), F.col("closing.day").alias("closing_date"), F.coalesce(award["sentence"], asked["sentence"]).alias("quote"))


def agreed(first: DataFrame, second: DataFrame, keys: list[str], fields: dict[str, str]) -> DataFrame:
    """Two readings of the same facts as one, with how they agree: both, single (one has it) or disputed. ``fields`` has the
    kind of each field. A disputed value is the first reading's."""
    from leadlens.functions.fuzzy import values_agree

    a = first.select(*keys, *(F.col(f).alias(f"a_{f}") for f in fields))
    b = second.select(*keys, *(F.col(f).alias(f"b_{f}") for f in fields))
    out = a.join(b, keys, "full")
    cells = []
    for f, kind in fields.items():
        x, y = F.col(f"a_{f}"), F.col(f"b_{f}")
        how = F.when(x.isNull() & y.isNull(), None).when(x.isNull() | y.isNull(), "single").when(values_agree(F.lit(kind), x, y), "both").otherwise("disputed")
        cells += [F.coalesce(x, y).alias(f), how.alias(f"{f}_agreement")]
    return out.select(*keys, *cells)
