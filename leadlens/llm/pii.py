"""Personal data by weak supervision: regex, gazetteer and context labelers vote on candidate spans, expectation
maximisation estimates how reliable each labeler is, and a span classifier trained on the posteriors decides.

Four base kinds are certain by their form and always stay. The method adds spans of further kinds. Votes are counted
over all documents by pattern; the patterns are few and fixed in number, so that the fit is exact and small.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import give_back, remembered, slices, tidy, utf8

#: An address is `[A-Za-z0-9._%+-]+@` and this: the local part is looked for from the "@" back, in time linear in the text.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`; a run of digits is taken whole, as no shorter one can go on with a dot.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("secret", "number", "person")
KINDS = BASE_KINDS + ADDED_KINDS
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

_SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}")
_NUMBER = re.compile(r"(?<![0-9A-Za-z+.])[0-9][0-9 ().-]{5,18}[0-9](?![0-9A-Za-z])")
_PERSON = re.compile(r"\b[A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]{2,}\b")
#: Words that announce a kind: fixed values, of this module's own choice.
GAZETTEER = {
    "secret": frozenset("token key apikey secret password passwd pwd auth bearer credential credentials".split()),
    "number": frozenset("phone tel telephone mobile cell fax call ssn passport account iban".split()),
    "person": frozenset("james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen maria anna peter hans jean marie pierre carlos jose juan luis ana".split()),
}
CONTEXT = {"secret": re.compile(r"[=:]\s*[\"']?$"), "number": re.compile(r"(?:[:#]|\bno\.?|\bat)\s*$", re.I), "person": re.compile(r"\b(?:mr|mrs|ms|dr|prof|contact|dear|herr|frau|monsieur|madame|senor|señor)\.?\s*$", re.I)}
LABELERS = 4
#: Posterior from which a span is added, and the share of positives that EM starts from.
DECISION, PRIOR = 0.9, 0.2


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d)
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds, each leftmost and non-overlapping; failing matches are dropped without a retry."""
    out = []
    out += [(a, "email", b) for a, b in emails(text)]
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    if _DIGIT.search(text):
        out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = _DIGITS.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), "card", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


def _entropy(s: str) -> float:
    _, n = np.unique(np.frombuffer(s.encode(), np.uint8), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def _shape(kind: str, s: str) -> int:
    if kind == "secret":
        return 1 if len(s) >= 28 and _entropy(s) >= 3.2 else -1
    if kind == "number":
        d = _DIGITS.sub("", s)
        return 1 if re.fullmatch(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}", s) else -1 if len(d) < 8 else 0
    return 0 if re.search(r"[a-z] [A-Z]\. [A-Z]", s) else -1


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int, tuple[int, ...]]]:
    """(start, kind, end, votes) of spans that may be personal; none overlaps a base span. Votes are 1, 0 (abstains) or -1:
    the form, the gazetteer, the text before, the neighbourhood of base spans."""
    found = []
    if _DIGIT.search(text):
        found += [(m.start(), "secret", m.end()) for m in _SECRET.finditer(text)]
        found += [(m.start(), "number", m.end()) for m in _NUMBER.finditer(text)]
    found += [(m.start(), "person", m.end()) for m in _PERSON.finditer(text)]
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    before = lambda at: reach[k - 1] if (k := bisect_left(starts, at)) else -99  # noqa: E731  the furthest end of what starts before
    out, last = [], 0
    for start, kind, end in sorted(found):
        if start < last or before(end) > start:
            continue
        last = end
        own, ahead = text[start:end], text[max(0, start - 24) : start]
        words = re.findall(r"[a-zäöüßñáéíóú]+", (own if kind == "person" else ahead).lower())
        near = start - before(start) < 40 or (k := bisect_left(starts, end)) < len(starts) and starts[k] - end < 40
        gazetteer = 1 if not GAZETTEER[kind].isdisjoint(words[:1] if kind == "person" else words[-2:]) else -1 if kind == "person" else 0
        out.append((start, kind, end, (_shape(kind, own), gazetteer, 1 if CONTEXT[kind].search(ahead) else 0, 1 if near else 0)))
    return out


Pattern = tuple[str, tuple[int, ...]]


def estimate(counts: dict[Pattern, int], rounds: int = 50) -> dict[str, tuple[float, np.ndarray]]:
    """Per kind (share of positives, P(vote | class) of shape labelers x 2 classes x 3 votes) by expectation maximisation.

    Pseudo-counts say that a labeler which votes is right more often than not, so that few data leave it at that.
    """
    out = {}
    for kind in ADDED_KINDS:
        votes = [(v, n) for (k, v), n in counts.items() if k == kind]
        pseudo = np.tile(np.array([[4.0, 5.0, 1.0], [1.0, 5.0, 4.0]]), (LABELERS, 1, 1))
        share, table = PRIOR, pseudo / pseudo.sum(axis=2, keepdims=True)
        for _ in range(rounds if votes else 0):
            total, positive, mass = np.array(pseudo), 2 * PRIOR, 2.0
            for v, n in votes:
                p = posterior(share, table, v)
                for j, x in enumerate(v):
                    total[j, 0, x + 1] += n * (1 - p)
                    total[j, 1, x + 1] += n * p
                positive, mass = positive + n * p, mass + n
            share, table = positive / mass, total / total.sum(axis=2, keepdims=True)
        out[kind] = (share, table)
    return out


def posterior(share: float, table: np.ndarray, votes: tuple[int, ...]) -> float:
    yes, no = share, 1 - share
    for j, x in enumerate(votes):
        yes, no = yes * table[j, 1, x + 1], no * table[j, 0, x + 1]
    return yes / (yes + no)


def _inputs(kind: str, votes: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(kind == k) for k in ADDED_KINDS), *(float(v > 0) for v in votes), *(float(v < 0) for v in votes), float(sum(v > 0 for v in votes))]


@dataclass
class Classifier:
    """A logistic span classifier over kind and votes."""

    weights: np.ndarray

    def __call__(self, kind: str, votes: tuple[int, ...]) -> bool:
        """Added if the classifier is sure and at least two labelers are for it."""
        return sum(v > 0 for v in votes) >= 2 and 1 / (1 + np.exp(-float(np.dot(self.weights, _inputs(kind, votes))))) >= DECISION


def train(counts: dict[Pattern, int]) -> Classifier:
    """Fit the span classifier to the posteriors of all patterns, weighted by how often they occur."""
    reliability = estimate(counts)
    patterns = sorted(counts)
    if not patterns:
        return Classifier(np.zeros(len(_inputs("", (0,) * LABELERS))))
    x = np.array([_inputs(k, v) for k, v in patterns])
    y = np.array([posterior(*reliability[k], v) for k, v in patterns])
    n = np.log1p(np.array([counts[p] for p in patterns], float))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), x.T @ (n * (y - p)) - 0.05 * w)
        w += np.clip(step, -3, 3)
    return Classifier(w)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    remembered("pii")
    for batch in batches:
        seen: dict[tuple[str, str], int] = {}
        for text in batch.column("text").to_pylist():
            text = text or ""
            for _, kind, _, votes in candidates(text, base_spans(text)):
                key = (kind, ",".join(map(str, votes)))
                seen[key] = seen.get(key, 0) + 1
        yield pa.record_batch([pa.array([k for k, _ in seen], pa.string()), pa.array([v for _, v in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "n"])


def fit(docs: DataFrame) -> Classifier:
    """Count vote patterns over all documents (at most 3 kinds x 3**4 rows come back) and train on them."""
    rows = docs.select("text").mapInArrow(tidy(_count), "kind string, votes string, n long").groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()
    return train({(r.kind, tuple(map(int, r.votes.split(",")))): r.n for r in rows})


def all_spans(text: str, classifier: Classifier) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), by start and kind."""
    base = base_spans(text)
    added = [(s, k, e) for s, k, e, votes in candidates(text, base) if classifier(k, votes)]
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[1])))


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans counted by base kind, base_sha256 and spans for every row of docs (doc_id, text).

    Null text counts as empty: no spans. Texts are read whole, whatever their length. Repeated rows and rows without an id
    stay. Spans that begin together go by kind, as listed. Other columns are ignored, whatever their names. Offsets count
    code points. An empty table gives no rows.
    """
    classifier = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                n: dict[str, list] = {k: [] for k in BASE_KINDS}
                sha, spans = [], []
                for text in part.column("text").cast(pa.string()).to_pylist():
                    base, every = all_spans(text, classifier)
                    for k in BASE_KINDS:
                        n[k].append(sum(x[1] == k for x in base))
                    sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                    spans.append(written(every))
                yield pa.record_batch([part.column("doc_id"), *(pa.array(n[k], pa.int64()) for k in BASE_KINDS), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    kinds = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(tidy(run), f"doc_id long, {kinds}, base_sha256 string, spans string")


def masked(text: str, classifier: Classifier) -> str:
    """The text with every span as its kind in brackets; of overlapping spans the union takes the first's kind."""
    out, at = [], 0
    for start, kind, end in all_spans(text, classifier)[1]:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask_spans(docs: DataFrame) -> DataFrame:
    """docs with personal data replaced in ``text``; all other columns stay as they are, whatever their names.

    Null texts stay null, empty ones empty; texts are read whole, whatever their length. Of spans that overlap, the one that
    begins first is replaced and the rest of the other as well. Rows that repeat are treated alike. An empty table gives
    no rows.
    """
    classifier = fit(docs)

    @F.pandas_udf("string")
    def mask(texts):
        out = texts.map(lambda t: None if t is None else masked(t, classifier))
        give_back()
        return out

    return docs.withColumn("text", mask("text"))
