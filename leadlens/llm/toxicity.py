"""Toxicity by a learned lexicon: Levenshtein automata over a trie find exact, inflected and misspelled terms, and the
context of each hit tells quotation from abuse.

The lexicon (words, and stems that open many words) is learned from a bounded sample of labelled documents by how far
their document counts depart from chance. A logistic regression over hit features gives the score.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import give_back, least_hashed, remembered, saved, slices, tidy, utf8

#: Labelled documents that lexicon and weights are fitted on: those with the least hash of their id.
FIT_DOCUMENTS = 12_000
#: The departure from chance (G squared) that a term of the lexicon needs.
LEAST_G2 = 20.0
#: Letters of the shortest term, and of the shortest stem, that is looked for with an edit; what such a hit counts.
NEAR_TERM, NEAR_STEM, NEAR = 4, 5, 0.5
STEM_LENGTHS = (4, 5, 6)
#: Words on each side of a hit that make its context.
WINDOW = 8
THRESHOLD = 0.3
#: Words whose look-up a worker remembers.
KEPT_WORDS = 200_000
NOTHING = (0, 0.0)

_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = re.compile("[\"'`«»‘-‟‹›]")
#: Words that report what somebody else said: fixed values, of this module's own choice.
REPORTING = frozenset("said says quoted quote called wrote word term sagte schrieb zitat dit écrit citation dijo escribió cita".split())
FEATURES = ("hits", "quoted", "stems", "near", "share", "weight", "context")


class Trie:
    """The lexicon's terms; a term is (weight, is a stem)."""

    def __init__(self, terms: dict[str, tuple[float, bool]]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[tuple[float, bool] | None] = [None]
        for term, what in terms.items():
            at = 0
            for ch in term:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.end.append(None)
                at = self.next[at][ch]
            self.end[at] = what

    def exact(self, word: str) -> tuple[float, bool] | None:
        """The heaviest of the whole term and the stems that the word opens with."""
        at, best = 0, None
        for i, ch in enumerate(word):
            at = self.next[at].get(ch, -1)
            if at < 0:
                return best
            what = self.end[at]
            if what and (what[1] or i == len(word) - 1) and (best is None or what[0] > best[0]):
                best = what
        return best

    def _tail(self, at: int, word: str) -> float:
        """The weight of the heaviest term that ends where ``word`` does, or stem that ends before, from a node on, or 0."""
        best = 0.0
        for ch in word:
            what = self.end[at]
            if what and what[1]:
                best = max(best, what[0])
            at = self.next[at].get(ch, -1)
            if at < 0:
                return best
        return max(best, self.end[at][0]) if self.end[at] else best

    def swapped(self, word: str) -> float:
        """The weight of the heaviest term that ``word`` is with two letters beside each other swapped, or 0."""
        best, at = 0.0, 0
        for i in range(len(word) - 1):
            if word[i] != word[i + 1]:
                to = self.next[at].get(word[i + 1], -1)
                to = self.next[to].get(word[i], -1) if to >= 0 else -1
                if to >= 0:
                    best = max(best, self._tail(to, word[i + 2 :]))
            at = self.next[at].get(word[i], -1)
            if at < 0:
                break
        return best

    def near(self, word: str) -> float:
        """The weight of the heaviest term one edit from ``word``, or 0.

        The Levenshtein automaton of the word has an exact and an edited state; along the trie's exact path each node is
        left once by a dropped, a changed and an added letter, and from there on only the exact rest is accepted.
        """
        best, at = 0.0, 0
        for i in range(len(word) + 1):
            rest = word[i + 1 :]
            if i < len(word):
                best = max(best, self._tail(at, rest))
            for ch, to in self.next[at].items():
                best = max(best, self._tail(to, word[i:]))
                if i < len(word) and ch != word[i]:
                    best = max(best, self._tail(to, rest))
            at = self.next[at].get(word[i], -1) if i < len(word) else -1
            if at < 0:
                return best
        return best


def shortened(word: str) -> set[str]:
    """A word, and what it is with one letter left out. Words one edit or swap apart have one of these in common."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


@dataclass
class Model:
    """A lexicon, weights of FEATURES, and a cache of the words seen.

    ``under`` has the words below the lexicon's stems, which are looked for with an edit; ``ordinary`` has words that are
    one edit from a term and are no misspelling of it, as clean documents have them.
    """

    terms: dict[str, tuple[float, bool]]
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0
    under: dict[str, float] = field(default_factory=dict)
    ordinary: frozenset[str] = frozenset()

    def __post_init__(self):
        self.trie, self.seen = Trie(self.terms), {}
        self.name = hashlib.md5(repr((sorted(self.terms.items()), sorted(self.under.items()), sorted(self.ordinary))).encode()).hexdigest()
        below = {t: (w, False) for t, w in self.under.items() if len(t) >= NEAR_TERM}
        sought = below | {t: v for t, v in self.terms.items() if len(t) >= (NEAR_STEM if v[1] else NEAR_TERM)}
        self.near = Trie(sought)
        self.whole = frozenset(x for t, v in sought.items() if not v[1] for x in shortened(t))
        self.opening = frozenset(x for t, v in sought.items() if v[1] for x in shortened(t))
        self.opening_lengths = sorted({len(t) + d for t, v in sought.items() if v[1] for d in (-1, 0, 1)})
        # An edit or swap leaves a term's first letters as they are, or else all from the one after next on.
        self.halves: dict[int, list[tuple[int, int, set[str], set[str]]]] = {}
        self.first, self.inner = set(), set()
        for t, v in sought.items():
            k = max(2, (len(t) - 1) // 2)
            if v[1]:
                self.first.add(t[:k])
                self.inner.add(t[k + 1 : k + 3])
                continue
            for n in range(len(t) - 1, len(t) + 2):
                same = next((x for x in self.halves.setdefault(n, []) if x[:2] == (k, len(t) - k - 1)), None)
                if same is None:
                    self.halves[n].append(same := (k, len(t) - k - 1, set(), set()))
                same[2].add(t[:k])
                same[3].add(t[k + 1 :])

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "bias": self.bias, "under": self.under, "ordinary": self.ordinary}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def look_up(self, word: str) -> tuple[int, float]:
        """(0 nothing, 1 term, 2 stem, 3 an edit or a swap from a term, an opening or a word below a stem; weight)."""
        what = self.trie.exact(word)
        if what:
            return (2 if what[1] else 1), what[0]
        if len(word) >= NEAR_TERM - 1 and word not in self.ordinary and self.may_be_near(word):
            w = max(self.near.near(word), self.near.swapped(word))
            if w:
                return 3, w
        return NOTHING

    def may_be_near(self, word: str) -> bool:
        """False only for words that the automaton can't accept; most words are told apart here, without a walk of the trie."""
        for k, rest, heads, tails in self.halves.get(len(word), ()):
            if word[:k] in heads or word[-rest:] in tails:
                if not self.whole.isdisjoint(shortened(word)):
                    return True
                break
        if self.first and (word[:2] in self.first or not self.inner.isdisjoint((word[2:4], word[3:5], word[4:6]))):
            return any(not self.opening.isdisjoint(shortened(word[:k])) for k in self.opening_lengths if len(word) >= k)
        return False

    def at_work(self) -> Model:
        """This model with the words that the worker's earlier tasks have looked up in it."""
        kept = remembered("toxicity")
        if self.name not in kept:
            kept.clear()
        self.seen = kept.setdefault(self.name, self.seen)
        return self

    def kind(self, word: str) -> tuple[int, float]:
        """look_up(), remembered."""
        got = self.seen.get(word)
        if got is None:
            if len(self.seen) >= KEPT_WORDS:
                self.seen.clear()
            got = self.seen[word] = self.look_up(word)
        return got

    def features(self, text: str) -> list[float]:
        low = text.lower()
        words = _WORD.findall(low)
        hits = {w: k for w in set(words) if (k := self.kind(w))[0]}
        n = [0, 0, 0, 0]
        quoted, weight, context = 0.0, 0.0, 0.0
        if hits:
            spans = list(_WORD.finditer(low))
            marks = [i for i, w in enumerate(words) if w in hits]
            for i in marks:
                kind, w = hits[words[i]]
                n[kind] += 1
                before = low[spans[max(0, i - WINDOW)].start() : spans[i].start()]
                after = low[spans[i].end() : spans[min(len(spans) - 1, i + WINDOW)].end()]
                said = not REPORTING.isdisjoint(words[max(0, i - WINDOW) : i])
                is_quote = bool(_QUOTES.search(before) and _QUOTES.search(after)) or said
                part = NEAR if kind == 3 else 1
                quoted += part * is_quote
                weight += part * (0.25 * w if is_quote else w)
                context += part * sum((NEAR if hits[x][0] == 3 else 1) for x in words[max(0, i - WINDOW) : i + WINDOW + 1] if x in hits) - part * part
        total = n[1] + n[2] + NEAR * n[3]
        return [math.log1p(n[1]), math.log1p(quoted), math.log1p(n[2]), math.log1p(n[3]), 100 * total / (len(words) + 20), math.log1p(weight), math.log1p(context)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights) + self.bias, -30, 30)))


def g_squared(a: int, b: int, toxic: int, clean: int) -> float:
    """How far documents with a term (a toxic, b clean of the totals) depart from chance."""
    out, n = 0.0, toxic + clean
    for k, row, col in ((a, a + b, toxic), (b, a + b, clean), (toxic - a, n - a - b, toxic), (clean - b, n - a - b, clean)):
        if k:
            out += 2 * k * math.log(k * n / (row * col))
    return out


def _g_squared(toxic: int, clean: int) -> F.Column:
    """g_squared of the columns a and b."""
    a, b, n = F.col("a"), F.col("b"), toxic + clean
    cells = ((a, a + b, toxic), (b, a + b, clean), (toxic - a, n - a - b, toxic), (clean - b, n - a - b, clean))
    return reduce(add, [F.when(k > 0, 2 * k * F.log(k * float(n) / (row * float(col)))).otherwise(0.0) for k, row, col in cells])


def _count(batches: Iterator[pa.RecordBatch], terms: Callable[[set[str]], set[str]]) -> Iterator[pa.RecordBatch]:
    """How many clean and toxic documents of a batch have each term of their words."""
    for batch in batches:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(terms(set(_WORD.findall((text or "").lower()))))
        for toxic, c in enumerate(counts):
            yield pa.record_batch([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int64()), pa.array(list(c.values()), pa.int64())], ["term", "toxic", "n"])


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each word, and with each stem of words."""
    return _count(batches, lambda words: words | {w[:k] + "*" for w in words for k in STEM_LENGTHS if len(w) >= k})


def _by_label(sample: DataFrame, of: Callable) -> DataFrame:
    """(term, a, b): toxic and clean documents of the sample with a term."""
    rows = sample.select("text", "toxic").mapInArrow(tidy(of), "term string, toxic long, n long")
    return rows.groupBy("term").agg(F.sum(F.col("toxic") * F.col("n")).alias("a"), F.sum((1 - F.col("toxic")) * F.col("n")).alias("b"))


def choose_terms(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, tuple[float, bool]]:
    """Terms bound to toxic documents; a stem stays only where it says more than the words it opens."""
    kept = {}
    for term, a, b in counts:
        if a / max(1, toxic) > 3 * b / max(1, clean) and (g := g_squared(a, b, toxic, clean)) >= LEAST_G2:
            kept[term] = (g, math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)))
    ranked = sorted(kept.items(), key=lambda x: (-x[1][0], x[0]))
    out: dict[str, tuple[float, bool]] = {}
    words = {t: v for t, v in ranked if not t.endswith("*")}
    stems: tuple[str, ...] = ()
    for term, (g, w) in ranked:
        if term.rstrip("*").startswith(stems):
            continue  # what a chosen stem opens is found by it
        if term.endswith("*"):
            stem = term[:-1]
            below = max((v[0] for t, v in words.items() if t.startswith(stem)), default=0)
            if g > 1.2 * below:
                out[stem] = (w, True)
                stems += (stem,)
        else:
            out.setdefault(term, (w, False))
    return out


def regress(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> tuple[list[float], float]:
    """Logistic regression by Newton steps with a ridge."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1].tolist(), float(w[-1])


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def whole_texts(found: DataFrame) -> DataFrame:
    """(text, toxic) of found (doc_id, text, toxic), each text once, with the label of its least id.

    Exact copies of one document would make its rare words look like terms; texts that only open alike all stay.
    """
    text = F.coalesce("text", F.lit(""))
    one = found.groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(F.struct("doc_id", "text", "toxic")).alias("x"))
    return saved(one.select("x.text", "x.toxic"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn lexicon and weights from at most FIT_DOCUMENTS labelled documents that aren't held out.

    The sample's ids are a bounded table that is broadcast. Labels other than 0 and 1 and null ids are ignored; an id
    with both labels counts as toxic. With no toxic or no clean document all scores are the share of toxic ones.
    """
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = usable.join(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    rows = [(r.doc_id, r.toxic) for r in least_hashed(saved(chosen), "doc_id", FIT_DOCUMENTS).collect()]
    known = docs.sparkSession.createDataFrame(rows, "doc_id long, toxic long")
    sample = whole_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id"))
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not toxic or not clean:
        share = (toxic + 0.1) / (toxic + clean + 1)
        return Model({}, [0.0] * len(FEATURES), math.log(share / (1 - share)))
    counts = _by_label(sample, _terms)
    # 3 of 4 terms of a corpus stand in one or two documents. They are left out unless so few could reach LEAST_G2.
    least = next((a for a in (1, 2) if g_squared(a, 0, toxic, clean) >= LEAST_G2), 3)
    bound = saved(counts.where((F.col("a") >= least) & (F.col("a") * clean > 3 * F.col("b") * toxic)))
    strong = bound.where(_g_squared(toxic, clean) >= 0.999 * LEAST_G2)
    model = Model(choose_terms([(r.term, r.a, r.b) for r in strong.collect()], toxic, clean))
    stems = {t: v[0] for t, v in model.terms.items() if v[1]}
    opened = [F.substring("term", 1, k).isin([t for t in stems if len(t) == k]) for k in STEM_LENGTHS if any(len(t) == k for t in stems)]
    if opened:
        words = [r.term for r in bound.where(~F.col("term").endswith("*")).where(reduce(or_, opened)).select("term").collect()]
        model = Model(model.terms, under={w: max(stems.get(w[:k], 0.0) for k in STEM_LENGTHS) for w in words})

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work = model.at_work()
        return _count(batches, lambda words: {w for w in words if at_work.kind(w)[0] == 3})

    common = _by_label(sample, edited).where((F.col("b") >= 1) & (F.col("a") * clean <= 3 * F.col("b") * toxic))
    model = Model(model.terms, under=model.under, ordinary=frozenset(r.term for r in common.select("term").collect()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work = model.at_work()
        for batch in batches:
            x = [at_work.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    got = sample.select("text", "toxic").mapInArrow(tidy(features), "x array<double>, toxic long").collect()
    x, y = np.array([r.x for r in got]), np.array([r.toxic for r in got], float)
    model.weights, model.bias = regress(x, y)
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.3 on) for every row of docs (doc_id, text).

    Other columns are ignored, whatever their names. Null and empty texts get the score of a text without hits. Whole
    texts are read, however long. Repeated rows and rows without an id stay and aren't held out for a missing id. Equal
    texts have equal scores; a score of exactly the threshold counts as toxic. An empty table gives no rows.
    """
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work = model.at_work()
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                x = np.array([at_work.features(t) for t in part.column("text").cast(pa.string()).to_pylist()])
                yield pa.record_batch([part.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under the threshold, with all their columns; the text is read once more, never joined.

    Null and empty texts are clean where texts without hits are. Texts are scored whole, whatever their length. Repeated
    rows and rows without an id are judged alone; a score at the threshold drops its row. An empty table gives no rows.
    """
    model = fit(docs, labels)

    @F.pandas_udf("boolean")
    def clean(texts):
        at_work = model.at_work()
        out = texts.fillna("").map(lambda t: float(at_work.scores(np.array(at_work.features(t)))) < THRESHOLD)
        give_back()
        return out

    return docs.where(clean("text"))
