"""SentencePiece encoding and decoding as a relational lattice.

A word's substrings of bounded length are exploded and joined to the piece table; the pieces found are the edges of the
word's lattice, grouped by word. The vocabulary's model is BPE, whose result is not the path of the best sum of scores
that Viterbi finds, so the fold over a word's edges applies the merges instead: the state is the set of boundaries left,
and each step takes the best edge that spans exactly one of them.

The lattice is built for the words that are frequent in the corpus, a bounded number; the rest are merged one by one by
the same rule when they are met. Words are cut where no piece can cross.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm.common import saved, slices, tidy, utf8

SPACE = "▁"
#: Words whose lattice is folded ahead; their ids go to every task.
KNOWN_WORDS = 200_000
#: Characters of a word that the fold's 63-bit state holds; longer ones are merged when they are met.
LONGEST = 62
#: Characters of a word whose pairs are searched one by one for the next merge.
SHORT = 32
#: Words that a task counts before it hands them on, and merged words it keeps.
COUNTED, KEPT = 200_000, 300_000


class Pieces:
    """The piece table of a model: text, id and rank (by score; least first) of ordinary pieces."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model)
        own = [(p.id_to_piece(i), i, p.get_score(i)) for i in range(p.get_piece_size()) if not (p.is_unknown(i) or p.is_control(i) or p.is_byte(i) or p.is_unused(i))]
        order = {s: r for r, s in enumerate(sorted({s for *_, s in own}, reverse=True))}
        self.rows = [(t, i, order[s]) for t, i, s in own]
        self.rank, self.id = {t: r for t, _, r in self.rows}, {t: i for t, i, _ in self.rows}
        self.byte0 = p.piece_to_id("<0x00>")
        self.raw = {i: t.encode() for t, i, _ in self.rows} | {self.byte0 + b: bytes([b]) for b in range(256)}
        self.longest = max(len(t) for t in self.rank)
        parts = [self.raw.get(i, b"") for i in range(p.get_piece_size())]
        self.bytes, self.size = np.frombuffer(b"".join(parts), np.uint8), np.array([len(x) for x in parts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        apart = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in t for t in self.rank))
        self.words = re.compile(f"{SPACE}+[^{SPACE}{apart}]*|[{apart}]|[^{SPACE}{apart}]+")
        self.memo: dict[str, bytes] = {}

    @staticmethod
    @cache
    def load(model: str) -> Pieces:
        return Pieces(model)

    def split(self, text: str) -> list[str]:
        """The words of a text; no piece crosses from one to the next."""
        return self.words.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def merge(self, word: str) -> list[str]:
        """BPE: the pair with the least rank is merged first, the leftmost of equals; in long words by a queue with stale entries."""
        n, rank = len(word), self.rank
        if n <= SHORT:
            parts, none = list(word), len(rank)
            pairs = [rank.get(a + b, none) for a, b in zip(word, word[1:])]  # noqa: B905
            while pairs and (least := min(pairs)) < none:
                i = pairs.index(least)
                parts[i] += parts.pop(i + 1)
                del pairs[i]
                if i:
                    pairs[i - 1] = rank.get(parts[i - 1] + parts[i], none)
                if i < len(pairs):
                    pairs[i] = rank.get(parts[i] + parts[i + 1], none)
            return parts
        after, before, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        queue = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, length = heapq.heappop(queue)
            j = after[i] if size[i] else n
            if j >= n or size[i] + size[j] != length:
                continue
            size[i], size[j], after[i] = length, 0, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and (b := after[a]) < n and (r := rank.get(word[a : a + size[a] + size[b]])) is not None:
                    heapq.heappush(queue, (r, a, size[a] + size[b]))
        return [word[i : i + size[i]] for i in range(n) if size[i]]

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The texts of runs of ids, as decode() gives them: run i is ids[bounds[i]:bounds[i + 1]]."""
        size = self.size[ids]
        stop = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.repeat(self.start[ids] - stop[:-1], size) + np.arange(stop[-1])].tobytes()
        cuts = stop[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace").replace(SPACE, " ")[1:] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def ids(self, word: str) -> bytes:
        got = self.memo.get(word)
        if got is None:
            out = []
            for p in self.merge(word):
                if p in self.id:
                    out.append(self.id[p])
                else:
                    out += [self.byte0 + b for b in p.encode()]
            got = np.array(out, "<u4").tobytes()
            if len(self.memo) < KEPT:
                self.memo[word] = got
        return got


def _counts(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen = Pieces.load(model), Counter()

        def out() -> pa.RecordBatch:
            rows = [(w, n) for w, n in seen.items() if len(w) <= LONGEST]
            seen.clear()
            return pa.record_batch([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["word", "n"])

        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                for t in part.column("text").cast(pa.string()).to_pylist():
                    seen.update(pieces.split(t))
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    return run


def frequent_words(docs: DataFrame, model: str, limit: int = KNOWN_WORDS) -> DataFrame:
    """(word, n): the most frequent words of all documents that occur twice or more, whole classes of equal counts, at most ``limit``."""
    counts = docs.mapInArrow(tidy(_counts(model)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2")
    counts = saved(counts)
    # The number of words for each count, counts over 1000 as one: at most 999 rows.
    sizes = {r.n: r.words for r in counts.groupBy(F.least("n", F.lit(1000)).alias("n")).agg(F.count("*").alias("words")).collect()}
    total, least = 0, None
    for n in sorted(sizes, reverse=True):
        total += sizes[n]
        if total > limit:
            break
        least = n
    return counts.where(F.col("n") >= least if least else F.lit(False))


def lattice_ids(words: DataFrame, model: str) -> DataFrame:
    """(word, ids) for distinct words of at most LONGEST characters, with DataFrame operations only."""
    spark, pieces = words.sparkSession, Pieces.load(model)
    # As many rows as the vocabulary has pieces, whatever the corpus: it can go to every task.
    vocabulary = F.broadcast(spark.createDataFrame(pieces.rows, "piece string, id int, rank int"))
    spans = F.expr(f"""flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({pieces.longest}, length(word) - i + 1)), l ->
        named_struct('a', i - 1, 'b', i - 1 + l, 'piece', substring(word, i, l)))))""")
    edges = words.select("word", F.explode(spans).alias("x")).select("word", "x.*").join(vocabulary, "piece")
    ends = "shiftleft(1L, a) | shiftleft(1L, b)"
    inner = "(shiftleft(1L, b) - 1) & ~(shiftleft(1L, a + 1) - 1)"
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.expr(f"named_struct('rank', rank, 'a', a, 'b', b, 'id', id, 'ends', {ends}, 'inner', {inner})"))).alias("edges"))
    whole = words.select("word").join(grouped, "word", "left").withColumn("edges", F.expr("coalesce(edges, array())"))
    best = "get(filter(edges, e -> (s & e.ends) = e.ends AND bit_count(s & e.inner) = 1), 0).inner"
    state = F.expr(f"aggregate(sequence(1, length(word)), shiftleft(1L, length(word) + 1) - 1, (s, k) -> coalesce(s & ~{best}, s))")
    left = whole.withColumn("state", state).withColumn("at", F.expr("filter(sequence(0, length(word)), i -> (shiftright(state, i) & 1) = 1)"))
    raw = "hex(encode(substring(word, at[k] + 1, at[k + 1] - at[k]), 'UTF-8'))"
    fallback = f"transform(sequence(0, cast(length({raw}) / 2 as int) - 1), j -> cast(conv(substring({raw}, 2 * j + 1, 2), 16, 10) as int) + {pieces.byte0})"
    found = "get(filter(edges, e -> e.a = at[k] AND e.b = at[k + 1]), 0).id"
    return left.select("word", F.expr(f"flatten(transform(sequence(0, size(at) - 2), k -> if({found} is null, {fallback}, array({found}))))").alias("ids"))


def viterbi_pieces(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word, pieces) of the best path through each word's lattice, by the sum of the scores of ``pieces`` (piece, score).

    For vocabularies whose segmentation is that path (unigram models); the public one here is BPE and takes lattice_ids().
    The fold goes over a word's edges by their end and keeps the best score and the last edge for every boundary. Of equal
    sums the path whose last piece begins first wins. Words without a path have null.
    """
    spans = F.expr(f"flatten(transform(sequence(1, length(word)), i -> transform(sequence(1, least({longest}, length(word) - i + 1)), l -> named_struct('a', i - 1, 'b', i - 1 + l, 'piece', substring(word, i, l)))))")
    edges = words.where("length(word) > 0").select("word", F.explode(spans).alias("x")).select("word", "x.*").join(pieces, "piece")
    grouped = edges.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("b", "a", "score", "piece"))).alias("edges"))
    best = F.expr("""aggregate(edges, transform(sequence(0, length(word)), k -> named_struct('sum', if(k = 0, 0D, cast(null as double)), 'a', cast(null as int), 'piece', cast(null as string))),
        (t, e) -> if(t[e.a].sum is null or coalesce(t[e.b].sum >= t[e.a].sum + e.score, false), t,
            transform(t, (x, k) -> if(k = e.b, named_struct('sum', t[e.a].sum + cast(e.score as double), 'a', e.a, 'piece', e.piece), x))))""")
    back = F.expr("""aggregate(sequence(1, length(word)), named_struct('at', length(word), 'out', cast(array() as array<string>)),
        (s, k) -> if(s.at > 0 and table[s.at].piece is not null, named_struct('at', table[s.at].a, 'out', concat(array(table[s.at].piece), s.out)), s))""")
    done = words.join(grouped.withColumn("table", best).withColumn("back", back).select("word", F.expr("if(back.at = 0, back.out, null)").alias("pieces")), "word", "left")
    return done


def _encode(model: str, known, as_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, table = Pieces.load(model), known.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out = []
                for t in part.column("text").cast(pa.string()).to_pylist():
                    words = pieces.split(t)
                    got = [table.get(w) for w in words]
                    if None in got:
                        got = [pieces.ids(w) if x is None else x for w, x in zip(words, got, strict=True)]
                    out.append(b"".join(got))
                bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int64)
                ids = np.frombuffer(b"".join(out), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
                if as_ids:
                    yield pa.record_batch([part.column("doc_id"), lists], ["doc_id", "ids"])
                else:
                    sizes, crcs = pa.array(np.diff(bounds), pa.int64()), pa.array([zlib.crc32(x) for x in out], pa.int64())
                    yield pa.record_batch([part.column("doc_id"), sizes, crcs, lists, pa.array(pieces.texts(ids, bounds), pa.string())], ["doc_id", "n_tokens", "ids_crc32", "ids", "decoded"])

    return tidy(run)


def encode(docs: DataFrame, model: str, as_ids: bool = True) -> DataFrame:
    """doc_id and ids for every row of docs (doc_id, text); or n_tokens, ids_crc32 of the little-endian ids, ids, and decoded, the text of the ids.

    Null and empty texts have no ids and decode to an empty text. Texts of any length are encoded whole. Repeated rows and
    rows without an id stay; equal texts have equal ids. Other columns are ignored, whatever their names. An empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    rows = lattice_ids(frequent_words(docs, model), model).select("word", F.expr("array_join(transform(ids, i -> hex(i)), ',')").alias("ids")).collect()
    known = {r.word: np.array([int(x, 16) for x in r.ids.split(",")], "<u4").tobytes() for r in rows}
    shared = docs.sparkSession.sparkContext.broadcast(known)
    return docs.mapInArrow(_encode(model, shared, as_ids), "doc_id long, ids array<int>" if as_ids else "doc_id long, n_tokens long, ids_crc32 long, ids array<int>, decoded string")


def decode(encoded: DataFrame, spark: SparkSession, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids) by a join of ids to the piece table, in order; byte pieces give their bytes.

    No ids give an empty text; repeated rows and rows without an id stay.
    """
    pieces = Pieces.load(model)
    rows = [(i, bytearray(t.encode())) for t, i, _ in pieces.rows] + [(pieces.byte0 + b, bytearray([b])) for b in range(256)]
    table = F.broadcast(spark.createDataFrame(rows, "id int, raw binary"))
    rows = encoded.groupBy("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).agg(F.count("*").alias("copies"))
    one = rows.select("doc_id", "ids", "copies", F.posexplode_outer("ids").alias("at", "id"))
    joined = one.join(table, "id", "left").groupBy("doc_id", "ids", "copies").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("raw").alias("raw")))).alias("x"))
    whole = F.expr("decode(unhex(array_join(transform(x, y -> y.raw), '')), 'UTF-8')")
    text = F.regexp_replace(F.coalesce(whole, F.lit("")), SPACE, " ")
    return joined.select("doc_id", F.substring(text, 2, 2147483647).alias("text"), F.explode(F.expr("sequence(1, cast(copies as int))")).alias("copy")).drop("copy")
