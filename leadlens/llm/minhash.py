"""MinHash near-duplicates by a chosen-path similarity join.

Each document's shingle set is reduced to minwise tokens. In every tree a document walks from the root to the
children named by the minwise tokens that the node selects; the node's own hash decides how many (1.25 on average, so
that a pair at the target similarity of 0.8 keeps one common path in expectation). Nodes that are small enough are
compared exhaustively on sketches; larger ones branch again until they are small or deep enough. Large nodes whose members
are mostly near the first one, and those that are still large at the greatest depth, link their members to the first.
Independent trees are repeated. That leaves groups that hold all links the trees found; within them the links are
confirmed on the full shingle sets, in chunks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import buffers, mix, remembered, saved, shingle_sets, slices, tidy, utf8, whole_groups
from leadlens.llm.components import components

#: Independent trees: a pair at similarity 0.8 shares a path of three steps in one tree with probability 0.64.
TREES = 12
DEPTH, DEEPEST = 3, 9
FUNCTIONS = 128
NODE_ROWS = 128
#: A sketch has the lowest two bits of each minwise value. Two documents may differ in so many of the 128: 19 are
#: expected at similarity 0.8, four and a half deviations more are allowed.
SKETCH_DIFFER = 37
SKETCH = ("s1", "s2", "s3", "s4")
#: A confirming task holds at most so many documents of one group, and about so many shingles.
CHUNK_ROWS, CHUNK_SHINGLES = 1500, 1_000_000

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)[:, None]


def minwise(tokens: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set of 64-bit tokens."""
    low = (tokens >> np.uint64(32)).astype(np.uint32)
    out = np.full(FUNCTIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 8192):
        np.minimum(out, (low[i : i + 8192] * _MUL + _ADD).min(axis=1), out=out)
    return out


def sketches(sig: np.ndarray) -> np.ndarray:
    """The two highest bits of each scrambled minwise value, as four 64-bit words a document."""
    two = (sig * np.uint32(0x9E3779B1)) >> np.uint32(30)
    bits = np.stack([two >> np.uint32(1), two & np.uint32(1)], axis=2).astype(np.uint8).reshape(len(sig), 2 * FUNCTIONS)
    return np.packbits(bits, axis=1).view(np.int64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of the two-bit values sketches differ, over the last axis."""
    x = a ^ b
    return np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1, dtype=np.int64)


def children(row: np.ndarray, node: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, node, parent) one step down: each node names one function, one in four names a second."""
    out = []
    for branch in (1, 2):
        pick = mix(node + np.uint64(branch))
        keep = slice(None) if branch == 1 else (pick >> np.uint64(40)) % np.uint64(4) == 0
        r, n, f = row[keep], node[keep], (pick[keep] % np.uint64(FUNCTIONS)).astype(np.int64)
        out.append((r, mix(mix(n * np.uint64(3) + f.astype(np.uint64)) + sig[r, f]), n))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("minhash")
        roots = mix(np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(0x51ED2701))
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(*buffers(part.column("text")), words)
                sig = np.array([minwise(s) for s in sets], np.uint32)
                row, node = np.repeat(np.arange(len(sets)), TREES), np.tile(roots, len(sets))
                for _ in range(DEPTH):
                    row, node, _ = children(row, node, sig)
                order = np.argsort(row, kind="stable")
                starts = np.searchsorted(row[order], np.arange(len(sets) + 1))
                sketch = sketches(sig)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "th": part.column("th"),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "f1": pa.array([int(mix(s).sum().view(np.int64)) for s in sets], pa.int64()),
                        "f2": pa.array([int(mix(s ^ np.uint64(0xA5A5)).sum().view(np.int64)) for s in sets], pa.int64()),
                        **{c: pa.array(np.ascontiguousarray(sketch[:, i])) for i, c in enumerate(SKETCH)},
                        "sig": pa.array([s.tobytes() for s in sig], pa.binary()),
                        "nodes": pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(node[order].view(np.int64))),
                    }
                )

    return tidy(run)


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All paths below the given nodes, to the greatest depth: at most 126 steps for a row, 14 on average."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
        row, node = np.arange(batch.num_rows), batch.column("node").to_numpy().view(np.uint64)
        for depth in range(DEPTH + 1, DEEPEST + 1):
            row, node, parent = children(row, node, sig)
            yield pa.record_batch([batch.column("rep").take(pa.array(row)), pa.array(parent.view(np.int64)), pa.array(node.view(np.int64)), pa.array(np.full(len(row), depth, np.int32))], ["rep", "parent", "node", "depth"])


def star(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links between the places ``x`` and ``y`` of ascending ids: every id that reaches a smaller one, after the smallest it reaches."""
    low = np.arange(len(ids))
    while True:
        new = low.copy()
        np.minimum.at(new, x, low[y])
        np.minimum.at(new, y, low[x])
        new = new[new]
        if (new == low).all():
            some = np.flatnonzero(low != np.arange(len(ids)))
            return ids[low[some]], ids[some]
        low = new


def _near_in_nodes(percent: int):
    """The pairs in each small node whose sizes and sketches allow a link, as stars around the least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["node"], 4096):
            rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            sketch = np.stack([t.column(c).to_numpy() for c in SKETCH], axis=1).view(np.uint64)
            near = lambda i, j: (differing(sketch[i], sketch[j]) <= SKETCH_DIFFER) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[near(two, two + 1)]
            a, b = [rep[two]], [rep[two + 1]]
            for g in np.flatnonzero(size > 2):
                at = np.arange(bounds[g], bounds[g + 1])
                u, v = star(rep[at], *np.nonzero(np.triu(near(at[:, None], at[None, :]), 1)))
                a.append(u)
                b.append(v)
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return tidy(run)


def link_forest(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets with 100 * intersection >= percent * union.

    Pairs that are joined already, or share a label, aren't compared; ``left`` says which sets to compare with all others.
    """
    n = len(sets)
    out = []
    root = np.arange(n) if labels is None else np.unique(labels, return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    token, place = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(n), size)
    by_token = np.argsort(place, kind="stable")
    first_of = np.searchsorted(place[by_token], np.arange(len(token) + 1))
    owner_by_token, ends = owner[by_token], np.concatenate([[0], np.cumsum(size)])
    for i in range(n) if left is None else np.flatnonzero(left).tolist():
        other = root != root[i]
        if left is None:
            other[: i + 1] = False
        other &= (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])) & (size > 0)
        if not size[i] or not other.any():
            continue
        mine = place[ends[i] : ends[i + 1]]
        lo, width = first_of[mine], first_of[mine + 1] - first_of[mine]
        flat = np.repeat(lo - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
        both = np.bincount(owner_by_token[flat], minlength=n)
        for j in np.flatnonzero(other & (100 * both >= percent * (size + size[i] - both))).tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _confirm(words: int, percent: int, residual: bool):
    keys = ["blob", "chunk", "other"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (s for b in batches for s in slices(b, "text", 8 << 20))
        for t, bounds in whole_groups(small, keys):
            ids = t.column("doc_id").to_numpy()
            labels, left = (t.column("label").to_numpy(), t.column("left").to_numpy()) if residual else (None, None)
            text = t.column("text").combine_chunks()
            a, b = [ids[:0]], [ids[:0]]
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sets = shingle_sets(*buffers(text.slice(lo, hi - lo)), words)
                pairs = link_forest(sets, percent, labels[lo:hi] if residual else None, left[lo:hi] if residual else None)
                if pairs:
                    u, v = star(ids[lo:hi], *np.array(pairs).T)
                    a.append(u)
                    b.append(v)
            yield pa.record_batch({"a": np.concatenate(a), "b": np.concatenate(b)})

    return tidy(run)


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents that ``rows`` (rep, th, others) name, with its other columns. The rows grow with the corpus, so that
    they are never broadcast, not even while they are few."""
    named = rows.withColumnsRenamed({"rep": "doc_id", "th": "_th"}).hint("merge")
    return docs.join(named, "doc_id").where("th = _th").drop("_th")


def _confirmed(docs: DataFrame, rows: DataFrame, words: int, percent: int, residual: bool = False) -> DataFrame:
    """Links between the members of each (blob, chunk, other), whose texts are fetched by one join."""
    full = _texts(docs, rows).drop("th")
    return full.repartition("blob", "chunk", "other").sortWithinPartitions("blob", "chunk", "other", "doc_id").mapInArrow(_confirm(words, percent, residual), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Components of documents whose sets of ``words``-word shingles have a Jaccard similarity of at least ``similarity``.

    Takes columns doc_id and text; others are ignored, whatever their names. Returns one row for each doc_id: doc_id,
    n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id = component_id).

    * Null, empty and blank texts have no shingles and link with nothing. Rows without a doc_id give no row.
    * Rows that repeat a doc_id are one document. If their texts differ, the text with the least ``text_rank`` counts
      and the others don't.
    * Very long texts are read whole, in pieces. Ties can't arise: similarities are compared as integers.
    * An empty table gives no rows.
    """
    percent = round(100 * similarity)
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), text_rank().alias("th"))
    kinds = ", ".join(f"{c} long" for c in ("doc_id", "th", "n", "f1", "f2", *SKETCH))
    signed = saved(docs.mapInArrow(_sign(words), f"{kinds}, sig binary, nodes array<long>"))
    count = signed.count()
    one = saved(signed.groupBy("doc_id").agg(F.min(F.struct("th", "f1", "f2", "n")).alias("x")).select("doc_id", "x.*"), count)
    same = one.where("n > 0").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "th")).alias("x")).select("f1", "f2", "n", F.col("x.doc_id").alias("rep"), "x.th")
    wanted = same.select("rep", "th")
    kept = saved(_named(signed.where("n > 0"), wanted).select("rep", "th", "n", *SKETCH, "nodes").dropDuplicates(["rep"]), count)
    reps = kept.drop("nodes")

    links = _candidates(kept, reps, _named(signed, wanted), percent, count)
    blobs = components(links, rows=count).withColumnsRenamed({"id": "rep", "label": "blob"})
    sized = blobs.join(reps.select("rep", "th", "n"), "rep")
    parts = sized.groupBy("blob").agg(F.ceil(F.greatest(F.count("*") / F.lit(CHUNK_ROWS), F.sum("n") / F.lit(CHUNK_SHINGLES))).cast("int").alias("parts"))
    dealt = saved(sized.join(parts, "blob").select("rep", "th", "blob", "parts", F.expr("cast(pmod(xxhash64(rep), parts) as int)").alias("chunk")), count)
    split = dealt.where("parts > 1")
    several = not split.isEmpty()
    texts = saved(_texts(docs, dealt.select("rep", "th")), count) if several else docs
    # The first member of a split group stands in each of its chunks, so that most of them grow together at once.
    guests = split.where("rep = blob").select("rep", "th", "blob", "parts", F.explode(F.expr("sequence(0, parts - 1)")).alias("chunk"))
    rows = dealt.where("parts = 1 or rep != blob").unionByName(guests) if several else dealt
    exact = _confirmed(texts, rows.select("rep", "th", "blob", "chunk", F.lit(0).alias("other")), words, percent)
    if several:
        exact = saved(exact.distinct(), count)
        exact = exact.union(_across_chunks(texts, split, exact, words, percent, count))

    joined = components(exact, rows=count).withColumnsRenamed({"id": "rep", "label": "low"})
    tops = same.join(joined, "rep", "left").select("f1", "f2", "n", F.coalesce("low", "rep").alias("low"))
    low = F.coalesce("low", "doc_id")
    return one.join(tops, ["f1", "f2", "n"], "left").select("doc_id", F.col("n").alias("n_shingles"), low.alias("component_id"), (F.col("doc_id") == low).alias("kept"))


def text_rank() -> F.Column:
    """Where rows repeat a doc_id, the row with the least of this counts."""
    return F.xxhash64(utf8("text"))


def _named(signed: DataFrame, wanted: DataFrame) -> DataFrame:
    """The signed rows that ``wanted`` (rep, th) names; repeated rows come more than once."""
    return signed.withColumnRenamed("doc_id", "rep").join(wanted.withColumnRenamed("th", "_th"), "rep").where("th = _th").drop("_th")


def _candidates(kept: DataFrame, reps: DataFrame, signed: DataFrame, percent: int, count: int) -> DataFrame:
    """Links (a, b) that join whatever the trees' nodes hold together: found in small nodes, or to the first of large ones.

    All steps of the recursion are made at once: a path goes on below large nodes and ends in the first small one.
    """
    nodes = kept.select("rep", F.explode("nodes").alias("node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("rows"), F.min("rep").alias("hub")).where("rows > 1")
    shared = saved(nodes.join(sizes, "node"), 8 * count)
    small, hot = shared.where(f"rows <= {NODE_ROWS}").select("node", "rep"), shared.where(f"rows > {NODE_ROWS}")
    to_hub = []
    if many := hot.count():
        dense = saved(_dense(hot, reps), many // NODE_ROWS)
        to_hub.append(hot.join(dense, "node", "left_semi"))
        rest = hot.join(dense, "node", "left_anti").select("rep", "node")
        signatures = signed.select("rep", "sig").dropDuplicates(["rep"])
        paths = saved(rest.join(signatures, "rep").mapInArrow(tidy(_descend), "rep long, parent long, node long, depth int").distinct(), 14 * many)
        below = saved(paths.groupBy("node").agg(F.count("*").alias("rows"), F.min("rep").alias("hub")).where("rows > 1"), 4 * many)
        # What stands under a small node was compared there.
        large = below.where(f"rows > {NODE_ROWS}").select(F.col("node").alias("parent"))
        first = paths.where(f"depth = {DEPTH + 1}").unionByName(paths.where(f"depth > {DEPTH + 1}").join(large, "parent", "left_semi").select(paths.columns))
        ends = saved(first.join(below, "node").where(f"rows <= {NODE_ROWS} or depth = {DEEPEST}").select("rep", "node", "rows", "hub"), 4 * many)
        small = small.unionByName(ends.where(f"rows <= {NODE_ROWS}").select("node", "rep"))
        to_hub.append(ends.where(f"rows > {NODE_ROWS}"))
    rows = small.distinct().join(reps, "rep").repartition("node").sortWithinPartitions("node", "rep")
    found = rows.mapInArrow(_near_in_nodes(percent), "a long, b long")
    for x in to_hub:
        found = found.unionByName(x.where("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")))
    return found


def _dense(hot: DataFrame, reps: DataFrame) -> DataFrame:
    """Large nodes whose members are mostly near their first one: to branch them would only repeat them. All their members
    are linked to the first, which loses nothing, as links are confirmed later."""
    first = {c: f"h{i}" for i, c in enumerate(SKETCH)}
    hubs = hot.select("node", F.col("hub").alias("rep")).distinct().join(reps.select("rep", *(F.col(c).alias(h) for c, h in first.items())), "rep").drop("rep")
    pair = lambda x: F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(0x5555555555555555)))
    differ = sum((pair(F.col(c).bitwiseXOR(F.col(h))) for c, h in first.items()), F.lit(0))
    return hot.join(reps.select("rep", *SKETCH), "rep").join(hubs, "node").groupBy("node").agg(F.avg((differ <= SKETCH_DIFFER).cast("int")).alias("near")).where("near >= 0.5").select("node")


def _across_chunks(docs: DataFrame, dealt: DataFrame, exact: DataFrame, words: int, percent: int, count: int) -> DataFrame:
    """The links of split groups that lie across chunks: members outside the group's largest class against all others."""
    known = components(exact, rows=count).withColumnsRenamed({"id": "rep"})
    named = saved(dealt.join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep")), count)
    counted = named.groupBy("blob", "label").agg(F.count("*").alias("rows"))
    largest = counted.groupBy("blob").agg(F.max_by("label", F.struct("rows", "label")).alias("main"))
    rest = saved(named.join(largest, "blob").where("label != main").drop("main"), count)
    others = rest.groupBy("blob").agg(F.ceil(F.count("*") / F.lit(CHUNK_ROWS)).cast("int").alias("others"))
    rest = rest.join(others, "blob").withColumn("other", F.expr("cast(pmod(xxhash64(rep, 7), others) as int)"))
    guests = rest.withColumn("chunk", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("left", F.lit(True))
    hosts = named.join(others, "blob").withColumn("other", F.explode(F.expr("sequence(0, others - 1)"))).withColumn("left", F.lit(False))
    hosts = hosts.join(rest.select("rep", "other"), ["rep", "other"], "left_anti")
    columns = ["rep", "th", "blob", "chunk", "other", "label", "left"]
    rows = guests.select(columns).unionByName(hosts.select(columns))
    return saved(_confirmed(docs, rows, words, percent, residual=True).distinct(), count)
