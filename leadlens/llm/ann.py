"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Rotations are learned that turn unit vectors into balanced binary codes. Parts of the codes are the keys of tables;
vectors that share a key are candidates and are ranked by their own cosine. Keys grow by a bit and tables in number as
vectors double, so that the vectors of a key stay few. A pair counts in the first table that holds it, so that links are
counted where they are found and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import least_hashed, saved, tidy, whole_groups
from leadlens.llm.components import components

#: Bits of a rotation's code, and of the key of a table while no label and dimension has more than KEY_VECTORS for each.
BITS, KEY_BITS, KEY_VECTORS = 64, 16, 16
#: At cosine 0.98 a bit differs with this probability; a pair may be missed by all tables with this one.
BIT_DIFFERS, MISSED = 0.064, 0.0012
#: Vectors that the rotations are fitted on: those with the least hash of their id. All vectors are indexed.
FIT_VECTORS = 10_000
#: Vectors of one table key that a task compares with as many others at once.
TILE = 1024


def key_bits(n: int) -> int:
    """Bits of a key for ``n`` vectors."""
    return min(32, max(KEY_BITS, int(np.ceil(np.log2(max(1, n) / KEY_VECTORS)))))


def rotations(bits: int) -> int:
    """How many rotations give enough tables of keys of so many bits: 16 tables for 16 bits."""
    tables = np.log(MISSED) / np.log1p(-((1 - BIT_DIFFERS) ** bits))
    return int(np.ceil(tables / (BITS // bits)))


def fit_rotation(x: np.ndarray, seed: int, rounds: int = 40) -> np.ndarray:
    """A projection to BITS signs: principal axes, then the rotation that is closest to the signs it gives.

    Fewer dimensions than bits are rotated several ways, side by side.
    """
    d, rng = x.shape[1], np.random.default_rng(seed)
    out = []
    while sum(w.shape[1] for w in out) < BITS:
        k = min(d, BITS)
        axes = np.linalg.svd(x, full_matrices=False)[2][:k].T if len(x) >= k else np.eye(d)[:, :k]
        v = x @ axes
        r = np.linalg.qr(rng.standard_normal((k, k)))[0]
        for _ in range(rounds if len(x) >= k else 0):
            u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (u @ w).T
        out.append(axes @ r)
    return np.concatenate(out, axis=1)[:, :BITS]


def codes(x: np.ndarray, mean: np.ndarray, rotations: list[np.ndarray], bits: int) -> np.ndarray:
    """The table keys of unit vectors, one column a table."""
    out = []
    for w in rotations:
        sign = ((x - mean) @ w > 0).astype(np.uint64)
        for at in range(0, BITS - bits + 1, bits):
            out.append(sign[:, at : at + bits] @ (np.uint64(1) << np.arange(bits, dtype=np.uint64)))
    return np.stack(out, axis=1).astype(np.int64)


class Quantiser:
    """Mean and rotations for one dimension; others get rotations of their own that aren't fitted."""

    def __init__(self, sample: np.ndarray, bits: int = KEY_BITS):
        self.dim, self.bits = sample.shape[1] if len(sample) else 0, bits
        self.tables = rotations(bits) * (BITS // bits)
        self.fitted = self._fit(sample) if self.dim else None

    def _fit(self, sample: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        mean = sample.mean(axis=0) if len(sample) > 1 else np.zeros(sample.shape[1])
        return mean, [fit_rotation(sample - mean, seed) for seed in range(rotations(self.bits))]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return codes(x, *(self.fitted if x.shape[1] == self.dim else self._fit(np.zeros((0, x.shape[1])))), self.bits)


def _index(quantiser: Quantiser):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = pa.compute.list_value_length(batch.column("v")).to_numpy()
            for d in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == d))
                x = np.array(part.column("v").flatten(), np.float64).reshape(-1, d)
                keys = quantiser(x / np.linalg.norm(x, axis=1, keepdims=True))
                n = len(x)
                yield pa.record_batch(
                    {
                        **{c: part.column(c) for c in ("rep", "label", "copies", "v")},
                        "dim": pa.array([d] * n, pa.int32()),
                        "keys": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * quantiser.tables, pa.int32()), pa.array(keys.ravel())),
                    }
                )

    return tidy(run)


def _forest(links: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Few of the links (rows a, columns b) that join whatever all of them join."""
    rows, cols = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
    links, out = links[np.ix_(rows, cols)], []
    seen_r, seen_c = np.zeros(len(rows), bool), np.zeros(len(cols), bool)
    for seed in range(len(rows)):
        if seen_r[seed]:
            continue
        seen_r[seed], front = True, np.array([seed])
        while len(front):
            reached = np.flatnonzero(links[front].any(axis=0) & ~seen_c)
            seen_c[reached] = True
            out += [(a[rows[seed]], b[cols[c]]) for c in reached]
            front = np.flatnonzero(links[:, reached].any(axis=1) & ~seen_r) if len(reached) else reached
            seen_r[front] = True
            out += [(a[rows[seed]], a[rows[r]]) for r in front]
    return [(x, y) for x, y in out if x != y]


def _rank(least: float, n_tables: int):
    """Count the links of each tile of a table key, and keep a forest of them."""
    group = ["label", "dim", "t", "key", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = (b.slice(i, 2 * TILE) for b in batches for i in range(0, b.num_rows, 2 * TILE))
        for t, bounds in whole_groups(small, group, 4 * TILE):
            rep, copies, dim, tables = (t.column(c).to_numpy() for c in ("rep", "copies", "dim", "t"))
            left = t.column("left").to_numpy(zero_copy_only=False)
            one, two = t.column("one").to_numpy(), t.column("two").to_numpy()
            keys = np.array(t.column("keys").combine_chunks().flatten()).reshape(-1, n_tables)
            vectors = t.column("v").combine_chunks()
            who, links, a, b = [], [], [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2:
                    continue
                x = np.array(vectors.slice(lo, hi - lo).flatten(), np.float64).reshape(-1, dim[lo])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                same = one[lo] == two[lo]
                p = np.arange(hi - lo) if same else np.flatnonzero(left[lo:hi])
                q = p if same else np.flatnonzero(~left[lo:hi])
                near = x[p] @ x[q].T >= least
                if same:
                    np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                for k in range(tables[lo]):  # pairs of an earlier table are counted there
                    new = keys[lo + p[i], k] != keys[lo + q[j], k]
                    i, j = i[new], j[new]
                near[:] = False
                near[i, j] = True
                ids, weight = rep[lo:hi], copies[lo:hi]
                for side, count in ((p, near @ weight[q]), (q, weight[p] @ near)) if not same else ((p, near @ weight[q]),):
                    some = np.flatnonzero(count)
                    who.append(ids[side[some]])
                    links.append(count[some])
                for u, v in _forest(near, ids[p], ids[q]):
                    a.append(u)
                    b.append(v)
            n = np.concatenate(who) if who else np.zeros(0, np.int64)
            yield pa.record_batch(
                {
                    "rep": pa.concat_arrays([pa.array(n, pa.int64()), pa.array(a, pa.int64())]),
                    "links": pa.array(np.concatenate([*links, np.zeros(len(a), np.int64)]) if links else np.zeros(len(a), np.int64), pa.int64()),
                    "other": pa.concat_arrays([pa.nulls(len(n), pa.int64()), pa.array(b, pa.int64())]),
                }
            )

    return tidy(run)


def near_embeddings(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row with a vec_id of vectors (vec_id, embedding, label).

    Vectors are compared only if their labels are equal and not null. Other columns are ignored, whatever their names.

    * Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing. Vectors of different
      lengths don't link. A cosine of exactly the least one is a link.
    * Equal vectors are one with a count, so a large group of copies costs no more than one.
    * Rows that repeat a vec_id are vectors of their own, each with its row and its links; what they reach has the smallest
      vec_id of all of it, and a row is kept if that is its own.
    * Rows without a vec_id give no row. An empty table gives no rows.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    number = next(f.dataType.elementType.simpleString() for f in rows.schema if f.name == "v")
    unique = rows.groupBy("vec_id").count().where("count > 1").isEmpty()
    sound = F.coalesce(F.expr("label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)"), F.lit(False))
    # An id of a row's own: the vec_id where it is one, else its place in the saved rows.
    own = rows.withColumn("id", F.col("vec_id") if unique else F.monotonically_increasing_id())
    keyed = saved(own.withColumn("f1", F.when(sound, F.xxhash64("v"))).withColumn("f2", F.when(sound, F.xxhash64(F.lit(7), "v"))))
    group = ["label", "f1", "f2"]
    same = saved(keyed.where("f1 is not null").groupBy(*group).agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    reps = keyed.select(F.col("id").alias("rep"), "v").join(same, "rep")

    taken = least_hashed(reps.select("rep", "v"), "rep", FIT_VECTORS).toPandas()["v"].tolist()
    dims = [len(v) for v in taken]
    dim = max(set(dims), key=dims.count) if dims else 0
    sample = np.array([v for v in taken if len(v) == dim], np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
    largest = same.groupBy("label").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    quantiser = Quantiser(sample / np.linalg.norm(sample, axis=1, keepdims=True) if dim else sample, key_bits(largest))

    indexed = saved(reps.select("rep", "label", "copies", "v").mapInArrow(_index(quantiser), f"rep long, label string, copies long, v array<{number}>, dim int, keys array<long>"))
    entries = indexed.select("rep", "label", "dim", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("label", "dim", "t", "key").agg(F.count("*").alias("size")).where("size > 1").withColumn("tiles", F.ceil(F.col("size") / F.lit(TILE)).cast("int"))
    held = entries.join(sizes, ["label", "dim", "t", "key"]).withColumn("tile", F.expr("cast(pmod(xxhash64(rep), tiles) as int)"))
    tiles = held.withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)")))
    dealt = tiles.select("rep", "label", "dim", "t", "key", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), (F.col("tile") <= F.col("with")).alias("left"))
    full = dealt.join(indexed.drop("label", "dim"), "rep")
    ranked = saved(full.repartition("label", "dim", "t", "key", "one", "two").sortWithinPartitions("label", "dim", "t", "key", "one", "two").mapInArrow(_rank(cosine, quantiser.tables), "rep long, links long, other long"))

    counts = ranked.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(ranked.where("other is not null"), "rep", "other").withColumnsRenamed({"id": "rep", "label": "low"})
    known = same.join(counts, "rep", "left").join(joined, "rep", "left").select(*group, "copies", "links", F.coalesce("low", "rep").alias("low"))
    out = keyed.drop("v").join(known, group, "left").withColumn("low", F.coalesce("low", "id"))
    if not unique:
        out = out.join(out.groupBy("low").agg(F.min("vec_id").alias("least")), "low").withColumn("low", F.col("least"))
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.col("low").alias("component_id"), (F.col("vec_id") == F.col("low")).alias("kept"))
