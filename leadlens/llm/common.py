"""Helpers shared by the training-data operators: checkpoints, Arrow text buffers, whole groups from sorted batches."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; temporary arrays are some 50 times as large.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(rows: int) -> int:
    """How many files narrow rows are saved in: one for 50,000 rows up to 64, one for a million beyond."""
    return max(1, min(64, -(-rows // 50_000)), -(-rows // 1_000_000))


def saved(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs no recomputation of what came before.

    ``rows`` is about how many rows there are, if that is known: small results of many partitions become few files.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a session whose executors are threads of the driver may
    go without: it gets a temporary folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="leadlens-"))
    return (df if rows is None else df.coalesce(files(rows))).checkpoint(eager=True)


def least_hashed(df: DataFrame, key: str, k: int) -> DataFrame:
    """The ``k`` rows with the least hash of ``key``. A threshold on the hash leaves little more than k rows to sort."""
    rows = df.withColumn("_hash", F.xxhash64(key))
    n = df.count()
    if n > 2 * k:
        share = (k + 10 * k**0.5 + 10) / n
        some = rows.where(F.col("_hash") < int(-(1 << 63) + share * (1 << 64)))
        rows = some if some.count() >= k else rows
    return rows.orderBy("_hash", key).limit(k).drop("_hash")


_memory: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """What ``owner`` keeps in this worker process. Workers outlive stages, so that what other operators kept goes."""
    for other in [k for k in _memory if k != owner]:
        del _memory[other]
    return _memory.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system. Workers wait for more tasks beside the executor's heap; what they hold is lost to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function of mapInArrow that gives memory back when its task's rows are through."""

    def out(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return out


def utf8(col: str | Column = "text") -> Column:
    """A text column as its UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary Arrow array; document i is bytes[offsets[i]:offsets[i + 1]]."""
    arr = pc.fill_null(arr.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(arr) else data[:0], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes each, or of one row that is longer."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From batches sorted by ``keys``: (table, bounds) with whole groups only; group i is rows bounds[i]:bounds[i + 1]."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def cut(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            v = t.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(new), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held)
        bounds = cut(t)
        if len(bounds) > 2:
            yield t.slice(0, bounds[-2]), bounds[:-1]
        held = t.slice(bounds[-2]).combine_chunks().to_batches()
        rows = sum(b.num_rows for b in held)
    if held:
        t = pa.Table.from_batches(held)
        yield t, cut(t)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse) to 0, 1, ..., n - 1 modulo 2**64."""
    name = "inv" if inverse else "pow"
    if len(_powers.get(name, ())) < n:
        out = np.full(max(n, SLICE_BYTES + 4096), pow(BASE, -1, 1 << 64) if inverse else BASE, np.uint64)
        out[0] = 1
        _powers[name] = np.cumprod(out)
    return _powers[name][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * BASE**position over positions i..j-1."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges start..stop-1, equal for equal contents wherever they stand."""
    return mix((prefix[stop] - prefix[start]) * powers(len(prefix), True)[start] + (stop - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word: A-Z lower-cased, words split at ASCII white space.

    Long input is taken in pieces that end at white space or between documents, as temporary arrays are much larger.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) > 4 * SLICE_BYTES:
        at, found = 0, []
        while at < len(data):
            stop = min(len(data), at + SLICE_BYTES)
            while stop < len(data):  # on to the next white space
                ahead = np.flatnonzero(_SPACE[data[stop : stop + SLICE_BYTES]])
                stop = min(len(data), stop + (int(ahead[0]) if len(ahead) else SLICE_BYTES))
                if len(ahead):
                    break
            inner = offsets[(offsets > at) & (offsets < stop)]
            cuts = np.concatenate([[at], inner, [stop]]) - at
            h, piece = word_hashes_of(data[at:stop], cuts)
            first = int(np.searchsorted(offsets, at, "right")) - 1
            # Empty documents have equal offsets: the document of a piece is the last that starts where it does.
            of = np.searchsorted(offsets, cuts[:-1] + at, "right") - 1
            of[0] = first
            found.append((h, of[piece]))
            at = stop
        return np.concatenate([h for h, _ in found]), np.concatenate([d for _, d in found])
    return word_hashes_of(data, offsets)


def word_hashes_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() of input that is taken at once."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~edge[:-1]
    after = np.concatenate([word[1:], [False]]) & ~edge[1:]
    start, stop = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return range_hash(prefix_hash(_LOWER[data]), start, stop), np.searchsorted(offsets, start, "right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Per document the sorted distinct hashes of its runs of ``words`` words; a shorter document is one run; no words: empty."""
    h, doc = word_hashes(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.full(max(0, len(h) - words + 1), words, np.uint64)
    for j in range(words):
        out = mix(out * np.uint64(BASE) + h[j : j + len(out)])
    sets = []
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a >= words:
            sets.append(np.unique(out[a : b - words + 1]))
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                one = mix(one * np.uint64(BASE) + h[j])
            sets.append(one)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
