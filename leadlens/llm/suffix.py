"""Exact substring dedup: every byte goes that a string of LENGTH bytes covers which a document of smaller id has, too.

Suffix arrays are made for shards of bounded size, not for the corpus at once. In each window of LENGTH bytes the gram
with the least hash is its anchor, so that equal windows have equal anchors; a run of windows with one anchor is a
snippet. Anchors deal the snippets to shards: strings that could be equal meet in one shard, or in shards of one anchor.

1. Blocks of documents exchange their anchors. A snippet whose anchor nobody else has shares no window. Snippets that are
   equal as a whole (by 112 bits of hash) are one, owned by the least id.
2. The other snippets, each once, form shards. A shard's suffixes are sorted by Larsson-Sadakane refinement; Kasai's pass
   gives the common prefixes of neighbours, and runs of LENGTH bytes or more are equal windows.
3. Where an anchor fills several shards, their sorted windows are merged by binary search: within a task, or across tasks
   for anchors that a sample shows to be frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadlens.llm.common import SLICE_BYTES, buffers, give_back, mix, powers, prefix_hash, range_hash, remembered, slices, tidy, utf8, whole_groups

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of a block of documents; entries of a bucket of anchors; snippet bytes of a suffix array.
BLOCK_BYTES, BUCKET_ENTRIES, SHARD_BYTES = 4 << 20, 400_000, 1 << 20
#: Anchors with so many different snippets in a sample of so many bytes are dealt to several tasks. Others are kept whole,
#: with the same results.
SAMPLE_BYTES, FREQUENT = 8 << 20, 32
#: Ends a snippet in a shard; no UTF-8 text has this byte.
SEPARATOR = b"\xff"
_PLACE = np.uint64((1 << 30) - 1)
#: The bits of an anchor's hash that blocks exchange, in whose order their entries are.
_SENT = np.uint64((1 << 48) - 1)
_KEY = f"S{LENGTH}"
_NO_ONE = np.iinfo(np.int64).max

Runs = dict[str, np.ndarray]
_RUN_TYPES = {"doc": np.int64, "first": np.int64, "last": np.int64, "anchor": np.int64, "h": np.uint64, "s": np.uint64}


def runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    """The snippets of documents: doc, first and last window start, anchor place, hash of the anchor and of the snippet.

    Long documents are taken in overlapping pieces. A snippet that a piece cuts still shares its anchor with others.
    """
    if len(data) <= 4 * SLICE_BYTES:
        return _runs(data, offsets)
    found = [{k: np.zeros(0, t) for k, t in _RUN_TYPES.items()}]
    for doc in range(len(offsets) - 1):
        for at in range(int(offsets[doc]), max(int(offsets[doc]) + 1, int(offsets[doc + 1]) - LENGTH + 1), SLICE_BYTES):
            piece = data[at : min(int(offsets[doc + 1]), at + SLICE_BYTES + LENGTH - 1)]
            part = _runs(piece, np.array([0, len(piece)]))
            found.append(part | {"doc": part["doc"] + doc} | {k: part[k] + at for k in ("first", "last", "anchor")})
    return {k: np.concatenate([x[k] for x in found]) for k in _RUN_TYPES}


def _runs(data: np.ndarray, offsets: np.ndarray) -> Runs:
    n = len(data)
    if n < LENGTH:
        return {k: np.zeros(0, t) for k, t in _RUN_TYPES.items()}
    prefix = prefix_hash(data)
    # range_hash of every gram, without gathering by index
    gram = mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix), True)[: n - GRAM + 1] + np.uint64(GRAM))
    low = (gram & ~_PLACE) | np.arange(n - GRAM + 1, dtype=np.uint64)  # equal grams: the first in the window
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - size)], low[SPAN - size :])
    windows = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    begin = np.cumsum(windows) - windows
    start = np.repeat(offsets[:-1] - begin, windows) + np.arange(windows.sum())
    anchor = (low[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[begin[windows > 0]] = True
    head = np.flatnonzero(new)
    first, last = start[head], start[np.append(head[1:], len(start)) - 1] if len(head) else start[:0]
    anchor = anchor[head]
    whole = range_hash(prefix, first, last + LENGTH)
    return {"doc": np.searchsorted(offsets, first, "right") - 1, "first": first, "last": last, "anchor": anchor, "h": gram[anchor], "s": mix(whole + (anchor - first).astype(np.uint64))}


class Deal:
    """Where anchors meet: plain ones by their hash, frequent ones also by their snippet's hash.

    ``frequent`` are the hashes of frequent anchors, sorted, and ``parts`` the tasks that each is dealt to.
    """

    def __init__(self, buckets: int, frequent: np.ndarray, parts: np.ndarray):
        self.buckets, self.frequent, self.parts = buckets, frequent, parts

    def parts_of(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.int64)
        if len(self.frequent):
            at = np.minimum(np.searchsorted(self.frequent, h), len(self.frequent) - 1)
            same = self.frequent[at] == h
            out[same] = self.parts[at[same]]
        return out

    def bucket(self, h: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Frequent anchors have odd buckets."""
        parts = self.parts_of(h)
        spread = np.where(parts > 1, mix(h + mix(s)), h >> np.uint64(16))
        return (2 * (spread % np.uint64(self.buckets)) + (parts > 1)).astype(np.int64)


class Block:
    """The snippets of a block's documents, and its distinct (anchor, snippet) entries by bucket."""

    def __init__(self, table: pa.Table, deal: Deal):
        self.ids = table.column("doc_id").to_numpy()
        self.parts = []
        own = []
        row = 0
        for batch in table.select(["text"]).combine_chunks().to_batches():
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                r = runs(data, offsets)
                own.append((r.pop("h"), r.pop("s"), self.ids[row + r.pop("doc")], np.full(len(r["first"]), len(self.parts))))
                del r["anchor"]
                self.parts.append((row, data, offsets, r))
                row += part.num_rows
        h, s, d, self.part_of_run = (np.concatenate([x[i] for x in own]) if own else np.zeros(0, np.uint64 if i < 2 else np.int64) for i in range(4))
        self.first_run = np.concatenate([[0], np.cumsum([len(x[0]) for x in own])]).astype(np.int64)
        del own
        bucket = deal.bucket(h, s)
        order = np.lexsort((d, s, h & _SENT, bucket))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (s[order][1:] != s[order][:-1])
        head = order[new]
        #: Per entry; per run its entry; runs count over all parts.
        self.h, self.s, self.least, self.bucket, self.head = h[head], s[head], d[head], bucket[head], head
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.id_of_run = d
        self.bounds = np.concatenate([[0], np.flatnonzero(self.bucket[1:] != self.bucket[:-1]) + 1, [len(head)]]) if len(head) else np.zeros(1, np.int64)

    def codes(self, answers: pa.Table) -> np.ndarray:
        """Per entry: 0 nothing, 1 a smaller id has the same snippet, 2 its owner, other snippets share the anchor."""
        out = np.zeros(len(self.h), np.uint8)
        where = {int(self.bucket[lo]): int(lo) for lo in self.bounds[:-1]}
        for bucket, payload in zip(answers.column("at").to_pylist(), answers.column("payload").to_pylist(), strict=True):
            lo = where[bucket]
            out[lo : lo + len(payload)] = np.frombuffer(payload, np.uint8)
        return out


_ENTRIES = "block long, bucket long, h binary, s binary, who binary, ids binary"
_ANSWERS = "block long, kind int, at long, payload binary"


def _packed(values: np.ndarray, width: int) -> bytes:
    """Ascending 64-bit values as steps, the first bytes of all, the second of all, ...: what shuffles compress best."""
    steps = np.diff(values.view(np.uint64), prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(packed: bytes, width: int) -> np.ndarray:
    steps = np.zeros((len(packed) // width, 8), np.uint8)
    steps[:, :width] = np.frombuffer(packed, np.uint8).reshape(width, -1).T
    return np.cumsum(steps.view(np.uint64)[:, 0], dtype=np.uint64)


def _send(deal: Deal) -> Callable:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        remembered("suffix")
        b = Block(table, deal)
        out: dict[str, list] = {k: [] for k in ("block", "bucket", "h", "s", "who", "ids")}
        low = b.h & _SENT
        for lo, hi in zip(b.bounds[:-1].tolist(), b.bounds[1:].tolist(), strict=True):
            ids, who = np.unique(b.least[lo:hi], return_inverse=True)
            row = (key[0].as_py(), int(b.bucket[lo]), _packed(low[lo:hi], 6), b.s[lo:hi].tobytes(), who.astype(np.uint16 if len(ids) <= 1 << 16 else np.uint32).tobytes(), _packed(ids, 8))
            for x, v in zip(out.values(), row, strict=True):
                x.append(v)
        give_back()
        return pa.table([pa.array(x, pa.int64() if k in ("block", "bucket") else pa.binary()) for k, x in out.items()], names=list(out))

    return run


def _meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One bucket of anchors: which entries a smaller id has, and which owners must be compared byte by byte."""
    raw = {c: [x.as_py() for x in table.column(c)] for c in ("h", "s", "who", "ids")}
    size = [len(x) // 8 for x in raw["s"]]
    h, s = np.concatenate([_unpacked(x, 6) for x in raw["h"]]), np.frombuffer(b"".join(raw["s"]), np.uint64)
    d = np.concatenate([_unpacked(i, 8).view(np.int64)[np.frombuffer(w, np.uint16 if 2 * n == len(w) else np.uint32)] for i, w, n in zip(raw["ids"], raw["who"], size, strict=True)])
    order = np.lexsort((d, s, h))
    ho, so, do = h[order], s[order], d[order]
    new_h = np.ones(len(h), bool)
    new_h[1:] = ho[1:] != ho[:-1]
    new_s = new_h.copy()
    new_s[1:] |= so[1:] != so[:-1]
    least = do[new_s][np.cumsum(new_s) - 1]
    anchor = np.cumsum(new_h) - 1
    # A frequent anchor has other snippets in other buckets, if not here.
    several = (np.bincount(anchor, new_s) > 1)[anchor] | bool(key[0].as_py() % 2)
    codes = np.empty(len(h), np.uint8)
    codes[order] = np.where(do > least, 1, np.where(several, 2, 0))
    at, out = 0, []
    for block, n in zip(table.column("block").to_pylist(), size, strict=True):
        part = codes[at : at + n]
        at += n
        if part.any():
            out.append((block, 0, key[0].as_py(), part.tobytes()))
    give_back()
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["block", "kind", "at", "payload"])


_SNIPPETS = "block long, entry long, h long, salt int, parts int, d long, snippet binary"


def _compare(deal: Deal) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"block": pa.int64(), "entry": pa.int64(), "h": pa.int64(), "salt": pa.int32(), "parts": pa.int32(), "d": pa.int64(), "snippet": pa.binary()}
        out: dict[str, list] = {k: [] for k in kinds}
        if left.num_rows and right.num_rows:
            b = Block(left, deal)
            some = np.flatnonzero(b.codes(right) == 2)
            parts = deal.parts_of(b.h[some])
            out |= {"block": [left.column("block")[0].as_py()] * len(some), "entry": some, "h": b.h[some].view(np.int64), "parts": parts, "d": b.least[some]}
            out["salt"] = (mix(b.s[some]) % parts.astype(np.uint64)).astype(np.int64)
            for r in b.head[some].tolist():
                p = int(b.part_of_run[r])
                _, data, _, own = b.parts[p]
                k = r - int(b.first_run[p])
                out["snippet"].append(data[own["first"][k] : own["last"][k] + LENGTH].tobytes())
        give_back()
        return pa.table([pa.array(out[k], t) for k, t in kinds.items()], names=list(kinds))

    return run


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all suffixes of ``data`` in order, place of each in it) by Larsson-Sadakane refinement.

    Suffixes are grouped by 8 bytes. Each round doubles the prefix by the ranks of what follows and sorts only groups with
    more than one member; a rank is the place of its group's first member, so that sorted suffixes keep theirs. No suffix
    may be a prefix of zeros of another, as holds if the last byte is SEPARATOR.
    """
    n = len(data)
    eight = eight_bytes(data)
    order = np.argsort(eight, kind="stable")
    new = np.ones(n + 1, bool)
    new[1:n] = eight[order[1:]] != eight[order[:-1]]
    place = np.arange(n)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new[:n], place, 0))
    have = 8
    while len(at := np.flatnonzero(~(new[:n] & new[1:]))):
        suffix = order[at]
        key = rank[suffix] * (n + 1) + rank[np.minimum(suffix + have, n)] + 1
        by_key = np.argsort(key, kind="stable")
        order[at], key = suffix[by_key], key[by_key]
        new[at[1:]] |= key[1:] != key[:-1]
        rank[order[at]] = np.maximum.accumulate(np.where(new[at], at, 0))
        have *= 2
    return order, rank[:n]


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as a number whose order is theirs; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, lane: int = 64) -> np.ndarray:
    """For each suffix in order the length of its common prefix with the one before, by Kasai's pass.

    The pass goes through the text: if a suffix shares h bytes with the one before it in order, the suffix one byte on
    shares h - 1 at least. Lanes of ``lane`` places go on side by side; each starts anew at its first place.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    eight, ended = eight_bytes(data), np.append(data.astype(np.int16), np.int16(-1))
    out, h = np.zeros(n, np.int64), np.zeros(-(-n // lane), np.int64)
    for k in range(lane):
        i = np.arange(k, n, lane)
        j, h = before[i], np.maximum(h[: len(i)] - 1, 0)
        h[j < 0] = 0
        alive = np.flatnonzero(j >= 0)
        while len(alive):  # eight bytes at a time
            a, b = i[alive] + h[alive], j[alive] + h[alive]
            fits = np.maximum(a, b) + 8 <= n
            alive, a, b = alive[fits], a[fits], b[fits]
            alive = alive[eight[a] == eight[b]]
            h[alive] += 8
        alive = np.flatnonzero(j >= 0)
        while len(alive):
            alive = alive[ended[i[alive] + h[alive]] == ended[j[alive] + h[alive]]]
            h[alive] += 1
        out[i] = h
    return out[order]


class Shard:
    """Snippets and their suffix array: the distinct windows in order, the least owner of each, and the window at each place."""

    def __init__(self, snippets: list[bytes], owner: np.ndarray):
        self.data = np.frombuffer(SEPARATOR.join([*snippets, b""]), np.uint8)
        lengths = np.array([len(x) for x in snippets], np.int64)
        self.windows = np.maximum(lengths - LENGTH + 1, 0)
        begin = np.cumsum(lengths + 1) - lengths - 1
        self.starts = np.repeat(begin - (np.cumsum(self.windows) - self.windows), self.windows) + np.arange(self.windows.sum())
        self.who = np.repeat(owner, self.windows)
        order, _ = suffix_array(self.data)
        new = common_prefixes(self.data, order) < LENGTH
        new[:1] = True
        at = np.full(len(self.data), -1, np.int64)
        at[order] = np.cumsum(new) - 1
        # Suffixes that run into a separator aren't windows; what is left is numbered anew, in order.
        used = np.zeros(len(self.data), np.int64)
        used[at[self.starts]] = 1
        self.of = (np.cumsum(used) - 1)[at[self.starts]]
        self.least, self.heads = np.full(used.sum(), _NO_ONE), np.zeros(used.sum(), np.int64)
        np.minimum.at(self.least, self.of, self.who)
        self.heads[self.of] = self.starts

    def keys(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The bytes of the distinct windows, in order."""
        return np.ascontiguousarray(self.data[self.heads[some][:, None] + np.arange(LENGTH)]).view(_KEY)[:, 0]

    def covered(self, least: np.ndarray) -> list[np.ndarray]:
        """Per snippet, which of its windows a smaller id has."""
        return np.split(least[self.of] < self.who, np.cumsum(self.windows)[:-1])


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (windows, least owners) as one; each window of the shorter is looked up in the longer by binary search."""
    (keys, least), (more, other) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    if not len(keys):
        return keys, least
    at = np.searchsorted(keys, more)
    held = keys[np.minimum(at, len(keys) - 1)] == more
    held &= at < len(keys)
    least = least.copy()
    np.minimum.at(least, at[held], other[held])
    return np.insert(keys, at[~held], more[~held]), np.insert(least, at[~held], other[~held])


def merge_all(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs as one, pair by pair."""
    while len(parts) > 1:
        parts = [merged(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def shared_windows(snippets: list[bytes], owner: np.ndarray) -> list[np.ndarray]:
    """Per snippet, which of its windows also stand in a snippet of a smaller owner."""
    cuts, size = [0], 0
    for i, x in enumerate(snippets):
        size += len(x)
        if size >= SHARD_BYTES or i == len(snippets) - 1:
            cuts.append(i + 1)
            size = 0
    if len(cuts) == 2:
        one = Shard(snippets, owner)
        return one.covered(one.least)
    shards = [Shard(snippets[lo:hi], owner[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    keys, least = merge_all([(x.keys(), x.least) for x in shards])
    return [c for x in shards for c in x.covered(least[np.searchsorted(keys, x.keys())])]


def _answers(t: pa.Table, covered: list[np.ndarray]) -> dict[str, pa.Array]:
    """The windows to remove, as answers to the blocks that sent the snippets of ``t``."""
    bits = [np.packbits(c).tobytes() if c.any() else None for c in covered]
    keep = pa.array([i for i, x in enumerate(bits) if x], pa.int64())
    block, entry = (t.column(c).combine_chunks().take(keep) for c in ("block", "entry"))
    return {"block": block, "kind": pa.array([1] * len(keep), pa.int32()), "at": entry, "payload": pa.array([x for x in bits if x], pa.binary())}


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, _ in whole_groups(batches, ["h"], 10_000):
        yield pa.record_batch(_answers(t, shared_windows(t.column("snippet").to_pylist(), t.column("d").to_numpy())))


_RUNS = "h long, part int, salt int, keys binary, least binary"


def _sorted_runs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One shard of a frequent anchor: its sorted windows, dealt by their hash to as many ranges as the anchor has shards."""
    shard, parts = Shard(table.column("snippet").to_pylist(), table.column("d").to_numpy()), table.column("parts")[0].as_py()
    out = [(key[0].as_py(), r, key[1].as_py(), shard.keys(some).tobytes(), shard.least[some].tobytes()) for r, some in _ranges(shard, parts)]
    give_back()
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["h", "part", "salt", "keys", "least"])


def _ranges(shard: Shard, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    prefix = prefix_hash(shard.data)
    of = range_hash(prefix, shard.heads, shard.heads + LENGTH) % np.uint64(parts)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(parts + 1, dtype=np.uint64))
    for r in range(parts):
        if cuts[r] < cuts[r + 1]:
            yield r, order[cuts[r] : cuts[r + 1]]


def _merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One range of a frequent anchor's windows: the least owners over all shards, for each shard in its order."""
    own = [np.frombuffer(x.as_py(), _KEY) for x in table.column("keys")]
    keys, least = merge_all([(k, np.frombuffer(x.as_py(), np.int64)) for k, x in zip(own, table.column("least"), strict=True)])
    found = [least[np.searchsorted(keys, k)].tobytes() for k in own]
    give_back()
    return pa.table([table.column("h"), table.column("salt"), table.column("part"), pa.array(found, pa.binary())], names=["h", "salt", "part", "least"])


def _settle_shard(left: pa.Table, right: pa.Table) -> pa.Table:
    """One shard of a frequent anchor, with the least owners that merging has found."""
    if not left.num_rows:
        return pa.table({"block": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "at": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})
    shard, parts = Shard(left.column("snippet").to_pylist(), left.column("d").to_numpy()), left.column("parts")[0].as_py()
    found = dict(zip(right.column("part").to_pylist(), right.column("least").to_pylist(), strict=True))
    least = shard.least.copy()
    for r, some in _ranges(shard, parts):
        least[some] = np.frombuffer(found[r], np.int64)
    out = pa.table(_answers(left, shard.covered(least)))
    give_back()
    return out


def _remove(deal: Deal, wanted: dict[str, pa.DataType]) -> Callable:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in wanted}
        if left.num_rows:
            b = Block(left, deal)
            kind = right.column("kind").to_numpy() if right.num_rows else np.zeros(0, np.int32)
            codes = b.codes(right.filter(pa.array(kind == 0))) if right.num_rows else np.zeros(len(b.h), np.uint8)
            bits = {}
            if right.num_rows:
                some = right.filter(pa.array(kind == 1))
                bits = dict(zip(some.column("at").to_pylist(), some.column("payload").to_pylist(), strict=True))
            for p, (row, data, offsets, r) in enumerate(b.parts):
                lo = int(b.first_run[p])
                entry = b.entry[lo : lo + len(r["first"])]
                owner = b.least[entry]
                full = (b.id_of_run[lo : lo + len(entry)] > owner) | (codes[entry] == 1)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, r["first"][full], 1)
                np.add.at(edge, r["last"][full] + LENGTH, -1)
                for k in np.flatnonzero(~full & (codes[entry] == 2)).tolist():
                    if (x := bits.get(int(entry[k]))) is not None:
                        n = int(r["last"][k] - r["first"][k]) + 1
                        at = r["first"][k] + np.flatnonzero(np.unpackbits(np.frombuffer(x, np.uint8))[:n])
                        edge[at] += 1
                        edge[at + LENGTH] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                for i in range(len(offsets) - 1):
                    own, g = data[offsets[i] : offsets[i + 1]], gone[offsets[i] : offsets[i + 1]]
                    rest = own[~g].tobytes() if g.any() else own.tobytes()
                    values = {"n_bytes": len(own), "n_removed": int(g.sum()), "n_spans": int(np.count_nonzero(g[1:] & ~g[:-1]) + bool(len(g) and g[0]))}
                    for name in out.keys() & values.keys():
                        out[name].append(values[name])
                    if "kept" in out:  # a character that loses some of its bytes goes as a whole
                        out["kept"].append(rest.decode("utf-8", "ignore"))
                    if "kept_sha256" in out:
                        out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
        for name in ("doc_id", "row"):
            if name in out:
                out[name] = left.column(name).combine_chunks()
        table = pa.table([x if isinstance(x, pa.Array) else pa.array(x, wanted[k]) for k, x in out.items()], names=list(wanted))
        give_back()
        return table

    return run


def _frequent(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, tasks) of the anchors that many different snippets share in a sample of about SAMPLE_BYTES: those documents
    with the least hashes of their ids. At most SAMPLE_BYTES / FREQUENT anchors come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                r = runs(*buffers(part.column("text")))
                pair = np.unique(np.stack([r["h"], r["s"]], axis=1), axis=0).view(np.int64)
                yield pa.record_batch([pa.array(np.ascontiguousarray(pair[:, i])) for i in (0, 1)], ["h", "s"])

    share = min(1.0, SAMPLE_BYTES / max(1, size))
    sample = docs.where(F.xxhash64("doc_id", F.lit(3)) <= int(-(1 << 63) + share * ((1 << 64) - 1))) if share < 1 else docs
    pairs = sample.select("text").mapInArrow(tidy(run), "h long, s long").distinct()
    rows = pairs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).collect()
    hashes = np.array([r.h for r in rows], np.int64).view(np.uint64)
    bytes_ = np.array([r.n for r in rows], np.int64) / share * (LENGTH + SPAN / 2)
    parts = np.ceil(bytes_ / SHARD_BYTES).astype(np.int64)
    order = np.argsort(hashes)[parts[np.argsort(hashes)] > 1]
    return hashes[order], parts[order]


def _removed(docs: DataFrame, wanted: dict[str, pa.DataType], schema: T.StructType) -> DataFrame:
    """``wanted`` of docs (doc_id, text as bytes, row): what is left of each row when repeats are removed."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks, buckets = max(1, -(-size // BLOCK_BYTES)), max(1, -(-2 * size // (SPAN + 1) // BUCKET_ENTRIES))
    deal = Deal(buckets, *_frequent(docs, size))
    texts = docs.withColumn("block", F.expr(f"pmod(xxhash64(doc_id), {blocks})"))
    answers = texts.groupBy("block").applyInArrow(_send(deal), _ENTRIES).groupBy("bucket").applyInArrow(_meet, _ANSWERS)
    snippets = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_compare(deal), _SNIPPETS)
    settled = snippets.where("parts = 1").repartition("h").sortWithinPartitions("h", "d").mapInArrow(tidy(_settle), _ANSWERS)
    if len(deal.frequent):
        frequent = snippets.where("parts > 1")  # not saved: a job of its own would deal all texts and entries once more
        ranges = frequent.groupBy("h", "salt").applyInArrow(_sorted_runs, _RUNS)
        least = ranges.groupBy("h", "part").applyInArrow(_merge, "h long, salt int, part int, least binary")
        shards = frequent.groupBy("h", "salt").cogroup(least.groupBy("h", "salt")).applyInArrow(_settle_shard, _ANSWERS)
        settled = settled.unionByName(shards)
    return texts.groupBy("block").cogroup(answers.unionByName(settled).groupBy("block")).applyInArrow(_remove(deal, wanted), schema)


_COUNTS = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256 of the bytes left, for every row of docs
    with a doc_id.

    Takes doc_id and text; other columns are ignored, whatever their names. Documents are UTF-8 bytes (null: empty), judged
    as they come in, and of any length. Rows that repeat a doc_id are rows of their own and don't repeat each other. Texts
    under LENGTH bytes lose nothing. Of equal strings the one in the smallest doc_id stays. An empty table gives no rows.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    schema = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _removed(rows, {"doc_id": pa.int64()} | _COUNTS, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of ``text``; a character that loses some of its bytes goes as a whole.

    All other columns come back as they are, whatever their names and types. Null texts stay null. Rows without a doc_id
    have no order and stay as they are. Cases of remove_repeats() have its results.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.col("text").isNull().alias("text")).alias("row")
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"), row)
    schema = T.StructType([T.StructField("kept", T.StringType()), rows.schema["row"]])
    done = _removed(rows, {"kept": pa.string(), "row": pa.null()}, schema)
    text = F.when(~F.col("row.text"), F.col("kept")).alias("text")
    return done.select(*(text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns)).unionByName(docs.where("doc_id is null"))
