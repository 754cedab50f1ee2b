"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces are dealt into groups of bounded size, each packed best-fit decreasing. Nearly full bins are final. Underfull
bins go up a tree as items of their own and are packed again with those of other groups, until one group is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import saved, slices, tidy, utf8, whole_groups
from leadlens.llm.wordbpe import WordBpe

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bins filled to this share are final.
FULL = 0.984
#: Bins, and pieces within them, that a task of a round packs.
GROUP_ITEMS, GROUP_PIECES = 20_000, 2_000_000
#: A round that lowers the number of its bins by less than this share is the last: what is left doesn't fit together.
LEAST_GAIN = 0.02


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of every item, and the number of bins, by best-fit decreasing in time linear in the items.

    ``free`` has bit r set if some open bin has room for exactly r, so that the tightest fitting bin is its lowest bit from the size on.
    """
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    free, bins = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = free >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            k = open_bins[room].pop()
            if not open_bins[room]:
                free ^= 1 << room
        else:
            k, room, bins = bins, capacity, bins + 1
        bin_of[i], offset[i] = k, capacity - room
        if room > s:
            open_bins[room - s].append(k)
            free |= 1 << (room - s)
    return bin_of, offset, bins


def _pieces(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = WordBpe.load(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out: list[list[int]] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), bpe.encode(part.column("text").cast(pa.string()).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for x, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                            x.append(v)
                yield pa.record_batch([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Documents as token pieces of at most ``capacity``: doc_id, piece, start, length, ids_crc32. Null text: the end id alone."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(tidy(_pieces(tokenizer, capacity, end_id)), PIECES)


def _pack(capacity: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["part"]):
            parts, fills = t.column("part").to_numpy(), t.column("fill").to_numpy()
            items, starts = (c.combine_chunks() for c in (t.column("items"), t.column("starts")))
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                bin_of, offset, bins = best_fit(fills[lo:hi], capacity)
                own, at = items.slice(lo, hi - lo), starts.slice(lo, hi - lo)
                counts = pa.compute.list_value_length(own).to_numpy()
                order = np.argsort(np.repeat(bin_of, counts), kind="stable")
                lists = pa.array(np.concatenate([[0], np.cumsum(np.bincount(bin_of, counts, bins).astype(np.int64))]), pa.int32())
                moved = at.flatten().to_numpy() + np.repeat(offset, counts)
                filled = np.bincount(bin_of, fills[lo:hi], bins).astype(np.int64)
                yield pa.record_batch(
                    {
                        "bin": pa.array((level << 56) + (int(parts[lo]) << 28) + np.arange(bins, dtype=np.int64)),
                        "fill": pa.array(filled),
                        "items": pa.ListArray.from_arrays(lists, own.flatten().take(pa.array(order))),
                        "starts": pa.ListArray.from_arrays(lists, pa.array(moved[order])),
                    }
                )

    return run


def packed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each piece of ``pieces`` (doc_id, piece, length, others) a place: adds sequence_id and offset (from 0, gapless).

    Lengths are 1 to ``capacity``. Repeated rows are pieces of their own. An empty table gives an empty one. Rounds have as
    many groups as the bins that are left need, so that no task grows with the table; they end with one group, or with
    a round that makes few bins less.
    """
    item = F.struct(*pieces.columns)
    rows = pieces.select(F.col("length").alias("fill"), F.array(item).alias("items"), F.array(F.lit(0).cast("long")).alias("starts"), F.xxhash64("doc_id", "piece").alias("spread"))
    left, groups, level, done = None, max(1, -(-pieces.count() // GROUP_ITEMS)), 0, None
    kind = f"bin long, fill long, items array<{item_type(pieces)}>, starts array<long>"
    while True:
        dealt = rows.select("fill", "items", "starts", F.pmod("spread", F.lit(groups)).alias("part"), "spread")
        bins = saved(dealt.repartition("part").sortWithinPartitions("part", "spread").drop("spread").mapInArrow(tidy(_pack(capacity, level)), kind))
        open_ = F.col("fill") < int(FULL * capacity)
        n = bins.agg(F.count("*").alias("bins"), F.count_if(open_).alias("open"), F.sum(F.when(open_, F.size("items"))).alias("pieces")).first()
        if groups == 1 or (left is not None and n.bins > (1 - LEAST_GAIN) * left):
            done = bins if done is None else done.union(bins)
            break
        done = bins.where(~open_) if done is None else done.union(bins.where(~open_))
        rows = bins.where(open_).select("fill", "items", "starts", F.xxhash64("bin").alias("spread"))
        left, level = n.open, level + 1
        groups = max(1, -(-left // GROUP_ITEMS), -(-(n.pieces or 0) // GROUP_PIECES))
    one = done.select(F.col("bin").alias("sequence_id"), F.explode(F.arrays_zip("items", "starts")).alias("x"))
    return one.select("x.items.*", "sequence_id", F.col("x.starts").alias("offset"))


def item_type(df: DataFrame) -> str:
    return df.schema.simpleString()


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise documents and pack them into sequences of at most ``capacity`` tokens: a row for each piece.

    Takes doc_id and text; others are ignored and may have any name. Null and empty texts are one piece that holds the
    end id. Texts of any length are encoded whole and cut. Repeated rows and rows without an id are documents of their
    own. Of equal lengths any goes first: which sequence a piece lies in is not fixed. An empty table gives no rows.
    """
    return packed(saved(tokenized(docs, tokenizer, capacity, end_id)), capacity)
