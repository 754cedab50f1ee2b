"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard loads. Differencing takes the two with the largest spread and adds them in
opposite order, largest load to least. Groups are dealt to tasks of bounded size, each of which differences its own
down to one partial partition; those (one row for each task) are differenced again, level by level.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import saved, whole_groups

#: Groups, or partial partitions, that one task differences.
TASK_ROWS = 20_000
#: Rows of a bucket, in which places are counted.
BUCKET_ROWS = 10_000


def differenced(loads: np.ndarray) -> np.ndarray:
    """Combine rows of shard loads to one; returns for each row the final shard of each of its columns."""
    rows, shards = loads.shape
    if not rows:
        return np.zeros((0, shards), np.int64)
    heap, sums, parts = [], {}, {}
    for i in range(rows):
        order = np.argsort(-loads[i], kind="stable")
        sums[i] = loads[i][order].tolist()
        parts[i] = (i, order.tolist())
        heap.append((sums[i][-1] - sums[i][0], i))
    heapq.heapify(heap)
    tree: list[tuple[int, int, list[int]]] = []
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        a, b = sums.pop(i), sums.pop(j)
        total = [x + y for x, y in zip(a, reversed(b), strict=True)]
        order = sorted(range(shards), key=lambda k: -total[k])
        n = rows + len(tree)
        tree.append((i, j, order))
        sums[n] = [total[k] for k in order]
        heapq.heappush(heap, (sums[n][-1] - sums[n][0], n))
    # Down the tree again: place[k] is the final shard of the k-th largest load.
    place = {heap[0][1]: list(range(shards))}
    for n in range(rows + len(tree) - 1, rows - 1, -1):
        i, j, order = tree[n - rows]
        own, up = place.pop(n), [0] * shards
        for k, o in enumerate(order):
            up[o] = own[k]
        place[i], place[j] = up, up[::-1]
    out = np.zeros((rows, shards), np.int64)
    for i in range(rows):
        out[i, parts[i][1]] = place[i]
    return out


def _difference(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in whole_groups(batches, ["task"]):
            loads = np.array(t.column("loads").combine_chunks().flatten()).reshape(-1, shards)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                place = differenced(loads[lo:hi])
                total = np.zeros(shards, np.int64)
                np.add.at(total, place, loads[lo:hi])
                n = hi - lo
                yield pa.record_batch(
                    {
                        "key": t.column("key").slice(lo, n).combine_chunks(),
                        "task": t.column("task").slice(lo, n).combine_chunks(),
                        "place": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * shards, pa.int32()), pa.array(place.ravel())),
                        "total": pa.array([total.tolist() if i == 0 else None for i in range(n)], pa.list_(pa.int64())),
                    }
                )

    return run


def balanced(groups: DataFrame, shards: int) -> DataFrame:
    """(key, shard) for groups (key string, size long): shard sums nearly equal. Null keys are a group like any other."""
    loads = F.expr(f"transform(sequence(0, {shards - 1}), i -> if(i = 0, size, 0L))")
    rows = groups.select("key", loads.alias("loads"))
    tasks, levels = max(1, -(-groups.count() // TASK_ROWS)), []
    while True:
        dealt = rows.withColumn("task", F.expr(f"cast(pmod(xxhash64(key), {tasks}) as string)"))
        out = saved(dealt.repartition("task").sortWithinPartitions("task", "key").mapInArrow(_difference(shards), "key string, task string, place array<long>, total array<long>"))
        levels.append(out)
        if tasks == 1:
            break
        rows = out.where("total is not null").select(F.col("task").alias("key"), F.col("total").alias("loads"))
        tasks = -(-tasks // TASK_ROWS)
    up = levels.pop().select(F.col("key").alias("task"), F.col("place").alias("up"))
    shard = None
    while levels:
        # A task's column k ends where the level above has put it.
        up = levels.pop().join(up, "task").select(F.col("key").alias("task"), F.expr("transform(place, p -> up[cast(p as int)])").alias("up"))
    shard = up.select(F.col("task").alias("key"), F.col("up")[0].cast("int").alias("shard"))
    return shard


def shard_documents(docs: DataFrame, shards: int = 8, extra: list[str] | None = None) -> DataFrame:
    """Deal documents to ``shards`` shards of nearly equal bytes; equal texts stay together.

    Takes doc_id and text. Returns doc_id, size (UTF-8 bytes and 1), text_crc32, law, shard, slot (gapless from 0 in
    each shard, by hash of the id) and grown_shard (null). Null text counts as empty. Repeated rows and rows without
    an id are rows of their own. A text of any length counts whole and isn't cut. Groups of equal spread are combined by
    the hash of their text. Other columns are ignored, whatever their names. An empty table gives no rows.
    """
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = saved(docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("key")))
    placed = balanced(rows.groupBy("key").agg(F.sum("size").alias("size")), shards)
    buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    dealt = saved(rows.join(placed, "key").drop("key").withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, text_crc32), {buckets})")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("rows")).select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    out = dealt.withColumn("within", within).join(base, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
