"""Mixing sources to target weights by entropy balancing, in DataFrame functions alone.

A document's rate is the number of times the mix takes it, between 0 and 2. Of all rates that give each source its
target of words, those are taken that stay nearest to 1 in relative entropy: with x the document's size over the mean
size of its source, log(rate / (2 - rate)) = tilt * x, an exponential tilt with one dual variable a source. The convex
dual falls apart by source; Newton's method solves all sources at once, one aggregation of the histogram of sizes a
step. Rates become copies (0, 1 or 2) by cumulative rounding from the longest documents to the shortest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.llm.common import files, saved

#: Weights of sources in order, repeating; what the mix takes of all sizes; the most that is taken of a document.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Documents of one source and size among which ranks are counted in one task.
BUCKET_ROWS = 50_000
#: Newton steps at most; some five are taken. Steps are ended by the first that finds all sources this near to their target.
STEPS, NEAR = 60, 1e-9
#: Steps in which documents of one size of a source are taken once more or less, to close what rounding has left open; one to three are taken.
MENDS = 8


def _exact(x: Column) -> Column:
    """Doubles whose sums don't depend on the order, so that runs agree."""
    return x.cast("decimal(38,10)")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text) and key, a digest of the id and the text that orders equal sizes."""
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text).cast("binary"))
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), key.alias("key"))


def numbered(sources: DataFrame, rows: int) -> DataFrame:
    """``sources`` with ``place``: 0, 1, ... in code-point order of the source, null last; ranges are sorted apart."""
    ranged = saved(sources.repartitionByRange(files(rows), F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("part").agg(F.count("*").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.asc_nulls_last("source")))
    return ranged.withColumn("within", within).join(base, "part").select(*sources.columns, (F.col("base") + F.col("within") - 1).alias("place"))


def filled(sources: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``: a share of all sizes by weight, at most ``most`` times the source's size.

    Each round gives what full sources leave to the others by weight and marks those that are full then. The driver
    sees two sums a round. The level only rises, so that a source that is full stays full.
    """
    left, weight, full = 0.0, 1.0, -1
    room = F.col("source_size") * float(most)
    while True:
        over = F.lit(left) * F.col("weight") > room * weight
        row = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(over, room)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("weight"), F.count_if(over).alias("full")).first()
        if row["full"] == full or not row["weight"]:
            return sources.withColumn("target", F.when(over, room).otherwise(F.lit(left) * F.col("weight") / weight))
        left, weight, full = (row["all"] or 0) * share - (row["taken"] or 0.0), float(row["weight"]), row["full"]


def tilts(cells: DataFrame, sources: DataFrame, most: float = MOST) -> DataFrame:
    """(place, tilt) for the sources whose target lies between nothing and ``most`` times their size.

    ``cells`` has place, size, n (documents) and x (size over the source's mean). Newton's step is taken on the log
    odds of the words that the tilt gives, which are nearly linear in it; a step out of the bracket halves it.
    """
    room = F.col("source_size") * float(most)
    state = saved(sources.where((F.col("target") > 0) & (F.col("target") < room)).select("place", room.alias("room"), "target", F.lit(0.0).alias("tilt"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    odds = lambda v: F.log(v / (F.col("room") - v))
    for _ in range(STEPS):
        share = 1 / (1 + F.exp(-F.col("tilt") * F.col("x")))
        words = F.col("n") * F.col("size") * float(most)
        sums = cells.join(state.select("place", "tilt"), "place").groupBy("place").agg(F.sum(_exact(words * share)).cast("double").alias("given"), F.sum(_exact(words * F.col("x") * share * (1 - share))).cast("double").alias("slope"))
        at = state.join(sums, "place").withColumn("off", odds(F.col("given")) - odds(F.col("target")))
        at = at.withColumn("low", F.when(F.col("off") < 0, F.col("tilt")).otherwise(F.col("low"))).withColumn("high", F.when(F.col("off") > 0, F.col("tilt")).otherwise(F.col("high")))
        step = F.col("tilt") - F.col("off") / (F.col("slope") * (1 / F.col("given") + 1 / (F.col("room") - F.col("given"))))
        middle = F.when(F.col("low") == float("-inf"), F.col("high") * 2 - 1).when(F.col("high") == float("inf"), F.col("low") * 2 + 1).otherwise((F.col("low") + F.col("high")) / 2)
        good = step.isNotNull() & ~F.isnan(step) & (step >= F.col("low")) & (step <= F.col("high"))
        state = saved(at.select("place", "room", "target", F.when(good, step).otherwise(middle).alias("tilt"), "low", "high", (F.abs(F.col("given") - F.col("target")) > NEAR * F.col("target")).alias("open")))
        if state.where("open").isEmpty():
            break
        state = state.drop("open")
    return state.select("place", "tilt")


def rounded(cells: DataFrame) -> DataFrame:
    """``cells`` (place, size, n, rate, target) with ``copies``, whole numbers that all documents of a cell get together.

    Copies follow the running sum of n * rate from the longest size down, which keeps a source's words within half of its
    longest document. Up to MENDS times, that size is looked for of which some documents taken once more or less bring
    the source nearest to its target; of equally good ones the longest.
    """
    running = F.sum(_exact(F.col("n") * F.col("rate"))).over(Window.partitionBy("place").orderBy(F.desc("size")))
    # Running sums of exactly one half, as equal sizes give them, are rounded up whatever the last digits of a rate are.
    up = cells.withColumn("up", F.floor(running + F.expr("0.500001bd")).cast("long"))
    out = saved(up.withColumn("copies", F.col("up") - F.lag("up", 1, 0).over(Window.partitionBy("place").orderBy(F.desc("size")))).drop("up"))
    for _ in range(MENDS):
        gap = out.groupBy("place").agg((F.floor(F.first("target") + 0.5) - F.sum(F.col("copies") * F.col("size"))).cast("long").alias("gap"))
        both = out.where("size > 0").join(gap.where("gap != 0"), "place")
        room = F.when(F.col("gap") > 0, MOST * F.col("n") - F.col("copies")).otherwise(F.col("copies"))
        some = F.least(room, F.greatest(F.lit(1), F.floor(F.abs("gap") / F.col("size"))))
        both = both.withColumn("some", some).withColumn("left", F.abs(F.abs("gap") - F.col("some") * F.col("size")))
        rank = F.struct("left", (-F.col("size")).alias("size"), (F.signum("gap") * F.col("some")).cast("long").alias("some"))
        best = saved(both.where((F.col("some") > 0) & (F.col("left") < F.abs("gap"))).groupBy("place").agg(F.min(rank).alias("b")).select("place", (-F.col("b.size")).alias("size"), "b.some"))
        if best.isEmpty():
            break
        out = saved(out.join(best, ["place", "size"], "left").withColumn("copies", F.col("copies") + F.coalesce("some", F.lit(0))).drop("some"))
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken (size times copies).

    Takes doc_id, source, text; other columns may have any name. A null text has size 0, a null source is a source.
    Documents of size 0 are taken with 0 words. Every row is a document, also where ids repeat or are null; which of
    equal sizes get a copy more is settled by a digest of id and text, and equal rows share what they get in any order.
    Texts of any length count whole. An empty table gives no rows. A source's words end within half of its
    longest document from the target, as a rule within a few words.
    """
    rows = saved(sized(docs))
    sizes = saved(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("filled"))
    sources = numbered(per, sizes.count())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = saved(filled(saved(sources.withColumn("weight", weight)), share))

    s = sources.select(F.col("source").alias("of"), "place", "source_size", "filled", "target")
    cells = saved(sizes.join(s, sizes["source"].eqNullSafe(s["of"])).select("place", "source", "size", "n", "source_size", "target", (F.col("size") * F.col("filled") / F.greatest("source_size", F.lit(1))).alias("x")))
    tilt = tilts(cells.where("size > 0"), sources)
    rate = F.when(F.col("target") <= 0, 0.0).when(F.col("target") >= F.col("source_size") * MOST, float(MOST)).otherwise(MOST / (1 + F.exp(-F.col("tilt") * F.col("x"))))
    whole = rounded(cells.join(tilt, "place", "left").withColumn("rate", rate).drop("tilt", "x"))

    c = whole.select(F.col("source").alias("of"), F.col("size").alias("long"), "place", "n", "copies", "source_size", "target")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    dealt = rows.join(c, rows["source"].eqNullSafe(c["of"]) & (F.col("size") == F.col("long"))).withColumn("bucket", F.expr("cast(conv(substring(key, 1, 8), 16, 10) as long)") * buckets / F.lit(1 << 32))
    dealt = dealt.withColumn("bucket", F.floor("bucket"))
    cell = ["place", "size"]
    before = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*cell, "bucket").agg(F.count("*").alias("rows")).select(*cell, "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("key"))).join(base, [*cell, "bucket"])
    each = F.expr("copies div n + int(base + rank <= copies % n)")
    return ranked.select("doc_id", "size", "source_size", "target", (F.col("size") * each).cast("long").alias("taken"))
