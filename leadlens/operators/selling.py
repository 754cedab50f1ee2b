"""What to sell to each buyer, and when: planned by its role, named by its sources, and not what it makes itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FITS = ("good", "possible", "competitor")


def sell_items(buyers: DataFrame, rules: DataFrame, named: DataFrame, makes: DataFrame) -> DataFrame:
    """buyer, item, fit, why, opens, closes, place: the items of each buyer in order of fit, group and item.

    ``buyers`` has buyer, role, trigger (a day or null); ``rules``, a table of a few rows, role, grp (0, 1, ...), item, fit, why, first
    and last (months after the trigger); ``named`` buyer, item; ``makes`` buyer, item. An item of several groups is the
    first's. One that a source names is a good fit, planned or not, and unplanned ones have the first group's window; one
    that the buyer makes is a competitor's, with a window only if it was planned. Without a trigger there is no window.
    """
    first = F.min(F.struct("grp", "fit", "why", "first", "last"))
    plan = buyers.select("buyer", "role").join(F.broadcast(rules), "role").groupBy("buyer", "item").agg(first.alias("p"))
    opening = rules.groupBy("role").agg(F.min(F.struct("grp", "first", "last")).alias("o"))
    said = named.select("buyer", "item").distinct().withColumn("named", F.lit(True))
    own = makes.select("buyer", "item").distinct().withColumn("own", F.lit(True))
    rows = plan.join(said, ["buyer", "item"], "full").join(own, ["buyer", "item"], "full").join(buyers, "buyer").join(F.broadcast(opening), "role", "left")
    planned, is_named, is_own = F.col("p").isNotNull(), F.coalesce("named", F.lit(False)), F.coalesce("own", F.lit(False))
    fit = F.when(is_own, FITS[2]).when(is_named, FITS[0]).otherwise(F.col("p.fit"))
    # What is both named and made, and not planned, is only made.
    window = F.when(planned, F.struct(F.col("p.first").alias("first"), F.col("p.last").alias("last"))).when(is_named & ~is_own, F.struct(F.col("o.first").alias("first"), F.col("o.last").alias("last")))
    why = F.when(is_own, "They make it").when(planned & is_named, F.concat("p.why", F.lit(", named in the source"))).when(planned, F.col("p.why")).otherwise("Named in the source")
    grp = F.coalesce(F.col("p.grp"), F.when(is_own | F.col("o").isNull(), 99).otherwise(0))
    out = rows.select("buyer", "item", fit.alias("fit"), why.alias("why"), F.add_months("trigger", window["first"]).alias("opens"), F.add_months("trigger", window["last"]).alias("closes"), grp.alias("grp"))
    order = F.array_position(F.array(*map(F.lit, FITS)), F.col("fit"))
    place = F.row_number().over(Window.partitionBy("buyer").orderBy(order, "grp", "item"))
    return out.withColumn("place", place.cast("long")).drop("grp")
