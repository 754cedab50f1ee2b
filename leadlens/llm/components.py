"""Connected components of a link table by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import saved


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(id, label) for every id in ``links``: label is the smallest id that it reaches.

    Each round takes the least label among the neighbours and then the label of the label. All steps are
    equi-joins and minima that combine before the shuffle, so a hub with most of the links is no hot spot.
    ``rows`` is about how many ids there are, if that is known. Null ends, self links and repeated links add nothing; no links give no rows.
    """
    ways = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    edges = saved(links.select(F.explode(ways).alias("x")).select("x.*").where("u is not null and v is not null and u != v").distinct(), rows and 4 * rows)
    labels = saved(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("label")), rows)
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), F.col("label").alias("far")), "v").groupBy(F.col("u").alias("id")).agg(F.min("far").alias("far"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "far").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("top"))
        step = saved(hooked.join(up, "label", "left").select("id", "old", F.least("label", F.coalesce("top", "label")).alias("label")), rows)
        labels = step.select("id", "label")
        if step.where("label < old").isEmpty():
            return labels
