"""A buyer's team: who of a company's people fills which slot, nobody twice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Slot:
    """A slot with the titles and, for people without a title, the buying roles that fit it. More special slots come first."""

    name: str
    titles: tuple[str, ...]
    roles: tuple[str, ...]


def _isin(c: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(c.isin(*values), F.lit(False)) if values else F.lit(False)


def team_slots(people: DataFrame, slots: list[Slot]) -> DataFrame:
    """company, slot, person for every slot of every company that has people; person is null where nobody fits.

    ``people`` has company, person, title, role, slot (one that a user has put the person in, or null). In three passes
    each slot that is open takes the first person, by id, that nobody has taken: those put there, then by title, then
    by role. A slot can lose at most one candidate to each other slot, so that as many candidates as there are slots are
    kept of each, whatever number of people a company has.
    """
    cells = []
    for i, s in enumerate(slots):
        untitled = F.col("title").isNull()
        for turn, fits in enumerate((F.col("slot").eqNullSafe(s.name), ~untitled & _isin(F.col("title"), s.titles), untitled & _isin(F.col("role"), s.roles))):
            cells.append(F.when(fits, F.struct(F.lit(turn).alias("turn"), F.lit(i).alias("at"))))
    fit = people.select("company", "person", F.explode(F.array_compact(F.array(*cells))).alias("c")).select("company", "person", "c.*")
    nth = F.row_number().over(Window.partitionBy("company", "turn", "at").orderBy("person"))
    few = fit.withColumn("nth", nth).where(F.col("nth") <= len(slots))
    lists = few.groupBy("company", "turn", "at").agg(F.array_sort(F.collect_list("person")).alias("list"))
    steps = lists.groupBy("company").agg(F.array_sort(F.collect_list(F.struct("turn", "at", "list"))).alias("steps"))
    kind = people.schema["person"].dataType.simpleString()
    first = F.array().cast(f"array<struct<at:int,person:{kind}>>")

    def step(out: Column, x: Column) -> Column:
        free = F.get(F.filter(x["list"], lambda p: ~F.exists(out, lambda o: o["person"] == p)), F.lit(0))
        closed = F.exists(out, lambda o: o["at"] == x["at"])
        return F.when(closed | free.isNull(), out).otherwise(F.array_append(out, F.struct(x["at"].alias("at"), free.alias("person"))))

    taken = steps.select("company", F.aggregate("steps", first, step).alias("taken"))
    every = people.select("company").distinct().join(taken, "company", "left")
    names = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(s.name).alias("slot")) for i, s in enumerate(slots)])
    rows = every.select("company", "taken", F.explode(names).alias("s"))
    return rows.select("company", "s.slot", F.get(F.filter("taken", lambda o: o["at"] == F.col("s.at")), F.lit(0))["person"].alias("person"))
