"""The part of a long text that a costly reader gets: paragraphs by what they say, with their neighbours, within a budget."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.binding import let


@dataclass(frozen=True)
class Focus:
    """``points``: words that make a paragraph worth that much, most first. ``about``: words of which the paragraph or a neighbour needs one."""

    points: dict[int, tuple[str, ...]]
    about: tuple[str, ...]
    limit: int = 4500
    head: int = 200
    shortest: int = 40
    #: Without a paragraph worth anything: the least length and words of a line to begin at, and what is shown of the text.
    line: tuple[int, int] = (100, 15)
    stretch: int = 6500


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _any(words: Column, table: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, table)).cast("array<string>"))


def _worth(words: Column, f: Focus) -> Column:
    out = F.lit(0)
    for points, table in sorted(f.points.items()):
        out = F.when(_any(words, table), points).otherwise(out)
    return out


def focus_text(text: Column, f: Focus) -> Column:
    """At most ``f.limit`` characters of a text as it stands: its head, then the paragraphs worth most, each followed by the
    one before and the one after it; one that doesn't fit any more is passed over.

    Ties go by place. A text without such a paragraph gives its first line and a stretch from its first long line that
    is worth anything, or its beginning. Null gives null.
    """

    def ranked(tagged: Column) -> Column:
        near = lambda n: F.coalesce(F.get(tagged, n)["about"], F.lit(False))
        fit = lambda x, n: (x["worth"] > 0) & (F.length(x["part"]) >= f.shortest) & (x["about"] | F.when(n > 0, near(n - 1)).otherwise(False) | near(n + 1))
        rows = F.transform(tagged, lambda x, n: F.when(fit(x, n), F.struct((-x["worth"]).alias("worth"), n.alias("n"))))
        order = F.flatten(F.transform(F.array_sort(F.array_compact(rows)), lambda r: F.array(r["n"], r["n"] - 1, r["n"] + 1)))
        return F.struct(tagged.alias("tagged"), F.array_distinct(order).alias("order"))

    def chosen(x: Column) -> Column:
        head = F.left(text, F.lit(f.head))
        first = F.struct(F.array().cast("array<string>").alias("parts"), F.length(head).alias("used"))

        def step(acc: Column, n: Column) -> Column:
            part = F.when((n >= 0) & (n < F.size(x["tagged"])), F.get(x["tagged"], n)["part"])
            fits = F.coalesce((F.length(part) >= 10) & (acc["used"] + F.length(part) + 1 <= f.limit), F.lit(False))
            return F.struct(F.when(fits, F.array_append(acc["parts"], part)).otherwise(acc["parts"]).alias("parts"), (acc["used"] + F.when(fits, F.length(part) + 1).otherwise(0)).alias("used"))

        taken = F.aggregate(x["order"], first, step, lambda acc: acc["parts"])
        return F.when(F.size(x["order"]) > 0, F.array_join(F.concat(F.array(head), taken), "\n")).otherwise(beginning())

    def beginning() -> Column:
        lines = F.split(text, "\n")
        least, words = f.line

        def stretch(all_lines: Column) -> Column:
            good = lambda s: (F.length(s) >= least) & (F.size(F.split(s, r"\s+")) >= words) & (_worth(_words(s), f) > 0)
            at = F.get(F.array_compact(F.transform(all_lines, lambda s, k: F.when(good(s), k))), F.lit(0))
            offset = F.aggregate(F.slice(all_lines, F.lit(1), F.coalesce(at, F.lit(0))), F.lit(0), lambda n, s: n + F.length(s) + 1)
            cut = lambda start: F.concat(F.when(start > 0, F.concat(F.get(all_lines, F.lit(0)), F.lit("\n"))).otherwise(""), F.substr(text, start + 1, F.lit(f.stretch)))
            return F.left(let(F.when(at.isNull(), 0).otherwise(F.greatest(offset - 200, F.lit(0))), cut), F.lit(f.limit))

        return let(lines, stretch)

    tagged = F.transform(F.split(text, "\n+"), lambda p: let(_words(p), lambda w: F.struct(p.alias("part"), _worth(w, f).alias("worth"), _any(w, f.about).alias("about"))))
    return let(let(tagged, ranked), chosen)
