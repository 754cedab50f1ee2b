"""Similarity of short texts with built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Distinct words between white space, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != "")))


def ratio(a: Column, b: Column) -> Column:
    """0 to 100 by edit distance; equal texts 100, an empty one against another 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 100).when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.round((1 - F.levenshtein(a, b) / longest) * 100)).cast("int")


def token_set_ratio(a: Column, b: Column) -> Column:
    """The best ratio among what the word sets share and what each has besides."""
    ta, tb = tokens(a), tokens(b)
    words = lambda x: F.array_join(F.array_sort(x), " ")
    base = words(F.array_intersect(ta, tb))
    x, y = F.trim(F.concat_ws(" ", base, words(F.array_except(ta, tb)))), F.trim(F.concat_ws(" ", base, words(F.array_except(tb, ta))))
    best = F.when(base == "", ratio(x, y)).otherwise(F.greatest(ratio(base, x), ratio(base, y), ratio(x, y)))
    return F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0).otherwise(best)


def jaccard(a: Column, b: Column) -> Column:
    ta, tb = tokens(a), tokens(b)
    return F.try_divide(F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb)))


def values_agree(kind: Column, a: Column, b: Column) -> Column:
    """Whether two readings of a value agree: names at 92, texts at 85, numbers within 1 %, days or months as dates, others by case."""
    number = lambda c: F.regexp_replace(c, "[^0-9.]", "").try_cast("double")
    x, y = number(a), number(b)
    near = F.abs(x - y) <= 0.01 * F.greatest(F.abs(x), F.abs(y))
    day = F.when((F.length(a) == 7) | (F.length(b) == 7), F.substring(a, 1, 7) == F.substring(b, 1, 7)).otherwise(a == b)
    out = F.when(kind == "name", token_set_ratio(F.lower(a), F.lower(b)) >= 92).when(kind == "text", token_set_ratio(F.lower(a), F.lower(b)) >= 85)
    return F.coalesce(out.when(kind == "number", near).when(kind == "date", day).otherwise(F.lower(a) == F.lower(b)), F.lit(False))
