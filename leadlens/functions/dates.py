"""Dates in text and calendar rules.

A text is read as tokens: numbers, words, and the signs that part numbers. A date is a short run of tokens of the right
kinds, wherever it stands; what kind of run it is decides which token is the year, the month and the day. One pattern over
the tokens finds the runs, so that only they are taken apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.binding import let

#: How months begin.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Years that are believed, exclusive for the date of a text, inclusive for dates that are compared.
OLDEST, NEWEST = 1990, 2100
#: Tokens that may stand within a date and say nothing.
FILLERS = ["st", "nd", "rd", "th", "of"]


def _tokens(c: Column) -> Column:
    """What a date can be made of, in order, with a blank on either side of each; a full stop after a word says nothing."""
    token = rf"[0-9]++|(?<![a-z])(?!(?:{'|'.join(FILLERS)})(?![a-z]))[a-z]++|[-/]|(?<![a-z])[.]"
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(c), F.lit(token), F.lit(0)), " "), F.lit(" "))


_DAY, _TWO, _YEAR, _MONTH = "[0-9]{1,2}", "[0-9]{2}", "[0-9]{4}", f"(?=[{''.join(sorted({m[0] for m in MONTHS}))}])(?:{'|'.join(MONTHS)})[a-z]*+"
#: What a sign joins to something before it is part of a number, such as a tender's.
_FREE = "(?<![-/.] )"
#: The forms of dates as runs of tokens. Runs may share tokens, so that each is matched by looking ahead.
_FORMS = [f"{_FREE}{_YEAR} - {_TWO} - {_TWO}", f"{_DAY} {_MONTH} {_YEAR}", f"{_MONTH} {_DAY} {_YEAR}", f"{_DAY} [/.] {_DAY} [/.] {_YEAR}", f"(?<! {_DAY} ){_MONTH} {_YEAR}"]
_MONTH_ONLY = f"{_FREE}{_YEAR} - {_TWO}(?! - )"


def _found(c: Column, with_months: bool) -> Column:
    """array<struct<form, at, y, m, d>> of the dates in a text, by form and place; d is null for a month."""
    forms = [*_FORMS, _MONTH_ONLY] if with_months else _FORMS
    found = F.regexp_extract_all(_tokens(c), F.lit(rf"(?<= )(?=((?:{'|'.join(forms)})(?= )))"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda x, i: let(F.split(x, " "), lambda t: _date(t, i)))


def _date(t: Column, i: Column) -> Column:
    """The date that a run of tokens is."""
    at = lambda k: F.get(t, F.lit(k))
    value = lambda k: at(k).try_cast("int")
    month = lambda k: F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(at(k), 1, 3)).cast("int")
    cell = lambda form, y, m, day: F.struct(F.lit(form).alias("form"), i.alias("at"), y.alias("y"), m.alias("m"), day.alias("d"))
    none = F.lit(None).cast("int")
    signed = F.when(F.size(t) == 3, cell(6, value(0), value(2), none)).when(at(1) == "-", cell(1, value(0), value(2), value(4))).otherwise(cell(4, value(4), value(2), value(0)))
    named = F.when(F.size(t) == 2, cell(5, value(1), month(0), none)).when(F.length(at(0)) <= 2, cell(2, value(2), month(1), value(0))).otherwise(cell(3, value(2), month(0), value(1)))
    return F.when(at(1).isin("-", "/", "."), signed).otherwise(named)


def _sound(x: Column, ends: int = 0) -> Column:
    return (x["y"] > OLDEST - ends) & (x["y"] < NEWEST + ends) & x["m"].between(1, 12) & F.coalesce(x["d"], F.lit(1)).between(1, 31)


def parse_date(c: Column) -> Column:
    """The date of a text as yyyy-mm-dd text, a month as its first day; null if there is none or it can't be one.

    Of several dates the most exact form counts (2024-03-15, 15 March 2024, March 15, 2024, 15/03/2024, March 2024), then
    the first.
    """
    written = lambda x: F.when(_sound(x), F.format_string("%04d-%02d-%02d", x["y"], x["m"], F.coalesce(x["d"], F.lit(1))))
    return let(F.array_min(_found(c, with_months=False)), written)


def dates_in(c: Column) -> Column:
    """array<struct<y, m, d>> of all dates that a text names; d is null where it names a month only."""
    return F.transform(F.filter(_found(c, with_months=True), lambda x: _sound(x, 1)), lambda x: F.struct(x["y"].alias("y"), x["m"].alias("m"), x["d"].alias("d")))


def date_backed(value: Column, quote: Column) -> Column:
    """Whether a quote names the day of a value, or the month of a value that is one; a month backs no day."""
    return let(F.get(dates_in(value), F.lit(0)), lambda want: day_named(want, quote))


def day_named(want: Column, quote: Column) -> Column:
    """date_backed() of a value's struct<y, m, d>."""
    same = lambda q: (q["y"] == want["y"]) & (q["m"] == want["m"]) & F.when(q["d"].isNull(), want["d"].isNull()).otherwise(want["d"].isNull() | (q["d"] == want["d"]))
    return F.coalesce(F.exists(dates_in(quote), same), F.lit(False))


def award_date(text_date: Column, published: Column, is_award: Column, today: Column) -> Column:
    """The date in the text unless it lies over three days after publication or in the future; award stories fall back to their publication."""
    usable = text_date.isNotNull() & (published.isNull() | (text_date <= F.date_add(published, 3))) & (text_date <= today)
    return F.when(usable, text_date).when(is_award, published)
