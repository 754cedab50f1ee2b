"""Amounts of money and numbers in text, with built-in functions. All patterns come from the tables of units."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions.binding import let

#: What the word after a number multiplies it by.
SCALE = {"thousand": 1e3, "lakh": 1e5, "lakhs": 1e5, "million": 1e6, "mn": 1e6, "mln": 1e6, "crore": 1e7, "crores": 1e7, "cr": 1e7, "billion": 1e9, "bn": 1e9}
#: US dollars for a unit.
USD_RATE = {"USD": 1, "EUR": 1.08, "GBP": 1.27, "INR": 1 / 83, "SAR": 1 / 3.75, "AED": 1 / 3.6725, "QAR": 1 / 3.64, "OMR": 2.6, "KWD": 3.25, "BHD": 2.65, "NOK": 1 / 10.5, "MYR": 1 / 4.7, "SEK": 1 / 10.6, "DKK": 1 / 6.9}
#: Other ways to write a currency.
ALIASES = {"$": "USD", "US$": "USD", "€": "EUR", "£": "GBP", "RS": "INR", "RS.": "INR", "₹": "INR", "SR": "SAR", "RM": "MYR"}
#: No single award is larger, in US dollars.
PLAUSIBLE = 20e9


def _any(words: list[str]) -> str:
    """A pattern for one of the words, longer ones first."""
    return "(" + "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


NUMBER = "([0-9][0-9,]*(?:[.][0-9]+)?)"
_SCALED = rf"{NUMBER}[+]?(?:\s*{_any(list(SCALE))}\b)?"
#: The currency stands before the number, as a sign or a code, or after it as a code.
LED = rf"(?i){_any([*USD_RATE, *ALIASES])}\s?{_SCALED}"
TRAILED = rf"(?i){_SCALED}\s?{_any(list(USD_RATE))}\b"


def _lookup(c: Column, table: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _times(number: Column, scale: Column) -> Column:
    return F.regexp_replace(number, ",", "").try_cast("double") * F.coalesce(_lookup(F.lower(scale), SCALE), F.lit(1.0))


def parse_money(c: Column) -> Column:
    """struct<amount, currency, usd> of the first amount that has a currency before or after it; null if there is none."""
    place = lambda pattern: F.nullif(F.regexp_instr(c, F.lit(pattern)), F.lit(0))

    def read(at: Column) -> Column:
        leads = at["led"].isNotNull() & (at["trailed"].isNull() | (at["led"] <= at["trailed"]))
        # Places count UTF-16 units: only a text of single bytes is cut there, so that its amount isn't looked for again.
        rest = F.when(F.octet_length(c) == F.length(c), F.substr(c, F.when(leads, at["led"]).otherwise(at["trailed"]))).otherwise(c)
        pick = lambda i, j: F.when(leads, F.regexp_extract(rest, LED, i)).otherwise(F.regexp_extract(rest, TRAILED, j))
        parts = F.struct(F.upper(pick(1, 3)).alias("mark"), _times(pick(2, 1), pick(3, 2)).alias("amount"))
        return F.when(at["led"].isNotNull() | at["trailed"].isNotNull(), let(parts, priced))

    def priced(p: Column) -> Column:
        return let(F.coalesce(_lookup(p["mark"], ALIASES), p["mark"]), lambda currency: F.struct(p["amount"].alias("amount"), currency.alias("currency"), F.round(p["amount"] * _lookup(currency, {k: float(v) for k, v in USD_RATE.items()})).cast("long").alias("usd")))

    return let(F.struct(place(LED).alias("led"), place(TRAILED).alias("trailed")), read)


def plausible_usd(money: Column) -> Column:
    return F.when(money["usd"] <= PLAUSIBLE, money["usd"])


def _read(c: Column, both: bool) -> Column:
    pattern = F.lit(rf"(?i){_SCALED}")
    plain, scale = F.regexp_extract_all(c, pattern, F.lit(1)), F.regexp_extract_all(c, pattern, F.lit(2))
    scaled = F.zip_with(plain, scale, lambda n, w: _times(n, w))
    return F.concat(F.transform(plain, lambda n: F.regexp_replace(n, ",", "").try_cast("double")), scaled) if both else scaled


def numbers_in(c: Column) -> Column:
    """All numbers of a text, scaled by the word that follows."""
    return _read(c, both=False)


def number_backed(value: Column, quote: Column) -> Column:
    """Whether every amount of a value stands in a quote, scaled or not, within 1 %, and in the same currency if both name one."""
    near = lambda x, y: F.when(x == 0, y == 0).otherwise(F.abs(x - y) / F.abs(x) <= 0.01)
    there = lambda amounts, stated: (F.size(amounts) > 0) & F.forall(amounts, lambda x: F.exists(stated, lambda y: near(x, y)))
    all_there = let(numbers_in(value), lambda amounts: let(_read(quote, both=True), lambda stated: there(amounts, stated)))
    a, b = parse_money(value)["currency"], parse_money(quote)["currency"]
    return F.coalesce(all_there & F.coalesce(a == b, F.lit(True)), F.lit(False))
