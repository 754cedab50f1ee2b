"""Cleaning, comparison forms, terms, chunks and quotes of longer texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space that isn't a plain blank or a line break, from the Unicode tables.
_BLANKS = "".join(chr(i) for i in [*range(0x80, 0x3001), 0xFEFF] if unicodedata.category(chr(i)) == "Zs" or i in (0x200B, 0xFEFF))
#: Signs that are one in comparisons.
SAME_SIGN = {"'": "‘’‚‛′´`", '"': "“”„‟″", "-": "‐‑‒–—―−", "ا": "آأإٱ", "ي": "ى", "ه": "ة"}
#: Arabic marks above and below letters, and the stroke that stretches words, from the Unicode tables.
_ARABIC_MARKS = "".join(chr(i) for i in range(0x600, 0x700) if unicodedata.category(chr(i)) == "Mn") + "\u0640"


@F.pandas_udf(StringType())
def composed(texts: pd.Series) -> pd.Series:
    """Letters with their combining marks as one character each (NFC), for which there is no built-in function."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def clean(c: Column) -> Column:
    """White space runs to one blank, lines trimmed, at most one empty line. composed() goes before it where texts need it."""
    lines = F.split(F.translate(c, _BLANKS + "\t\f\x0b", " " * (len(_BLANKS) + 3)), "\n")
    trimmed = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return F.trim(F.array_join(F.filter(trimmed, lambda x: x != ""), "\n"))


def match_form(c: Column) -> Column:
    """For comparing quotes: one form of quotes, dashes and Arabic letters, no Arabic marks, lower case, single blanks."""
    signs = F.translate(c, "".join(SAME_SIGN.values()) + _ARABIC_MARKS, "".join(k * len(v) for k, v in SAME_SIGN.items()))
    return F.trim(F.regexp_replace(F.lower(signs), r"\s+", " "))


def has_term(c: Column, term: str) -> Column:
    """The term as a whole word; Arabic terms anywhere."""
    if re.search("[؀-ۿ]", term):
        return F.contains(c, F.lit(term))
    return c.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}]){re.escape(term)}($|[^\p{{L}}\p{{N}}])")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def query_terms(c: Column, drop: list[str] = ("the", "for", "of", "all", "any")) -> Column:
    """The parts of a search between commas, semicolons, slashes, "or" and "and"; phrases over three words also word by word."""
    parts = F.filter(F.transform(F.split(F.lower(c), r"\s*(?:[,;/]|\bor\b|\band\b)\s*"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin(*drop))
    words = F.flatten(F.transform(F.filter(parts, lambda p: F.size(F.split(p, " ")) > 3), lambda p: F.filter(F.split(p, " "), lambda w: ~w.isin(*drop))))
    return F.array_distinct(F.concat(parts, words))


def chunks(c: Column, size: int, overlap: int = 500) -> Column:
    """array<struct<start, text>> of overlapping windows over the whole text; starts count from 0."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.substr(c, s + 1, F.lit(size)).alias("text")))


def relevant_chunks(c: Column, size: int, pattern: str, most: int = 2) -> Column:
    return F.slice(F.filter(chunks(c, size), lambda x: x["text"].rlike(pattern)), 1, most)


def csv_cell(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula: a quote stands before = + - @, tab and return."""
    return F.when(c.rlike("^[=+\\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def decide(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The reason of the first rule that holds."""
    out = F
    for condition, reason in rules:
        out = out.when(condition, reason)
    return out.otherwise(otherwise)
