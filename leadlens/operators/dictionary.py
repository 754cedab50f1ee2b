"""Phrases of a dictionary in texts: the dictionary is an inverted index by letters, met by the texts' word runs in one join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What parts words of a phrase may be nothing, one blank or one hyphen; whatever else stands between words ends a chain of them.
_BREAK = r"[^\p{L}\p{N}]*(?:[^\p{L}\p{N}\s-]|[\s-]{2})[^\p{L}\p{N}]*"


def spans(text: Column) -> Column:
    """array<string>: lines and sentences of a text, cut at line breaks and at blanks behind end marks."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\n"), "\n+"), lambda s: s != "")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"[\s-]"), lambda w: w != "")


def _cuts(words: Column) -> Column:
    """Where words meet when they are written without blanks."""
    ends = F.transform(words, lambda _, i: F.aggregate(F.slice(words, 1, i + 1), F.lit(0), lambda n, w: n + F.length(w)))
    return F.slice(ends, 1, F.greatest(F.size(words) - 1, F.lit(0)))


def indexed(phrases: DataFrame) -> DataFrame:
    """(item, phrase, letters, cuts): each phrase under its letters, in the singular as given and with an s behind."""
    words = _words(F.regexp_replace("phrase", r"[^\p{L}\p{N}]+", " "))
    rows = phrases.select("item", "phrase", words.alias("words")).where(F.size("words") > 0)
    letters = F.array_join("words", "")
    return rows.select("item", "phrase", F.explode(F.array(letters, F.concat(letters, F.lit("s")))).alias("letters"), _cuts(F.col("words")).alias("cuts"))


def beginnings(index: DataFrame) -> DataFrame:
    """(first): what the first word of a run can be that has an indexed phrase: its words up to a cut, or all its letters."""
    return index.select(F.explode(F.concat(F.transform("cuts", lambda c: F.substring("letters", F.lit(1), c)), F.array("letters"))).alias("first")).distinct()


def runs(texts: DataFrame, key: str, text: Column, most: int, first: DataFrame) -> DataFrame:
    """(key, span, letters, words): runs of up to ``most`` words of a text that nothing but single blanks or hyphens part, if
    they begin with a word of ``first``.

    Each word comes as a row with the words behind it, and only rows that can begin a phrase become runs.
    """
    each = texts.select(key, F.posexplode(spans(text)).alias("span", "part"))
    chains = each.select(key, "span", F.explode(F.split(F.lower("part"), _BREAK)).alias("chain")).select(key, "span", F.array_remove(F.split("chain", r"[\s-]"), "").alias("words"))
    behind = F.arrays_zip(*(F.slice("words", k + 1, F.greatest(F.size("words"), F.lit(1))).alias(str(k)) for k in range(most)))
    rows = chains.select(key, "span", F.inline(behind).alias(*(f"w{k}" for k in range(most)))).join(first, F.col("w0") == F.col("first"), "left_semi")
    words = F.filter(F.array(*(f"w{k}" for k in range(most))), lambda w: w.isNotNull())
    found = rows.select(key, "span", words.alias("words")).select(key, "span", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("n")).select(key, "span", F.slice("words", F.lit(1), F.col("n")).alias("words"))
    return found.select(key, "span", F.array_join("words", "").alias("letters"), F.col("words"))


def _named(texts: DataFrame, key: str, text: Column, phrases: DataFrame, most: int) -> DataFrame:
    """hits(), which may repeat."""
    index = indexed(phrases).withColumnRenamed("cuts", "own")
    rows = runs(texts, key, text, most, beginnings(index.withColumnRenamed("own", "cuts"))).join(index, "letters").where(F.size(F.array_except(_cuts(F.col("words")), "own")) == 0)
    return rows.select(key, "span", "item", "phrase")


def hits(texts: DataFrame, key: str, text: Column, phrases: DataFrame, most: int = 4) -> DataFrame:
    """(key, span, item, phrase): every phrase in every span that has it as whole words, in any case, with or without a plural s.

    Phrases of more than ``most`` words are never found. One equi-join on letters; that the words are cut where the
    phrase's are, or not at all, is tested behind it. Spark sends the dictionary to all tasks if it is small, or else
    shuffles both sides.
    """
    return _named(texts, key, text, phrases, most).distinct()


def items_in(texts: DataFrame, key: str, text: Column, phrases: DataFrame) -> DataFrame:
    """(key, item): the items of which a text has any phrase."""
    return _named(texts, key, text, phrases, 4).select(key, "item").distinct()


def evidence_of_items(texts: DataFrame, key: str, text: Column, phrases: DataFrame, context: tuple[str, ...], shortest: int = 5) -> DataFrame:
    """(key, item, evidence): `phrase` if a span has a phrase of several words; `word` if one has a single long word beside a word of the context."""
    found = hits(texts, key, text, phrases)
    several = F.size(_words("phrase")) > 1
    long = ~several & (F.length("phrase") >= shortest) & ~F.col("phrase").rlike("[0-9]")
    around = texts.select(key, F.posexplode(spans(text)).alias("span", "part")).where(F.arrays_overlap(F.regexp_extract_all(F.lower("part"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array(*map(F.lit, context)))).select(key, "span", F.lit(True).alias("near"))
    rows = found.join(around, [key, "span"], "left").withColumn("kind", F.when(several, 2).when(long & F.col("near"), 1).otherwise(0))
    return rows.groupBy(key, "item").agg(F.max("kind").alias("kind")).where("kind > 0").select(key, "item", F.when(F.col("kind") == 2, "phrase").otherwise("word").alias("evidence"))


def works_in(texts: DataFrame, key: str, text: Column, uses: DataFrame) -> DataFrame:
    """(key, item): kinds of work that a text names in a span: all core words of one, or two of its other words.

    ``uses`` has item, phrase (a word) and core (whether the word is one of its name's).
    """
    need = uses.where("core").groupBy("item").agg(F.count_distinct("phrase").alias("need"))
    found = hits(texts, key, text, uses.select(F.struct("item", "core").alias("item"), "phrase"), 1)
    each = found.select(key, "span", "item.item", "item.core", "phrase").groupBy(key, "span", "item").agg(F.count_if("core").alias("core"), F.count_if(~F.col("core")).alias("others"))
    return each.join(need, "item", "left").where((F.col("core") == F.col("need")) | (F.col("others") >= 2)).select(key, "item").distinct()
