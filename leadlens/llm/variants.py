"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' values, which are the fifth powers of their code points, so that the order of
letters doesn't count. Words that differ by one letter more, less or another have keys that differ by that letter's
value, or by the difference of two values: each word is listed under its key less each of its letters and, for letters
added, under its whole key, and an equi-join finds the pairs. The half of the word that a single edit leaves alone is
part of the join key, so that long lists of anagrams don't meet; the edit distance is verified for what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlens.llm.common import saved

LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Of (document, word) pairs one in so many loses a letter: spelling errors to be found again.
DAMAGE = 199
#: Letters and occurrences that a word needs; how many times as frequent a word's form is.
LEAST_LETTERS, LEAST_COUNT, TIMES = 6, 5, 5
POWER = 5
#: Keys are kept below this prime, so that words of any length have one.
MODULUS = (1 << 61) - 1


def runs(docs: DataFrame) -> DataFrame:
    """A row for each run of letters: doc_id, run (A-Z lower-cased)."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))


def damaged(doc_id: Column, run: Column) -> Column:
    """The run, without one letter if the checksum of id and run says so; a null id counts as empty."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    words = runs(docs).select(damaged(F.col("doc_id"), F.col("run")).alias("word")).where(F.length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _value(letter: str) -> str:
    return "*".join([f"cast(ascii({letter}) as bigint)"] * POWER)


def listed(words: DataFrame) -> DataFrame:
    """(key, side, half, letter, other, word, n): words under the keys that a near word has as well.

    ``letter`` is the one taken off, or empty for the whole word. ``half`` is the first or the last part of the word, as
    ``side`` says, and ``other`` the other part: a near word's edit leaves one of the two alone.
    """
    letters = F.expr("split(word, '')").alias("letters")
    key = F.expr(f"aggregate(letters, 0L, (s, c) -> (s + {_value('c')}) % {MODULUS}L)")
    keyed = words.select("word", "n", letters).withColumn("key", key)
    each = keyed.select("word", "n", "key", F.explode(F.expr("array_append(array_distinct(letters), '')")).alias("letter"))
    key = F.expr(f"if(letter = '', key, pmod(key - {_value('letter')}, {MODULUS}L))")
    length = F.length("word") - F.when(F.col("letter") == "", 0).otherwise(1)
    cut = F.floor(length / 2).cast("int")
    first, last = F.col("word").substr(F.lit(1), cut), F.expr("right(word, rest)")
    each = each.select("word", "n", "letter", key.alias("key"), first.alias("first"), (length - cut).alias("rest")).withColumn("last", last)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("half"), F.col("last").alias("other")), F.struct(F.lit(1).alias("side"), F.col("last").alias("half"), F.col("first").alias("other")))
    return each.select("word", "n", "letter", "key", F.explode(sides).alias("s")).select("key", "s.*", "letter", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one letter, in both directions."""
    lists = listed(words)
    a, b = lists.alias("a"), lists.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("key", "side", "half")]
    # Exchanged letters differ; a letter more is seen from the longer word only. A pair that agrees in both parts is found on the first side.
    which = (F.col("a.letter") > F.col("b.letter")) & ((F.col("a.side") == 0) | (F.col("a.other") != F.col("b.other")))
    pairs = a.join(b, [*same, which, F.levenshtein("a.word", "b.word", 1) == 1]).select(F.col("a.word").alias("u"), F.col("a.n").alias("un"), F.col("b.word").alias("v"), F.col("b.n").alias("vn"))
    ways = F.array(F.struct(F.col("u").alias("word"), F.col("un").alias("n"), F.col("v").alias("near"), F.col("vn").alias("near_n")), F.struct(F.col("v").alias("word"), F.col("vn").alias("n"), F.col("u").alias("near"), F.col("un").alias("near_n")))
    return pairs.select(F.explode(ways).alias("x")).select("x.*")


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the end of each chain of forms, by doubling the step until no chain goes on."""
    roots = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = saved(roots.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")))
        roots = step.select("word", "root")
        if step.where("went").isEmpty():
            return roots


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Words of whole texts with the more frequent form that they are a variant of: word, form, root, n, n_near, form_n.

    Takes doc_id and text; other columns may have any name. Null texts have no words; a null id counts as empty in the
    damage's checksum; rows that repeat count again. Texts and words of any length count whole. Of near words with
    equal counts the least in code-point order is the form. An empty table gives no rows.
    """
    words = saved(counted(docs))
    rank = F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(rank).alias("best"))
    found = saved(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best")).alias("best")))
    roots = rooted(found.where("best is not null").select("word", F.col("best.word").alias("form")))
    return found.join(roots, "word", "left").select("word", F.col("best.word").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.n")).alias("form_n"))
