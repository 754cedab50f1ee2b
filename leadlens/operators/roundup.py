"""Lists of companies as somebody has read them from an article, held against the article itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import evidence, names, rules
from leadlens.functions.binding import let


def verified_entries(articles: DataFrame, entries: DataFrame) -> DataFrame:
    """article, place, name, quote, fields (name and text of those that hold), lost (fields that don't), dropped (entries of
    the article that don't hold at all).

    ``articles`` has article, body; ``entries`` article, place, name, quote, fields: array<struct<field, text, quote>>. An
    entry holds if its quote stands in the body, as it is or by its signs, and names it, and its name can be a company's;
    of entries with one name the first stays. A field holds if its quote stands in the body, has its text, is about no
    other subject, and either names the entry or is part of the entry's quote.
    """
    rows = entries.join(articles, "article")
    found = rows.withColumn("found", evidence.original_quote(F.col("body"), F.col("quote")))
    good = F.col("found").isNotNull() & rules.junk_name(F.col("name")).isNull() & evidence.names_company(F.col("found"), F.col("name"))
    judged = found.withColumn("good", F.coalesce(good, F.lit(False)))

    def holds(f: Column) -> Column:
        def test(q: Column) -> Column:
            about = evidence.names_company(q, F.col("name")) | F.contains(F.col("found"), q)
            return q.isNotNull() & evidence.original_quote(q, f["text"]).isNotNull() & ~evidence.other_subject(q, F.col("name")) & about

        return F.coalesce(let(evidence.original_quote(F.col("body"), f["quote"]), test), F.lit(False))

    dropped = judged.groupBy("article").agg(F.count_if(~F.col("good")).alias("dropped"))
    nth = F.row_number().over(Window.partitionBy("article", names.company_key(F.col("name"))).orderBy("place"))
    first = judged.where("good").withColumn("nth", nth).where("nth = 1")
    kept = first.withColumn("kept", F.filter("fields", holds))
    fields = F.transform("kept", lambda f: F.struct(f["field"].alias("field"), f["text"].alias("text")))
    return kept.join(dropped, "article").select("article", "place", "name", F.col("found").alias("quote"), fields.alias("fields"), (F.size("fields") - F.size("kept")).alias("lost"), "dropped")
