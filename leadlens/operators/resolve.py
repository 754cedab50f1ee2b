"""Entity resolution: stored documents by URL and content, companies by exact keys, then by near names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.functions import fuzzy, names
from leadlens.operators.ranking import first_per


def stored_documents(new: DataFrame, known: DataFrame) -> DataFrame:
    """new (url, hash, others) with ``state``: known, known_copy (the content under another URL), changed (another content) or new."""
    both = known.select("url", "hash").distinct().withColumn("same", F.lit(True))
    by_hash = known.select("hash").distinct().withColumn("copy", F.lit(True))
    by_url = known.select("url").distinct().withColumn("seen", F.lit(True))
    rows = new.join(both, ["url", "hash"], "left").join(by_hash, "hash", "left").join(by_url, "url", "left")
    state = F.when(F.col("same"), "known").when(F.col("copy"), "known_copy").when(F.col("seen"), "changed").otherwise("new")
    return rows.withColumn("state", state).drop("same", "copy", "seen")


def stored_in_order(rows: DataFrame, order: str) -> DataFrame:
    """rows (url, hash, ``order``, others) with ``state`` as stored_documents() gives it against all rows of a smaller ``order``.

    The least of each content, URL and both is found by aggregates; the few URLs of a hot source come back by a join.
    """
    out = rows
    for name, keys in (("_both", ["url", "hash"]), ("_copy", ["hash"]), ("_seen", ["url"])):
        out = out.join(rows.groupBy(*keys).agg(F.min(order).alias(name)), keys, "left")
    now = F.col(order)
    state = F.when(F.col("_both") < now, "known").when(F.col("_copy") < now, "known_copy").when(F.col("_seen") < now, "changed").otherwise("new")
    return out.withColumn("state", state).drop("_both", "_copy", "_seen")


#: How sure a match is by the way it was found, and the least ratio of near names: fixed values.
EXACT, NEAR, ALONE, LEAST_RATIO = 0.90, 0.85, 0.60, 92


def resolve_companies(mentions: DataFrame, companies: DataFrame) -> DataFrame:
    """mentions (mention_id, name, country) with company_id and certainty; unmatched ones have no company and ALONE.

    1. A shared key (name, alias, name without words for a part, well-known group) in the same country is EXACT.
    2. A shared key where a country isn't known, or where either name has an alias written to it, is NEAR; EXACT for
       well-known groups.
    3. In one country, a name whose words are nearly those of another is NEAR. Names are compared where the rarest word of
       one is a word of the other, so that a word of many names doesn't pair them all.

    The best step wins, then the better ratio, then the smaller id.
    """
    keys = lambda df, i: df.select(i, "country", (F.size(names.name_parts(F.col("name"))["aliases"]) > 0).alias("aliased"), F.explode(names.company_keys(F.col("name"))).alias("key"))
    theirs = keys(companies, "company_id").withColumnsRenamed({"country": "their_country", "aliased": "their_alias"})
    pairs = keys(mentions, "mention_id").join(theirs, "key")
    same = F.coalesce(F.col("country") == F.col("their_country"), F.lit(False))
    known = F.col("key").startswith("known:")
    loose = F.col("country").isNull() | F.col("their_country").isNull() | F.col("aliased") | F.col("their_alias") | known
    by_key = pairs.where(same | loose).select("mention_id", "company_id", F.when(same | known, EXACT).otherwise(NEAR).alias("certainty"), F.when(same, 1).otherwise(2).alias("step"), F.lit(100).alias("score"))

    words = lambda df, i, c: df.select(i, "country", names.company_key(F.col("name")).alias(c)).where("country is not null").withColumn("words", fuzzy.tokens(F.col(c)))
    mine, pool = words(mentions, "mention_id", "a"), words(companies, "company_id", "b")
    counts = pool.select("country", F.explode("words").alias("word")).groupBy("country", "word").agg(F.count("*").alias("names"))
    every = lambda df, i: df.select(i, "country", F.explode("words").alias("word"))
    rarest = lambda df, i: every(df, i).join(counts, ["country", "word"], "left").groupBy(i, "country").agg(F.min_by("word", F.struct(F.coalesce("names", F.lit(0)).alias("n"), F.col("word").alias("w"))).alias("word"))
    met = rarest(mine, "mention_id").join(every(pool, "company_id"), ["country", "word"]).select("mention_id", "company_id").union(every(mine, "mention_id").join(rarest(pool, "company_id"), ["country", "word"]).select("mention_id", "company_id")).distinct()
    compared = met.join(mine.select("mention_id", "a"), "mention_id").join(pool.select("company_id", "b"), "company_id")
    scored = compared.withColumn("score", fuzzy.token_set_ratio(F.col("a"), F.col("b"))).where(F.col("score") >= LEAST_RATIO)
    near = scored.select("mention_id", "company_id", F.lit(NEAR).alias("certainty"), F.lit(3).alias("step"), "score")
    best = first_per(by_key.unionByName(near), ["mention_id"], F.col("step"), F.desc("score"), F.col("company_id")).drop("step", "score")
    return mentions.join(best, "mention_id", "left").withColumn("certainty", F.coalesce("certainty", F.lit(ALONE)))
