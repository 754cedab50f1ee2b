"""Sources as Spark reads them: notices and article lists as JSON, feeds as XML, seeds, robots rules. Nothing is fetched."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.functions import urls
from leadlens.operators.ranking import top_per

NOTICE = "notices array<struct<`publication-number`: string, `buyer-name`: string, `winner-name`: array<string>, title: string, value: double, currency: string, deadline: string, link: string>>"
ARTICLES = "articles array<struct<url: string, title: string, seendate: string, domain: string, language: string>>"
ITEM = "title string, link string, description string, pubDate string"


def parsed_notices(answers: DataFrame, column: str) -> DataFrame:
    """One row for each notice of the tender-search answers in a column, with the winners as an array; what isn't JSON gives none."""
    rows = answers.select(F.explode(F.from_json(F.col(column), NOTICE)["notices"]).alias("n"))
    return rows.select(F.col("n.`publication-number`").alias("id"), F.col("n.`buyer-name`").alias("buyer"), F.col("n.`winner-name`").alias("winners"), "n.title", "n.value", "n.currency", F.try_to_date("n.deadline").alias("deadline"), F.col("n.link").alias("url"))


def notices(spark: SparkSession, path: str) -> DataFrame:
    """The notices of files of tender-search answers."""
    return parsed_notices(spark.read.text(path, wholetext=True), "value")


def parsed_articles(answers: DataFrame, column: str) -> DataFrame:
    """News answers in a column; one that is plain text, as when calls are limited, gives no rows."""
    rows = answers.select(F.explode(F.from_json(F.col(column), ARTICLES)["articles"]).alias("a"))
    return rows.select("a.url", "a.title", F.expr("try_to_timestamp(a.seendate, \"yyyyMMdd'T'HHmmss'Z'\")").alias("published"), "a.domain", "a.language")


def articles(spark: SparkSession, path: str) -> DataFrame:
    """The articles of files of news answers."""
    return parsed_articles(spark.read.text(path, wholetext=True), "value")


def _target(link: Column) -> Column:
    """What a link that counts clicks leads to; other links are their own."""
    return F.coalesce(F.url_decode(F.try_parse_url(link, F.lit("QUERY"), F.lit("url"))), link)


def parsed_items(rows: DataFrame, column: str) -> DataFrame:
    """title, url, description and published of the RSS item in each row of a column; other columns stay."""
    item = F.from_xml(F.col(column), ITEM)
    return rows.withColumn("_item", item).select(*rows.columns, "_item.title", _target(F.col("_item.link")).alias("url"), "_item.description", F.col("_item.pubDate").alias("published"))


def feed(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """RSS items (or Atom entries, by their tag); links that count clicks are replaced by what they lead to."""
    rows = spark.read.format("xml").schema(ITEM).option("rowTag", tag).load(path)
    return rows.select("title", _target(F.col("link")).alias("url"), "description", F.col("pubDate").alias("published"))


def request_key(*parts: Column) -> Column:
    """The key under which a search's answer is kept: a hash of the request, the same for the same request."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def to_ask(requests: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Requests whose answer isn't kept yet, one for each key."""
    return requests.join(kept.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def story_cap(rows: DataFrame, most: int = 2) -> DataFrame:
    """At most ``most`` copies of one story, told by the distinct long words of its title; the first URLs stay."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 4)))
    return top_per(rows.withColumn("story", F.array_join(words, " ")), ["story"], most, F.col("url")).drop("rank", "story")


def fill_dates(c: Column, today: dt.date) -> Column:
    """Replace {{date:+N}} and {{date:-N}} by the day N days from ``today``."""
    parts = F.split(c, r"\{\{date:")

    def one(p: Column) -> Column:
        n = F.regexp_extract(p, r"^([+-]?\d+)\}\}", 1)
        return F.when(n != "", F.concat(F.date_format(F.date_add(F.lit(today), n.try_cast("int")), "yyyy-MM-dd"), F.regexp_replace(p, r"^[+-]?\d+\}\}", ""))).otherwise(F.concat(F.lit("{{date:"), p))

    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), one), ""))


def allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (url) that no rule (host, path, allow) forbids: the longest path that opens the page's path decides, allowing on a tie.

    Addresses are judged once each; rows that repeat one all stay or all go.
    """
    urls_ = pages.select("url").distinct().select("url", urls.host(F.col("url")).alias("_host"), F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("/")).alias("_path"))
    hit = (F.col("_host") == F.col("host")) & F.col("_path").startswith(F.col("path"))
    judged = urls_.join(rules, hit).groupBy("url").agg(F.max_by("allow", F.struct(F.length("path").alias("a"), F.col("allow").alias("b"))).alias("_allow"))
    return pages.join(judged.where("not _allow").select("url"), "url", "left_anti")
