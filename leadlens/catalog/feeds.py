"""Answers of sources as columns: notices, articles, feed items, kept searches, seeds, placeholders and robots rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.registry import Tables, query
from leadlens.sources import readers


@query("""SELECT 'N' || o_orderkey AS id, c_name AS buyer, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'W' || o_orderkey ELSE 'W' || o_orderkey || '|V' || o_orderkey END AS winners, floor(o_totalprice) AS value, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS deadline
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 <> 0""")
def ted_source(t: Tables) -> DataFrame:
    """Notices from answers in JSON, one answer an order; every seventh answer is an error page and gives none."""
    k = F.col("o_orderkey").cast("string")
    winners = F.when(F.col("o_orderkey") % 3 == 0, F.array().cast("array<string>")).when(F.col("o_orderkey") % 3 == 1, F.array(F.concat(F.lit("W"), k))).otherwise(F.array(F.concat(F.lit("W"), k), F.concat(F.lit("V"), k)))
    deadline = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    notice = F.struct(F.concat(F.lit("N"), k).alias("publication-number"), F.col("c_name").alias("buyer-name"), winners.alias("winner-name"), F.floor("o_totalprice").cast("double").alias("value"), deadline.alias("deadline"))
    body = F.when(F.col("o_orderkey") % 7 == 0, "<html>busy</html>").otherwise(F.to_json(F.struct(F.array(notice).alias("notices"))))
    rows = readers.parsed_notices(t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(body.alias("body")), "body")
    return rows.select("id", "buyer", F.array_join("winners", "|").alias("winners"), "value", F.col("deadline").cast("string").alias("deadline"))


@query("""SELECT 'https://n.example.org/' || event_id AS url, date_trunc('second', ts) AS published, event_type AS title FROM events WHERE event_id % 10 <> 0""")
def gdelt_source(t: Tables) -> DataFrame:
    """Articles from answers in JSON; answers that only say that calls are limited give none."""
    url = F.concat(F.lit("https://n.example.org/"), F.col("event_id").cast("string"))
    seen = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    body = F.when(F.col("event_id") % 10 == 0, "Please limit requests to one every 5 seconds").otherwise(F.to_json(F.struct(F.array(F.struct(url.alias("url"), F.col("event_type").alias("title"), seen.alias("seendate"))).alias("articles"))))
    rows = readers.parsed_articles(t.events.select(body.alias("body")), "body")
    return rows.select("url", F.col("published").cast("timestamp_ntz").alias("published"), "title")


@query("""WITH i AS (SELECT p_partkey, 'Award of ' || lower(p_name) AS title, CASE p_partkey % 2 WHEN 0 THEN 'https://p.example.org/' || p_partkey ELSE 'https://d.example.org/x?id=' || p_partkey END AS url FROM part)
SELECT p_partkey, title, url FROM (SELECT *, row_number() OVER (PARTITION BY list_sort(list_distinct(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 4))) ORDER BY url) AS r FROM i) WHERE r <= 2""")
def bing_news_source(t: Tables) -> DataFrame:
    """Feed items in XML with links that count clicks, and at most two copies of one story."""
    k = F.col("p_partkey").cast("string")
    url = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://p.example.org/"), k)).otherwise(F.concat(F.lit("https://d.example.org/x?id="), k))
    link = F.when(F.col("p_partkey") % 2 == 0, url).otherwise(F.concat(F.lit("http://news.example.com/click?a=1&amp;url="), F.url_encode(url)))
    body = F.concat(F.lit("<item><title>Award of "), F.lower("p_name"), F.lit("</title><link>"), link, F.lit("</link></item>"))
    items = readers.parsed_items(t.part.select("p_partkey", body.alias("body")), "body")
    return readers.story_cap(items.select("p_partkey", "title", "url")).select("p_partkey", "title", "url")


@query("""SELECT page_id, 'Page ' || page_id AS title, 'https://feed.example.org/' || page_id AS url FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0""")
def rss_source(t: Tables) -> DataFrame:
    """Feed items whose title or description has a word that is looked for; only those would be fetched."""
    k = F.col("page_id").cast("string")
    words = F.when(F.col("page_id") % 3 == 0, "A pipeline contract").when(F.col("page_id") % 5 == 0, "Valves ordered").otherwise("Cooking at home")
    body = F.concat(F.lit("<item><title>Page "), k, F.lit("</title><link>https://feed.example.org/"), k, F.lit("</link><description>"), words, F.lit("</description></item>"))
    items = readers.parsed_items(t.pages.select("page_id", body.alias("body")), "body")
    return items.where(F.concat_ws(" ", "title", "description").rlike(r"(?i)\b(?:pipelines?|valves?|contracts?)\b")).select("page_id", "title", "url")


@query("""SELECT user_id, event_type, min(event_id) AS event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events k WHERE k.user_id = e.user_id AND k.event_type = e.event_type AND k.event_id % 4 = 0) GROUP BY 1, 2""")
def tavily_source(t: Tables) -> DataFrame:
    """Searches to pay for: those whose request has no kept answer, each once."""
    rows = t.events.withColumn("key", readers.request_key(F.col("user_id"), F.col("event_type")))
    asked = rows.groupBy("key", "user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return readers.to_ask(asked, rows.where("event_id % 4 = 0"), "key").select("user_id", "event_type", "event_id")


SEEDS = [("India", "acme.in", "pipe"), ("Norway", "nordic.no", "valve"), ("India", "zeta.in", "valve")]


@query("""WITH seeds(country, domain, item) AS (VALUES ('India', 'acme.in', 'pipe'), ('Norway', 'nordic.no', 'valve'), ('India', 'zeta.in', 'valve')),
r AS (SELECT s_name AS name, upper(n_name) AS country, 's' || s_suppkey || '.example.org' AS domain FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT name, country, domain, 'registry' AS origin FROM r UNION ALL SELECT domain, upper(country), domain, 'seed' FROM seeds""")
def registry_source(t: Tables) -> DataFrame:
    """Companies of public registers and those that are known from the start."""
    register = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("name"), F.upper("n_name").alias("country"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit(".example.org")).alias("domain"), F.lit("registry").alias("origin"))
    seeds = t.spark.createDataFrame(SEEDS, "country string, domain string, item string")
    return register.unionByName(seeds.select(F.col("domain").alias("name"), F.upper("country").alias("country"), "domain", F.lit("seed").alias("origin")))


@query("""WITH items(type, item, share) AS (VALUES ('PROMO', 'pipe', 3), ('ECONOMY', 'valve', 2), ('STANDARD', 'plate', 1)) SELECT p_partkey, item, share FROM part LEFT JOIN items ON type = p_type""".replace("share FROM", "CAST(share AS DOUBLE) AS share FROM"))
def seed_json_scan(t: Tables) -> DataFrame:
    """Parts with what the catalogue of a few rows, read from JSON text, says about their type."""
    seed = '[{"type": "PROMO", "item": "pipe", "share": 3}, {"type": "ECONOMY", "item": "valve", "share": 2}, {"type": "STANDARD", "item": "plate", "share": 1}]'
    rows = t.spark.createDataFrame([(seed,)], "body string").select(F.explode(F.from_json("body", "array<struct<type: string, item: string, share: double>>")).alias("x")).select("x.*")
    return t.part.join(F.broadcast(rows), F.col("p_type") == F.col("type"), "left").select("p_partkey", "item", "share")


@query("SELECT event_id, 'from ' || CAST(DATE '2026-01-31' + CAST(event_id % 40 AS INTEGER) AS VARCHAR) || ' to ' || CAST(DATE '2026-01-31' - CAST(event_id % 7 AS INTEGER) AS VARCHAR) AS text FROM events")
def fixture_source(t: Tables) -> DataFrame:
    """Texts with days counted from the day of the run."""
    k = lambda n: (F.col("event_id") % n).cast("string")
    text = F.concat(F.lit("from {{date:+"), k(40), F.lit("}} to {{date:-"), k(7), F.lit("}}"))
    return t.events.select("event_id", readers.fill_dates(text, dt.date(2026, 1, 31)).alias("text"))


@query("""SELECT page_id FROM pages WHERE page_id % 4 <> 1 AND page_id % 4 <> 2""")
def robots_rules(t: Tables) -> DataFrame:
    """Pages that their host's rules let be fetched: the longest path decides."""
    case, k = F.col("page_id") % 4, F.col("page_id").cast("string")
    path = F.when(case == 0, "open/").when(case == 1, "private/").when(case == 2, "private/x/").otherwise("private/open/")
    pages = t.pages.select("page_id", F.concat(F.lit("https://www.host.example.org/"), path, k).alias("url"))
    rules = t.spark.createDataFrame([("host.example.org", "/private", False), ("host.example.org", "/private/open", True), ("host.example.org", "/", True)], "host string, path string, allow boolean")
    return readers.allowed(pages, rules).select("page_id")
