"""Documents, pages and names: cleaning, hashing, filtering, quoting, parsing, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.functions import dates, money, names, textual, urls
from leadlens.operators.ranking import first_per, top_per
from leadlens.operators.resolve import stored_in_order
from leadlens.registry import Tables, query
from leadlens.sources import sinks

URL = r"(^[a-z]+)://(?:www\.)?([^/?#:]+)[^/?#]*([^?#]*)\??([^#]*)"


@query(rf"""WITH u AS (SELECT page_id, url, regexp_extract(url, '{URL}', 1) AS scheme, lower(regexp_extract(url, '{URL}', 2)) AS host, regexp_extract(url, '{URL}', 3) AS path,
array_to_string(list_filter(string_split(regexp_extract(url, '{URL}', 4), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_|fbclid|gclid|mc_|ref=|ref$|from=|from$)', 'i')), '&') AS q FROM pages)
SELECT page_id, scheme || '://' || host || CASE WHEN path IN ('', '/') THEN '/' WHEN q = '' THEN regexp_replace(path, '/$', '') ELSE path END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM u""")
def canonical_url(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@query(rf"""WITH u AS (SELECT page_id, string_split(lower(regexp_extract(url, '{URL}', 2)), '.') AS p FROM pages) SELECT page_id, CASE WHEN len(p) <= 2 THEN array_to_string(p, '.') WHEN p[-2] IN ('co', 'com', 'org', 'net', 'gov', 'ac', 'edu') THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS publisher FROM u""")
def publisher_key(t: Tables) -> DataFrame:
    return t.pages.select("page_id", urls.publisher(F.col("url")).alias("publisher"))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def doc_dedupe_exact(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH d AS (SELECT doc_id, source, sha256(text) AS h FROM documents), m AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, h) AS both_, min(doc_id) OVER (PARTITION BY h) AS copy, min(doc_id) OVER (PARTITION BY source) AS seen FROM d)
SELECT doc_id, CASE WHEN both_ < doc_id THEN 'known' WHEN copy < doc_id THEN 'known_copy' WHEN seen < doc_id THEN 'changed' ELSE 'new' END AS state FROM m""")
def store_document(t: Tables) -> DataFrame:
    """What each document is when it arrives after those of smaller id: known by URL and content, by content alone, changed, or new."""
    rows = t.documents.select("doc_id", F.col("source").alias("url"), F.sha2("text", 256).alias("hash"))
    return stored_in_order(rows, "doc_id").select("doc_id", "state")


@query(r"""SELECT doc_id, CASE WHEN n_chars < 200 THEN 'drop:short' WHEN regexp_matches(text, '(^|[^\p{L}\p{N}])(licensed|lorem)($|[^\p{L}\p{N}])', 'i') THEN 'drop:noise' WHEN regexp_matches(text, '(^|[^\p{L}\p{N}])(token|contract)($|[^\p{L}\p{N}])', 'i') THEN 'relevant:term' WHEN lang NOT IN ('en', 'de') THEN 'uncertain:market' ELSE 'uncertain:none' END AS verdict FROM documents""")
def doc_filter(t: Tables) -> DataFrame:
    text = F.col("text")
    verdict = textual.decide(
        (F.col("n_chars") < 200, "drop:short"),
        (textual.has_term(text, "licensed") | textual.has_term(text, "lorem"), "drop:noise"),
        (textual.has_term(text, "token") | textual.has_term(text, "contract"), "relevant:term"),
        (~F.col("lang").isin("en", "de"), "uncertain:market"),
        otherwise="uncertain:none",
    )
    return t.documents.select("doc_id", verdict.alias("verdict"))


@query("""SELECT item_id, doc_id, strpos(d.text, b.text) - 1 AS start FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def quote_verify_exact(t: Tables) -> DataFrame:
    """Quotes in documents by an equi-join on the quote's longest inner word, so that only documents with that word are searched.

    The first and last word of a quote may be parts of words of the document. Quotes of fewer than three words aren't evidence.
    """
    words = F.split("text", "[ \n]")
    longest = F.array_max(F.transform(F.slice(words, 2, F.size(words) - 2), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    quotes = t.benchmark.where(F.size(words) >= 3).select("item_id", F.col("text").alias("quote"), longest.alias("key"))
    keyed = t.documents.select("doc_id", F.explode(F.array_distinct(words)).alias("key"))
    pairs = keyed.join(quotes, "key").select("doc_id", "item_id", "quote").distinct()
    found = pairs.join(t.documents.select("doc_id", "text"), "doc_id").where(F.contains("text", "quote"))
    return found.select("item_id", "doc_id", (F.expr("instr(text, quote)") - 1).cast("long").alias("start")).distinct()


@query("SELECT doc_id, CAST(unnest(range(0, greatest(length(text), 1), 1500)) AS INT) AS start FROM documents")
def relevance_chunks(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.explode(F.transform(textual.chunks(F.col("text"), 2000), lambda x: x["start"])).alias("start"))


STORY_KEY = "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) >= 4))), ' ')"


@query(f"SELECT doc_id, place, copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY k) AS copies FROM (SELECT doc_id, md5({STORY_KEY}) AS k FROM documents)) WHERE place > 1 AND place <= 3")
def story_repeats(t: Tables) -> DataFrame:
    """Repeats of a story, told by its distinct longer words whatever their order: the second and the third, with how many there are."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: F.length(w) >= 4)))
    rows = t.documents.select("doc_id", F.md5(F.array_join(words, " ").cast("binary")).alias("k"))
    counts = rows.groupBy("k").agg(F.count("*").alias("copies")).where("copies > 1")
    ranked = top_per(rows, ["k"], 3, F.col("doc_id"), rank="place").where("place > 1")
    return ranked.join(counts, "k").select("doc_id", "place", "copies")


MONEY_TEXT = "CASE o_orderkey % 4 WHEN 0 THEN 'worth USD ' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' million' WHEN 1 THEN 'Rs ' || CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) || ' crore on 2001-03-04' WHEN 2 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) || ' NOK due 4 March 2001' ELSE 'nothing stated' END"


@query("""WITH m AS (SELECT o_orderkey, floor(o_totalprice) AS v, floor(o_totalprice / 1000) AS k, o_orderkey % 4 AS c FROM orders)
SELECT o_orderkey, CASE c WHEN 0 THEN 'USD' WHEN 1 THEN 'INR' WHEN 2 THEN 'NOK' END AS currency, CASE c WHEN 0 THEN v * 1e6 WHEN 1 THEN k * 1e7 WHEN 2 THEN v END AS amount,
CASE c WHEN 0 THEN v * 1e6 WHEN 1 THEN round(k * 1e7 * (CAST(1 AS DOUBLE) / 83)) WHEN 2 THEN round(v * (CAST(1 AS DOUBLE) / 10.5)) END AS usd, CASE c WHEN 1 THEN '2001-03-04' WHEN 2 THEN '2001-03-04' END AS day FROM m""")
def money_dates(t: Tables) -> DataFrame:
    text = F.expr(MONEY_TEXT.replace("VARCHAR", "STRING"))
    rows = t.orders.select("o_orderkey", money.parse_money(text).alias("m"), dates.parse_date(text).alias("day"))
    return rows.select("o_orderkey", F.col("m.currency").alias("currency"), F.col("m.amount").alias("amount"), F.col("m.usd").cast("double").alias("usd"), "day")


@query("""SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i)\\d[\\d,]*(?:\\.\\d+)?'), lambda x: x <> '')) AS numbers FROM documents""".replace("\\\\", "\\"))
def numbers_in_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(money.numbers_in(F.col("text"))).cast("long").alias("numbers"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(name, '^[=+@\\-\t\r]') THEN '''' || name ELSE name END AS cell FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '=' WHEN 1 THEN '-' ELSE '' END || p_name AS name FROM part)""".replace("\\\\", "\\"))
def csv_escape(t: Tables) -> DataFrame:
    name = F.concat(F.when(F.col("p_partkey") % 3 == 0, "=").when(F.col("p_partkey") % 3 == 1, "-").otherwise(""), F.col("p_name"))
    return t.part.select("p_partkey", sinks.cell(name).alias("cell"))


@query("SELECT o_orderkey, CASE WHEN v >= 1e9 THEN '$' || regexp_replace(printf('%.1f', round(v / 1e9, 1)), '\\.0$', '') || 'bn' WHEN v >= 1e6 THEN '$' || regexp_replace(printf('%.1f', round(v / 1e6, 1)), '\\.0$', '') || 'm' WHEN v >= 1e3 THEN '$' || CAST(CAST(round(v / 1e3) AS BIGINT) AS VARCHAR) || 'k' ELSE '$' || CAST(CAST(round(v) AS BIGINT) AS VARCHAR) END AS shown FROM (SELECT o_orderkey, floor(o_totalprice) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 100 ELSE 100000 END AS v FROM orders)".replace("\\\\", "\\"))
def format_money(t: Tables) -> DataFrame:
    from leadlens.operators.scalars import compact_usd

    v = F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, 100).otherwise(100000)
    return t.orders.select("o_orderkey", compact_usd(v.cast("double")).alias("shown"))


@query(r"""WITH n AS (SELECT c_custkey, lower(c_name) || CASE c_custkey % 3 WHEN 0 THEN ' project phase' WHEN 1 THEN ' the scheme for' ELSE '' END AS name FROM customer) SELECT c_custkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(name, '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda x: x <> '' AND NOT list_contains(['the', 'project', 'projects', 'scheme', 'phase', 'of', 'for', 'and', 'a', 'an'], x)), ' ') AS key FROM n""")
def project_norm(t: Tables) -> DataFrame:
    tail = F.when(F.col("c_custkey") % 3 == 0, " project phase").when(F.col("c_custkey") % 3 == 1, " the scheme for").otherwise("")
    return t.customer.select("c_custkey", names.project_key(F.concat("c_name", tail)).alias("key"))


@query("SELECT lang, doc_id, place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY CAST(contains(lower(text), 'token') AS INT) * 10 + CAST(n_chars > 1500 AS INT) * 5 DESC, n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 10")
def ai_priority_topk(t: Tables) -> DataFrame:
    worth = F.contains(F.lower("text"), F.lit("token")).cast("int") * 10 + (F.col("n_chars") > 1500).cast("int") * 5
    return top_per(t.documents, ["lang"], 10, worth.desc(), F.desc("n_chars"), F.col("doc_id"), rank="place").select("lang", "doc_id", "place")


@query(rf"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '{URL}', 2)) AS host, length(html) AS size FROM pages) SELECT page_id, host FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY size DESC, page_id) AS r FROM u) WHERE r = 1""")
def best_page_per_domain(t: Tables) -> DataFrame:
    rows = t.pages.select("page_id", urls.host(F.col("url")).alias("host"), F.length("html").alias("size"))
    return first_per(rows, ["host"], F.desc("size"), F.col("page_id")).select("page_id", "host")


@query(rf"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '{URL}', 2)) AS host FROM pages) SELECT page_id, CASE WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') THEN 'junk' WHEN starts_with(host, 'blog.') THEN 'blog' ELSE 'site' END AS kind FROM u""")
def domain_class(t: Tables) -> DataFrame:
    """Suffixes of each host are exploded and joined to the list: no comparison of every host with every entry."""
    listed = F.broadcast(t.spark.createDataFrame([("spam-farm.example.org", "junk")], "suffix string, class string"))
    host = urls.host(F.col("url"))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = t.pages.select("page_id", F.explode(suffixes).alias("suffix")).join(listed, "suffix").groupBy("page_id").agg(F.min("class").alias("class"))
    return t.pages.select("page_id", host.alias("host")).join(hits, "page_id", "left").select("page_id", F.when(F.col("class").isNotNull(), F.col("class")).when(F.col("host").startswith("blog."), "blog").otherwise("site").alias("kind"))


@query()
def html_strip(t: Tables) -> DataFrame:
    """Title and rough text by patterns alone, where the structure of a page doesn't matter."""
    text = F.col("html")
    for pattern in (r"(?is)<(script|style)[^>]*>.*?</\1>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return t.pages.select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), textual.word_count(text).alias("words"))
