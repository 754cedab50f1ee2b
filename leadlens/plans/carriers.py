"""The lead relations as the public star schema carries them: an order is a project's lead, its customer the buyer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlens.registry import Tables

AS_OF = dt.datetime(2001, 8, 2)


def leads(t: Tables) -> DataFrame:
    """lead_id, buyer, segment, place, region, status, priority, score (0 to 100), value and created of every order.

    Nations and regions are fixed tables of a few rows.
    """
    places = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("lead_id"),
        F.col("c_custkey").alias("buyer_id"),
        F.col("c_name").alias("buyer"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("place"),
        F.col("r_name").alias("region"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.least(F.lit(100), F.floor(F.col("o_totalprice") / 5000)).cast("long").alias("score"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").alias("created"),
    )


#: The same relation in SQL.
LEADS_SQL = """leads AS (
  SELECT o_orderkey AS lead_id, c_custkey AS buyer_id, c_name AS buyer, c_mktsegment AS segment, n_name AS place, r_name AS region, o_orderstatus AS status,
         o_orderpriority AS priority, CAST(least(100, floor(o_totalprice / 5000)) AS BIGINT) AS score, o_totalprice AS value, o_orderdate AS created
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""


#: Names as a press text has them: a key in letters, with what firms are called.
BUYER_SQL = "'K' || translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') || CASE c_custkey % 4 WHEN 0 THEN ' Holdings' WHEN 1 THEN ' Industries' WHEN 2 THEN '' ELSE ' Energy' END"
SELLER_SQL = "'Q' || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'abcdefghij') || CASE s_suppkey % 3 WHEN 0 THEN ' Works' WHEN 1 THEN ' Pipes' ELSE '' END"

#: A story for each order that has a line: who awarded what to whom, for how much, when, under which number, until when.
STORIES_SQL = f"""stories AS (
  SELECT o_orderkey AS story_id, buyer, seller, CAST(floor(o_totalprice / 1000) + 1 AS BIGINT) AS millions, CAST(o_orderdate AS DATE) AS signed, CAST(o_orderdate AS DATE) + 30 AS closing,
    buyer || ' has awarded ' || seller || ' a steel pipe supply contract worth USD ' || CAST(CAST(floor(o_totalprice / 1000) + 1 AS BIGINT) AS VARCHAR) || ' million.' AS first,
    'RF-' || CAST(o_orderkey AS VARCHAR) || '-' || CAST(CAST(o_custkey AS BIGINT) AS VARCHAR) AS ref
  FROM orders JOIN (SELECT c_custkey, {BUYER_SQL} AS buyer FROM customer) ON c_custkey = o_custkey
  JOIN (SELECT l_orderkey, min(l_suppkey) AS suppkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN (SELECT s_suppkey, {SELLER_SQL} AS seller FROM supplier) ON s_suppkey = suppkey)"""


def stories(t: Tables) -> DataFrame:
    """story_id, buyer, seller, millions, signed, closing, first (its first sentence), ref and text of every order that has a line."""
    expr = lambda sql: F.expr(sql.replace("VARCHAR", "STRING"))
    sold = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    buyers, sellers = t.customer.select("c_custkey", expr(BUYER_SQL).alias("buyer")), t.supplier.select("s_suppkey", expr(SELLER_SQL).alias("seller"))
    rows = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(sold, F.col("o_orderkey") == F.col("l_orderkey")).join(sellers, "s_suppkey")
    day = F.to_date("o_orderdate")
    millions = (F.floor(F.col("o_totalprice") / 1000) + 1).cast("long")
    first = F.concat("buyer", F.lit(" has awarded "), "seller", F.lit(" a steel pipe supply contract worth USD "), millions.cast("string"), F.lit(" million."))
    ref = F.concat(F.lit("RF-"), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))
    out = rows.select(F.col("o_orderkey").alias("story_id"), "buyer", "seller", millions.alias("millions"), day.alias("signed"), F.date_add(day, 30).alias("closing"), first.alias("first"), ref.alias("ref"))
    signed = F.concat(F.lit("Mr. Khan signed the order on "), F.date_format("signed", "d MMMM yyyy"), F.lit("."))
    due = F.concat(F.lit("Bids for the rest are due by "), F.col("closing").cast("string"), F.lit("."))
    return out.withColumn("text", F.concat("first", F.lit(" "), signed, F.lit("\nTender No: "), "ref", F.lit(". "), due))
