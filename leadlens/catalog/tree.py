"""The supply tree of every company: the supplier of an order's first line buys what the order's other lines deliver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadlens.operators.ranking import top_per
from leadlens.operators.steps import stored
from leadlens.operators.supply import supply_tree
from leadlens.registry import Tables, query

#: From which types of company one of a type buys; the last buys from none.
BUYS = {"LARGE": ["PROMO", "STANDARD", "MEDIUM"], "PROMO": ["STANDARD", "SMALL"], "STANDARD": ["MEDIUM", "ECONOMY", "SMALL"], "MEDIUM": ["ECONOMY", "LARGE"], "ECONOMY": ["SMALL"], "SMALL": []}
#: Types that a company is known for; days that a relation is remembered (all are older than a deal's own); lines that a user has put in or taken out.
OWN_TYPES, BIG = 2, 48
QUOTA, DEPTH = 3, 3
#: What a line says of its relation; of one day and project the higher one holds.
SET, REMOVED = 1, 2

_EDGES = ", ".join(f"('{k}', {i}, '{v}')" for k, vs in BUYS.items() for i, v in enumerate(vs))
_TYPES = ", ".join(f"('{k}')" for k in BUYS)


def _level(tier: int, above: str) -> str:
    """SQL of one level below another: all relations of a node ranked, then directory picks one type after the other."""
    t, p = tier, above
    picks = ""
    for i in range(max(map(len, BUYS.values()))):
        used = "".join(f" AND coalesce(k.c{j}, -1) <> x.supplier" for j in range(i))
        before = ", ".join(["root", "up", "path", "buyer", *(f"c{j}" for j in range(i))])
        source = f"p{t}_{i - 1}" if i else f"(SELECT root, node AS up, path, company AS buyer FROM a{t})"
        picks += f""", p{t}_{i} AS (SELECT {", ".join("k." + c for c in before.split(", "))}, (SELECT arg_min(x.supplier, x.nth) FROM d x WHERE x.buyer = k.buyer AND x.type = l.type AND NOT list_contains(k.path, x.supplier){used}) AS c{i}, l.type AS t{i}{"".join(f", k.t{j}" for j in range(i))}
FROM {source} k LEFT JOIN l{t} l ON l.root = k.root AND l.up = k.up AND l.pos = {i})"""
    last = max(map(len, BUYS.values())) - 1
    rest = " UNION ALL ".join(f"SELECT root, up, t{i} AS type, c{i} AS company, CASE WHEN c{i} IS NULL THEN 'not_identified' ELSE 'possible' END AS link, 1 AS nth FROM p{t}_{last} WHERE t{i} IS NOT NULL" for i in range(last + 1))
    return f"""
), a{t} AS (SELECT * FROM {p} WHERE company IS NOT NULL {"" if t == 2 else "AND type IN (SELECT kind FROM edges)"}
), f{t} AS (SELECT a.root, a.node AS up, x.type, x.supplier, min(CASE WHEN x.put OR list_contains(x.projects, a.project) THEN 0 ELSE 1 END) AS rank, max(x.latest) AS latest
  FROM a{t} a JOIN related x ON x.buyer = a.company AND x.node_type = a.type WHERE NOT list_contains(a.path, x.supplier) GROUP BY 1, 2, 3, 4
), m{t} AS (SELECT root, up, type, supplier AS company, CASE rank WHEN 0 THEN 'confirmed' ELSE 'likely' END AS link, nth FROM (SELECT *, row_number() OVER (PARTITION BY root, up, type ORDER BY rank, latest DESC NULLS LAST, supplier) AS nth FROM f{t}) WHERE nth <= {QUOTA}
), l{t} AS (SELECT a.root, a.node AS up, e.pos, e.type FROM a{t} a JOIN edges e ON e.kind = a.type WHERE NOT EXISTS (SELECT 1 FROM f{t} f WHERE f.root = a.root AND f.up = a.node AND f.type = e.type)
){picks}, s{t} AS (SELECT * FROM m{t} UNION ALL {rest}
), n{t} AS (SELECT s.root, 't{t}:' || CASE WHEN up = 't1' THEN '' ELSE substring(up, strpos(up, ':') + 1) || ':' END || s.type || CASE WHEN nth > 1 THEN ':' || nth ELSE '' END AS node, up AS parent, {t} AS tier, s.type, s.company, s.link, a.project, CASE WHEN s.company IS NULL THEN a.path ELSE list_append(a.path, s.company) END AS path
  FROM s{t} s JOIN a{t} a ON a.root = s.root AND a.node = s.up"""


TREE_SQL = f"""
WITH edges(kind, pos, type) AS (VALUES {_EDGES}), kinds(kind) AS (VALUES {_TYPES}
), own AS (SELECT company, list(p_type ORDER BY nth) AS types FROM (SELECT l_suppkey AS company, p_type, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_type) AS nth FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2) WHERE nth <= {OWN_TYPES} GROUP BY 1
), companies AS (SELECT s_suppkey AS company, coalesce(types, []) AS types, s_nationkey AS place, n_regionkey AS region FROM supplier LEFT JOIN own ON company = s_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey
), prime AS (SELECT l_orderkey AS project, arg_min(l_suppkey, l_linenumber * 1000000 + l_suppkey) AS buyer FROM lineitem GROUP BY 1
), lines AS (SELECT buyer, l_suppkey AS supplier, l_orderkey AS project, CAST(l_shipdate AS DATE) AS day, p_type, l_returnflag, l_quantity FROM lineitem JOIN prime ON project = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_suppkey <> buyer
), acts AS (SELECT buyer, p_type AS type, supplier, arg_max(CASE l_returnflag WHEN 'R' THEN 'removed' ELSE 'set' END, strftime(day, '%Y-%m-%d') || lpad(CAST(project AS VARCHAR), 12, '0') || l_returnflag) AS action FROM lines WHERE l_returnflag IN ('R', 'A') AND l_quantity >= {BIG} GROUP BY 1, 2, 3
), sets AS (SELECT buyer, type, supplier FROM acts WHERE action = 'set'), removed AS (SELECT buyer, type, supplier FROM acts WHERE action = 'removed'
), pairs AS (SELECT buyer, supplier, max(day) AS latest, list(DISTINCT project) AS projects FROM lines GROUP BY 1, 2
), free AS (
  SELECT p.buyer, k.kind AS node_type, p.supplier, p.latest, p.projects, coalesce(list_filter(c.types, lambda t: list_contains(w.wanted, t))[1], c.types[1], w.wanted[1]) AS type
  FROM pairs p JOIN companies c ON c.company = p.supplier CROSS JOIN kinds k LEFT JOIN (SELECT kind, list(type ORDER BY pos) AS wanted FROM edges GROUP BY 1) w ON w.kind = k.kind WHERE NOT EXISTS (SELECT 1 FROM sets s WHERE s.buyer = p.buyer AND s.supplier = p.supplier)
), related AS (
  SELECT buyer, node_type, type, supplier, latest, projects, FALSE AS put FROM free f WHERE type IS NOT NULL AND NOT EXISTS (SELECT 1 FROM removed r WHERE r.buyer = f.buyer AND r.type = f.type AND r.supplier = f.supplier)
  UNION ALL SELECT s.buyer, k.kind, s.type, s.supplier, p.latest, p.projects, TRUE FROM sets s LEFT JOIN pairs p ON p.buyer = s.buyer AND p.supplier = s.supplier CROSS JOIN kinds k
), d AS (
  SELECT b.company AS buyer, t.type, c.company AS supplier, row_number() OVER (PARTITION BY b.company, t.type ORDER BY c.place <> b.place, c.company) AS nth FROM companies b JOIN (SELECT company, place, region, unnest(types) AS type FROM companies) t ON t.region = b.region JOIN companies c ON c.company = t.company
  WHERE c.company <> b.company AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.buyer = b.company AND p.supplier = c.company) AND NOT EXISTS (SELECT 1 FROM removed r WHERE r.buyer = b.company AND r.type = t.type AND r.supplier = c.company)
), n1 AS (
  SELECT company AS root, 't1' AS node, CAST(NULL AS VARCHAR) AS parent, 1 AS tier, types[1] AS type, company, 'confirmed' AS link, project, [company] AS path FROM companies JOIN (SELECT buyer, arg_max(project, strftime(o_orderdate, '%Y-%m-%d') || lpad(CAST(project AS VARCHAR), 12, '0')) AS project FROM prime JOIN orders ON o_orderkey = project GROUP BY 1) ON buyer = company{_level(2, "n1")}{_level(3, "n2")}
) SELECT root, node, parent, tier, type, CAST(company AS VARCHAR) AS company, link FROM (SELECT root, node, parent, tier, type, company, link FROM n1 UNION ALL SELECT root, node, parent, tier, type, company, link FROM n2 UNION ALL SELECT root, node, parent, tier, type, company, link FROM n3)
"""


def chain(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(roots, companies, relations, manual) as supply_tree() takes them. Lines meet their parts and their orders once, and are stored."""
    act = F.when(F.col("l_quantity") >= BIG, F.when(F.col("l_returnflag") == "A", SET).when(F.col("l_returnflag") == "R", REMOVED))
    typed = t.lineitem.select(F.col("l_orderkey").alias("project"), F.col("l_suppkey").alias("supplier"), "l_linenumber", "l_partkey", F.to_date("l_shipdate").alias("day"), act.alias("act"))
    typed = typed.join(t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("type"), F.lit(True).alias("known")), "l_partkey", "left")
    first = F.when(F.col("l_linenumber").isNotNull() & F.col("supplier").isNotNull(), F.struct("l_linenumber", "supplier"))
    buyer = F.min(first).over(Window.partitionBy("project"))["supplier"]
    lines = stored(typed.withColumn("buyer", buyer).select("project", "buyer", "supplier", "day", "type", "act", F.coalesce("known", F.lit(False)).alias("known")))
    counts = lines.where("known").groupBy(F.col("supplier").alias("company"), "type").agg(F.count("*").alias("n"))
    own = top_per(counts, ["company"], OWN_TYPES, F.desc("n"), F.col("type"), rank="nth").groupBy("company").agg(F.array_sort(F.collect_list(F.struct("nth", "type"))).getField("type").alias("types"))
    places = F.broadcast(t.nation.select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("region")))
    companies = t.supplier.select(F.col("s_suppkey").alias("company"), F.col("s_nationkey").alias("place")).join(own, "company", "left").join(places, "place", "left")
    companies = stored(companies.select("company", F.coalesce("types", F.array().cast("array<string>")).alias("types"), "place", "region"))
    later = lines.where("known and project is not null and supplier != buyer")
    manual = later.where("act is not null").select(F.col("buyer").alias("parent"), "type", F.col("supplier").alias("company"), F.when(F.col("act") == REMOVED, "removed").otherwise("set").alias("action"), F.struct("day", "project", "act").alias("at"))
    newest = lines.where("supplier = buyer").join(t.orders, F.col("o_orderkey") == F.col("project")).groupBy("buyer").agg(F.max_by("project", F.struct(F.to_date("o_orderdate").alias("d"), "project")).alias("project"))
    roots = newest.join(companies, F.col("buyer") == F.col("company")).select(F.col("company").alias("root"), "company", F.get("types", F.lit(0)).alias("type"), "project")
    return roots, companies, later.select("buyer", "supplier", "project", "day"), manual


@query(TREE_SQL)
def supply_chain_tree(t: Tables) -> DataFrame:
    """The supply tree of every company that leads an order, to the third tier, for its newest order."""
    tree = supply_tree(*chain(t), BUYS, quota=QUOTA, depth=DEPTH)
    return tree.withColumn("company", F.col("company").cast("string"))
