"""Press texts made from the orders: sentences, quotes, facts, whom they name, and what their words say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadlens.functions import dates, evidence, money, names, rules
from leadlens.operators import extract
from leadlens.operators.resolve import resolve_companies
from leadlens.operators.roundup import verified_entries
from leadlens.plans.carriers import BUYER_SQL, STORIES_SQL, stories
from leadlens.registry import Tables, query

WITH = f"WITH {STORIES_SQL}"


@query(f"{WITH} SELECT story_id, 4 AS sentences, length(first) AS first_length, length('Mr. Khan signed the order on ' || strftime(signed, '%-d %B %Y') || '.') AS second_length FROM stories")
def split_sentences(t: Tables) -> DataFrame:
    """How a story falls into sentences; the short form of a title ends none."""
    s = evidence.sentences(F.col("text"))
    return stories(t).select("story_id", F.size(s).alias("sentences"), F.length(s[0]).cast("long").alias("first_length"), F.length(s[1]).cast("long").alias("second_length"))


@query(f"{WITH} SELECT story_id, CASE story_id % 2 WHEN 0 THEN first ELSE first || ' Mr. Khan signed the order on ' || strftime(signed, '%-d %B %Y') || '.' END AS sentence FROM stories")
def sentence_around(t: Tables) -> DataFrame:
    """The sentence that holds the seller's name, or the two that a span over their border touches."""
    at = F.instr("text", F.col("seller")) - 1
    end = F.when(F.col("story_id") % 2 == 0, at + F.length("seller")).otherwise(F.length("first") + 10)
    return stories(t).select("story_id", evidence.sentence_around(F.col("text"), at, end).alias("sentence"))


@query(f"""{WITH} SELECT story_id, CASE story_id % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'same' WHEN 2 THEN CASE WHEN round((1 - 1.0 / length(first)) * 100) >= 97 THEN 'near' ELSE 'none' END ELSE 'none' END AS how,
CASE WHEN story_id % 5 IN (0, 1) OR (story_id % 5 = 2 AND round((1 - 1.0 / length(first)) * 100) >= 97) THEN CAST(0 AS DOUBLE) END AS place FROM stories""")
def quote_verify_fuzzy(t: Tables) -> DataFrame:
    """Quotes as they stand, with other case and spacing, with a changed letter, and of another text."""
    first, case = F.col("first"), F.col("story_id") % 5
    quote = F.when(case == 0, first).when(case == 1, F.regexp_replace(F.upper(first), " ", "  ")).when(case == 2, F.concat(F.left(first, F.length(first) - 3), F.lit("q"), F.right(first, F.lit(2)))).otherwise(F.reverse(first))
    rows = stories(t).select("story_id", evidence.found_quote(F.col("text"), quote).alias("q"))
    return rows.select("story_id", "q.how", F.col("q.at").cast("double").alias("place"))


@query(f"{WITH} SELECT story_id, CASE story_id % 3 WHEN 0 THEN first WHEN 1 THEN first END AS original FROM stories")
def original_quote(t: Tables) -> DataFrame:
    first = F.col("first")
    quote = F.when(F.col("story_id") % 3 == 0, first).when(F.col("story_id") % 3 == 1, F.regexp_replace(F.lower(first), " ", "\n ")).otherwise(F.concat(first, F.lit("x")))
    return stories(t).select("story_id", evidence.original_quote(F.col("text"), quote).alias("original"))


@query(f"""{WITH} SELECT story_id, story_id % 4 <> 1 AS money, story_id % 4 <> 2 AS day, TRUE AS month, story_id % 4 <> 3 AS name FROM stories""")
def value_backed(t: Tables) -> DataFrame:
    """Whether a story's words back a value: an amount written out, a day, a month, a name."""
    case, text = F.col("story_id") % 4, F.col("text")
    amount = F.concat(F.lit("USD "), ((F.col("millions") + F.when(case == 1, F.col("millions")).otherwise(0)) * 1000).cast("string"), F.lit(" thousand"))
    day = F.date_add("signed", F.when(case == 2, 1).otherwise(0)).cast("string")
    name = F.concat(F.upper("seller"), F.when(case == 3, " Gmbh").otherwise(""))
    signed = F.col("second")
    return stories(t).withColumn("second", evidence.sentences(text)[1]).select("story_id", evidence.value_backed(amount, F.col("first"), F.lit("number")).alias("money"), evidence.value_backed(day, signed, F.lit("date")).alias("day"), evidence.value_backed(F.date_format("signed", "MMMM yyyy"), signed, F.lit("date")).alias("month"), evidence.value_backed(name, F.col("first"), F.lit("name")).alias("name"))


@query(f"{WITH} SELECT story_id, CAST(signed AS VARCHAR) || '|' || CAST(closing AS VARCHAR) AS days, 2 AS n FROM stories")
def dates_in_quote(t: Tables) -> DataFrame:
    """All days that a story names, in order."""
    found = F.col("found")
    day = F.transform(found, lambda d: F.when(d["d"].isNull(), F.format_string("%04d-%02d", d["y"], d["m"])).otherwise(F.format_string("%04d-%02d-%02d", d["y"], d["m"], d["d"])))
    return stories(t).select("story_id", dates.dates_in(F.col("text")).alias("found")).select("story_id", F.array_join(day, "|").alias("days"), F.size(found).alias("n"))


@query(f"""{WITH} SELECT story_id, 'awarded' AS stage, buyer AS awarder, seller AS awardee, 'supplier' AS role, CAST(millions * 1000000 AS DOUBLE) AS usd, CAST(signed AS VARCHAR) AS award_date, ref AS tender_ref, CAST(closing AS VARCHAR) AS closing_date, length(first) AS quoted FROM stories""")
def rules_extract(t: Tables) -> DataFrame:
    """Award facts of every story by rules alone, with the sentence that they stand in."""
    rows = extract.facts(stories(t), "story_id", F.col("text"))
    return rows.select("story_id", "stage", "awarder", "awardee", "role", F.col("usd").cast("double").alias("usd"), "award_date", "tender_ref", "closing_date", F.length("quote").cast("long").alias("quoted"))


@query(f"""{WITH} SELECT story_id, CASE WHEN story_id % 4 = 3 THEN 'single' ELSE 'both' END AS seller_agreement, CASE story_id % 4 WHEN 1 THEN 'disputed' ELSE 'both' END AS usd_agreement, CASE story_id % 4 WHEN 2 THEN 'disputed' ELSE 'both' END AS day_agreement, seller, CAST(millions * 1000000 AS VARCHAR) AS usd FROM stories""")
def extract_document(t: Tables) -> DataFrame:
    """Two readings of each story, by rules and as a table of answers would have it, and how they agree."""
    case = F.col("story_id") % 4
    base = stories(t)
    ruled = extract.facts(base, "story_id", F.col("text")).select("story_id", F.col("awardee").alias("seller"), F.col("usd").cast("string").alias("usd"), F.col("award_date").alias("day"))
    said = base.select("story_id", F.when(case != 3, F.concat(F.upper("seller"), F.lit(" "))).alias("seller"), (F.col("millions") * F.when(case == 1, 1_100_000).otherwise(1_005_000)).cast("string").alias("usd"), F.when(case == 2, F.date_add("signed", 1)).otherwise(F.col("signed")).cast("string").alias("day"))
    out = extract.agreed(ruled, said, ["story_id"], {"seller": "name", "usd": "number", "day": "date"})
    return out.select("story_id", "seller_agreement", "usd_agreement", "day_agreement", "seller", "usd")


@query(f"{WITH} SELECT story_id, TRUE AS buyer_named, TRUE AS seller_named, story_id % 2 = 0 AS typed_named FROM stories")
def names_company(t: Tables) -> DataFrame:
    """Whose names stand in a story as whole words, whatever the signs between them."""
    text = F.col("text")
    typed = F.when(F.col("story_id") % 2 == 0, F.regexp_replace(F.upper("seller"), " ", "-")).otherwise(F.concat("seller", F.lit(" Overseas")))
    return stories(t).select("story_id", evidence.names_company(text, F.col("buyer")).alias("buyer_named"), evidence.names_company(text, F.col("seller")).alias("seller_named"), evidence.names_company(text, typed).alias("typed_named"))


@query(f"""{WITH} SELECT story_id, CASE story_id % 3 WHEN 0 THEN seller || ' won an order. It makes pipes in Oman.' WHEN 1 THEN seller || ' won an order.' END AS claim FROM stories""")
def attribution(t: Tables) -> DataFrame:
    """The claim by which a quote is about the seller: its own, one that a pronoun carries on, or none where another is the subject."""
    case = F.col("story_id") % 3
    own = F.concat("seller", F.lit(" won an order."))
    text = F.concat(own, F.lit(" It makes pipes in Oman.\n"), F.col("buyer"), F.lit(" is a client."))
    quote = F.when(case == 0, "It makes pipes in Oman.").when(case == 1, "won an order").otherwise(F.concat("buyer", F.lit(" is a client.")))
    return stories(t).select("story_id", evidence.attributed(text, quote, F.col("seller"), own).alias("claim"))


@query(f"""{WITH} SELECT story_id, CASE story_id % 6 WHEN 0 THEN 'event' WHEN 1 THEN 'government' WHEN 2 THEN 'headline' WHEN 3 THEN 'address' WHEN 4 THEN 'place' ELSE CASE WHEN length(buyer) < 3 THEN 'length' END END AS junk, CASE story_id % 6 WHEN 5 THEN buyer END AS tidy FROM stories""")
def entity_junk(t: Tables) -> DataFrame:
    """Why names aren't those of buying companies, and what stays of one that has a place before it."""
    case = F.col("story_id") % 6
    name = F.when(case == 0, F.concat("buyer", F.lit(" Expo"))).when(case == 1, F.concat(F.lit("Ministry of "), "buyer")).when(case == 2, F.concat("buyer", F.lit(" wins order"))).when(case == 3, F.concat(F.lit("www."), "buyer")).when(case == 4, "Saudi Arabia").otherwise(F.concat(F.lit("Dubai-based "), "buyer"))
    return stories(t).select("story_id", rules.junk_name(F.when(case == 5, F.col("buyer")).otherwise(name)).alias("junk"), F.when(case.isin(4, 5), names.tidy_company(name)).alias("tidy"))


@query("""SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'procurement_lead' WHEN 1 THEN 'project_director' WHEN 2 THEN 'executive' WHEN 3 THEN 'tender_contact' ELSE 'other' END AS role,
CASE c_custkey % 5 WHEN 0 THEN 'director' WHEN 1 THEN 'director' WHEN 2 THEN 'executive' WHEN 3 THEN 'manager' ELSE 'specialist' END AS seniority,
CASE c_mktsegment WHEN 'BUILDING' THEN 'infrastructure' WHEN 'MACHINERY' THEN 'power' WHEN 'AUTOMOBILE' THEN 'oil_gas' WHEN 'HOUSEHOLD' THEN 'water' END AS sector FROM customer""")
def role_rules(t: Tables) -> DataFrame:
    """Buying role, seniority and sector from words."""
    case = F.col("c_custkey") % 5
    title = F.when(case == 0, "Head of Procurement").when(case == 1, "Project Director").when(case == 2, "CEO").when(case == 3, "Tender Manager").otherwise("Clerk")
    seg = F.col("c_mktsegment")
    text = F.when(seg == "BUILDING", "Metro rail works").when(seg == "MACHINERY", "A solar farm").when(seg == "AUTOMOBILE", "Crude oil line").when(seg == "HOUSEHOLD", "Desalination plant").otherwise("Toys")
    return t.customer.select("c_custkey", rules.buying_role(title).alias("role"), rules.seniority(title).alias("seniority"), rules.sector(text).alias("sector"))


@query("""SELECT p_partkey, 'X' || (42 + p_size) AS grades, CASE p_partkey % 2 WHEN 0 THEN 'API 5L' ELSE 'ISO 3183' END AS standards, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN round(p_size * 10 / 25.4, 1) ELSE round((100 + p_size) / 25.0) END AS inches FROM part""")
def spec_parse(t: Tables) -> DataFrame:
    """Grade, standard and diameter of parts from loose text."""
    case, size = F.col("p_partkey") % 3, F.col("p_size")
    diameter = F.when(case == 0, F.concat(size.cast("string"), F.lit("-inch"))).when(case == 1, F.concat((size * 10).cast("string"), F.lit(" mm"))).otherwise(F.concat(F.lit("DN "), (100 + size).cast("string")))
    text = F.concat(F.lit("pipe x "), (42 + size).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " api5L ").otherwise(" iso 3183 "), diameter)
    rows = t.part.select("p_partkey", rules.spec(text).alias("s"))
    return rows.select("p_partkey", F.array_join("s.grades", "|").alias("grades"), F.array_join("s.standards", "|").alias("standards"), F.col("s.inches").cast("double").alias("inches"))


@query("SELECT p_partkey, lower(p_name) AS words, 2 AS forms FROM part")
def item_words(t: Tables) -> DataFrame:
    """An item's words, and in how many number forms a page may name it."""
    words = rules.item_words(F.col("p_name"))
    return t.part.select("p_partkey", words.alias("words"), F.size(rules.number_forms(words)).alias("forms"))


@query("""WITH n AS (SELECT p_partkey, lower(p_name) AS name, string_split(lower(p_name), ' ')[-1] AS word FROM part)
SELECT p_partkey, 100 AS whole, CASE WHEN length(name) >= 3 THEN 60 + least(30, length(name)) ELSE 0 END AS within, CASE WHEN length(name) > length(word) AND length(word) >= 4 THEN 45 WHEN name = word THEN 100 ELSE 35 END AS part FROM n""")
def material_score(t: Tables) -> DataFrame:
    """How well words name a part: as a whole, within other words, and by its last word alone."""
    name = F.lower("p_name")
    score = lambda words: rules.material_score(words, name, F.array(name), F.array().cast("array<string>"))
    rows = t.part.select("p_partkey", score(name).alias("whole"), score(F.concat(F.lit("zz "), name, F.lit(" zz"))).alias("within"), score(F.substring_index(name, " ", -1)).alias("part"))
    return rows


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'filing' WHEN 1 THEN 'roundup' WHEN 2 THEN 'junk' WHEN 3 THEN 'article' WHEN 4 THEN 'tender_notice' ELSE 'company_site' END AS kind FROM pages""")
def page_kind(t: Tables) -> DataFrame:
    """What pages are, by address and title."""
    case = F.col("page_id") % 6
    host = F.lit("https://firm.example.org/")
    url = F.when(case == 0, F.concat(host, F.lit("filings/"), F.col("page_id").cast("string"))).when(case == 3, F.concat(host, F.lit("news/2024/"), F.col("page_id").cast("string"))).otherwise(host)
    title = F.when(case == 1, "Top 10 makers").when(case == 2, "Pipe market size").when(case == 4, "Contract award notice").otherwise("Welcome")
    return t.pages.select("page_id", rules.page_kind(url, title, F.lit("plain text")).alias("kind"))


@query(f"{WITH} SELECT story_id, CASE WHEN year(signed) >= 2000 AND story_id % 3 < 2 THEN CAST(signed AS VARCHAR) END AS day FROM stories")
def publication_dateline(t: Tables) -> DataFrame:
    """The day of a dateline, in either order; a day within a sentence is none, nor is one before 2000."""
    case = F.col("story_id") % 3
    line = F.when(case == 0, F.concat(F.lit("Dubai, "), F.date_format("signed", "MMM d, yyyy"), F.lit(" - News"))).when(case == 1, F.date_format("signed", "d MMMM yyyy")).otherwise(F.concat(F.lit("It was signed on "), F.date_format("signed", "d MMMM yyyy")))
    return stories(t).select("story_id", rules.dateline(F.concat(F.lit("Menu\n"), line, F.lit("\n"), F.col("first"))).cast("string").alias("day"))


@query(f"{WITH} SELECT story_id, TRUE AS tender, millions, CAST(millions * 1000000 AS DOUBLE) AS largest FROM stories")
def tender_wording(t: Tables) -> DataFrame:
    """Stories that speak of a tender, and the largest number that they state."""
    largest = F.array_max(money.numbers_in(F.col("first")))
    return stories(t).select("story_id", rules.tender_wording(F.col("text")).alias("tender"), "millions", largest.alias("largest"))


@query(f"""WITH c AS (SELECT c_custkey, {BUYER_SQL} AS buyer, n_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey)
SELECT c_custkey AS mention_id, CASE c_custkey % 5 WHEN 4 THEN NULL ELSE CAST(c_custkey AS DOUBLE) END AS company_id, CASE c_custkey % 5 WHEN 0 THEN CAST(0.9 AS DOUBLE) WHEN 4 THEN CAST(0.6 AS DOUBLE) ELSE CAST(0.85 AS DOUBLE) END AS certainty FROM c""")
def resolve_company(t: Tables) -> DataFrame:
    """Mentions of buyers as texts spell them against the register: with a legal form, without a country, with another name
    written to them under another country, with a word more, and of somebody unknown."""
    places = F.broadcast(t.nation.select("n_nationkey", "n_name"))
    register = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("company_id"), F.expr(BUYER_SQL.replace("VARCHAR", "STRING")).alias("name"), F.col("n_name").alias("country"))
    case = F.col("company_id") % 5
    spelt = F.when(case == 0, F.concat("name", F.lit(" Ltd"))).when(case == 2, F.concat("name", F.lit(" (Zz "), F.col("company_id").cast("string"), F.lit(")"))).when(case == 3, F.concat("name", F.lit(" Overseas"))).when(case == 4, F.concat(F.lit("Nobody "), F.col("company_id").cast("string"))).otherwise(F.col("name"))
    country = F.when(case == 1, None).when(case == 2, "ELSEWHERE").otherwise(F.col("country"))
    got = resolve_companies(register.select(F.col("company_id").alias("mention_id"), spelt.alias("name"), country.alias("country")), register)
    return got.select("mention_id", F.col("company_id").cast("double").alias("company_id"), "certainty")


@query(f"""{WITH}, p AS (SELECT story_id, lower(buyer) AS key, buyer AS name, 'owner' AS role, signed FROM stories UNION ALL SELECT story_id, lower(seller), seller, 'supplier', signed FROM stories)
SELECT key, arg_min(name, story_id) AS name, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles, count(*) AS documents, CAST(min(signed) AS VARCHAR) AS first_award, CAST(max(signed) AS VARCHAR) AS last_award FROM p GROUP BY 1""")
def resolve_document(t: Tables) -> DataFrame:
    """Companies from the facts of all stories, each once by its key, with the roles and awards that any story gives it."""
    f = extract.facts(stories(t), "story_id", F.col("text"))
    sides = F.array(F.struct(F.col("awarder").alias("name"), F.lit("owner").alias("role")), F.struct(F.col("awardee").alias("name"), F.col("role").alias("role")))
    rows = f.select("story_id", F.col("award_date").alias("day"), F.explode(sides).alias("x")).select("story_id", "day", "x.*").where("name is not null")
    keyed = rows.withColumn("key", names.company_key(F.col("name")))
    return keyed.groupBy("key").agg(F.min_by("name", "story_id").alias("name"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count("*").alias("documents"), F.min("day").alias("first_award"), F.max("day").alias("last_award"))


#: Press items of five forms, one for each priority of an order: a headline, a unit's win, an aside with people, a tender, a passive.
NEWS_SQL = f"""news AS (
  SELECT story_id, buyer, seller, millions, signed, o_orderpriority AS form, CASE left(o_orderpriority, 1)
    WHEN '1' THEN seller || ' In Focus After Securing Rs ' || millions || ' Crore Gas Pipeline Contract From ' || buyer
    WHEN '2' THEN buyer || '''s unit wins a USD ' || millions || ' million steel pipe order.' || chr(10) || 'Nothing else was said.'
    WHEN '3' THEN seller || ', the main EPC contractor on the Kappa Gas Project, has won a contract worth USD ' || millions || ' million from ' || buyer || '. Anna Berg, Procurement Manager, signed it on ' || CAST(signed AS VARCHAR) || '.'
    WHEN '4' THEN buyer || ' has floated tenders for a valve package. Tender No: RF-' || story_id || '/A. Bids are due by ' || CAST(closing AS VARCHAR) || '.'
    ELSE seller || ' was awarded a subcontract of USD ' || millions || ' million by ' || buyer || ' on ' || CAST(signed AS VARCHAR) || '.' END AS body, closing
  FROM stories JOIN orders ON o_orderkey = story_id)"""


def news(t: Tables) -> DataFrame:
    """story_id and body of a press item for every order that has a line; its form follows the order's priority."""
    rows = stories(t).join(t.orders.select(F.col("o_orderkey").alias("story_id"), F.left("o_orderpriority", F.lit(1)).alias("form")), "story_id")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    buyer, seller, n, signed, closing = F.col("buyer"), F.col("seller"), F.col("millions").cast("string"), F.col("signed").cast("string"), F.col("closing").cast("string")
    body = (
        F.when(F.col("form") == "1", said(seller, " In Focus After Securing Rs ", n, " Crore Gas Pipeline Contract From ", buyer))
        .when(F.col("form") == "2", said(buyer, "'s unit wins a USD ", n, " million steel pipe order.\nNothing else was said."))
        .when(F.col("form") == "3", said(seller, ", the main EPC contractor on the Kappa Gas Project, has won a contract worth USD ", n, " million from ", buyer, ". Anna Berg, Procurement Manager, signed it on ", signed, "."))
        .when(F.col("form") == "4", said(buyer, " has floated tenders for a valve package. Tender No: RF-", F.col("story_id").cast("string"), "/A. Bids are due by ", closing, "."))
        .otherwise(said(seller, " was awarded a subcontract of USD ", n, " million by ", buyer, " on ", signed, "."))
    )
    return rows.select("story_id", body.alias("body"))


@query(f"""{WITH}, {NEWS_SQL} SELECT story_id, CASE left(form, 1) WHEN '2' THEN 'unknown' WHEN '4' THEN 'epc_tender' ELSE 'awarded' END AS stage, CASE left(form, 1) WHEN '2' THEN NULL ELSE buyer END AS awarder,
CASE WHEN left(form, 1) IN ('1', '3', '5') THEN seller END AS awardee, CASE left(form, 1) WHEN '1' THEN 'main_epc' WHEN '3' THEN 'main_epc' WHEN '5' THEN 'subcontractor' END AS role,
CASE WHEN left(form, 1) IN ('3', '5') THEN CAST(signed AS VARCHAR) END AS award_date, CASE left(form, 1) WHEN '4' THEN 'RF-' || story_id || '/A' END AS tender_ref, CASE left(form, 1) WHEN '4' THEN CAST(closing AS VARCHAR) END AS closing_date FROM news""")
def news_facts(t: Tables) -> DataFrame:
    """Facts of press items in five forms. What a unit wins is neither its parent's nor given by it."""
    out = extract.facts(news(t), "story_id", F.col("body"))
    return out.select("story_id", "stage", "awarder", "awardee", "role", "award_date", "tender_ref", "closing_date")


@query(f"""{WITH}, {NEWS_SQL}, m AS (
SELECT story_id, seller AS name, CASE left(form, 1) WHEN '5' THEN 'subcontractor' ELSE 'main_epc' END AS role, CAST(NULL AS VARCHAR) AS title FROM news WHERE left(form, 1) IN ('1', '3', '5')
UNION ALL SELECT story_id, buyer, CASE left(form, 1) WHEN '2' THEN 'parent' WHEN '5' THEN 'main_epc' ELSE 'owner' END, NULL FROM news
UNION ALL SELECT story_id, 'Anna Berg', 'person', 'Procurement Manager' FROM news WHERE left(form, 1) = '3') SELECT * FROM m""")
def news_mentions(t: Tables) -> DataFrame:
    """Everybody whom press items name, with the role that says most."""
    return extract.mentions(news(t), "story_id", F.col("body")).select("story_id", "name", "role", "title")


@query(f"""{WITH}, e AS (SELECT o_custkey, story_id, seller, o_orderstatus AS status, lead(seller) OVER (PARTITION BY o_custkey ORDER BY story_id) AS other FROM stories JOIN orders ON o_orderkey = story_id
), g AS (SELECT *, status = 'F' AND length(seller) >= 3 AS good FROM e
), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, seller, good ORDER BY story_id) AS nth, count(*) FILTER (NOT good) OVER (PARTITION BY o_custkey) AS dropped, coalesce(other = seller OR starts_with(other, seller || ' '), FALSE) AS also FROM g)
SELECT o_custkey, story_id, seller AS name, CASE WHEN also THEN 'value,kind' ELSE 'value' END AS fields, CASE WHEN also THEN 1 ELSE 2 END AS lost, dropped FROM n WHERE good AND nth = 1""")
def roundup_verify(t: Tables) -> DataFrame:
    """Every buyer's stories as one article, and its list of sellers as somebody has read it: with quotes that were never
    written, names that the quote doesn't have, and fields that belong to the next story."""
    rows = stories(t).join(t.orders.select(F.col("o_orderkey").alias("story_id"), "o_custkey", "o_orderstatus"), "story_id")
    order = Window.partitionBy("o_custkey").orderBy("story_id")
    rows = rows.withColumn("after", F.lead("first").over(order))
    quote = F.when(F.col("o_orderstatus") == "O", F.regexp_replace("first", "awarded", "promised")).otherwise(F.col("first"))
    name = F.when(F.col("o_orderstatus") == "P", "Nobody At All").otherwise(F.col("seller"))
    value = F.concat(F.lit("USD "), F.col("millions").cast("string"), F.lit(" million"))
    field = lambda kind, text, said: F.struct(F.lit(kind).alias("field"), text.alias("text"), said.alias("quote"))
    fields = F.array(field("value", value, F.col("first")), field("kind", F.lit("supply contract"), F.col("after")), field("date", F.lit("yesterday"), F.col("first")))
    entries = rows.select(F.col("o_custkey").alias("article"), F.col("story_id").alias("place"), name.alias("name"), quote.alias("quote"), fields.alias("fields"))
    bodies = rows.groupBy(F.col("o_custkey").alias("article")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("story_id", "first"))), lambda x: x["first"]), "\n").alias("body"))
    out = verified_entries(bodies, entries)
    return out.select(F.col("article").alias("o_custkey"), F.col("place").alias("story_id"), "name", F.array_join("fields.field", ",").alias("fields"), "lost", "dropped")
