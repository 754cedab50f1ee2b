"""Word rules that sort titles, items, pages and names; each is an ordered list of a pattern and what it says."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadlens.functions import dates, names, urls
from leadlens.functions.binding import let


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """What the first rule says whose pattern occurs in the lower-case text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F
    for pattern, says in rules:
        out = out.when(low.rlike(pattern), says)
    return out.otherwise(F.lit(otherwise))


#: What a job title says about a person's part in buying.
BUYING_ROLE = [("procurement|purchas|supply chain|buyer|sourcing", "procurement_lead"), ("projects? director|head of projects", "project_director"), ("package (?:manager|lead)", "package_manager"), (r"tender|contracts?\b|bid manager", "tender_contact"), (r"chief executive|\bceo\b|managing director|president|chairman", "executive"), ("project manager", "decision_maker"), ("engineer|technical", "technical_evaluator"), ("logistics", "logistics_coordinator")]
#: Fixed values.
SENIORITY = [(r"chief|\bc[ep]o\b|managing director|president|chairman", "executive"), (r"director|\bhead\b|vice president|\bvp\b", "director"), ("manager|lead|secretary", "manager"), (".", "specialist")]
#: What a project's text says about its sector.
SECTOR = [("petrochemical|polymer|cracker", "petrochemical"), (r"\b(?:gas|oil)\b|crude|lng|refin|petroleum|condensate|hydrocarbon", "oil_gas"), ("water|desalination|sewage|wastewater", "water"), ("power|electricity|solar|wind farm|substation", "power"), ("mining|mineral", "mining"), ("road|rail|metro|port|airport|infrastructure|city gas", "infrastructure")]
#: An item's kind; other items are their own.
ITEM = [("line ?pipes?", "line pipe"), (r"valves?\b", "valves")]


def buying_role(title: Column) -> Column:
    return first_rule(title, BUYING_ROLE, "other")


def seniority(title: Column) -> Column:
    return first_rule(title, SENIORITY)


def sector(text: Column) -> Column:
    return first_rule(text, SECTOR)


def item_category(item: Column) -> Column:
    return F.coalesce(first_rule(item, ITEM), F.left(F.trim(F.regexp_replace(F.lower(item), r"\s+", " ")), F.lit(80)))


#: Words and phrases that make a name something else than a company's, in order of what they are said to be.
JUNK_WORDS = {
    "event": ("expo", "conference", "exhibition", "trade fair", "summit"),
    "government": ("ministry", "department of", "government of"),
    "association or consultant": ("association", "council", "chamber", "institute", "market report", "market intelligence", "insights"),
    "headline": ("award", "awards", "awarded", "win", "wins", "secured", "bags", "how to", "market size", "market outlook"),
}


def _says(words: Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases stands among words that single blanks part."""
    padded = F.concat(F.lit(" "), words, F.lit(" "))
    return reduce(or_, [F.contains(padded, F.lit(f" {p} ")) for p in phrases])


def junk_name(name: Column) -> Column:
    """Why a name can't be a buying company's; null for names that can."""
    n = F.trim(name)

    def why(words: Column) -> Column:
        address = F.contains(n, F.lit("@")) | F.contains(F.lower(n), F.lit("http://")) | F.contains(F.lower(n), F.lit("https://")) | F.lower(n).startswith("www.")
        out = F.when(~F.length(n).between(3, 180), "length").when(F.lower(n).isin(*names.PLACES), "place").when(address, "address")
        counted = words.rlike("(^| )top [0-9]")
        for kind, phrases in JUNK_WORDS.items():
            said = _says(words, phrases)
            said = said | F.contains(F.concat(F.lit(" "), words), F.lit(" consult")) if kind.endswith("consultant") else said | counted if kind == "headline" else said
            out = out.when(said, kind)
        return out

    return let(item_words(n), why)


#: Domains of publishers, a host's own or above it, among them those that post jobs or host anybody's pages.
PUBLISHERS = ["reuters.com", "zawya.com", "meed.com", "arabnews.com", "gulfnews.com", "ft.com", "businesswire.com", "indiatimes.com", "worldoil.com", "ogj.com"]
#: Fixed values.
NOT_COMPANIES = [*PUBLISHERS, "linkedin.com", "facebook.com", "wikipedia.org", "scribd.com", "indeed.com", "glassdoor.com", "wordpress.com", "blogspot.com", "medium.com", "github.io"]


def under(host: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or under one: its own suffixes are looked up, not every domain compared."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.coalesce(F.arrays_overlap(suffixes, F.array(*map(F.lit, domains))), F.lit(False))


#: Phrases of titles, and parts of paths, that say what a page is.
TITLES = {
    "junk": ("market size", "market report", "market analysis", "market outlook", "cagr", "salary", "job", "jobs"),
    "tender_notice": ("contract award notice", "contract notice", "tender notice"),
    "roundup": ("list of",),
}
PATHS = {
    "junk": ("daily-prices", "privacy", "terms-and-conditions", "cookie-policy"),
    "listing": ("topic", "tag", "tags", "category", "archive"),
    "filing": ("filings", "disclosures", "announcements"),
    "article": ("news", "article", "articles", "press-release", "press-releases"),
}
AWARD_WORDS = ("award", "awards", "awarded", "win", "wins", "won", "secured", "order", "orders")
DIRECTORY_WORDS = ("company name", "contractor name", "member directory")
#: Lines of that many cells make a page a directory.
CELLS, LINES = 3, 6


def page_kind(url: Column, title: Column, text: Column) -> Column:
    """What a page is, by address, title and text: junk, tender_notice, filing, roundup, directory, article or company_site."""
    host, path = urls.host(url), F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    parts = F.struct(F.split(path, "/").alias("path"), item_words(F.coalesce(title, F.lit(""))).alias("title"), item_words(F.coalesce(text, F.lit(""))).alias("text"))

    def decide(p: Column) -> Column:
        within = lambda kind: F.exists(p["path"], lambda s: reduce(or_, [s == v for v in PATHS[kind]]))
        begins = F.exists(p["path"], lambda s: reduce(or_, [(s == v) | s.startswith(v + "-") for v in PATHS["article"]]))
        titled = lambda kind: _says(p["title"], TITLES[kind])
        published = under(host, PUBLISHERS)
        table_lines = F.size(F.filter(F.split(text, "\n"), lambda line: F.size(F.split(line, "[|]")) >= CELLS))
        counted = p["title"].rlike("(^| )(top|leading) [0-9]") | F.exists(p["path"], lambda s: s.rlike("^top-[0-9]+-"))
        awards = (_says(p["title"], AWARD_WORDS) | _says(p["text"], AWARD_WORDS)) & (F.array_contains(p["path"], "companies") | path.endswith(".ece"))
        dated = F.exists(F.slice(p["path"], 1, F.size(p["path"]) - 1), lambda s: s.rlike("^20[0-9]{2}$"))
        out = F.when(host.isNull() | ~(url.startswith("http:") | url.startswith("https:")), "junk")
        out = out.when(titled("junk") | F.contains(p["title"], F.lit("career")) | within("junk"), "junk")
        out = out.when(published & F.coalesce(F.get(p["path"], F.lit(1)).isin(*PATHS["listing"]), F.lit(False)), "junk")
        out = out.when(titled("tender_notice") | F.contains(path, F.lit("/notice/-/detail/")), "tender_notice").when(within("filing"), "filing")
        out = out.when(titled("roundup") | counted, "roundup").when((table_lines >= LINES) & _says(p["text"], DIRECTORY_WORDS), "directory")
        return out.when(published | begins | dated | awards, "article").otherwise("company_site")

    return let(parts, decide)


#: Words that say "tender" in several languages.
TENDER_WORDS = ["tender", "request for proposal", "request for quotation", "invitation to bid", "licitación", "appel d'offres", "ausschreibung", "gara d'appalto", "مناقصة"]


def tender_wording(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in TENDER_WORDS:
        out = out | F.contains(low, F.lit(w))
    return F.coalesce(out, F.lit(False))


#: Patterns of a material's grade, standard and size.
GRADE = r"(?i)\bX\s?[0-9]{2,3}\b"
STANDARD = r"(?i)\b(?:API\s?(?:5L|6D|600|602|608|6A|Q1)|ASME\s?B[0-9]+(?:[.][0-9]+)?|ISO\s?3183|EN\s?10208)\b"
#: Signs and words behind a diameter in inches; words before one, and before one in nominal millimetres.
INCHES, BEFORE_INCHES, BEFORE_MM = ("\"", "”", "''", "inch", "inches", "in", "nps"), ("nps",), ("dn", "nb")


def inches(text: Column) -> Column:
    """The first diameter of a text in inches: given so, in millimetres or as a nominal size. Read token by token."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"([0-9]+(?:[.][0-9]+)?|[a-z]+|''|[\"”])"), F.lit(1))

    def first(t: Column) -> Column:
        at = lambda i: F.get(t, i)
        number = lambda i: at(i).try_cast("double")
        near = lambda i, words: F.coalesce(F.when(i >= 0, at(i)).isin(*words), F.lit(False))
        pick = lambda test: F.get(F.array_compact(F.transform(t, lambda x, i: F.when(x.rlike("^[0-9]") & test(i), number(i)))), F.lit(0))
        return F.coalesce(pick(lambda i: near(i + 1, INCHES)), pick(lambda i: near(i - 1, BEFORE_INCHES)), F.round(pick(lambda i: near(i + 1, ("mm",))) / 25.4, 1), F.round(pick(lambda i: near(i - 1, BEFORE_MM)) / 25))

    return let(tokens, first)


def spec(text: Column) -> Column:
    """struct<grades, standards, inches> that a text states, each once and in one spelling."""
    every = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    grades = F.transform(every(GRADE), lambda g: F.upper(F.regexp_replace(g, r"\s", "")))
    standards = F.transform(every(STANDARD), lambda s: F.regexp_replace(F.upper(s), r"^(API|ASME|ISO|EN)\s?", "$1 "))
    return F.struct(F.array_distinct(grades).alias("grades"), F.array_distinct(standards).alias("standards"), inches(text).alias("inches"))


def item_words(text: Column) -> Column:
    """Lower case, no accents, letters and digits with single blanks."""
    return F.trim(F.regexp_replace(F.lower(names.without_marks(text)), r"[^\p{L}\p{N}]+", " "))


def number_forms(phrase: Column) -> Column:
    """A phrase with its last word in singular and plural; words under three letters or with digits stay as they are."""
    last = F.substring_index(phrase, " ", -1)
    head = F.left(phrase, F.length(phrase) - F.length(last))
    cut = lambda n: F.left(last, F.length(last) - n)
    other = F.when(last.rlike("(?:ss|us|is)$"), F.concat(last, F.lit("es"))).when(last.rlike("(?:ches|shes|xes)$"), cut(2)).when(last.endswith("ies"), F.concat(cut(3), F.lit("y")))
    other = other.when(last.endswith("s"), cut(1)).when(last.rlike("(?:ch|sh|x)$"), F.concat(last, F.lit("es"))).when(last.rlike("[^aeiou]y$"), F.concat(cut(1), F.lit("ies"))).otherwise(F.concat(last, F.lit("s")))
    return F.when((F.length(last) < 3) | last.rlike("[0-9]"), F.array(phrase)).otherwise(F.array(phrase, F.concat(head, other)))


def material_score(text: Column, name: Column, terms: Column, standards: Column) -> Column:
    """How well words name a catalogue item, 0 to 100: the item itself, a standard of it, a term within the words, the words
    within a term, or the share of their words that its terms have."""
    has = lambda t, p: F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))
    exact = F.array_contains(F.concat(F.array(name), terms), text)
    standard = F.exists(standards, lambda s: has(text, s))
    within = F.array_max(F.transform(F.filter(terms, lambda t: (F.length(t) >= 3) & has(text, t)), lambda t: 60 + F.least(F.lit(30), F.length(t))))
    around = (F.length(text) >= 4) & F.exists(terms, lambda t: (F.length(t) > F.length(text)) & has(t, text))
    words = F.filter(F.split(text, " "), lambda w: F.length(w) >= 3)
    known = F.flatten(F.transform(F.concat(F.array(name), terms), lambda t: F.split(t, " ")))
    share = F.when(F.size(words) > 0, F.round(F.size(F.filter(words, lambda w: F.array_contains(known, w) | F.array_contains(known, F.regexp_replace(w, "s$", "")))) / F.size(words) * 35)).otherwise(0)
    return F.greatest(F.when(exact, 100).otherwise(0), F.when(standard, 90).otherwise(0), F.coalesce(within, F.lit(0)), F.when(around, 45).otherwise(0), share.cast("int"))


def dateline(text: Column) -> Column:
    """The day of the first line that is a dateline ("Dubai, Mar 5, 2024 - ..." or "5 March 2024"), as a date; else null.

    What stands before a colon or a dash must be a date alone, of three words, behind a place and a comma at most. Only
    years from 2000 on count.
    """

    def day(line: Column) -> Column:
        head = F.trim(F.get(F.split(line, r"\s*[:–—]|\s+-\s|-\s"), F.lit(0)))
        place = F.substring_index(head, ",", 1)
        rest = F.when(F.contains(head, F.lit(",")) & ~place.rlike("[0-9]") & F.length(place).between(2, 35), F.substr(head, F.length(place) + 2)).otherwise(head)
        alone = F.size(F.regexp_extract_all(rest, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))) == 3
        found = let(rest, lambda r: dates.parse_date(r))
        return F.when(alone & (found >= "2000"), F.try_to_date(found))

    lines = F.filter(F.transform(F.split(text, "\n+"), lambda x: F.trim(x)), lambda x: x.rlike("20[0-9]{2}"))
    return F.get(F.array_compact(F.transform(lines, day)), F.lit(0))
