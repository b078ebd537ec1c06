"""Queries of the query language and of the single rewrites."""

from __future__ import annotations

from pyspark.sql import functions as F

from ancestra.engine import event_dates
from ancestra.functions import place, text
from ancestra.operators import search as S
from ancestra.plans.ast import Options
from ancestra.plans.compile import Compiler
from ancestra.plans.parser import parse
from ancestra.plans.rewrites import rewritten

from . import query
from .search import D, indexed, place_paths, scored

SOURCE = (("Namespace", "Source"),)


def matched(docs, q: str, options: Options | None = None, key: str = "PageId"):
    """Keys of the documents that a query finds without wider matches, by default."""
    o = options or Options(exact=True)
    return docs.where(Compiler(docs).match(rewritten(parse(q, o), o))).select(key)


def surnames(t):
    """Customers by their segment, and every second also by another name."""
    c = t("customer")
    return c.select(F.col("c_custkey").alias("PageId"), F.array(F.lower("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "machinery").otherwise("none")).alias("PersonSurname"), F.array(F.when(F.col("c_custkey") % 3 == 0, "building").otherwise("none")).alias("WifeSurname"))


def births(t):
    o = t("orders")
    return o.select(F.col("o_orderkey").alias("PageId"), F.array(F.date_format("o_orderdate", "yyyyMMdd")).alias("PersonBirthDate"), F.array(F.date_format("o_orderdate", "yyyy")).alias("PersonBirthYear"))


def filed(t):
    """Customers by their place; those of even numbers are filed at exactly the nation, others in a town of it."""
    path = F.concat("r_name", F.lit(","), "n_name", F.when(F.col("c_custkey") % 2 == 0, ",(no subordinate)").otherwise(",town"))
    return t("customer").join(place_paths(t), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("PageId"), place.ancestors(F.lower(path)).alias("PersonBirthPlace"))


CUSTOMERS = "(SELECT c_custkey AS PageId, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"{D} SELECT count(*) AS hits, round(max(CASE WHEN list_contains(k[1:5], 'reed') THEN 1.0 ELSE 0.5 END + Popularity / 1024.0)::double, 9) AS best FROM d WHERE list_contains(k, 'reed')")
def hits_and_best_score(t):
    """How many documents a search finds, and the highest score."""
    return S.search(indexed(t), "reed").summary.select("hits", F.round("best", 9).alias("best"))


@query(f"{D} SELECT 'Search results (' || count(*) || ' documents)' AS line FROM d WHERE list_contains(k, 'reed')")
def wikilist_header(t):
    return S.wiki_header(S.search(indexed(t), "reed"))


@query(f"{D} SELECT PageId, (CASE WHEN list_contains(k, 'reed') THEN 2.5 ELSE 0 END + CASE WHEN list_contains(k, 'onth') THEN 1 ELSE 0 END)::double AS score FROM d WHERE list_contains(k, 'reed') OR list_contains(k, 'onth')")
def boosted_terms(t):
    return scored(t, indexed(t), "reed^2.5 onth", Options(exact=True))


@query(f"{D} SELECT PageId FROM d WHERE list_contains(k, 'reed') AND list_contains(k, 'onth') AND NOT list_contains(k, 'una')")
def and_or_not(t):
    return matched(indexed(t), "reed AND onth NOT una")


@query(f"{D} SELECT PageId FROM d WHERE (list_contains(k, 'reed') OR list_contains(k, 'onth')) AND NOT (list_contains(k, 'shre') AND list_contains(k, 'ea')) AND list_contains(k, 'the')")
def nested_groups(t):
    return matched(indexed(t), "+(reed onth) -(+shre +ea) +Keywords:the", Options(exact=True))


@query("SELECT c_custkey AS PageId FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 2 = 0")
def name_phrase_words(t):
    """A phrase of names asks for each word, wherever it is."""
    return matched(surnames(t), 'PersonSurname:"machinery building"')


@query("SELECT o_orderkey AS PageId FROM orders WHERE year(o_orderdate) = 1996")
def year_only_date(t):
    """A date of a year alone asks the year field."""
    return matched(births(t), "PersonBirthDate:1996")


@query("SELECT o_orderkey AS PageId FROM orders WHERE strftime(o_orderdate, '%Y%m') = '199603'")
def month_date(t):
    """A date of a month asks for all its days."""
    return matched(births(t), 'PersonBirthDate:"Mar 1996"')


@query("SELECT o_orderkey AS PageId, 0.4::double AS score FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1996")
def year_range_weight(t):
    """A range of years asked of a date field asks the year field, with its weight."""
    return scored(t, births(t), "PersonBirthDate:[1994 TO 1996]")


@query(f"SELECT PageId FROM {CUSTOMERS} WHERE r_name = 'ASIA'")
def place_prefix(t):
    """A place without a match and without a comma asks for all below it."""
    return matched(filed(t), "PersonBirthPlace:Asia")


@query("SELECT c_custkey AS PageId FROM customer WHERE c_mktsegment = 'BUILDING'")
def unmatched_place_dropped(t):
    """A place without a match but with a comma asks nothing."""
    return matched(surnames(t), '+PersonBirthPlace:"Nowhere, Land" +PersonSurname:building')


@query("SELECT c_custkey AS PageId FROM customer WHERE c_mktsegment = 'BUILDING'")
def scoped_virtual_field(t):
    """Within persons Surname asks their own surname alone."""
    return matched(surnames(t), "Surname:building", Options(exact=True, filters=(("Namespace", "Person"),)))


@query("SELECT c_custkey AS PageId, 1.0::double AS score FROM customer WHERE c_mktsegment = 'BUILDING' OR c_custkey % 3 = 0")
def unscoped_virtual_field(t):
    return scored(t, surnames(t), "Surname:building", Options(exact=True))


FOUND = {"match_places": lambda x: ["NATION_6, AMERICA"]}


@query(f"SELECT PageId, 0.8::double AS score FROM {CUSTOMERS} WHERE n_name = 'NATION_6' AND PageId % 2 = 0")
def source_place_exactly(t):
    """Within sources a place finds what is filed at exactly it."""
    return scored(t, filed(t), 'PersonBirthPlace:"Nation_6, America"', Options(filters=SOURCE, **FOUND))


@query(f"SELECT PageId, CASE WHEN PageId % 2 = 0 THEN 1.5 ELSE 0.5 END::double AS score FROM {CUSTOMERS} WHERE n_name = 'NATION_6'")
def source_place_below(t):
    """With the option all below it, and what is filed at exactly it first."""
    return scored(t, filed(t), 'PersonBirthPlace:"Nation_6, America"', Options(filters=SOURCE, sub=True, **FOUND))


@query("""SELECT p_partkey, round(((1 - levenshtein(w, 'smell') / least(len(w), 5)::double) - 0.65) / 0.35, 6) AS score FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS w FROM part)
WHERE 1 - levenshtein(w, 'smell') / least(len(w), 5)::double > 0.65""")
def place_name_fuzzy(t):
    """A place's name is found by similar ones, the more similar the higher."""
    docs = t("part").select("p_partkey", F.array(F.lower(F.substring_index("p_name", " ", 1))).alias("PlaceName"))
    return scored(t, docs, "PlaceName:smell", key="p_partkey").select("p_partkey", F.round("score", 6).alias("score"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') ELSE NULL END AS standard,
CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE NULL END AS iso, CASE WHEN o_orderkey % 3 < 2 THEN year(o_orderdate)::int END AS effective_year,
CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') || '00' ELSE NULL END AS sort_key, CASE WHEN o_orderkey % 3 = 2 THEN 'no year' END AS error FROM orders""")
def event_date_service(t):
    """What the service of event dates says of days, months and texts without a year."""
    k = F.col("o_orderkey") % 3
    q = F.when(k == 0, F.date_format("o_orderdate", "d MMM yyyy")).when(k == 1, F.concat(F.lit("about "), F.date_format("o_orderdate", "MMMM yyyy"))).otherwise("in spring")
    return event_dates(t("orders").select("o_orderkey", q.alias("q"))).select("o_orderkey", "standard", "iso", "effective_year", "sort_key", "error")


@query("""SELECT doc_id, regexp_matches(text, '^[\\x00-\\x7F]*$') AS ascii, text IS NULL OR trim(text) = '' AS blank, starts_with(lower(text), 'the') AS begins, len(text) - len(replace(text, 'e', '')) AS e FROM documents""")
def text_tests(t):
    """Tests of whole texts: ASCII alone, blank, a beginning in any case, occurrences of a letter."""
    d = t("documents")
    return d.select("doc_id", text.is_ascii("text").alias("ascii"), text.is_blank("text").alias("blank"), text.starts_with_ignore_case("text", "the").alias("begins"), text.occurrences("text", "e").cast("long").alias("e"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN '  ' || lpad(p_partkey::varchar, 6, '0') ELSE '' END AS padded, lpad(p_partkey::varchar, 10, '0') AS zeros FROM part""")
def padded_titles(t):
    """Titles whose number sorts as a number."""
    return t("part").select("p_partkey", text.padded_title(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" ("), "p_partkey", F.lit(")"))).otherwise(""))).alias("padded"), text.zero_padded("p_partkey").alias("zeros"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 108 WHEN 1 THEN 109 WHEN 2 THEN 1 ELSE 8 END::int AS id, CASE doc_id % 4 WHEN 0 THEN 'Person' WHEN 1 THEN 'Person' WHEN 2 THEN 'Article' ELSE 'MediaWiki' END AS main FROM documents""")
def namespace_ids(t):
    """Namespaces' ids, and the main ones of talk pages."""
    k = F.col("doc_id") % 4
    n = F.when(k == 0, "Person").when(k == 1, "Person talk").when(k == 2, "Talk").otherwise("MediaWiki talk")
    return t("documents").select("doc_id", text.namespace_id(n).alias("id"), text.main_namespace(n).alias("main"))


@query(f"""SELECT n_nationkey, 2 + n_nationkey % 2 AS level, CASE WHEN r_name = 'ASIA' THEN r_name END AS place0, CASE WHEN r_name = 'ASIA' THEN r_name || ',' || n_name END AS place1, r_name || ',' || n_name || CASE WHEN n_nationkey % 2 = 1 THEN ',town' ELSE '' END AS path
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def place_levels(t):
    """Levels of places, blank ones aside, and the facets of known countries."""
    c = F.concat(F.when(F.col("n_nationkey") % 2 == 1, "town, ").otherwise(", ,"), "title")
    f = place.place_facets(c, F.array(F.lit("ASIA")))
    path = place.reversed_place(c)
    return place_paths(t).select("n_nationkey", place.place_level(path).alias("level"), f["place0"].alias("place0"), f["place1"].alias("place1"), path.alias("path"))
