"""Queries of page extraction, from XML pages made of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ancestra.engine import Engine
from ancestra.operators import extract, index
from ancestra.plans.ast import Options

from . import query


def raw_pages(t, title, contents, key, table, spread=True):
    """A table's rows as pages. spread: over all tasks, as a page takes long for the few bytes of its row, of which a split of a file holds very many."""
    rows = t(table).repartition(key) if spread else t(table)
    return rows.select(F.col(key).cast("string").alias("page_id"), title.alias("full_title"), F.lit(1).cast("long").alias("rev_id"), F.lit("20200101000000").alias("rev_timestamp"), F.lit(7).alias("popularity"), contents.alias("contents"), F.array(F.lit("u")).alias("users"), F.array().cast("array<string>").alias("trees"))


def persons(t):
    given, surname = F.concat(F.lit("Given"), "c_custkey"), F.initcap("c_mktsegment")
    xml = F.concat(F.lit('<person><name given="'), given, F.lit('" surname="'), surname, F.lit('"/><gender>'), F.when(F.col("c_custkey") % 2 == 0, "M").otherwise("F"), F.lit('</gender><child_of_family title="Rob '), surname, F.lit(' and Mary Jones (3)"/><event_fact type="Birth" date="3 Feb 18'), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit('" place="Kent, England|Kent"/></person>[[Category:'), surname, F.lit("]]"))
    return raw_pages(t, F.concat(F.lit("Person:"), given, F.lit(" "), surname, F.lit(" (1)")), xml, "c_custkey", "customer")


SEGMENT = "upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2))"


@query(f"""SELECT c_custkey::varchar AS page_id, 'Given' || c_custkey AS given, {SEGMENT} AS surname, 'Rob' AS father, {SEGMENT} AS father_surname, 'Jones' AS mother_surname, 'unknown' AS spouse, 'Kent' AS place_stored, 'Kent, England' AS place,
'1800' AS century, '18' || substr(lpad((c_custkey % 100)::varchar, 2, '0'), 1, 1) || '0' AS decade, 'England' AS country, 'England, Kent' AS state, {SEGMENT} || ', Given' || c_custkey AS fullname, left(c_mktsegment, 1) AS letter, {SEGMENT} AS category FROM customer""")
def person_index(t):
    d = extract.documents(persons(t))
    return d.select(
        F.col("PageId").alias("page_id"), F.get("PersonGivenname", 0).alias("given"), F.get("PersonSurname", 0).alias("surname"), F.get("FatherGivenname", 0).alias("father"), F.get("FatherSurname", 0).alias("father_surname"), F.get("MotherSurname", 0).alias("mother_surname"),
        F.get("SpouseGivenname", 0).alias("spouse"), F.get("PersonBirthPlaceStored", 0).alias("place_stored"), F.get("PersonBirthPlace", 0).alias("place"), F.col("PersonCenturyFacet").alias("century"), F.col("PersonDecadeFacet").alias("decade"), F.col("PersonCountryFacet").alias("country"),
        F.col("PersonStateFacet").alias("state"), F.col("FullnameStored").alias("fullname"), F.col("SurnameIndexFacet").alias("letter"), F.get("Category", 0).alias("category"),
    )


LETTER = "translate((s_suppkey % 10)::varchar, '0123456789', 'abcdefghij')"


@query(f"""SELECT s_suppkey::varchar AS page_id, 'Hus' || {LETTER} AS husband, CASE WHEN s_suppkey % 2 = 0 THEN 'Wed' || {LETTER} ELSE 'D' END AS wife, (1700 + s_suppkey % 200)::varchar AS born, CASE WHEN s_suppkey % 2 = 0 THEN '1801' ELSE '0000' END AS wife_born,
'Hus' || {LETTER} || ', A and ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Wed' || {LETTER} || ', Eve' ELSE 'D, C' END AS fullname, 'Family:B, A and D, C' AS sort FROM supplier""")
def family_index(t):
    k = F.translate((F.col("s_suppkey") % 10).cast("string"), "0123456789", "abcdefghij")
    wife = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("<wife given='Eve' surname='Wed"), k, F.lit("' birthdate='1801'/>"))).otherwise("")
    xml = F.concat(F.lit("<family><husband given='A' surname='Hus"), k, F.lit("' birthdate='"), (1700 + F.col("s_suppkey") % 200).cast("string"), F.lit("'/>"), wife, F.lit("</family>text"))
    d = extract.documents(raw_pages(t, F.concat(F.lit("Family:A B and C D ("), "s_suppkey", F.lit(")")), xml, "s_suppkey", "supplier"))
    return d.select(F.col("PageId").alias("page_id"), F.get("HusbandSurname", 0).alias("husband"), F.get("WifeSurname", 0).alias("wife"), F.get("HusbandBirthDate", 0).alias("born"), F.get("WifeBirthDate", 0).alias("wife_born"), F.col("FullnameStored").alias("fullname"), F.col("TitleSort").alias("sort"))


@query("SELECT n_nationkey::varchar AS page_id, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS name, ' Earth' AS located, n_nationkey::varchar AS lat FROM nation")
def place_page_index(t):
    n = F.initcap("n_name")
    p = raw_pages(t, F.concat(F.lit("Place:"), n, F.lit(", Earth")), F.concat(F.lit("<place><type>Country</type><latitude>"), "n_nationkey", F.lit("</latitude></place>")), "n_nationkey", "nation")
    d = extract.documents(p)
    return d.select(F.col("PageId").alias("page_id"), F.get("PlaceName", 0).alias("name"), F.get("LocatedInPlace", 0).alias("located"), F.get("Latitude", 0).alias("lat"))


@query("SELECT doc_id::varchar AS page_id, CASE WHEN doc_id % 2 = 0 THEN source END AS surname, CASE WHEN doc_id % 2 = 0 THEN lang END AS place FROM documents WHERE doc_id % 5 <> 0")
def xpath_extract(t):
    """Articles with XML, without, malformed, and redirects."""
    body = F.when(F.col("doc_id") % 5 == 0, F.lit("#redirect [[X]]")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<article><surname>"), "source", F.lit("</surname><place>"), "lang", F.lit("|x</place></article>"), "text")).otherwise(F.lit("<article><broken></article>"))
    d = extract.documents(raw_pages(t, F.concat(F.lit("Title "), "doc_id"), body, "doc_id", "documents", spread=False))
    return d.select(F.col("PageId").alias("page_id"), F.get("OtherSurname", 0).alias("surname"), F.get("OtherPlace", 0).alias("place"))


@query(f"SELECT c_custkey::varchar AS page_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Building' ELSE 'Other' END AS surname, 'Other' AS given FROM customer")
def name_facets(t):
    known = t("region").select(F.lit("building").alias("name")).distinct()
    d = index.name_facets(extract.documents(persons(t)), known, known)
    return d.select(F.col("PageId").alias("page_id"), F.col("PersonSurnameFacet").alias("surname"), F.col("PersonGivennameFacet").alias("given"))


@query("SELECT c_custkey::varchar AS page_id, 1.65 + 7 / 1024.0 AS score FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 100 BETWEEN 40 AND 45")
def engine_search(t):
    """Pages to index to search: a surname, and a range of birth years that doesn't score."""
    docs = index.build(extract.documents(persons(t)).drop("Title"))
    r = Engine(docs).search("+PersonSurname:building +PersonBirthYear:[1840 TO 1845]", Options(filters=(("Namespace", "Person"),)), rows=None)
    return r.docs.select(F.col("PageId").alias("page_id"), F.round(F.col("score") - 0.4, 9).alias("score"))


@query("SELECT c_custkey::varchar AS page_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::int END AS value FROM customer")
def sort_values(t):
    docs = t("customer").select(F.col("c_custkey").cast("string").alias("PageId"), F.concat(F.lit("Title "), "c_custkey").alias("TitleSort"))
    labels = t("customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("title "), "c_custkey").alias("sort_key"), F.col("c_custkey").cast("int").alias("value"))
    return index.with_sort_values(docs, labels).select(F.col("PageId").alias("page_id"), F.col("TitleSortValue").alias("value"))
