"""Queries of each kind of page, from XML made of the parts' table."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ancestra.operators import extract, index
from ancestra.operators import places as P

from . import query
from .pages import raw_pages
from .search import place_paths


def filled(template: str):
    """A template whose {expressions} are Spark SQL over the row."""
    parts = re.split(r"\{([^}]*)\}", template)
    return F.concat(*[F.expr(f"cast({p} as string)") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


def extracted(t, title: str, xml: str):
    return extract.documents(raw_pages(t, filled(title), filled(xml), "p_partkey", "part")).withColumnRenamed("PageId", "page_id")


def joined(*names: str):
    """Arrays as one text each, named like the field in lower case."""
    return [F.array_join(n, "; ").alias(n.lower()) for n in names]


@query("""SELECT p_partkey::varchar AS page_id, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS author, 'T' || p_partkey || ' ' || p_name AS title, p_type || '; ' || p_name AS sourcesubject,
'e' || p_size % 5 || CASE WHEN p_size % 3 = 0 THEN '; r' || p_size || '; o' ELSE '' END AS sourcesubsubject, 'a' || p_size % 4 AS sourceavailability, (1800 + p_size)::varchar AS fromyear, CASE WHEN p_size % 2 = 0 THEN '1900' ELSE '' END AS toyear,
p_brand || ', X' AS otherplace, p_type AS placestored, p_name AS othersurname FROM part""")
def source_page_index(t):
    """Sources: linked authors, subjects of several elements, availability, years, and a title of two parts."""
    d = extracted(t, "Source:T{p_partkey}", "<source><author>[[{case when p_size % 2 = 0 then concat('Source:A|', p_brand) else concat(p_type, '(', p_size, ')') end}]]</author><source_title>{p_name}</source_title><source_category>{p_type}</source_category><subject>{p_name}</subject><ethnicity>e{p_size % 5}</ethnicity>{case when p_size % 3 = 0 then concat('<religion>r', p_size, '</religion><occupation>o</occupation>') else '' end}<repository title='R' availability='a{p_size % 4}'/><from_year>{1800 + p_size}</from_year>{case when p_size % 2 = 0 then '<to_year>1900</to_year>' else '' end}<place>{p_brand}, X|{p_type}</place><surname>{p_name}</surname></source>{p_name}")
    return d.select("page_id", F.col("Title").alias("title"), *joined("Author", "SourceSubject", "SourceSubSubject", "SourceAvailability", "FromYear", "ToYear", "OtherPlace", "PlaceStored", "OtherSurname"))


@query("SELECT p_partkey::varchar AS page_id, p_brand AS author, p_name AS othersurname, p_type || ', Y' AS otherplace, p_type || ', Y' AS placestored, (1700 + p_size)::varchar AS fromyear FROM part")
def mysource_page_index(t):
    d = extracted(t, "MySource:U/{p_name}", "<mysource><author>{p_brand}</author><surname>{p_name}</surname><place>{p_type}, Y</place><from_year>{1700 + p_size}</from_year></mysource>")
    return d.select("page_id", *joined("Author", "OtherSurname", "OtherPlace", "PlaceStored", "FromYear"))


@query("SELECT p_partkey::varchar AS page_id, p_brand AS otherplace, p_type AS placestored, '' AS othersurname FROM part")
def repository_page_index(t):
    """Repositories have places and no surnames."""
    d = extracted(t, "Repository:{p_name}", "<repository><place>{p_brand}|{p_type}</place><surname>{p_name}</surname></repository>")
    return d.select("page_id", *joined("OtherPlace", "PlaceStored", "OtherSurname"))


@query("SELECT p_partkey::varchar AS page_id, CASE WHEN p_size % 4 = 0 THEN '' ELSE p_name END AS othersurname, CASE WHEN p_size % 4 = 0 THEN '' ELSE (1600 + p_size)::varchar END AS fromyear, CASE WHEN p_size % 4 = 0 THEN '<transcript>' ELSE '' END || p_type AS text FROM part")
def transcript_page_index(t):
    """Transcripts, a quarter of which has XML that doesn't end and so is text."""
    d = extracted(t, "Transcript:{p_name}/{p_partkey}", "<transcript>{case when p_size % 4 = 0 then '' else concat('<surname>', p_name, '</surname><from_year>', 1600 + p_size, '</from_year></transcript>') end}{p_type}")
    return d.select("page_id", *joined("OtherSurname", "FromYear"), F.col("TextStored").alias("text"))


@query("SELECT p_partkey::varchar AS page_id, p_name AS othersurname, p_brand AS otherplace, 'u; N' || p_partkey || ' x' AS user FROM part")
def user_page_index(t):
    """Users' pages: what they research, and the user's own name among the users."""
    d = extracted(t, "User:N{p_partkey} x", "<user><researching surname='{p_name}' place='{p_brand}'/></user>hello")
    return d.select("page_id", *joined("OtherSurname", "OtherPlace", "User"))


@query("SELECT p_partkey::varchar AS page_id, p_type || '; C' || p_partkey || ' y' AS category, p_name AS othersurname FROM part")
def category_page_index(t):
    """Categories' pages are in their own category, too."""
    d = extracted(t, "Category:C{p_partkey} y", "<category><surname>{p_name}</surname></category>[[Category:{p_type}]]")
    return d.select("page_id", *joined("Category", "OtherSurname"))


@query("""SELECT p_partkey::varchar AS page_id, CASE WHEN p_size % 2 = 0 THEN 'S' || p_partkey END AS surnametitle, CASE WHEN p_size % 2 = 1 THEN 'S' || p_partkey END AS givennametitle,
CASE WHEN p_size % 2 = 0 THEN 'S' || p_partkey ELSE '' END AS othersurname, CASE WHEN p_size % 2 = 1 THEN 'S' || p_partkey ELSE '' END AS othergivenname, p_name || '; ' || p_type AS relatedname FROM part""")
def name_page_index(t):
    """Surnames' and given names' pages with the names related to them."""
    xml = "<{case when p_size % 2 = 0 then 'surname' else 'givenname' end}><related name='{p_name}'/><related name='{p_type}'/></{case when p_size % 2 = 0 then 'surname' else 'givenname' end}>"
    d = extracted(t, "{case when p_size % 2 = 0 then 'Surname' else 'Givenname' end}:S{p_partkey}", xml)
    return d.select("page_id", F.col("SurnameTitle").alias("surnametitle"), F.col("GivennameTitle").alias("givennametitle"), *joined("OtherSurname", "OtherGivenname", "RelatedName"))


SPLIT = "string_split(p_name, ' ')"


@query(f"""SELECT p_partkey::varchar AS page_id, p_type || '; Reed; ' || {SPLIT}[2] AS othersurname, 'G' || p_size || '; Al; ' || {SPLIT}[1] AS othergivenname, p_brand AS otherplace, 'Reed, Al and ' || {SPLIT}[2] || ', ' || {SPLIT}[1] AS fullname FROM part""")
def image_page_index(t):
    """Images: names of persons in them and of both spouses of families, whose titles give the full name."""
    d = extracted(t, "Image:I{p_partkey}.jpg", "<image_data><person given='G{p_size}' surname='{p_type}'/><family title='Al Reed and {p_name} ({p_size})'/><place>{p_brand}</place></image_data>")
    return d.select("page_id", *joined("OtherSurname", "OtherGivenname", "OtherPlace"), F.col("FullnameStored").alias("fullname"))


@query(f"""SELECT p_partkey::varchar AS page_id, CASE WHEN p_size % 2 = 0 THEN 'Person' ELSE 'Family' END AS namespace, TRUE AS talk, '' AS personsurname, '' AS husbandsurname,
CASE WHEN p_size % 2 = 0 THEN {SPLIT}[2] || ', ' || {SPLIT}[1] ELSE {SPLIT}[2] || ', ' || {SPLIT}[1] || ' and B, A' END AS fullname, '<person><name given="x" surname="y"/></person>' || p_type AS text FROM part""")
def talk_page_index(t):
    """Talk pages of persons and families: in the namespace of their subject, marked, with names from the title alone; their text isn't read as XML."""
    d = extracted(t, "{case when p_size % 2 = 0 then concat('Person talk:', p_name) else concat('Family talk:', p_name, ' and A B') end} ({p_size})", "<person><name given=\"x\" surname=\"y\"/></person>{p_type}")
    return d.select("page_id", F.col("Namespace").alias("namespace"), F.col("TalkNamespace").alias("talk"), *joined("PersonSurname", "HusbandSurname"), F.col("FullnameStored").alias("fullname"), F.col("TextStored").alias("text"))


@query("SELECT p_partkey::varchar AS page_id, CASE WHEN p_size % 3 = 2 THEN '' ELSE 'Wed' || p_size % 7 END AS personmarriedname, CASE WHEN p_size % 3 = 2 THEN 'M' ELSE 'F' END AS persongender, p_size % 3 = 1 AS unsourced, p_brand || '; ' || p_type AS parentfamilytitle FROM part")
def person_married_names(t):
    """Women's married names from their families' titles; persons without text and sources are unsourced."""
    xml = "<person><name given='A' surname='{p_type}'/><gender>{case when p_size % 3 = 2 then 'M' else 'F' end}</gender><child_of_family title='{p_brand}'/><child_of_family title='{p_type}'/><spouse_of_family title='Bob Wed{p_size % 7} and A B (1)'/>{case when p_size % 3 = 0 then '<note>n</note>' else '' end}</person>{case when p_size % 3 = 2 then p_name else ' ' end}"
    d = extracted(t, "Person:{p_name} ({p_partkey})", xml)
    return d.select("page_id", *joined("PersonMarriedName", "PersonGender", "ParentFamilyTitle"), F.coalesce("Unsourced", F.lit(False)).alias("unsourced"))


@query("""WITH p AS (SELECT n_nationkey, n_name || ', ' || r_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN ';also ' || r_name ELSE '' END AS also FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey::varchar AS page_id, '(no subordinate), ' || title || also AS born, CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN '(no subordinate), Nowhere, X' ELSE '(no subordinate), ' || title || also || ';(no subordinate), Nowhere, X' END AS died, '' AS married
FROM customer JOIN p ON c_nationkey = n_nationkey""")
def batch_place_standardize(t):
    """The places of a batch of documents: redirects resolved, further parents added, unknown ones by themselves; all fields through one pair of joins."""
    paths = place_paths(t)
    none = F.array().cast("array<string>")
    places = paths.select("title", none.alias("names"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("also "), "r_name"))).alias("also_located_in"), F.lit("nation").alias("place_type"), F.lit(None).cast("string").alias("lat"), F.lit(None).cast("string").alias("lng"))
    redirects = paths.select(F.concat(F.lit("Old "), "title").alias("source"), F.col("title").alias("target"))
    c = t("customer").join(paths, F.col("c_nationkey") == F.col("n_nationkey"))
    old, lost = F.concat(F.lit("Old "), "title"), F.lit("Nowhere, X")
    died = F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("unknown"))).when(F.col("c_custkey") % 4 == 1, F.array(lost)).otherwise(F.array(F.col("title"), lost))
    docs = c.select(F.col("c_custkey").cast("string").alias("PageId"), F.array(F.when(F.col("c_custkey") % 3 == 0, old).otherwise(F.col("title"))).alias("PersonBirthPlace"), died.alias("PersonDeathPlace"), none.alias("MarriagePlace"), none.alias("OtherPlace"))
    found = index.standardized_places(docs, redirects, P.indexed(places))
    shown = lambda f: F.array_join(f, ";")
    return found.select(F.col("PageId").alias("page_id"), shown("PersonBirthPlace").alias("born"), shown("PersonDeathPlace").alias("died"), shown("MarriagePlace").alias("married"))
