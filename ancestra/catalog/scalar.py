"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ancestra import data
from ancestra.functions import dates, names, place, text

from . import query, quoted, sql_romanized, sql_tokens

ENTITY = "replace(replace(replace('caf&eacute; &amp; ' || p_name || '&nbsp;&Uuml;ber', '&eacute;', 'é'), '&nbsp;', ' '), '&Uuml;', 'Ü')"


@query(f"SELECT doc_id, {sql_romanized('text')} AS r FROM documents")
def romanize(t):
    return t("documents").select("doc_id", text.romanize("text").alias("r"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[üöäÜÖÄ]') THEN replace(replace(replace(replace(replace(replace(text, 'ü', 'ue'), 'ö', 'oe'), 'ä', 'ae'), 'Ü', 'Ue'), 'Ö', 'Oe'), 'Ä', 'Ae') END AS u FROM documents")
def umlauts(t):
    return t("documents").select("doc_id", text.umlauts("text").alias("u"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') AS m FROM part")
def mixed_case(t):
    return t("part").select("p_partkey", text.mixed_case("p_name").alias("m"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name || CASE p_partkey % 3 WHEN 0 THEN ' and the vii' WHEN 1 THEN ' NASA De ' ELSE ' over ' END || p_brand, ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN upper(w[i]) = 'VII' THEN 'VII' WHEN i > 1 AND w[i] IN ('and', 'the', 'over') THEN w[i] WHEN w[i] = lower(w[i]) THEN upper(left(w[i], 1)) || substr(w[i], 2) ELSE w[i] END), ' ') AS c FROM w""")
def title_case(t):
    k = F.col("p_partkey") % 3
    return t("part").select("p_partkey", text.title_case(F.concat("p_name", F.when(k == 0, " and the vii").when(k == 1, " NASA De ").otherwise(" over "), "p_brand")).alias("c"))


@query(f"SELECT p_partkey, {ENTITY} AS e FROM part")
def html_entities(t):
    return t("part").select("p_partkey", text.html_entities(F.concat(F.lit("caf&eacute; &amp; "), "p_name", F.lit("&nbsp;&Uuml;ber"))).alias("e"))


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '?', 'g') AS a FROM documents")
def ascii_fold(t):
    return t("documents").select("doc_id", text.to_ascii("text").alias("a"))


@query("SELECT doc_id, 'title:' || md5(text) AS k FROM documents")
def md5_key(t):
    return t("documents").select("doc_id", text.cache_key("title:", "text").alias("k"))


@query(f"SELECT doc_id, trim(lower(substr({sql_romanized('text')}, 1, 80))) AS k FROM documents")
def sort_key(t):
    return t("documents").select("doc_id", text.sort_key("text").alias("k"))


@query(f"SELECT doc_id, substr(trim(lower({sql_romanized('text')})), 1, 80) AS k FROM documents")
def sort_key_batch(t):
    return t("documents").select("doc_id", text.sort_key_batch("text").alias("k"))


@query("SELECT o_orderkey, epoch_ms(o_orderdate)::bigint AS ms FROM orders")
def wiki_timestamp(t):
    return t("orders").select("o_orderkey", text.wiki_millis(F.date_format("o_orderdate", "yyyyMMddHHmmss")).alias("ms"))


@query("SELECT s_suppkey, upper(left(s_name, 1)) AS l, 'other' AS o, CASE WHEN s_suppkey % 2 = 0 THEN 'WXYZ' ELSE 'A' END AS w FROM supplier")
def first_letter(t):
    return t("supplier").select("s_suppkey", text.first_letter("s_name").alias("l"), text.first_letter(F.lit("1900")).alias("o"), text.first_letter(F.when(F.col("s_suppkey") % 2 == 0, "yule").otherwise("alba")).alias("w"))


@query(f"SELECT doc_id, array_to_string(list_transform({sql_tokens('text')}, lambda x: substr(x, 1, 4)), ' ') AS k FROM documents")
def truncate_tokens(t):
    return t("documents").select("doc_id", F.array_join(F.transform(text.tokens("text"), lambda x: text.truncated(x, 4)), " ").alias("k"))


@query(f"SELECT doc_id, array_to_string(list_filter({sql_tokens('text')}, lambda x: x NOT IN ({', '.join(quoted(w) for w in sorted(data.STOP_WORDS))})), ' ') AS k FROM documents")
def stop_tokens(t):
    return t("documents").select("doc_id", F.array_join(text.without_stop_words(text.tokens("text")), " ").alias("k"))


@query("""SELECT page_id, array_to_string(list_transform(string_split(html, '<'), lambda x, i: CASE WHEN i = 1 THEN x ELSE
  regexp_replace(array_to_string(regexp_extract_all(regexp_extract(x, '^[A-Za-z0-9/]*((?:[^">]|"[^"]*")*)>?', 1), '"([^"]*)"', 1), ' '), '^((?s:.)+)$', ' \\1')
  || ' ' || regexp_replace(x, '^[A-Za-z0-9/]*(?:[^">]|"[^"]*")*>?', '') END), '') AS text FROM pages""")
def strip_markup(t):
    """Text and attribute values of whole pages."""
    return t("pages").select("page_id", text.strip_markup("html").alias("text"))


@query("SELECT n_nationkey, r_name || ',' || n_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def reverse_place(t):
    from .search import place_paths

    return place_paths(t).select("n_nationkey", place.reversed_place("title").alias("r"))


@query("SELECT n_nationkey, r_name || ',' || n_name || ',town;' || r_name || ',' || n_name || ';' || r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey")
def expand_place(t):
    from .search import place_paths

    return place_paths(t).select("n_nationkey", F.array_join(place.ancestors(place.reversed_place(F.concat(F.lit("town, "), "title"))), ";").alias("r"))


@query("SELECT n_nationkey, r_name || ',' || n_name || ',(no subordinate)' AS f FROM nation JOIN region ON n_regionkey = r_regionkey")
def facet_path(t):
    from .search import place_paths

    return place_paths(t).select("n_nationkey", place.facet_path("title").alias("f"))


@query("SELECT n_nationkey, ' ' || r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey")
def parent_place(t):
    from .search import place_paths

    return place_paths(t).select("n_nationkey", place.parent_place("title").alias("p"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'North Carolina' WHEN 1 THEN 'Utah' WHEN 2 THEN 'New York' END AS s FROM nation")
def state_abbrev(t):
    k = F.col("n_nationkey") % 4
    return t("nation").select("n_nationkey", place.state_of(F.when(k == 0, "N. Car.").when(k == 1, "ut").when(k == 2, "N.  Y.").otherwise("zz")).alias("s"))


@query("SELECT n_nationkey, n_name || CASE n_nationkey % 3 WHEN 0 THEN ', Utah, United States' WHEN 1 THEN ' (township), Ohio, United States' ELSE ' County, United States' END AS c FROM nation")
def cleanse_place(t):
    k = F.col("n_nationkey") % 3
    return t("nation").select("n_nationkey", place.cleansed(F.concat("n_name", F.when(k == 0, ",Utah").when(k == 1, " twp, Ohio").otherwise(" co., U.S.A."))).alias("c"))


LAND = "'Land' || translate(n_nationkey::varchar, '0123456789', 'abcdefghij')"


@query(f"SELECT n_nationkey, {LAND} || CASE n_nationkey % 3 WHEN 0 THEN ', Utah, United States' WHEN 1 THEN ', New York, United States' ELSE '' END AS l FROM nation")
def lookup_text(t):
    k = F.col("n_nationkey") % 3
    n = F.concat(F.lit("Land"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij"))
    return t("nation").select("n_nationkey", place.lookup_text(F.when(k == 0, F.concat(n, F.lit(", UT, 84601"))).when(k == 1, F.concat(F.lit("Ward 3, "), n, F.lit(", New York"))).otherwise(F.concat(F.lit("prob. "), n))).alias("l"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS ok FROM nation JOIN region ON n_regionkey = r_regionkey")
def place_consistent(t):
    from .search import place_paths

    p = place_paths(t)
    return p.select("n_nationkey", place.consistent(F.when(F.col("n_nationkey") % 2 == 0, F.lower("title")).otherwise(F.concat("r_name", F.lit(", "), "n_name")), "title").alias("ok"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y') || ';' || (year(o_orderdate) + 1)::varchar ELSE '' END AS d FROM orders""")
def date_tokens(t):
    style = F.col("o_orderkey") % 4
    d = F.when(style == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(style == 1, F.concat(F.lit("abt "), F.date_format("o_orderdate", "MMM yyyy"))).when(style == 2, F.concat(F.date_format("o_orderdate", "yyyy"), F.lit(" or "), (F.year("o_orderdate") + 1).cast("string"))).otherwise(F.date_format("o_orderdate", "MMM"))
    return t("orders").select("o_orderkey", F.array_join(dates.date_tokens(dates.date_words(d)), ";").alias("d"))


@query("SELECT o_orderkey, year(o_orderdate)::varchar || ';' || '950' AS y FROM orders")
def year_tokens(t):
    return t("orders").select("o_orderkey", F.array_join(dates.year_tokens(dates.date_words(F.concat(F.date_format("o_orderdate", "d MMM yyyy"), F.lit(" or 950")))), ";").alias("y"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'pre1600' ELSE left(year(o_orderdate)::varchar, 2) || '00' END AS century, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE left(year(o_orderdate)::varchar, 3) || '0' END AS decade FROM orders")
def century_decade(t):
    y = dates.century_decade(F.when(F.col("o_orderkey") % 2 == 0, "about 1599").otherwise(F.date_format("o_orderdate", "d MMM yyyy")))
    return t("orders").select("o_orderkey", y["century"].alias("century"), y["decade"].alias("decade"))


PERSON = "split_part(c_name, '#', 2)"


@query("SELECT c_custkey, lower(c_mktsegment) || ', Customer' AS r FROM customer")
def reversed_title(t):
    return t("customer").select("c_custkey", names.reversed_title(F.concat(F.lit("Customer "), F.lower("c_mktsegment"), F.lit(" ("), "c_custkey", F.lit(")"))).alias("r"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN left(c_mktsegment, 1) WHEN 1 THEN 'O' ELSE 'U' END AS i FROM customer")
def surname_index(t):
    k = F.col("c_custkey") % 3
    return t("customer").select("c_custkey", names.surname_index(F.concat(F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "Ødegaard").otherwise("123"), F.lit(", X"))).alias("i"))


@query("SELECT c_custkey, c_mktsegment AS husband, 'Jones' AS wife FROM customer")
def family_pieces(t):
    p = names.family_pieces(F.concat(F.lit("Robert "), "c_mktsegment", F.lit(" and Mary Jones (3)")))
    return t("customer").select("c_custkey", p["husband"]["surname"].alias("husband"), p["wife"]["surname"].alias("wife"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: left(w, 1)), ' ') AS i FROM part")
def initials(t):
    return t("part").select("p_partkey", names.initials("p_name").alias("i"))


@query("""SELECT p_partkey, count(*)::int AS n FROM (SELECT p_partkey, coalesce(sum(length(p_name) + 1 + length(i::varchar)) OVER (PARTITION BY p_partkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
FROM part, unnest(range(1, 13)) u(i)) WHERE before < 100 GROUP BY 1""")
def alt_names_cap(t):
    many = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.col("p_name"), F.lit(" "), i.cast("string")))
    return t("part").select("p_partkey", F.size(names.capped_names(many)).alias("n"))


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split_regex(lower({sql_romanized('text')}), '\\s+'), lambda w: regexp_replace(w, '[^a-z]', '', 'g')), lambda w: w <> ''), ' ') AS n FROM documents")
def name_tokens(t):
    return t("documents").select("doc_id", F.array_join(names.name_tokens("text"), " ").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'Person' ELSE '' END AS ns, CASE WHEN lang = 'en' THEN source ELSE 'Foo:' || source END AS title FROM documents")
def split_namespace(t):
    s = text.namespace_title(F.concat(F.when(F.col("lang") == "en", "Person:").otherwise("Foo:"), "source"))
    return t("documents").select("doc_id", s["namespace"].alias("ns"), s["title"].alias("title"))


@query("SELECT doc_id, doc_id % 5 = 0 AS redirect FROM documents")
def redirect_flag(t):
    return t("documents").select("doc_id", text.is_redirect(F.concat(F.when(F.col("doc_id") % 5 == 0, "#Redirect [[X]] ").otherwise("x #redirect [[X]] "), "text")).alias("redirect"))


@query("SELECT doc_id, source || ';' || lang AS c FROM documents")
def category_links(t):
    return t("documents").select("doc_id", F.array_join(text.category_links(F.concat(F.lit("[[Category:"), "source", F.lit("|k]] "), "text", F.lit(" [[category:"), "lang", F.lit("]]"))), ";").alias("c"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '<person>' || lang || '</person>' ELSE '' END AS xml, text AS rest FROM documents")
def structured_split(t):
    s = text.structured_split("person", F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("<person>"), "lang", F.lit("</person>"))).otherwise(""), "text"))
    return t("documents").select("doc_id", s["xml"].alias("xml"), s["text"].alias("rest"))


@query("SELECT doc_id, lang AS pre, source AS post, lang AS link FROM documents")
def bar_filters(t):
    c = F.concat("source", F.lit("|"), "lang")
    return t("documents").select("doc_id", text.after_bar(c).alias("pre"), text.before_bar(c).alias("post"), text.link_text(F.concat(F.lit("[["), c, F.lit("]]"))).alias("link"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name || ' co', ' '), lambda w: CASE w WHEN 'co' THEN 'county' ELSE w END), ' ') AS u FROM part")
def unabbrev(t):
    return t("part").select("p_partkey", F.array_join(text.unabbreviated(F.split(F.concat("p_name", F.lit(" co")), " "), data.PLACE_ABBREVIATIONS), " ").alias("u"))
