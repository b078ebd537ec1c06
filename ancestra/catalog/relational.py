"""Queries of joins, aggregates, labels, set operations and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ancestra.functions import text
from ancestra.operators import index as X
from ancestra.operators import nameservice as N
from ancestra.operators import places as P
from ancestra.operators import relational as R
from ancestra.operators import sortkeys as K

from . import query
from .search import place_paths

E = "epoch_us(ts)"


def event_times(t):
    return t("events").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("k"), "event_type")


def signups(t):
    return event_times(t).where("event_type = 'purchase'").select("k", F.col("event_id").alias("purchase"))


ASOF_SQL = "WITH e AS (SELECT event_id, epoch_us(ts) AS k, event_type FROM events), p AS (SELECT k, min(event_id) AS purchase FROM e WHERE event_type = 'purchase' GROUP BY k) SELECT e.event_id, p.purchase AS found FROM e ASOF LEFT JOIN p ON e.k {} p.k"


@query(ASOF_SQL.format(">="))
def asof_prev(t):
    """The last purchase at or before each event."""
    return R.asof(event_times(t).select("event_id", "k"), signups(t), "k", "purchase").select("event_id", "found")


@query(ASOF_SQL.format("<"))
def asof_next(t):
    return R.asof(event_times(t).select("event_id", "k"), signups(t), "k", "purchase", how="forward").select("event_id", "found")


@query(ASOF_SQL.format("<="))
def asof_next_inclusive(t):
    return R.asof(event_times(t).select("event_id", "k"), signups(t), "k", "purchase", how="forward_inclusive").select("event_id", "found")


@query("""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS k, event_type FROM events), p AS (SELECT user_id, k, min(event_id) AS purchase FROM e WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.purchase AS found FROM e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.k >= p.k""")
def asof_by_user(t):
    e = t("events").select("event_id", "user_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").alias("k"), "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "k", F.col("event_id").alias("purchase"))
    return R.asof(e.select("event_id", "user_id", "k"), right, "k", "purchase", by=["user_id"]).select("event_id", "found")


@query("SELECT c_custkey, CASE WHEN n_regionkey = 1 THEN r_name ELSE n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def redirect_resolve(t):
    places = place_paths(t)
    redirects = places.where("r_name = 'AMERICA'").select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    c = t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return R.resolve_redirects(c, redirects, "n_name", "place").select("c_custkey", "place")


@query("SELECT n_nationkey, n_name || ', ' || r_name || CASE WHEN n_nationkey % 2 = 0 THEN ';also ' || r_name ELSE '' END AS tokens FROM nation JOIN region ON n_regionkey = r_regionkey")
def place_tokens(t):
    p = place_paths(t)
    index = P.indexed(p.select("title", F.array().cast("array<string>").alias("names"), F.when(F.col("n_nationkey") % 2 == 0, F.array(F.concat(F.lit("also "), "r_name"))).alias("also_located_in"), F.lit("nation").alias("place_type"), F.lit(None).cast("string").alias("lat"), F.lit(None).cast("string").alias("lng")))
    return P.index_tokens(p.select("n_nationkey", "title"), index).select("n_nationkey", F.array_join("tokens", ";").alias("tokens"))


@query("SELECT s_suppkey, coalesce(n_name, s_name) AS s_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON s_nationkey = n_nationkey")
def update_join(t):
    source = t("nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s_name"))
    return R.update_from(t("supplier").select("s_suppkey", "s_nationkey", "s_name"), source, "s_nationkey", "s_name").select("s_suppkey", "s_name")


@query("SELECT count(*) FILTER (WHERE p_name LIKE 'a%') * 10 + count(*) FILTER (WHERE p_name NOT LIKE 'a%') AS weight FROM part")
def weighted_count(t):
    return K.weighted_count(t("part"), "p_name", "a", 10)


@query("SELECT p_brand, count(*) AS n, max(p_partkey) AS last FROM part GROUP BY 1")
def title_count_max(t):
    """Titles without their number: how many, and the largest number."""
    s = text.split_index_number(F.concat("p_brand", F.lit(" ("), "p_partkey", F.lit(")")))
    return t("part").select(s["title"].alias("p_brand"), s["number"].alias("k")).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("k").cast("long").alias("last"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def latest_revision(t):
    return R.latest_by(t("events"), "user_id", "event_id", "event_type")


@query("SELECT DISTINCT p_name FROM part")
def distinct_keys(t):
    """The different keys that get a label."""
    return K.rebuilt(t("part").select("p_name"), "p_name", "c", 3).select("p_name")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, (o_orderkey % 7)::bigint AS w FROM orders),
f(o_custkey, r, o_orderkey, held, total) AS (SELECT o_custkey, r, o_orderkey, CASE WHEN w >= 10 THEN 0 ELSE w END, w FROM o WHERE r = 1
UNION ALL SELECT o.o_custkey, o.r, o.o_orderkey, CASE WHEN f.held + o.w >= 10 THEN 0 ELSE f.held + o.w END, f.held + o.w FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1)
SELECT o_custkey, o_orderkey, total::bigint AS total FROM f WHERE total >= 10""")
def bucket_running_total(t):
    return R.running_buckets(t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 7).alias("w")), "o_custkey", "o_orderkey", "w", 10)


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, o_orderkey % 7 AS w, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders),
f(r, k, held, total) AS (SELECT r, o_orderkey, CASE WHEN w >= 10 THEN 0 ELSE w END, w FROM o WHERE r = 1
UNION ALL SELECT o.r, o.o_orderkey, CASE WHEN f.held + o.w >= 10 THEN 0 ELSE f.held + o.w END, f.held + o.w FROM f JOIN o ON o.r = f.r + 1)
SELECT k AS o_orderkey, total::bigint AS total FROM f WHERE total >= 10""")
def bucket_one_group(t):
    """The same with all rows in one group, which many tasks fold at once."""
    one = t("orders").select(F.lit(1).alias("g"), "o_orderkey", (F.col("o_orderkey") % 7).alias("w"))
    return R.running_buckets(one, "g", "o_orderkey", "w", 10).drop("g")


@query("SELECT p_name, (-2147483648 + row_number() OVER (ORDER BY p_name) * 1000)::bigint AS label FROM (SELECT DISTINCT p_name FROM part)")
def row_number_labels(t):
    return R.numbered(t("part").select("p_name").distinct(), "p_name", -(1 << 31), 1000)


@query("""WITH d AS (SELECT DISTINCT p_name AS k FROM part), w AS (SELECT sum(CASE WHEN k LIKE 'b%' THEN 5 ELSE 1 END) AS w FROM d)
SELECT k, (-2147483648 + (4294967296 // (w + 1)) * sum(CASE WHEN k LIKE 'b%' THEN 5 ELSE 1 END) OVER (ORDER BY k))::int AS value FROM d, w""")
def range_gap_labels(t):
    return K.rebuilt(t("part").select(F.col("p_name").alias("k")), "k", "b", 5)


@query("""WITH n AS (SELECT n_name AS sort_key, ((n_nationkey + 1) * 1000)::int AS value FROM nation WHERE n_nationkey % 5 <> 2), r AS (SELECT n_name AS k FROM nation WHERE n_nationkey % 5 = 2),
x AS (SELECT k, (SELECT arg_max(value, sort_key) FROM n WHERE sort_key <= k) AS low, (SELECT arg_min(value, sort_key) FROM n WHERE sort_key > k) AS high FROM r),
y AS (SELECT k, coalesce(low, -2147483648)::bigint AS low, coalesce(high, 2147483647)::bigint AS high, row_number() OVER (PARTITION BY low, high ORDER BY k) AS a, count(*) OVER (PARTITION BY low, high) AS c FROM x)
SELECT sort_key, value FROM n UNION ALL SELECT k, trunc((low * (c + 1 - a) + high * a) / (c + 1)::double)::int FROM y""")
def midpoint_labels(t):
    n = t("nation")
    labels = n.where("n_nationkey % 5 <> 2").select(F.col("n_name").alias("sort_key"), ((F.col("n_nationkey") + 1) * 1000).cast("int").alias("value"))
    return K.inserted(labels, n.where("n_nationkey % 5 = 2").select(F.col("n_name").alias("sort_key")))


@query("""SELECT c_custkey::varchar AS page_id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN upper(left(c_mktsegment, 1)) || lower(substr(c_mktsegment, 2)) ELSE 'Other' END || CASE WHEN c_custkey % 2 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '|Other' ELSE '' END AS surname,
CASE WHEN c_custkey % 3 = 0 THEN 'Mary' WHEN c_custkey % 3 = 1 THEN 'Other' ELSE 'Unknown' END AS given FROM customer""")
def known_name_flag(t):
    """Tokens of names by whether the list of known names has them."""
    known = t("customer").where("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.lower("c_mktsegment").alias("name")).distinct()
    docs = t("customer").select(F.col("c_custkey").cast("string").alias("PageId"), F.array(F.col("c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, "van Strange")).alias("PersonSurname"), F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("MARY"))).when(F.col("c_custkey") % 3 == 1, F.array(F.lit("zz"))).alias("PersonGivenname"))
    given = t("region").select(F.lit("mary").alias("name")).distinct()
    return X.name_facets(docs, known, given).select(F.col("PageId").alias("page_id"), F.col("PersonSurnameFacet").alias("surname"), F.col("PersonGivennameFacet").alias("given"))


WORDS = "(SELECT DISTINCT unnest(string_split(p_name, ' ')) AS name FROM part)"


def sql_soundex(x: str) -> str:
    """The sound code of a lower-case word in SQL."""
    codes = f"translate(upper({x}), 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077')"
    coded = f"left({codes}, 1) || replace(substr({codes}, 2), '7', '')"
    for d in "123456":
        coded = f"regexp_replace({coded}, '{d}+', '{d}', 'g')"
    return f"rpad(upper(left({x}, 1)) || left(replace(substr({coded}, 2), '0', ''), 3), 4, '0')"


def words_universe(t):
    return t("part").select(F.explode(F.split("p_name", " ")).alias("name")).distinct().select("name", (~F.col("name").startswith("s")).alias("common"))


@query(f"""WITH w AS (SELECT name, {sql_soundex("name")} AS code FROM {WORDS})
SELECT a.name, coalesce((SELECT string_agg(b.name, ',' ORDER BY b.name) FROM w b WHERE b.code = a.code AND b.name <> a.name AND b.name NOT LIKE 's%'), '') AS c FROM w a""")
def candidates_except(t):
    """Common names of a name's sound, without itself."""
    u = words_universe(t)
    return N.candidates(u.select("name"), u).select("name", F.array_join("candidates", ",").alias("c"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(['kept', 'gone', split_part(p_name, ' ', 1)]), lambda x: x <> 'gone')), ',') AS confirmed,
array_to_string(list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x <> split_part(p_name, ' ', 1) AND x <> 'gone')), ',') AS computer FROM part""")
def variants_merge(t):
    words = F.split("p_name", " ")
    v = t("part").select("p_partkey", F.array(F.get(words, 0)).alias("adds"), F.array(F.lit("kept"), F.lit("gone")).alias("confirmed"), F.array_distinct(words).alias("computer"))
    m = R.variants_merged(v, F.col("adds"), F.array(F.lit("gone")))
    return m.select("p_partkey", F.array_join("confirmed", ",").alias("confirmed"), F.array_join("computer", ",").alias("computer"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'building,edifice,house' ELSE lower(c_mktsegment) END AS s FROM customer")
def synonym_expand(t):
    classes = N.synonym_classes(["building, house", "edifice, building,", "x, y"])
    return t("customer").select("c_custkey", F.array_join(F.array_sort(N.with_synonyms(F.array(F.lower("c_mktsegment")), classes)), ",").alias("s"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'build,building' ELSE lower(c_mktsegment) END AS s FROM customer")
def name_variants_expand(t):
    c = t("customer").select("c_custkey", F.array(F.lower("c_mktsegment")).alias("tokens"))
    variants = t("region").select(F.lit("building").alias("name"), F.array(F.lit("build")).alias("confirmed"), F.array().cast("array<string>").alias("computer")).distinct()
    return N.expanded_tokens(c, "c_custkey", "tokens", variants).select("c_custkey", F.array_join("tokens", ",").alias("s"))


@query("SELECT s_suppkey AS k, s_name AS v FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT -1, 'new'")
def keyed_upsert(t):
    s = t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v"))
    changes = s.where("k % 3 = 0").select("k", F.lit("new").alias("v")).unionByName(t("region").select(F.lit(-1).cast("long").alias("k"), F.lit("new").alias("v")).distinct())
    return R.upsert(s, changes, "k")


@query("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 <> 1")
def keyed_delete(t):
    s = t("supplier").select(F.col("s_suppkey").alias("k"))
    return R.delete_by_key(s, s.where("k % 4 = 1"), "k")


@query("SELECT n_name AS k, n_nationkey AS v FROM nation UNION ALL SELECT r_name, -1 FROM region")
def insert_ignore(t):
    n = t("nation").select(F.col("n_name").alias("k"), F.col("n_nationkey").alias("v"))
    more = t("region").select(F.col("r_name").alias("k"), F.lit(-1).alias("v")).unionByName(n.select("k", F.lit(-1).alias("v")))
    return R.insert_ignore(n, more, "k")


def lands(t):
    """Nations under names of letters alone."""
    name = F.concat(F.lit("Land"), F.translate(F.col("n_nationkey").cast("string"), "0123456789", "abcdefghij"))
    return place_paths(t).select("n_nationkey", name.alias("n_name"), F.initcap("r_name").alias("r_name"), F.concat(name, F.lit(", "), F.initcap("r_name")).alias("title"))


def place_index(t):
    """Regions and nations as a place table."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    r = t("region").select(F.initcap("r_name").alias("title"), F.col("r_regionkey").cast("string").alias("lat"), F.col("r_regionkey").cast("string").alias("lng"))
    n = lands(t).select("title", none.alias("lat"), none.alias("lng"))
    return P.indexed(r.unionByName(n).select("title", empty.alias("names"), F.lit(None).cast("array<string>").alias("also_located_in"), F.lit("place").alias("place_type"), "lat", "lng"))


INITCAP = "array_to_string(list_transform(string_split(lower({}), ' '), lambda w: upper(left(w, 1)) || substr(w, 2)), ' ')"
LAND = "'Land' || translate(n_nationkey::varchar, '0123456789', 'abcdefghij')"
NR = f"(SELECT n_nationkey, {LAND} AS n, {INITCAP.format('r_name')} AS r, r_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN n || ', ' || r ELSE 'Nowhere, ' || r END AS result, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 'missing' END AS error FROM {NR}")
def standardize_places(t):
    """Free text resolved level by level against the hierarchy."""
    q = lands(t).select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lit("nowhere, "), F.lower("r_name"))).alias("q"))
    return P.standardize(q, place_index(t)).select("id", "result", "error")


@query(f"""SELECT n_nationkey AS id, n || ', ' || r AS title FROM {NR} WHERE n_nationkey % 4 <> 2 UNION ALL
SELECT a.n_nationkey, {INITCAP.format('r_name')} FROM {NR} a, region WHERE a.n_nationkey % 4 = 2 AND left(r_name, 2) = upper(left(a.r, 2))""")
def autocomplete(t):
    """A whole name, a whole name within a region, the two first letters of a region, and a name within a region of which two letters are there."""
    k = F.col("n_nationkey") % 4
    q = lands(t).select(F.col("n_nationkey").alias("id"), F.lower(F.when(k == 0, F.concat("n_name", F.lit(","))).when(k == 1, F.concat("n_name", F.lit(", "), "r_name", F.lit(","))).when(k == 2, F.substring("r_name", 1, 2)).otherwise(F.concat("n_name", F.lit(", "), F.substring("r_name", 1, 2)))).alias("q"))
    return P.autocomplete(q, place_index(t)).select("id", "title")


@query(f"SELECT n_nationkey AS id, r_regionkey::float AS lat FROM {NR}")
def latlng_fallback(t):
    """A place without coordinates has those of its nearest ancestor."""
    q = lands(t).select(F.col("n_nationkey").alias("id"), F.concat(F.lit("Town, "), "title").alias("title"))
    return P.title_coordinates(q, place_index(t)).select("id", "lat")


@query(f"SELECT n_nationkey AS id, n || ', ' || r AS first FROM {NR}")
def top_places(t):
    q = lands(t).select(F.col("n_nationkey").alias("id"), F.concat_ws(", ", F.initcap("n_name"), F.initcap("r_name")).alias("q"))
    return P.matches(q, place_index(t)).select("id", F.get("titles", 0).alias("first"))


DEEP = 8


def deep_places(t):
    """A chain of places eight levels deep in each region."""
    names = F.transform(F.sequence(F.lit(1), F.lit(DEEP)), lambda i: F.concat(F.lit("Lev"), F.translate(i.cast("string"), "123456789", "abcdefghi")))
    each = t("region").select("r_regionkey", F.initcap("r_name").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(DEEP))).alias("n"))
    return each.select("r_regionkey", "n", F.array_join(F.concat(F.reverse(F.slice(names, F.lit(1), F.col("n"))), F.array("r")), ", ").alias("title"))


def deep_index(t):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    return P.indexed(deep_places(t).select("title", empty.alias("names"), F.lit(None).cast("array<string>").alias("also_located_in"), F.lit("place").alias("place_type"), none.alias("lat"), none.alias("lng")))


@query(f"""WITH RECURSIVE p(k, n, title) AS (SELECT r_regionkey, 0, {INITCAP.format('r_name')} FROM region UNION ALL SELECT k, n + 1, 'Lev' || translate((n + 1)::varchar, '123456789', 'abcdefghi') || ', ' || title FROM p WHERE n < {DEEP})
SELECT k::int AS r_regionkey, n::int AS n, title, CASE WHEN n % 2 = 0 THEN title ELSE 'Nowhere, ' || title END AS standard FROM p""")
def recursive_resolve(t):
    """Texts of up to nine levels, every second with a level that no place has, resolved level by level."""
    q = deep_places(t).select(F.struct("r_regionkey", "n").alias("id"), F.lower(F.when(F.col("n") % 2 == 0, F.col("title")).otherwise(F.concat(F.lit("Nowhere, "), "title"))).alias("lookup"), F.lit(False).alias("strict"), F.lit(False).alias("begun"))
    found = P.resolve(q, deep_index(t)).select("id.r_regionkey", "id.n", "titles", "standard")
    return found.select("r_regionkey", "n", F.coalesce(F.get("titles", 0), F.regexp_replace("standard", "^Nowhere, ", "")).alias("title"), "standard")


@query(f"SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n || ', ' || r END AS found FROM {NR}")
def first_match_lookup(t):
    """Places by their title, whatever its case and spaces; the first of several."""
    k = F.col("n_nationkey") % 3
    q = lands(t).select(F.col("n_nationkey").alias("id"), F.when(k == 0, F.col("n_name")).when(k == 1, F.upper("title")).otherwise(F.concat(F.lit(" "), "n_name", F.lit(" ,  "), F.lower("r_name"))).alias("q"))
    return P.by_title(q, place_index(t), "q", "found").select("id", "found")


@query(f"SELECT n_nationkey AS id, CASE WHEN r IN ('Asia', 'Europe') THEN n || ', ' || r END AS title FROM {NR} WHERE r IN ('Asia', 'Europe')")
def located_in_semi(t):
    """Names looked up within the places that are located in given ones."""
    asked = lands(t).select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("level"), P.wanted(F.col("n_name")).alias("want"), F.array(F.lit("asia"), F.lit("europe")).alias("asked_located"), F.lit(False).alias("begun"))
    return P.level_matches(asked, place_index(t)).select("id", "title")


@query(f"""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN r_regionkey::float END AS lat, CASE n_nationkey % 3 WHEN 0 THEN 0 ELSE 2 END::int AS error FROM {NR} WHERE n_nationkey % 3 <> 1
UNION ALL SELECT n_nationkey, CASE (SELECT count(*) FROM nation WHERE left(n_name, 1) = 'A') WHEN 1 THEN NULL END, 3 FROM nation WHERE n_nationkey % 3 = 1""")
def place_coordinates(t):
    """A place's coordinates or its parent's; a text without a place and one of several places have an error's number instead."""
    k = F.col("n_nationkey") % 3
    q = lands(t).select(F.col("n_nationkey").alias("id"), F.when(k == 0, F.col("title")).when(k == 1, F.lit("Twin")).otherwise(F.concat(F.lit("zz"), "n_name")).alias("q"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    twins = t("region").where("r_regionkey < 2").select(F.concat(F.lit("Twin, "), F.initcap("r_name")).alias("title"))
    twins = P.indexed(twins.select("title", empty.alias("names"), F.lit(None).cast("array<string>").alias("also_located_in"), F.lit("place").alias("place_type"), none.alias("lat"), none.alias("lng")))
    return P.coordinates(q, place_index(t).unionByName(twins)).select("id", "lat", "error")


@query(f"""WITH u AS (SELECT name, {sql_soundex("name")} AS code FROM {WORDS})
SELECT u.name, u.name AS normalized, CASE WHEN u.name LIKE 'b%' THEN 'kept' ELSE '' END AS confirmed,
coalesce((SELECT string_agg(b.name, ',' ORDER BY b.name) FROM u b WHERE b.code = u.code AND b.name <> u.name AND b.name NOT LIKE 's%'), '') AS candidates, u.code FROM u""")
def name_info(t):
    """What is known of names: variants, names of the same sound and the sound's code."""
    u = words_universe(t)
    variants = u.where("name like 'b%'").select("name", F.array(F.lit("kept")).alias("confirmed"), F.array().cast("array<string>").alias("computer"))
    out = N.info(u.select("name"), variants, u)
    return out.select("name", "normalized", F.array_join("confirmed", ",").alias("confirmed"), F.array_join("candidates", ",").alias("candidates"), "code")
