"""Queries of predicates, scores, facets, order and highlights."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ancestra.functions import analysis, place, stem, text
from ancestra.operators import postings as P
from ancestra.operators import search as S
from ancestra.operators.best import search_best
from ancestra.operators.terms import Terms, similar
from ancestra.plans.ast import MUST, MUST_NOT, SHOULD, Bool, DisMax, Options, Term, Wildcard
from ancestra.plans.compile import Compiler
from ancestra.plans.parser import parse
from ancestra.plans.rewrites import rewritten
from ancestra.session import shared_dir

from . import query, sql_tokens


def indexed(t):
    """documents as search documents: Keywords and Title (its first five tokens), Popularity, Namespace."""
    d = t("documents").select(F.col("doc_id").alias("PageId"), "lang", "source", F.col("n_chars").alias("Popularity"), text.tokens("text").alias("Keywords"))
    return d.withColumn("Title", F.slice("Keywords", 1, 5))


D = f"WITH d AS (SELECT doc_id AS PageId, lang, source, n_chars AS Popularity, {sql_tokens('text')} AS k FROM documents)"


def found(t, q: str, **options):
    docs = indexed(t)
    return docs.where(Compiler(docs).match(parse(q, Options(**options)))).select("PageId")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND source = 'src3'")
def project_filter(t):
    """Projection and filters that don't score, both pushed to the scan."""
    return S.filtered(t("documents").select("doc_id", "lang", "source", "n_chars"), (("lang", "en"), ("source", "src3")))


@query(f"{D} SELECT PageId FROM d WHERE list_contains(k, 'was')")
def term_match(t):
    return found(t, "+was -zzz")


@query(f"{D} SELECT PageId FROM d WHERE len(list_filter(k, lambda x: starts_with(x, 'tionth'))) > 0")
def prefix_match(t):
    return found(t, "tionth*")


@query(f"{D} SELECT PageId FROM d WHERE len(list_filter(k, lambda x: x LIKE 'th%ing_s')) > 0")
def wildcard_match(t):
    return found(t, "th*ing?s")


@query(f"{D} SELECT PageId FROM d WHERE list_contains(k, 'reed') AND NOT list_contains(k, 'una')")
def bool_must_should_not(t):
    return found(t, "+reed onth -una")


@query(f"{D} SELECT PageId FROM d WHERE contains(' ' || array_to_string(k, ' ') || ' ', ' in th ')")
def phrase_match(t):
    return _phrase(t)


def _phrase(t):
    from ancestra.plans.ast import Phrase

    docs = indexed(t)
    return docs.where(Compiler(docs).match(Phrase("Keywords", ("in", "th")))).select("PageId")


@query("SELECT o_orderkey FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998")
def year_range(t):
    docs = t("orders").select("o_orderkey", F.array(F.date_format("o_orderdate", "yyyy")).alias("PersonBirthYear"))
    return docs.where(Compiler(docs).match(parse("PersonBirthYear:[1996 TO 1998]"))).select("o_orderkey")


@query("""SELECT p_partkey, round(1 - levenshtein(w, 'smell') / least(len(w), 5)::double, 6) AS similarity
FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS w FROM part) WHERE 1 - levenshtein(w, 'smell') / least(len(w), 5)::double > 0.3""")
def fuzzy_name(t):
    from ancestra.plans.ast import Fuzzy

    docs = t("part").select("p_partkey", F.lower(F.substring_index("p_name", " ", 1)).alias("PlaceName"))
    return docs.where(Compiler(docs).match(Fuzzy("PlaceName", "smell", 0.3))).select("p_partkey", F.round(Compiler.similarity(F.col("PlaceName"), "smell"), 6).alias("similarity"))


@query(f"{D} SELECT PageId, round(greatest(CASE WHEN list_contains(k, 'reed') THEN 0.4 ELSE 0 END, CASE WHEN list_contains(k, 'onth') THEN 0.9 ELSE 0 END)::double, 6) AS score FROM d WHERE list_contains(k, 'reed') OR list_contains(k, 'onth')")
def dismax_score(t):
    docs = indexed(t)
    q = DisMax((Term("Keywords", "reed", 0.4), Term("Keywords", "onth", 0.9)))
    c = Compiler(docs)
    return docs.where(c.match(q)).select("PageId", F.round(c.score(q), 6).alias("score"))


def scored(t, docs, q: str, options: Options | None = None, key: str = "PageId"):
    o = options or Options()
    tree = rewritten(parse(q, o), o)
    c = Compiler(docs)
    return docs.where(c.match(tree)).select(key, F.round(c.score(tree), 9).alias("score"))


@query(f"""{D} SELECT PageId, round((CASE WHEN list_contains(k, 'reed') THEN 0.5 ELSE 0 END + CASE WHEN list_contains(k[1:5], 'reed') THEN 0.5 ELSE 0 END + Popularity / 1024.0)::double, 9) AS score
FROM d WHERE list_contains(k, 'reed')""")
def popularity_score(t):
    return scored(t, indexed(t), "reed")


KEYWORD_SQL = f"""{D}, s AS (SELECT PageId, (CASE WHEN list_contains(k, 'reed') THEN 0.5 ELSE 0 END + CASE WHEN list_contains(k[1:5], 'reed') THEN 0.5 ELSE 0 END
  + CASE WHEN contains(' ' || array_to_string(k, ' ') || ' ', ' onth re ') THEN 0.5 ELSE 0 END + CASE WHEN contains(' ' || array_to_string(k[1:5], ' ') || ' ', ' onth re ') THEN 0.5 ELSE 0 END) AS s, Popularity FROM d)
SELECT PageId, round((s + Popularity / 1024.0)::double, 6) AS score FROM s WHERE s > 0 ORDER BY 2 DESC, 1 LIMIT 10"""


@query(KEYWORD_SQL)
def keyword_search(t):
    """The flagship: a word or a phrase, weighted, with the title and popularity, the ten best."""
    return S.search(indexed(t), 'reed "onth re"').docs.select("PageId", F.round("score", 6).alias("score"))


@query(f"{D} SELECT PageId FROM d WHERE list_contains(k, 'reed') AND list_contains(k, 'ha') ORDER BY Popularity, PageId LIMIT 20")
def sorted_and(t):
    """With a sort all words are required."""
    return S.search(indexed(t), "reed ha", Options(sort="Popularity", exact=True), rows=20).docs.select("PageId")


@query(f"{D} SELECT PageId FROM d WHERE list_contains(k, 'reed') ORDER BY PageId LIMIT 5 OFFSET 10")
def paged_topk(t):
    return S.search(indexed(t), "reed", Options(exact=True), start=10, rows=5).docs.select("PageId")


@query(f"{D} SELECT lang AS value, count(*) AS count FROM d WHERE list_contains(k, 'reed') GROUP BY 1")
def facet_single(t):
    return S.search(indexed(t), "reed", Options(exact=True), facets=("lang",)).facets["lang"]


@query(f"{D} SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(k)) AS value FROM d) GROUP BY 1")
def facet_tokens(t):
    """Documents per term, over whole texts."""
    return S.facet(indexed(t).select("Keywords"), "Keywords")


@query("SELECT source AS value, count(*) AS count FROM documents WHERE lang = 'de' GROUP BY 1")
def facet_filtered(t):
    return S.facet(S.filtered(t("documents").select("lang", "source"), (("lang", "de"),)), "source")


def place_paths(t):
    n, r = t("nation"), t("region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat("n_name", F.lit(", "), "r_name").alias("title"), "n_name", "r_name")


@query("""WITH c AS (SELECT n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT value, count(*) AS count FROM (SELECT r_name AS value FROM c UNION ALL SELECT r_name || ',' || n_name FROM c) GROUP BY 1""")
def facet_place_hierarchy(t):
    """Customers per level of their place."""
    places = t("customer").select("c_nationkey").join(place_paths(t), F.col("c_nationkey") == F.col("n_nationkey"))
    return S.facet(places.select(place.ancestors(place.reversed_place("title")).alias("Place")), "Place")


@query("""WITH l AS (SELECT * FROM (VALUES (0,'Article'),(1,'User'),(2,'Project'),(3,'Image'),(4,'MediaWiki'),(5,'Template'),(6,'Help'),(7,'Category'),(8,'Givenname'),(9,'Surname'),(10,'Source'),(11,'Place'),(12,'Person'),(13,'Family'),(14,'MySource'),(15,'Repository'),(16,'Portal'),(17,'Transcript')) v(position, namespace)),
d AS (SELECT CASE lang WHEN 'en' THEN 'Person' WHEN 'de' THEN 'Family' ELSE 'Article' END AS n FROM documents)
SELECT l.position::int AS position, l.namespace, count(d.n) AS count FROM l LEFT JOIN d ON d.n = l.namespace GROUP BY 1, 2""")
def namespace_stats(t):
    docs = t("documents").select(F.when(F.col("lang") == "en", "Person").when(F.col("lang") == "de", "Family").otherwise("Article").alias("Namespace"))
    return S.namespace_stats(docs)


@query("SELECT count(*) AS total FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')")
def stats_total(t):
    docs = t("documents").select(F.when(F.col("lang") == "en", "Person").when(F.col("lang") == "de", "Family").otherwise("Article").alias("Namespace"))
    return S.namespace_stats(docs).agg(F.sum("count").alias("total"))


@query("SELECT count(*) AS count FROM documents WHERE source = 'src3'")
def watchlist_count(t):
    docs = t("documents").select(F.array("source").alias("User"))
    return docs.where(Compiler(docs).match(Term("User", "src3"))).agg(F.count(F.lit(1)).alias("count"))


DATE = "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y') END"


@query(f"SELECT o_orderkey AS PageId, CASE x WHEN '19960102' THEN 1.0 WHEN '199601' THEN 0.6 ELSE 0.4 END::double AS score FROM (SELECT o_orderkey, {DATE} AS x FROM orders) WHERE x IN ('19960102', '199601', '1996')")
def date_widen_score(t):
    """A full date also finds its month and its year, for less."""
    o = t("orders")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    x = F.when(F.col("o_orderkey") % 3 == 0, day).when(F.col("o_orderkey") % 3 == 1, F.substring(day, 1, 6)).otherwise(F.substring(day, 1, 4))
    return scored(t, o.select(F.col("o_orderkey").alias("PageId"), F.array(x).alias("PersonBirthDate")), 'PersonBirthDate:"2 Jan 1996"')


@query("""SELECT c_custkey AS PageId, round((greatest(CASE WHEN s = 'building' THEN 1.65 ELSE 0 END, CASE WHEN s = 'machinery' THEN 0.99 ELSE 0 END, CASE WHEN m = 'building' THEN 0.33 ELSE 0 END) + c_nationkey / 1024.0)::double, 9) AS score
FROM (SELECT c_custkey, c_nationkey, lower(c_mktsegment) AS s, CASE WHEN c_custkey % 2 = 0 THEN 'building' ELSE 'none' END AS m FROM customer) WHERE s IN ('building', 'machinery') OR m = 'building'""")
def name_expand_score(t):
    """A surname also finds related names and married names, for less."""
    docs = t("customer").select(F.col("c_custkey").alias("PageId"), F.col("c_nationkey").alias("Popularity"), F.array(F.lower("c_mktsegment")).alias("PersonSurname"), F.array(F.when(F.col("c_custkey") % 2 == 0, "building").otherwise("none")).alias("PersonMarriedName"))
    return scored(t, docs, "PersonSurname:building", Options(related_names=lambda n, s: ["machinery"]))


@query("SELECT doc_id AS PageId, CASE WHEN doc_id % 3 = 0 OR (doc_id % 3 = 1 AND lang = 'en') THEN 1.65 ELSE 0.8 END::double AS score FROM documents WHERE source = 'src1' AND (doc_id % 3 = 0 OR lang = 'en')")
def virtual_field_score(t):
    """Surname asks all surname fields and takes the best; another clause may add to it."""
    n = F.regexp_replace("source", "[0-9]", "")
    s = F.concat(n, F.translate(F.regexp_replace("source", "[a-z]", ""), "0123456789", "abcdefghij"))
    english = F.col("lang") == "en"
    field = lambda c, v: F.array_compact(F.array(F.when(c, v)))
    docs = t("documents").select(F.col("doc_id").alias("PageId"), field(F.col("doc_id") % 3 == 0, s).alias("PersonSurname"), field((F.col("doc_id") % 3 == 1) & english, s).alias("OtherSurname"), field((F.col("doc_id") % 3 == 2) & english, F.concat(s, F.lit("x"))).alias("WifeSurname"), field((F.col("doc_id") % 3 == 2) & english, s).alias("Other"))
    return scored(t, docs, "Surname:srcb Other:srcb^0.8")


@query("""WITH c AS (SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey AS PageId, CASE WHEN n_name = 'NATION_6' AND c_custkey % 2 = 0 THEN 0.5 ELSE 0.2 END::double AS score FROM c WHERE (n_name = 'NATION_6' AND c_custkey % 2 = 0) OR (r_name = 'AMERICA' AND c_custkey % 2 = 1)""")
def place_level_boost(t):
    """A place finds its documents and, for less, those filed at exactly a wider place."""
    filed = F.when(F.col("c_custkey") % 2 == 0, F.concat("r_name", F.lit(","), "n_name")).otherwise(F.concat("r_name", F.lit(",(no subordinate)")))
    docs = t("customer").join(place_paths(t), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("PageId"), place.ancestors(F.lower(filed)).alias("PersonBirthPlace"))
    return scored(t, docs, 'PersonBirthPlace:"NATION_6, AMERICA"', Options(match_places=lambda x: ["NATION_6, AMERICA"]))


@query("""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\\pL\\pN]+|[^\\pL\\pN]+'), lambda x: CASE WHEN lower(x) IN ('the', 'of', 'onth') THEN '<b>' || x || '</b>' ELSE x END), '') AS marked
FROM documents WHERE len(list_filter(regexp_extract_all(text, '[\\pL\\pN]+'), lambda x: lower(x) IN ('the', 'of', 'onth'))) > 0""")
def highlight_terms(t):
    """Whole texts with the words marked."""
    return t("documents").select("doc_id", S.highlighted(F.col("text"), ["the", "of", "onth"]).alias("marked")).where("marked is not null")


@query("SELECT conv_id, left(string_agg(text, '; ' ORDER BY turn), 80) AS shown FROM conversations GROUP BY 1")
def alternate_text(t):
    c = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("v"))
    return c.select("conv_id", S.alternate_text(F.col("v"), 80).alias("shown"))


@query("SELECT '*[[' || n_name || ']] ' || r_name AS line FROM nation JOIN region ON n_regionkey = r_regionkey")
def wikilist_lines(t):
    return S.wiki_lines(place_paths(t), F.col("n_name"), [F.col("r_name")])


@query("SELECT (i - 1)::int AS position, string_split('a|' || r_name || '|', '|')[i] AS q FROM region, unnest([1, 2, 3]) u(i)")
def batch_split(t):
    r = t("region").select("r_regionkey", F.concat(F.lit("a|"), "r_name", F.lit("|")).alias("q"))
    each = S.batch_split(r.select(F.concat("r_regionkey", F.lit("#"), "q").alias("q")))
    return each.withColumn("q", F.regexp_replace("q", "^[0-9]+#", ""))


def on_disk(docs, fields=("Title", "Keywords"), impact=None):
    """docs' postings, written below the shared folder and read back."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/postings-{uuid.uuid4().hex}"
    P.write(docs, path, fields, impact=impact)
    return P.read(docs.sparkSession, path)


@query(f"{D}, w AS (SELECT PageId, unnest(k) AS term, generate_subscripts(k, 1) - 1 AS position FROM d) SELECT term, PageId, count(*)::int AS frequency, min(position)::int AS first, max(position)::int AS last FROM w GROUP BY 1, 2")
def postings_positions(t):
    """All postings of the texts' words."""
    p = on_disk(indexed(t)).where("field = 'Keywords'")
    return p.select("term", "PageId", F.size("positions").alias("frequency"), F.array_min("positions").alias("first"), F.array_max("positions").alias("last"))


@query(KEYWORD_SQL)
def postings_keyword_search(t):
    """The flagship, answered from postings."""
    docs = indexed(t)
    return S.search(docs, 'reed "onth re"', postings=on_disk(docs)).docs.select("PageId", F.round("score", 6).alias("score"))


@query(f"{D} SELECT PageId FROM d WHERE list_contains(k, 'reed') AND NOT list_contains(k, 'una') AND len(list_filter(k, lambda x: x LIKE 'th%ing_s' OR starts_with(x, 'tionth'))) > 0")
def postings_bool_wildcard(t):
    docs = indexed(t)
    return S.search(docs, "+reed -una +(th*ing?s tionth*)", Options(exact=True), postings=on_disk(docs)).matched.select("PageId")


@query(f"{D} SELECT value, count(*) AS count FROM (SELECT unnest(list_distinct(k)) AS value FROM d WHERE list_contains(k, 'reed')) GROUP BY 1")
def postings_facet(t):
    """Documents per word, of those that hold a word."""
    docs = indexed(t)
    p = on_disk(docs)
    return P.facet(p, "Keywords", S.search(docs, "reed", Options(exact=True), postings=p).matched)


@query(f"{D} SELECT count(*) AS hits, round(max(CASE WHEN list_contains(k[1:5], 'reed') THEN 1.0 ELSE 0.5 END + Popularity / 1024.0)::double, 9) AS best FROM d WHERE list_contains(k, 'reed')")
def postings_hits(t):
    docs = indexed(t)
    return S.search(docs, "reed", postings=on_disk(docs)).summary.select("hits", F.round("best", 9).alias("best"))


@query(f"{D} SELECT PageId, (list_contains(k[1:5], 'the'))::int + 1.0::double AS score FROM d WHERE list_contains(k, 'reed') AND NOT list_contains(k[1:5], 'and')")
def postings_some_fields(t):
    """Words looked up in postings, titles in the documents' arrays, as only words were written."""
    docs = indexed(t)
    tree = Bool(((MUST, Term("Keywords", "reed")), (SHOULD, Term("Title", "the")), (MUST_NOT, Term("Title", "and"))))
    p = on_disk(docs, ("Keywords",))
    look = P.Lookup(docs, tree, P.written_fields(p))
    return look.joined(docs, p).where(look.match(tree)).select("PageId", look.score(tree).alias("score"))


@query(KEYWORD_SQL)
def best_k_search(t):
    """The flagship, whose documents below the impact that the tenth needs aren't scored."""
    docs = indexed(t)
    return search_best(docs, on_disk(docs, impact="Popularity"), 'reed "onth re"').select("PageId", F.round("score", 6).alias("score"))


def dictionary(t):
    """A dictionary of the documents' words, written below the shared folder."""
    docs = indexed(t).select("PageId", "Keywords")
    return Terms(docs.sparkSession, f"{shared_dir(docs.sparkSession).rstrip('/')}/terms-{uuid.uuid4().hex}").write(P.held(docs, ("Keywords",)))


WORDS = f"{D}, w AS (SELECT DISTINCT PageId, unnest(k) AS term FROM d), v AS (SELECT term, count(*) AS documents FROM w GROUP BY 1)"


@query(f"{WORDS} SELECT term, documents FROM v WHERE term LIKE '%tion_n'")
def leading_wildcard_terms(t):
    """Words of a pattern that begins with a star, found by their pieces."""
    return dictionary(t).matching(Wildcard("Keywords", "*tion?n"))


@query(f"{WORDS} SELECT term, documents FROM v WHERE starts_with(term, 't') ORDER BY documents DESC, term LIMIT 50")
def term_completions(t):
    """The fifty words of most documents that begin with a letter."""
    return dictionary(t).completed("Keywords", "t", 50)


@query(f"{WORDS}, a AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS asked FROM part), l AS (SELECT asked, term, levenshtein(asked, term) AS e, least(length(asked), length(term)) AS m FROM a, v) SELECT asked, term FROM l WHERE 1 - e / m > 0.65")
def similar_terms(t):
    """All words of the documents that are similar to a word of the parts' names."""
    words = dictionary(t)
    asked = t("part").select(F.explode(text.tokens("p_name")).alias("asked"))
    return similar(asked, words.grams(), words.terms()).select("asked", "term")


def stem_sql(words: str) -> str:
    first, *rest = stem.sql("term")
    out = f"SELECT term, {first} AS x FROM ({words})"
    for step in rest:
        out = f"SELECT term, {step} AS x FROM ({out})"
    return out


PROTECTED = ("reading", "ties")


@query(f"{WORDS} SELECT term, CASE WHEN term IN {PROTECTED} OR NOT regexp_matches(term, '^[a-z]{{3,}}$') THEN term ELSE x END AS stem FROM ({stem_sql('SELECT term FROM v')})")
def stemmed_words(t):
    """Every word of the documents with its stem; protected words stay."""
    words = indexed(t).select(F.explode("Keywords").alias("term")).distinct()
    run = analysis.make("text", stop=False, stem="english", protected=PROTECTED)
    return words.select("term", F.get(run(F.col("term")), 0).alias("stem"))


MARK = r"regexp_replace(p, '\b(the|of|and|ioning)\b', '<b>\1</b>', 'gi')"


@query(rf"""WITH p AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)(.{{1,60}}\S*)\s*', 1) AS x FROM documents WHERE lang = 'en')),
s AS (SELECT doc_id, i, p, len(list_distinct(list_transform(regexp_extract_all(p, '(?i)\b(the|of|and|ioning)\b', 1), lambda w: lower(w)))) AS n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM s WHERE n > 0)
SELECT doc_id, string_agg({MARK}, ' ... ' ORDER BY r) AS best FROM r WHERE r <= 2 GROUP BY 1""")
def best_fragment_terms(t):
    """The two pieces of each English text that hold the most different ones of four words, marked."""
    d = t("documents").where("lang = 'en'").select("doc_id", S.best_fragments(F.col("text"), ["the", "of", "and", "ioning"], 60, 2).alias("f"))
    return d.where("f is not null").select("doc_id", F.array_join("f", " ... ").alias("best"))


@query("SELECT p_partkey, replace(replace(p_name, 'i', '<b>i</b>'), '</b><b>', '') AS marked FROM part WHERE contains(p_name, 'i')")
def marked_by_offsets(t):
    """Single letters marked by their places, given last first and with overlaps."""
    at = F.filter(F.transform(F.sequence(F.length("p_name"), F.lit(1), F.lit(-1)), lambda i: F.struct((i - 1).alias("start"), i.alias("end"))), lambda s: F.substr("p_name", s["end"], F.lit(1)) == "i")
    spans = F.concat(at, at)
    return t("part").select("p_partkey", S.marked_spans(F.col("p_name"), spans).alias("marked")).where("marked is not null")
