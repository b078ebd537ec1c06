"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontam, embeddings, lm, periods, quality, rules, simhash, tokencounts, urls, warc
from .common import fresh_path, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance resampling of all documents against the labelled good ones."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words in all documents."""
    found = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_chat_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotation links and threads of all conversations, in reply order."""
    return chat.reply_ordered(chat.link_quotes(table(spark, sf_dir, "conversations")))


def chat_quoted_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every message but each third quotes the one before it, whole or from its second sentence on, and every third the two before it, nested."""
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = lambda c: F.regexp_replace(c, r"\. ", ".\n")
    t = table(spark, sf_dir, "conversations").withColumn("text", lines(F.col("text")))
    t = t.withColumns({"one": F.lag("text").over(at), "two": F.lag("text", 2).over(at)})
    t = t.withColumn("some", F.when((F.col("turn") % 2 == 0) & F.contains("one", F.lit("\n")), F.substr("one", F.instr("one", "\n") + 1)).otherwise(F.col("one")))
    marked = lambda c, mark: F.concat(F.lit(mark), F.regexp_replace(c, "\n", "\n" + mark), F.lit("\n"))
    nested = F.concat(marked(F.col("two"), ">> "), marked(F.col("one"), "> "), F.col("text"))
    said = F.when(F.col("turn") % 3 == 1, F.concat(marked(F.col("some"), "> "), F.col("text"))).when(F.col("turn") % 3 == 2, nested)
    return chat.reply_ordered(chat.link_quotes(t.withColumn("text", F.coalesce(said, "text"))))


#: Fixed by the query's contract.
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, else by trees that learn from the URLs of labelled documents."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.labelled_by_document(pages, table(spark, sf_dir, "labels")), URL_RULES)


def op5_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints at 2 or fewer differing bits over all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on six sevenths of the documents and score all."""
    return lm.train_and_score(table(spark, sf_dir, "documents"), fresh_path(spark, "lm"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more among all embeddings of a label."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents, with the ranks of the 50k byte-level vocabulary."""
    ranks = tokencounts.parse_ranks(bpe.read_text(spark, tokencounts.default_ranks_path()))
    return tokencounts.count_tokens(table(spark, sf_dir, "documents"), tokencounts.zipf_scores(ranks))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page to WARC archives in the shared folder and read them back."""
    return warc.round_trip(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the 50k byte-level vocabulary."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), bpe.read_text(spark, bpe.default_path()))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in all documents, a tenth of which repeat a part of themselves."""
    docs = periods.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return periods.digest(periods.mark_runs(docs))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language over all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold table over all documents."""
    found = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *rules.MEASURES, "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_decontamination": op2_decontamination,
    "op3_chat_quotes": op3_chat_quotes,
    "op4_url_filter": op4_url_filter,
    "op5_simhash_neardup": op5_simhash_neardup,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_embedding_neardup": op7_embedding_neardup,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
    "chat_quoted_threads": chat_quoted_threads,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::varchar[])"

ORACLE_SQL: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wi AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
h AS (SELECT dp.doc_id, dp.p, wi.n, wi.item_id
      FROM (SELECT doc_id, p, m.n, array_to_string(w[p:p + m.n - 1], ' ') AS k FROM dp, (SELECT DISTINCT n FROM wi) m WHERE p + m.n - 1 <= len(w)) dp
      JOIN wi ON wi.k = dp.k AND wi.n = dp.n),
hw AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(s, ',' ORDER BY s)) AS items_sha256
       FROM (SELECT DISTINCT doc_id, item_id::varchar AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
SELECT p.page_id, octet_length(encode(p.h))::bigint AS payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(p.h), (5 * g + 1)::int, 5))::int >> (15 - 5 * c)::int) & 31) + 1)::int, 1)), '')), '') AS payload_digest,
       CASE WHEN p.page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id IS NOT DISTINCT FROM m THEN NULL ELSE m END AS refers_to
FROM p JOIN g ON p.h = g.h
""",
    "op7_embedding_neardup": """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::double[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) >= 0.98),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::bigint AS n_links, least(vec_id, coalesce(c.b, vec_id)) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(c.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id
""",
    "op3_chat_quotes": r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS rid, conv_id, turn, role, text, coalesce(regexp_matches(text, '(^|\n)[ \t]*>'), false) AS q FROM conversations),
l AS (SELECT rid, conv_id, turn, i, string_split_regex(text, '\r?\n')[i] AS line FROM (SELECT *, unnest(range(1, len(string_split_regex(text, '\r?\n')) + 1)) AS i FROM m WHERE q)),
k AS (SELECT rid, conv_id, turn, i, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)+)', 1), '[^>]', '', 'g')) AS level, line, regexp_replace(line, '^((?:[ \t]*>)+)[ \t]?', '') AS content FROM l),
o AS (SELECT rid, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS own FROM k WHERE level = 0 GROUP BY rid),
b AS (SELECT m.rid, m.conv_id, m.turn, m.role, m.q, CASE WHEN m.q THEN coalesce(o.own, '') ELSE m.text END AS own FROM m LEFT JOIN o USING (rid)),
g AS (SELECT *, sum(CASE WHEN level IS NOT DISTINCT FROM was THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM (SELECT *, lag(level) OVER (PARTITION BY rid ORDER BY i) AS was FROM k)),
p AS (SELECT * FROM (SELECT rid, conv_id, turn, level, trim(regexp_replace(lower(string_agg(content, chr(10) ORDER BY i)), '\s+', ' ', 'g')) AS n FROM g WHERE level > 0 GROUP BY rid, conv_id, turn, run, level) WHERE n <> ''),
u AS (SELECT conv_id, turn, trim(regexp_replace(lower(unnest(list_concat([own], string_split_regex(own, '\r?\n[ \t]*\r?\n'), string_split_regex(own, '\r?\n')))), '\s+', ' ', 'g')) AS n FROM b WHERE turn IS NOT NULL AND own IS NOT NULL),
nl AS (SELECT rid, conv_id, turn, list_filter(list_transform(string_split_regex(own, '\r?\n'), lambda x: trim(regexp_replace(lower(x), '\s+', ' ', 'g'))), lambda x: x <> '') AS ls FROM b
  WHERE turn IS NOT NULL AND own IS NOT NULL AND conv_id IN (SELECT conv_id FROM p)),
w AS (SELECT conv_id, turn, array_to_string(ls[i:k], ' ') AS n FROM (SELECT conv_id, turn, ls, i, unnest(range(i, len(ls) + 1)) AS k FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM nl))
  UNION ALL SELECT conv_id, turn, trim(regexp_replace(lower(unnest(string_split_regex(text, '(?m)^[ \t]*>[^\n]*(?:\n|\z)'))), '\s+', ' ', 'g')) FROM m WHERE turn IS NOT NULL AND text IS NOT NULL
  UNION ALL SELECT conv_id, turn, n FROM u),
f AS (SELECT conv_id, n, min(turn) AS found FROM w WHERE n <> '' GROUP BY 1, 2),
j AS (SELECT p.*, f.found FROM p LEFT JOIN f ON f.conv_id = p.conv_id AND f.n = p.n AND f.found < p.turn),
c AS (SELECT rid, conv_id, turn, count(*) AS n_quotes, count(found) AS n_linked, max(level) AS quote_level, (min((level, -found)) FILTER (WHERE found IS NOT NULL))[2] AS neg FROM j GROUP BY 1, 2, 3),
e AS (SELECT conv_id, turn, min(-neg) AS parent FROM c WHERE neg IS NOT NULL GROUP BY 1, 2),
r(conv_id, turn, thread, depth) AS (SELECT conv_id, turn, parent, 1 FROM e UNION ALL SELECT r.conv_id, r.turn, e.parent, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.thread),
t AS (SELECT conv_id, turn, arg_max(thread, depth) AS thread, max(depth) AS depth FROM r GROUP BY 1, 2)
SELECT b.conv_id, b.turn, b.role, b.own AS text, -c.neg AS parent_turn, CASE WHEN c.neg IS NULL THEN b.turn ELSE coalesce(t.thread, -c.neg) END AS thread_turn,
       CASE WHEN c.neg IS NULL THEN 0 ELSE 1 + coalesce(t.depth, 0) END::bigint AS depth, coalesce(c.n_quotes, 0)::bigint AS n_quotes, coalesce(c.n_linked, 0)::bigint AS n_linked, coalesce(c.quote_level, 0)::int AS quote_level,
       CASE WHEN b.conv_id IS NOT NULL AND b.turn IS NOT NULL THEN dense_rank() OVER (PARTITION BY b.conv_id ORDER BY CASE WHEN c.neg IS NULL THEN b.turn ELSE coalesce(t.thread, -c.neg) END, b.turn) END::bigint AS position
FROM b LEFT JOIN c USING (rid) LEFT JOIN t ON t.conv_id = b.conv_id AND t.turn = -c.neg
""",
}

ORACLE_SQL["op12_collocations"] = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
p AS (SELECT pid, lang, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
s AS (SELECT lang, x AS x1, lead(x) OVER o AS x2, lead(x, 2) OVER o AS x3, lead(x, 3) OVER o AS x4 FROM p WINDOW o AS (PARTITION BY pid ORDER BY i)),
e AS (SELECT lang, 1 AS k, x1 AS phrase FROM s UNION ALL SELECT lang, 2, x1 || ' ' || x2 FROM s WHERE x2 IS NOT NULL
  UNION ALL SELECT lang, 3, x1 || ' ' || x2 || ' ' || x3 FROM s WHERE x3 IS NOT NULL UNION ALL SELECT lang, 4, x1 || ' ' || x2 || ' ' || x3 || ' ' || x4 FROM s WHERE x4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM e GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
u AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
o AS MATERIALIZED (SELECT lang, phrase, f FROM f WHERE f >= 30),
z AS (SELECT u.lang, u.phrase, u.a, u.j, l.f AS l, r.f AS r, ((2000000::hugeint * u.a) // (l.f + r.f))::bigint AS score FROM u
  JOIN o l ON l.lang = u.lang AND l.phrase = u.head JOIN o r ON r.lang = u.lang AND r.phrase = u.tail),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, a AS longer, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, a, ws, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
x AS (SELECT lang, phrase, max(longer) AS longer FROM h GROUP BY ALL)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, n.n, b.score FROM b JOIN n USING (lang)
  WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100::hugeint * x.longer >= 80::hugeint * b.a))
WHERE rank <= 2000
"""

ORACLE_SQL["op13_quality_rules"] = f"SELECT * REPLACE (array_to_string(failed_rules, ',') AS failed_rules) FROM ({rules.sql()})"

ORACLE_SQL["chat_quoted_threads"] = ORACLE_SQL["op3_chat_quotes"].replace("FROM conversations", """FROM (
  SELECT conv_id, turn, role, coalesce(CASE turn % 3 WHEN 1 THEN '> ' || replace(part, chr(10), chr(10) || '> ') || chr(10) || text
    WHEN 2 THEN '>> ' || replace(two, chr(10), chr(10) || '>> ') || chr(10) || '> ' || replace(one, chr(10), chr(10) || '> ') || chr(10) || text END, text) AS text
  FROM (SELECT *, CASE WHEN turn % 2 = 0 AND contains(one, chr(10)) THEN substr(one, instr(one, chr(10)) + 1) ELSE one END AS part
    FROM (SELECT *, lag(text) OVER a AS one, lag(text, 2) OVER a AS two FROM (SELECT conv_id, turn, role, replace(text, '. ', '.' || chr(10)) AS text FROM conversations) WINDOW a AS (PARTITION BY conv_id ORDER BY turn, role, text))))""", 1)
