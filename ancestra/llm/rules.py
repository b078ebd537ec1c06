"""Quality rules: a table of thresholds, compiled into one projection over measures of each text.

All of it is DataFrame functions. Words are what lies between ASCII white space, lines what
lies between line feeds; measures are whole numbers, and so are the thresholds (thousandths
of a ratio), so that no rule depends on rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"

#: Frequent words of the four languages; as they are and with a capital.
STOP_WORDS = (
    "the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "was", "on", "with", "be", "as", "by", "are", "this", "at",
    "der", "die", "und", "den", "von", "zu", "das", "sich", "mit", "auf", "des", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "en", "un", "une", "du", "que", "pour", "est", "qui", "dans", "par", "pas", "au", "sur",
    "el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al",
)


@dataclass(frozen=True)
class Rule:
    """A text fails if 1000 * num < low * den or 1000 * num > high * den; den None counts as 1."""

    name: str
    num: str
    den: str | None = None
    low: int | None = None
    high: int | None = None


#: Rules that every text must pass before the others count.
BASE = (
    Rule("few_words", "n_words", None, low=50_000),
    Rule("repeated_words", "n_repeat_words", "n_words", high=500),
)
#: The threshold table.
TABLE = (
    Rule("word_length", "word_chars", "n_words", low=3_000, high=10_000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("stop_words", "n_stop_words", "n_words", low=20),
    Rule("alphabetic_words", "n_alpha_words", "n_words", low=700),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=900),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=300),
)


def measures(text: Column) -> list[dict[str, Column]]:
    """The measures of a text as expressions, in steps: each step reads the columns of those before it."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.coalesce(trimmed, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    from_word = lambda i: F.slice("words_", i, F.greatest(F.size("words_") - 2, F.lit(0)))
    # All windows of three words with their place, sorted, so that equal ones are neighbours.
    windows = F.sort_array(F.arrays_zip(from_word(1).alias("a"), from_word(2).alias("b"), from_word(3).alias("c"), F.when(F.size("words_") > 2, F.sequence(F.lit(0), F.size("words_") - 3)).otherwise(F.array().cast("array<int>")).alias("i")))
    ahead = lambda i: F.slice("windows_", i, F.greatest(F.size("windows_") - 1, F.lit(0)))
    equal = F.filter(F.arrays_zip(ahead(1).alias("x"), ahead(2).alias("y")), lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    found = F.array_union(F.col("equal_").getField("x").getField("i"), F.col("equal_").getField("y").getField("i"))
    covered = F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2))))
    stops = [w for x in STOP_WORDS for w in (x, x[:1].upper() + x[1:])]
    count = lambda c: F.size(c).cast("long")
    return [
        {"words_": words, "lines_": lines},
        {"windows_": windows},
        {"equal_": equal},
        {
            "n_words": count("words_"),
            "word_chars": F.char_length(F.array_join("words_", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(text, F.lit(f"[{SYMBOLS}]")), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long"),
            "n_repeat_words": count(covered),
            "n_lines": count("lines_"),
            "n_stop_words": count(F.filter("words_", lambda w: w.isin(stops))),
            "n_alpha_words": count(F.filter("words_", lambda w: w.rlike(r"\p{L}"))),
            "n_bullet_lines": count(F.filter("lines_", lambda x: x.rlike(r"^\s*[-*•]"))),
            "n_ellipsis_lines": count(F.filter("lines_", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))),
        },
    ]


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_alpha_words", "n_bullet_lines", "n_ellipsis_lines")


def fails(rule: Rule) -> Column:
    """The rule as a condition over the measures."""
    num, den = F.lit(1000) * F.col(rule.num), F.col(rule.den) if rule.den else F.lit(1)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (num < F.lit(rule.low) * den)
    if rule.high is not None:
        out = out | (num > F.lit(rule.high) * den)
    return out


def judge(docs: DataFrame, text_col: str = "text", table: tuple[Rule, ...] = TABLE, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """All columns, the measures, base_failed, failed_rules and kept. Map only.

    kept: no rule of `base` or `table` is failed; failed_rules names those that are, in the
    order of the tables. Null and empty texts have no words, and all their measures are 0; a very long
    text is measured whole, its windows of words by a sort; repeated rows and ties each give
    their row. Existing columns with names of the new ones are replaced, other columns pass.
    An empty table gives none.
    """
    new = {c.lower() for c in (*MEASURES, "base_failed", "failed_rules", "kept")}
    out = docs.select(*(c for c in docs.columns if c.lower() not in new or c == text_col))
    kept = [c for c in out.columns if c.lower() not in new]
    text = unused(out, "judged_text")
    out = out.withColumn(text, F.col(text_col).cast("string")).select(*kept, text)
    steps = measures(F.col(text))
    made: list[str] = []
    for step in steps[:-1]:
        out = out.select(*out.columns, *(c.alias(name) for name, c in step.items()))
        made += step
    out = out.select(*kept, *(c.alias(name) for name, c in steps[-1].items()))
    failed = F.filter(F.array(*(F.when(fails(r), F.lit(r.name)) for r in (*base, *table))), lambda x: x.isNotNull())
    base_failed = F.lit(False)
    for r in base:
        base_failed = base_failed | fails(r)
    return out.select(*out.columns, base_failed.alias("base_failed"), failed.alias("failed_rules"), (F.size(failed) == 0).alias("kept"))


def sql(documents: str = "documents", table: tuple[Rule, ...] = TABLE, base: tuple[Rule, ...] = BASE) -> str:
    """The same rules over the same measures in DuckDB's SQL."""
    def bad(r: Rule) -> str:
        den = r.den or "1"
        return "(" + " OR ".join([f"1000 * {r.num} < {r.low} * {den}"] * (r.low is not None) + [f"1000 * {r.num} > {r.high} * {den}"] * (r.high is not None)) + ")"

    stops = ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x[:1].upper() + x[1:]))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT rid, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w),
t AS (SELECT rid, i, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM p WINDOW s AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS c FROM t WHERE z IS NOT NULL),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY rid),
m AS (SELECT doc_id, len(words)::bigint AS n_words, length(array_to_string(words, ''))::bigint AS word_chars, len(regexp_extract_all(text, '[{SYMBOLS}]'))::bigint AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words, len(lines)::bigint AS n_lines,
    len(list_filter(words, lambda x: x IN ({stops})))::bigint AS n_stop_words, len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}')))::bigint AS n_alpha_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*\x{{2022}}]')))::bigint AS n_bullet_lines, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})\s*$')))::bigint AS n_ellipsis_lines
  FROM w LEFT JOIN r USING (rid))
SELECT *, {" OR ".join(map(bad, base))} AS base_failed, NOT ({" OR ".join(map(bad, (*base, *table)))}) AS kept,
  list_filter([{", ".join(f"CASE WHEN {bad(r)} THEN '{r.name}' END" for r in (*base, *table))}], lambda x: x IS NOT NULL) AS failed_rules
FROM m
"""
