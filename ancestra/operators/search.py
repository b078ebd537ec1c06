"""Search over documents: predicate and score, order and page, facets, highlights, response text."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ancestra import data
from ancestra.operators.relational import positions
from ancestra.plans.ast import Bool, Options, show
from ancestra.plans.compile import Compiler
from ancestra.plans.parser import parse
from ancestra.plans.rewrites import highlight_terms, rewritten

#: Tokens of a field that are indexed, at most.
MOST_TOKENS = 100_000
#: Stored fields of a result.
STORED = (
    "PageId", "NamespaceStored", "TitleStored", "LastModDate", "UserStored", "FullnameStored", "AltnameStored", "SurnameStored", "PlaceStored", "PrimaryImage", "PersonGender",
    "PersonBirthDateStored", "PersonChrDateStored", "PersonDeathDateStored", "PersonBurialDateStored", "PersonBirthPlaceStored", "PersonChrPlaceStored", "PersonDeathPlaceStored", "PersonBurialPlaceStored",
    "ParentFamilyTitle", "SpouseFamilyTitle", "MarriageDateStored", "MarriagePlaceStored", "BannsDateStored", "BannsPlaceStored", "ChildTitle", "SourceSubjectStored", "SourceAvailabilityStored", "AuthorStored", "LocatedInPlaceStored", "PlaceType", "Latitude", "Longitude",
)


@dataclass
class Result:
    """A search's frames: all are lazy. docs: a page of scored documents; matched: all matching ones; summary: one row (hits, best), how many match and the highest score, null where none does."""

    docs: DataFrame
    matched: DataFrame
    facets: dict[str, DataFrame]
    tree: Bool
    highlights: dict[str, list[str]]
    place_matches: dict[str, list[str]] = field(default_factory=dict)
    summary: DataFrame | None = None

    def explain_query(self) -> str:
        return show(self.tree)


def indexed_tokens(tokens: Column, most: int = MOST_TOKENS) -> Column:
    return F.slice(tokens, 1, most)


def facet(matched: DataFrame, name: str) -> DataFrame:
    """(value, count): how many documents have each value; values without a document don't appear."""
    values = F.explode(F.array_distinct(F.col(name))) if isinstance(matched.schema[name].dataType, T.ArrayType) else F.col(name)
    return matched.select(values.alias("value")).where("value is not null").groupBy("value").count()


def namespace_stats(docs: DataFrame, name: str = "Namespace") -> DataFrame:
    """(position, namespace, count) of every main namespace, with zeros, in the list's order."""
    listed = docs.sparkSession.createDataFrame([(i, n) for i, n in enumerate(data.NAMESPACES)], "position int, namespace string")  # 18 rows
    return F.broadcast(listed).join(docs.groupBy(F.col(name).alias("n")).count(), F.col("namespace") == F.col("n"), "left").select("position", "namespace", F.coalesce("count", F.lit(0)).alias("count"))


def filtered(docs: DataFrame, filters) -> DataFrame:
    """Documents with all the (field, value) filters, which don't score."""
    for name, value in filters:
        c = F.col(name)
        docs = docs.where(F.array_contains(c, value) if isinstance(docs.schema[name].dataType, T.ArrayType) else c == value)
    return docs


def paged(df: DataFrame, order: list[Column], start: int = 0, rows: int | None = 10) -> DataFrame:
    """A page of a total order; its plan keeps start + rows rows a partition at most. rows None: all rows from `start` on.

    All rows are sorted in ranges, so that no task has them all. A start other than 0 is found by
    the rows' places, which checkpoints them.
    """
    if rows is not None:
        return df.orderBy(*order).limit(start + rows).offset(start)
    if start:
        df = positions(df, order, out="__place").where(F.col("__place") > start).drop("__place")
    return df.hint("rebalance").orderBy(*order)  # a sort reads its rows twice, and from the exchange they aren't made anew


def search(docs: DataFrame, query: str, options: Options | None = None, start: int = 0, rows: int | None = 10, facets: tuple[str, ...] = (), key: str = "PageId", postings: DataFrame | None = None) -> Result:
    """Parse, rewrite and run a query; order by score (or the sort field) and then by key. rows None: all that match, from `start` on.

    With postings (operators.postings) the terms are looked up there, and the documents' arrays of terms aren't read.
    """
    o = options or Options()
    asked = parse(query, o)
    tree = rewritten(asked, o)
    if postings is None:
        compiler = Compiler(docs)
    else:
        from ancestra.operators.postings import Lookup, written_fields

        compiler = Lookup(docs, tree, written_fields(postings), key)
        docs = compiler.joined(docs, postings)
    matched = filtered(docs, o.filters).where(compiler.match(tree))
    scored = matched.withColumn("score", compiler.score(tree))
    if postings is not None:
        matched, scored = compiler.stripped(matched), compiler.stripped(scored)
    order = [F.col(o.sort), F.col(key)] if o.sort else [F.desc("score"), F.col(key)]
    return Result(paged(scored, order, start, rows), matched, {f: facet(matched, f) for f in facets}, tree, highlight_terms(asked), o.place_matches, scored.agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best")))


def highlighted(c: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """Text with its occurrences of whole words marked, ignoring case; null where there are none."""
    import re

    if not words:
        return F.lit(None).cast("string")
    found = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    return F.when(c.rlike(found), F.regexp_replace(c, found, f"{before}$1{after}"))


def fragments(c: Column, words: list[str], size: int = 100, most: int = 1) -> Column:
    """The first `most` pieces of about `size` characters that hold a marked word; all of the text where size is 0."""
    if not size:
        return F.when(highlighted(c, words).isNotNull(), F.array(highlighted(c, words)))
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{size}}}\S*)\s*"), F.lit(1))
    marked = F.filter(F.transform(pieces, lambda x: highlighted(x, words)), lambda x: x.isNotNull())
    return F.when(F.size(marked) > 0, F.slice(marked, 1, most))


def best_fragments(c: Column, words: list[str], size: int = 100, most: int = 1) -> Column:
    """The `most` pieces of about `size` characters that hold the most different words, best first, ties in the order of the text; marked."""
    import re

    if not words:
        return F.lit(None).cast("array<string>")
    pieces = F.regexp_extract_all(c, F.lit(rf"(?s)(.{{1,{size}}}\S*)\s*"), F.lit(1))
    any_word = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
    held = lambda x: F.size(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(any_word), F.lit(1)), F.lower)))
    ranked = F.array_sort(F.transform(pieces, lambda x, i: F.struct((-held(x)).alias("score"), i.alias("at"), x.alias("piece"))))
    best = F.slice(F.filter(ranked, lambda r: r["score"] < 0), 1, most)
    return F.when(F.size(best) > 0, F.transform(best, lambda r: highlighted(r["piece"], words)))


def marked_spans(c: Column, spans: Column, before: str = "<b>", after: str = "</b>") -> Column:
    """Text with spans (start, end, ...) marked, whatever their order; spans that overlap are one. Null without spans.

    Analyzers that add tokens give them out of order; all are put in the order of their starts, which is at least
    what a bounded window does.
    """
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    reach = lambda s, i: F.array_max(F.transform(F.slice(s, 1, i), lambda x: x["end"]))

    def joined(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["start"] >= reach(s, i)), i)), lambda i: i.isNotNull())
        return bound(starts, lambda at: F.transform(at, lambda i, j: F.struct(s[i]["start"].alias("start"), reach(s, F.coalesce(F.get(at, j + 1), F.size(s))).alias("end"))))

    def text_of(s: Column) -> Column:
        piece = lambda x, i: F.concat(F.substr(c, F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"]) + 1, x["start"] - F.when(i == 0, 0).otherwise(F.get(s, i - 1)["end"])), F.lit(before), F.substr(c, x["start"] + 1, x["end"] - x["start"]), F.lit(after))
        return F.concat(F.array_join(F.transform(s, piece), ""), F.substr(c, F.element_at(s, -1)["end"] + 1))

    return F.when(F.size(spans) > 0, bound(bound(ordered, joined), text_of))


def joined_values(c: Column, separator: str = "; ") -> Column:
    """The values of a repeated field as one text."""
    return F.array_join(c, separator)


def alternate_text(c: Column, length: int, separator: str = "; ") -> Column:
    """What is shown of a field without a highlight: its values joined and cut."""
    return F.substring(joined_values(c, separator), 1, length)


def with_highlights(docs: DataFrame, words: dict[str, list[str]], sizes: dict[str, int] | None = None, alternate: int = 0) -> DataFrame:
    """docs with hl_<field> columns, for the fields of `words` that docs has."""
    sizes = sizes or {"UserStored": 100, "TextStored": 100}
    for name in (n for n in words if n in docs.columns):
        many = isinstance(docs.schema[name].dataType, T.ArrayType)
        c = joined_values(F.col(name)) if many else F.col(name)
        out = F.array_join(fragments(c, words[name], sizes.get(name, 0)), " ")
        docs = docs.withColumn(f"hl_{name}", F.coalesce(out, F.substring(c, 1, alternate)) if alternate else out)
    return docs


def wiki_lines(docs: DataFrame, title: Column, details: list[Column]) -> DataFrame:
    """A line of wiki text for each result."""
    return docs.select(F.concat(F.lit("*[["), title, F.lit("]]"), *[F.concat(F.lit(" "), F.coalesce(d, F.lit(""))) for d in details]).alias("line"))


def wiki_header(result: Result, label: str = "Search results") -> DataFrame:
    """The line above wiki_lines(): what follows, and how many documents match in all."""
    return result.summary.select(F.concat(F.lit(f"{label} ("), "hits", F.lit(" documents)")).alias("line"))


def to_json_lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.to_json(F.struct(*docs.columns)).alias("line"))


def batch_split(requests: DataFrame, column: str = "q") -> DataFrame:
    """One row per request of a batch: (position, q), the batch split on bars."""
    return requests.select(F.posexplode(F.split(F.col(column), r"\|", -1)).alias("position", "q"))
