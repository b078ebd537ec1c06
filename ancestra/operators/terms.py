"""A dictionary of the index's terms, for patterns, completions and similar terms.

dictionary() has each term of a field once; grams() has its pieces of two and three letters, with
marks at its ends. Both are sorted files, a folder a field, so that a lookup reads the row
groups of a few pieces, not all terms; Parquet stores sorted terms by what differs from the one
before. What a lookup gives is tested on each term, so the pieces never decide alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ancestra.plans.ast import Fuzzy, Prefix, Query, Wildcard
from ancestra.plans.compile import Compiler

START, END = "\x02", "\x03"
#: Terms of one lookup that are named in the scan of postings; more are joined.
NAMED = 1000


def dictionary(postings: DataFrame) -> DataFrame:
    """(field, term, documents) of a table of postings, or of postings.held(), which needs neither places nor order."""
    return postings.groupBy("field", "term").agg(F.count(F.lit(1)).alias("documents")).repartitionByRange("field", "term").sortWithinPartitions("field", "term")


def pieces(term: Column, n: int) -> Column:
    """(gram, nth) of a term's pieces of n letters with the marks of its ends; nth counts equal ones, so that pieces of two terms can be matched one to one."""
    bound = lambda value, body: F.transform(F.array(value), body)[0]
    marked = F.concat(F.lit(START), term, F.lit(END))

    def each(m: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(m) - n + 1, F.lit(1))), lambda i: F.substring(m, i, n))
        once = lambda g: F.transform(g, lambda x: F.struct(x.alias("gram"), F.lit(1).alias("nth")))
        counted = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("gram"), F.size(F.filter(F.slice(g, F.lit(1), i + 1), lambda y: y == x)).alias("nth")))
        return bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), once(g)).otherwise(counted(g)))  # few terms have a piece twice, and only they are compared piece by piece

    return bound(marked, each)


def grams(terms: DataFrame) -> DataFrame:
    """(field, gram, nth, length, term) of a dictionary, in that order; pieces of two letters and of three."""
    each = terms.select("field", "term", F.length("term").alias("length"), F.explode(F.concat(pieces(F.col("term"), 2), pieces(F.col("term"), 3))).alias("g"))
    return each.select("field", "g.gram", "g.nth", "length", "term").repartitionByRange("field", "gram", "length", "term").sortWithinPartitions("field", "gram", "length", "term")


class Terms:
    """A dictionary and its pieces below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, postings: DataFrame) -> Terms:
        out = lambda df, name: df.write.mode("overwrite").option("parquet.writer.version", "v2").option("parquet.enable.dictionary#term", "false").partitionBy("field").parquet(f"{self.path}/{name}")
        out(dictionary(postings), "terms")
        out(grams(self.terms()), "grams")
        return self

    def terms(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms")

    def grams(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/grams")

    def matching(self, q: Query) -> DataFrame:
        """(term, documents) of a field's terms that a leaf of single terms asks for."""
        terms = self.terms().where(F.col("field") == q.field)
        test = Compiler.test(q, F.col("term"))
        if isinstance(q, Wildcard):
            needed = pattern_grams(q.text)
            head = re.split(r"[*?]", q.text, maxsplit=1)[0]
            if head or not needed:  # the terms are sorted by their beginnings
                return terms.where(F.startswith("term", F.lit(head)) & test).select("term", "documents")
            some = self.grams().where((F.col("field") == q.field) & F.col("gram").isin(needed))
            known = some.groupBy("term").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(needed)).where(test)
            return terms.join(known, "term", "left_semi").select("term", "documents")
        if isinstance(q, Fuzzy):
            asked = self.spark.createDataFrame([(q.text,)], "asked string")
            return terms.join(similar(asked, self.grams().where(F.col("field") == q.field), terms, q.least), "term", "left_semi").select("term", "documents")
        return terms.where(test).select("term", "documents")

    def completed(self, field: str, begun: str, most: int = 100) -> DataFrame:
        """The terms that go on from a beginning of any length, those of the most documents first."""
        return self.matching(Prefix(field, begun)).orderBy(F.desc("documents"), "term").limit(most)

    def named(self, q: Query) -> list[str] | DataFrame:
        """The terms that a leaf asks for: a list if they are few, else a table to join."""
        found = self.matching(q).select("term")
        few = [r.term for r in found.limit(NAMED + 1).collect()]
        return sorted(few) if len(few) <= NAMED else found


def pattern_grams(pattern: str) -> list[str]:
    """The pieces that every term of a pattern with * and ? must have: of three letters, of two where a literal part has no more; none for a part of one."""
    out: dict[str, None] = {}
    for part in re.split(r"[*?]", START + pattern + END):
        if len(part) >= 2 and part not in (START, END):
            n = min(3, len(part))
            out.update(dict.fromkeys(part[i : i + n] for i in range(len(part) - n + 1)))
    return list(out)


def most_edits(shorter: Column, least: float) -> Column:
    """The most edits d with 1 - d / shorter > least."""
    return F.greatest(F.ceil(F.round((F.lit(1.0) - F.lit(least)) * shorter, 9)) - 1, F.lit(0)).cast("int")


def similar(asked: DataFrame, grams: DataFrame, terms: DataFrame, least: float = 0.65) -> DataFrame:
    """(asked, term, similarity) of terms with 1 - edits / shorter length > least. asked: (asked); grams and terms of one field.

    d edits change 2 d pieces of two letters at most, so two terms share at least the longer
    length + 1 - 2 d of them. Where that is over none, candidates are the terms that share
    so many, found by a join on pieces within the bounds of lengths; for other asked terms (only where least
    is under a half) all terms of fitting lengths are compared.
    """
    words = asked.select("asked").where("asked is not null and asked <> ''").distinct().withColumn("asked_length", F.length("asked"))
    shorter, longer = F.least("asked_length", "length"), F.greatest("asked_length", "length")
    edits = most_edits(shorter, least)
    similarity = Compiler.similarity_of(F.col("term"), F.col("asked"))
    fits = longer - shorter <= edits
    if least >= 0.5:
        g = words.select("asked", "asked_length", F.explode(pieces(F.col("asked"), 2)).alias("g")).select("asked", "asked_length", F.col("g.gram").alias("asked_gram"), F.col("g.nth").alias("asked_nth"))
        pairs = g.join(grams, (F.col("asked_gram") == F.col("gram")) & (F.col("asked_nth") == F.col("nth")) & fits)
        pairs = pairs.groupBy("asked", "asked_length", "term", "length").count().where(F.col("count") >= longer + 1 - 2 * edits)
    else:
        pairs = words.join(terms.select("term", F.length("term").alias("length")), fits)
    return pairs.select("asked", "term", similarity.alias("similarity")).where(F.col("similarity") > least)
