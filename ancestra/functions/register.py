"""The functions for SQL: scalar ones as SQL functions, place services as table functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dates, names, place, text

#: SQL name -> (function of one string Column, SQL type of the result).
SCALAR = {
    "romanize": (text.romanize, "STRING"), "html_entities": (text.html_entities, "STRING"), "umlauts": (text.umlauts, "STRING"), "mixed_case": (text.mixed_case, "STRING"), "title_case": (text.title_case, "STRING"),
    "place_level_case": (text.place_level_case, "STRING"), "to_ascii": (text.to_ascii, "STRING"), "sort_key": (text.sort_key, "STRING"), "first_letter": (text.first_letter, "STRING"), "strip_markup": (text.strip_markup, "STRING"),
    "main_namespace": (text.main_namespace, "STRING"), "link_text": (text.link_text, "STRING"), "is_redirect": (text.is_redirect, "BOOLEAN"), "category_links": (text.category_links, "ARRAY<STRING>"), "index_tokens": (text.tokens, "ARRAY<STRING>"),
    "reversed_place": (place.reversed_place, "STRING"), "place_ancestors": (lambda c: place.ancestors(place.reversed_place(c)), "ARRAY<STRING>"), "cleansed_place": (place.cleansed, "STRING"), "place_lookup_text": (place.lookup_text, "STRING"), "us_state": (place.state_of, "STRING"), "parent_place": (place.parent_place, "STRING"),
    "date_tokens": (lambda c: dates.date_tokens(dates.date_words(c)), "ARRAY<STRING>"), "year_tokens": (lambda c: dates.year_tokens(dates.date_words(c)), "ARRAY<STRING>"), "century": (lambda c: dates.century_decade(c)["century"], "STRING"), "decade": (lambda c: dates.century_decade(c)["decade"], "STRING"),
    "name_tokens": (names.name_tokens, "ARRAY<STRING>"), "reversed_title": (names.reversed_title, "STRING"), "surname_index": (names.surname_index, "STRING"), "initials": (names.initials, "STRING"),
}


def body_of(spark: SparkSession, name: str) -> str:
    """The SQL text of a scalar function of a parameter x."""
    out = spark.createDataFrame([], "x string").select(SCALAR[name][0](F.col("x")).alias("result"))
    return out._jdf.queryExecution().analyzed().expressions().head().sql().removesuffix(" AS result")


def apply(name: str, df: DataFrame, column: str, out: str) -> DataFrame:
    """df with a registered function of a column."""
    return df.withColumn(out, SCALAR[name][0](F.col(column)))


class PlaceBatch:
    """A table function: rows (position, place) of a batch of places split on bars."""

    def eval(self, batch: str):
        for i, q in enumerate((batch or "").split("|")):
            yield i, q.strip()


def register(spark: SparkSession, prefix: str = "g_") -> list[str]:
    """Make all functions known to spark.sql() under the prefix, for the session; returns their names.

    Scalar functions are SQL functions whose body is the same native expression, so Catalyst
    inlines them; only the table function runs Python. Expressions with lambdas have no SQL text
    in this version of Spark; those stay functions of Columns, for apply().
    """
    made = []
    for name, (_, kind) in SCALAR.items():
        body = body_of(spark, name)
        if "lambdafunction(" not in body:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(x STRING) RETURNS {kind} RETURN {body}")
            made.append(f"{prefix}{name}")
    spark.udtf.register(f"{prefix}batch", F.udtf(PlaceBatch, returnType="position int, place string"))
    return [*made, f"{prefix}batch"]
