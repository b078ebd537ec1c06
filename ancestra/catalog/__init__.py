"""The registered queries: each applies an operator to the given tables, with the same result in SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ancestra import data
from ancestra.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a table reader; sql: its result from the same tables."""

    def put(f):
        key = name or f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[key] = run
        if sql:
            SQL[key] = sql
        return f

    return put


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_romanized(x: str) -> str:
    """romanize() in SQL."""
    one = {a: b for a, b in data.ROMANIZE.items() if len(b) == 1}
    out = f"translate({x}, {quoted(''.join(one))}, {quoted(''.join(one.values()))})"
    for a, b in data.ROMANIZE.items():
        if len(b) > 1:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return out


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(lower({sql_romanized(x)}), '[^a-z0-9]+'), lambda t: t <> '')"


def load() -> None:
    """Import the modules that register queries."""
    from . import feeds, kinds, pages, relational, rules, scalar, search  # noqa: F401
