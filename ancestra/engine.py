"""The engine: searches an index with its places and names, and answers the services' requests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.operators import nameservice as N
from ancestra.operators import places as P
from ancestra.operators import search as S
from ancestra.plans.ast import Options


class Engine:
    """An index of documents (operators.index.build), a place table, name variants, and the index's postings (operators.postings).

    A query's places are resolved by one small job and its related names by another; the query
    then is one plan over the index.
    """

    def __init__(self, index: DataFrame, places: DataFrame | None = None, variants: DataFrame | None = None, universe: DataFrame | None = None, postings: DataFrame | None = None):
        self.index, self.variants, self.universe, self.postings = index, variants, universe, postings
        self.places = P.indexed(places) if places is not None else None

    def _request(self, text: str) -> DataFrame:
        return self.index.sparkSession.createDataFrame([(0, text)], "id int, q string")

    def match_places(self, text: str) -> list[str]:
        if self.places is None:
            return []
        row = P.matches(self._request(text), self.places).first()
        return list(row.titles or []) if row.error is None else []

    def also_located_in(self, title: str) -> list[str]:
        if self.places is None:
            return []
        row = self.places.where(F.lower("title") == title.lower()).select("also_located_in").first()
        return list(row[0] or []) if row else []

    def related_names(self, name: str, surname: bool) -> list[str]:
        if self.variants is None:
            return []
        row = self.variants.where(F.col("name") == name).first()
        return [*(row.confirmed or []), *(row.computer or [])][: N.MOST_RELATED] if row else []

    def search(self, query: str, options: Options | None = None, start: int = 0, rows: int | None = 10, facets: tuple[str, ...] = ()) -> S.Result:
        """The main request: documents with scores (all that match where rows is None), facets, words to highlight and the places that were matched."""
        o = replace(options or Options(), match_places=self.match_places, also_located_in=self.also_located_in, related_names=self.related_names)
        return S.search(self.index, query, o, start, rows, facets, postings=self.postings)

    def place_index(self, titles: DataFrame) -> DataFrame:
        return P.index_tokens(titles, self.places)

    def place_standardize(self, requests: DataFrame, default_country: str | None = None) -> DataFrame:
        return P.standardize(requests, self.places, default_country)

    def place_autocomplete(self, requests: DataFrame) -> DataFrame:
        return P.autocomplete(requests, self.places)

    def place_latlng(self, requests: DataFrame) -> DataFrame:
        return P.coordinates(requests, self.places)

    def place_latlng_title(self, titles: DataFrame) -> DataFrame:
        return P.title_coordinates(titles, self.places)

    def stats(self) -> dict[str, DataFrame]:
        """Documents per namespace, and of all namespaces."""
        per = S.namespace_stats(self.index)
        return {"namespaces": per, "total": per.agg(F.sum("count").alias("total"))}

    def watched(self, user: str) -> DataFrame:
        return self.index.where(F.array_contains("User", user)).agg(F.count(F.lit(1)).alias("count"))

    def name_info(self, requests: DataFrame) -> DataFrame:
        return N.info(requests, self.variants, self.universe)

    def name_update(self, name: str, adds: list[str], deletes: list[str], user: str, comment: str | None, admin: bool, timestamp: str, kind: str = "surname"):
        return N.update(self.variants, self.universe, name, adds, deletes, user, comment, admin, timestamp, kind)


def data_quality(docs: DataFrame, rules: dict[str, Column], key: str = "PageId") -> DataFrame:
    """(key, issue) of documents for which a rule, a boolean Column, holds. The rules themselves are the caller's."""
    issues = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])) if rules else F.array().cast("array<string>")
    return docs.select(key, F.explode(issues).alias("issue"))


def event_dates(requests: DataFrame, column: str = "q") -> DataFrame:
    """requests with what their date says: its first standard form, the ISO form of it, the year, whether there is but a year, a key to sort by, and an error without a year."""
    from ancestra.functions import dates

    first = F.get(dates.date_tokens(dates.date_words(column)), 0)
    parts = F.array_compact(F.array(F.substring(first, 1, 4), F.when(F.length(first) >= 6, F.substring(first, 5, 2)), F.when(F.length(first) == 8, F.substring(first, 7, 2))))
    return requests.withColumns({
        "standard": first, "iso": F.when(first.isNotNull(), F.array_join(parts, "-")), "effective_year": F.substring(first, 1, 4).cast("int"), "year_only": F.length(first) == 4, "sort_key": F.rpad(first, 8, "0"),
        "error": F.when(first.isNull(), "no year"),
    })
