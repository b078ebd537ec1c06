"""From extracted documents to the searchable index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ancestra import data
from ancestra.functions import analysis, names, text
from ancestra.operators import places as P
from ancestra.operators import search as S
from ancestra.operators.relational import resolve_redirects
from ancestra.plans.analyze import kind

PLACE_FIELDS = ("PersonBirthPlace", "PersonDeathPlace", "MarriagePlace", "OtherPlace")
#: Fields that are searched by terms; all others are stored as they are.
TERMS = (
    "Title", "Keywords", "User", "Tree", "Category", "PersonSurname", "PersonGivenname", "PersonMarriedName", "PersonBirthDate", "PersonDeathDate", "FatherSurname", "FatherGivenname", "MotherSurname", "MotherGivenname", "SpouseSurname", "SpouseGivenname",
    "HusbandSurname", "HusbandGivenname", "WifeSurname", "WifeGivenname", "HusbandBirthDate", "HusbandDeathDate", "WifeBirthDate", "WifeDeathDate", "MarriageDate", "OtherSurname", "OtherGivenname", "Author", "SourceSubject", "SourceSubSubject", "SourceAvailability",
    "PlaceName", "PlaceTitle", "LocatedInPlace", "SurnameTitle", "GivennameTitle",
)
#: Year fields are copies of date fields with another analyzer.
YEARS = ("PersonBirth", "PersonDeath", "HusbandBirth", "HusbandDeath", "WifeBirth", "WifeDeath", "Marriage")
#: Stored copies of fields that are searched by terms.
STORED = {"UserStored": "User", "AuthorStored": "Author", "SourceSubjectStored": "SourceSubject", "SourceAvailabilityStored": "SourceAvailability", "LocatedInPlaceStored": "LocatedInPlace"}


def standardized_places(docs: DataFrame, redirects: DataFrame, places: DataFrame, fields: tuple[str, ...] = PLACE_FIELDS) -> DataFrame:
    """docs with the index places of their place fields: redirects resolved, further parents added, marked as without subordinate; unknown for none.

    All fields' distinct places go through one pair of joins, and come back in one more.
    """
    each = F.concat(*[F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), _tagged(f)) for f in fields])
    long = docs.select("PageId", F.posexplode(each).alias("at", "x")).select("PageId", "at", "x.field", "x.value")
    known = long.select("value").where(F.col("value") != data.UNKNOWN).distinct()
    known = resolve_redirects(known, redirects, "value", "title")
    known = P.index_tokens(known, places).select(F.col("value").alias("k"), P.standard_tokens(F.col("tokens")).alias("t"))
    found = long.join(known, F.col("value") == F.col("k"), "left").select("PageId", "at", "field", F.coalesce("t", F.array(F.lit(data.UNKNOWN))).alias("t"))
    per = found.groupBy("PageId").agg(F.array_sort(F.collect_list(F.struct("at", "field", "t"))).alias("found")).withColumnRenamed("PageId", "__p")
    joined = docs.join(per, F.col("PageId") == F.col("__p"), "left")
    return joined.withColumns({f: _of_field(f) for f in fields}).drop("__p", "found")


def _tagged(field: str):
    return lambda v: F.struct(F.lit(field).alias("field"), v.alias("value"))


def _of_field(field: str) -> Column:
    own = F.filter(F.coalesce("found", F.array().cast("array<struct<at:int,field:string,t:array<string>>>")), lambda x: x["field"] == field)
    return F.flatten(F.transform(own, lambda x: x["t"]))


def place_facets(docs: DataFrame, countries: Column, fields: tuple[str, ...] = PLACE_FIELDS) -> DataFrame:
    """docs with Place0, Place1 and Place2: the distinct hierarchical facets of their places."""
    from ancestra.functions import place

    values = F.array_distinct(F.flatten(F.array(*[F.coalesce(F.col(f), F.array().cast("array<string>")) for f in fields])))
    facets = F.transform(values, lambda v: place.place_facets(v, countries))
    return docs.withColumns({f"Place{i}": F.array_distinct(F.array_compact(F.transform(facets, _facet(i)))) for i in range(3)})


def _facet(i: int):
    return lambda x: x[f"place{i}"]


def name_facets(docs: DataFrame, surnames: DataFrame, givennames: DataFrame) -> DataFrame:
    """docs with PersonSurnameFacet and PersonGivennameFacet: known name tokens in mixed case and Other for the rest, sorted and joined by bars; Unknown for no token.

    surnames and givennames (name) are tables of known tokens; both fields go through one join.
    """
    fields = (("PersonSurname", surnames), ("PersonGivenname", givennames))
    tokens = F.concat(*[F.transform(F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v: F.coalesce(names.name_tokens(v), F.array().cast("array<string>"))))), _tagged(f)) for f, _ in fields])
    long = docs.select("PageId", F.explode(tokens).alias("x")).select("PageId", "x.field", "x.value")
    known = surnames.select(F.lit("PersonSurname").alias("kf"), F.col("name").alias("kn")).unionByName(givennames.select(F.lit("PersonGivenname").alias("kf"), F.col("name").alias("kn"))).distinct()
    shown = long.join(known, (F.col("field") == F.col("kf")) & (F.col("value") == F.col("kn")), "left").select("PageId", "field", F.when(F.col("kn").isNotNull(), text.mixed_case("value")).otherwise("Other").alias("v"))
    per = shown.groupBy("PageId").agg(*[F.array_join(F.array_sort(F.collect_set(F.when(F.col("field") == f, F.col("v")))), "|").alias(f"__{f}") for f, _ in fields]).withColumnRenamed("PageId", "__p")
    joined = docs.join(per, F.col("PageId") == F.col("__p"), "left")
    return joined.withColumns({f"{f}Facet": F.coalesce(F.when(F.col(f"__{f}") != "", F.col(f"__{f}")), F.lit("Unknown")) for f, _ in fields}).drop("__p", *[f"__{f}" for f, _ in fields])


def with_sort_values(docs: DataFrame, labels: DataFrame, title: str = "TitleSort") -> DataFrame:
    """docs with TitleSortValue, the label of their title's sort key; null where it has none yet. labels: sort_key, value."""
    known = labels.select(F.col("sort_key").alias("__k"), F.col("value").alias("TitleSortValue"))
    return docs.join(known, text.sort_key(title) == F.col("__k"), "left").drop("__k")


def build(docs: DataFrame, options: dict[str, dict] | None = None, most: int = S.MOST_TOKENS) -> DataFrame:
    """The index: term fields as arrays of their values' terms, `most` a field; year fields; stored copies; one row a document.

    options: field -> options of its analyzer.
    """
    options = options or {}
    columns: dict[str, Column] = {new: F.col(old) for new, old in STORED.items() if old in docs.columns}
    arrays = {f.name: isinstance(f.dataType, T.ArrayType) for f in docs.schema.fields}

    def terms(field: str, name: str) -> Column:
        run = analysis.make(name, **options.get(field, {}))
        if not arrays[field]:
            return F.coalesce(run(F.col(field)), F.array().cast("array<string>"))
        return S.indexed_tokens(F.flatten(F.transform(F.filter(field, lambda v: v.isNotNull()), lambda v: run(v))), most)

    for f in (*TERMS, *PLACE_FIELDS):
        if f in arrays:
            columns[f] = terms(f, analysis.BY_KIND[kind(f)])
    for y in YEARS:
        if f"{y}Date" in arrays:
            columns[f"{y}Year"] = terms(f"{y}Date", "year")
    return docs.withColumns(columns)
