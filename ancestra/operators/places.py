"""Resolving place text against a place hierarchy: level by level, for all texts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ancestra import data
from ancestra.functions import names, place, text
from ancestra.session import cut

MOST_READ, MOST_LOCATED_IN, MOST_COMPLETIONS, MOST_MATCHES, MOST_COORDINATES = 300, 300, 100, 12, 2
NO_COORDINATE = 999.0
SCHEMA = "title string, names array<string>, also_located_in array<string>, place_type string, lat string, lng string"


def indexed(places: DataFrame) -> DataFrame:
    """The place table with what lookups need: name tokens, the reversed title, and all reversed ancestors of all parents."""
    head = F.trim(F.substring_index("title", ",", 1))
    own = F.array_compact(F.concat(F.array(head, text.umlauts(head)), F.coalesce("names", F.array().cast("array<string>")), F.array("place_type")))
    parents = F.array_compact(F.concat(F.array(F.trim(place.parent_place("title"))), F.coalesce("also_located_in", F.array().cast("array<string>"))))
    return places.select(
        "title", "also_located_in", "place_type", "lat", "lng", F.array_distinct(F.flatten(F.transform(own, lambda x: names.name_tokens(x)))).alias("tokens"), F.lower(text.romanize(place.reversed_place("title"))).alias("reversed"),
        F.array_distinct(F.flatten(F.transform(parents, lambda x: place.ancestors(F.lower(text.romanize(place.reversed_place(x))))))).alias("located"), text.occurrences("title", ",").alias("commas"),
    )


def by_title(requests: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    """requests with the title that equals their text when both are reversed and lower-cased; the smallest of several."""
    known = index.groupBy("reversed").agg(F.min("title").alias(out))
    return requests.join(known, F.lower(text.romanize(place.reversed_place(column))) == F.col("reversed"), "left").drop("reversed")


def sort_key_of(title: Column, wanted: Column) -> Column:
    """How matches of a level are ordered: US places first, those whose name is the one wanted before others."""
    k = F.lower(title)
    us = k.endswith(", united states")
    shown = F.when(~us, F.concat(k, F.lit("foreign-------------"))).when(k == "georgia, united states", "georgia").otherwise(k)
    exact = (k == wanted) | k.startswith(F.concat(wanted, F.lit(",")))
    return F.when(exact, shown).otherwise(F.concat(shown, F.lit("alternate name match-----")))


def level_matches(asked: DataFrame, index: DataFrame) -> DataFrame:
    """(id, title, ...) of the places with all the tokens of a level's name, in one of the located titles where there are any.

    asked: id, want (the name's tokens), asked_located (reversed titles), begun (whether the last
    token is the beginning of one, of any length). One token is an equi-join key, a whole one where
    there is one, else the first letters of the begun one, three at most; the other tokens, and
    the parents, are checked on the pairs it gives.
    """
    q = asked.where(F.size("want") > 0)
    whole = F.when(F.col("begun"), F.slice("want", F.lit(1), F.size("want") - 1)).otherwise(F.col("want"))
    q = q.withColumn("whole", whole).withColumn("last", F.when(F.col("begun"), F.element_at("want", -1)))
    q = q.withColumn("probe", F.when(F.size("whole") > 0, F.concat(F.lit("="), F.get("whole", 0))).otherwise(F.concat(F.lit("^"), F.substring("last", 1, 3))))
    starts = F.flatten(F.transform("tokens", lambda t: F.array(F.concat(F.lit("="), t), *[F.concat(F.lit("^"), F.substring(t, 1, n)) for n in (1, 2, 3)])))
    pairs = q.join(index.withColumn("term", F.explode(F.array_distinct(starts))), F.col("probe") == F.col("term"))
    good = F.forall("whole", lambda t: F.array_contains(F.col("tokens"), t)) & (F.col("last").isNull() | F.exists("tokens", lambda t: t.startswith(F.col("last"))))
    inside = (F.size("asked_located") == 0) | F.arrays_overlap("located", "asked_located")
    return pairs.where(good & inside)


def wanted(level: Column) -> Column:
    """The tokens by which a level's name is looked up."""
    return F.filter(names.name_tokens(level), lambda t: t != data.UNKNOWN)


def top_matches(found: DataFrame, most: Column) -> DataFrame:
    """(id, titles, lat, lng): matches of the fewest levels, in the order of their keys, `most` of them."""
    keyed = found.withColumn("k", sort_key_of(F.col("title"), F.col("level"))).withColumn("depth", text.occurrences("k", ","))
    best = keyed.groupBy("id").agg(F.min("depth").alias("best")).withColumnRenamed("id", "bid")
    kept = keyed.join(best, (F.col("id") == F.col("bid")) & (F.col("depth") == F.col("best")))
    w = Window.partitionBy("id").orderBy(F.length("k"), "k", "title")
    ranked = kept.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "title", "reversed", "lat", "lng"))).alias("hits"))


def resolve(requests: DataFrame, index: DataFrame, most: int = MOST_MATCHES, prefer_top: bool = True) -> DataFrame:
    """(id, titles, standard, lat, lng) of requests (id, lookup, strict, begun): levels from right to left, each looked up within what the last one found.

    The United States at the end need no lookup; empty levels are passed over; a level without a
    match goes before the standardized title, capitalized, and leaves the parents as they are.
    strict: a first level that is found only deeper than the second level of the hierarchy doesn't
    count. begun: the text ends within a name. titles are those of the last level looked up, null
    where it had no match. One round of joins per level, each cut from the last; a request leaves
    after its own last level, however many others have. What depends on the texts alone is computed once, before the rounds.
    """
    parts = F.transform(F.reverse(place.levels("lookup")), lambda x: F.struct(x.alias("name"), F.lower(x).alias("level"), wanted(x).alias("want"), text.place_level_case(x).alias("cased")))
    state = requests.select("id", "strict", "begun", parts.alias("levels")).withColumns({
        "located": F.array().cast("array<string>"), "standard": F.lit(""), "titles": F.lit(None).cast("array<string>"), "lat": F.lit(None).cast("string"), "lng": F.lit(None).cast("string"), "us": F.lit(False),
    })
    state = cut(state)
    done = state.where(F.coalesce(F.size("levels"), F.lit(0)) < 1)
    states = [s.lower() for s in data.US_STATES]
    for i in range(state.agg(F.max(F.size("levels"))).first()[0] or 0):
        state = state.where(F.size("levels") > i)
        now = F.get("levels", i)
        state = state.withColumns({"level": now["level"], "want": now["want"], "cased": now["cased"], "active": (now["name"] != "") & ~(F.lit(i == 0) & (now["level"] == "united states")), "final": F.size("levels") == i + 1})
        asked = state.where("active").select("id", "level", "want", "final", F.col("located").alias("asked_located"), "us", (F.col("begun") & F.lit(i == 0)).alias("begun"))  # the text's end is its last level
        if i == 1:  # a US state is taken by its title
            short = asked.where(F.col("us") & F.col("level").isin(states)).join(index, F.col("reversed") == F.concat(F.lit("united states,"), F.col("level")))
            short = short.groupBy("id").agg(F.array(F.min(F.struct(F.lit(1).alias("r"), "title", "reversed", "lat", "lng"))).alias("hits"))
            rest = asked.join(short.select(F.col("id").alias("sid")), F.col("id") == F.col("sid"), "left_anti")
        else:
            short, rest = None, asked
        found = level_matches(rest, index)
        limit = F.when(F.col("final"), most).otherwise(MOST_LOCATED_IN)
        hits = top_matches(found, limit) if prefer_top else first_matches(found, limit)
        if short is not None:
            hits = hits.unionByName(short)
        hits = hits.withColumnRenamed("id", "hid")
        state = state.join(hits, F.col("id") == F.col("hid"), "left")
        if i == 0:
            state = state.withColumn("hits", F.when(~F.col("strict") | (text.occurrences(F.get("hits", 0)["title"], ",") <= 1), F.col("hits")))
        hit = F.col("hits").isNotNull()
        first = F.get("hits", 0)
        is_us = F.lit(i == 0) & (F.col("level") == "united states")
        found_titles = F.transform("hits", lambda h: h["title"])
        failed = F.concat("cased", F.when(F.col("standard") == "", "").otherwise(F.concat(F.lit(", "), F.col("standard"))))
        state = state.select(
            "id", "strict", "begun", "levels", F.when(is_us, F.array(F.lit("united states"))).when(F.col("active") & hit & ~F.col("final"), F.transform("hits", lambda h: h["reversed"])).otherwise(F.col("located")).alias("located"),
            F.when(is_us, "United States").when(~F.col("active"), F.col("standard")).when(hit, first["title"]).otherwise(failed).alias("standard"),
            F.when(F.col("active"), F.when(hit, found_titles)).otherwise(F.col("titles")).alias("titles"), F.when(F.col("active") & hit, F.coalesce(first["lat"], F.col("lat"))).otherwise(F.col("lat")).alias("lat"), F.when(F.col("active") & hit, F.coalesce(first["lng"], F.col("lng"))).otherwise(F.col("lng")).alias("lng"),
            (F.col("us") | is_us).alias("us"),
        )
        state = cut(state)
        done = done.unionByName(state.where(F.size("levels") == i + 1))
    return done.select("id", "titles", "standard", "lat", "lng")


def first_matches(found: DataFrame, most: Column) -> DataFrame:
    """(id, hits): the first matches by title, whatever their level."""
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("title"))).where(F.col("r") <= most)
    return ranked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("r", "title", "reversed", "lat", "lng"))).alias("hits"))


def matches(requests: DataFrame, index: DataFrame, default_country: str | None = None) -> DataFrame:
    """(id, q, lookup, titles, error, standard) of requests (id, q): by title, then strictly, then in the default country, then without strictness, else missing.

    All tries of all requests go through the levels together.
    """
    q = requests.select("id", "q", place.lookup_text("q").alias("lookup"))
    q = cut(by_title(q, index, "lookup", "exact"))
    inland = place.lookup_text(F.concat("q", F.lit(f", {default_country}"))) if default_country else F.lit(None).cast("string")
    tries = F.array(*[F.struct(F.lit(n).alias("n"), x.alias("lookup"), F.lit(n != "lax").alias("strict")) for n, x in (("strict", F.col("lookup")), ("country", inland), ("lax", F.col("lookup")))])
    each = q.select("id", F.explode(tries).alias("t")).where("t.lookup is not null")
    found = resolve(each.select(F.struct("id", "t.n").alias("id"), "t.lookup", "t.strict", F.lit(False).alias("begun")), index)
    of = lambda n, c: F.max_by(F.when(F.col("id.n") == n, F.col(c)), F.col("id.n") == n)
    got = found.groupBy(F.col("id.id").alias("rid")).agg(*[of(n, "titles").alias(n) for n in ("strict", "country", "lax")], of("lax", "standard").alias("standard"))
    q = q.join(got, F.col("id") == F.col("rid"), "left")
    titles = F.coalesce(F.when(F.col("exact").isNotNull(), F.array("exact")), "strict", "country", "lax")
    return q.select("id", "q", "lookup", titles.alias("titles"), F.when(titles.isNull(), "missing").alias("error"), "standard")


def standardize(requests: DataFrame, index: DataFrame, default_country: str | None = None) -> DataFrame:
    """(id, q, result, error) of requests (id, q), q being a place or place^shown: the title, with the shown text where it says more."""
    split = F.split("q", r"\^", 2)
    r = requests.select("id", F.col("q").alias("given"), F.get(split, 0).alias("q"), F.coalesce(F.get(split, 1), F.get(split, 0)).alias("shown"))
    one = matches(r.select("id", "q"), index, default_country).select(F.col("id").alias("i1"), F.coalesce(F.get("titles", 0), "standard").alias("t1"), F.col("error").alias("e1"))
    two = matches(r.where("shown <> q").select("id", F.col("shown").alias("q")), index, default_country).select(F.col("id").alias("i2"), F.coalesce(F.get("titles", 0), "standard").alias("t2"), F.col("error").alias("e2"))
    r = r.join(one, F.col("id") == F.col("i1"), "left").join(two, F.col("id") == F.col("i2"), "left")
    again = F.col("e1").isNotNull() & F.col("i2").isNotNull()
    r = r.select("id", "given", F.when(again, F.col("t2")).otherwise(F.col("t1")).alias("title"), F.when(again, F.col("e2")).otherwise(F.col("e1")).alias("error"), place.cleansed_us(place.cleansed("shown")).alias("display"))
    r = r.withColumn("display", F.when(F.lower("display") == F.lower("title"), "").otherwise(F.col("display"))).withColumn("stripped", place.lookup_text("display"))
    r = cut(r)
    checked = r.where((F.col("display") != "") & (F.col("stripped") != F.col("title")) & place.consistent("stripped", "title"))
    single = resolve(checked.select("id", F.col("stripped").alias("lookup"), F.lit(False).alias("strict"), F.lit(False).alias("begun")), index, prefer_top=False).where(F.size("titles") == 1).select(F.col("id").alias("si"))
    r = r.join(single, F.col("id") == F.col("si"), "left")
    shown = F.when(F.col("si").isNotNull(), F.replace("display", F.col("stripped"), F.col("title"))).otherwise(F.col("display"))
    shown = F.when(F.lower(shown) == F.lower("title"), "").otherwise(shown)
    return r.select("id", F.col("given").alias("q"), F.when(shown == "", F.col("title")).otherwise(F.concat_ws("^", F.when(F.col("title") != "", F.col("title")), shown)).alias("result"), "error")


def index_tokens(titles: DataFrame, index: DataFrame, column: str = "title") -> DataFrame:
    """titles with `tokens`: the title itself and the places it is also located in; an unknown one by itself."""
    known = index.groupBy(F.col("title").alias("__t")).agg(F.first("also_located_in", ignorenulls=True).alias("__a"))
    return titles.join(known, F.col(column) == F.col("__t"), "left").withColumn("tokens", F.concat(F.array(column), F.coalesce("__a", F.array().cast("array<string>")))).select(*titles.columns, "tokens")


def standard_tokens(places: Column) -> Column:
    """The index tokens of a document's place: the place marked as without subordinate, then the others; unknown for none."""
    return F.when(F.size(places) == 0, F.array(F.lit(data.UNKNOWN))).otherwise(F.concat(F.array(place.no_subordinate(F.get(places, 0))), F.slice(places, F.lit(2), F.greatest(F.size(places) - 1, F.lit(0)))))


def autocomplete(requests: DataFrame, index: DataFrame, most: int = MOST_COMPLETIONS) -> DataFrame:
    """(id, title, place_type): completions of requests (id, q). A comma at the end means the name is whole."""
    q = F.lower(F.trim("q"))
    whole = q.endswith(",")
    base = requests.select("id", F.regexp_replace(q, r",+$", "").alias("lookup"), F.lit(False).alias("strict"), (~whole).alias("begun"))
    hits = resolve(base, index, most=most, prefer_top=False).select("id", F.explode("titles").alias("title"))
    kinds = index.groupBy(F.col("title").alias("t")).agg(F.min("place_type").alias("place_type"))
    return hits.join(kinds, F.col("title") == F.col("t"), "left").select("id", "title", "place_type")


def coordinates(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(id, lat, lng, error) of requests (id, q): 0 found, 1 no coordinates, 2 no place, 3 several places."""
    m = matches(requests, index).select("id", "titles", "error")
    single = title_coordinates(m.where(F.size("titles") == 1).select("id", F.get("titles", 0).alias("title")), index).select(F.col("id").alias("ci"), "lat", "lng")
    out = m.join(single, F.col("id") == F.col("ci"), "left")
    code = F.when(F.col("error").isNotNull(), 2).when(F.size("titles") > 1, 3).when(F.col("lat").isNull(), 1).otherwise(0)
    return out.select("id", F.when(code == 0, F.col("lat")).alias("lat"), F.when(code == 0, F.col("lng")).alias("lng"), code.alias("error"))


def title_coordinates(titles: DataFrame, index: DataFrame) -> DataFrame:
    """(id, lat, lng) of (id, title): those of the place or of its nearest ancestor that has some."""
    parts = F.split("title", r",\s*", -1)
    climbed = titles.select("id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ", "))).alias("up", "t"))
    number = lambda c: F.col(c).try_cast("float")
    known = index.where(number("lat").isNotNull() & number("lng").isNotNull()).groupBy(F.lower("title").alias("k")).agg(F.min(F.struct("title", number("lat").alias("lat"), number("lng").alias("lng"))).alias("at"))
    found = climbed.join(known, F.lower("t") == F.col("k")).groupBy("id").agg(F.min_by("at", "up").alias("at"))
    return titles.join(found.withColumnRenamed("id", "fid"), F.col("id") == F.col("fid"), "left").select("id", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lng"))
