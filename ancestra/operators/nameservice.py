"""Name variants: expansion, reading a name's information, and updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ancestra.functions import names

MOST_CANDIDATES, MOST_RELATED = 60, 65


def related(variants: DataFrame, tokens: DataFrame, column: str = "token", most: int = MOST_RELATED) -> DataFrame:
    """tokens with each related name as a row of its own: (…, related). variants: name, confirmed, computer."""
    known = variants.select(F.col("name").alias("__n"), F.slice(F.array_union("confirmed", "computer"), 1, most).alias("__r"))
    return tokens.join(known, F.col(column) == F.col("__n")).select(*tokens.columns, F.explode("__r").alias("related")).where(F.col("related") != F.col(column))


def expanded_tokens(docs: DataFrame, key: str, tokens: str, variants: DataFrame) -> DataFrame:
    """docs with its name tokens and all their related names, distinct and sorted."""
    each = docs.select(key, F.explode(tokens).alias("token"))
    more = related(variants, each).groupBy(F.col(key).alias("__k")).agg(F.collect_set("related").alias("__m"))
    return docs.join(more, F.col(key) == F.col("__k"), "left").withColumn(tokens, F.array_sort(F.array_union(tokens, F.coalesce("__m", F.array().cast("array<string>"))))).select(*docs.columns)


def candidates(requests: DataFrame, universe: DataFrame, most: int = MOST_CANDIDATES) -> DataFrame:
    """requests (name) with up to `most` names of the same sound code. universe: name, common."""
    from pyspark.sql import Window

    coded = universe.where("common").select(F.col("name").alias("c"), F.soundex("name").alias("code"))
    w = Window.partitionBy("code").orderBy("c")
    first = coded.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most + 1).groupBy("code").agg(F.array_sort(F.collect_list("c")).alias("found"))
    joined = requests.join(first, F.soundex("name") == F.col("code"), "left")
    return joined.select("name", F.slice(F.array_except(F.coalesce("found", F.array().cast("array<string>")), F.array("name")), 1, most).alias("candidates"))


def info(requests: DataFrame, variants: DataFrame, universe: DataFrame) -> DataFrame:
    """(name, normalized, confirmed, computer, candidates, code): what is known of each name. A name of several tokens has none of it but its tokens."""
    empty = F.array().cast("array<string>")
    asked = requests.select("name", names.name_tokens("name").alias("tokens"))
    single = F.when(F.size("tokens") == 1, F.get("tokens", 0))
    asked = asked.withColumn("normalized", single)
    v = variants.select(F.col("name").alias("vn"), "confirmed", "computer")
    got = asked.join(v, F.col("normalized") == F.col("vn"), "left")
    near = candidates(asked.where("normalized is not null").select(F.col("normalized").alias("name")).distinct(), universe).withColumnRenamed("name", "cn")
    got = got.join(near, F.col("normalized") == F.col("cn"), "left")
    confirmed, computer = F.array_sort(F.coalesce("confirmed", empty)), F.coalesce("computer", empty)
    computer = F.array_sort(F.array_except(computer, confirmed))
    return got.select("name", F.array_join("tokens", " ").alias("normalized"), confirmed.alias("confirmed"), computer.alias("computer"), F.array_except(F.array_except(F.coalesce("candidates", empty), confirmed), computer).alias("candidates"), F.soundex("normalized").alias("code"))


def update(variants: DataFrame, universe: DataFrame, name: str, adds: list[str], deletes: list[str], user: str, comment: str | None, admin: bool, timestamp: str, kind: str = "surname") -> tuple[DataFrame, DataFrame, list[str]] | None:
    """(changed variants, log rows, rejected adds) of one editor's request; null unless the name is already normalized.

    An add that isn't common and has the name's sound code is reported instead of added. Confirmed
    variants are deleted by administrators alone, computed ones by anyone. The reverse updates go
    to all adds and deletes of the request, taken or not. A row is logged only if it changed. The
    frames have a row per name of the request.
    """
    spark = variants.sparkSession
    one = spark.createDataFrame([(x, x in adds, x in deletes) for x in dict.fromkeys([name, *adds, *deletes])], "raw string, is_add boolean, is_delete boolean")
    coded = one.select("*", names.name_tokens("raw").alias("t")).select("raw", "is_add", "is_delete", F.when(F.size("t") == 1, F.get("t", 0)).alias("norm"), F.soundex("raw").alias("code"))
    coded = coded.join(universe.select(F.col("name").alias("u"), "common"), F.col("norm") == F.col("u"), "left").join(variants.select(F.col("name").alias("v"), "confirmed", "computer"), F.col("raw") == F.col("v"), "left")
    rows = {r.raw: r for r in coded.collect()}  # the names of one request
    me = rows[name]
    if me.norm != name:
        return None
    confirmed, computer = set(me.confirmed or []), set(me.computer or [])
    taken, rejected = set(), []
    for add in adds:
        n = rows[add].norm
        if n and n != name:
            if not rows[add].common and rows[add].code == me.code:
                rejected.append(n)
            elif n not in confirmed:
                taken.add(n)
    gone = {d for d in deletes if ((admin and d in confirmed) or d in computer) and d not in taken}
    if not taken and not gone:
        return variants.limit(0), spark.createDataFrame([], LOG), sorted(set(rejected))
    plans = [(name, sorted(taken), sorted(gone), 0), *[(a, [name], [], 1) for a in adds], *[(d, [], [name], 1) for d in deletes]]
    asked = spark.createDataFrame(plans, "name string, adds array<string>, deletes array<string>, flags int")
    empty = F.array().cast("array<string>")
    now = asked.join(variants.withColumnRenamed("name", "v"), F.col("name") == F.col("v"), "left").withColumns({"confirmed": F.coalesce("confirmed", empty), "computer": F.coalesce("computer", empty)})
    new_confirmed = F.array_sort(F.array_except(F.array_union("confirmed", "adds"), F.col("deletes")))
    new_computer = F.array_sort(F.array_except(F.array_except("computer", "adds"), F.col("deletes")))
    changed = now.withColumns({"nc": new_confirmed, "np": new_computer}).where((F.array_sort("confirmed") != F.col("nc")) | (F.array_sort("computer") != F.col("np")))
    text = lambda c: F.array_join(c, " ")
    log = changed.select(F.lit(timestamp).alias("log_timestamp"), F.lit(user).alias("log_user_text"), F.col("name").alias("log_name"), F.lit(kind).alias("log_type"), text("adds").alias("log_adds"), text("deletes").alias("log_deletes"), F.col("flags").alias("log_flags"), F.lit(comment or "").alias("log_comment"))
    return changed.select("name", F.col("nc").alias("confirmed"), F.col("np").alias("computer")), log, sorted(set(rejected))


LOG = "log_timestamp string, log_user_text string, log_name string, log_type string, log_adds string, log_deletes string, log_flags int, log_comment string"


def synonym_classes(lines: list[str]) -> dict[str, list[str]]:
    """Word -> all words of its class. Lines are comma-separated classes; lines that share a word are one class, blanks are dropped."""
    root: dict[str, str] = {}

    def find(w: str) -> str:
        while root.setdefault(w, w) != w:
            root[w] = root[root[w]]
            w = root[w]
        return w

    for line in lines:
        members = [m.strip() for m in line.split("#")[0].split(",") if m.strip()]
        for m in members:
            root[find(m)] = find(members[0])
    out: dict[str, list[str]] = {}
    for w in sorted(root):
        out.setdefault(find(w), []).append(w)
    return {w: group for group in out.values() for w in group}


def with_synonyms(tokens: Column, classes: dict[str, list[str]]) -> Column:
    """Tokens and their synonyms, distinct. The classes are a configuration file's, and so bounded."""
    if not classes:
        return F.array_distinct(tokens)
    known = F.create_map(*[x for w, g in sorted(classes.items()) for x in (F.lit(w), F.array(*[F.lit(m) for m in g]))])
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), F.array(t)))))
