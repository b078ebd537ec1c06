"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ancestra import data


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def record(**fields: Column) -> Column:
    """A struct by its fields' names."""
    return F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])


def let(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), 0)


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def words_in(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)])


def romanize(c: Column | str) -> Column:
    """Latin letters with marks, and a few others, as ASCII letters; null as the empty string."""
    one = {a: b for a, b in data.ROMANIZE.items() if len(b) == 1}
    out = F.translate(F.coalesce(col(c), F.lit("")), "".join(one), "".join(one.values()))
    for a, b in data.ROMANIZE.items():
        if len(b) > 1:
            out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.coalesce(col(c), F.lit("")).rlike(r"[^\x00-\x7F]"), out).otherwise(F.coalesce(col(c), F.lit("")))


def html_entities(c: Column | str) -> Column:
    """Named Latin-1 entities replaced by their characters (the no-break space by a space); all others stay."""
    known = literal_map(data.LATIN1_ENTITIES)
    parts = F.split(col(c), "&", -1)

    def one(x: Column, i: Column) -> Column:
        name = F.regexp_extract(x, "^([A-Za-z0-9]+);", 1)
        found = F.try_element_at(known, name)
        return F.when(i == 0, x).when(found.isNotNull(), F.concat(found, F.regexp_replace(x, "^[A-Za-z0-9]+;", ""))).otherwise(F.concat(F.lit("&"), x))

    return F.array_join(F.transform(parts, one), "")


def umlauts(c: Column | str) -> Column:
    """Umlauts written with an e; null where there are none."""
    out = col(c)
    for a, b in (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("Ü", "Ue"), ("Ö", "Oe"), ("Ä", "Ae")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(col(c).rlike("[üöäÜÖÄ]"), out)


def mixed_case(c: Column | str) -> Column:
    """First letters of words (after a space or at the beginning) in upper case, the rest as it is."""
    up = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))
    return F.array_join(F.transform(F.split(col(c), " ", -1), up), " ")


_DELIMITERS = r" `~!@#$%&_=:;<>,./{}()?+*|\"\-\[\]\\"


def title_case(c: Column | str) -> Column:
    """Title capitalisation: Roman numerals and acronyms upper, words of the lower-case list lower but at the beginning and after : ? !, name parts as given."""
    words = F.regexp_extract_all(col(c), F.lit(f"([{_DELIMITERS}]+|[^{_DELIMITERS}]+)"), F.lit(1))
    upper, lower, names = words_in(data.UPPERCASE_WORDS), words_in(data.LOWERCASE_WORDS), words_in(data.NAME_WORDS)
    pairs = F.transform(words, lambda x, i: record(w=x, first=F.when(i == 0, True).otherwise(F.trim(F.get(words, i - 1)).isin(":", "?", "!"))))

    def one(p: Column) -> Column:
        w, uc, lc = p["w"], F.upper(p["w"]), F.lower(p["w"])
        return (
            F.when(F.array_contains(upper, uc) | (w == uc), uc).when(F.array_contains(names, lc) & (w != lc), w).when(~p["first"] & F.array_contains(lower, lc), lc)
            .when(w == lc, F.concat(F.upper(F.substring(w, 1, 1)), F.substr(lc, F.lit(2)))).otherwise(w)
        )

    return F.array_join(F.transform(pairs, one), "")


def place_level_case(c: Column | str) -> Column:
    """title_case() outside parentheses, lower case inside."""
    at = F.instr(col(c), "(")
    return F.when(at > 1, F.concat(title_case(F.trim(F.substr(col(c), F.lit(1), at - 1))), F.lit(" "), F.lower(F.trim(F.substr(col(c), at))))).otherwise(title_case(F.trim(col(c))))


def occurrences(c: Column | str, char: str) -> Column:
    return F.length(col(c)) - F.length(F.replace(col(c), F.lit(char), F.lit("")))


def starts_with_ignore_case(c: Column | str, needle: str) -> Column:
    """needle in lower case."""
    return F.lower(col(c)).startswith(needle)


def is_blank(c: Column | str) -> Column:
    return col(c).isNull() | (F.trim(col(c)) == "")


def is_ascii(c: Column | str) -> Column:
    return ~col(c).rlike(r"[^\x00-\x7F]")


def to_ascii(c: Column | str) -> Column:
    """Characters beyond ASCII as question marks; null as the empty string."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), r"[^\x00-\x7F]", "?")


def cache_key(prefix: str, c: Column | str) -> Column:
    """A prefix and the MD5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(col(c)))


def wiki_millis(c: Column | str) -> Column:
    """Milliseconds since the epoch of a 14-digit time stamp, in the session's zone."""
    return F.unix_millis(F.to_timestamp(col(c), "yyyyMMddHHmmss"))


def sort_key(c: Column | str) -> Column:
    """Romanized, cut to 80 characters, then lower-cased and trimmed."""
    return F.trim(F.lower(F.substring(romanize(c), 1, 80)))


def sort_key_batch(c: Column | str) -> Column:
    """Romanized, lower-cased and trimmed, then cut to 80 characters (the batch tool's order)."""
    return F.substring(F.trim(F.lower(romanize(c))), 1, 80)


def remove_index_number(c: Column | str) -> Column:
    """A title without its number in parentheses at the end."""
    return F.regexp_replace(col(c), r"\s*\(\d+\)\s*$", "")


def split_index_number(c: Column | str) -> Column:
    """(title, number) of "title (number)"; the number is null without one."""
    return F.struct(remove_index_number(c).alias("title"), F.regexp_extract(col(c), r"\((\d+)\)\s*$", 1).try_cast("int").alias("number"))


def padded_title(c: Column | str) -> Column:
    """A title whose number is two spaces and six digits, as sorted titles have it."""
    parts = split_index_number(c)
    return F.when(parts["number"].isNull(), col(c)).otherwise(F.concat(parts["title"], F.lit("  "), F.lpad(parts["number"].cast("string"), 6, "0")))


def zero_padded(c: Column | str, digits: int = 10) -> Column:
    return F.lpad(col(c).cast("string"), digits, "0")


def first_letter(c: Column | str) -> Column:
    """A to V by their letter, W to Z together, all else "other"."""
    x = F.upper(F.substring(col(c), 1, 1))
    return F.when(x.rlike("^[A-V]$"), x).when(x.rlike("^[W-Z]$"), "WXYZ").otherwise("other")


def truncated(c: Column | str, length: int) -> Column:
    return F.substring(col(c), 1, length)


def unabbreviated(tokens: Column | str, abbreviations: dict[str, str], first_token: bool = True, ignore_case: bool = True) -> Column:
    """Tokens that are abbreviations written out; the first one only if first_token."""
    known = literal_map({k.lower(): v for k, v in abbreviations.items()} if ignore_case else abbreviations)
    return F.transform(col(tokens), lambda x, i: F.when(F.lit(not first_token) & (i == 0), x).otherwise(F.coalesce(F.try_element_at(known, F.lower(x) if ignore_case else x), x)))


def without_stop_words(tokens: Column | str, stop=data.STOP_WORDS) -> Column:
    return F.filter(col(tokens), lambda x: ~x.isin(*sorted(stop)))


def tokens(c: Column | str) -> Column:
    """Lower-cased romanized runs of letters and digits."""
    return F.array_remove(F.split(F.lower(romanize(c)), "[^a-z0-9]+"), "")


def strip_markup(c: Column | str) -> Column:
    """Text and attribute values of markup; tag names and attribute names go, and a tag's end becomes a space.

    Tags are split off at "<"; in each, name="value" pairs leave their values. An attribute value may hold any character but a double quote.
    """
    pieces = F.split(col(c), "<", -1)

    def one(x: Column, i: Column) -> Column:
        tag = F.regexp_extract(x, r'^[A-Za-z0-9/]*((?:[^">]|"[^"]*")*)>?', 1)
        rest = F.regexp_replace(x, r'^[A-Za-z0-9/]*(?:[^">]|"[^"]*")*>?', "")
        values = F.array_join(F.regexp_extract_all(tag, F.lit('"([^"]*)"'), F.lit(1)), " ")
        return F.when(i == 0, x).otherwise(F.concat(F.when(values == "", "").otherwise(F.concat(F.lit(" "), values)), F.lit(" "), rest))

    return F.array_join(F.transform(pieces, one), "")


def namespace_title(c: Column | str) -> Column:
    """(namespace, title): a prefix before the first colon counts only if it is a namespace."""
    known = [f"{n} talk" for n in data.NAMESPACES if n != "Article"] + [n for n in data.NAMESPACES if n != "Article"] + ["Talk"]
    prefix = F.regexp_extract(col(c), r"^([^:]+):", 1)
    is_one = prefix.isin(*known)
    return F.struct(F.when(is_one, prefix).otherwise("").alias("namespace"), F.when(is_one, F.substr(col(c), F.length(prefix) + 2)).otherwise(col(c)).alias("title"))


def main_namespace(c: Column | str) -> Column:
    """A namespace without " talk"; none and "Talk" are Article."""
    return F.when(F.coalesce(col(c), F.lit("")).isin("", "Talk"), "Article").otherwise(F.regexp_replace(col(c), " talk$", ""))


def namespace_id(c: Column | str) -> Column:
    """The id of a namespace; "MediaWiki talk" has that of MediaWiki."""
    ids = {n: i for n, i in data.NAMESPACES.items() if n != "Article"}
    ids |= {f"{n} talk": i + (n != "MediaWiki") for n, i in ids.items()} | {"Talk": 1, "": 0}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ids.items() for x in kv]), col(c))


def structured_split(tag: str, c: Column | str) -> Column:
    """(xml, text): split after the first closing tag; without one all is text."""
    end = F.instr(col(c), f"</{tag}>")
    size = len(tag) + 3
    return F.struct(F.when(end > 0, F.substr(col(c), F.lit(1), end + size - 1)).otherwise("").alias("xml"), F.when(end > 0, F.substr(col(c), end + size)).otherwise(col(c)).alias("text"))


def category_links(c: Column | str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(?s)\[\[[cC]ategory:(.*?)(?:\|.*?)?\]\]"), F.lit(1))


def is_redirect(c: Column | str) -> Column:
    return col(c).rlike(r"(?i)^#redirect\s*\[\[.*?\]\]")


def after_bar(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?s)^[^|]*\|", "")


def before_bar(c: Column | str) -> Column:
    return F.substring_index(col(c), "|", 1)


def link_text(c: Column | str) -> Column:
    """The shown text of a wiki link: brackets go; without a bar a number at the end goes; with one what follows it stays, unless nothing follows."""
    bare = F.regexp_replace(col(c), r"\[\[|\]\]", "")
    at = F.instr(bare, "|")
    return F.when(at == 0, F.regexp_replace(bare, r"\(\d+\)$", "")).when(at < F.length(bare), F.substr(bare, at + 1)).otherwise(bare)


def ajax_url(host: str, function: str, args: dict[str, Column] | list[Column]) -> Column:
    """The request of a wiki function, its arguments encoded and joined by an encoded bar."""
    parts = [F.concat(F.lit(f"{k}="), F.url_encode(v)) for k, v in args.items()] if isinstance(args, dict) else [F.url_encode(v) for v in args]
    return F.concat(F.lit(f"http://{host}/w/index.php?action=ajax&rs={function}&rsargs="), F.array_join(F.array(*parts), "%7C"))
