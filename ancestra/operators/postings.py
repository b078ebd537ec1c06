"""Postings: which documents hold a term and where, written once and read by term."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ancestra.plans.ast import MUST, MUST_NOT, SHOULD, Bool, DisMax, Fuzzy, Phrase, Popularity, Prefix, Query, Range, Term, Wildcard, boosted
from ancestra.plans.compile import Compiler

LEAF = (Term, Phrase, Prefix, Wildcard, Range, Fuzzy)
#: Documents from which write() learns where its files' ranges begin; about the rows of a file, and the least worth one of their own.
SAMPLED, FILE, LEAST = 2000, 2_000_000, 20_000
#: Terms of documents that are put in order at once, and rows of an Arrow batch.
SLICE, BATCH = 2_000_000, 100_000


def _terms(index: DataFrame, field: str) -> Column:
    """A field's terms as an array; a string field is one term."""
    if isinstance(index.schema[field].dataType, T.ArrayType):
        return F.coalesce(F.col(field), F.array().cast("array<string>"))
    return F.array(F.col(field).cast("string"))


def held(index: DataFrame, fields: tuple[str, ...], key: str = "PageId") -> DataFrame:
    """(field, term, key) of the rows of postings(), in no order and without a shuffle: what counts terms needs no more."""
    distinct = lambda f: F.array_distinct(F.array_compact(_terms(index, f)))
    if len(fields) == 1:  # the terms as they are, without a record for each
        return index.select(F.lit(fields[0]).alias("field"), F.explode(distinct(fields[0])).alias("term"), key)

    def named(f: str) -> Column:
        return F.transform(distinct(f), lambda x: F.struct(F.lit(f).alias("field"), x.alias("term")))

    return index.select(key, F.explode(F.concat(*[named(f) for f in fields])).alias("x")).select("x.field", "x.term", key)


def postings(index: DataFrame, fields: tuple[str, ...], key: str = "PageId", impact: str | None = None) -> DataFrame:
    """(field, term, key, positions) of the index's term fields, one row a term and document, in that order.

    impact: a numeric column of documents by which they score whatever the query; then it goes with each row
    as `impact` (0 for null), and a term's rows begin with the largest, for operators.best.

    A document's places of a term are gathered before the one shuffle, by ranges of (field, term,
    key), so that a term of very many documents is spread over tasks and files. A string field is
    one term. Null terms have neither row nor position, as in the search of arrays; keys must be
    distinct, as write() checks. The fields go with the rows, as metadata of `term`.
    """
    return _ordered(_placed(index, fields, key, impact).drop("part"), fields, key, impact)


def _placed(index: DataFrame, fields: tuple[str, ...], key: str, impact: str | None, starts: tuple[tuple, ...] = ()) -> DataFrame:
    """The rows of postings() in no order over all, with the number of their range as `part`; ranges begin at `starts`."""
    carried = [F.coalesce(F.col(impact).cast("double"), F.lit(0.0)).alias("impact")] if impact else []
    given = index.select(F.col(key), *carried, *[_terms(index, f).cast("array<string>").alias(f"__t{i}") for i, f in enumerate(fields)])
    schema = T.StructType().add("field", "string").add("term", "string")
    for f in given.schema.fields[1 : 1 + len(carried)] + given.schema.fields[:1]:
        schema = schema.add(f)
    schema = schema.add("positions", T.ArrayType(T.IntegerType())).add("part", T.IntegerType())
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, len(fields)):
                for i, f in enumerate(fields):
                    yield from _field_rows(some, f, 1 + bool(impact) + i, bool(impact), starts, names)

    return given.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, fields: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about SLICE terms; a longer document is alone in its slice."""
    sizes = sum(pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[-fields:])
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE, "right")))
        yield batch.slice(start, end - start)
        start = end


def _field_rows(batch: pa.RecordBatch, field: str, at: int, impact: bool, starts: tuple[tuple, ...], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A field's rows of a slice, in order: documents and terms get numbers in their order, and both together are sorted as one."""
    n, keys = len(batch), batch.column(0)
    lists = batch.column(at)
    terms = lists.flatten()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), sizes)
    if terms.null_count:
        there = terms.is_valid()
        terms, doc = terms.filter(there), doc[there.to_numpy(zero_copy_only=False)]
        sizes = np.bincount(doc, minlength=n)
    if not len(terms):
        return
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    columns = {"key": keys} | ({"impact": batch.column(1)} if impact else {})
    docs = pc.sort_indices(pa.table(columns), sort_keys=[*([("impact", "descending")] if impact else []), ("key", "ascending")]).to_numpy()
    number = np.empty(n, np.int64)
    number[docs] = np.arange(n)
    coded = terms.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    both = rank[coded.indices.to_numpy()] * n + number[doc]
    sort = np.argsort(both, kind="stable")
    both, place = both[sort], place[sort].astype(np.int32)
    first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1])))
    rows = both[first]

    def least(j: int) -> tuple:
        d = int(docs[j])
        return (*((-batch.column(1)[d].as_py(),) if impact else ()), keys[d].as_py())

    base = sum(s[0] < field for s in starts)
    cuts = []
    for s in starts:
        if s[0] == field:
            w = bisect_left(range(len(words)), s[1], key=lambda j: words[j].as_py())
            d = bisect_left(range(n), s[2:], key=least) if w < len(words) and words[w].as_py() == s[1] else 0
            cuts.append(w * n + d)
    part = (base + np.searchsorted(np.array(cuts, np.int64), rows, "right")).astype(np.int32)
    offsets = np.append(first, len(both)).astype(np.int32)
    for i in range(0, len(rows), BATCH):
        some = rows[i : i + BATCH]
        of = pa.array(docs[some % n])
        carried = [batch.column(1).take(of)] if impact else []
        positions = pa.ListArray.from_arrays(pa.array(offsets[i : i + len(some) + 1]), pa.array(place))
        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(field, words.type), len(some)), words.take(pa.array(some // n)), *carried, keys.take(of), positions, pa.array(part[i : i + len(some)])], names)


def _order(columns: list[str], key: str) -> list[Column]:
    return [F.col("field"), F.col("term"), *([F.desc("impact")] if "impact" in columns else []), F.col(key)]


def _said(rows: DataFrame, fields: tuple[str, ...], impact: str | None) -> DataFrame:
    return rows.withMetadata("term", {"fields": list(fields)} | ({"impact": impact} if impact else {}))


def _ordered(rows: DataFrame, fields: tuple[str, ...], key: str, impact: str | None) -> DataFrame:
    order = _order(rows.columns, key)
    return _said(rows.repartitionByRange(*order).sortWithinPartitions(*order), fields, impact)


def _starts(index: DataFrame, fields: tuple[str, ...], key: str, impact: str | None) -> tuple[tuple, ...]:
    """Where ranges of about equal rows begin, by the rows of some SAMPLED documents; all documents' rows are put into them.

    Range partitioning by itself makes all rows twice, once to find its ranges.
    """
    every = max(1, index.count() // SAMPLED)
    rows = _placed(index.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0), fields, key, impact)
    about = rows.count() * every
    ranges = max(math.ceil(about / FILE), min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(about / LEAST)))
    if ranges < 2:
        return ()
    least = F.min(F.struct("field", "term", *([(-F.col("impact")).alias("impact")] if impact else []), key)).alias("x")
    found = rows.repartitionByRange(ranges, *_order(rows.columns, key)).groupBy(F.spark_partition_id().alias("p")).agg(least).orderBy("x").select("x.*").toArrow()  # a row a range
    return tuple(zip(*[c.to_pylist() for c in found.columns], strict=True))[1:]


def written_fields(table: DataFrame) -> tuple[str, ...]:
    """The fields whose postings a table of postings holds, with or without terms."""
    fields = table.schema["term"].metadata.get("fields")
    if fields is None:
        raise ValueError("a table of postings must come from postings() or read(): its fields aren't known")
    return tuple(fields)


def write(index: DataFrame, path: str, fields: tuple[str, ...], key: str = "PageId", impact: str | None = None) -> None:
    """Write the postings: a folder a field, files sorted by term, so that a term's readers skip all other row groups.

    A repeated or null key is an error: facets and hits count rows as documents. Each field's folder
    also holds a row without a term, so that fields without terms, too, can be read.
    """
    twice = index.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull()).first()
    if twice is not None:
        raise ValueError(f"{key} {twice[0]} is null or repeated: postings need distinct keys")
    starts = _starts(index, fields, key, impact)
    rows = _placed(index, fields, key, impact, starts)
    _save(_said(rows.repartitionById(len(starts) + 1, "part").sortWithinPartitions(*_order(rows.columns, key)).drop("part"), fields, impact), path)


def write_rows(rows: DataFrame, path: str, fields: tuple[str, ...], key: str = "PageId") -> None:
    """Write rows of postings, as postings() gives them, anew in their order; those of distinct keys that were written before."""
    _save(_ordered(rows, fields, key, rows.schema["term"].metadata.get("impact")), path)


def _save(table: DataFrame, path: str) -> None:
    said = table.schema["term"].metadata
    fields, columns = said["fields"], ["field", *(c for c in table.columns if c != "field")]
    table.select(*columns).write.mode("overwrite").partitionBy("field").parquet(path)
    none = table.sparkSession.createDataFrame([(f,) for f in fields], "field string").select("field", *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns[1:]))
    none.withMetadata("term", said).coalesce(1).write.mode("append").partitionBy("field").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where("term is not null")


def facet(table: DataFrame, field: str, matched: DataFrame | None = None, key: str = "PageId") -> DataFrame:
    """(value, count): documents per term of a field, of all documents or of the matched ones; a row is a document, so nothing is made distinct."""
    of = table.where(F.col("field") == field)
    if matched is not None:
        of = of.join(matched.select(key), key, "left_semi")
    return of.groupBy(F.col("term").alias("value")).count()


def leaves(q: Query) -> list[Query]:
    """The queries of terms in a tree, without their boosts, each once."""
    match q:
        case DisMax(queries):
            found = [x for y in queries for x in leaves(y)]
        case Bool(clauses):
            found = [x for _, y in clauses for x in leaves(y)]
        case Popularity():
            found = []
        case _:
            found = [boosted(q, 1.0)]
    return list(dict.fromkeys(found))


def matches_without(q: Query, looked_up: Callable[[Query], bool]) -> tuple[bool, bool]:
    """(may, must): whether a document that holds none of the terms looked up may match, and whether it does for sure.

    Leaves that aren't looked up are decided by the document itself: they may match and need not.
    """
    match q:
        case Popularity():
            return True, True
        case DisMax(queries):
            each = [matches_without(x, looked_up) for x in queries]
            return any(may for may, _ in each), any(must for _, must in each)
        case Bool(clauses):
            need, some, never = ([matches_without(x, looked_up) for o, x in clauses if o == occur] for occur in (MUST, SHOULD, MUST_NOT))
            may = bool(need or some) and all(x for x, _ in need) and not any(x for _, x in never) and (bool(need) or any(x for x, _ in some))
            must = bool(need or some) and all(x for _, x in need) and not any(x for x, _ in never) and (bool(need) or any(x for _, x in some))
            return may, must
    return not looked_up(q), False


class Lookup(Compiler):
    """Compiles a tree over what its leaves found in the postings, a row a document.

    Same results as over arrays of terms, but that a phrase is of whole terms even where a term
    holds a space. Fields without postings are searched in the documents' arrays. The scan is pruned to the leaves' fields (folders) and terms (row groups); a
    fuzzy leaf compares all terms of the fields that are read.
    """

    def __init__(self, docs: DataFrame, tree: Query, written: tuple[str, ...], key: str = "PageId", popularity: str = "Popularity"):
        super().__init__(docs, popularity)
        self.key = key
        self.at = {q: i for i, q in enumerate(q for q in leaves(tree) if q.field in self.fields and q.field in written)}
        self.everything, _ = matches_without(tree, lambda q: boosted(q, 1.0) in self.at or q.field not in self.fields)

    def words(self, q: Query) -> tuple[str, ...]:
        """A phrase's terms in the postings."""
        return q.words if isinstance(self.fields[q.field], T.ArrayType) else (" ".join(q.words),)

    def asked(self, q: Query) -> Column:
        """Whether a row's term is asked for by a leaf, on the term alone, so that it can be pushed to the scan."""
        term = F.col("term")
        if isinstance(q, Phrase):
            return term.isin(*self.words(q))
        head = q.text[: min(i for i in (q.text.find("*"), q.text.find("?")) if i >= 0)] if isinstance(q, Wildcard) else ""
        return term.startswith(head) & self.test(q, term) if head else self.test(q, term)

    def found(self, table: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
        """(key, __f0, __f1, ...): of each document that holds a term asked for, whether a leaf is found; of a fuzzy leaf the best similarity.

        carried: columns of the table that are the same in all rows of a document.
        """
        if not self.at:
            return table.select(self.key, *carried).limit(0)
        rows = table.where(F.col("field").isin(sorted({q.field for q in self.at}))).where(self._any([self.asked(q) for q in self.at]))
        parts, columns = [], []
        for q, i in self.at.items():
            here = F.col("field") == q.field
            if isinstance(q, Phrase):
                words = self.words(q)
                parts += [F.max(F.when(here & (F.col("term") == w), F.col("positions"))).alias(f"__w{i}_{j}") for j, w in enumerate(words)]
                columns.append(self._consecutive([F.col(f"__w{i}_{j}") for j in range(len(words))]).alias(f"__f{i}"))
            else:
                hit = here & self.asked(q)
                parts.append(F.max(F.when(hit, self.similarity(F.col("term"), q.text) if isinstance(q, Fuzzy) else F.lit(True))).alias(f"__f{i}"))
                columns.append(F.col(f"__f{i}"))
        return rows.groupBy(self.key).agg(*parts, *(F.max(c).alias(c) for c in carried)).select(self.key, *carried, *columns)

    @staticmethod
    def _consecutive(positions: list[Column]) -> Column:
        def all_follow(p: Column) -> Column:
            out = F.lit(True)
            for j, other in enumerate(positions[1:], 1):
                out = out & F.array_contains(other, (p + j).cast("int"))
            return out

        return F.exists(positions[0], all_follow)

    def joined(self, docs: DataFrame, table: DataFrame) -> DataFrame:
        """docs with what was found of them; documents without a term asked for are left out where they can't match."""
        found = self.found(table).withColumnRenamed(self.key, "__key")
        return docs.join(found, F.col(self.key) == F.col("__key"), "left" if self.everything else "inner").drop("__key")

    def stripped(self, df: DataFrame) -> DataFrame:
        return df.drop(*[f"__f{i}" for i in self.at.values()])

    def match(self, q: Query) -> Column:
        if not isinstance(q, LEAF):
            return super().match(q)
        i = self.at.get(boosted(q, 1.0))
        if i is None:
            return super().match(q)
        return F.col(f"__f{i}").isNotNull() if isinstance(q, Fuzzy) else F.coalesce(F.col(f"__f{i}"), F.lit(False))

    def score(self, q: Query) -> Column:
        if isinstance(q, Fuzzy) and boosted(q, 1.0) in self.at:
            return F.coalesce(q.boost * (F.col(f"__f{self.at[boosted(q, 1.0)]}") - q.least) / (1 - q.least), F.lit(0.0))
        return super().score(q)
