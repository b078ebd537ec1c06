"""The best documents of a query, without scoring all that match.

Postings written with `impact` carry what a document scores by whatever the query, and a
term's rows begin with the largest, so that files and row groups are blocks with a
largest impact. The best of the documents of great impact give a score that the k-th must
reach. What the query's terms can add at most says which impact a document needs for that; all
others' blocks are skipped. Scores come from postings alone; only the documents of the result are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ancestra.operators import postings as P
from ancestra.plans.ast import MUST, MUST_NOT, Bool, DisMax, Options, Popularity, Query, Term
from ancestra.plans.parser import parse
from ancestra.plans.rewrites import rewritten

#: The share of documents, by impact, that is scored first; if they give too few, the next share.
SHARES = (0.01, 0.1)
#: Keys of results that are named in the scan of documents.
NAMED = 10_000


def highest(q: Query, impact: float) -> float:
    """The most that a document of this impact can score; it grows with the impact as long as boosts aren't negative."""
    match q:
        case Popularity():
            return max(impact, 0.0) / 1024 * q.boost
        case DisMax(queries):
            return q.boost * max((highest(x, impact) for x in queries), default=0.0)
        case Bool(clauses):
            return q.boost * sum(highest(x, impact) for o, x in clauses if o != MUST_NOT)
    return q.boost


def negative(q: Query) -> bool:
    match q:
        case DisMax(queries):
            return q.boost < 0 or any(map(negative, queries))
        case Bool(clauses):
            return q.boost < 0 or any(negative(x) for _, x in clauses)
    return q.boost < 0


def needed(q: Query, score: float, most: float) -> float:
    """The least impact with which a document can reach a score, to within rounding that errs on the low side; -inf where any can."""
    if highest(q, 0.0) >= score:
        return float("-inf")
    low, high = 0.0, max(most, 0.0)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if highest(q, mid) >= score else (mid, high)
    return low * (1 - 1e-9)


class Best:
    """Postings with impacts, and what is known of them."""

    def __init__(self, docs: DataFrame, table: DataFrame, key: str = "PageId"):
        self.docs, self.table, self.key = docs, table, key
        self.written = P.written_fields(table)
        self.popularity = table.schema["term"].metadata.get("impact")
        self._shares: list[float] | None = None

    def shares(self) -> list[float]:
        """Impacts that SHARES of the documents have at least, and the largest of all; read once from the postings of the first field that has some."""
        if self._shares is None:
            of = self.table.where(F.col("field") == self.written[0]).agg(F.percentile_approx("impact", [1 - s for s in SHARES], 1000).alias("at"), F.max("impact").alias("most")).first()
            self._shares = [*(of["at"] or [0.0] * len(SHARES)), of["most"] or 0.0]
        return self._shares

    def able(self, tree: Query) -> bool:
        """Whether the postings alone decide the tree: every field is written, the impact is the popularity, boosts aren't negative, and no document matches without a term."""
        fields = {f.name for f in self.docs.schema.fields}
        leaves = P.leaves(tree)
        may, _ = P.matches_without(tree, lambda q: True)
        return self.popularity == "Popularity" and not negative(tree) and not may and all(q.field in self.written or q.field not in fields for q in leaves)

    def scored(self, tree: Query, least: float = float("-inf")) -> DataFrame:
        """(key, score) of matching documents whose impact is `least` or more."""
        look = P.Lookup(self.docs, tree, self.written, self.key, "impact")
        rows = self.table if least == float("-inf") else self.table.where(F.col("impact") >= least)
        look.fields = look.fields | {"impact": None}
        return look.found(rows, ("impact",)).where(look.match(tree)).select(self.key, look.score(tree).alias("score"))

    def bound(self, tree: Query, k: int) -> float:
        """The least impact of a document among the best k."""
        *some, most = self.shares()
        for least in some:
            best = self.scored(tree, least).orderBy(F.desc("score"), self.key).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
            if best["n"] == k:
                return min(least, needed(tree, best["score"], most))
        return float("-inf")

    def best(self, tree: Query, start: int = 0, rows: int = 10) -> DataFrame:
        """The documents from place `start` on with their scores, best first, ties by key."""
        found = self.scored(tree, self.bound(tree, start + rows)).orderBy(F.desc("score"), self.key).limit(start + rows).offset(start)
        top = [(r[self.key], r["score"]) for r in found.collect()]  # `rows` of them
        named = self.docs.sparkSession.createDataFrame(top, self.docs.select(F.col(self.key).alias("__key"), F.lit(0.0).alias("score")).schema)
        docs = self.docs.where(F.col(self.key).isin([k for k, _ in top])) if len(top) <= NAMED else self.docs
        return docs.join(F.broadcast(named), F.col(self.key) == F.col("__key")).drop("__key").orderBy(F.desc("score"), self.key)


def search_best(docs: DataFrame, table: DataFrame, query: str, options: Options | None = None, start: int = 0, rows: int | None = 10, key: str = "PageId") -> DataFrame:
    """What operators.search.search() gives as docs, from postings with impacts; filters on written fields are terms that must be found."""
    from ancestra.operators import search as S

    o = options or Options()
    tree = rewritten(parse(query, o), o)
    best = Best(docs, table, key)
    filtered = Bool(((MUST, tree), *((MUST, Term(f, v, 0.0)) for f, v in o.filters))) if o.filters else tree
    if rows is None or o.sort or not best.able(filtered):
        return S.search(docs, query, o, start, rows, key=key, postings=table).docs
    return best.best(filtered, start, rows)
