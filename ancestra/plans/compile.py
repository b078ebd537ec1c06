"""Query trees as Columns: a predicate and a score over documents whose fields are arrays of terms (or strings)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ast import MUST, MUST_NOT, SHOULD, Bool, DisMax, Fuzzy, Phrase, Popularity, Prefix, Query, Range, Term, Wildcard


class Compiler:
    """Compiles for one document schema; a field that the schema hasn't matches nothing."""

    def __init__(self, docs: DataFrame, popularity: str = "Popularity"):
        self.fields = {f.name: f.dataType for f in docs.schema.fields}
        self.popularity = popularity

    def any_term(self, field: str, test) -> Column:
        """Whether a term of the field passes the test; never null."""
        if field not in self.fields:
            return F.lit(False)
        found = F.exists(F.col(field), test) if isinstance(self.fields[field], T.ArrayType) else test(F.col(field))
        return F.coalesce(found, F.lit(False))

    @classmethod
    def test(cls, q: Query, x: Column) -> Column:
        """Whether one term is what a query of single terms asks for."""
        match q:
            case Term(_, text):
                return x == text
            case Prefix(_, text):
                return x.startswith(text)
            case Wildcard(_, text):
                pattern = re.sub(r"([\\%_])", r"\\\1", text).replace("*", "%").replace("?", "_")
                return x.like(pattern)
            case Range(_, low, high):
                return x.between(low, high)
            case Fuzzy(_, text, least):
                return cls.similarity(x, text) > least
        raise TypeError(q)

    def match(self, q: Query) -> Column:
        match q:
            case Term(field, text):
                if isinstance(self.fields.get(field), T.ArrayType):
                    return F.coalesce(F.array_contains(F.col(field), text), F.lit(False))
                return self.any_term(field, lambda x: self.test(q, x))
            case Phrase(field, words):
                if not isinstance(self.fields.get(field), T.ArrayType):
                    return self.any_term(field, lambda x: x == " ".join(words))
                joined = F.concat(F.lit(" "), F.array_join(F.col(field), " "), F.lit(" "))
                return F.coalesce(F.contains(joined, F.lit(f" {' '.join(words)} ")), F.lit(False))
            case Prefix() | Wildcard() | Range() | Fuzzy():
                return self.any_term(q.field, lambda x: self.test(q, x))
            case Popularity():
                return F.lit(True)
            case DisMax(queries):
                return self._any([self.match(x) for x in queries])
            case Bool(clauses):
                need = [self.match(x) for o, x in clauses if o == MUST]
                never = [~self.match(x) for o, x in clauses if o == MUST_NOT]
                some = [self.match(x) for o, x in clauses if o == SHOULD]
                parts = need + never + ([self._any(some)] if not need and some else [])
                if not need and not some:
                    return F.lit(False)
                out = parts[0]
                for p in parts[1:]:
                    out = out & p
                return out
        raise TypeError(q)

    @staticmethod
    def _any(columns: list[Column]) -> Column:
        out = F.lit(False)
        for c in columns:
            out = out | c
        return out

    @staticmethod
    def similarity(x: Column, text: str) -> Column:
        """One less the edit distance over the shorter length."""
        return Compiler.similarity_of(x, F.lit(text))

    @staticmethod
    def similarity_of(x: Column, y: Column) -> Column:
        return 1 - F.levenshtein(x, y) / F.least(F.length(x), F.length(y))

    def score(self, q: Query) -> Column:
        """0 where it doesn't match: a sum over matching clauses, a maximum over disjuncts; a term gives its boost."""
        zero = F.lit(0.0)
        match q:
            case Popularity():
                return F.coalesce(F.col(self.popularity), F.lit(0)) / 1024 * q.boost if self.popularity in self.fields else zero
            case DisMax(queries):
                parts = [self.score(x) for x in queries]
                best = F.greatest(*parts) if len(parts) > 1 else parts[0] if parts else zero
                return best * q.boost
            case Bool(clauses):
                total = zero
                for occur, x in clauses:
                    if occur != MUST_NOT:
                        total = total + self.score(x)
                return F.when(self.match(q), total * q.boost).otherwise(zero)
            case Fuzzy(field, text, least):
                if field not in self.fields:
                    return zero
                each = F.array_max(F.transform(F.col(field), lambda x: self.similarity(x, text))) if isinstance(self.fields[field], T.ArrayType) else self.similarity(F.col(field), text)
                return F.when(self.match(q), q.boost * (each - least) / (1 - least)).otherwise(zero)
        return F.when(self.match(q), q.boost).otherwise(zero)
