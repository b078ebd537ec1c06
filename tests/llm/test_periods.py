import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ancestra.llm import periods
from ancestra.llm import queries as registered


def plain_runs(words, times=4, least=6):
    """All periods one after the other, word by word."""
    out = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, size, q) for (s, size), q in out.items())


@pytest.mark.parametrize("seed", range(12))
def test_find_runs_equals_plain(seed):
    r = random.Random(seed)
    for _ in range(60):
        words = []
        while len(words) < r.choice((0, 3, 7, 40, 150)):
            base = [r.randrange(r.choice((1, 2, 3, 9))) for _ in range(r.randrange(1, 9))]
            words += base * r.choice((1, 1, 3, 4, 5, 9)) + base[: r.randrange(len(base))]
        got = [tuple(x) for x in periods.find_runs(np.array(words, dtype=np.int64)).tolist()]
        assert got == plain_runs(words)


def test_one_word_only_and_a_wrong_hash(monkeypatch):
    assert periods.find_runs(np.zeros(20_000, dtype=np.int64)).tolist() == [[0, 20_000, 1]]
    words = np.array([1, 2, 3] * 5 + [4, 5] * 5)
    want = [list(x) for x in plain_runs(words.tolist())]
    true = periods.PrefixHashes.equal
    # The first bases call every two stretches of five words equal; comparing words shows it, and other bases are taken.
    monkeypatch.setattr(periods.PrefixHashes, "equal", lambda self, x, q, n: true(self, x, q, n) | ((n == 5) & (self.levels[0][1][1] == 911_382_323 + 500)))
    assert periods.find_runs(words).tolist() == want


def digest(doc_id, text):
    words = [] if text is None else text.encode().split()
    n, h = len(words), None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if n and h is not None and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_equals_plain(spark, tmp_path):
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(("ab", "cd", "é", "x.")) for _ in range(r.choice((0, 1, 5, 30, 400))))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, " \n\t "), (203, "a b " * 3000), (203, "a b " * 3000), (None, "q " * 7), (204, "a\x0bb\x0cc\rd"), (205, "u v w x " * 4 + "y " + "u v w x " * 4)]
    spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id long, text string, runs int").write.parquet(f"{tmp_path}/documents.parquet")
    got = registered.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(digest(i, t)) for i, t in texts)


def test_whole_table_equals_plain(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: tuple(r) for r in registered.op11_periodic_runs(spark, folder).collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect() if len((r["text"] or "").split()) < 600]
    assert rows and all(got[i] == digest(i, t) for i, t in rows)


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([("z z z z z z z", 5, "x")], "text string, Collapsed int, batch string")
    out = periods.mark_runs(docs)
    assert out.columns == ["text", "batch", "runs", "collapsed"]
    assert out.collect()[0].asDict(True) == {"text": "z z z z z z z", "batch": "x", "runs": [{"start": 0, "length": 7, "period": 1}], "collapsed": "z"}
    assert periods.digest(periods.mark_runs(docs.where("false").withColumn("doc_id", docs["batch"]))).count() == 0
