import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ancestra.llm import lm
from ancestra.llm.eliasfano import EliasFano, to_bytes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 40) - 1), max_size=200), st.lists(st.integers(0, (1 << 40) - 1), min_size=1, max_size=50))
def test_elias_fano(values, asked):
    v = np.array(sorted(values), dtype=np.uint64)
    e, _ = EliasFano.view(np.frombuffer(to_bytes(EliasFano.build(v, 1 << 40).arrays()), dtype=np.uint8), 0)
    assert e[np.arange(len(v))].tolist() == v.tolist()
    q = np.array([*asked, *values], dtype=np.uint64)
    assert e.successor(q).tolist() == np.searchsorted(v, q).tolist()
    assert (e.find(q) >= 0).tolist() == np.isin(q, v).tolist()


def words_of(text):
    lowered = (text or "").encode().lower()
    return [*lowered.split(), None]


def brute(rows, held, prior=lm.PRIOR, prior3=lm.PRIOR3):
    """(n_tokens, n_known, N, base, score) of each row, from plain counters."""
    one, two, three, texts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if not held(i):
            w = words_of(t)
            texts += 1
            one.update(w)
            two.update(zip([0, *w[:-1]], w, strict=True))
            three.update(zip([0, *w], w, w[1:], strict=False))
    total, distinct = sum(one.values()), len(one)
    p1 = lambda w: (one.get(w, 0) + 1) / (total + distinct + 1)
    out = []
    for i, t in rows:
        w = words_of(t)
        base = sum(math.log10(p1(x)) for x in w)
        value, before = 0.0, None
        for u, x in zip([0, *w[:-1]], w, strict=True):
            p = (two.get((u, x), 0) + prior * p1(x)) / ((one.get(u, 0) if u != 0 else texts) + prior)
            if before is not None and (before, u) in two:
                p = (three.get((before, u, x), 0) + prior3 * p) / (two[before, u] + prior3)
            value += math.log10(p)
            before = u
        out.append((i, held(i), len(w), sum(x in one for x in w), total, base, value))
    return out


def check(spark, rows, tmp_path, shards="4", held=lm.held_out):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        df = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
        got = sorted(map(tuple, lm.train_and_score(df, str(tmp_path / f"m{shards}"), held).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = sorted(brute(rows, held), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    drift = sum(g[6] - w[6] for g, w in zip(got, want, strict=True)) / max(1, sum(w[2] for w in want))
    assert abs(drift) < 0.012  # roundings even out; a missing back-off would not
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert abs(g[6] - w[6]) <= 0.06 * w[2] + 1e-9  # two roundings of 0.025 a token at most


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["É", "the", "The", "a.", "ÄB"]
    return [(i, " ".join(rng.choices(vocab, weights=[30] * 3 + [1] * (len(vocab) - 3), k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("shards", ["1", "7"])
def test_against_counters(spark, tmp_path, shards):
    check(spark, corpus(150), tmp_path, shards)


def test_edge_cases(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a b a b"), (5, "A b\x0bA\x0cb"), (5, "A b\x0bA\x0cb"), (6, "x " * 200_000), (7, "  a b")]
    check(spark, rows, tmp_path)


def test_all_held_out_and_empty(spark, tmp_path):
    check(spark, corpus(10), tmp_path, held=lambda i: True)
    assert lm.train_and_score(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "none")).count() == 0


def test_split_contexts_and_held_out_gain(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i in range(300):  # chains: each word is followed by one of two
        w, out = rng.randrange(40), []
        for _ in range(50):
            out.append(f"t{w}")
            w = (w * 7 + rng.randrange(2)) % 40
        rows.append((i, " ".join(out)))
    got = lm.train_and_score(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "chain")).where("held_out").toPandas()
    assert (got["score"] > 0.5 * got["base_score"]).all() and len(got) > 20


def test_held_out():
    assert [lm.held_out(i) for i in range(50)] == [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(50)]


@pytest.mark.parametrize("distinct, count", [(10**9, 10**12), (2**32 - 3, 10**13), (3, 10**12), (7, 1)])
def test_places_neither_overflow_nor_fall(distinct, count):
    words = lm.Words("", 0, {0: (distinct, 5 * count)})
    g = lm.Grams("", words, 10, 100, 1.0, 1.0)
    ids = np.unique(np.linspace(0, distinct - 1, 50).astype(np.int64))
    for k in range(5):
        got = g.place(np.full(len(ids), k * count), np.full(len(ids), count), ids)
        assert got.tolist() == [(k * count + count * i // distinct) // g.per for i in ids.tolist()]


def test_too_many_words():
    with pytest.raises(ValueError):
        lm.Grams("", lm.Words("", 0, {0: (2**32, 2**33)}), 1, 1, 1.0, 1.0)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 2**33), st.integers(1, 2**40)), min_size=1, max_size=50))
def test_blobs(rows):
    a, b, n = (np.array(x, dtype=np.uint64) for x in zip(*rows, strict=True))
    order = lm.ordered(a, b)
    assert list(zip(a[order].tolist(), b[order].tolist(), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
    a, b, n = a[order], b[order], n[order]
    got = list(lm.shard_runs(lm.blobs(np.zeros(len(a), dtype=np.int64), a, b, n, most=7), 3))
    assert [np.concatenate(x).tolist() for x in zip(*got[0][1], strict=True)] == [a.tolist(), b.tolist(), n.tolist()]
