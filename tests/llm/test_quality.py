import random

import numpy as np
import pytest

from ancestra.llm import quality


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    good, bad = [f"word{i}" for i in range(300)], [f"JUNK{i}!!" for i in range(300)]
    return [(i, " ".join(rng.choices(bad if i % 5 == 0 else good, k=rng.randrange(20, 80)))) for i in range(n)]


def frames(spark, rows, labels):
    d = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, log_weight double, good boolean")
    return d, spark.createDataFrame(labels, "doc_id long, quality int")


def test_rejects_junk_and_keeps_the_rest(spark):
    rows = corpus()
    d, l = frames(spark, rows, [(i, int(i % 5 != 0)) for i, _ in rows if i % 2])
    got = {r.doc_id: r for r in quality.classify(d, l).collect()}
    held = [i for i, _ in rows if i % 2 == 0]
    assert all(got[i].accepted == (i % 5 != 0) for i in held)
    kept = quality.keep_accepted(d, l)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in got if got[i].accepted)


def test_weights_are_those_of_plain_counts(spark):
    rows = corpus(60)
    labels = [(i, int(i % 5 != 0)) for i, _ in rows]
    d, l = frames(spark, rows, labels)
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in rows:
        n = np.bincount(quality.features(t.encode()), minlength=quality.BUCKETS)
        raw += n
        target += n * (i % 5 != 0)
    weights = quality.ratios(target, raw)
    got = quality.classify(d, l, k=10).collect()
    keys = {i: weights[quality.features(t.encode())].sum() + quality.gumbel(i) for i, t in rows}
    assert {r.doc_id: r.gumbel_key for r in got} == pytest.approx(keys)
    assert {r.doc_id for r in got if r.accepted} == set(sorted(keys, key=keys.get)[-10:])


def test_bigrams_are_of_neighbours():
    assert len(quality.features(b"a b, c")) == 7
    assert not (quality.features(b"x y") == quality.features(b"y x")).all()


@pytest.mark.parametrize("k", [0, 1, 3, 7, 8, 99])
def test_kth_largest(spark, k):
    values = [3.5, -1.0, 3.5, 1e-300, 2e-300, 7.0, 7.0, -1e308]
    df = spark.createDataFrame([(v,) for v in values], "__key double")
    got = quality.kth_largest(df, k, bins=2)
    want = float("inf") if k == 0 else float("-inf") if k >= len(values) else sorted(values)[-k]
    assert got == want


def test_gumbel_sampling_follows_the_weights():
    weights = np.log(np.array([8.0, 4.0, 2.0, 1.0]))
    first = np.zeros(4)
    for seed in range(3000):
        first[np.argmax([w + quality.gumbel(i, seed) for i, w in enumerate(weights)])] += 1
    assert first / 3000 == pytest.approx(np.array([8, 4, 2, 1]) / 15, abs=0.03)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b"), (4, "x " * 100_000), (5, "\n\t")]
    d, l = frames(spark, rows, [(3, 1), (3, 0), (None, 1), (4, None), (9, 1)])
    got = quality.classify(d, l).collect()
    assert len(got) == len(rows) and all(r.accepted is not None for r in got)
    assert all(r.accepted for r in quality.classify(d, l.limit(0)).collect())
    assert quality.classify(d.limit(0), l).count() == 0 and quality.keep_accepted(d.limit(0), l.limit(0)).count() == 0
