import numpy as np
import pytest

from ancestra.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, least=0.98):
    ok = [i for i, (d, v, l) in enumerate(rows) if d is not None and l is not None and v is not None and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))
    for a in ok:
        for b in ok:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(np.array(rows[k][1], dtype=np.float32), dtype=float) for k in (a, b))
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                    n[a] += 1
                    ra, rb = a, b
                    while root[ra] != ra:
                        ra = root[ra]
                    while root[rb] != rb:
                        rb = root[rb]
                    root[max(ra, rb)] = min(ra, rb)
    low = {}
    find = lambda k: k if root[k] == k else find(root[k])
    for i in ok:
        low[find(i)] = min(rows[i][0], low.get(find(i), rows[i][0]))
    out = []
    for i, (d, _, _) in enumerate(rows):
        c = low[find(i)] if i in ok else d
        out.append((d, n[i], c, d == c))
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "c") for r in rows], SCHEMA)
    return sorted(map(tuple, embeddings.near_duplicates(df, **options).collect()), key=repr)


def cloud(n, dim, seed, near=0.5, noise=0.05):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < near:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.normal(0, noise * rng.choice([0, 1, 3]), dim)
        else:
            v = rng.normal(0, 1, dim)
        rows.append((n - i, [float(x) for x in np.float32(v)], int(rng.integers(3))))
    return rows


def test_all_links_where_blocks_hold_all(spark):
    rows = cloud(300, 16, 1)
    assert run(spark, rows) == sorted(brute(rows), key=repr)


def test_links_are_counted_once_over_many_blocks(spark):
    rows = cloud(400, 16, 2, near=0.8)
    got, want = run(spark, rows, block=16, missed=1e-4), sorted(brute(rows), key=repr)
    for g, w in zip(got, want, strict=True):
        assert g[0] == w[0] and g[1] <= w[1]
    assert sum(g[1] for g in got) >= 0.999 * sum(w[1] for w in want)
    assert np.mean([g[2] == w[2] for g, w in zip(got, want, strict=True)]) >= 0.99


@pytest.mark.parametrize("block", [4, 512])
def test_edge_cases(spark, block):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1),
        (11, [1.0, 0.0, 0.0], 1), (12, [], 1), (13, [-1.0, 0.0], 1), (14, [3e38, 0.0], 1), (15, [1e-38, 0.0], 1),
    ]
    assert run(spark, rows, block=block) == sorted(brute(rows), key=repr)
    assert run(spark, []) == []


@pytest.mark.parametrize("block", [32, 100])
def test_large_group_of_near_copies(spark, block):
    """All links of a group many times a block, next to other vectors."""
    rng = np.random.default_rng(7)
    base = rng.normal(0, 1, 32)
    rows = [(i, [float(x) for x in np.float32(base + rng.normal(0, 0.02, 32))], 0) for i in range(700)]
    rows += [(1000 + i, [float(x) for x in np.float32(rng.normal(0, 1, 32))], 0) for i in range(300)]
    got = run(spark, rows, block=block)
    assert {g[2] for g in got if g[0] < 1000} == {0}
    assert sum(g[1] for g in got) >= 0.9999 * 700 * 699


def test_schedule():
    assert embeddings.schedule(2048, 0.98) == (0, 1) and embeddings.schedule(0, 0.98) == (0, 1)
    digits, passes = embeddings.schedule(10**9, 0.98)
    met = (1 - np.arccos(0.98) / np.pi) ** digits
    assert 10**9 / 2**digits <= 2048 and (1 - met) ** passes <= 1e-4 < (1 - met) ** (passes - 1)


def test_keys_are_the_same_in_any_batch():
    x = np.random.default_rng(1).normal(0, 1, (500, 64))
    x = np.float32(x).astype(float)
    whole = embeddings.keys(x, 6, 20)
    assert all((embeddings.keys(x[i : i + 1], 6, 20) == whole[i]).all() for i in range(500))
