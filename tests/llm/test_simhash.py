import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ancestra.llm import simhash
from ancestra.llm.components import components


def plain(text):
    """The fingerprint, bit by bit."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def grouped(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    prints = [plain(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    group = grouped(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(d, least.get(group[i], d))
    return [(rows[i][0], f"{prints[i]:016x}", least.get(group[i])) for i in range(len(rows))]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = " ".join(t)
        else:
            t = " ".join(rng.choices(words, k=rng.choice([1, 2, 30, 150, 300])))
        texts.append(t)
        rows.append((1000 - i, t))
    return rows


def test_fingerprint():
    for t in ["", "a", "A b", "a b c", "The cat sat on the mat " * 9, "é\x0bÄ ö x y", "x " * 200_000]:
        assert simhash.fingerprint(t.encode()) == plain(t)


def test_bk_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for _ in range(12)]))
    rng.shuffle(values)
    for radius in (0, 1, 2, 5):
        want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if int(values[i] ^ values[j]).bit_count() <= radius]
        assert simhash.bk_pairs(values, radius) == want


def test_bands_cover_the_radius():
    masks = simhash.bands(2)
    rng = random.Random(1)
    for _ in range(300):
        x = (1 << rng.randrange(64)) | (1 << rng.randrange(64))
        assert any(not x & m for m in masks)


def test_against_brute_force(spark):
    rows = corpus(250)
    df = spark.createDataFrame([(d, t, "c") for d, t in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t"), (2, "z")]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    rows = [*corpus(150, 4), (None, "only null"), (None, "only null"), (1, None), (0, "")]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], "doc_id long, text string, fp string, id string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert got == sorted({c for _, _, c in brute(rows)}, key=repr)


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {"chain": [(i, i + 1) for i in range(60)], "star": [(99, i) for i in range(50)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(70)], "none": [(4, 4), (None, 3)]}[shape]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    clean = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    assert got == grouped({n for x in clean for n in x}, clean)


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def near_copies(seed=3):
    """Texts of 150 words in families: (family, text); a copy has a word changed or none."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(5000)]
    rows = []
    for family in range(60):
        base = rng.choices(words, k=150)
        for _ in range(rng.choice([1, 1, 2, 5])):
            t = list(base)
            for _ in range(rng.randrange(2)):
                t[rng.randrange(150)] = rng.choice(words)
            rows.append((family, " ".join(t)))
    return rows


def test_similar_texts_are_found_and_others_kept(spark):
    rows = near_copies()
    df = spark.createDataFrame([(500 - i, t, "x", i) for i, (_, t) in enumerate(rows)], "doc_id long, text string, node string, mark int")
    kept = simhash.keep_similar(df)
    assert kept.columns == df.columns
    first = {}
    for i, (family, _) in enumerate(rows):
        first[family] = min(500 - i, first.get(family, 999))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())


def test_distance_follows_similarity():
    rows = near_copies(5)
    for (_, a), (_, b) in zip(rows, rows[1:]):
        x, y = shingles(a), shingles(b)
        j = len(x & y) / len(x | y)
        d = int.from_bytes(simhash.set_fingerprint(a.encode()), "little") ^ int.from_bytes(simhash.set_fingerprint(b.encode()), "little")
        assert abs(d.bit_count() - simhash.BITS * simhash.differing(j)) < 30
    assert simhash.differing(1) == 0 and 35 < simhash.BITS * simhash.differing(0.8) < 42


@pytest.mark.parametrize("block", [8, 4096])
def test_large_class_of_near_copies(spark, block, monkeypatch):
    rng = random.Random(4)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(150):
        t = list(base)
        t[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(t)))
    monkeypatch.setattr(simhash, "BLOCK", block)
    assert [r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_similar_edge_cases(spark):
    rows = [(5, None), (3, ""), (9, " \t"), (None, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (None, "q r s t"), (None, "q r s t"), (2, "z"), (8, "w " * 100_000)]
    got = [r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([3, 7, None, 2, 8], key=repr)
    assert simhash.keep_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def overlapping(shared, seed=6, words=104):
    """Two texts that share so many of their first words, and their exact similarity."""
    rng = random.Random(seed)
    base = [f"s{rng.randrange(10**6)}" for _ in range(words)]
    other = base[:shared] + [f"t{rng.randrange(10**6)}" for _ in range(words - shared)]
    a, b = shingles(" ".join(base)), shingles(" ".join(other))
    return " ".join(base), " ".join(other), len(a & b) / len(a | b)


def test_links_are_exact_at_the_similarity(spark):
    rows, want = [], set()
    for seed in range(120):
        a, b, j = overlapping(80 + seed % 20, seed)
        rows += [(2 * seed, a), (2 * seed + 1, b)]
        want |= {2 * seed} if j >= 0.8 else {2 * seed, 2 * seed + 1}
    got = {r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got  # no text without a partner goes
    assert len(got - want) <= 4  # pairs that meet in no shard


def test_radius_keeps_candidates_at_the_similarity():
    lost = 0
    for seed in range(400):
        a, b, j = overlapping(93, seed)
        assert 0.8 <= j < 0.81
        d = int.from_bytes(simhash.set_fingerprint(a.encode()), "little") ^ int.from_bytes(simhash.set_fingerprint(b.encode()), "little")
        lost += d.bit_count() > simhash.radius_for(0.8)
    assert lost <= 6


def test_recall_just_above_the_similarity(spark):
    pairs = [(a, b) for a, b, j in (overlapping(93, seed) for seed in range(1000, 1500)) if 0.8 <= j < 0.81]
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    got = {r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(pairs) > 400 and {2 * i for i in range(len(pairs))} <= got
    assert len(got) - len(pairs) <= 0.04 * len(pairs)


def test_recall_on_the_documents(spark):
    """Against the exact similarity of all pairs that share a shingle."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, where = {}, {}
    for r in docs.select("doc_id", "text").collect():
        sets.setdefault(simhash.shingle_set((r.text or "").encode()).tobytes(), []).append(r.doc_id)
    keys = [np.frombuffer(k, dtype=np.uint64) for k in sets]
    for i, k in enumerate(keys):
        for x in k.tolist():
            where.setdefault(x, []).append(i)
    shared = {}
    for together in where.values():
        for x, i in enumerate(together):
            for j in together[x + 1 :]:
                shared[i, j] = shared.get((i, j), 0) + 1
    near = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(keys[i]) + len(keys[j]) - n)]
    ids = list(sets.values())
    rows, found = simhash.similar_classes(docs.selectExpr("doc_id as id", "text"), 0.8, 5)
    of = dict(rows.join(found.withColumnRenamed("node", "fn"), rows["node"] == F.col("fn")).select("id", "component_id").collect())
    true = grouped(range(len(ids)), near)
    assert near and sum(of[ids[i][0]] == of[ids[j][0]] for i, j in near) >= 0.95 * len(near)
    assert all(true[i] == true[j] for i, j in near) and len({of[x] for own in ids for x in own}) >= len(set(true.values()))


def test_links_where_the_first_bit_differs(spark):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rng = random.Random(7)
    pairs = []
    for bit in range(63):
        x = rng.getrandbits(64)
        pairs.append((x, x ^ 1 << 63 ^ 1 << bit))
    x = rng.getrandbits(64)
    far = (x, x ^ 7 << 61)  # three bits
    values = np.array([signed(v) for p in [*pairs, far] for v in p])
    near = [(2 * i, 2 * i + 1) for i in range(63)]
    assert [p for p in simhash.bk_pairs(values, 2)] == near
    frame = spark.createDataFrame([(int(v),) for v in values], "fp long")
    got = {tuple(sorted(r)) for r in simhash.links(frame, 2).collect()}
    assert got == {tuple(sorted(map(signed, p))) for p in pairs}


@pytest.mark.parametrize("keep", [simhash.keep_similar, simhash.keep_one])
def test_classes_of_null_or_equal_ids_each_keep_a_row(spark, keep):
    rng = random.Random(9)
    texts = [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[3])]
    got = [tuple(r) for r in keep(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=repr) == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3])], key=repr)


def test_all_pairs_of_a_large_shard_meet(spark, monkeypatch):
    rng = random.Random(10)
    texts = []
    for _ in range(40):  # pairs of near copies, all with an equal fingerprint but for a bit
        words = [f"p{rng.randrange(10**6)}" for _ in range(104)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    folder = simhash.fresh_path(spark, "sets")
    fs, top = simhash.filesystem(folder)
    fs.create_dir(top, recursive=True)
    rows, at = [], 0
    with fs.open_output_stream(f"{top}/1") as out:
        order = list(range(0, 80, 2)) + list(range(1, 80, 2))  # partners are 40 apart in byte order
        for rank, i in enumerate(order):
            out.write(len(sets[i]).to_bytes(8, "little") + sets[i].tobytes())
            rows.append((1 << simhash.WORD_BITS | at, bytearray([rank, *[0] * 31])))
            at += 1 + len(sets[i])
    monkeypatch.setattr(simhash, "BLOCK", 8)
    monkeypatch.setattr(simhash, "choices", lambda *_: np.arange(200, 212)[None, :])  # bits that all share: one shard
    frame = spark.createDataFrame(rows, "node long, fp binary").repartition(3)
    got = {tuple(sorted(r)) for r in simhash.similar_links(frame, len(rows), 0.8, folder).collect()}
    assert got == {(rows[k][0], rows[k + 40][0]) for k in range(40)}
