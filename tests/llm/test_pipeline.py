"""The pipeline on a small corpus, against the operators' brute-force versions."""

import hashlib
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest

from ancestra.llm import bpe, decontam, quality, simhash

ROOT = Path(corpus_pipeline.__file__).parent


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    import random

    rng = random.Random(8)
    at = tmp_path_factory.mktemp("tables")
    words, junk = [f"word{i}" for i in range(400)], [f"JUNK{i}%%" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=14))) for i in range(5)]
    rows = []
    for i in range(300):
        text = " ".join(rng.choices(junk if i % 6 == 0 else words, k=60))
        if i % 6 and i % 7 == 0:
            text += " " + items[i % 5][1]
        if i % 6 and i % 11 == 0:
            text = rows[i - 1][1]
        rows.append((i, text, "en", "s", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int").write.parquet(str(at / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(at / "benchmark.parquet"))
    return str(at), rows, items


def test_run(spark, tables):
    at, rows, items = tables
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    found = {i: quality.features((t or "").encode()) for i, t, *_ in rows}
    for i, f in found.items():
        n = np.bincount(f, minlength=quality.BUCKETS)
        raw += n
        target += n * (i < 300 and i % 2 == 0 and i % 6 != 0)
    weights = quality.ratios(target, raw)
    weight = {i: weights[f].sum() for i, f in found.items()}
    labelled = range(0, 300, 2)
    cut = quality.threshold(np.array([weight[i] for i in labelled if i % 6]), np.array([weight[i] for i in labelled if i % 6 == 0]))
    k = sum(w >= cut for w in weight.values())
    kept = [r for r in rows if r[0] in sorted(weight, key=lambda i: weight[i] + quality.gumbel(i))[-k:]]
    sets = [set(simhash.shingle_set((t or "").encode()).tolist()) for _, t, *_ in kept]
    first, classes = [], []  # ids rise; a class is what exact similarity connects
    for j, r in enumerate(kept):
        near = [c for c in classes if any(sets[j] == sets[p] or len(sets[j] & sets[p]) >= 0.8 * len(sets[j] | sets[p]) for p in c)]
        classes = [c for c in classes if c not in near] + [[p for c in near for p in c] + [j]]
    first = [kept[min(c)] for c in sorted(classes, key=min)]
    clean = [r for r in first if not decontam.brute(r[1], items)[4]]
    encoder = bpe.encoder(open(bpe.default_path(), encoding="utf-8").read())
    want = []
    for i, t, *_ in clean:
        ids = encoder.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, at).collect()))
    assert got == sorted(want) and 150 < len(got) < 270
    assert {i for i, *_ in got} >= {i for i in range(300) if i % 6 and i % 7 and i % 11}
    assert not {i for i, *_ in got} & {i for i in range(300) if i % 6 == 0}


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), tables[0]).schema.names == docs.columns


def test_the_rest_works_without_this_part(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse", ".hypothesis"))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"], cwd=copy, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and said.stdout.split()[2] == "False" and int(said.stdout.split()[0]) > 60, said.stderr[-500:]
