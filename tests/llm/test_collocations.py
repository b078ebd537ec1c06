import random
import re
from collections import Counter

from ancestra.llm import collocations


def plain(rows, max_n=4, least=30, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                for i in range(len(w) - k + 1):
                    f.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        hidden = {p[i : i + m] for p, a in cand.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * counts[p[i : i + m]]}
        kept = []
        for p, a in cand.items():
            if p not in hidden:
                score, _, left, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), left, r))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def some_rows():
    r = random.Random(5)
    words = ["the", "of", "new", "york", "times", "é", "x|y", "THE", "a#"] + [f"w{i}" for i in range(40)]
    rows = []
    for i in range(400):
        text = ""
        for _ in range(r.randrange(0, 60)):
            text += r.choice(("new york times", "of the", "the  new", r.choice(words), "The New\tYork", "a a a")) + r.choice((" ", " ", " ", ". ", ",", "\n", "\r\n", "\x0b"))
        rows.append((r.choice(("en", "en", "en", "de", None)), text))
    return [*rows, ("en", None), ("en", ""), (None, " . "), ("de", "new york " * 5000), *[("xx", "same words here again")] * 30]


def test_equals_plain(spark):
    rows = some_rows()
    docs = spark.createDataFrame([(lang, text, "f", 1) for lang, text in rows], "lang string, text string, phrase string, n int")
    want = plain(rows)
    assert len(want) > 20 and any(len(x[2].split()) == 4 for x in want) and any(x[0] == "xx" for x in want)
    assert sorted(map(tuple, collocations.mine(docs.repartition(5)).collect())) == want
    assert sorted(map(tuple, collocations.mine(docs, prune=False).collect())) == want
    assert sorted(map(tuple, collocations.mine(docs, least=3, top=7, max_n=3).collect())) == plain(rows, 3, 3, 7)


def test_a_full_bitmap_only_lets_more_rows_through(spark, monkeypatch):
    rows = some_rows()[:150]
    docs = spark.createDataFrame(rows, "lang string, text string")
    full = lambda found: collocations.np.full(1 << collocations.BITMAP, 2**64 - 1, dtype=collocations.np.uint64)
    monkeypatch.setattr(collocations, "bitmap", full)
    assert sorted(map(tuple, collocations.mine(docs).collect())) == plain(rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(docs).collect() == []


def test_exact_beyond_64_bits(spark):
    score = spark.range(1).selectExpr("(cast(2000000 as decimal(10,0)) * cast(9000000000000001 as decimal(20,0))) div (cast(9000000000000001 as decimal(20,0)) + cast(9000000000000002 as decimal(20,0))) as s").collect()[0]["s"]
    assert score == 2000000 * 9000000000000001 // (9000000000000001 + 9000000000000002)
