import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from ancestra.llm import bpe, tokencounts as tc

SCORES = {b"a": -10, b"b": -12, b"ab": -15, b"abc": -30, b"c": -11, b"bc": -18, b"ca": -21, b" a": -14, b" ": -9}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet="abc d", max_size=12), max_size=20))
def test_trie_agrees_with_plain_segmentation(words):
    counter = tc.TrieCounter(SCORES)
    small = tc.TrieCounter(SCORES, most_nodes=8)
    for w in words:
        want = tc.segment_count(w.encode(), SCORES, counter.unknown)
        assert counter.count(w.encode()) == want == small.count(w.encode())


def test_shared_prefixes_are_scored_once():
    c = tc.TrieCounter(SCORES)
    for w in (b"abcabc", b"abcabb", b"abc", b"abcabc"):
        c.count(w)
    assert c.scored == 7


def test_scores_fall_with_rank():
    s = tc.zipf_scores({b"x": 0, b"y": 1, b"z": 9})
    assert s[b"x"] > s[b"y"] > s[b"z"] and tc.zipf_scores({}) == {}


def test_documents(spark):
    ranks = tc.parse_ranks(open(tc.default_ranks_path()).read())
    scores = tc.zipf_scores(ranks)
    unknown = tc.TrieCounter(scores).unknown
    rng = random.Random(1)
    rows = [(1, None), (2, ""), (None, "Hello world 123!"), (3, "same text é日"), (3, "same text é日"), (4, "x" * 5000), (5, " ".join("".join(rng.choices("etaoin", k=5)) for _ in range(3000)))]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, tc.count_tokens(df, scores).collect()), key=repr)
    want = []
    for i, t in rows:
        words = regex.findall(bpe.PATTERN, t or "")
        want.append((i, len(words), len((t or "").encode()), sum(tc.segment_count(w.encode(), scores, unknown) for w in words)))
    assert got == sorted(want, key=repr)
    assert tc.count_tokens(df.limit(0), scores).count() == 0
