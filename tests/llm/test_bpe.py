import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ancestra.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
VOCABULARY = open(bpe.default_path(), encoding="utf-8").read()
MINE, THEIRS = bpe.ForcedBoundaryBPE(VOCABULARY), tokenizers.Tokenizer.from_str(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_encodes_and_decodes_as_the_library(s):
    ids = MINE.encode(s)
    assert ids == THEIRS.encode(s, add_special_tokens=False).ids
    assert MINE.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False) == s


@pytest.mark.parametrize("s", ["", "<|endoftext|>", "a<|endoftext|> b", " \n\t x  ", "don't WE'LL 123½", "日本語🙂", "a" * 3000, " " * 999, "é​\x00", "The <|endoftext|<|endoftext|>"])
def test_odd_texts(s):
    assert MINE.encode(s) == THEIRS.encode(s, add_special_tokens=False).ids and MINE.decode(MINE.encode(s)) == s


def test_cuts_are_between_tokens():
    word = "xqzjkvbé日qqq".encode()
    parts = MINE.fragments(word)
    assert b"".join(parts) == word and len(parts) > 1
    assert [i for p in parts for i in MINE.merge(p)] == MINE.merge(word)


def test_documents(spark):
    texts = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "long " * 50_000, "w")]
    df = spark.createDataFrame([(i, t, n, 5) for i, t, n in texts], "doc_id long, text string, ids_sha256 string, n_tokens int")
    got = sorted(map(tuple, bpe.encode_documents(df, VOCABULARY).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in texts:
        ids = THEIRS.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want, key=repr)
    full = bpe.encode_documents(df, VOCABULARY, with_ids=True).where("doc_id = 1").first()
    assert full.decoded == "Hello world" and len(full.ids) == full.n_tokens
    assert bpe.encode_documents(df.limit(0), VOCABULARY).count() == 0


def test_other_kinds_of_vocabulary_raise():
    import public_tokenizers
    import pytest

    with open(public_tokenizers.path("word_bpe_49k.json")) as f, pytest.raises(ValueError, match="byte-level"):
        bpe.ForcedBoundaryBPE(f.read())
