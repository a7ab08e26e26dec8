import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens

pytest.importorskip("tiktoken")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_cuts_cover_the_text(text):
    at = tokens.cuts(text)
    assert at[0] == 0 and at == sorted(set(at)) and all(b - a <= tokens.LONGEST for a, b in zip(at, [*at[1:], len(text)]))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc d", max_size=900), max_size=8))
def test_cuts_of_many_texts_are_those_of_each(texts):
    assert tokens.cuts_of(texts) == [tokens.cuts(t) for t in texts]


def test_shared_passages_across_long_texts(spark):
    rng = random.Random(3)
    words = ["alpha", "beta,", "gamma", "  delta", "9x", "é\n", "zeta"]
    passage = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(4)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(90))) + rng.choice(passage) + rng.choice(passage) for _ in range(40)]
    encode = tokens.encoding(tokens.vocabulary()).encode_ordinary
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {k: encode(t) for k, t in enumerate(texts)}


def test_cuts_depend_on_content_only():
    rng = random.Random(1)
    body = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    a, b = tokens.cuts("xyz " + body), tokens.cuts("a longer start, " + body)
    assert len({x - 4 for x in a} & {x - 16 for x in b}) >= 10


def test_ids_equal_the_encoder(spark):
    rng = random.Random(2)
    alphabet = ["the ", "pump ", "don't ", "  ", "\n", "\t", "é", "漢字", "😀", "a", "1234 ", "...", " ", "<|endoftext|>", "வால்வு ", "x" * 50]
    texts = [None, "", " ", "a", "'", "x y", "\r\n", "y" * 9000, "日本語" * 2000] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 1500))) for _ in range(60)]
    texts += texts[20:30] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS start", "3 AS text_key", "4 AS _n")
    encode = tokens.encoding(tokens.vocabulary()).encode_ordinary
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        assert got[k] == (encode(text) if text else []), text
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_repeated_rows_keep_their_number(spark, monkeypatch):
    monkeypatch.setattr("millrace.operators.skew.ROWS_A_SALT", 3)
    monkeypatch.setattr("millrace.operators.skew.BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(k, "the same text again and again " * 30) for k in range(40)] + [(7, "the same text again and again " * 30)], "doc_id long, text string")
    rows = tokens.encode_corpus(df).collect()
    assert len(rows) == 41 and len({tuple(r.ids) for r in rows}) == 1


def test_counts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "the pump")], "doc_id long, text string")
    assert [r.n_tokens for r in tokens.token_counts(df).orderBy("doc_id").collect()] == [0, 0, 2]
