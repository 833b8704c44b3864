"""Problem 8 against another implementation of the vocabulary, and as a round trip."""

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import tokens as T

with open(T.VOCABULARY, "rb") as f:
    ENCODER = T.Encoder(f.read())
OTHER = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})
BYTES = {v: k for k, v in ENCODER.ranks.items()}


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_same_as_the_other(text):
    ids = ENCODER.encode(text)
    assert ids == OTHER.encode_ordinary(text)
    assert b"".join(BYTES[i] for i in ids) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aé漢", "etaoin shrdlu", "!?=- \n"])
@pytest.mark.parametrize("n", [1, 150, 201, 3000])
def test_short_and_long_words(alphabet, n):
    rng = random.Random(n)
    text = "".join(rng.choice(alphabet) for _ in range(n))
    assert ENCODER.encode(text) == OTHER.encode_ordinary(text)


def test_scan_and_heap_agree():
    rng = random.Random(0)
    for _ in range(200):
        word = bytes(rng.choice(b"abcdeinrst \xc3\xa9") for _ in range(rng.randint(1, 60)))
        assert ENCODER._scan(word) == ENCODER._heap(word)


def test_frame(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "<|endoftext|> Hi", None), (4, "again", None), (None, "a" * 200_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id or 0, r.ids) for r in T.encode(df).collect()), key=str)
    assert got == sorted(((i or 0, OTHER.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    assert {(r.doc_id or 0, r.n_tokens) for r in T.count_tokens(df).collect()} == {(i, len(x)) for i, x in got}
    assert T.encode(df.limit(0)).count() == 0
    assert base64.b64decode(b"IQ==") in ENCODER.ranks
