import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from edgeloom.llm import byte_bpe

CODEC = byte_bpe.codec(public_tokenizers.path(byte_bpe.RANKS))
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text())
def test_any_text(text):
    assert ids(text) == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


@pytest.mark.parametrize("alphabet", ["ab", "aeiou th", "0123 .,!\n\t ", "日本語 テ", "aaaa", "ab \x1c\x1f\x85\xa0 ​", "a²³½Ⅷ_", "it's 're 'llx'T "])
def test_dense_alphabets(alphabet):
    rng = random.Random(alphabet)
    for n in (1, 7, 40, 300):
        for _ in range(60):
            text = "".join(rng.choice(alphabet) for _ in range(n))
            assert ids(text) == REFERENCE.encode_ordinary(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 100_000 + "b", "".join(random.Random(1).choice("abcdefgh") for _ in range(100_000))):
        assert ids(text) == REFERENCE.encode_ordinary(text)


def test_query_columns_and_edge_cases(spark):
    rows = [(1, "Hello world"), (None, None), (2, ""), (2, ""), (3, "é" * 5000)]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    found = byte_bpe.encode_documents(df).collect()
    assert len(found) == 5
    for r in found:
        text = next(t for i, t in rows if i == r["doc_id"]) or ""
        wanted = REFERENCE.encode_ordinary(text)
        assert (r["ids"], r["n_tokens"]) == (wanted, len(wanted))
        assert r["ids_sha256"] == hashlib.sha256(np.array(wanted, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_documents(df.limit(0), ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert byte_bpe.encode_documents(df.limit(0)).count() == 0
