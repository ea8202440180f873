"""Operator 5 against the tiktoken library, and the round trip."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from trackwise.llm.byte_bpe import LONG_PIECE, encode_documents, encode_table, load

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    parts = ["the", " of", "ing", "  ", "\n", "ß", "é", "日本", "😀", "12", "'ll", "!!", "<|endoftext|>", "́", "a" * 30, "=" * 40, " " * 20, "\x00"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    long = ["a" * 5000, "ab" * 3000, " " * (LONG_PIECE * 3), "".join(rng.choice("abcdefgh") for _ in range(4000)), "=" * 700]
    return [None, "", *some, *long]


def test_ids_are_the_librarys(library):
    codec = load(PATH, P.PATTERN)
    for text, got in zip(texts(), codec.encode_texts(texts()), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text or "")
        assert codec.decode(got) == (text or "").encode()


def test_documents(spark, library):
    rows = list(enumerate(texts())) + [(0, "again"), (None, "no id")]
    got = encode_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH, P.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_columns_pass_through(spark):
    df = spark.createDataFrame([(1, "the the", "x", 5)], "doc_id bigint, text string, ids string, n_tokens int")
    out = encode_table(df, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "ids_in", "n_tokens_in", "ids", "n_tokens", "ids_sha256", "decoded_sha256"]
    row = out.first()
    assert (row["ids_in"], row["n_tokens_in"], len(row["ids"])) == ("x", 5, row["n_tokens"])
    assert encode_table(df.filter("false"), PATH, P.PATTERN).count() == 0
