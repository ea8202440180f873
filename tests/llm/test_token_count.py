"""Operator 7 against the sentencepiece library."""

import random

import public_tokenizers as P
import pytest
import sentencepiece

from trackwise.llm.token_count import Prefixes, count_tokens, load

PATH = P.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "t", "h", " ", "  ", "the", "ing", "\n", "\t", "é", "①", "😀", "▁", " ▁", "0", "12", "ion", "X", "İ", "\xa0", "</s>", "<0x41>", "...", " " * 20]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_are_the_librarys(library):
    rng, counter = random.Random(3), load(PATH)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["".join(rng.choice(counter.names).replace("▁", " ") for _ in range(4)) for _ in range(1500)]
    texts += ["", " ", "abc" * 900, "x" * 3000, " " * 999, "the cat " * 500]
    assert counter.texts(texts) == [len(ids) for ids in library.encode(texts)]


def test_every_prefix(library):
    rng, counter = random.Random(4), load(PATH)
    for _ in range(25):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15)))
        prefixes = Prefixes(counter, text)
        counts = [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert [prefixes.tokens(k) for k in range(len(text) + 1)] == counts
        for budget in (0, 1, 3, 8, 99):
            assert prefixes.cut(budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_indented_code(library):
    counter = load(PATH)
    text = "def f(x):\n    if x:\n        return  x\n" + " " * 37 + "y  =   ①" + " " * 5 + "z" * 700 + "    éé"
    assert counter.texts([text]) == [len(library.encode(text))]
    prefixes = Prefixes(counter, text)
    assert [prefixes.tokens(k) for k in range(len(text) + 1)] == [len(library.encode(text[:k])) for k in range(len(text) + 1)]


def test_documents(spark):
    long = "the cat sat " * 3000
    rows = [(1, None), (2, ""), (3, "é x"), (3, "é x"), (None, "a"), (5, long)]
    got = count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string"), PATH).collect()
    by = {(r.doc_id, r.n_bytes): (r.n_tokens, r.over_limit) for r in got}
    assert len(got) == 6 and by[1, 0] == (0, False) and by[2, 0] == (0, False) and by[5, len(long)][1] and by[3, 4][0] == 2
    assert count_tokens(spark.createDataFrame([], "doc_id bigint, text string"), PATH).count() == 0
