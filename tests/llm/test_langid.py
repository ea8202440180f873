"""Operator 1: the forward algorithm against the sum over all segmentations, and held-out accuracy."""

import itertools
import math
import random

import numpy as np
import public_tokenizers as P
import pytest

from trackwise.llm import langid as L

PIECES = ["▁", "a", "b", "c", "ab", "bc", "▁a", "abc", "ca"]


def by_segmentations(word, prob):
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at, parts = 0, []
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        total += math.prod(prob.get(p, prob["?"] if len(p) == 1 and p not in prob else 0.0) for p in parts)
    return math.log(total)


def table():
    rng = np.random.default_rng(0)
    t = rng.random((len(PIECES) + 1, 2))
    return np.vstack([t / t.sum(axis=0), np.zeros((1, 2))])


def test_forward_sums_all_segmentations():
    t, index = table(), L.PieceIndex(PIECES)
    words = ["▁abcabc", "▁", "▁zab", "▁bcaza", "▁abcabcabcab"]
    got = np.zeros((len(words), 2))
    for rows, points in L.by_length(words):
        got[rows] = L.forward(points, index, t)
    for k in range(2):
        prob = dict(zip([*PIECES, "?"], t[:-1, k], strict=True))
        assert np.allclose(got[:, k], [by_segmentations(w, prob) for w in words])


def plain_forward(word, prob):
    """log of the sum over all segmentations, position by position, in logarithms."""
    logs = [0.0]
    for i in range(1, len(word) + 1):
        ways = []
        for w in range(1, min(i, 3) + 1):
            part = word[i - w : i]
            p = prob.get(part, prob["?"] if w == 1 else 0.0)
            if p:
                ways.append(logs[i - w] + math.log(p))
        top = max(ways)
        logs.append(top + math.log(sum(math.exp(x - top) for x in ways)))
    return logs[-1]


def test_words_of_any_length_are_walked_whole(monkeypatch):
    t, index = table(), L.PieceIndex(PIECES)
    rng = random.Random(3)
    for size in (40, 1999, 2000, 2001, 5000):
        word = "▁" + "".join(rng.choice("abcz") for _ in range(size))
        points = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None]
        got = L.forward(points, index, t)[0]
        for k in range(2):
            assert math.isclose(got[k], plain_forward(word, dict(zip([*PIECES, "?"], t[:-1, k], strict=True))), rel_tol=1e-9)
    points = np.frombuffer(("▁" + "abcabzca" * 12).encode("utf-32-le"), np.uint32)[None]
    column = np.append(t[:-1, 0], 0.0)[:, None]
    whole, counts = L.forward(points, index, t), L.expected(points, np.ones(1), index, column)
    for window in (1, 2, 7, 50):
        monkeypatch.setattr(L, "WINDOW", window)
        assert np.allclose(whole, L.forward(points, index, t))
        assert np.allclose(counts, L.expected(points, np.ones(1), index, column))


def test_sample_is_bounded_without_ids_and_with_repeats(spark):
    rows = [(None, f"text {i}", "en") for i in range(4000)] + [(7, "again", "en")] * 4000 + [(None, "wort", "de")] * 3 + [(1, None, "en"), (2, "x", None)]
    got = L.sampled(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), 500).collect()
    english = [r for r in got if r.lang == "en"]
    assert 150 < len(english) < 400 and len({r.text for r in english}) == len(english)  # half of the rows repeat one
    assert [r.text for r in got if r.lang == "de"] == ["wort"]


def test_long_words_are_scaled():
    t, index = table(), L.PieceIndex(PIECES)
    word = "▁" + "abcz" * 400
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None]
    got = L.forward(points, index, t)
    assert np.isfinite(got).all() and (got < -600).all()
    short = np.frombuffer(word[:30].encode("utf-32-le"), np.uint32)[None]
    plain, limit = L.forward(short, index, t), L.UNSCALED
    L.UNSCALED = 0
    try:
        assert np.allclose(plain, L.forward(short, index, t))
    finally:
        L.UNSCALED = limit


def test_expected_counts_are_posteriors():
    t, index = table(), L.PieceIndex(PIECES)
    word = "▁abcabz"
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32)[None]
    got = L.expected(points, np.ones(1), index, t[:, :1])
    prob, want, total = dict(zip([*PIECES, "?"], t[:-1, 0], strict=True)), np.zeros(len(t)), 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at, parts = 0, []
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(word[at:i])
                at = i
        parts.append(word[at:])
        p = math.prod(prob.get(x, prob["?"] if len(x) == 1 and x not in prob else 0.0) for x in parts)
        total += p
        for x in parts:
            want[PIECES.index(x) if x in PIECES else len(PIECES)] += p
    assert np.allclose(got, want / total)


@pytest.fixture(scope="module")
def pieces():
    return L.sentencepiece_pieces(P.path("piece_bpe_32k.model"))


def test_documents(spark, pieces):
    rng = random.Random(2)
    syllables = {"xx": ["ka", "to", "mi", "ra"], "yy": ["sch", "ung", "ein", "ber"], "zz": ["eau", "oi", "ré", "le"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(syllables))
        text = " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(20))
        rows.append((i, text, lang, "s"))
    odd = [(900, None, "xx", "s"), (901, "", None, "s"), (902, "12 34 ...", "yy", "s"), (903, "ungein " * 4000, None, "s"), (None, "eauoi", "zz", "s"), (5, "kato", "xx", "s")]
    df = spark.createDataFrame(rows + odd, "doc_id bigint, text string, lang string, score string")
    got = L.identify(df, pieces).collect()
    assert len(got) == len(rows) + len(odd)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (900, 901, 902, 903, None)] == ["und", "und", "und", "yy", "zz"]
    assert by[900].score == 0.0 and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    truth = {i: lang for i, _, lang, _ in rows}
    assert len(held) > 30 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_nothing_to_learn(spark, pieces):
    df = spark.createDataFrame([(1, "a b", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r)[2:] for r in L.identify(df, pieces).collect()] == [("und", 0.0)]
    assert L.identify(df.filter("false"), pieces).count() == 0
