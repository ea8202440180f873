"""Operator 10 against a count of all windows, and its sorting against a dictionary."""

import hashlib
import random
from collections import Counter

import numpy as np

from trackwise.llm import repeats as R


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for (i, _), x in zip(rows, texts, strict=True):
        gone = bytearray(len(x))
        for s in range(len(x) - length + 1):
            if count[x[s : s + length]] > 1:
                gone[s : s + length] = b"\x01" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(x)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefgh é\n") for _ in range(n))
    shared = [noise(n) for n in (150, 230, 260, 400, 900)]
    out = []
    for i in range(60):
        text = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            text += s[a : rng.randint(a, len(s))] + noise(rng.randint(0, 200))
        out.append((i, text))
    return out + [(100, None), (101, ""), (102, "x" * 199), (103, "y" * 201), (104, "ab" * 400), (105, out[5][1]), (5, out[5][1]), (None, shared[3]),
                  (106, noise(700) * 2), (107, "é" * 150)]


def test_against_all_windows(spark):
    data = rows()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in data], "doc_id bigint, text string, anchor string, lo int").repartition(3)
    got = R.remove_repeats(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(data, 200)


def test_hot_anchors_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 2)
    data = rows()
    got = R.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(data, 200)


def test_kept_text_and_spans(spark):
    data = [(1, "A" + "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300)) + "B"), (2, "".join(chr(97 + (i * i + i // 7) % 26) for i in range(300)))]
    got = {r.doc_id: r for r in R.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string"), with_text=True).collect()}
    assert bytes(got[1].kept) == b"AB" and got[1].removed == "1:301" and bytes(got[2].kept) == b""
    assert R.remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_chunks_of_long_texts_agree():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 40_000).astype(np.uint8)
    whole = R.contexts(raw, np.array([0, len(raw)]))
    old, R.CHUNK = R.CHUNK, 7000
    try:
        parts = R.chunked(raw, np.array([0, len(raw)]), R.LENGTH)
    finally:
        R.CHUNK = old
    starts = lambda c: sorted(s for lo, hi in zip(c[1], c[2], strict=True) for s in range(lo, hi + 1))
    assert starts(parts) == starts(whole) == list(range(len(raw) - R.LENGTH + 1))


def test_deep_shallow_sorting():
    rng = np.random.default_rng(2)
    for letters, length in ((2, 200), (3, 203), (1, 200), (20, 72)):
        base = rng.integers(97, 97 + letters, 400).astype(np.uint8)
        data = np.concatenate([base, base[50:350], rng.integers(97, 97 + letters, 300).astype(np.uint8), base[100:320]])
        starts = np.arange(len(data) - length + 1)
        blob = data.tobytes()
        count = Counter(blob[s : s + length] for s in starts)
        want = [count[blob[s : s + length]] > 1 for s in starts]
        assert R.equal_windows(data, starts, length).tolist() == want


def test_blind_trie():
    rng = random.Random(8)
    for _ in range(200):
        some = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(rng.randint(2, 40))]
        assert R.blind_trie(some, 0) == [some.count(s) > 1 for s in some]
