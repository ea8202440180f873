"""Operator 3: the base score against counting, the trie's table against the textbook recursion."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from trackwise.llm import ppm
from trackwise.llm.textbatch import packed, unpacked


def folded(text):
    return (text or "").encode().lower()


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def rows():
    rng = random.Random(1)
    words = ["the", "cat", "Sat", "ON", "mat", "é", "x1", "--", "dog"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice(["", "\n", " new%d" % i])) for i in range(120)]
    return out + [(500, None), (501, ""), (502, " \t\x0b "), (7, "the again"), (None, "no id the"), (503, "the cat " * 20_000)]


def test_base_scores(spark):
    data = rows()
    got = ppm.lm_scores(spark.createDataFrame([(i, t, "z", 1) for i, t in data], "doc_id bigint, text string, key string, n int")).collect()
    count, ends = Counter(), 0
    for i, t in data:
        if not held(i):
            count.update(folded(t).split())
            ends += 1
    total = sum(count.values()) + ends
    divisor = total + 0.5 * (len(count) + 2)
    want = []
    for i, t in data:
        words = folded(t).split()
        base = sum(math.log10((count[w] + 0.5) / divisor) for w in words) + math.log10((ends + 0.5) / divisor)
        want.append((i, held(i), len(words) + 1, sum(count[w] > 0 for w in words) + 1, total, round(base, 6)))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got if r.doc_id is not None) == sorted(
        w for w in want if w[0] is not None
    )
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert ppm.lm_scores(empty).count() == 0
    only_held = next(i for i in range(99) if held(i))
    row = ppm.lm_scores(spark.createDataFrame([(only_held, "a b")], "doc_id bigint, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (3, 0, 0) and math.isclose(row.base_score, 0.0)
    assert math.isclose(row.score, 4 * math.log10(1 / 256), rel_tol=1e-6)  # three bytes and the end, nothing known


def textbook(counts, context, symbol):
    """Method C with exclusion, one symbol at a time; counts: {(classes of length k): Counter}."""
    p, excluded = 1.0, set()
    for k in range(ppm.ORDER, -1, -1):
        own = {s: n for s, n in counts.get(context[ppm.ORDER - k :], {}).items() if s not in excluded}
        if not own:
            continue
        total, kinds = sum(own.values()), len(own)
        if symbol in own:
            return p * own[symbol] / (total + kinds)
        p *= kinds / (total + kinds)
        excluded |= set(own)
    return p / (256 - len(excluded))


def test_table_is_the_textbook_recursion():
    rng = random.Random(0)
    text = "".join(rng.choice("abc d\n") for _ in range(600)).encode()
    raw, offs = np.frombuffer(text, np.uint8), np.array([0, 250, 250, len(text)])
    gram, edges = ppm.grams(raw, offs)
    assert edges.tolist() == [0, 251, 252, 603]
    table = ppm.log_table(np.bincount(ppm.cells(gram), minlength=ppm.CELLS))
    counts = {}
    for g in gram.tolist():
        context = tuple((g >> (8 + 5 * j)) & 31 for j in (2, 1, 0))
        for k in range(ppm.ORDER + 1):
            counts.setdefault(context[ppm.ORDER - k :], Counter())[g & 255] += 1
    for _ in range(300):
        context = tuple(rng.choice([0, 1, 2, 3, 4, 27, 9]) for _ in range(3))
        symbol = rng.choice(b"abc dz\n\x00")
        cell = ((context[0] * 32 + context[1]) * 32 + context[2]) * 256 + symbol
        assert math.isclose(table[cell], math.log10(textbook(counts, context, symbol)), abs_tol=1e-4)


def test_every_context_sums_to_one(spark):
    df = spark.createDataFrame([(i, t) for i, t in rows()], "doc_id bigint, text string")
    model = ppm.Model(ppm.gather(df))
    upper = (10.0 ** model.table.astype(float)).reshape(-1, 256).sum(axis=1)
    assert np.allclose(upper, 1, atol=1e-3)
    mass = np.zeros(len(model.contexts))
    low = np.zeros(len(model.contexts))
    of = {c: i for i, c in enumerate(model.contexts.tolist())}
    for g, d in zip(model.grams.tolist(), model.direct.tolist(), strict=True):
        mass[of[g >> 8]] += 10**d
        low[of[g >> 8]] += 10.0 ** model.table[g & (ppm.CELLS - 1)]
    assert np.allclose(mass + 10.0**model.escape * (1 - low), 1, atol=1e-2)


def test_words_beyond_the_shared_ones_count_too(spark, monkeypatch):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    first = {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 8)) for r in ppm.lm_scores(df).collect()}
    monkeypatch.setattr(ppm, "SHARED_WORDS", 2)
    assert first == {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 8)) for r in ppm.lm_scores(df).collect()}


def test_grams_beyond_the_shared_ones_count_too(spark, monkeypatch):
    df = spark.createDataFrame([(i, t) for i, t in rows() if i is not None], "doc_id bigint, text string")
    want = {(r.doc_id, r.n_tokens): r.score for r in ppm.lm_scores(df).collect()}
    for limit in (0, 60, 400):
        monkeypatch.setattr(ppm, "SHARED_GRAMS", limit)
        got = {(r.doc_id, r.n_tokens): r.score for r in ppm.lm_scores(df).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-6) for k in want)


def test_letters_of_other_scripts_and_digits_are_told_apart(spark):
    rng = random.Random(4)
    data = []
    for i in range(200):  # every letter or digit is told by the one before it
        for j, signs in enumerate(("абвгдежзиклмнопр", "日月火水木金土山川田", "0123456789")):
            at = rng.randrange(len(signs))
            data.append((3 * i + j, "".join(signs[(at + 3 * k) % len(signs)] for k in range(40))))
    got = ppm.lm_scores(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    text = dict(data)
    for j in range(3):
        some = [r for r in got if r.held_out and r.doc_id % 3 == j]
        bits = -sum(r.score for r in some) / math.log10(2) / sum(len(text[r.doc_id].encode()) for r in some)
        assert len(some) > 20 and bits < 0.4


def test_contexts_against_the_textbook_recursion(spark):
    """Each level pays its escape and leaves the rest to the next shorter context, in proportion."""
    data = rows()[:120]
    got = {r.doc_id: r.score for r in ppm.lm_scores(spark.createDataFrame(data, "doc_id bigint, text string")).collect()}
    code = lambda b: int(ppm._CLASS[b])

    def chain(six):  # the contexts, longest first
        c3, c2, c1 = (code(b) for b in six[3:])
        return [six, six[1:], six[2:], six[3:], (c3, *six[4:]), (c3, c2, six[5])]

    def grams(text):
        raw = bytes(6) + folded(text) + bytes(1)
        return [(tuple(raw[k - 6 : k]), raw[k]) for k in range(6, len(raw))]

    deep = [{} for _ in range(6)]
    upper = {}
    for i, t in data:
        if not held(i):
            for six, s in grams(t):
                for level, c in enumerate(chain(six)):
                    deep[level].setdefault(c, Counter())[s] += 1
                three = tuple(code(b) for b in six[3:])
                for k in range(4):
                    upper.setdefault(three[3 - k :], Counter())[s] += 1

    def p(six, s, level=0):
        if level == 6:
            return textbook(upper, tuple(code(b) for b in six[3:]), s)
        own = deep[level].get(chain(six)[level])
        if not own:
            return p(six, s, level + 1)
        total = sum(own.values()) + len(own)
        return own[s] / total if s in own else len(own) / total * p(six, s, level + 1) / (1 - sum(p(six, x, level + 1) for x in own))

    for i, t in data[:40]:
        assert math.isclose(got[i], sum(math.log10(p(six, s)) for six, s in grams(t)), rel_tol=1e-4)


def test_units_hold_grams_in_few_rows(spark, monkeypatch):
    """A row for each unit, kind and bucket, not for each gram; how documents are dealt to units changes no score."""
    data = [(i, t) for i, t in rows() if i is not None]
    df = spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1)
    parts = ppm.gather(df).toPandas()
    asked = parts[parts.doc_id.isna()]
    grams = {(bytes(6) + folded(t) + bytes(1))[k : k + 7] for _, t in data for k in range(len(folded(t)) + 1)}
    assert len(parts) - len(asked) == len(data) and sorted(set(asked.kind)) == [0, 1, 2]
    assert len(asked) <= 3 * 64 < len(grams) and asked.groupby("kind")["size"].sum()[2] == len(grams)
    want = {(r.doc_id, r.n_tokens): r for r in ppm.lm_scores(df).collect()}
    for name, value in (("COUNT_BYTES", 700), ("UNIT_BYTES", 1500)):
        monkeypatch.setattr(ppm, name, value)
    got = {(r.doc_id, r.n_tokens): r for r in ppm.lm_scores(df).collect()}
    assert ppm.gather(df).select("unit").distinct().count() > 3 and got.keys() == want.keys()
    for k, r in want.items():
        assert got[k].n_known == r.n_known and math.isclose(got[k].base_score, r.base_score, rel_tol=1e-9) and math.isclose(got[k].score, r.score, rel_tol=1e-6)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(3)
    values = np.sort(rng.integers(0, 2**63, 500, dtype=np.uint64))
    assert (unpacked(packed(values, rising=True), 500, rising=True) == values).all()
    some = rng.random(7).astype(np.float32)
    assert (unpacked(packed(some), 7, np.float32) == some).all()
    assert len(unpacked(packed(values[:0], rising=True), 0, rising=True)) == 0
