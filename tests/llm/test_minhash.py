"""Operator 9 against all pairs, on families of edited copies."""

import itertools
import random

import numpy as np

from trackwise.llm import minhash as M


def sets(texts, size):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    return out


def brute(rows, size, num):
    s, root = sets([t for _, t in rows], size), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        common, union = len(s[a] & s[b]), len(s[a] | s[b])
        same_id = rows[a][0] == rows[b][0] and False
        if same_id or (union and 100 * common >= num * union):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return sorted(((i, len(s[k]), least[find(k)], i == least[find(k)]) for k, (i, _) in enumerate(rows)), key=str)


def family(seed, bases=3, copies=45, length=110, edits=14):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                i, kind = rng.randrange(len(w)), rng.random()
                if kind < 0.6:
                    w[i] = rng.choice(vocabulary)
                elif kind < 0.8:
                    del w[i]
                else:
                    w.insert(i, rng.choice(vocabulary))
            texts.append(" ".join(w))
    return texts


def test_components_of_edited_copies(spark):
    rows = list(enumerate(family(1)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one\tTWO"), (1005, "é x"), (None, "one two"), (3, rows[3][1]), (1006, "long " * 30_000)]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id bigint, text string, key string, n int").repartition(4)
    got = M.near_dedup(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 3, 85)


def test_survivors(spark):
    rows = list(enumerate(family(2, bases=2, copies=25, edits=5)))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, node string, a int")
    got = M.survivors(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, _, _, kept in brute(rows, 5, 80) if kept)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert M.near_dedup(empty).count() == 0 and M.survivors(empty).count() == 0


def test_sketches_estimate_the_similarity():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 2**63, 900).astype(np.uint64)
    own = rng.integers(0, 2**63, 200).astype(np.uint64)
    values = np.concatenate([np.sort(np.concatenate([shared, own[:100]])), np.sort(np.concatenate([shared, own[100:]]))])
    _, sketch = M.signatures(values, np.array([0, 1000, 2000]))
    differ = int(np.unpackbits((sketch[0] ^ sketch[1]).view(np.uint8)).sum())
    estimate = 1 + M.SKETCH / (4 * M.BANDS * M.ROWS) * np.log(1 - 2 * differ / M.SKETCH)
    assert abs(estimate - 900 / 1100) < 0.15 and differ <= M.most_bits(80, 100)


def test_chains_of_links(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r.node: r.root for r in M.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}
