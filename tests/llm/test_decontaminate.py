"""Operator 2 against the best window of every document and item."""

import random
import re
from collections import Counter

from trackwise.llm import decontaminate as D


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def bag(w, size):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute(docs, items):
    best = {}
    for item, t in items:
        need = words(t)
        if not need:
            continue
        n, size = len(need), min(5, len(need))
        own = bag(need, size)
        for doc, text in docs:
            w = words(text)
            for s in range(max(1, len(w) - n + 1)):
                b = bag(w[s : s + n], size)
                both, either = sum((own & b).values()), sum((own | b).values())
                if either and 10 * both >= 8 * either:
                    best[doc, item] = max(best.get((doc, item), 0), both / either)
    return best


def data():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "x"]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, line(rng.randint(12, 60))) for i in range(12)]
    items += [(20, ["only", "three", "words"]), (21, ["one"]), (22, items[0][1]), (23, ["a"] * 15)]
    docs = []
    for i in range(70):
        text = line(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            passage = list(rng.choice(items)[1])
            kind = rng.random()
            if kind < 0.3:
                passage = [w.upper() + "," for w in passage]
            elif kind < 0.5:
                passage = passage[rng.randint(0, 4) :]
            elif kind < 0.7 and len(passage) > 6:
                passage[rng.randrange(len(passage))] = "changed"
            elif kind < 0.8:
                passage = passage[: len(passage) // 2]
            text = text + passage + line(rng.randint(0, 30))
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, " ".join(items[3][1])), (103, "w1 " * 20_000 + " ".join(items[4][1])), (None, " ".join(items[5][1])), (102, "again")]
    return docs, [(i, " ".join(w) + ".") for i, w in items] + [(30, None), (31, "...")]


def test_against_all_windows(spark):
    docs, items = data()
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in docs], "doc_id bigint, text string, n int, words string")
    got = D.contamination(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute(docs, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(got) == len(want)
    assert all(abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-9 for r in got)


def test_parts_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_ROWS", 20)
    docs, items = data()
    got = D.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == set(brute(docs, items))


def test_clean_documents_stay(spark):
    docs, items = data()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, start string")
    kept = D.keep_clean(df, spark.createDataFrame(items, "item_id bigint, text string"))
    bad = {d for d, _ in brute(docs, items)}
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_empty_tables(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert D.contamination(d.filter("false"), b).count() == 0
    none = D.contamination(d, b.filter("false"))
    assert none.columns == ["doc_id", "item_id", "start", "similarity"] and none.count() == 0
    assert D.keep_clean(d, b.filter("false")).count() == len(docs)


def test_blocks_find_everything_within_the_radius(spark):
    rng = random.Random(1)
    pairs = []
    for k in range(200):
        a = rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, D.RADIUS)):
            pass
        flips = rng.sample(range(64), rng.randint(0, D.RADIUS))
        b = a
        for f in flips:
            b ^= 1 << f
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        pairs.append((k, signed(a), signed(b)))
    df = spark.createDataFrame(pairs, "k int, a bigint, b bigint")
    assert sum(D.WIDTHS) == 64
    from pyspark.sql import functions as F

    left = df.select("k", F.explode(D.blocks("a", False)).alias("x"))
    right = df.select("k", F.explode(D.blocks("b", True)).alias("x"))
    assert left.join(right, ["k", "x"]).select("k").distinct().count() == 200


def test_plan_is_native(spark):
    docs, items = data()
    out = D.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert not re.search("Python|Arrow|Pandas", out._jdf.queryExecution().executedPlan().toString())


def test_rows_without_an_id_are_told_apart(spark):
    item = " ".join(f"word{k}" for k in range(40))
    docs = [(None, f"before {item} after"), (None, "a clean text"), (None, None), (1, item), (2, "clean too")]
    kept = D.keep_clean(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    assert sorted(kept.collect(), key=str) == sorted([(None, "a clean text"), (None, None), (2, "clean too")], key=str)
