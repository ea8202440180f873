"""Operator 12 against a plain water-filling in fractions, and the repeated documents."""

import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb

from trackwise.llm.mixing import ORACLE, mix, mixture

SCHEMA = "doc_id bigint, text string, source string, size string, target string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "a", "b", "c") for i, t, s in rows], SCHEMA)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def levels(rows, weights=(3, 1, 2), share=Fraction(3, 2), cap=2):
    total = Counter()
    for _, t, s in rows:
        total[s] += size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        rest = share * sum(total.values()) - sum(target.values())
        unit = rest / sum(weight[s] for s in open_)
        above = {s for s in open_ if weight[s] * unit > cap * total[s]}
        if not above:
            return total, target | {s: weight[s] * unit for s in open_}
        target |= {s: Fraction(cap * total[s]) for s in above}
        open_ -= above
    return total, target


def rows_of(n=400):
    rows = []
    for i in range(n):
        s = "big" if i % 3 == 0 else [None, "a", "b", "ü", "\U0001f600"][i % 5]
        rows.append((i, " ".join(f"w{i}" for _ in range(1 + (i * 37) % 60)), s))
    return rows + [(900, None, "a"), (901, "", None), (902, " \t ", "blank"), (903, "x " * 3000, "big"), (None, "no id here", "b"), (5, "again", "a"), (5, "again", "a")]


def check(spark, rows):
    total, target = levels(rows)
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.source_size == total[r.source] and abs(r.target - float(target[r.source])) < 1e-6
        assert r.taken == r.repeats * r["size"] and 0 <= r.repeats <= 2
        taken[r.source] += r.taken
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((i, size(t), s) for i, t, s in rows)
    for s in total:
        assert abs(taken[s] - target[s]) <= max(total[s] / 800 + 1, max(size(t) for _, t, q in rows if q == s) / 2)
    return got


def test_against_fractions(spark):
    rows = rows_of()
    first = check(spark, rows)
    again = mix(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    _, target = levels(rows)
    total, _ = levels(rows)
    assert any(target[s] == 2 * total[s] for s in total if total[s]) and any(target[s] < 2 * total[s] for s in total)


def test_same_as_the_sql(spark):
    rows = rows_of(200)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = mix(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(ORACLE).fetchall()))


def test_one_source_of_copies_and_other_settings(spark):
    copies = [(7, "same words in all", "hot")] * 90 + [(i, "alone", "cold") for i in range(10)]
    check(spark, copies)
    got = mix(frame(spark, copies), weights=(1,), share=Fraction(9), max_epochs=4).collect()
    assert {r.repeats for r in got} == {4}
    half = mix(frame(spark, copies), weights=(1,), share=Fraction(1, 2), max_epochs=1).collect()
    assert Counter((r.source, r.repeats) for r in half)[("hot", 1)] == 44  # 185 words less the 10 of the others: 175, four each


def test_empty_tables(spark):
    assert mix(frame(spark, [])).count() == 0 and mixture(frame(spark, [])).count() == 0
    assert [r.taken for r in mix(frame(spark, [(1, None, None), (2, "", "a")])).collect()] == [0, 0]


def test_mixture_repeats_documents(spark):
    rows = rows_of(60)
    docs = frame(spark, rows)
    want = Counter()
    for r in mix(docs).collect():
        want[(r.doc_id, r.source)] += r.repeats
    got = mixture(docs)
    assert got.columns == docs.columns
    texts = defaultdict(set)
    for i, t, s in rows:
        texts[(i, s)].add(t)
    have = Counter()
    for r in got.collect():
        have[(r.doc_id, r.source)] += 1
        assert r.text in texts[(r.doc_id, r.source)] and r.key == "c"
    assert have == +want
