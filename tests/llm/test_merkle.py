"""Operator 13 against a tree built in plain Python."""

import zlib
from collections import defaultdict
from hashlib import sha256

import duckdb
import pytest

from trackwise.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", "l") for r in rows], SCHEMA)


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(i, t, lang, s, n):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, lang, n, t)])


def tree(nodes):
    """The root, and for each node its (left, right) siblings from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        cut = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for i, a in enumerate(at):
            run, k = cut[a // 3], a % 3
            paths[i].append((run[:k], run[k + 1 :]))
            at[i] = a // 3
        nodes = [h(*c) for c in cut]
    return nodes[0], paths


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        grown[s] = tree([leaf(*r) for r in by[s]])
    root, top = tree([grown[s][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for r, path in zip(by[s], grown[s][1]):
            path = path + top[k]
            text = r[1]
            if text is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            f = leaf(r[0], text, *r[2:])
            for left, right in path:
                f = h(*left, f, *right)
            proof = h(*[x for left, right in path for x in [*left, *right]])
            out.append((r[0], leaf(*r), grown[s][0], root, proof, f, f == root))
    return sorted(out, key=str)


def rows_of(sizes):
    rows = []
    for s, n in sizes.items():
        for _ in range(n):
            i = len(rows)
            rows.append((i * 3, None if i % 11 == 0 else f"line {i}\nné\n" * (i % 4), None if i % 7 == 0 else "en", s, None if i % 5 == 0 else i))
    return rows


@pytest.mark.parametrize("share", [20_000, 6])
def test_against_plain_trees(spark, monkeypatch, share):
    monkeypatch.setattr(merkle, "HOT_SHARE", share)
    rows = rows_of({"hot": 95, None: 4, "é": 1, "z": 27, "a": 28, "": 2, "\U0001f600": 3, "￿": 10})
    rows += [(None, "no\nid", "en", "a", 1), (None, "no\nother", "en", "a", 1), (3, "again\n", "en", "hot", 2), (3, "again\n", "en", "hot", 2)]
    got = merkle.manifest(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {v[-1] for v in want} == {True, False}


@pytest.mark.parametrize("sizes", [{"one": 1}, {"one": 9}, {"a": 1, "b": 1}, {f"s{i}": 1 for i in range(11)}, {}])
def test_small_trees(spark, sizes):
    rows = rows_of(sizes)
    got = merkle.manifest(frame(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == (brute(rows) if rows else [])


def test_same_as_the_sql(spark):
    rows = rows_of({"hot": 40, None: 5, "b": 12, "c": 1})
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.execute(merkle.ORACLE).fetchall(), key=str) == brute(rows)


def test_row_limit_is_put_back(spark):
    before = spark.conf.get("spark.sql.cteRecursionRowLimit")
    merkle.manifest(frame(spark, rows_of({"a": 4}))).collect()
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == before
