"""Operator 8 against a plain grouping, and the index over several batches."""

import hashlib
import re
from collections import defaultdict

from trackwise.llm.exact_dedup import DigestIndex, exact_dedup, survivors

ROWS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \x0b\x0c\r"), (7, "A b"), (8, "a b"), (9, "x" * 50_000), (10, "x" * 50_000),
        (None, "solo"), (12, "solo "), (13, " "), (14, "ab"), (14, "ab")]


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[key])[3]
        out.append((i, keep, len(groups[key]), i == keep, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "y", "x") for i, t in rows], "doc_id bigint, text string, digest string, keep_id string")


def test_against_brute_force(spark):
    assert sorted((tuple(r) for r in exact_dedup(frame(spark, ROWS)).collect()), key=str) == brute(ROWS)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_survivors_keep_their_columns(spark):
    got = survivors(frame(spark, ROWS))
    assert got.columns == ["doc_id", "text", "digest", "keep_id"]
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert len(rows) == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in ROWS})
    assert (3, "a\tb\n") in rows and (9, "x" * 50_000) in rows and (6, " \x0b\x0c\r") in rows


def test_index_remembers_batches(spark):
    index = DigestIndex(spark, buckets=4)
    assert {r.doc_id for r in index.add(frame(spark, [(1, "a"), (2, "b"), (3, "a ")])).filter("kept").collect()} == {2, 3}
    second = {r.doc_id: (r.keep_id, r.known, r.kept) for r in index.add(frame(spark, [(4, "a  "), (5, "c")])).collect()}
    assert second == {4: (3, True, False), 5: (5, False, True)}
    assert index.table().count() == 3
    assert index.add(frame(spark, [])).count() == 0 and index.table().count() == 3
    layout = " ".join(str(r) for r in spark.sql(f"DESCRIBE EXTENDED {index.name}").collect())
    assert "Num Buckets" in layout and "Sort Columns" in layout


def test_hot_group_takes_the_broadcast_way(spark):
    rows = [(i, "hot") for i in range(3000)] + [(10_000 + i, f"cold {i}") for i in range(3000)]
    got = exact_dedup(frame(spark, rows))
    assert got.filter("kept").count() == 3001 and got.filter("keep_id = 0").first()["group_size"] == 3000
