"""SM-08: the view after each batch against a full rebuild; the bucket store under it."""

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import tracker_df
from trackwise.operators import positions as P
from trackwise.operators.cluster import new_edges, similarity_edges
from trackwise.operators.components import components
from trackwise.plans.positions import build_positions
from trackwise.plans.refresh import PositionsView
from trackwise.sources.bucket_store import BucketStore, Conflict, Table

NAMES = ["acme", "acmes", "acne", "acned", "northwind", "northwinds", "northwindsystems", "windsystems", "unknown", "zeta", "zetas",
         "zetax", "zetaxy", "solo", "initech", "initechs", "globex", "hooli"]


def log(rng, n, seq):
    rows = []
    for _ in range(n):
        k = rng.choice(NAMES) if rng.random() < 0.8 else "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
        step, category = rng.choice([("Applied", "Applied"), ("Rejected", "Rejection"), ("Interview", "Invitation"), ("Offer", "Offer")])
        day = rng.randint(1, 28)
        rows.append({"company": k.title(), "company_key": k, "role": rng.choice(["", "Engineer", "Data Engineer"]), "step": step,
                     "category": category, "received": f"2026-0{rng.randint(5, 7)}-{day:02d}T09:00:00.000Z",
                     "interview_datetime": rng.choice(["", "", f"2026-07-{day:02d}T10:00:00.000Z"]), "thread_id": f"t{seq + len(rows)}", "message_id": f"m{seq + len(rows)}"})
    return rows


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def numbered(spark, rows, start):
    return tracker_df(spark, rows).withColumn("seq", F.col("seq") + start)


def rows_of(df):
    return sorted(map(str, df.select(*P.POSITION_COLUMNS, "cluster", "seg").collect()))


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(11)
    view = PositionsView(spark, str(tmp_path / "view"), buckets=8)
    everything, rolled, total = [], 0, 0
    for k in range(10):
        batch = log(rng, rng.choice([1, 3, 25]) if k else 60, len(everything))
        if k == 4:
            batch = []
        day = f"2026-07-{8 + k:02d}T12:00:00Z"  # interviews pass between batches
        done = view.refresh(numbered(spark, batch, len(everything)), day)
        everything += batch
        full = build_positions(numbered(spark, everything, 0), day, ordered=False)
        assert rows_of(view.positions(day)) == rows_of(full), k
        assert done.version == k + 1
        n = full.select("cluster").distinct().count()
        if k:
            rolled, total = rolled + done.clusters, total + n
            if len(batch) <= 3:
                assert done.clusters < n
    assert rolled < total
    assert rows_of(view.positions("2026-07-08T12:00:00Z", version=1)) == rows_of(
        build_positions(numbered(spark, everything[:60], 0), "2026-07-08T12:00:00Z", ordered=False)
    )


def test_only_touched_clusters_are_written(spark, tmp_path):
    view = PositionsView(spark, str(tmp_path / "view"), buckets=16)
    rows = [{"company_key": n, "company": n} for n in ["aaaa", "bbbbb", "cccccc", "ddddddd", "eeeeeeee"]]
    view.refresh(numbered(spark, rows, 0), "2026-07-02T00:00:00Z")
    done = view.refresh(numbered(spark, [{"company_key": "aaaa", "company": "aaaa"}], 5), "2026-07-02T00:00:00Z")
    assert (done.elected, done.clusters) == (1, 1)
    touched = view.store.buckets_of(spark.createDataFrame([("aaaa",)], "k string"), "k")
    everywhere = view.store.buckets_of(spark.createDataFrame([(r["company_key"],) for r in rows], "k string"), "k")
    written = {at.split("-")[0]: sorted(b for t, b, a in view.store.live() if t == "positions" and a == at) for _, _, at in view.store.live()}
    assert written == {"1": sorted(set(everywhere) - set(touched)), "2": touched}


def test_new_edges_are_those_that_are_missing(spark):
    rng = random.Random(2)
    words = sorted({w for w in NAMES} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    rng.shuffle(words)
    frame = lambda w: spark.createDataFrame([(x,) for x in w], "key string")
    all_pairs = {tuple(r) for r in similarity_edges(frame(words), 4).collect()}
    old = {tuple(r) for r in similarity_edges(frame(words[:40]), 4).collect()}
    assert {tuple(r) for r in new_edges(frame(words[:40]), frame(words[40:]), 4).collect()} == all_pairs - old


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1005), (2000, 2000)]
    got = {r["key"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {1000: 1000, 1001: 1000, 1005: 1000, 2000: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_store_versions_writers_and_compaction(spark, tmp_path):
    make = lambda: BucketStore(spark, str(tmp_path / "s"), {"t": Table("k string, v long", "k")}, 4)
    one, frame = make(), lambda rows: spark.createDataFrame(rows, "k string, v long")
    assert one.read("t").count() == 0
    for i in range(10):
        one.commit({}, {"t": frame([("a", i), (f"k{i}", i)])})
    assert sorted(r.v for r in one.read("t").filter("k = 'a'").collect()) == list(range(10))
    assert max(sum(b == x for _, b, _ in one.live()) for x in range(4)) <= 8
    assert one.read("t", version=3).count() == 6
    other = make()
    one.commit({"t": (frame([("a", 99)]), one.buckets_of(frame([("a", 0)]), "k"))})
    with pytest.raises(Conflict):
        other.commit({}, {"t": frame([("z", 1)])})
    assert one.read("t").filter("k = 'z'").count() == 0
    other.refresh()
    other.commit({}, {"t": frame([("z", 1)])})
    one.refresh()
    assert one.read("t").filter("k = 'z'").count() == 1
