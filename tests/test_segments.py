"""WN-01 and the orders SO-01/02 against plain Python on random event logs, one cluster and one instant being hot."""

import random
import re

from pyspark.sql import functions as F

from trackwise.operators import positions as P
from trackwise.plans.positions import build_positions
from trackwise.sources import adapters as A

WALL = re.compile(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d).*", re.S)


def test_segments_by_walking(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        cluster = rng.choice(["hot"] * 3 + ["b", "c"])
        received = rng.choice(["2026-07-01T09:00:00.000Z"] * 3 + [f"2026-07-0{rng.randint(1, 9)}T0{rng.randint(0, 9)}:00:00.000Z", ""])
        rows.append((cluster, received, rng.randint(1, 3), rng.randint(0, 5), i, rng.random() < 0.1))
    df = spark.createDataFrame(rows, "cluster string, received string, cnt bigint, first_seen bigint, seq bigint, closes boolean")
    got = {r.seq: r.seg for r in P.segment_events(df.repartition(5), boundary=F.col("closes")).collect()}
    want, seen = {}, {}
    for cluster, received, cnt, first, seq, closes in sorted(rows, key=lambda r: (r[0], r[1], -r[2], r[3], r[4])):
        want[seq] = seen.get(cluster, 0)
        seen[cluster] = seen.get(cluster, 0) + closes
    assert got == want


def test_ranges_do_not_follow_keys(spark):
    rows = [("hot", "2026-07-01T09:00:00.000Z", 1, 0, i, False) for i in range(4000)]
    df = spark.createDataFrame(rows, "cluster string, received string, cnt bigint, first_seen bigint, seq bigint, closes boolean")
    order = [F.col("received"), F.col("cnt").desc(), F.col("first_seen"), F.col("seq")]
    sizes = [r["count"] for r in df.repartitionByRange(8, F.col("cluster"), *order).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2000


def test_orders(spark):
    pos = build_positions(A.tracker(spark, "/root/testdata/sf0.001"), A.TRACKER_AS_OF, ordered=False)
    rows = [r.asDict() for r in pos.collect()]
    default = sorted(rows, key=lambda r: (tuple(r["cluster_order"]), r["seg"]))
    default.sort(key=lambda r: r["last_update"], reverse=True)
    default.sort(key=lambda r: (not WALL.match(r["next_interview"]), WALL.sub(r"\1\2", r["next_interview"])[:15] if WALL.match(r["next_interview"]) else ""))
    keys = lambda rs: [(r["cluster"], r["seg"]) for r in rs]
    assert keys(P.order_positions(pos).collect()) == keys(default)
    recent = sorted(default, key=lambda r: r["last_update"], reverse=True)
    assert keys(P.order_positions(pos, "recent").collect()) == keys(recent)
    names = [r["company"] for r in P.order_positions(pos, "company").collect()]
    assert names == [r[0] for r in pos.select("company").orderBy(F.expr("company COLLATE UNICODE")).collect()]
