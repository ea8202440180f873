"""SNK-04 and SNK-06: patches touch their buckets only; files of three generations read as one table."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import tracker_df
from trackwise.plans.tracker_store import TrackerStore, patch_buckets
from trackwise.sources.bucket_store import BucketStore, Conflict, Narrowed, Table


def test_patch_rewrites_its_buckets_only(spark, tmp_path):
    rows = tracker_df(spark, [{"message_id": f"m{i}"} for i in range(40)])
    t = TrackerStore(spark, str(tmp_path / "t"), buckets=8)
    t.append(rows)
    updates = spark.createDataFrame([("m3", "Offer", 1), ("m3", "Withdrawn", 2), ("m9", "bogus", 3), ("nope", "Offer", 4)], "id string, status string, ord long")
    touched, rejected = t.update_status(updates)
    assert touched == t.store.buckets_of(spark.createDataFrame([(3,)], "seq long"), "seq")
    assert {(r.id, r.status) for r in rejected.collect()} == {("m9", "bogus"), ("nope", "Offer")}
    after = {r.seq: r.status for r in t.read().collect()}
    assert after == {i: "Withdrawn" if i == 3 else "Applied" for i in range(40)}
    assert {r.status for r in t.read(version=1).collect()} == {"Applied"}  # readers of the version before
    rewritten = {b for _, b, at in t.store.live() if at.startswith("2-")}
    assert rewritten == set(touched)
    # unknown keys change nothing, several rows for one key are refused
    assert patch_buckets(t.store, "tracker", spark.createDataFrame([(999, "Offer")], "seq long, status string"), ["status"]) == []
    with pytest.raises(ValueError):
        patch_buckets(t.store, "tracker", spark.createDataFrame([(1, "a"), (1, "b")], "seq long, status string"), ["status"])
    assert t.store.version() == 2


def test_two_patches_from_one_version(spark, tmp_path):
    a = TrackerStore(spark, str(tmp_path / "t"), buckets=2)
    a.append(tracker_df(spark, [{}, {}]))
    b = TrackerStore(spark, str(tmp_path / "t"), buckets=2)
    one = lambda s: spark.createDataFrame([(1, s)], "seq long, status string")
    patch_buckets(a.store, "tracker", one("Offer"), ["status"])
    with pytest.raises(Conflict):
        patch_buckets(b.store, "tracker", one("Rejected"), ["status"])
    assert a.read().filter("seq = 1").first()["status"] == "Offer" and a.read().count() == 2


def test_three_generations_of_columns(spark, tmp_path):
    root = str(tmp_path / "s")
    store = lambda schema, **d: BucketStore(spark, root, {"t": Table(schema, "k", d)}, 2)
    store("k string, v long").commit({}, {"t": spark.createDataFrame([("a", 1)], "k string, v long")})
    second = store("k string, v long, note string", note="")
    second.commit({}, {"t": spark.createDataFrame([("a", 2, "x")], "k string, v long, note string")})
    third = store("k string, s struct<x: int, y: string>, v long, note string", note="")
    third.commit({}, {"t": spark.range(1).select(F.lit("a").alias("k"), F.struct(F.lit(1).alias("x"), F.lit("q").alias("y")).alias("s"), F.lit(3).cast("long").alias("v"), F.lit(None).cast("string").alias("note"))})
    got = {(r.v, r.note, r.s and r.s.y) for r in third.read("t").collect()}
    assert got == {(1, "", None), (2, "x", None), (3, "", "q")}
    for narrow in ("k string, v long, note string", "k string, v int, note string, s struct<x: int, y: string>"):
        with pytest.raises(Narrowed):
            store(narrow)
    with pytest.raises(Narrowed):  # a writer that still has the old columns
        second.refresh()
        second.commit({}, {"t": spark.createDataFrame([("a", 4, "z")], "k string, v long, note string")})
    assert third.read("t").count() == 3
