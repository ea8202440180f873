"""SM-08: positions kept up to date batch by batch.

A batch of tracker rows changes the counts of its keys, adds keys, and with them similar pairs. Only keys in the connected
components that a changed or new key belongs to can get another leader, so these alone are elected again, from the stored pairs
and the pairs that a new key has with all keys. Of their clusters only those are rolled up again that got rows, won or
lost a key, or whose next interview has passed since the last refresh; the rest of a bucket is copied and the other buckets
are not read. Events, keys, pairs and positions are committed together (``sources.bucket_store``).

``seq`` numbers the rows over all batches. Repeating a batch counts its rows again, as repeating rows in one table does.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import text as T
from trackwise.functions import timefn as TF
from trackwise.operators import positions as P
from trackwise.operators.cluster import assign_leaders, new_edges
from trackwise.operators.components import components
from trackwise.session import stored
from trackwise.sources.bucket_store import BucketStore, Table

ROW = P.ROW_COLUMNS
_TEXT = [c for c in ROW if c != "seq"]
TABLES = {
    "events": Table(", ".join(f"{c} string" for c in _TEXT) + ", seq long, gkey string", "gkey"),
    "keys": Table("key string, cnt long, first_seen long, canonical string, component string", "key"),
    "pairs": Table("a string, b string", "a"),  # both ways
    "positions": Table(
        ", ".join(f"{c} {({'rounds': 'long', 'stale': 'boolean'}).get(c, 'string')}" for c in P.POSITION_COLUMNS)
        + ", cluster string, seg long, cluster_order struct<col1: long, first_seen: long, seq: long>",
        "cluster",
    ),
    "clock": Table("one int, minutes long", "one"),
}


@dataclass
class Refreshed:
    """What a refresh has done: its version, and the numbers of keys elected again and of clusters rolled up again."""

    version: int
    elected: int
    clusters: int


class PositionsView:
    def __init__(
        self, spark: SparkSession, root: str, buckets: int | None = None, tz: str = fixed.DISPLAY_TZ,
        min_contain: int = fixed.CONTAIN_MIN_LEN, min_len: int = 0,
    ):
        self.store = BucketStore(spark, root, TABLES, buckets)
        self.spark, self.tz, self.min_contain, self.min_len = spark, tz, min_contain, min_len

    def positions(self, as_of, version: int | None = None) -> DataFrame:
        """The positions of a version, with ``stale`` judged now."""
        pos = self.store.read("positions", version=version)
        terminal = T.is_terminal("category", "status")
        return pos.withColumn("stale", TF.is_stale("last_update", terminal, as_of))

    def refresh(self, rows: DataFrame, as_of) -> Refreshed:
        """Takes in a batch of tracker rows and brings the positions up to ``as_of``."""
        new = stored(rows.select(*ROW, P.group_key().alias("gkey")), "refresh-rows")
        old = self.store.read("keys")
        counts = stored(
            new.groupBy(F.col("gkey").alias("key")).agg(F.count(F.lit(1)).alias("more"), F.min("seq").alias("first")), "refresh-counts"
        )
        fresh = stored(counts.join(old.select("key"), "key", "left_anti").select("key"), "refresh-fresh")
        pairs = stored(new_edges(old.select("key"), fresh, self.min_contain, self.min_len), "refresh-pairs")
        keys = stored(self._elect(old, counts, fresh, pairs), "refresh-keys")

        before = old.select("key", F.struct("cnt", "first_seen", "canonical", "component").alias("was"))
        now = F.struct("cnt", "first_seen", "canonical", "component")
        changed = stored(keys.join(before, "key", "left").filter(~F.col("was").eqNullSafe(now)), "refresh-changed")
        moved = changed.filter(F.col("was").isNull() | (F.col("was.canonical") != F.col("canonical")) | (F.col("was.cnt") != F.col("cnt")))
        touched = moved.select(F.explode(F.array_compact(F.array("canonical", "was.canonical"))).alias("cluster"))
        touched = stored(touched.unionByName(self._due(as_of)).distinct(), "refresh-touched")

        after = old.join(changed.select("key"), "key", "left_anti").unionByName(changed.select(*old.columns))
        members = after.join(touched.withColumnRenamed("cluster", "canonical"), "canonical", "left_semi")
        members = stored(members.select(F.col("key").alias("gkey"), "cnt", "first_seen", F.col("canonical").alias("cluster")), "refresh-members")
        held = self.store.read("events", self.store.buckets_of(members, "gkey"))
        events = held.unionByName(new).join(members, "gkey").select(*P.EVENT_COLUMNS)
        events = stored(P.segment_events(events), "refresh-segments")
        rolled = P.position_rollup(events, as_of, self.tz).join(P.cluster_rank(events), "cluster")
        order = F.col("cluster_order")
        rolled = rolled.withColumn("cluster_order", F.struct(order["col1"].alias("col1"), order["first_seen"].alias("first_seen"), order["seq"].alias("seq")))

        key_buckets = self.store.buckets_of(changed, "key")
        pos_buckets = self.store.buckets_of(touched, "cluster")
        other_keys = self.store.read("keys", key_buckets).join(changed.select("key"), "key", "left_anti")
        other_pos = self.store.read("positions", pos_buckets).join(touched, "cluster", "left_anti")
        clock = self.spark.createDataFrame([(1, P.now_minutes(as_of, self.tz))], TABLES["clock"].schema)
        both_ways = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        version = self.store.commit(
            replace={
                "keys": (changed.select(*old.columns).unionByName(other_keys.select(*old.columns)), key_buckets),
                "positions": (rolled.select(*other_pos.columns).unionByName(other_pos), pos_buckets),
                "clock": (clock, self.store.buckets_of(clock, "one")),
            },
            append={"events": new, "pairs": both_ways},
        )
        return Refreshed(version, keys.count(), touched.count())

    def _due(self, as_of) -> DataFrame:
        """Clusters whose shown interview lay ahead at the last refresh and does not any more."""
        last = self.store.read("clock").agg(F.max("minutes")).first()[0]
        wm = P.wall_minutes("next_interview")
        passed = self.store.read("positions").filter((F.col("next_interview") != "") & (wm >= F.lit(last)) & (wm < P.now_minutes(as_of, self.tz)))
        return passed.select("cluster")

    def _elect(self, old: DataFrame, counts: DataFrame, fresh: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of ``keys`` for all members of the components that the batch touches."""
        # components as they were, a new key being one of its own; the new pairs link them
        home = old.select("key", "component").unionByName(fresh.select("key", F.col("key").alias("component")))
        ends = pairs.join(home.select(F.col("key").alias("a"), F.col("component").alias("ca")), "a").join(
            home.select(F.col("key").alias("b"), F.col("component").alias("cb")), "b"
        )
        merged = components(ends.filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        merged = merged.select(F.col("key").alias("component"), F.col("component").alias("into"))
        hit = home.join(counts, "key", "left_semi").select("component").unionByName(merged.select("component")).distinct()
        members = home.join(hit, "component", "left_semi").join(merged, "component", "left")
        members = members.select("key", F.coalesce("into", "component").alias("component"))
        # a new key is older than nothing: its label may be larger than the smallest member's, which is of no account
        stats = members.join(counts, "key", "left").join(old.select("key", "cnt", "first_seen"), "key", "left").select(
            "key", "component", (F.coalesce("cnt", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("cnt"), F.least("first_seen", "first").alias("first_seen"),
        )
        stats = stored(stats, "refresh-stats")
        held = self.store.read("pairs").filter("a < b").join(stats.select(F.col("key").alias("a")), "a", "left_semi")
        led = assign_leaders(stats.select("key", "cnt", "first_seen"), held.unionByName(pairs))
        return led.join(stats.select("key", "component"), "key").select(*old.columns)
