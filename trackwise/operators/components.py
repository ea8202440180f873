"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwise.session import stored


def components(links: DataFrame) -> DataFrame:
    """(key, component) for all keys of ``links`` (a, b); ``component`` is the smallest key reachable.

    In each round a key takes the smallest label among its neighbours, the label itself takes the smallest that one of its
    keys has found, and every key then jumps to its label's label; the number of rounds grows with the logarithm of the distances."""
    if links.isEmpty():
        return links.select(F.col("a").alias("key"), F.col("a").alias("component"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct(), "component-links")
    label = stored(both.select(F.col("a").alias("key"), F.col("a").alias("component")).distinct(), "component-labels")
    while True:
        near = both.join(label.select(F.col("key").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        found = label.join(near.withColumnRenamed("a", "key"), "key").select("key", "component", F.least("component", "near").alias("low"))
        found = stored(found, "component-found")
        hooked = found.groupBy("component").agg(F.min("low").alias("hook")).withColumnRenamed("component", "key")
        lower = found.join(hooked, "key", "left").select(
            "key", "component", F.least("low", F.coalesce("hook", "low")).alias("low")
        )
        lower = stored(lower, "component-lower")
        ends = lower.select(F.col("key").alias("low"), F.col("low").alias("end"))
        jumped = stored(lower.join(ends, "low").select("key", "component", F.least("low", "end").alias("new")), "component-jumped")
        label = jumped.select("key", F.col("new").alias("component"))
        if jumped.filter("new <> component").isEmpty():
            return label
