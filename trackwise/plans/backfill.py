"""PL-02: backfill of known threads in one job (JN-06, WN-06, ML-04, AG-08, ST-01, ST-03).

Threads are known from tracker rows and legacy markers. Of their messages that were never processed, those that
a tracker row without a message id stands for (same thread and time, one to one) are migrated: the row gets the id, the
message is cached and marked. All others go through rules, scorer and guards like new mail, without alerts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwise.functions import text as T
from trackwise.plans import ingest as I
from trackwise.plans import repair as R
from trackwise.session import cut_lineage


def number_within(df: DataFrame, keys: list[str], order: str, name: str = "nth") -> DataFrame:
    """WN-06: 1, 2, ... within equal keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)))


def match_migration(messages: DataFrame, tracker: DataFrame) -> DataFrame:
    """JN-06: (message_id, seq) pairs, the k-th message of a (thread, received) with its k-th row that has no id."""
    keys = ["thread_id", "received"]
    rows = tracker.filter((T.blank("message_id") == "") & (T.blank("thread_id") != "")).select(*keys, F.col("seq").alias("row_seq"))
    rows = number_within(rows, keys, "row_seq")
    found = number_within(messages.select("message_id", "seq", *keys), keys, "seq")
    return found.join(rows, [*keys, "nth"]).select("message_id", F.col("row_seq").alias("seq"))


def apply_migration(tracker: DataFrame, matches: DataFrame) -> DataFrame:
    """ML-04 (SNK-04): the matched rows with their message ids."""
    return R.apply_patch(tracker, matches, "seq", ["message_id"])


def backfill_routes(messages: DataFrame, tracker: DataFrame, processed: DataFrame, scorer, cfg: I.IngestConfig) -> DataFrame:
    """Unseen messages of known threads with ``route`` (``migrated`` among them), ``source`` and ``analysis``."""
    unseen = I.one_per_id(R.unseen_messages(messages, R.known_threads(tracker, processed), processed))
    matched = match_migration(unseen, tracker).select("message_id").withColumn("migrated", F.lit(True))
    no = F.lit(False)
    c = unseen.join(matched, "message_id", "left").withColumn("migrated", F.coalesce("migrated", no))
    # a migrated message needs no decision; done is what decide() leaves alone
    c = c.withColumn("is_done", F.col("migrated")).withColumn("undated", no).withColumn("is_late", no)
    routed = I.decide(I.with_key(c), scorer, cfg, messages.columns)
    return routed.withColumn("route", F.when(F.col("route") == "processed", "migrated").otherwise(F.col("route")))


def backfill_metrics(routed: DataFrame, threads: DataFrame) -> DataFrame:
    """AG-08: one row of counters."""
    r, relevant = F.col("route"), F.col("analysis")["is_relevant"]
    analyzed = r.isin("rule", "scored")
    counts = routed.agg(
        F.count("*").alias("messages_seen"),
        F.count_if(r == "migrated").alias("migrated"),
        F.count_if(analyzed & relevant).alias("appended"),
        F.count_if((r == "noise") | (analyzed & ~relevant)).alias("noise"),
        F.count_if(r.isin("scored", "failed")).alias("ai_calls"),
        F.count_if(r == "failed").alias("failed"),
    )
    return threads.agg(F.count("*").alias("threads_scanned")).crossJoin(F.broadcast(counts))  # one row each


@dataclass
class BackfillResult:
    tracker: DataFrame  # with migrated ids
    rows: DataFrame  # to append
    raw: DataFrame
    processed: DataFrame
    metrics: DataFrame


def backfill(messages: DataFrame, tracker: DataFrame, processed: DataFrame, scorer, cfg: I.IngestConfig) -> BackfillResult:
    """The whole job; the routed messages are stored once for its outputs."""
    threads = R.known_threads(tracker, processed)
    routed = cut_lineage(backfill_routes(messages, tracker, processed, scorer, cfg))
    migrated = routed.filter("route = 'migrated'")
    as_done = routed.withColumn("route", F.when(F.col("route") == "migrated", "rule").otherwise(F.col("route")))
    return BackfillResult(
        tracker=apply_migration(tracker, match_migration(migrated, tracker)),
        rows=I.tracker_rows(routed),
        raw=I.raw_rows(as_done),
        processed=I.processed_marks(as_done, cfg.as_of),
        metrics=backfill_metrics(routed, threads),
    )
