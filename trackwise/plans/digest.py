"""PL-05: the digest as one plan over stored state (SRC-08, SM-05, SNK-05, SNK-08).

A run takes in a batch of alerts: held items ∪ new ones → merge → gate → lines. While the window since the last digest is open
the merged items are held; after it they are written as lines and nothing is held. A run without alerts (``tick``) sends what
is held once the window has ended. Held items, the clock, the lines and the run's own record are one commit of a
``BucketStore``: a run that dies leaves the state before it, a run that is repeated finds its record and changes nothing, and of
two runs at once the second fails with ``Conflict`` and may be repeated after ``store.refresh()``.

``outgoing`` makes mail of a run's lines: numbered by ranges, put together in messages of bounded length, with the header by which
the next scan knows its own mail (FLT-03).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.operators import digest as G
from trackwise.operators.ranges import number_rows
from trackwise.session import stored
from trackwise.sources.bucket_store import BucketStore, Table

ALERTS = ", ".join(f"{c} {'long' if c == 'seq' else 'string'}" for c in G.ALERT_COLS)
LINES = (
    "part int, company_key string, c_src int, c_seq long, is_role int, received string, r_src int, r_seq long, text string"
)
TABLES = {
    "held": Table(ALERTS, "thread_id"),
    "clock": Table("one int, last_notified_epoch long", "one"),
    "runs": Table("run_id string, outcome string, items long, epoch long", "run_id"),
    "lines": Table(f"run_id string, {LINES}", "run_id"),
}
#: Lines of one outgoing message.
MESSAGE_LINES = 500


@dataclass
class DigestRun:
    outcome: str  # 'sent', 'queued' or 'none'
    items: int
    repeated: bool = False


def line_order() -> list[Column]:
    """The order in which a digest's lines are read (SO-04)."""
    return [F.col("part"), F.col("c_src"), F.col("c_seq"), F.col("company_key"), F.col("is_role"), F.col("received").desc(), F.col("r_src"), F.col("r_seq")]


class Digest:
    def __init__(
        self, spark: SparkSession, root: str, window_s: int = fixed.DIGEST_WINDOW_MINUTES * 60, mode: str = "thread", buckets: int | None = None
    ):
        self.spark, self.window_s, self.mode = spark, window_s, mode
        self.store = BucketStore(spark, root, TABLES, buckets)

    def run(self, run_id: str, alerts: DataFrame, epoch: int) -> DigestRun:
        """Takes in ``alerts`` at ``epoch``. A ``run_id`` that has been committed is not run again."""
        before = self.store.read("runs").filter(F.col("run_id") == run_id).first()
        if before:
            return DigestRun(before["outcome"], before["items"], True)
        merged = stored(G.merge_alerts(self.store.read("held"), alerts, self.mode), "digest-items")
        state = self.store.read("clock").select("last_notified_epoch")
        gated = G.gate(merged, state, epoch, self.window_s)
        seen = gated.agg(F.count(F.lit(1)).alias("n"), F.max("outcome").alias("outcome")).first()
        done = DigestRun(seen["outcome"] or "none", seen["n"])
        record = self.spark.createDataFrame([(run_id, done.outcome, done.items, epoch)], TABLES["runs"].schema)
        replace, append = {}, {"runs": record}
        everywhere = list(range(self.store.buckets))
        if done.outcome == "queued":
            replace["held"] = (merged, everywhere)
        elif done.outcome == "sent":
            after = G.next_state(gated, state, epoch).withColumn("one", F.lit(1))
            replace = {"held": (merged.limit(0), everywhere), "clock": (after, everywhere)}
            append["lines"] = G.digest_rows(merged).withColumn("run_id", F.lit(run_id))
        self.store.commit(replace, append)
        return done

    def tick(self, run_id: str, epoch: int) -> DigestRun:
        """A run without alerts: sends what is held if the window has ended."""
        return self.run(run_id, self.spark.createDataFrame([], ALERTS), epoch)

    def held(self) -> DataFrame:
        return self.store.read("held")

    def lines(self, run_id: str) -> DataFrame:
        return self.store.read("lines", self.store.buckets_of(self.spark.createDataFrame([(run_id,)], "r string"), "r")).filter(
            F.col("run_id") == run_id
        )


def outgoing(
    lines: DataFrame, run_id: str, epoch: int, from_address: str, per_message: int = MESSAGE_LINES
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, headers, parts) of the messages that carry a run's lines, as ``sources.messages`` reads mail.

    A message has up to ``per_message`` lines, so neither a digest nor a company in it is one row."""
    subject = F.first(F.when(F.col("part") == 0, F.col("text")), True)
    head = lines.agg(subject.alias("subject"))  # one row
    body = number_rows(lines.filter("part > 0"), line_order())
    bodies = body.groupBy(F.floor(F.col("n") / per_message).alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("n", "text"))).alias("rows")  # per_message rows at most
    )
    mail = bodies.crossJoin(F.broadcast(head)).select(
        F.concat(F.lit(f"{run_id}/"), F.col("chunk").cast("string")).alias("message_id"),
        F.coalesce("subject", F.lit(fixed.NO_SUBJECT)).alias("subject"),
        F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("body"),
    )
    mail = stored(mail, "digest-mail")
    meta = mail.select("message_id", F.lit(run_id).alias("thread_id"), F.lit(epoch * 1000).cast("long").alias("internal_ms"))
    fields = [("Subject", F.col("subject")), ("From", F.lit(from_address)), (fixed.SELF_MARKER_HEADER.title(), F.lit(fixed.SELF_MARKER_VALUE))]
    rows = F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(n).alias("name"), v.alias("value")) for k, (n, v) in enumerate(fields, 1)])
    headers = mail.select("message_id", F.inline(rows))
    data = F.translate(F.base64(F.encode("body", "UTF-8")), "+/\r\n", "-_")
    parts = mail.select("message_id", F.lit("0").alias("path"), F.lit("text/plain").alias("mime"), data.alias("data"))
    return meta, headers, parts
