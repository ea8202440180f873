"""PL-05: held, sent, empty, repeated and competing runs; the written digest is known as own mail."""

import pytest
from pyspark.sql import functions as F

from tests.test_digest import ALERT, alerts
from trackwise.operators import digest as G
from trackwise.plans import ingest as I
from trackwise.plans.digest import Digest, line_order, outgoing
from trackwise.sources.bucket_store import Conflict
from trackwise.sources.messages import assemble_messages, select_body


def texts(d, run_id):
    return [r.text for r in d.lines(run_id).orderBy(*line_order()).collect()]


def test_runs(spark, tmp_path):
    d = Digest(spark, str(tmp_path / "d"), window_s=3600, buckets=2)
    none = spark.createDataFrame([], ALERT)
    assert d.run("r0", none, 100).outcome == "none" and d.held().count() == 0
    first = alerts(spark, {"role": "Dev"}, {"role": "Ops", "thread_id": "x"})
    assert (lambda r: (r.outcome, r.items, r.repeated))(d.run("r1", first, 1000)) == ("sent", 2, False)
    want = [r.text for r in G.digest_rows(G.merge_alerts(none, first)).orderBy(*line_order()).collect()]
    assert texts(d, "r1") == want and d.held().count() == 0

    second = alerts(spark, {"company": "Zen", "company_key": "zen", "thread_id": "z", "seq": 7})
    assert d.run("r2", second, 1500).outcome == "queued" and d.held().count() == 1
    version = d.store.version()
    again = d.run("r2", second, 9000)  # repeated: found, not run
    assert again.outcome == "queued" and again.repeated and d.store.version() == version and texts(d, "r2") == []
    third = alerts(spark, {"company": "Zen", "company_key": "zen", "thread_id": "z", "seq": 9}, {"company": "Ant", "company_key": "ant", "thread_id": "a", "seq": 8})
    assert d.run("r3", third, 2000).items == 2  # one of thread z
    assert {(r.company_key, r.seq) for r in d.held().collect()} == {("zen", 7), ("ant", 8)}
    assert d.tick("t1", 4599).outcome == "queued" and d.tick("t2", 4600).outcome == "sent"  # the window's end, without new items
    assert d.held().count() == 0 and any("Zen" in t for t in texts(d, "t2")) and any("Ant" in t for t in texts(d, "t2"))
    assert d.tick("t3", 99999).outcome == "none"
    assert d.store.read("clock").first()["last_notified_epoch"] == 4600


def test_two_runs_at_once_and_a_lost_one(spark, tmp_path):
    root = str(tmp_path / "d")
    one, two = Digest(spark, root, buckets=2), Digest(spark, root, buckets=2)
    assert one.run("a", alerts(spark, {}), 1000).outcome == "sent"
    with pytest.raises(Conflict):
        two.run("b", alerts(spark, {"seq": 5, "thread_id": "q"}), 1001)
    two.store.refresh()
    assert two.run("b", alerts(spark, {"seq": 5, "thread_id": "q"}), 1001).outcome == "queued"

    def die(*args, **kwargs):
        raise RuntimeError("lost")

    two.store.commit = die
    with pytest.raises(RuntimeError):
        two.run("c", alerts(spark, {"seq": 6, "thread_id": "r"}), 99999)
    three = Digest(spark, root, buckets=2)
    assert three.held().count() == 1 and three.run("c", alerts(spark, {"seq": 6, "thread_id": "r"}), 99999).items == 2


def test_written_digest_is_own_mail(spark, tmp_path):
    many = spark.range(100_000).select(
        F.lit("Acme").alias("company"), F.lit("acme").alias("company_key"), F.concat(F.lit("Role "), F.col("id")).alias("role"),
        F.lit("Interview").alias("step"), F.lit("Invitation").alias("category"), F.lit("").alias("interview_datetime"), F.lit("").alias("summary"),
        F.lit("2026-07-01").alias("received"), F.concat(F.lit("t"), F.col("id")).alias("thread_id"), F.col("id").alias("seq"),
    )
    d = Digest(spark, str(tmp_path / "d"), buckets=4)
    assert d.run("big", many, 1_783_000_000).items == 100_000
    meta, headers, parts = outgoing(d.lines("big"), "big", 1_783_000_000, "me@example.com", per_message=5000)
    assert meta.count() == 21  # a title, a head, a tail and 100,000 roles
    bodies = {r.message_id: r.body for r in select_body(parts).collect()}
    joined = "\n".join(bodies[f"big/{k}"] for k in range(21)).split("\n")
    assert joined == texts(d, "big")[1:]
    mail = assemble_messages(headers, meta)
    assert mail.filter("is_self").count() == 21
    extra = {"sender_name": "", "sender_domain": "", "body": ""}
    mail = mail.select("*", *[F.lit(v).alias(c) for c, v in extra.items()], F.array().cast("array<string>").alias("links"), F.monotonically_increasing_id().alias("seq"))
    none = spark.createDataFrame([], "message_id string, thread_id string")

    class NoAnswers:
        def answers(self):
            return spark.createDataFrame([], "request_id string, json string")

    cfg = I.IngestConfig(as_of="2026-07-03T00:00:00Z", start_date="2026-01-01", terms=[])
    assert {r.route for r in I.route(mail, none, NoAnswers(), cfg).select("route").distinct().collect()} == {"self"}
    own = I.IngestConfig(as_of="2026-07-03T00:00:00Z", start_date="2026-01-01", terms=[], own_address="ME@example.com")
    assert I.route(mail, none, NoAnswers(), own).count() == 0  # FLT-03: mail from the own address is not even scanned
