"""PL-01 routing, its invariances, and the repair paths that golden queries cannot show."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import tracker_df
from trackwise.operators import scorer as S
from trackwise.operators import view as V
from trackwise.plans import backfill as B
from trackwise.plans import ingest as I
from trackwise.plans import repair as R
from trackwise.sources import adapters as A
from trackwise.sources import messages as M

SF = "/root/testdata/sf0.001"
CFG = I.IngestConfig(as_of="2026-07-02T00:00:00Z", cursor=1782000000, terms=[], candidate="Sam Doe")
MSG = "message_id string, thread_id string, subject string, body string, received string, sender_name string, sender_domain string, links array<string>, is_self boolean, seq bigint"


def messages(spark, *rows):
    base = {"thread_id": "t", "subject": "", "body": "", "received": "2026-07-01T09:00:00.000Z", "sender_name": "", "sender_domain": "acme.dev",
            "links": [], "is_self": False}
    names = [c.split()[0] for c in MSG.split(", ")]
    return spark.createDataFrame([tuple({**base, "message_id": f"m{i}", "seq": i, **r}[c] for c in names) for i, r in enumerate(rows)], MSG)


def no_processed(spark, *rows):
    return spark.createDataFrame(list(rows), "message_id string, thread_id string, processed_at string")


def routes(df):
    return {r["message_id"]: r["route"] for r in df.select("message_id", "route").collect()}


ANSWER = {"is_relevant": True, "company": "Acme", "role": "Dev", "category": "Invitation", "step": "Interview"}


def seen_scorer(log=None):
    def answer(pdf: pd.DataFrame) -> pd.Series:
        return pd.Series([json.dumps({**ANSWER, "summary": f"{len(b)}:{s}"}) if "no answer" not in b else "oops" for s, b in zip(pdf["subject"], pdf["body"])])

    return S.PandasScorer(answer)


def test_routes(spark):
    m = messages(
        spark,
        {"subject": "Update", "body": "x" * 10_000 + " unfortunately we will not move on"},  # the only cue stands at the end
        {"subject": "Phone screen", "body": "are you available for an interview?"},
        {"subject": "Phone screen", "body": "are you available for an interview? no answer"},
        {"subject": "Menu of the week", "body": "soup"},
        {"is_self": True, "subject": "Phone screen"},
        {"received": "", "subject": "Phone screen"},
        {"received": "n/a", "subject": "Phone screen"},
        {"received": "2026-06-01T00:00:00.000Z", "subject": "too old"},
        {"thread_id": "legacy", "received": "2026-06-20T23:55:00.000Z", "subject": "Phone screen"},
        {"subject": "done before"},
    )
    p = no_processed(spark, ("legacy", "", "x"), ("m9", "t", "x"))
    got = routes(I.route(m, p, seen_scorer(), CFG))
    assert got == {"m0": "rule", "m1": "scored", "m2": "failed", "m3": "noise", "m4": "self", "m5": "undated", "m6": "undated",
                   "m8": "late", "m9": "processed"}
    out = I.ingest(m, p, seen_scorer(), CFG)
    assert {r.message_id for r in out.processed.collect()} == {"m0", "m1", "m3", "m4"}
    assert {r.message_id for r in I.side_rows(out.routed).collect()} == {"m5", "m6", "m8"}
    row = out.metrics.first()
    assert (row["scanned"], row["skipped"], row["ai_calls"], row["failed"], row["deferred"]) == (2, 5, 2, 1, 0)
    body = out.raw.filter("message_id = 'm0'").first()["body"]
    assert len(body) > 10_000
    assert I.advance_cursor(row, 77, 5) == 5 and I.advance_cursor({"failed": 0, "deferred": 0}, 77, 5) == 77


def test_quota_defers_the_oldest(spark):
    m = messages(spark, *[{"subject": "Phone screen", "received": f"2026-07-01T0{i}:00:00.000Z"} for i in range(4)])
    cfg = I.IngestConfig(**{**CFG.__dict__, "max_per_run": 2})
    assert routes(I.route(m, no_processed(spark), seen_scorer(), cfg)) == {"m0": "deferred", "m1": "deferred", "m2": "scored", "m3": "scored"}


def test_repeated_messages_count_once(spark):
    m, p, s = A.mail(spark, SF), A.processed(spark, SF), S.TableScorer(A.responses(spark, SF))
    cfg = I.IngestConfig(as_of=A.MAIL_AS_OF, cursor=A.MAIL_CURSOR)
    once, twice = (routes(I.route(x, p, s, cfg)) for x in (m, m.unionByName(m)))
    assert once == twice and I.route(m.unionByName(m), p, s, cfg).count() == len(once)


def test_repeated_answers_count_once(spark):
    m, p, r = A.mail(spark, SF), A.processed(spark, SF), A.responses(spark, SF)
    cfg = I.IngestConfig(as_of=A.MAIL_AS_OF, cursor=A.MAIL_CURSOR)
    once = I.route(m, p, S.TableScorer(r), cfg)
    worse = r.limit(50).withColumn("http_status", F.lit(500)).withColumn("json", F.lit(None).cast("string"))
    again = I.route(m, p, S.TableScorer(r.unionByName(r).unionByName(r).unionByName(worse)), cfg)
    assert again.count() == once.count()
    said = lambda df: sorted(map(str, df.select("message_id", "route", "analysis").collect()))
    assert said(again) == said(once)
    requests = m.select(F.col("message_id").alias("request_id"))
    assert S.fallback_responses(requests.unionByName(requests), r).count() == requests.distinct().count()


def test_messages_without_an_id_stay_apart(spark):
    m = messages(
        spark,
        {"subject": "Phone screen", "body": "are you available for an interview?"},
        {"message_id": None, "subject": "Phone screen", "body": "first"},
        {"message_id": None, "subject": "Phone screen", "body": "second"},
        {"message_id": "", "subject": "Phone screen", "body": "third"},
    )
    p = no_processed(spark, (None, "t", "x"), ("", "t", "x"))
    out = I.ingest(m, p, seen_scorer(), CFG)
    got = [(r.message_id, r.route) for r in out.routed.select("message_id", "route").collect()]
    assert sorted(got, key=str) == sorted([("m0", "scored"), (None, "unidentified"), (None, "unidentified"), ("", "unidentified")], key=str)
    assert {r.body for r in I.side_rows(out.routed).collect()} == {"first", "second", "third"}
    assert [r.message_id for r in out.processed.collect()] == ["m0"] and out.metrics.first()["skipped"] == 3


def test_scan_is_pushed_and_mail_read_once(spark, tmp_path):
    m = messages(spark, {"subject": "Phone screen"}, {"received": ""})
    m.write.parquet(str(tmp_path / "mail"))
    read = spark.read.parquet(str(tmp_path / "mail"))
    plan = I.route(read, no_processed(spark), S.TableScorer(spark.createDataFrame([], "request_id string, model string, http_status int, json string")), CFG)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1
    assert "GreaterThanOrEqual(received" in text


def test_scorer_gets_whole_messages_in_reprocess(spark):
    tr = tracker_df(spark, [{"message_id": "m0"}])
    raw = messages(spark, {"subject": "Phone screen", "body": "call " + "y" * 9000}).withColumn("links", F.lit("[]")).drop("is_self")
    out = R.reprocess(tr, raw, messages(spark), seen_scorer())
    assert out["classified"].first()["new"]["summary"] == f"{9005}:Phone screen"
    assert out["metrics"].first().asDict() == {"rows_examined": 1, "skipped_no_raw": 0, "backfilled_raw": 0, "reclassified": 1, "ai_calls": 1, "failed": 0}


def test_archive_needs_a_thread(spark):
    tr = tracker_df(spark, [{"message_id": "", "thread_id": ""}, {"message_id": "", "thread_id": "t"}])
    tr = tr.withColumn("received", F.lit("2026-07-01T09:00:00.000Z"))
    mail = messages(spark, {"thread_id": ""}, {"thread_id": "t"})
    raw = mail.withColumn("links", F.lit("[]")).filter("false").drop("is_self")
    got = {r.seq: r.raw_from for r in R.attach_raw(tr, R.read_raw(raw), mail).collect()}
    assert got == {0: None, 1: "archive"}


def test_protections_and_dry_run(spark):
    tr = tracker_df(spark, [
        {"message_id": "m0", "category": "Invitation", "step": "Interview"},  # an acknowledgement does not undo an invitation
        {"message_id": "m1", "category": "Applied", "step": "Applied", "status": "Withdrawn"},  # a hand-set status stays
    ])
    raw = messages(spark, {"subject": "Thank you for applying", "body": "received your application"},
                   {"subject": "News", "body": "unfortunately no"}).withColumn("links", F.lit("[]")).drop("is_self")
    changes = R.reprocess(tr, raw, messages(spark), seen_scorer())["changes"]
    assert {(r.seq, r.field) for r in changes.collect()} == {(1, "step"), (1, "category")}
    assert R.apply_reclassified(tr, changes).exceptAll(tr).count() == 0
    after = R.apply_reclassified(tr, changes, dry_run=False).filter("seq = 1").first()
    assert (after["step"], after["category"], after["status"]) == ("Rejected", "Rejection", "Withdrawn")


def test_null_status_is_rejected_and_order_is_needed(spark):
    up = spark.createDataFrame([("a", None, 1), ("b", "Offer", 2), ("c", "Maybe", 3)], "id string, status string, ord bigint")
    ok, bad = R.validate_status(up)
    assert [r.id for r in ok.collect()] == ["b"] and {r.id for r in bad.collect()} == {"a", "c"}
    with pytest.raises(ValueError):
        R.update_status(tracker_df(spark, [{}]), up.drop("ord"))


def test_migration_is_one_to_one(spark):
    at = "2026-07-01T09:00:00.000Z"
    tr = tracker_df(spark, [{"message_id": "", "thread_id": "t", "received": at}, {"message_id": "", "thread_id": "t", "received": at},
                            {"message_id": "", "thread_id": "", "received": at}, {"message_id": "m7", "thread_id": "t", "received": at}])
    mail = messages(spark, {}, {}, {"subject": "News", "body": "unfortunately no"}, {"thread_id": ""}, {"thread_id": "other"})
    out = B.backfill(mail, tr, no_processed(spark), seen_scorer(), CFG)
    assert [r.message_id for r in out.tracker.orderBy("seq").collect()] == ["m0", "m1", "", "m7"]
    assert [r.message_id for r in out.rows.collect()] == ["m2"]
    assert {r.message_id for r in out.processed.collect()} == {"m0", "m1", "m2"}
    m = out.metrics.first()
    assert (m["threads_scanned"], m["messages_seen"], m["migrated"], m["appended"], m["failed"]) == (1, 3, 2, 1, 0)


def test_wall_times_out_of_range(spark):
    df = spark.createDataFrame([("2026-00-05T09:30",), ("2026-13-05T09:30",), ("2026-06-31T25:10",)], "next_interview string")
    df = df.select("next_interview", F.lit("k").alias("key"), F.lit("Dev").alias("role"), F.lit("Acme").alias("company"), F.lit("").alias("link"))
    labels = [r[0] for r in df.select(V.format_interview("next_interview")).collect()]
    assert labels[0].startswith("undefined 5, 2026") and labels[1].startswith("undefined 5, 2026") and labels[2].startswith("Jun 31, 2026")
    feed = V.calendar_feed(df).collect()
    assert feed[2]["start"] == "20260631T251000" and feed[2]["end"] == "20260702T021000"


def test_links_keep_their_order_and_number(spark):
    urls = [f"https://a.example/{i}" for i in range(40)]
    html = "".join(f'<a href="{u}">' for u in [*urls, *urls, "https://a.example/unsubscribe", "ftp://b"])
    df = spark.createDataFrame([(html, "see https://c.example/x). and https://a.example/3")], "h string, t string")
    got = df.select(M.harvest_links(F.col("h"), F.col("t"))).first()[0]
    assert got == [*urls, "https://c.example/x"]
