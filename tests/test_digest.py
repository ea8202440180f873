"""ST-02, SM-05, AG-11, AG-12, SO-04: merging, the gate and its state, the lines of a digest."""

from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.operators import digest as G

ALERT = "company string, company_key string, role string, step string, category string, interview_datetime string, summary string, received string, thread_id string, seq bigint"


def alerts(spark, *rows):
    base = {"company": "Acme", "company_key": "acme", "role": "Dev", "step": "Interview", "category": "Invitation", "interview_datetime": "", "summary": "", "received": "2026-07-01"}
    names = [c.split()[0] for c in ALERT.split(", ")]
    return spark.createDataFrame([tuple({**base, "thread_id": f"t{i}", "seq": i, **r}[c] for c in names) for i, r in enumerate(rows)], ALERT)


def state(spark, *last):
    return spark.createDataFrame([(x,) for x in last], "last_notified_epoch bigint")


def test_gate_and_state(spark):
    items = G.merge_alerts(alerts(spark), alerts(spark, {}, {"company": "Zen", "company_key": "zen"}))

    def outcome(last, now, what=items):
        s = state(spark, *last)
        gated = G.gate(what, s, now, 3600)
        return {r.outcome for r in gated.collect()}, [r[0] for r in G.next_state(gated, s, now).collect()]

    assert outcome([], 1000) == ({"sent"}, [1000])  # never notified
    assert outcome([900], 1000) == ({"queued"}, [900])
    assert outcome([900], 4500) == ({"sent"}, [4500])  # the window has just closed
    assert outcome([900, 700], 4400) == ({"queued"}, [900])  # the latest state counts
    assert outcome([900], 9000, items.filter("false")) == (set(), [900])  # nothing to say


def test_lines_in_order(spark):
    pending = alerts(spark, {"role": "Ops", "received": "2026-07-01", "thread_id": "x"})
    new = alerts(
        spark,
        {"role": "Dev", "received": "2026-07-03", "interview_datetime": "2026-07-09T10:00", "summary": "call"},
        {"company": "Zen", "company_key": "zen", "role": "", "step": "", "category": "Offer"},
        {"role": "Dev", "received": "2026-07-02", "thread_id": "x"},  # the thread is there already
    )
    lines = G.digest_rows(G.merge_alerts(pending, new)).orderBy("part", "c_src", "c_seq", "is_role", F.col("received").desc(), "r_src", "r_seq")
    assert [r.text for r in lines.collect()] == [
        "Status digest: 3 items from 2 companies",
        fixed.DIGEST_BODY_HEAD_MANY,
        "■ Acme",
        "  • Dev — Interview\n    Interview scheduled for 2026-07-09T10:00\n    call",
        "  • Ops — Interview",
        "■ Zen",
        f"  • {fixed.DIGEST_NO_ROLE} — Offer",
        fixed.DIGEST_BODY_TAIL,
    ]
    one = G.digest_rows(G.merge_alerts(pending, new.filter("false"))).filter("part < 2").orderBy("part")
    assert [r.text for r in one.collect()] == ["Status digest: news from Acme", fixed.DIGEST_BODY_HEAD_ONE]
    assert G.digest_rows(G.merge_alerts(pending.filter("false"), new.filter("false"))).count() == 0
