"""Rule classifier, extraction, scorer normalisation, guards and failover."""

import json

from pyspark.sql import functions as F

from trackwise.functions import text as T
from trackwise.operators import scorer as S


def _one(spark, cols: dict, expr):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).collect()[0]["x"]


def msg(spark, subject, body="", sender_name="", sender_domain="", expr=None):
    return _one(spark, {"subject": subject, "body": body, "sender_name": sender_name, "sender_domain": sender_domain}, expr)


def test_rules(spark):
    assert msg(spark, "Your application", "Unfortunately we will not move on.", expr=T.rule_category()) == "Rejection"
    assert msg(spark, "עדכון", "לצערנו לא נמשיך", expr=T.rule_category()) == "Rejection"
    assert msg(spark, "Thanks for applying", "We will review it.", expr=T.rule_category()) == "Applied"
    assert msg(spark, "תודה על הגשת מועמדות", "", expr=T.rule_category()) == "Applied"
    # ack + invitation, ack + weak rejection cue → undecided
    assert msg(spark, "Thank you for applying", "Please pick a time for a call", expr=T.rule_category()) is None
    assert msg(spark, "Thank you for applying", "Best of luck in your search", expr=T.rule_category()) is None
    # ack opening, refusal later → Rejection
    assert msg(spark, "Thank you for applying", "We decided to move forward with other candidates.", expr=T.rule_category()) == "Rejection"


def test_signal_gate(spark):
    assert msg(spark, "Next steps", "Are you available for a phone screen?", expr=T.has_signal()) is True
    assert msg(spark, "Weekly digest", "Top stories of the week", expr=T.has_signal()) is False
    assert msg(spark, "Good news", "We are pleased to extend an offer", expr=T.has_signal()) is True


def test_company_extraction(spark):
    e = T.extract_company()
    assert msg(spark, "Thank you for applying to Zentrix", expr=e) == "Zentrix"
    assert msg(spark, "Hello", "", "Orbital Careers", "orbital.io", expr=e) == "Orbital"
    assert msg(spark, "Update", "", "no-reply", "blue-fin.com", expr=e) == "Blue fin"
    assert msg(spark, "Your interview", "Sent on behalf of Kestrel Dynamics, Inc.", "Hireflow", "", expr=e) == "Kestrel Dynamics"
    assert msg(spark, "Applying to the Platform Lead role", "", "", "acme.dev", expr=e) == "Acme"


def test_role_extraction(spark):
    r = T.extract_role()
    assert msg(spark, "Interview for Backend Engineer at Nimbus", expr=r) == "Backend Engineer"
    assert msg(spark, "Interview for Platform Managerat Agora", expr=r) == "Platform Manager"
    assert msg(spark, "Position: Data Analyst!", expr=r) == "Data Analyst"
    assert msg(spark, "Thank You for Applying to Ubeya", expr=r) == "Unknown"


def _norm(spark, obj):
    text = obj if isinstance(obj, str) else json.dumps(obj)
    df = spark.createDataFrame([(text,)], "json string")
    return df.select(S.normalize_response("json").alias("a")).collect()[0]["a"]


def test_normalize(spark):
    assert _norm(spark, "[1]") is None
    assert _norm(spark, {"company": "x"}) is None
    assert _norm(spark, {"is_relevant": "true"}) is None
    a = _norm(spark, {"is_relevant": True, "category": "Maybe", "step": " ", "apply_url": "ftp://x", "company": 7})
    assert (a["category"], a["step"], a["apply_url"], a["company"], a["role"]) == ("Other", "Update", "", "Unknown", "Unknown")
    assert a["interview_datetime"] is None


def test_guards(spark):
    df = spark.createDataFrame(
        [("Offer", "Offer call", "2026-07-01T10:00", "Sam Doe", "Pick a slot", ""),
         ("Offer", "Offer", "2026-07-01T10:00", "x", "Your base salary is attached", ""),
         ("Offer", "Offer", "", "x", "slot", "")],
        "category string, step string, interview_datetime string, interviewer_name string, body string, subject string",
    )
    a = F.struct("category", "step", "interview_datetime", "interviewer_name")
    out = df.select(S.strip_self(S.guard_offer(a), "sam doe").alias("a")).collect()
    assert (out[0]["a"]["category"], out[0]["a"]["step"], out[0]["a"]["interviewer_name"]) == ("Invitation", "Interview", "")
    assert out[1]["a"]["category"] == "Offer" and out[2]["a"]["category"] == "Offer"


def test_failover_matrix(spark):
    reqs = spark.createDataFrame([(r,) for r in "abcdef"], "request_id string")
    resp = spark.createDataFrame(
        [("a", "primary", 503, "P"), ("a", "fallback", 200, "F"), ("b", "primary", 429, "P"), ("b", "fallback", 200, "F"),
         ("c", "primary", 200, "P"), ("c", "fallback", 200, "F"), ("d", "primary", 400, "P"), ("d", "fallback", 200, "F"),
         ("e", "primary", 503, "P"), ("e", "fallback", 503, "F")],
        "request_id string, model string, http_status int, json string",
    )
    got = {r["request_id"]: r["json"] for r in S.fallback_responses(reqs, resp).collect()}
    assert got == {"a": "F", "b": "F", "c": "P", "d": None, "e": None, "f": None}
    same = {r["request_id"]: r["json"] for r in S.fallback_responses(reqs, resp, "primary", "primary").collect()}
    assert same["a"] is None
