"""Names and roles read out of subjects and bodies: golden cases, and both engines on awkward lines."""

import duckdb
import pytest

from trackwise.checks import duck as D
from trackwise.functions import text as T

# subject, body, sender name, sender domain, company, role
CASES = [
    ("Thank you for applying to Alder Works.", "", "Mira Tal", "brook-hr.com", "Alder Works", "Unknown"),
    ("Thanks for applying for the Lead Data Engineer position at Cobalt Shield", "", "Ron Vega", "jobs.cobalt.dev", "Cobalt Shield", "Lead Data Engineer"),
    ("Norvik 👋 Thanks for applying to the Platform Lead role", "", "no-reply@norvik.com", "norvik.com", "Norvik", "Unknown"),
    ("News about your application to Fennel", "", "no-reply@eu.relay.io", "eu.relay.io", "Fennel", "Unknown"),
    ("An update on your application", "Sent by Relay Hire on behalf of Marsh Security. Sadly no.", "Lia Or", "marsh.relay.com", "Marsh Security", "Unknown"),
    ("An update", "on behalf of 7 people, on behalf of Monday.works, Ltd", "Lia Or", "x.com", "Monday.works", "Unknown"),
    ("Thank You for Applying to Yarrow 🏟️", "", "Gil - Yarrow", "yarrow.relay.com", "Yarrow", "Unknown"),
    ("", "", "Tarn Careers", "", "Tarn", "Unknown"),
    ("", "", "no-reply", "blue-fin.com", "Blue fin", "Unknown"),
    ("", "", "", "", "Unknown", "Unknown"),
    (None, None, None, None, "Unknown", "Unknown"),
    ("Chat at Quarry & Sons | jobs", "", "", "", "Quarry & Sons", "Unknown"),
    ("Interview for Platform Managerat Agora", "", "", "agora.io", "Agora", "Platform Manager"),
    ("Interview for the  QA   Lead with us", "", "", "", "Unknown", "QA Lead"),
    ("Role - Front-end developer, Berlin!", "", "", "", "Unknown", "Front-end developer, Berlin"),
    ("position:Data Analyst @Heron", "", "", "", "Unknown", "Data Analyst"),
    ("Your interview for Site Lead @ Heron", "", "", "", "Unknown", "Site Lead @ Heron"),
    ("A slot for the Staff Engineer", "", "", "", "Unknown", "Staff Engineer"),
    ("A slot for Staff, Engineer", "", "", "", "Unknown", "Unknown"),
    ("application - to Heron", "", "", "", "Unknown", "Unknown"),
    ("Applied with X", "", "", "", "Unknown", "Unknown"),
    ("apply for the", "", "", "", "Unknown", "the"),
    ("position of position at Heron", "", "", "", "Heron", "position"),
    ("תודה על הגשת המועמדות for Data Lead", "", "", "", "Unknown", "Data Lead"),
]
LINES = [
    "applied at\tHeron\nInc", "role:", "role :  -x", "for The Lead", "for the Lead.", "@at @", "x @y at", "the role at the", "a_at B", "2at For for A",
    "applying to Über GmbH", "interview for é at", "application for a position at  O'Hara & Co. - Talent", "  ", "at", "for", "Re: position of Lead at Heron",
    "application to A application to Be", "role with position at Cedar's-", "interview for Leadrole", "interview for role", "for (Lead)", "at Heron at Cedar",
]


def test_golden(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, subject string, body string, sender_name string, sender_domain string, c string, r string")
    got = df.select("i", T.extract_company().alias("company"), T.extract_role().alias("role")).orderBy("i").collect()
    assert [(g.company, g.role) for g in got] == [c[4:] for c in CASES]


@pytest.mark.parametrize("column", ["subject", "body"])
def test_engines_agree(spark, column):
    words = ["at", "for", "the", "role", "Position", "applying", "to", "Heron", "&", "-", ":", "@", "on behalf of", "O'Hara", "with", "2b", "é", ".", ", "]
    lines = [c[0] or "" for c in CASES] + LINES
    for n in range(400):  # words dealt by a fixed rule
        lines.append("".join(words[(n * 7 + k * k * (n % 11 + 1) + k) % len(words)] + (" " if (n + k) % 5 else "") for k in range(n % 9 + 2)))
    df = spark.createDataFrame(list(enumerate(lines)), f"i int, {column} string")
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t (i int, {column} varchar)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(lines)))
    if column == "subject":
        ours = df.select("i", T.company_from_subject().alias("a"), T.extract_role().alias("b"))
        sql = f"SELECT i, {D.company_from_subject()}, {D.extract_role()} FROM t ORDER BY i"
    else:
        ours = df.select("i", T.company_from_behalf().alias("a"), T.jtrim("body").alias("b"))
        sql = f"SELECT i, {D.company_from_behalf()}, {D.jtrim('body')} FROM t ORDER BY i"
    assert [tuple(r) for r in ours.orderBy("i").collect()] == con.execute(sql).fetchall()


def test_tokens_lose_nothing(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "x string")
    from pyspark.sql import functions as F

    from trackwise.functions import reading as R

    assert df.filter(F.array_join(R.tokens(F.col("x")), "") != F.col("x")).count() == 0
