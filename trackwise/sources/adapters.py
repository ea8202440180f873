"""Input adapters: deterministic views of the driver tables in the shapes the
operators consume (SURVEY §5.4). Every column is derived from the driver rows
with built-in functions, so the work grows with the tables; the DuckDB oracle
builds the same views from ``trackwise.checks.duck_adapters``.

* ``tracker``   ← events        one tracker row per event
* ``mail``      ← conversations one message per turn, subject/body from a template
* ``processed`` / ``raw`` / ``responses`` / ``headers`` / ``meta`` ← mail
* ``parts``     ← conversations MIME parts of one message per conversation
* ``alerts``    ← tracker       Invitation/Offer rows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import text as T

TRACKER_AS_OF = "2024-01-20T12:00:00Z"
MAIL_AS_OF = "2026-06-10T12:00:00Z"
MAIL_CURSOR = 1780359600  # 2026-06-02T00:20:00Z, epoch seconds
PROCESSED_AT = "2026-06-01T00:00:00.000Z"
CANDIDATE = "Candidate Name"
OWN_ADDRESS = "me@inbox.example"

# Invented message templates (subject, opening of the body). The body of each
# message is the template opening followed by the conversation turn's text.
MAIL_TEMPLATES = [
    ("Thank you for applying to Lumora", "Hi, we received your application and our team will review it."),
    ("Your application to Brightwave Labs", "Unfortunately, we will not be moving forward with your application."),
    ("Interview invitation - Senior Backend Engineer", "We would like to invite you to a technical interview. Please pick a time below."),
    ("Offer for the position of Staff Engineer", "We are happy to make you an offer. Your base salary and start date are attached."),
    ("Application received: Product Manager position at Nordhaven", "Thank you for your application. We will keep your CV for future opportunities."),
    ("This week in cloud tooling", "Ten tips for faster builds and a new release of our command line."),
    ("תודה על הגשת המועמדות", "קיבלנו את קורות החיים שלך ונחזור אליך בקרוב."),
    ("עדכון לגבי מועמדותך", "לצערנו לא נמשיך בתהליך בשלב זה."),
    ("Next steps for the Data Analyst role", "Are you available for a phone screen with the hiring manager this week?"),
    ("Update on your role with Quillstone", "After careful review we decided to move forward with other candidates."),
    ("Thanks for applying for the Frontend Developer opening", "Sent by Hireflow on behalf of Kestrel Dynamics. We will be in touch."),
    ("Schedule your interview for Platform Engineerat Tidewell", "Please book a slot that suits you."),
    ("Offer call with the hiring team", "We would like to offer you an interview slot on Tuesday."),
]

# Invented From headers, chosen by conv_id
MAIL_SENDERS = [
    '"Lumora Careers" <careers@lumora.io>',
    "no-reply@brightwave-labs.com",
    '"Dana Ofek" <dana.ofek@Nordhaven.co>',
    '"Talent Team" <talent@quillstone.com>',
    "",
    '"Kestrel Dynamics | Jobs" <jobs@kestrel.dev>',
    "recruiting@tide_well.org",
    '"Hireflow" <notifications@hireflow.app>',
]

TRACKER_ROLES = [
    "Data Engineer",
    "Senior Data Engineer",
    "Product Manager",
    "Product Manager, Payments",
    "Unknown",
    "",
    "n/a",
    "Backend Developer",
    " data engineer ",
    "Data Engineer",
]
INVITATION_STEPS = ["HR screen", "Technical interview", "Home assignment", "Final interview"]
MANUAL_VALUES = ["Applied", "Interviewing", "Offer", "Rejected", "Withdrawn", "Archived"]

# (json text, label) of the untyped scorer responses, chosen by (conv_id + turn) % 12
RESPONSE_BODIES = [
    '{"is_relevant": true, "company": " Lumora ", "role": "Data Engineer", "category": "Invitation", '
    '"step": "HR screen", "interview_datetime": "2026-06-20T10:00:00", "summary": "Pick a slot", '
    '"apply_url": "https://jobs.example.org/1", "interviewer_name": "Noa Levin"}',
    '{"company": "Nordhaven"}',
    '{"is_relevant": "true", "company": "Quillstone"}',
    '{"is_relevant": true, "company": 42, "category": "Applied"}',
    '{"is_relevant": true, "category": "Maybe", "step": "  "}',
    '{"is_relevant": true, "company": "Tidewell", "category": "Offer", "step": "", "interview_datetime": "2026-06-21 09:30"}',
    '{"is_relevant": true, "category": "Other", "apply_url": "ftp://files.example.org/x"}',
    "[1, 2]",
    "not json at all",
    '{"is_relevant": false}',
    '{"is_relevant": true, "company": "Kestrel Dynamics", "category": "Offer", "step": "Offer extended", '
    '"interview_datetime": null, "summary": " Congrats "}',
    '{"is_relevant": true, "category": "Invitation", "interviewer_name": "candidate name", '
    '"interview_datetime": " 2026-06-22T15:00 ", "role": "Platform Engineer"}',
]
PRIMARY_STATUS = [200, 200, 429, 503, 400, 200]
FALLBACK_STATUS = [200, 503, 200, 200]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(index: Column, values: list) -> Column:
    """values[index] for a small fixed list, as a CASE expression (no join)."""
    expr = None
    for i, v in enumerate(values):
        expr = (F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v)))
    return expr


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# ---------------------------------------------------------------------------
# tracker ← events
# ---------------------------------------------------------------------------


def tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    key12 = F.substring(F.md5(F.col("user_id").cast("string")), 1, 12)
    e = F.col("event_id")
    ev = ev.select("event_id", "ts", "user_id", "event_type", k.alias("k"), key12.alias("key12"))
    k = F.col("k")
    category = (
        F.when(F.col("event_type") == "signup", "Applied")
        .when(F.col("event_type") == "view", "Other")
        .when(F.col("event_type") == "click", "Invitation")
        .when(F.col("event_type") == "purchase", "Offer")
        .when((F.col("event_type") == "error") & (k < 10), "Rejection")
        .otherwise("Other")
    )
    ev = ev.withColumn("category", category)
    cat = F.col("category")
    step = (
        F.when(cat == "Applied", "Applied")
        .when(cat == "Invitation", _pick(k % 4, INVITATION_STEPS))
        .when(cat == "Offer", F.when(k % 5 == 0, "").otherwise("Offer"))
        .when(cat == "Rejection", F.when(k % 3 == 0, "Not selected").otherwise("Rejected"))
        .otherwise(F.when(k % 2 == 0, "Update").otherwise(""))
    )
    ev = ev.withColumn("step", step)
    later = F.col("ts") + F.make_dt_interval(F.lit(0), k, F.lit(0), F.lit(0))
    interview = F.when(
        k % 3 == 0,
        F.when(e % 4 == 0, F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(e % 4 == 1, F.date_format(later, "yyyy-MM-dd HH:mm"))
        .when(e % 4 == 2, F.date_format(later, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise("TBD"),
    ).otherwise("")
    return ev.select(
        iso_millis(F.col("ts")).alias("received"),
        F.when((e % 13 == 0) & (e % 97 != 0), "Unknown").otherwise(F.upper("key12")).alias("company"),
        F.when(e % 97 == 0, "")
        .when(e % 7 == 0, F.substring("key12", 2, 11))
        .otherwise(F.col("key12"))
        .alias("company_key"),
        _pick(k % 10, TRACKER_ROLES).alias("role"),
        F.col("step"),
        F.col("category"),
        interview.alias("interview_datetime"),
        F.concat(F.col("event_type"), F.lit(" #"), e.cast("string")).alias("summary"),
        F.when(k.between(40, 45), _pick(k - 40, MANUAL_VALUES))
        .when(k == 46, "On hold")
        .otherwise(F.col("step"))
        .alias("status"),
        F.when(cat.isin("Applied", "Rejection"), "rule").otherwise("ai").alias("source"),
        F.concat(F.lit("t"), F.col("user_id").cast("string"), F.lit("-"), (k % 4).cast("string")).alias("thread_id"),
        F.when(k % 4 == 1, F.concat(F.lit("https://jobs.example.com/"), F.col("key12"), F.lit("/"), k.cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("https://www."), F.col("key12"), F.lit(".com/careers")))
        .otherwise("")
        .alias("link"),
        F.when((cat == "Invitation") & (k % 2 == 0), F.concat(F.lit("Interviewer "), (k % 7).cast("string")))
        .otherwise("")
        .alias("interviewer"),
        F.when(e % 11 == 0, "").otherwise(F.concat(F.lit("m"), e.cast("string"))).alias("message_id"),
        e.alias("seq"),
    )


# ---------------------------------------------------------------------------
# mail ← conversations
# ---------------------------------------------------------------------------


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cv = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    c, t = F.col("conv_id"), F.col("turn")
    tmpl = (c * 7 + t) % len(MAIL_TEMPLATES)
    start = F.lit("2026-06-01 00:00:00").cast("timestamp_ntz")
    received = start + F.make_dt_interval(F.lit(0), c.cast("int"), (t * 37).cast("int"), F.lit(0))
    from_header = _pick(c % len(MAIL_SENDERS), MAIL_SENDERS)
    df = cv.select(
        F.concat(F.lit("c"), c.cast("string"), F.lit("-"), t.cast("string")).alias("message_id"),
        F.concat(F.lit("c"), c.cast("string"), F.lit("-0")).alias("thread_id"),
        _pick(tmpl, [s for s, _ in MAIL_TEMPLATES]).alias("subject"),
        F.concat(_pick(tmpl, [b for _, b in MAIL_TEMPLATES]), F.lit("\n"), T.blank("text")).alias("body"),
        F.when((c % 41 == 11) & (t == 2), F.lit("")).otherwise(iso_millis(received)).alias("received"),
        from_header.alias("from_header"),
        F.when(t % 2 == 0, F.array(F.concat(F.lit("https://jobs.example.org/c"), c.cast("string"), F.lit("/"), t.cast("string"))))
        .otherwise(F.array().cast("array<string>"))
        .alias("links"),
        (F.col("role") == "system").alias("is_self"),
        (c * 100 + t).alias("seq"),
        c.alias("conv_id"),
        t.alias("turn"),
    )
    return df.select(
        "message_id",
        "thread_id",
        "subject",
        "body",
        "received",
        T.sender_name("from_header").alias("sender_name"),
        T.sender_domain("from_header").alias("sender_domain"),
        "links",
        "is_self",
        "seq",
        "conv_id",
        "turn",
        "from_header",
    )


def mail_links_json(links: str | Column = "links") -> Column:
    """JSON text of a link array, written the same way by both engines."""
    return F.concat(F.lit("["), F.array_join(F.transform(T.col(links), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turn 0 (and turn 1 of every 4th conversation) processed; every 5th
    conversation's first message is a legacy thread marker (thread column '')."""
    m = mail(spark, sf_dir).select("message_id", "thread_id", "conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    legacy = (t == 0) & (c % 5 == 0)
    normal = ((t == 0) & (c % 5 != 0)) | ((t == 1) & (c % 4 == 0))
    return m.filter(legacy | normal).select(
        F.when(legacy, F.col("thread_id")).otherwise(F.col("message_id")).alias("message_id"),
        F.when(legacy, F.lit("")).otherwise(F.col("thread_id")).alias("thread_id"),
        F.lit(PROCESSED_AT).alias("processed_at"),
    )


def raw_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cache rows (links as JSON text, corrupt for every 11th conversation);
    some messages are cached twice, the later copy has a corrected body."""
    m = mail(spark, sf_dir).filter(F.col("conv_id") % 3 != 0)
    c = F.col("conv_id")
    base = m.select(
        "message_id",
        "thread_id",
        "received",
        "sender_name",
        "sender_domain",
        "subject",
        "body",
        F.when(c % 11 == 0, F.lit("[bad")).otherwise(mail_links_json()).alias("links"),
        "seq",
    )
    again = m.filter((F.col("turn") == 1) & (c % 7 == 0)).select(
        "message_id",
        "thread_id",
        "received",
        "sender_name",
        "sender_domain",
        "subject",
        F.concat(F.lit("Corrected copy: "), F.col("body")).alias("body"),
        mail_links_json().alias("links"),
        (F.col("seq") + 50).alias("seq"),
    )
    return base.unionByName(again)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untyped scorer output per message and model with an HTTP status."""
    m = mail(spark, sf_dir).select("message_id", "conv_id", "turn")
    c, t = F.col("conv_id"), F.col("turn")
    body = _pick((c + t) % len(RESPONSE_BODIES), RESPONSE_BODIES)
    prim = m.select(
        F.col("message_id").alias("request_id"),
        F.lit("primary").alias("model"),
        _pick((c + t) % len(PRIMARY_STATUS), PRIMARY_STATUS).alias("http_status"),
        body.alias("json"),
    )
    fb = m.select(
        F.col("message_id").alias("request_id"),
        F.lit("fallback").alias("model"),
        _pick((c + t * 2) % len(FALLBACK_STATUS), FALLBACK_STATUS).alias("http_status"),
        body.alias("json"),
    )
    return prim.unionByName(fb)


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long header rows (message_id, pos, name, value) with mixed-case names,
    a duplicate Subject on every 4th turn, a missing Subject on every 9th
    conversation and the self marker on system turns."""
    m = mail(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn")
    from_name = _pick(c % 3, ["From", "from", "FROM"])
    rows = [
        m.select("message_id", F.lit(0).alias("pos"), from_name.alias("name"), F.col("from_header").alias("value")),
        m.filter(c % 9 != 0).select("message_id", F.lit(1).alias("pos"), F.lit("Subject").alias("name"), F.col("subject").alias("value")),
        m.select("message_id", F.lit(2).alias("pos"), F.lit("Date").alias("name"), F.col("received").alias("value")),
        m.filter(t % 4 == 0).select(
            "message_id", F.lit(3).alias("pos"), F.lit("subject").alias("name"), F.concat(F.lit("Dup: "), F.col("subject")).alias("value")
        ),
        m.filter(F.col("is_self")).select(
            "message_id", F.lit(4).alias("pos"), F.initcap(F.lit(fixed.SELF_MARKER_HEADER)).alias("name"), F.lit(fixed.SELF_MARKER_VALUE).alias("value")
        ),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message metadata: thread id and internal epoch-ms (missing on every 6th
    conversation, so the Date header is used)."""
    m = mail(spark, sf_dir)
    ms = F.unix_millis(F.try_to_timestamp(F.col("received")))
    return m.select(
        "message_id",
        "thread_id",
        F.when(F.col("conv_id") % 6 == 0, F.lit(None).cast("bigint")).otherwise(ms).alias("internal_ms"),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MIME parts: one message per conversation, one part per turn; user turns
    are text/plain, assistant turns text/html, system turns multipart; data is
    URL-safe base64 of the text."""
    cv = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    mime = F.when(F.col("role") == "user", "text/plain").when(F.col("role") == "assistant", "text/html").otherwise("multipart/mixed")
    data = F.translate(F.base64(F.encode(T.blank("text"), "UTF-8")), "+/", "-_")
    return cv.select(
        F.concat(F.lit("p"), F.col("conv_id").cast("string")).alias("message_id"),
        F.lpad(F.col("turn").cast("string"), 3, "0").alias("path"),
        mime.alias("mime"),
        data.alias("data"),
    )


def page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with anchors added: the page's own address twice (spaced and in capitals the second time, with
    trailing marks), and one that is noise."""
    u = F.col("url")
    more = F.concat(
        F.lit('<a href="'), u, F.lit('">x</a><A HREF = \''), u, F.lit(").'>y</A><a href=\"https://example.org/unsubscribe?u="), F.col("page_id").cast("string"), F.lit('">z</a>')
    )
    return _read(spark, sf_dir, "pages").select("page_id", "url", F.concat(T.blank("html"), more).alias("html"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invitation/Offer tracker rows as alert items; even seq = held from an
    earlier window (pending), odd = new this run."""
    tr = tracker(spark, sf_dir).filter(F.col("category").isin("Invitation", "Offer"))
    return tr.select(
        "company",
        "company_key",
        "role",
        "step",
        "category",
        "interview_datetime",
        "summary",
        "received",
        "thread_id",
        "seq",
        (F.col("seq") % 2 == 0).alias("pending"),
    )


def mail_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker rows for the mail archive as an older classifier left them (the
    input of the repair passes): category by (conv_id + turn) % 5, its default
    step, a hand-set Withdrawn on some rows, an interview time on every third
    turn, and no message id on every 4th conversation (pre-migration rows)."""
    m = mail(spark, sf_dir)
    c, t = F.col("conv_id"), F.col("turn")
    idx = (c + t) % len(fixed.CATEGORIES)
    step = _pick(idx, [fixed.DEFAULT_STEP[x] for x in fixed.CATEGORIES])
    return m.select(
        "received",
        F.concat(F.lit("Co"), c.cast("string")).alias("company"),
        F.concat(F.lit("co"), c.cast("string")).alias("company_key"),
        F.concat(F.lit("Role "), (t % 3).cast("string")).alias("role"),
        step.alias("step"),
        _pick(idx, fixed.CATEGORIES).alias("category"),
        F.when(t % 3 == 1, F.lit("2026-06-15T10:00")).otherwise(F.lit("")).alias("interview_datetime"),
        F.col("subject").alias("summary"),
        F.when(t % 7 == 3, F.lit("Withdrawn")).otherwise(step).alias("status"),
        F.lit("ai").alias("source"),
        "thread_id",
        F.lit("").alias("link"),
        F.lit("").alias("interviewer"),
        F.when(c % 4 == 0, F.lit("")).otherwise(F.col("message_id")).alias("message_id"),
        "seq",
    )
