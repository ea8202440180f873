"""Ingest queries (PL-01 and its parts: SRC-01, FLT-01..03, JN-01/02, WN-04,
UD-01, JN-10, FN-11..13, FN-22..24, AG-07, SNK-02/03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.checks import duck as D
from trackwise.checks.duck_adapters import with_views
from trackwise.checks.registry import register
from trackwise.functions import patterns as P
from trackwise.operators import scorer as S
from trackwise.plans import ingest as I
from trackwise.sources import adapters as A

CFG = I.IngestConfig(as_of=A.MAIL_AS_OF, cursor=A.MAIL_CURSOR, candidate=A.CANDIDATE)
# a literal, so that the oracle does not ask the engine: 600 s before the cursor
SINCE = 1780359000
KW = P.whole_terms(fixed.SEARCH_TERMS)
EPOCH = "floor(epoch_ms(TRY_CAST(received AS TIMESTAMPTZ)) / 1000)"


def _scorer(spark, sf_dir):
    return S.TableScorer(A.responses(spark, sf_dir))


def _routed(spark, sf_dir):
    return I.route(A.mail(spark, sf_dir), A.processed(spark, sf_dir), _scorer(spark, sf_dir), CFG)


# --------------------------------------------------------------------------- oracle CTEs


def _str(j: str, path: str) -> str:
    return f"(CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END)"


def _trim_or(j: str, path: str, default: str) -> str:
    s = _str(j, path)
    return f"(CASE WHEN {s} IS NOT NULL AND {D.jtrim(s)} <> '' THEN {D.jtrim(s)} ELSE {default} END)"


def normalized_cte(src: str, name: str = "norm") -> str:
    """FN-11 over ``src(request_id, json)``."""
    j = "jv"
    cat = f"(CASE WHEN {_str(j, '$.category')} IN {D.qlist(fixed.CATEGORIES)} THEN {_str(j, '$.category')} ELSE 'Other' END)"
    default_step = "(CASE " + " ".join(f"WHEN {cat} = {D.q(k)} THEN {D.q(v)}" for k, v in fixed.DEFAULT_STEP.items()) + " END)"
    url = D.jtrim(_str(j, "$.apply_url"))
    return f"""{name} AS (
  SELECT request_id,
    (jv IS NOT NULL AND json_type(jv) = 'OBJECT' AND coalesce(json_type(jv, '$.is_relevant') = 'BOOLEAN', false)) AS valid,
    CAST(json_extract(jv, '$.is_relevant') AS BOOLEAN) AS is_relevant,
    {_trim_or(j, '$.company', "'Unknown'")} AS company,
    {_trim_or(j, '$.role', "'Unknown'")} AS role,
    {cat} AS category,
    {_trim_or(j, '$.step', default_step)} AS step,
    {_trim_or(j, '$.interview_datetime', 'NULL')} AS interview_datetime,
    coalesce({D.jtrim(_str(j, '$.summary'))}, '') AS summary,
    CASE WHEN {_str(j, '$.apply_url')} IS NOT NULL AND {D.rlike(url, P.HTTP_PREFIX)} THEN {url} ELSE '' END AS apply_url,
    coalesce({D.jtrim(_str(j, '$.interviewer_name'))}, '') AS interviewer_name
  FROM (SELECT request_id, CASE WHEN json_valid(json) THEN json END AS jv FROM {src}))"""


def fallback_cte(requests: str, name: str = "resp") -> str:
    """JN-10 over ``requests(request_id)`` and the ``responses`` view."""
    retry = f"p.http_status IN {tuple(fixed.RETRYABLE_HTTP)} AND f.http_status = 200"
    return f"""{name} AS (
  SELECT r.request_id,
    CASE WHEN p.http_status = 200 THEN 'primary' WHEN {retry} THEN 'fallback' END AS model,
    CASE WHEN p.http_status = 200 THEN p.json WHEN {retry} THEN f.json END AS json
  FROM {requests} r
  LEFT JOIN responses p ON p.request_id = r.request_id AND p.model = 'primary'
  LEFT JOIN responses f ON f.request_id = r.request_id AND f.model = 'fallback')"""


def routed_ctes() -> list[str]:
    return [
        f"""cand AS (SELECT * FROM mail WHERE coalesce({EPOCH}, {SINCE}) >= {SINCE}
            AND ({D.rlike(D.blank('subject'), KW)} OR {D.rlike(D.blank('body'), KW)}))""",
        "ids AS (SELECT DISTINCT message_id FROM processed)",
        "legacy AS (SELECT DISTINCT message_id AS thread_id FROM processed WHERE thread_id = '')",
        f"""c2 AS (SELECT cand.*,
            message_id IN (SELECT message_id FROM ids) AS is_done,
            coalesce(thread_id IN (SELECT thread_id FROM legacy) AND {EPOCH} <= {CFG.cursor or 0}, false) AS is_late, {EPOCH} IS NULL AS undated,
            {D.rule_category()} AS rcat, {D.has_signal()} AS sig FROM cand)""",
        *decided_ctes(),
    ]


def decided_ctes() -> list[str]:
    """From ``c2`` (messages with is_done, undated, is_late, rcat, sig) to ``routed``."""
    text = D.mail_text()
    comp = D.rlike(text, P.COMPENSATION)
    hit = f"(n_category = 'Offer' AND coalesce(n_interview, '') <> '' AND NOT {comp})"
    cand = CFG.candidate.strip().lower()
    return [
        "chosen AS (SELECT message_id FROM c2 WHERE NOT is_done AND NOT undated AND NOT is_late AND NOT is_self AND rcat IS NULL AND sig)",
        fallback_cte("(SELECT message_id AS request_id FROM chosen)", "resp"),
        normalized_cte("resp", "norm"),
        f"""r0 AS (
  SELECT c2.*, n.request_id AS n_id, n.is_relevant AS n_rel, n.company AS n_company, n.role AS n_role,
    n.category AS n_category, n.step AS n_step, n.interview_datetime AS n_interview, n.summary AS n_summary,
    n.apply_url AS n_url, n.interviewer_name AS n_iv,
    CASE WHEN is_done THEN 'processed' WHEN undated THEN 'undated' WHEN is_late THEN 'late' WHEN is_self THEN 'self'
         WHEN rcat IS NOT NULL THEN 'rule' WHEN NOT sig THEN 'noise'
         WHEN ch.message_id IS NULL THEN 'deferred' WHEN n.request_id IS NULL THEN 'failed' ELSE 'scored' END AS route
  FROM c2 LEFT JOIN chosen ch USING (message_id) LEFT JOIN norm n ON n.request_id = c2.message_id AND n.valid)""",
        f"""routed AS (
  SELECT message_id, thread_id, received, sender_domain, seq, route,
    CASE WHEN is_done THEN '' WHEN rcat IS NOT NULL THEN 'rule' ELSE 'ai' END AS source,
    CASE WHEN route = 'rule' THEN true WHEN route = 'scored' THEN n_rel END AS is_relevant,
    CASE WHEN route = 'rule' THEN {D.extract_company()} WHEN route = 'scored' THEN n_company END AS company,
    CASE WHEN route = 'rule' THEN {D.extract_role()} WHEN route = 'scored' THEN n_role END AS role,
    CASE WHEN route = 'rule' THEN rcat WHEN route = 'scored' THEN (CASE WHEN {hit} THEN 'Invitation' ELSE n_category END) END AS category,
    CASE WHEN route = 'rule' THEN (CASE WHEN rcat = 'Rejection' THEN 'Rejected' ELSE 'Applied' END)
         WHEN route = 'scored' THEN (CASE WHEN {hit} AND {D.rlike('n_step', P.OFFER_WORD)} THEN 'Interview' ELSE n_step END) END AS step,
    CASE WHEN route = 'scored' THEN n_interview END AS interview_datetime,
    CASE WHEN route = 'rule' THEN {D.blank('subject')} WHEN route = 'scored' THEN n_summary END AS summary,
    CASE WHEN route = 'rule' THEN '' WHEN route = 'scored' THEN n_url END AS apply_url,
    CASE WHEN route = 'rule' THEN ''
         WHEN route = 'scored' THEN (CASE WHEN {D.norm('n_iv')} = {D.q(cand)} THEN '' ELSE n_iv END) END AS interviewer_name,
    subject, body, sender_name, links
  FROM r0)""",
    ]


def _ingest_sql(select: str, frm: str = "routed", where: str = "TRUE") -> str:
    return with_views("mail", "processed", "responses", extra=routed_ctes()) + f"SELECT {select} FROM {frm} WHERE {where}"


ROUTE_COLS = "message_id, route, source, is_relevant, company, role, category, step, interview_datetime, summary, apply_url, interviewer_name"


@register("ingest_routes", _ingest_sql(ROUTE_COLS))
def ingest_routes(spark, sf_dir):
    """PL-01 core: every candidate message with its route and final analysis."""
    r = _routed(spark, sf_dir)
    a = F.col("analysis")
    return r.select(
        "message_id", "route", "source", *[a[f].alias(f) for f in S.ANALYSIS_FIELDS]
    )


@register(
    "ingest_metrics",
    _ingest_sql(
        "count(*) FILTER (WHERE route IN ('rule','scored')) AS scanned, "
        "count(*) FILTER (WHERE route IN ('processed','undated','late','self')) AS skipped, "
        "count(*) FILTER (WHERE route IN ('rule','scored') AND is_relevant) AS relevant, "
        "count(*) FILTER (WHERE route IN ('rule','scored') AND is_relevant AND category = 'Invitation') AS invitations, "
        "count(*) FILTER (WHERE route IN ('rule','scored') AND is_relevant AND category = 'Offer') AS offers, "
        "count(*) FILTER (WHERE route = 'rule') AS rule_classified, "
        "count(*) FILTER (WHERE route IN ('scored','failed')) AS ai_calls, "
        "count(*) FILTER (WHERE route = 'noise' OR (route IN ('rule','scored') AND NOT is_relevant)) AS irrelevant, "
        "count(*) FILTER (WHERE route = 'failed') AS failed, "
        "count(*) FILTER (WHERE route = 'deferred') AS deferred"
    ),
)
def ingest_metrics(spark, sf_dir):
    """AG-07."""
    return I.ingest_metrics(_routed(spark, sf_dir))


@register(
    "ingest_tracker_rows",
    _ingest_sql(
        f"received, company, {D.entity_key('company', 'sender_domain')} AS company_key, role, step, category, "
        "coalesce(interview_datetime, '') AS interview_datetime, summary, step AS status, source, thread_id, "
        "apply_url AS link, interviewer_name AS interviewer, message_id, seq",
        where="route IN ('rule','scored') AND is_relevant",
    ),
)
def ingest_tracker_rows(spark, sf_dir):
    """FN-23 + FN-10: tracker rows appended by the run (SNK-01 payload)."""
    return I.tracker_rows(_routed(spark, sf_dir))


@register(
    "ingest_alerts",
    _ingest_sql(
        f"company, {D.entity_key('company', 'sender_domain')} AS company_key, role, step, category, "
        "coalesce(interview_datetime, '') AS interview_datetime, summary, received, thread_id, seq",
        where="route IN ('rule','scored') AND is_relevant AND category IN ('Invitation','Offer')",
    ),
)
def ingest_alerts(spark, sf_dir):
    """FN-24."""
    return I.alert_rows(_routed(spark, sf_dir))


@register(
    "ingest_raw",
    _ingest_sql(
        f"message_id, thread_id, received, sender_name, sender_domain, subject, body, "
        f"('[' || array_to_string(list_transform(links, lambda x: '\"' || x || '\"'), ',') || ']') AS links, seq",
        where="route IN ('rule','scored')",
    ),
)
def ingest_raw(spark, sf_dir):
    """SNK-02 projection: rows cached in raw (rule + scored, not noise)."""
    return I.raw_rows(_routed(spark, sf_dir))


@register(
    "ingest_processed",
    _ingest_sql(f"message_id, thread_id, {D.q(CFG.as_of)} AS processed_at", where="route IN ('self','rule','noise','scored')"),
)
def ingest_processed(spark, sf_dir):
    """SNK-03: messages the run marks as processed."""
    return I.processed_marks(_routed(spark, sf_dir), CFG.as_of)


@register(
    "normalize_responses",
    with_views("responses", extra=["prim AS (SELECT request_id, json FROM responses WHERE model = 'primary')", normalized_cte("prim")])
    + "SELECT request_id, valid, "
    + ", ".join(f"CASE WHEN valid THEN {f} END AS {f}" for f in S.ANALYSIS_FIELDS)
    + " FROM norm",
)
def normalize_responses(spark, sf_dir):
    """FN-11 over every primary-model response."""
    r = A.responses(spark, sf_dir).filter(F.col("model") == "primary")
    a = S.normalize_response("json")
    return r.select("request_id", a.isNotNull().alias("valid"), *[a[f].alias(f) for f in S.ANALYSIS_FIELDS])


@register(
    "scorer_fallback",
    with_views("mail", "responses", extra=["req AS (SELECT message_id AS request_id FROM mail)", fallback_cte("req")])
    + "SELECT request_id, model, json FROM resp",
)
def scorer_fallback(spark, sf_dir):
    """JN-10 + UD-01 (TableScorer)."""
    m = A.mail(spark, sf_dir).select(F.col("message_id").alias("request_id"))
    return S.fallback_responses(m, A.responses(spark, sf_dir))


@register(
    "scorer_requests",
    with_views("mail")
    + f"SELECT message_id AS request_id, subject, body, "
    "received AS email_date, sender_name, sender_domain, array_to_string(links, chr(10)) AS links FROM mail",
)
def scorer_requests(spark, sf_dir):
    """FN-22."""
    return S.build_requests(A.mail(spark, sf_dir))


@register(
    "scan_messages",
    with_views("mail")
    + f"SELECT message_id, thread_id, received FROM mail WHERE coalesce({EPOCH}, {SINCE}) >= {SINCE} "
    f"AND ({D.rlike(D.blank('subject'), KW)} OR {D.rlike(D.blank('body'), KW)})",
)
def scan_messages(spark, sf_dir):
    """SRC-01 + FLT-02 (cursor − overlap) + FLT-01."""
    return I.scan_messages(A.mail(spark, sf_dir), SINCE, None).select("message_id", "thread_id", "received")


@register(
    "split_late",
    with_views("mail", "processed")
    + f"""SELECT message_id, (thread_id IN (SELECT DISTINCT message_id FROM processed WHERE thread_id = '')
         AND coalesce({EPOCH} <= {CFG.cursor}, false)) AS is_late
    FROM mail WHERE message_id NOT IN (SELECT message_id FROM processed)""",
)
def split_late(spark, sf_dir):
    """JN-01 (anti join on processed ids) + JN-02 (legacy thread at/before cursor)."""
    m, p = A.mail(spark, sf_dir), A.processed(spark, sf_dir)
    fresh, _ = I.split_processed(m, p)
    return I.late_flag(fresh, p, CFG.cursor).select("message_id", "is_late")
