"""The adapter views of ``trackwise.sources.adapters`` written as DuckDB SQL.

Each function returns a ``name AS (...)`` CTE body; ``with_views`` assembles the
ones a query needs (dependencies first)."""

from __future__ import annotations

from trackwise import fixed
from trackwise.checks import duck as D
from trackwise.sources import adapters as A


def _case(index: str, values: list) -> str:
    parts = " ".join(f"WHEN {index} = {i} THEN {D.q(v) if isinstance(v, str) else v}" for i, v in enumerate(values))
    return f"(CASE {parts} END)"


def iso_millis(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


TRACKER = f"""
tracker_base AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         substr(md5(CAST(user_id AS VARCHAR)), 1, 12) AS key12
  FROM events
),
tracker_cat AS (
  SELECT *,
    CASE WHEN event_type = 'signup' THEN 'Applied' WHEN event_type = 'view' THEN 'Other'
         WHEN event_type = 'click' THEN 'Invitation' WHEN event_type = 'purchase' THEN 'Offer'
         WHEN event_type = 'error' AND k < 10 THEN 'Rejection' ELSE 'Other' END AS category
  FROM tracker_base
),
tracker_step AS (
  SELECT *,
    CASE WHEN category = 'Applied' THEN 'Applied'
         WHEN category = 'Invitation' THEN {_case('k % 4', A.INVITATION_STEPS)}
         WHEN category = 'Offer' THEN (CASE WHEN k % 5 = 0 THEN '' ELSE 'Offer' END)
         WHEN category = 'Rejection' THEN (CASE WHEN k % 3 = 0 THEN 'Not selected' ELSE 'Rejected' END)
         ELSE (CASE WHEN k % 2 = 0 THEN 'Update' ELSE '' END) END AS step,
    ts + to_hours(k) AS later
  FROM tracker_cat
),
tracker AS (
  SELECT
    {iso_millis('ts')} AS received,
    CASE WHEN event_id % 13 = 0 AND event_id % 97 <> 0 THEN 'Unknown' ELSE upper(key12) END AS company,
    CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 7 = 0 THEN substr(key12, 2, 11) ELSE key12 END AS company_key,
    {_case('k % 10', A.TRACKER_ROLES)} AS role,
    step,
    category,
    CASE WHEN k % 3 = 0 THEN
      (CASE WHEN event_id % 4 = 0 THEN strftime(later, '%Y-%m-%dT%H:%M:%S')
            WHEN event_id % 4 = 1 THEN strftime(later, '%Y-%m-%d %H:%M')
            WHEN event_id % 4 = 2 THEN strftime(later, '%Y-%m-%dT%H:%M:%S') || 'Z'
            ELSE 'TBD' END)
    ELSE '' END AS interview_datetime,
    event_type || ' #' || CAST(event_id AS VARCHAR) AS summary,
    CASE WHEN k BETWEEN 40 AND 45 THEN {_case('k - 40', A.MANUAL_VALUES)} WHEN k = 46 THEN 'On hold' ELSE step END AS status,
    CASE WHEN category IN ('Applied', 'Rejection') THEN 'rule' ELSE 'ai' END AS source,
    't' || CAST(user_id AS VARCHAR) || '-' || CAST(k % 4 AS VARCHAR) AS thread_id,
    CASE WHEN k % 4 = 1 THEN 'https://jobs.example.com/' || key12 || '/' || CAST(k AS VARCHAR)
         WHEN k % 4 = 2 THEN 'https://www.' || key12 || '.com/careers' ELSE '' END AS link,
    CASE WHEN category = 'Invitation' AND k % 2 = 0 THEN 'Interviewer ' || CAST(k % 7 AS VARCHAR) ELSE '' END AS interviewer,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE 'm' || CAST(event_id AS VARCHAR) END AS message_id,
    event_id AS seq
  FROM tracker_step
)"""


def _mail() -> str:
    n = len(A.MAIL_TEMPLATES)
    tmpl = f"((conv_id * 7 + turn) % {n})"
    subj = _case(tmpl, [s for s, _ in A.MAIL_TEMPLATES])
    head = _case(tmpl, [b for _, b in A.MAIL_TEMPLATES])
    sender = _case(f"(conv_id % {len(A.MAIL_SENDERS)})", A.MAIL_SENDERS)
    return f"""
mail_base AS (
  SELECT conv_id, turn, role,
    'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id,
    'c' || CAST(conv_id AS VARCHAR) || '-0' AS thread_id,
    {subj} AS subject,
    {head} || chr(10) || coalesce(text, '') AS body,
    CASE WHEN conv_id % 41 = 11 AND turn = 2 THEN '' ELSE
    {iso_millis("(TIMESTAMP '2026-06-01 00:00:00' + to_hours(CAST(conv_id AS INTEGER)) + to_minutes(CAST(turn * 37 AS INTEGER)))")} END AS received,
    {sender} AS from_header
  FROM conversations
),
mail AS (
  SELECT message_id, thread_id, subject, body, received,
    {D.sender_name('from_header')} AS sender_name,
    {D.sender_domain('from_header')} AS sender_domain,
    CASE WHEN turn % 2 = 0 THEN ['https://jobs.example.org/c' || CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR)]
         ELSE CAST([] AS VARCHAR[]) END AS links,
    role = 'system' AS is_self,
    conv_id * 100 + turn AS seq,
    conv_id, turn, from_header
  FROM mail_base
)"""


MAIL = _mail()

LINKS_JSON = "('[' || array_to_string(list_transform(links, lambda x: '\"' || x || '\"'), ',') || ']')"

PROCESSED = f"""
processed AS (
  SELECT CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN thread_id ELSE message_id END AS message_id,
         CASE WHEN turn = 0 AND conv_id % 5 = 0 THEN '' ELSE thread_id END AS thread_id,
         {D.q(A.PROCESSED_AT)} AS processed_at
  FROM mail
  WHERE (turn = 0) OR (turn = 1 AND conv_id % 4 = 0)
)"""

RAW = f"""
raw AS (
  SELECT message_id, thread_id, received, sender_name, sender_domain, subject, body,
         CASE WHEN conv_id % 11 = 0 THEN '[bad' ELSE {LINKS_JSON} END AS links, seq
  FROM mail WHERE conv_id % 3 <> 0
  UNION ALL
  SELECT message_id, thread_id, received, sender_name, sender_domain, subject, 'Corrected copy: ' || body,
         {LINKS_JSON}, seq + 50
  FROM mail WHERE conv_id % 3 <> 0 AND turn = 1 AND conv_id % 7 = 0
)"""

RESPONSES = f"""
responses AS (
  SELECT message_id AS request_id, 'primary' AS model,
         {_case(f'((conv_id + turn) % {len(A.PRIMARY_STATUS)})', A.PRIMARY_STATUS)} AS http_status,
         {_case(f'((conv_id + turn) % {len(A.RESPONSE_BODIES)})', A.RESPONSE_BODIES)} AS json
  FROM mail
  UNION ALL
  SELECT message_id, 'fallback',
         {_case(f'((conv_id + turn * 2) % {len(A.FALLBACK_STATUS)})', A.FALLBACK_STATUS)},
         {_case(f'((conv_id + turn) % {len(A.RESPONSE_BODIES)})', A.RESPONSE_BODIES)}
  FROM mail
)"""

HEADERS = f"""
headers AS (
  SELECT message_id, 0 AS pos, {_case('(conv_id % 3)', ['From', 'from', 'FROM'])} AS name, from_header AS value FROM mail
  UNION ALL SELECT message_id, 1, 'Subject', subject FROM mail WHERE conv_id % 9 <> 0
  UNION ALL SELECT message_id, 2, 'Date', received FROM mail
  UNION ALL SELECT message_id, 3, 'subject', 'Dup: ' || subject FROM mail WHERE turn % 4 = 0
  UNION ALL SELECT message_id, 4, '{fixed.SELF_MARKER_HEADER.title()}', '{fixed.SELF_MARKER_VALUE}' FROM mail WHERE is_self
)"""

META = """
meta AS (
  SELECT message_id, thread_id,
         CASE WHEN conv_id % 6 = 0 THEN NULL ELSE epoch_ms(TRY_CAST(received AS TIMESTAMPTZ)) END AS internal_ms
  FROM mail
)"""

PARTS = """
parts AS (
  SELECT 'p' || CAST(conv_id AS VARCHAR) AS message_id,
         lpad(CAST(turn AS VARCHAR), 3, '0') AS path,
         CASE WHEN role = 'user' THEN 'text/plain' WHEN role = 'assistant' THEN 'text/html' ELSE 'multipart/mixed' END AS mime,
         translate(to_base64(encode(coalesce(text, ''))), '+/', '-_') AS data
  FROM conversations
)"""

ALERTS = """
alerts AS (
  SELECT company, company_key, role, step, category, interview_datetime, summary, received, thread_id, seq,
         seq % 2 = 0 AS pending
  FROM tracker WHERE category IN ('Invitation', 'Offer')
)"""

def _mail_tracker() -> str:
    idx = f"((conv_id + turn) % {len(fixed.CATEGORIES)})"
    step = _case(idx, [fixed.DEFAULT_STEP[x] for x in fixed.CATEGORIES])
    return f"""
mail_tracker AS (
  SELECT received, 'Co' || CAST(conv_id AS VARCHAR) AS company, 'co' || CAST(conv_id AS VARCHAR) AS company_key,
    'Role ' || CAST(turn % 3 AS VARCHAR) AS role, {step} AS step, {_case(idx, fixed.CATEGORIES)} AS category,
    CASE WHEN turn % 3 = 1 THEN '2026-06-15T10:00' ELSE '' END AS interview_datetime, subject AS summary,
    CASE WHEN turn % 7 = 3 THEN 'Withdrawn' ELSE {step} END AS status, 'ai' AS source, thread_id, '' AS link,
    '' AS interviewer, CASE WHEN conv_id % 4 = 0 THEN '' ELSE message_id END AS message_id, seq
  FROM mail
)"""


_VIEWS = {
    "mail_tracker": (_mail_tracker(), ["mail"]),
    "tracker": (TRACKER, []),
    "mail": (MAIL, []),
    "processed": (PROCESSED, ["mail"]),
    "raw": (RAW, ["mail"]),
    "responses": (RESPONSES, ["mail"]),
    "headers": (HEADERS, ["mail"]),
    "meta": (META, ["mail"]),
    "parts": (PARTS, []),
    "alerts": (ALERTS, ["tracker"]),
}


def with_views(*names: str, extra: list[str] | None = None) -> str:
    """``WITH`` clause holding the named adapter views (and their inputs) plus
    any extra ``name AS (...)`` CTEs."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _VIEWS[n][1]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [_VIEWS[n][0].strip() for n in order] + [c.strip() for c in (extra or [])]
    return "WITH " + ",\n".join(ctes) + "\n"
