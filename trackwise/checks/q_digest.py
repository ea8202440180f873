"""Digest queries (ST-02, AG-11, AG-12, SO-04, PL-05) over the alerts adapter."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.checks.duck_adapters import with_views
from trackwise.checks.registry import register
from trackwise.operators import digest as G
from trackwise.plans.digest import Digest
from trackwise.session import checkpoint_dir
from trackwise.sources import adapters as A

NL = "chr(10)"
NEWEST = "received DESC, src, seq"


_HELD_AND_NEW = "SELECT *, 0 AS src FROM alerts WHERE pending UNION ALL SELECT *, 1 AS src FROM alerts WHERE NOT pending"


def _merged_ctes(items: str = _HELD_AND_NEW) -> list[str]:
    return [
        f"u AS ({items})",
        """u2 AS (SELECT *, CASE WHEN thread_id <> '' THEN thread_id ELSE concat_ws('|', company_key, role, received) END AS dkey FROM u)""",
        """merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY src, seq) AS rn FROM u2) WHERE rn = 1)""",
    ]


def _section_ctes(items: str = _HELD_AND_NEW) -> list[str]:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    return _merged_ctes(items) + [
        f"m AS (SELECT *, CASE WHEN role <> '' THEN role ELSE {q(fixed.DIGEST_NO_ROLE)} END AS role_label FROM merged)",
        f"""roles AS (SELECT company_key, role_label,
            first(received ORDER BY {NEWEST}) AS r_recv, first(src ORDER BY {NEWEST}) AS r_src, first(seq ORDER BY {NEWEST}) AS r_seq,
            first(step ORDER BY {NEWEST}) AS l_step, first(category ORDER BY {NEWEST}) AS l_cat, first(summary ORDER BY {NEWEST}) AS l_sum,
            max(interview_datetime) FILTER (WHERE interview_datetime <> '') AS with_time
          FROM m GROUP BY ALL)""",
        f"""lines AS (SELECT company_key, string_agg(line, {NL} ORDER BY r_recv DESC, r_src, r_seq) AS lines FROM (
            SELECT *, {q(fixed.DIGEST_ROLE_BULLET)} || role_label || ' — ' || CASE WHEN l_step <> '' THEN l_step ELSE l_cat END
              || coalesce({NL} || {q(fixed.DIGEST_INTERVIEW_LINE)} || with_time, '')
              || CASE WHEN l_sum <> '' THEN {NL} || {q(fixed.DIGEST_SUMMARY_INDENT)} || l_sum ELSE '' END AS line
            FROM roles) GROUP BY company_key)""",
        f"""comp AS (SELECT company_key, first(src ORDER BY src, seq) AS c_src, first(seq ORDER BY src, seq) AS c_seq,
            first(company ORDER BY {NEWEST}) AS newest_company, first(company ORDER BY src, seq) AS first_company,
            count(*) AS n_items FROM m GROUP BY company_key)""",
        f"""sections AS (SELECT c.company_key, c.c_src, c.c_seq, c.first_company, c.n_items,
            {q(fixed.DIGEST_COMPANY_BULLET)} || CASE WHEN newest_company <> '' THEN newest_company ELSE {q(fixed.DIGEST_UNKNOWN_COMPANY)} END
              || {NL} || l.lines AS section
            FROM comp c JOIN lines l USING (company_key))""",
    ]


@register(
    "merge_alerts",
    with_views("alerts", extra=_merged_ctes()) + "SELECT dkey, company_key, role, received, thread_id, seq FROM merged",
)
def merge_alerts(spark, sf_dir):
    """ST-02: pending ∪ new, first item per thread."""
    al = A.alerts(spark, sf_dir)
    m = G.merge_alerts(al.filter("pending"), al.filter("NOT pending"))
    return m.select("dkey", "company_key", "role", "received", "thread_id", "seq")


@register("digest_sections", with_views("alerts", extra=_section_ctes()) + "SELECT company_key, n_items, section FROM sections")
def digest_sections(spark, sf_dir):
    """AG-11 per company (+ SO-04 newest-first inside)."""
    al = A.alerts(spark, sf_dir)
    s = G.digest_sections(G.merge_alerts(al.filter("pending"), al.filter("NOT pending")))
    return s.select("company_key", "n_items", "section")


def _rows_sql(items: str = _HELD_AND_NEW) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    one_a, one_b = fixed.DIGEST_SUBJECT_ONE.split("{company}")
    m1, rest = fixed.DIGEST_SUBJECT_MANY.split("{items}")
    m2, m3 = rest.split("{companies}")
    line = (
        f"{q(fixed.DIGEST_ROLE_BULLET)} || role_label || ' — ' || CASE WHEN l_step <> '' THEN l_step ELSE l_cat END "
        f"|| coalesce({NL} || {q(fixed.DIGEST_INTERVIEW_LINE)} || with_time, '') "
        f"|| CASE WHEN l_sum <> '' THEN {NL} || {q(fixed.DIGEST_SUMMARY_INDENT)} || l_sum ELSE '' END"
    )
    title = f"{q(fixed.DIGEST_COMPANY_BULLET)} || CASE WHEN newest_company <> '' THEN newest_company ELSE {q(fixed.DIGEST_UNKNOWN_COMPANY)} END"
    subj = (
        f"CASE WHEN n_companies = 1 THEN {q(one_a)} || CASE WHEN first_company <> '' THEN first_company ELSE {q(fixed.DIGEST_SUBJECT_ONE_FALLBACK)} END"
        f" || {q(one_b)} ELSE {q(m1)} || CAST(n_items AS VARCHAR) || {q(m2)} || CAST(n_companies AS VARCHAR) || {q(m3)} END"
    )
    opening = f"CASE WHEN n_companies = 1 THEN {q(fixed.DIGEST_BODY_HEAD_ONE)} ELSE {q(fixed.DIGEST_BODY_HEAD_MANY)} END"
    tot = "tot AS (SELECT sum(n_items) AS n_items, count(*) AS n_companies, first(first_company ORDER BY c_src, c_seq) AS first_company FROM comp)"
    return with_views("alerts", extra=[*_section_ctes(items), tot]) + f"""
SELECT 2 AS part, company_key, c_src, c_seq, 0 AS is_role, CAST(NULL AS VARCHAR) AS received, 0 AS r_src, 0 AS r_seq, {title} AS text FROM comp
UNION ALL SELECT 2, r.company_key, c_src, c_seq, 1, r_recv, r_src, r_seq, {line} FROM roles r JOIN comp c ON c.company_key = r.company_key
UNION ALL SELECT 0, NULL, 0, 0, 0, NULL, 0, 0, {subj} FROM tot WHERE n_companies > 0
UNION ALL SELECT 1, NULL, 0, 0, 0, NULL, 0, 0, {opening} FROM tot WHERE n_companies > 0
UNION ALL SELECT 3, NULL, 0, 0, 0, NULL, 0, 0, {q(fixed.DIGEST_BODY_TAIL)} FROM tot WHERE n_companies > 0"""


@register("digest_rows", _rows_sql())
def digest_rows(spark, sf_dir):
    """PL-05 render: the ordered lines of AG-11 and AG-12."""
    al = A.alerts(spark, sf_dir)
    return G.digest_rows(G.merge_alerts(al.filter("pending"), al.filter("NOT pending")))


_LAST = "epoch_ms(max(CAST(received AS TIMESTAMPTZ))) // 1000"


@register(
    "digest_gate",
    with_views("alerts", extra=_merged_ctes() + [f"st AS (SELECT {_LAST} AS last FROM alerts WHERE pending)"])
    + """SELECT dkey, n.minutes, CASE WHEN n.minutes * 60 < 3600 THEN 'queued' ELSE 'sent' END AS outcome,
      CASE WHEN n.minutes * 60 < 3600 THEN last ELSE last + n.minutes * 60 END AS last_notified_epoch
    FROM merged, st, (VALUES (10), (90)) n(minutes)""",
)
def digest_gate(spark, sf_dir):
    """PL-05 / SM-05 with SRC-08, SNK-05: the gate 10 and 90 minutes after the state's last digest, and the next state."""
    al = A.alerts(spark, sf_dir)
    merged = G.merge_alerts(al.filter("pending"), al.filter("NOT pending"))
    state = al.filter("pending").agg(F.unix_seconds(F.max(F.try_to_timestamp("received"))).alias("last_notified_epoch"))
    last = state.first()[0]  # one number
    out = []
    for minutes in (10, 90):
        now = (last or 0) + minutes * 60
        gated = G.gate(merged, state, now)
        after = G.next_state(gated, state, now)
        out.append(gated.select("dkey", F.lit(minutes).alias("minutes"), "outcome").crossJoin(F.broadcast(after)))
    return out[0].unionByName(out[1])


@register(
    "digest_runs",
    f"SELECT 'first' AS run_id, * FROM ({_rows_sql('SELECT *, 1 AS src FROM alerts WHERE pending')}) "
    f"UNION ALL SELECT 'later', * FROM ({_rows_sql('SELECT *, 0 AS src FROM alerts WHERE NOT pending')})",
)
def digest_runs(spark, sf_dir):
    """PL-05 whole (SRC-08, SM-05, SNK-05): one batch is sent at once, the next is held ten minutes later, and goes out when the
    window has ended, without new alerts. Each run finds the state that the one before it has stored."""
    al = A.alerts(spark, sf_dir)
    d = Digest(spark, f"{checkpoint_dir(spark)}/digest-{uuid.uuid4().hex}")
    start = 1_780_000_000
    d.run("first", al.filter("pending"), start)
    d.run("held", al.filter("NOT pending"), start + 600)
    d.tick("later", start + 3600)
    return d.store.read("lines")
