"""DuckDB oracle SQL for the composite operators. Written independently of the
Spark code: row picks use ordered aggregates (``first(x ORDER BY ...)``) and
windows over whole groups, clustering uses ``levenshtein`` on a self join."""

from __future__ import annotations

from trackwise import fixed
from trackwise.checks import duck as D
from trackwise.checks.duck_adapters import with_views
from trackwise.functions.timefn import parse_as_of, wall_now
from trackwise.sources import adapters as A

REC = "received DESC, cnt DESC, first_seen ASC, seq ASC"
CHRONO = "received ASC, cnt DESC, first_seen ASC, seq ASC"


def _now_wall(as_of, tz) -> str:
    return f"TIMESTAMP '{wall_now(as_of, tz):%Y-%m-%d %H:%M:%S}'"


def clustered_events_ctes(min_contain: int = fixed.CONTAIN_MIN_LEN) -> list[str]:
    """ev1: tracker rows with gkey, cnt, first_seen, cluster. The canonical key
    is the best-ranked earlier neighbour (exact when no key is both a follower
    and someone's only earlier neighbour, which holds for the adapter data;
    chains are covered by the brute-force test)."""
    gkey = f"coalesce(nullif({D.norm('company_key')}, ''), nullif({D.norm('company')}, ''), 'unknown')"
    return [
        f"ev0 AS (SELECT *, {gkey} AS gkey FROM tracker)",
        "ks AS (SELECT gkey AS key, count(*) AS cnt, min(seq) AS first_seen FROM ev0 GROUP BY gkey)",
        f"""pairs AS (
  SELECT a.key AS ka, a.cnt AS ca, a.first_seen AS fa, b.key AS kb, b.cnt AS cb, b.first_seen AS fb
  FROM ks a JOIN ks b ON a.key <> b.key
  WHERE a.key <> 'unknown' AND b.key <> 'unknown'
    AND (levenshtein(a.key, b.key) <= 1
         OR (length(a.key) >= {min_contain} AND length(b.key) >= {min_contain}
             AND (contains(a.key, b.key) OR contains(b.key, a.key)))))""",
        """canon AS (
  SELECT kb AS key, first(ka ORDER BY ca DESC, fa ASC) AS canonical
  FROM pairs WHERE ca > cb OR (ca = cb AND fa < fb) GROUP BY kb)""",
        """ev1 AS (
  SELECT ev0.*, ks.cnt, ks.first_seen, coalesce(canon.canonical, ev0.gkey) AS cluster
  FROM ev0 JOIN ks ON ev0.gkey = ks.key LEFT JOIN canon ON ev0.gkey = canon.key)""",
    ]


def cluster_keys_sql() -> str:
    return with_views("tracker", extra=clustered_events_ctes()) + (
        "SELECT DISTINCT gkey AS key, cluster AS canonical, cnt, first_seen FROM ev1"
    )


def segment_ctes() -> list[str]:
    b = D.is_boundary()
    return clustered_events_ctes() + [
        f"""ev AS (
  SELECT *,
    coalesce(sum(CASE WHEN {b} THEN 1 ELSE 0 END) OVER (PARTITION BY cluster ORDER BY {CHRONO}
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg,
    {D.wall_clock('interview_datetime')} AS wc,
    {b} AS isb,
    {D.is_manual()} AS man,
    {D.norm('category')} AS ncat
  FROM ev1)"""
    ]


def segments_sql() -> str:
    return with_views("tracker", extra=segment_ctes()) + (
        "SELECT seq, cluster, seg, isb AS is_boundary FROM ev"
    )


def positions_ctes(as_of=A.TRACKER_AS_OF, tz=fixed.DISPLAY_TZ) -> list[str]:
    now = _now_wall(as_of, tz)
    manual_cat = " ".join(f"WHEN {D.norm('l_status')} = {D.q(k)} THEN {D.q(v)}" for k, v in fixed.MANUAL_CATEGORY.items())
    t_status = "coalesce(nullif(t_status, ''), nullif(t_step, ''), 'Rejected')"
    as_of_s = parse_as_of(as_of).timestamp()
    return segment_ctes() + [
        f"""seg AS (
  SELECT cluster, seg, count(*) AS rounds,
    first(received ORDER BY {REC}) AS last_update,
    first(company_key ORDER BY {REC}) AS l_key,
    first(thread_id ORDER BY {REC}) AS l_thread,
    first(message_id ORDER BY {REC}) AS l_msg,
    first(summary ORDER BY {REC}) AS l_summary,
    first(status ORDER BY {REC}) AS l_status,
    first(step ORDER BY {REC}) AS l_step,
    first(category ORDER BY {REC}) AS l_cat,
    first(man ORDER BY {REC}) AS l_man,
    count(*) FILTER (WHERE isb) AS n_term,
    first(status ORDER BY {REC}) FILTER (WHERE isb) AS t_status,
    first(step ORDER BY {REC}) FILTER (WHERE isb) AS t_step,
    first(man ORDER BY {REC}) FILTER (WHERE isb) AS t_man,
    count(*) FILTER (WHERE ncat = 'offer') AS n_offer,
    first(step ORDER BY {REC}) FILTER (WHERE ncat = 'offer') AS offer_step,
    count(*) FILTER (WHERE ncat = 'invitation') AS n_inv,
    first(step ORDER BY {REC}) FILTER (WHERE ncat = 'invitation') AS inv_step,
    count(*) FILTER (WHERE wc >= {now}) AS n_up,
    first(interview_datetime ORDER BY wc ASC, {CHRONO}) FILTER (WHERE wc >= {now}) AS next_up,
    first(interview_datetime ORDER BY wc DESC, {CHRONO}) FILTER (WHERE wc IS NOT NULL) AS last_past,
    first(link ORDER BY {REC}) FILTER (WHERE link <> '') AS r_link,
    first(interviewer ORDER BY {REC}) FILTER (WHERE interviewer <> '') AS r_iv
  FROM ev GROUP BY cluster, seg)""",
        "segx AS (SELECT *, coalesce(next_up, last_past, '') AS next_interview FROM seg)",
        f"""roles1 AS (
  SELECT cluster, seg, {D.norm('role')} AS nrole, count(*) AS freq,
    first({D.jtrim('role')} ORDER BY {REC}) AS role_text,
    first(received ORDER BY {REC}) AS r, first(cnt ORDER BY {REC}) AS c,
    first(first_seen ORDER BY {REC}) AS f, first(seq ORDER BY {REC}) AS s
  FROM ev WHERE {D.is_real_role('role')} GROUP BY ALL)""",
        f"""roles AS (
  SELECT cluster, seg, first(role_text ORDER BY ntok DESC, freq DESC, r DESC, c DESC, f ASC, s ASC) AS seg_role
  FROM (SELECT *, {D.role_token_count('nrole')} AS ntok FROM roles1) GROUP BY cluster, seg)""",
        f"""names1 AS (
  SELECT cluster, {D.jtrim('company')} AS nm, count(*) AS n,
    first(cnt ORDER BY cnt DESC, first_seen, seq) AS oc, first(first_seen ORDER BY cnt DESC, first_seen, seq) AS ofs,
    first(seq ORDER BY cnt DESC, first_seen, seq) AS os
  FROM ev GROUP BY ALL)""",
        """names AS (
  SELECT cluster, coalesce(
    first(nm ORDER BY n DESC, oc DESC, ofs, os) FILTER (WHERE nm <> '' AND lower(nm) <> 'unknown'),
    first(nm ORDER BY oc DESC, ofs, os) FILTER (WHERE nm <> ''),
    'Unknown') AS company_name
  FROM names1 GROUP BY cluster)""",
        f"""owner AS (
  SELECT e.cluster, e.seg, first(e.interviewer ORDER BY e.received, e.cnt DESC, e.first_seen, e.seq) AS shown_iv
  FROM ev e JOIN segx s ON e.cluster = s.cluster AND e.seg = s.seg AND e.interview_datetime = s.next_interview
  WHERE e.interviewer <> '' AND e.interview_datetime <> '' GROUP BY ALL)""",
        f"""pos0 AS (
  SELECT s.*, coalesce(r.seg_role, '') AS role0, n.company_name, o.shown_iv,
    CASE WHEN n_term > 0 THEN {t_status}
         WHEN l_man THEN l_status
         WHEN n_offer > 0 THEN coalesce(nullif(offer_step, ''), 'Offer')
         WHEN n_inv > 0 THEN coalesce(nullif(inv_step, ''), 'Interview')
         WHEN n_up > 0 THEN 'Interview scheduled'
         ELSE coalesce(nullif(l_status, ''), nullif(l_step, ''), 'Applied') END AS status,
    CASE WHEN n_term > 0 THEN (CASE WHEN {D.norm(t_status)} = 'rejected' THEN 'Rejection' ELSE 'Other' END)
         WHEN l_man THEN (CASE {manual_cat} ELSE 'Other' END)
         WHEN n_offer > 0 THEN 'Offer'
         WHEN n_inv > 0 THEN 'Invitation'
         WHEN n_up > 0 THEN 'Invitation'
         ELSE coalesce(nullif(l_cat, ''), 'Other') END AS category,
    CASE WHEN n_term > 0 THEN (CASE WHEN t_man THEN 'manual' ELSE 'derived' END)
         WHEN l_man THEN 'manual' ELSE 'derived' END AS status_source
  FROM segx s LEFT JOIN roles r USING (cluster, seg) LEFT JOIN owner o USING (cluster, seg)
  LEFT JOIN names n USING (cluster))""",
        f"""positions AS (
  SELECT
    concat_ws('|', {D.norm("coalesce(nullif(l_key, ''), company_name)")}, {D.norm('role0')}, l_thread) AS key,
    company_name AS company,
    CASE WHEN role0 = '' THEN '—' ELSE role0 END AS role,
    status, category, status_source,
    l_summary AS summary, last_update, next_interview, rounds,
    NOT {D.is_terminal('category', 'status')}
      AND coalesce(({as_of_s} - epoch(TRY_CAST(last_update AS TIMESTAMPTZ))) / 86400.0, 0) > {fixed.STALE_DAYS} AS stale,
    l_thread AS latest_thread_id, l_msg AS latest_message_id,
    coalesce(r_link, '') AS link,
    coalesce(CASE WHEN next_interview <> '' THEN nullif(shown_iv, '') END, r_iv, '') AS interviewer,
    cluster, seg
  FROM pos0)""",
    ]


POSITION_COLUMNS = (
    "key, company, role, status, category, status_source, summary, last_update, next_interview, rounds, stale, "
    "latest_thread_id, latest_message_id, link, interviewer"
)


def positions_sql(as_of=A.TRACKER_AS_OF, tz=fixed.DISPLAY_TZ, where: str = "TRUE") -> str:
    return with_views("tracker", extra=positions_ctes(as_of, tz)) + f"SELECT {POSITION_COLUMNS} FROM positions WHERE {where}"
