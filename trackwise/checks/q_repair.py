"""Repair queries (SRC-05, ST-01, ST-03, JN-03..05, ML-01..02, PL-03)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackwise.checks import duck as D
from trackwise.checks.duck_adapters import with_views
from trackwise.checks.q_ingest import CFG, fallback_cte, normalized_cte
from trackwise.checks.registry import register
from trackwise.functions import patterns as P
from trackwise.operators import scorer as S
from trackwise.plans import repair as R
from trackwise.plans.tracker_store import TrackerStore
from trackwise.session import checkpoint_dir
from trackwise.sources import adapters as A

RR = """rr AS (
  SELECT message_id, min(seq) AS first_seq,
    first(thread_id ORDER BY seq DESC) AS thread_id, first(received ORDER BY seq DESC) AS received,
    first(sender_name ORDER BY seq DESC) AS sender_name, first(sender_domain ORDER BY seq DESC) AS sender_domain,
    first(subject ORDER BY seq DESC) AS subject, first(body ORDER BY seq DESC) AS body,
    first(links ORDER BY seq DESC) AS links_txt
  FROM raw WHERE message_id <> '' GROUP BY message_id)"""


@register(
    "read_raw",
    with_views("raw", extra=[RR])
    + """SELECT message_id, first_seq, thread_id, body,
    CASE WHEN json_valid(links_txt) AND json_type(links_txt) = 'ARRAY'
         THEN array_to_string(CAST(json(links_txt) AS VARCHAR[]), ' ') ELSE '' END AS links
    FROM rr""",
)
def read_raw(spark, sf_dir):
    """SRC-05: last write wins, first write fixes the cache position, bad links → []."""
    r = R.read_raw(A.raw_table(spark, sf_dir))
    return r.select("message_id", "first_seq", "thread_id", "body", F.array_join("links", " ").alias("links"))


_KNOWN = "(SELECT thread_id FROM mail_tracker WHERE thread_id <> '' UNION SELECT message_id FROM processed WHERE thread_id = '')"


@register("known_threads", with_views("mail_tracker", "processed") + f"SELECT DISTINCT thread_id FROM {_KNOWN}")
def known_threads(spark, sf_dir):
    """ST-01."""
    return R.known_threads(A.mail_tracker(spark, sf_dir), A.processed(spark, sf_dir))


@register(
    "unseen_messages",
    with_views("mail", "mail_tracker", "processed")
    + f"""SELECT message_id, thread_id FROM mail WHERE thread_id IN {_KNOWN}
      AND message_id NOT IN (SELECT message_id FROM processed)""",
)
def unseen_messages(spark, sf_dir):
    """ST-03 (+ JN-01): never-processed messages of known threads."""
    th = R.known_threads(A.mail_tracker(spark, sf_dir), A.processed(spark, sf_dir))
    return R.unseen_messages(A.mail(spark, sf_dir), th, A.processed(spark, sf_dir)).select("message_id", "thread_id")


@register(
    "attach_raw",
    with_views("mail", "raw", "mail_tracker", extra=[RR]) + """,
tr_c AS (SELECT thread_id, received, first(message_id ORDER BY first_seq) AS c_mid FROM rr GROUP BY ALL),
ar_c AS (SELECT thread_id, received, first(message_id ORDER BY seq) AS a_mid FROM mail GROUP BY ALL)
SELECT t.seq,
  coalesce(CASE WHEN t.message_id <> '' THEN r1.message_id END, tc.c_mid,
           CASE WHEN t.message_id <> '' THEN a1.message_id ELSE ac.a_mid END, '') AS raw_message_id,
  CASE WHEN coalesce(CASE WHEN t.message_id <> '' THEN r1.message_id END, tc.c_mid) IS NOT NULL THEN 'cache'
       WHEN (CASE WHEN t.message_id <> '' THEN a1.message_id ELSE ac.a_mid END) IS NOT NULL THEN 'archive' ELSE '' END AS raw_from
FROM mail_tracker t
LEFT JOIN rr r1 ON r1.message_id = t.message_id
LEFT JOIN tr_c tc ON tc.thread_id = t.thread_id AND tc.received = t.received
LEFT JOIN mail a1 ON a1.message_id = t.message_id
LEFT JOIN ar_c ac ON t.thread_id <> '' AND ac.thread_id = t.thread_id AND ac.received = t.received""",
)
def attach_raw(spark, sf_dir):
    """JN-03 / JN-04 / JN-05."""
    att = R.attach_raw(A.mail_tracker(spark, sf_dir), R.read_raw(A.raw_table(spark, sf_dir)), A.mail(spark, sf_dir))
    return att.select(
        "seq",
        F.coalesce(F.col("raw")["message_id"], F.lit("")).alias("raw_message_id"),
        F.coalesce("raw_from", F.lit("")).alias("raw_from"),
    )


def _reprocess_ctes() -> list[str]:
    cand = CFG.candidate.strip().lower()
    text = D.mail_text("m_subject", "m_body")
    hit = f"(n_category = 'Offer' AND coalesce(n_interview, '') <> '' AND NOT {D.rlike(text, P.COMPENSATION)})"
    return [
        RR,
        "tr_c AS (SELECT thread_id, received, first(message_id ORDER BY first_seq) AS c_mid FROM rr GROUP BY ALL)",
        "ar_c AS (SELECT thread_id, received, first(message_id ORDER BY seq) AS a_mid FROM mail GROUP BY ALL)",
        """att AS (SELECT t.*,
            coalesce(CASE WHEN t.message_id <> '' THEN r1.message_id END, tc.c_mid) AS cache_mid,
            CASE WHEN t.message_id <> '' THEN a1.message_id ELSE ac.a_mid END AS arch_mid
          FROM mail_tracker t LEFT JOIN rr r1 ON r1.message_id = t.message_id
          LEFT JOIN tr_c tc ON tc.thread_id = t.thread_id AND tc.received = t.received
          LEFT JOIN mail a1 ON a1.message_id = t.message_id
          LEFT JOIN ar_c ac ON t.thread_id <> '' AND ac.thread_id = t.thread_id AND ac.received = t.received)""",
        """att2 AS (SELECT att.*,
            CASE WHEN cache_mid IS NOT NULL THEN rc.subject ELSE am.subject END AS m_subject,
            CASE WHEN cache_mid IS NOT NULL THEN rc.body ELSE am.body END AS m_body,
            CASE WHEN cache_mid IS NOT NULL THEN rc.sender_name ELSE am.sender_name END AS m_sender_name,
            CASE WHEN cache_mid IS NOT NULL THEN rc.sender_domain ELSE am.sender_domain END AS m_sender_domain,
            coalesce(cache_mid, arch_mid) AS raw_mid
          FROM att LEFT JOIN rr rc ON rc.message_id = att.cache_mid LEFT JOIN mail am ON am.message_id = att.arch_mid)""",
        f"""cl AS (SELECT *, {D.rule_category('m_subject', 'm_body')} AS rcat, {D.has_signal('m_subject', 'm_body')} AS sig
            FROM att2 WHERE raw_mid IS NOT NULL)""",
        "req AS (SELECT DISTINCT raw_mid AS request_id FROM cl WHERE rcat IS NULL AND sig)",
        fallback_cte("req", "resp"),
        normalized_cte("resp", "norm"),
        f"""cl2 AS (SELECT cl.*, n.request_id AS n_id, n.is_relevant AS n_rel, n.category AS n_category, n.step AS n_step,
              n.interview_datetime AS n_interview,
              CASE WHEN rcat IS NOT NULL THEN 'rule' WHEN NOT sig THEN 'no_signal' WHEN n.request_id IS NULL THEN 'failed' ELSE 'scored' END AS route
            FROM cl LEFT JOIN norm n ON n.request_id = cl.raw_mid AND n.valid)""",
        f"""cl3 AS (SELECT *,
              CASE WHEN route = 'rule' THEN 'rule' ELSE 'ai' END AS src,
              CASE WHEN route = 'rule' THEN true ELSE n_rel END AS new_rel,
              CASE WHEN route = 'rule' THEN rcat WHEN {hit} THEN 'Invitation' ELSE n_category END AS new_cat,
              CASE WHEN route = 'rule' THEN (CASE WHEN rcat = 'Rejection' THEN 'Rejected' ELSE 'Applied' END)
                   WHEN {hit} AND {D.rlike('n_step', P.OFFER_WORD)} THEN 'Interview' ELSE n_step END AS new_step,
              CASE WHEN route = 'rule' THEN NULL ELSE n_interview END AS new_iv_raw
            FROM cl2 WHERE route IN ('rule', 'scored'))""",
        """cl4 AS (SELECT *, CASE WHEN src = 'rule' AND new_iv_raw IS NULL THEN interview_datetime ELSE coalesce(new_iv_raw, '') END AS new_iv
            FROM cl3 WHERE new_rel
              AND NOT (src = 'rule' AND new_cat = 'Applied' AND category NOT IN ('Applied', 'Other', '')))""",
        """chg AS (SELECT * FROM cl4 WHERE new_step <> step OR new_cat <> category OR new_iv <> interview_datetime)""",
    ]


@register(
    "reprocess_diff",
    with_views("mail", "raw", "responses", "mail_tracker", extra=_reprocess_ctes())
    + """SELECT seq, company, role, 'step' AS field, step AS old_value, new_step AS new_value FROM chg WHERE new_step <> step
UNION ALL SELECT seq, company, role, 'category', category, new_cat FROM chg WHERE new_cat <> category
UNION ALL SELECT seq, company, role, 'interviewDateTime', interview_datetime, new_iv FROM chg WHERE new_iv <> interview_datetime
UNION ALL SELECT seq, company, role, 'status', status, new_step FROM chg WHERE status = step AND new_step <> status""",
)
def reprocess_diff(spark, sf_dir):
    """PL-03 + ML-02: re-classify every tracker row from its cached/recovered
    message and emit the long-form diff."""
    out = R.reprocess(
        A.mail_tracker(spark, sf_dir),
        A.raw_table(spark, sf_dir),
        A.mail(spark, sf_dir),
        S.TableScorer(A.responses(spark, sf_dir)),
        candidate=CFG.candidate,
    )
    return out["changes"]


_UPD_STATUSES = ["Interviewing", "Offer", "Maybe", "Rejected"]


def _updates(spark, sf_dir):
    t = A.mail_tracker(spark, sf_dir)
    pick = F.element_at(F.array(*[F.lit(x) for x in _UPD_STATUSES]), (F.col("seq") % 4 + 1).cast("int"))
    a = t.filter(F.col("seq") % 7 == 0).select(
        F.when(F.col("message_id") != "", F.col("message_id")).otherwise(F.col("thread_id")).alias("id"),
        pick.alias("status"),
        F.col("seq").alias("ord"),
    )
    b = t.filter(F.col("seq") % 13 == 0).select(
        F.concat(F.lit("nope-"), F.col("seq").cast("string")).alias("id"), F.lit("Offer").alias("status"), (F.col("seq") + 1_000_000_000).alias("ord")
    )
    # no status at all: rejected like one that is not allowed
    n = t.filter(F.col("seq") % 17 == 0).select(
        F.col("thread_id").alias("id"), F.lit(None).cast("string").alias("status"), (F.col("seq") + 2_000_000_000).alias("ord")
    )
    return a.unionByName(b).unionByName(n)


_STATUS_SQL = (
    with_views("mail", "mail_tracker")
    + f"""SELECT t.seq, coalesce(p.status, t.status) AS status FROM mail_tracker t LEFT JOIN (
  SELECT target, first(status ORDER BY ord DESC) AS status FROM (
    SELECT ok.status, ok.ord, coalesce(bym.seq_m, byt.seq_t) AS target FROM (
      SELECT * FROM (
        SELECT CASE WHEN message_id <> '' THEN message_id ELSE thread_id END AS id,
               [{', '.join(D.q(x) for x in _UPD_STATUSES)}][seq % 4 + 1] AS status, seq AS ord
        FROM mail_tracker WHERE seq % 7 = 0
        UNION ALL SELECT 'nope-' || CAST(seq AS VARCHAR), 'Offer', seq + 1000000000 FROM mail_tracker WHERE seq % 13 = 0
        UNION ALL SELECT thread_id, NULL, seq + 2000000000 FROM mail_tracker WHERE seq % 17 = 0)
      WHERE status IN {D.qlist(['Applied', 'Interviewing', 'Offer', 'Rejected', 'Withdrawn', 'Archived'])}) ok
    LEFT JOIN (SELECT message_id, min(seq) AS seq_m FROM mail_tracker WHERE message_id <> '' GROUP BY 1) bym ON bym.message_id = ok.id
    LEFT JOIN (SELECT thread_id, first(seq ORDER BY received DESC, seq ASC) AS seq_t FROM mail_tracker GROUP BY 1) byt ON byt.thread_id = ok.id)
  WHERE target IS NOT NULL GROUP BY target) p ON p.target = t.seq"""
)


@register("update_status", _STATUS_SQL)
def update_status(spark, sf_dir):
    """ML-01 + FLT-11 + JN-09 + SNK-04: whitelisted status updates resolved to
    their target rows (message id, else latest row of the thread) and patched."""
    patched, _rejected = R.update_status(A.mail_tracker(spark, sf_dir), _updates(spark, sf_dir))
    return patched.select("seq", "status")


@register("stored_status", _STATUS_SQL)
def stored_status(spark, sf_dir):
    """SNK-04 on a stored tracker: the status updates rewrite the key buckets of their rows, in one commit."""
    rows = A.mail_tracker(spark, sf_dir)
    t = TrackerStore(spark, f"{checkpoint_dir(spark)}/tracker-{uuid.uuid4().hex}")
    t.append(rows)
    t.update_status(_updates(spark, sf_dir))
    return t.read().select("seq", "status")


@register(
    "rejected_updates",
    with_views("mail", "mail_tracker")
    + f"""SELECT id, status FROM (
  SELECT CASE WHEN message_id <> '' THEN message_id ELSE thread_id END AS id, [{', '.join(D.q(x) for x in _UPD_STATUSES)}][seq % 4 + 1] AS status
  FROM mail_tracker WHERE seq % 7 = 0
  UNION ALL SELECT 'nope-' || CAST(seq AS VARCHAR), 'Offer' FROM mail_tracker WHERE seq % 13 = 0
  UNION ALL SELECT thread_id, NULL FROM mail_tracker WHERE seq % 17 = 0) u
WHERE status IS NULL OR status NOT IN {D.qlist(['Applied', 'Interviewing', 'Offer', 'Rejected', 'Withdrawn', 'Archived'])}
   OR (id NOT IN (SELECT message_id FROM mail_tracker WHERE message_id <> '') AND id NOT IN (SELECT thread_id FROM mail_tracker))""",
)
def rejected_updates(spark, sf_dir):
    """FLT-11: the updates that ML-01 turns down (status not allowed or missing, id unknown)."""
    return R.update_status(A.mail_tracker(spark, sf_dir), _updates(spark, sf_dir))[1]


def _reprocess(spark, sf_dir):
    return R.reprocess(
        A.mail_tracker(spark, sf_dir), A.raw_table(spark, sf_dir), A.mail(spark, sf_dir), S.TableScorer(A.responses(spark, sf_dir)), candidate=CFG.candidate
    )


@register(
    "reprocess_recovered",
    with_views("mail", "raw", "responses", "mail_tracker", extra=_reprocess_ctes())
    + """SELECT message_id, thread_id, received, sender_name, sender_domain, subject, body, array_to_string(links, ' ') AS links
FROM mail WHERE message_id IN (SELECT arch_mid FROM att WHERE cache_mid IS NULL)""",
)
def reprocess_recovered(spark, sf_dir):
    """PL-03 / JN-05: raw rows found in the archive, with their content."""
    r = _reprocess(spark, sf_dir)["recovered"]
    return r.withColumn("links", F.array_join("links", " "))


@register(
    "reprocess_metrics",
    with_views("mail", "raw", "responses", "mail_tracker", extra=_reprocess_ctes())
    + """SELECT count(*) AS rows_examined, count(*) FILTER (WHERE cache_mid IS NULL AND arch_mid IS NULL) AS skipped_no_raw,
  count(DISTINCT CASE WHEN cache_mid IS NULL THEN arch_mid END) AS backfilled_raw,
  (SELECT count(*) FROM cl2 WHERE route IN ('rule', 'scored')) AS reclassified,
  (SELECT count(*) FROM cl2 WHERE route IN ('scored', 'failed')) AS ai_calls,
  (SELECT count(*) FROM cl2 WHERE route = 'failed') AS failed FROM att""",
)
def reprocess_metrics(spark, sf_dir):
    """AG-09."""
    return _reprocess(spark, sf_dir)["metrics"]


@register(
    "apply_reclassified",
    with_views("mail", "raw", "responses", "mail_tracker", extra=_reprocess_ctes())
    + """SELECT t.seq, coalesce(c.new_step, t.step) AS step, coalesce(c.new_cat, t.category) AS category,
  coalesce(c.new_iv, t.interview_datetime) AS interview_datetime,
  CASE WHEN c.seq IS NOT NULL AND t.status = t.step THEN c.new_step ELSE t.status END AS status
FROM mail_tracker t LEFT JOIN chg c ON c.seq = t.seq""",
)
def apply_reclassified(spark, sf_dir):
    """ML-03: the tracker after the diff has been applied."""
    changes = _reprocess(spark, sf_dir)["changes"]
    out = R.apply_reclassified(A.mail_tracker(spark, sf_dir), changes, dry_run=False)
    return out.select("seq", "step", "category", "interview_datetime", "status")
