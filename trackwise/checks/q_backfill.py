"""Backfill queries (PL-02, JN-06, WN-06, ML-04, AG-08) and message assembly (SRC-02, FN-03, FN-04, SO-05)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.checks import duck as D
from trackwise.checks.duck_adapters import with_views
from trackwise.checks.q_ingest import CFG, decided_ctes
from trackwise.checks.registry import register
from trackwise.functions import patterns as P
from trackwise.functions import text as T
from trackwise.operators import scorer as S
from trackwise.plans import backfill as B
from trackwise.plans import ingest as I
from trackwise.plans import repair as R
from trackwise.sources import adapters as A
from trackwise.sources import messages as M

KNOWN = "known AS (SELECT thread_id FROM mail_tracker WHERE thread_id <> '' UNION SELECT message_id FROM processed WHERE thread_id = '')"
UNSEEN = """unseen AS (SELECT * FROM mail WHERE thread_id IN (SELECT thread_id FROM known)
  AND message_id NOT IN (SELECT message_id FROM processed))"""
MATCH = """match AS (SELECT u.message_id, t.seq FROM
  (SELECT *, row_number() OVER (PARTITION BY thread_id, received ORDER BY seq) AS k FROM unseen) u JOIN
  (SELECT *, row_number() OVER (PARTITION BY thread_id, received ORDER BY seq) AS k FROM mail_tracker
   WHERE message_id = '' AND thread_id <> '') t
  ON u.thread_id = t.thread_id AND u.received = t.received AND u.k = t.k)"""
C2 = f"""c2 AS (SELECT unseen.*, message_id IN (SELECT message_id FROM match) AS is_done, false AS undated, false AS is_late,
  {D.rule_category()} AS rcat, {D.has_signal()} AS sig FROM unseen)"""


def _sql(select: str) -> str:
    extra = [KNOWN, UNSEEN, MATCH, C2, *decided_ctes()]
    return with_views("mail", "mail_tracker", "processed", "responses", extra=extra) + select


def _inputs(spark, sf_dir):
    return A.mail(spark, sf_dir), A.mail_tracker(spark, sf_dir), A.processed(spark, sf_dir)


def _routes(spark, sf_dir):
    return B.backfill_routes(*_inputs(spark, sf_dir), S.TableScorer(A.responses(spark, sf_dir)), CFG)


@register("match_migration", _sql("SELECT message_id, seq FROM match"))
def match_migration(spark, sf_dir):
    """JN-06 + WN-06."""
    mail, tracker, processed = _inputs(spark, sf_dir)
    unseen = I.one_per_id(R.unseen_messages(mail, R.known_threads(tracker, processed), processed))
    return B.match_migration(unseen, tracker)


@register("apply_migration", _sql("SELECT t.seq, coalesce(m.message_id, t.message_id) AS message_id FROM mail_tracker t LEFT JOIN match m ON m.seq = t.seq"))
def apply_migration(spark, sf_dir):
    """ML-04."""
    mail, tracker, processed = _inputs(spark, sf_dir)
    unseen = I.one_per_id(R.unseen_messages(mail, R.known_threads(tracker, processed), processed))
    return B.apply_migration(tracker, B.match_migration(unseen, tracker)).select("seq", "message_id")


@register(
    "backfill_routes",
    _sql("SELECT message_id, CASE WHEN route = 'processed' THEN 'migrated' ELSE route END AS route, source, is_relevant, category, step FROM routed"),
)
def backfill_routes(spark, sf_dir):
    """PL-02 core."""
    a = F.col("analysis")
    return _routes(spark, sf_dir).select("message_id", "route", "source", *[a[f].alias(f) for f in ("is_relevant", "category", "step")])


@register(
    "backfill_metrics",
    _sql(
        """SELECT (SELECT count(*) FROM known) AS threads_scanned, count(*) AS messages_seen, count(*) FILTER (WHERE route = 'processed') AS migrated,
  count(*) FILTER (WHERE route IN ('rule','scored') AND is_relevant) AS appended,
  count(*) FILTER (WHERE route = 'noise' OR (route IN ('rule','scored') AND NOT is_relevant)) AS noise,
  count(*) FILTER (WHERE route IN ('scored','failed')) AS ai_calls, count(*) FILTER (WHERE route = 'failed') AS failed FROM routed"""
    ),
)
def backfill_metrics(spark, sf_dir):
    """AG-08."""
    _, tracker, processed = _inputs(spark, sf_dir)
    return B.backfill_metrics(_routes(spark, sf_dir), R.known_threads(tracker, processed))


@register(
    "assemble_messages",
    with_views("mail", "headers", "meta", extra=[
        f"""h AS (SELECT message_id, first(value ORDER BY pos) FILTER (WHERE lower(name) = 'subject') AS subject,
          first(value ORDER BY pos) FILTER (WHERE lower(name) = 'from') AS from_header,
          first(value ORDER BY pos) FILTER (WHERE lower(name) = 'date') AS date,
          first(value ORDER BY pos) FILTER (WHERE lower(name) = {D.q(fixed.SELF_MARKER_HEADER)}) AS mark FROM headers GROUP BY message_id)""",
    ])
    + f"""SELECT m.message_id, m.thread_id, coalesce(subject, {D.q(fixed.NO_SUBJECT)}) AS subject, coalesce(from_header, '') AS from_header,
  coalesce(strftime(make_timestamp_ms(coalesce(internal_ms, epoch_ms(TRY_CAST(date AS TIMESTAMPTZ)))), '%Y-%m-%dT%H:%M:%S.%g') || 'Z', '') AS received,
  coalesce(mark = {D.q(fixed.SELF_MARKER_VALUE)}, false) AS is_self
FROM meta m LEFT JOIN h USING (message_id)""",
)
def assemble_messages(spark, sf_dir):
    """SRC-02."""
    return M.assemble_messages(A.headers(spark, sf_dir), A.meta(spark, sf_dir))


@register(
    "select_body",
    with_views("parts", extra=["p AS (SELECT message_id, path, mime, decode(from_base64(translate(data, '-_', '+/'))) AS text FROM parts)"])
    + """SELECT message_id, coalesce(first(text ORDER BY path) FILTER (WHERE mime = 'text/plain' AND text <> ''),
  first(text ORDER BY path), '') AS body FROM p GROUP BY message_id""",
)
def select_body(spark, sf_dir):
    """FN-03."""
    return M.select_body(A.parts(spark, sf_dir))


_CLEAN = f"regexp_replace(trim(u), {D.q('[' + ''.join(chr(92) + c for c in fixed.LINK_TRAILING_CHARS) + ']+$')}, '')"
_ADDED = ["<a href=\"", None, "\">x</a><A HREF = '", None, ").'>y</A><a href=\"https://example.org/unsubscribe?u="]
_HTML = " || ".join(["coalesce(html, '')", *[D.q(x) if x else "url" for x in _ADDED], "CAST(page_id AS VARCHAR)", D.q('">z</a>')])


@register(
    "harvest_links",
    f"""WITH pg AS (SELECT page_id, {_HTML} AS html FROM pages),
found AS (SELECT page_id, unnest(regexp_extract_all(html, {D.q(M.HREF)}, 1)) AS u, generate_subscripts(regexp_extract_all(html, {D.q(M.HREF)}, 1), 1) AS i FROM pg),
good AS (SELECT page_id, link, min(i) AS i FROM (SELECT page_id, i, {_CLEAN} AS link FROM found)
  WHERE regexp_matches(link, '(?i)^https?://') AND NOT regexp_matches(link, {D.q(P.JUNK_LINK)}) GROUP BY ALL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS nth, link FROM good""",
)
def harvest_links(spark, sf_dir):
    """FN-04 + SO-05 over raw pages: every link, in order of appearance."""
    p = A.page_html(spark, sf_dir)
    return p.select("page_id", F.posexplode(M.harvest_links(html=T.blank("html"))).alias("p", "link")).select(
        "page_id", (F.col("p") + 1).cast("bigint").alias("nth"), "link"
    )
