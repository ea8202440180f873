"""Text, rule and scalar-expression queries (FN-01..17, FLT-01/04..08/13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.checks import duck as D
from trackwise.checks.duck_adapters import with_views
from trackwise.checks.registry import register
from trackwise.functions import patterns as P
from trackwise.functions import text as T
from trackwise.functions import timefn as TF
from trackwise.operators import positions as PO
from trackwise.sources import adapters as A


def _mail_sql(select: str, where: str = "TRUE") -> str:
    return with_views("mail") + f"SELECT {select} FROM mail WHERE {where}"


def _tracker_sql(select: str, where: str = "TRUE") -> str:
    return with_views("tracker") + f"SELECT {select} FROM tracker WHERE {where}"


@register(
    "classify_rules",
    _mail_sql(f"message_id, coalesce({D.rule_category()}, '') AS rule_category, {D.has_signal()} AS has_signal"),
)
def classify_rules(spark, sf_dir):
    """FN-09 + FLT-04 over every message."""
    m = A.mail(spark, sf_dir)
    return m.select(
        "message_id",
        F.coalesce(T.rule_category(), F.lit("")).alias("rule_category"),
        T.has_signal().alias("has_signal"),
    )


@register(
    "extract_company",
    _mail_sql(
        f"message_id, {D.company_from_subject()} AS subject_company, {D.company_from_behalf()} AS behalf_company, "
        f"{D.clean_company('sender_name')} AS clean_sender, {D.title_domain('sender_domain')} AS domain_title, "
        f"{D.extract_company()} AS company"
    ),
)
def extract_company(spark, sf_dir):
    """FN-05, FN-06, FN-07."""
    m = A.mail(spark, sf_dir)
    return m.select(
        "message_id",
        T.company_from_subject().alias("subject_company"),
        T.company_from_behalf().alias("behalf_company"),
        T.clean_company("sender_name").alias("clean_sender"),
        T.title_domain("sender_domain").alias("domain_title"),
        T.extract_company().alias("company"),
    )


@register("extract_role", _mail_sql(f"message_id, {D.extract_role()} AS role"))
def extract_role(spark, sf_dir):
    """FN-08."""
    return A.mail(spark, sf_dir).select("message_id", T.extract_role().alias("role"))


@register(
    "entity_key",
    _mail_sql(f"message_id, {D.entity_key(D.extract_company(), 'sender_domain')} AS company_key"),
)
def entity_key(spark, sf_dir):
    """FN-10 over the extracted company."""
    m = A.mail(spark, sf_dir)
    return m.select("message_id", T.entity_key(T.extract_company(), "sender_domain").alias("company_key"))


@register(
    "sender_split",
    _mail_sql(
        f"message_id, {D.sender_name('from_header')} AS sender_name, {D.sender_domain('from_header')} AS sender_domain"
    ),
)
def sender_split(spark, sf_dir):
    """FN-02."""
    m = A.mail(spark, sf_dir)
    return m.select(
        "message_id", T.sender_name("from_header").alias("sender_name"), T.sender_domain("from_header").alias("sender_domain")
    )


_KW = P.whole_terms(fixed.SEARCH_TERMS)


@register(
    "keyword_filter",
    _mail_sql("message_id, thread_id, received", f"{D.rlike(D.blank('subject'), _KW)} OR {D.rlike(D.blank('body'), _KW)}"),
)
def keyword_filter(spark, sf_dir):
    """FLT-01: bilingual keyword filter over subject and body."""
    return T.keyword_filter(A.mail(spark, sf_dir)).select("message_id", "thread_id", "received")


@register(
    "normalize_text",
    _tracker_sql(f"seq, {D.norm('role')} AS norm_role, {D.norm('company')} AS norm_company, {D.jtrim('role')} AS trim_role"),
)
def normalize_text(spark, sf_dir):
    """FN-01."""
    tr = A.tracker(spark, sf_dir)
    return tr.select("seq", T.norm("role").alias("norm_role"), T.norm("company").alias("norm_company"), T.jtrim("role").alias("trim_role"))


@register(
    "row_predicates",
    _tracker_sql(
        f"seq, {D.is_terminal()} AS is_terminal, {D.is_boundary()} AS is_boundary, {D.is_manual()} AS is_manual, "
        f"{D.is_real_role()} AS is_real_role, {D.is_known_company()} AS is_known_company"
    ),
)
def row_predicates(spark, sf_dir):
    """FLT-05, FLT-06, FLT-07, FLT-08, FLT-13."""
    tr = A.tracker(spark, sf_dir)
    return tr.select(
        "seq",
        T.is_terminal().alias("is_terminal"),
        T.is_boundary().alias("is_boundary"),
        T.is_manual().alias("is_manual"),
        T.is_real_role().alias("is_real_role"),
        T.is_known_company().alias("is_known_company"),
    )


@register(
    "role_tokens",
    _tracker_sql(
        f"seq, {D.role_token_count()} AS n_tokens, "
        f"array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array({D.norm('role')}, '[^a-z0-9]+'), lambda x: x <> ''))), ' ') AS tokens"
    ),
)
def role_tokens(spark, sf_dir):
    """FN-17."""
    tr = A.tracker(spark, sf_dir)
    toks = T.role_tokens("role")
    return tr.select("seq", F.size(toks).alias("n_tokens"), F.array_join(F.array_sort(toks), " ").alias("tokens"))


_NOW_M = PO.now_minutes(A.TRACKER_AS_OF, fixed.DISPLAY_TZ)
_AS_OF_S = TF.parse_as_of(A.TRACKER_AS_OF).timestamp()


@register(
    "wall_clock",
    _tracker_sql(
        f"seq, interview_datetime, coalesce(strftime({D.wall_clock('interview_datetime')}, '%Y-%m-%d %H:%M'), '') AS wall, "
        f"coalesce(date_diff('minute', TIMESTAMP '1970-01-01', {D.wall_clock('interview_datetime')}) >= {_NOW_M}, false) AS upcoming, "
        f"coalesce({int(_AS_OF_S * 1000)} - epoch_ms(TRY_CAST(received AS TIMESTAMPTZ)), 0) AS age_ms, "
        f"coalesce(({_AS_OF_S} - epoch(TRY_CAST(received AS TIMESTAMPTZ))) / 86400.0, 0) > {fixed.STALE_DAYS} AS over_stale_days"
    ),
)
def wall_clock(spark, sf_dir):
    """FN-14 (wall-clock parse), FN-15 (now in zone), FN-16 (age in days)."""
    tr = A.tracker(spark, sf_dir)
    wm = PO.wall_minutes("interview_datetime")
    return tr.select(
        "seq",
        "interview_datetime",
        F.coalesce(F.date_format(TF.wall_clock("interview_datetime"), "yyyy-MM-dd HH:mm"), F.lit("")).alias("wall"),
        F.coalesce(wm >= F.lit(_NOW_M), F.lit(False)).alias("upcoming"),
        F.coalesce(F.lit(int(_AS_OF_S * 1000)) - F.unix_millis(TF.instant("received")), F.lit(0)).alias("age_ms"),
        (TF.days_since("received", A.TRACKER_AS_OF) > fixed.STALE_DAYS).alias("over_stale_days"),
    )
