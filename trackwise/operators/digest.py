"""Rate-limited digest of Invitation/Offer alerts (ST-02, SM-05, AG-11, AG-12,
SO-04, PL-05).

``ord`` is the merge order: held (pending) items first, then this run's new
items, each in ``seq`` order. Grouping "in order of first appearance" becomes a
``min(ord)`` key, "newest first" a ``max(struct(received, -ord))`` key. A digest is a table of ordered
lines (header, one title a company, one line a role, footer), so no company and no digest is put together
in one task; a mailer streams the lines in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import text as T

ALERT_COLS = ["company", "company_key", "role", "step", "category", "interview_datetime", "summary", "received", "thread_id", "seq"]


def dedup_key(mode: str = "thread") -> Column:
    """Quirk Q2: by default two alerts of one thread collapse to the first;
    ``mode="message"`` keeps every alert item."""
    if mode == "message":
        return F.col("seq").cast("string")
    composite = F.concat_ws("|", T.blank("company_key"), T.blank("role"), T.blank("received"))
    return F.when(T.blank("thread_id") != "", F.col("thread_id")).otherwise(composite)


def merge_alerts(pending: DataFrame, new: DataFrame, mode: str = "thread") -> DataFrame:
    """ST-02: pending ∪ new, first item per thread (else company|role|received) wins."""
    p = pending.select(*ALERT_COLS).withColumn("src", F.lit(0))
    n = new.select(*ALERT_COLS).withColumn("src", F.lit(1))
    u = p.unionByName(n).withColumn("ord", F.struct("src", "seq")).withColumn("dkey", dedup_key(mode))
    first = u.groupBy("dkey").agg(F.min_by(F.struct(*ALERT_COLS, "ord"), "ord").alias("it"))
    return first.select("dkey", "it.*")


def gate(merged: DataFrame, state: DataFrame, now_epoch: int, window_s: int = fixed.DIGEST_WINDOW_MINUTES * 60) -> DataFrame:
    """SM-05: the items with ``outcome``: 'queued' while the window since the state's last digest is open, else 'sent'.
    Without items there is nothing to say. ``state``: last_notified_epoch (SRC-08), possibly without rows."""
    last = state.agg(F.max("last_notified_epoch").alias("last"))  # one row
    open_ = F.coalesce(F.lit(now_epoch) - F.col("last") < window_s, F.lit(False))
    return merged.crossJoin(F.broadcast(last)).withColumn("outcome", F.when(open_, "queued").otherwise("sent")).drop("last")


def next_state(gated: DataFrame, state: DataFrame, now_epoch: int) -> DataFrame:
    """SNK-05/08: the state after a digest: notified now if an item was sent, else as it was."""
    sent = gated.agg(F.max(F.when(F.col("outcome") == "sent", F.lit(now_epoch))).alias("now"))
    last = state.agg(F.max("last_notified_epoch").alias("last"))
    return sent.crossJoin(F.broadcast(last)).select(F.coalesce("now", "last").cast("bigint").alias("last_notified_epoch"))


def newest() -> Column:
    return F.struct(F.col("received"), (-F.col("ord.src")).alias("src"), (-F.col("ord.seq")).alias("seq"))


def role_lines(merged: DataFrame) -> DataFrame:
    """AG-11: (company_key, role_order, line), one row a role of a company."""
    m = merged.withColumn("role_label", F.when(T.blank("role") != "", F.col("role")).otherwise(F.lit(fixed.DIGEST_NO_ROLE)))
    roles = m.groupBy("company_key", "role_label").agg(
        F.max(newest()).alias("role_order"),
        F.max_by(F.struct("step", "category", "summary"), newest()).alias("latest"),
        F.max(F.when(T.blank("interview_datetime") != "", F.col("interview_datetime"))).alias("with_time"),
    )
    L = F.col("latest")
    line = F.concat(
        F.lit(fixed.DIGEST_ROLE_BULLET),
        F.col("role_label"),
        F.lit(" — "),
        F.when(T.blank(L["step"]) != "", L["step"]).otherwise(T.blank(L["category"])),
        F.coalesce(F.concat(F.lit("\n" + fixed.DIGEST_INTERVIEW_LINE), F.col("with_time")), F.lit("")),
        F.when(T.blank(L["summary"]) != "", F.concat(F.lit("\n" + fixed.DIGEST_SUMMARY_INDENT), L["summary"])).otherwise(F.lit("")),
    )
    return roles.select("company_key", "role_order", line.alias("line"))


def company_titles(merged: DataFrame) -> DataFrame:
    """AG-11: (company_key, company_order, first_company, n_items, title), one row a company."""
    companies = merged.groupBy("company_key").agg(
        F.min("ord").alias("company_order"),
        F.max_by("company", newest()).alias("newest_company"),
        F.min_by("company", "ord").alias("first_company"),
        F.count(F.lit(1)).alias("n_items"),
    )
    name = F.when(T.blank("newest_company") != "", F.col("newest_company")).otherwise(F.lit(fixed.DIGEST_UNKNOWN_COMPANY))
    return companies.select(
        "company_key", "company_order", "first_company", "n_items", F.concat(F.lit(fixed.DIGEST_COMPANY_BULLET), name).alias("title")
    )


def subject() -> Column:
    """AG-12 over n_items, n_companies, first_company."""
    first = F.when(T.blank("first_company") != "", F.col("first_company")).otherwise(F.lit(fixed.DIGEST_SUBJECT_ONE_FALLBACK))
    one = F.replace(F.lit(fixed.DIGEST_SUBJECT_ONE), F.lit("{company}"), first)
    many = F.replace(F.lit(fixed.DIGEST_SUBJECT_MANY), F.lit("{items}"), F.col("n_items").cast("string"))
    many = F.replace(many, F.lit("{companies}"), F.col("n_companies").cast("string"))
    return F.when(F.col("n_companies") == 1, one).otherwise(many)


def digest_rows(merged: DataFrame) -> DataFrame:
    """AG-11 + AG-12: the digest's lines. Their order (SO-04): ``part`` (0 subject, 1 head, 2 companies, 3 tail), then the
    company's first appearance (c_src, c_seq), its title before its roles, the roles newest first (received
    descending, then r_src, r_seq). Without items there are no lines."""
    titles, lines = company_titles(merged), role_lines(merged)
    none = F.lit(None).cast("string")
    order = [F.col("company_order.src").alias("c_src"), F.col("company_order.seq").alias("c_seq")]
    zero = [F.lit(0).alias("c_src"), F.lit(0).cast("bigint").alias("c_seq")]
    no_role = [none.alias("received"), F.lit(0).alias("r_src"), F.lit(0).cast("bigint").alias("r_seq")]
    head = titles.select(F.lit(2).alias("part"), "company_key", *order, F.lit(0).alias("is_role"), *no_role, F.col("title").alias("text"))
    roles = lines.join(titles.select("company_key", "company_order"), "company_key").select(
        F.lit(2).alias("part"), "company_key", *order, F.lit(1).alias("is_role"), F.col("role_order.received").alias("received"),
        (-F.col("role_order.src")).alias("r_src"), (-F.col("role_order.seq")).alias("r_seq"), F.col("line").alias("text"),
    )
    totals = titles.agg(
        F.sum("n_items").alias("n_items"), F.count(F.lit(1)).alias("n_companies"), F.min_by("first_company", "company_order").alias("first_company")
    ).filter("n_companies > 0")
    opening = F.when(F.col("n_companies") == 1, fixed.DIGEST_BODY_HEAD_ONE).otherwise(fixed.DIGEST_BODY_HEAD_MANY)
    frame = F.array(
        F.struct(F.lit(0).alias("part"), subject().alias("text")),
        F.struct(F.lit(1).alias("part"), opening.alias("text")),
        F.struct(F.lit(3).alias("part"), F.lit(fixed.DIGEST_BODY_TAIL).alias("text")),
    )
    ends = totals.select(F.inline(frame)).select("part", none.alias("company_key"), *zero, F.lit(0).alias("is_role"), *no_role, "text")
    return head.unionByName(roles).unionByName(ends)


def digest_sections(merged: DataFrame) -> DataFrame:
    """AG-11 as one text a company, for small digests: (company_key, company_order, first_company, n_items, section).
    ``digest_rows`` has the same lines without putting a company together."""
    newest_first = F.reverse(F.array_sort(F.collect_list(F.struct(F.col("role_order").alias("k"), F.col("line").alias("l")))))
    texts = role_lines(merged).groupBy("company_key").agg(newest_first.alias("lines"))
    section = F.concat(F.col("title"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["l"]), "\n"))
    return company_titles(merged).join(texts, "company_key").select("company_key", "company_order", "first_company", "n_items", section.alias("section"))
