"""PL-01: one ingest run as a single Spark plan.

scan (time bound + keywords + not own mail) → one row an id → drop processed ids →
legacy/self split → rules → signal gate → score → guards → routed messages.

The mail is scanned once and classified once. A table of answers is joined by id; any
other scorer gets the undecided messages, and what it was given and what it said are
written to the checkpoint folder, so the five outputs (tracker rows, raw cache rows,
processed marks, alerts, metrics) agree. ``ingest`` stores the routed messages once for them.

Routes, in precedence order (SURVEY §2.13-E):
``unidentified`` (no id: unmarked, kept aside) · ``processed`` (skip) · ``undated`` (no readable time: unmarked, kept aside) · ``late`` (legacy thread, at/before
cursor: unmarked, kept aside) · ``self`` (skip, marked) · ``rule`` · ``noise`` (no signal: marked, not cached) ·
``deferred`` (only with ``max_per_run``: unmarked) · ``failed`` (scorer gave nothing: unmarked) · ``scored``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import text as T
from trackwise.operators import scorer as S
from trackwise.session import cut_lineage


@dataclass
class IngestConfig:
    as_of: str
    cursor: int | None = None  # last checked, epoch seconds (None = first run)
    start_date: str | None = None  # 'YYYY-MM-DD' floor for the first run (default: as_of's day)
    terms: list[str] | None = None  # keyword filter (default: fixed.SEARCH_TERMS); [] disables it
    own_address: str = ""
    max_per_run: int | None = None  # a quota of scored messages; the rest is deferred, newest first
    candidate: str = ""
    overlap_s: int = fixed.OVERLAP_SECONDS


def since_bound(cursor: int | None, start_date: str | None, as_of: str, overlap_s: int = fixed.OVERLAP_SECONDS) -> int:
    """FLT-02: epoch seconds of the scan's lower bound."""
    if cursor is not None and cursor > 0:
        return max(0, int(cursor) - overlap_s)
    day = start_date or as_of[:10]
    d = dt.datetime.fromisoformat(day.replace("/", "-")[:10]).replace(tzinfo=dt.timezone.utc)
    return int(d.timestamp())


def epoch_s(received: str | Column = "received") -> Column:
    return F.floor(F.unix_micros(F.try_to_timestamp(T.blank(received))) / 1_000_000)


def scan_messages(messages: DataFrame, since: int, terms: list[str] | None, own_address: str = "") -> DataFrame:
    """SRC-01 + FLT-01 + FLT-02 + FLT-03 (``-from:me``): messages at or after the bound, and undated ones.

    ``received`` is ISO text, which sorts by time; the plain comparisons reach the Parquet scan (a day's slack for
    zone offsets) and the exact bound follows. Text that sorts before any year is undated, not old."""
    day = dt.datetime.fromtimestamp(max(0, since - 86_400), dt.timezone.utc).strftime("%Y-%m-%d")
    received = F.col("received")
    m = messages.filter(received.isNull() | (received < "19") | (received >= day))
    m = m.filter(epoch_s().isNull() | (epoch_s() >= F.lit(since)))
    if terms is None or terms:
        m = T.keyword_filter(m, terms)
    if own_address:
        m = m.filter(F.lower(T.sender_address("from_header")) != own_address.lower())
    return m


def without_id() -> Column:
    return T.blank("message_id") == ""


def with_key(messages: DataFrame) -> DataFrame:
    """Adds ``_key``: the id, or a key of its own for a message without one, so that these neither fall together nor meet
    in one task."""
    own = F.concat(F.lit("\u0001"), F.monotonically_increasing_id().cast("string"))
    return messages.withColumn("_key", F.when(without_id(), own).otherwise(F.col("message_id")))


def one_per_id(messages: DataFrame) -> DataFrame:
    """SM-02: of messages with one id the first by ``seq``; all messages without an id."""
    first = with_key(messages).groupBy("_key").agg(F.min_by(F.struct(*messages.columns), "seq").alias("m"))
    return first.select("m.*")


def split_processed(messages: DataFrame, processed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """JN-01: (fresh, already processed) by message id; legacy markers count as ids."""
    ids = processed.select("message_id").distinct()
    return messages.join(ids, "message_id", "left_anti"), messages.join(ids, "message_id", "left_semi")


def legacy_threads(processed: DataFrame) -> DataFrame:
    """SRC-06: thread ids of legacy markers (thread column blank)."""
    return processed.filter(T.blank("thread_id") == "").select(F.col("message_id").alias("thread_id")).distinct()


def late_flag(messages: DataFrame, processed: DataFrame, cursor: int | None) -> DataFrame:
    """JN-02: flags messages of a legacy thread received at or before the cursor."""
    lt = legacy_threads(processed).withColumn("_legacy", F.lit(True))
    c = int(cursor) if cursor else 0
    return messages.join(lt, "thread_id", "left").withColumn(
        "is_late", F.coalesce(F.col("_legacy"), F.lit(False)) & F.coalesce(epoch_s() <= F.lit(c), F.lit(False))
    ).drop("_legacy")


def rule_analysis(category: str = "rule_cat") -> Column:
    """Analysis struct for a rule decision (null when the rules are undecided)."""
    cat = F.col(category)
    return F.when(
        cat.isNotNull(),
        F.struct(
            F.lit(True).alias("is_relevant"),
            T.extract_company().alias("company"),
            T.extract_role().alias("role"),
            cat.alias("category"),
            F.when(cat == "Rejection", F.lit("Rejected")).otherwise(F.lit("Applied")).alias("step"),
            F.lit(None).cast("string").alias("interview_datetime"),
            T.blank("subject").alias("summary"),
            F.lit("").alias("apply_url"),
            F.lit("").alias("interviewer_name"),
        ),
    )


def budget(needs: DataFrame, n: int) -> DataFrame:
    """WN-04: ids of the first ``n`` messages needing a score, newest first. A
    bounded top-n (TakeOrderedAndProject), never a global window."""
    ids = needs.select("message_id", "received", "seq")
    return ids.orderBy(F.col("received").desc(), F.col("seq").desc()).limit(n).select("message_id")


def flagged(messages: DataFrame, processed: DataFrame, cfg: IngestConfig) -> DataFrame:
    """Candidates with ``is_done``, ``undated`` and ``is_late``."""
    since = since_bound(cfg.cursor, cfg.start_date, cfg.as_of, cfg.overlap_s)
    cand = one_per_id(scan_messages(messages, since, cfg.terms, cfg.own_address))
    ids = processed.select(F.col("message_id").alias("_key")).distinct().withColumn("is_done", F.lit(True))
    c = with_key(cand).join(ids, "_key", "left").withColumn("is_done", F.coalesce("is_done", F.lit(False)))
    return late_flag(c, processed, cfg.cursor).withColumn("undated", epoch_s().isNull())


def classify(c: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``needs`` (undecided, with a signal) to flagged messages."""
    open_ = ~without_id() & ~F.col("is_done") & ~F.col("undated") & ~F.col("is_late") & ~F.col("is_self")
    c = c.withColumn("rule_cat", F.when(~F.col("is_done"), T.rule_category()))
    c = c.withColumn("needs", open_ & F.col("rule_cat").isNull() & T.has_signal())
    return c.withColumn("rule", rule_analysis()).drop("rule_cat")


def route(messages: DataFrame, processed: DataFrame, scorer, cfg: IngestConfig) -> DataFrame:
    """All candidate messages with ``route``, ``source`` and the final ``analysis``."""
    return decide(flagged(messages, processed, cfg), scorer, cfg, messages.columns)


def decide(c: DataFrame, scorer, cfg: IngestConfig, columns: list[str]) -> DataFrame:
    """Rules, scorer and guards for flagged messages."""
    c = classify(c)
    table = hasattr(scorer, "answers")
    if not table or cfg.max_per_run is not None:
        c = cut_lineage(c)  # read twice below
    if cfg.max_per_run is not None:
        chosen = budget(c.filter("needs"), cfg.max_per_run).withColumn("chosen", F.lit(True))
        c = c.join(chosen, "message_id", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))
    else:
        c = c.withColumn("chosen", F.col("needs"))
    if table:
        said = scorer.answers().select("request_id", S.normalize_response("json").alias("analysis"))
    else:
        said = cut_lineage(S.score(S.build_requests(c.filter("chosen")), scorer))  # scored once, then read
    c = c.join(said.select(F.col("request_id").alias("_key"), F.col("analysis").alias("scored")), "_key", "left")
    route_ = (
        F.when(without_id(), "unidentified")
        .when(F.col("is_done"), "processed")
        .when(F.col("undated"), "undated")
        .when(F.col("is_late"), "late")
        .when(F.col("is_self"), "self")
        .when(F.col("rule").isNotNull(), "rule")
        .when(~F.col("needs"), "noise")
        .when(~F.col("chosen"), "deferred")
        .when(F.col("scored").isNull(), "failed")
        .otherwise("scored")
    )
    c = c.withColumn("route", route_)
    guarded = S.strip_self(S.guard_offer(F.col("scored")), cfg.candidate)
    return c.select(
        *columns,
        "route",
        F.when(F.col("is_done"), "").when(F.col("rule").isNotNull(), "rule").otherwise("ai").alias("source"),
        # only analyzed messages carry an analysis
        F.when(F.col("route") == "rule", F.col("rule")).when(F.col("route") == "scored", guarded).alias("analysis"),
    )


ANALYZED = ["rule", "scored"]


def tracker_rows(routed: DataFrame) -> DataFrame:
    """FN-23 (+ FN-10): tracker rows for relevant analyzed messages; status = step."""
    a = F.col("analysis")
    rel = routed.filter(F.col("route").isin(*ANALYZED) & a["is_relevant"])
    return rel.select(
        "received",
        a["company"].alias("company"),
        T.entity_key(a["company"], "sender_domain").alias("company_key"),
        a["role"].alias("role"),
        a["step"].alias("step"),
        a["category"].alias("category"),
        T.blank(a["interview_datetime"]).alias("interview_datetime"),
        a["summary"].alias("summary"),
        a["step"].alias("status"),
        "source",
        "thread_id",
        T.blank(a["apply_url"]).alias("link"),
        T.blank(a["interviewer_name"]).alias("interviewer"),
        "message_id",
        "seq",
    )


def raw_rows(routed: DataFrame) -> DataFrame:
    """SNK-02 projection: analyzed messages (relevant or not), whole body, links as JSON text."""
    m = routed.filter(F.col("route").isin(*ANALYZED))
    return m.select(
        "message_id",
        "thread_id",
        "received",
        "sender_name",
        "sender_domain",
        "subject",
        T.blank("body").alias("body"),
        F.to_json(F.coalesce("links", F.array().cast("array<string>"))).alias("links"),
        "seq",
    )


def side_rows(routed: DataFrame) -> DataFrame:
    """SM-04: late, undated and unidentified messages, which no other output has, with their route."""
    return routed.filter(F.col("route").isin("late", "undated", "unidentified")).drop("source", "analysis")


def processed_marks(routed: DataFrame, processed_at: str) -> DataFrame:
    """SNK-03: messages settled by this run, one timestamp for the batch."""
    m = routed.filter(F.col("route").isin("self", "rule", "noise", "scored"))
    return m.select("message_id", "thread_id", F.lit(processed_at).alias("processed_at"))


def alert_rows(routed: DataFrame) -> DataFrame:
    """FN-24: Invitation / Offer rows become alert items."""
    t = tracker_rows(routed).filter(F.col("category").isin("Invitation", "Offer"))
    return t.select(
        "company", "company_key", "role", "step", "category", "interview_datetime", "summary", "received", "thread_id", "seq"
    )


def ingest_metrics(routed: DataFrame) -> DataFrame:
    """AG-07: the run's counters in one aggregation."""
    r, a = F.col("route"), F.col("analysis")
    analyzed = r.isin(*ANALYZED)
    rel = analyzed & a["is_relevant"]
    return routed.agg(
        F.count_if(analyzed).alias("scanned"),
        F.count_if(r.isin("unidentified", "processed", "undated", "late", "self")).alias("skipped"),
        F.count_if(rel).alias("relevant"),
        F.count_if(rel & (a["category"] == "Invitation")).alias("invitations"),
        F.count_if(rel & (a["category"] == "Offer")).alias("offers"),
        F.count_if(r == "rule").alias("rule_classified"),
        F.count_if(r.isin("scored", "failed")).alias("ai_calls"),
        F.count_if((r == "noise") | (analyzed & ~a["is_relevant"])).alias("irrelevant"),
        F.count_if(r == "failed").alias("failed"),
        F.count_if(r == "deferred").alias("deferred"),
    )


def advance_cursor(metrics_row, run_start_epoch: int, cursor: int | None) -> int | None:
    """SM-03: the cursor moves to the run's start only when nothing failed or was deferred."""
    if metrics_row["failed"] == 0 and metrics_row["deferred"] == 0:
        return run_start_epoch
    return cursor


@dataclass
class IngestResult:
    routed: DataFrame
    rows: DataFrame
    raw: DataFrame
    processed: DataFrame
    alerts: DataFrame
    metrics: DataFrame


def ingest(messages: DataFrame, processed: DataFrame, scorer, cfg: IngestConfig, processed_at: str | None = None) -> IngestResult:
    routed = cut_lineage(route(messages, processed, scorer, cfg))
    return IngestResult(
        routed=routed,
        rows=tracker_rows(routed),
        raw=raw_rows(routed),
        processed=processed_marks(routed, processed_at or cfg.as_of),
        alerts=alert_rows(routed),
        metrics=ingest_metrics(routed),
    )
