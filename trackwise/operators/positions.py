"""Positions: group → cluster → segment → roll up (AG-01..06, WN-01..03, SO-01/02).

Ordering facts that the results depend on (the source data is an ordered list):

* rows of a merged cluster are concatenated in key-rank order, then ``seq``; a
  stable sort by ``received`` follows. The chronological order is therefore
  ``(received, -cnt, first_seen, seq)`` where ``cnt``/``first_seen`` belong to
  the row's own key.
* "most recent" is a stable descending sort: ties take the earliest row in
  chronological order → ``max_by(x, struct(received, cnt, -first_seen, -seq))``.

Every rollup is a ``groupBy`` with ``max_by``/``min_by`` over struct keys, so
Spark aggregates partially on the map side; no group is collected into a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import text as T
from trackwise.functions import timefn as TF
from trackwise.operators.cluster import cluster_keys
from trackwise.session import stored


def group_key(company_key="company_key", company="company") -> Column:
    """AG-01: normalised key, else normalised company, else 'unknown'."""
    return F.coalesce(T.nonblank(T.norm(company_key)), T.nonblank(T.norm(company)), F.lit("unknown"))


def chrono() -> Column:
    """Ascending = oldest first (ties: key rank, then seq)."""
    return F.struct(F.col("received"), -F.col("cnt"), F.col("first_seen"), F.col("seq"))


def recency() -> Column:
    """Larger = more recent; among equal ``received`` the earliest row wins."""
    return F.struct(F.col("received"), F.col("cnt"), -F.col("first_seen"), -F.col("seq"))


def concat_order() -> Column:
    """Order of the concatenated cluster rows before the time sort."""
    return F.struct(-F.col("cnt"), F.col("first_seen"), F.col("seq"))


def wall_minutes(c) -> Column:
    """Wall-clock as minutes since 1970-01-01 (ordering/comparison key)."""
    w = TF.wall_clock(c)
    return F.datediff(F.to_date(w), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(w) * 60 + F.minute(w)


def now_minutes(as_of, tz: str) -> int:
    w = TF.wall_now(as_of, tz)
    import datetime as dt

    return (w - dt.datetime(1970, 1, 1)).days * 1440 + w.hour * 60 + w.minute


#: What the rollups read of a clustered event.
EVENT_COLUMNS = [
    "received", "company", "company_key", "role", "step", "category", "interview_datetime", "summary", "status", "thread_id", "link",
    "interviewer", "message_id", "seq", "cnt", "first_seen", "cluster",
]

#: The same of a row as it comes in.
ROW_COLUMNS = [c for c in EVENT_COLUMNS if c not in ("cnt", "first_seen", "cluster")]


def assign_clusters(
    events: DataFrame, min_contain: int = fixed.CONTAIN_MIN_LEN, min_len: int = 0, key_map: DataFrame | None = None
) -> DataFrame:
    """Adds ``gkey``, ``cnt``, ``first_seen`` (of the row's own key) and ``cluster``. ``key_map``: a stored result of
    ``cluster_keys`` for these events, so that several queries cluster once."""
    ev = events.withColumn("gkey", group_key())
    if key_map is not None:
        return ev.join(key_map.select(F.col("key").alias("gkey"), "cnt", "first_seen", F.col("canonical").alias("cluster")), "gkey")
    stats = ev.groupBy("gkey").agg(F.count(F.lit(1)).alias("cnt"), F.min("seq").alias("first_seen"))
    stats = stats.withColumnRenamed("gkey", "key")
    keyed = cluster_keys(stats, min_contain, min_len).select(
        F.col("key").alias("gkey"), "cnt", "first_seen", F.col("canonical").alias("cluster")
    )
    return ev.join(keyed, "gkey")


def segment_events(ev: DataFrame, boundary: Column | None = None) -> DataFrame:
    """WN-01: ``seg`` = number of boundary rows strictly before the row in its
    cluster (segments close *after* each boundary).

    Skew-safe two-pass prefix sum: a cluster, or one instant of a cluster, may hold a third of all rows. The rows are
    dealt out by ranges of their total order, so every range (``chunk``) has about as many rows whatever the keys; the
    running count is computed inside (cluster, chunk), and the totals of the chunks, one row each,
    supply the offsets. The ranges are stored before they are read twice."""
    boundary = T.is_boundary() if boundary is None else boundary
    order = [F.col("received"), F.col("cnt").desc(), F.col("first_seen"), F.col("seq")]
    n = int(ev.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ev = ev.withColumn("is_boundary", boundary).repartitionByRange(n, F.col("cluster"), *order)
    ev = stored(ev.withColumn("chunk", F.spark_partition_id()), "ranges")
    b = F.col("is_boundary").cast("int")
    w = Window.partitionBy("cluster", "chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(b).over(w), F.lit(0))
    totals = ev.groupBy("cluster", "chunk").agg(F.sum(b).alias("n_boundary"))
    w2 = Window.partitionBy("cluster").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("cluster", "chunk", F.coalesce(F.sum("n_boundary").over(w2), F.lit(0)).alias("offset"))
    ev = ev.withColumn("local_before", local).join(offsets, ["cluster", "chunk"])
    return ev.withColumn("seg", F.col("offset") + F.col("local_before")).drop("offset", "local_before", "chunk")


def best_company(ev: DataFrame) -> DataFrame:
    """AG-02: per cluster, the most frequent trimmed name that is not 'unknown'
    (ties: first in concatenation order), else the first non-blank name, else
    'Unknown'."""
    named = ev.withColumn("nm", T.jtrim("company"))
    lvl1 = named.groupBy("cluster", "nm").agg(F.count(F.lit(1)).alias("n"), F.min(concat_order()).alias("first"))
    valid = (F.col("nm") != "") & (F.lower(F.col("nm")) != "unknown")
    return lvl1.groupBy("cluster").agg(
        F.coalesce(
            F.min_by("nm", F.when(valid, F.struct(-F.col("n"), F.col("first")))),
            F.min_by("nm", F.when(F.col("nm") != "", F.col("first"))),
            F.lit("Unknown"),
        ).alias("company_name")
    )


def segment_role(ev: DataFrame) -> DataFrame:
    """AG-03 (+ WN-03, FN-17): most tokens, then most frequent, then most recent;
    only real roles; '' when the segment has none."""
    real = ev.filter(T.is_real_role("role")).withColumn("nrole", T.norm("role"))
    lvl1 = real.groupBy("cluster", "seg", "nrole").agg(
        F.count(F.lit(1)).alias("freq"),
        F.max(recency()).alias("rec"),
        F.max_by(T.jtrim("role"), recency()).alias("role_text"),
    ).withColumn("ntok", F.size(T.role_tokens("nrole")))
    return lvl1.groupBy("cluster", "seg").agg(
        F.max_by("role_text", F.struct("ntok", "freq", "rec")).alias("seg_role")
    )


def rollup_segments(ev: DataFrame, as_of, tz: str = fixed.DISPLAY_TZ) -> DataFrame:
    """AG-04 + AG-05 + AG-06 over (cluster, seg). ``ev`` carries cluster, seg,
    cnt, first_seen and the tracker columns."""
    now_m = now_minutes(as_of, tz)
    ev = ev.withColumns(
        {"wm": wall_minutes("interview_datetime"), "is_boundary": T.is_boundary(), "cat": T.norm("category"), "manual": T.is_manual()}
    )
    rec = recency()
    ch = chrono()
    latest = F.struct(
        "received", "company_key", "thread_id", "message_id", "summary", "status", "step", "category", "manual",
    )
    cat = F.col("cat")
    upcoming = F.col("wm") >= F.lit(now_m)
    agg = ev.groupBy("cluster", "seg").agg(
        F.count(F.lit(1)).alias("rounds"),
        F.max_by(latest, rec).alias("latest"),
        F.max_by(F.struct("status", "step", "manual"), F.when(F.col("is_boundary"), rec)).alias("term"),
        F.max_by("step", F.when(cat == "offer", rec)).alias("offer_step"),
        F.max((cat == "offer").cast("int")).alias("has_offer"),
        F.max_by("step", F.when(cat == "invitation", rec)).alias("inv_step"),
        F.max((cat == "invitation").cast("int")).alias("has_inv"),
        F.max(upcoming.cast("int")).alias("has_upcoming"),
        F.min_by("interview_datetime", F.when(upcoming, F.struct(F.col("wm"), ch))).alias("next_up"),
        F.min_by("interview_datetime", F.when(F.col("wm").isNotNull(), F.struct(-F.col("wm"), ch))).alias("last_past"),
        F.max_by("link", F.when(F.col("link") != "", rec)).alias("recent_link"),
        F.max_by("interviewer", F.when(F.col("interviewer") != "", rec)).alias("recent_interviewer"),
        F.min(concat_order()).alias("first_row"),
    )
    L = F.col("latest")
    term = F.col("term")
    term_status = F.coalesce(T.nonblank(term["status"]), T.nonblank(term["step"]), F.lit("Rejected"))
    manual_cat = F.coalesce(
        *[F.when(T.norm(L["status"]) == k, F.lit(v)) for k, v in fixed.MANUAL_CATEGORY.items()], F.lit("Other")
    )
    status = (
        F.when(term.isNotNull(), term_status)
        .when(L["manual"], L["status"])
        .when(F.col("has_offer") == 1, F.coalesce(T.nonblank(F.col("offer_step")), F.lit("Offer")))
        .when(F.col("has_inv") == 1, F.coalesce(T.nonblank(F.col("inv_step")), F.lit("Interview")))
        .when(F.col("has_upcoming") == 1, F.lit("Interview scheduled"))
        .otherwise(F.coalesce(T.nonblank(L["status"]), T.nonblank(L["step"]), F.lit("Applied")))
    )
    category = (
        F.when(term.isNotNull(), F.when(T.norm(term_status) == "rejected", "Rejection").otherwise("Other"))
        .when(L["manual"], manual_cat)
        .when(F.col("has_offer") == 1, F.lit("Offer"))
        .when(F.col("has_inv") == 1, F.lit("Invitation"))
        .when(F.col("has_upcoming") == 1, F.lit("Invitation"))
        .otherwise(F.coalesce(T.nonblank(L["category"]), F.lit("Other")))
    )
    source = (
        F.when(term.isNotNull(), F.when(term["manual"], "manual").otherwise("derived"))
        .when(L["manual"], F.lit("manual"))
        .otherwise(F.lit("derived"))
    )
    return agg.select(
        "cluster",
        "seg",
        "rounds",
        "first_row",
        status.alias("status"),
        category.alias("category"),
        source.alias("status_source"),
        L["summary"].alias("summary"),
        L["received"].alias("last_update"),
        F.coalesce("next_up", "last_past", F.lit("")).alias("next_interview"),
        L["thread_id"].alias("latest_thread_id"),
        L["message_id"].alias("latest_message_id"),
        L["company_key"].alias("latest_company_key"),
        F.coalesce("recent_link", F.lit("")).alias("link"),
        F.coalesce("recent_interviewer", F.lit("")).alias("recent_interviewer"),
    )


def interview_owner(ev: DataFrame, seg: DataFrame) -> DataFrame:
    """Interviewer named on the shown interview's own row (first in chronological
    order). Only rows that name an interviewer and a time take part, so this
    join sees a small slice of the events."""
    cand = ev.filter((F.col("interviewer") != "") & (F.col("interview_datetime") != "")).select(
        "cluster", "seg", "interview_datetime", "interviewer", chrono().alias("ch")
    )
    shown = seg.filter(F.col("next_interview") != "").select(
        "cluster", "seg", F.col("next_interview").alias("interview_datetime")
    )
    return cand.join(shown, ["cluster", "seg", "interview_datetime"]).groupBy("cluster", "seg").agg(
        F.min_by("interviewer", "ch").alias("shown_interviewer")
    )


POSITION_COLUMNS = [
    "key",
    "company",
    "role",
    "status",
    "category",
    "status_source",
    "summary",
    "last_update",
    "next_interview",
    "rounds",
    "stale",
    "latest_thread_id",
    "latest_message_id",
    "link",
    "interviewer",
]


def position_rollup(ev: DataFrame, as_of, tz: str = fixed.DISPLAY_TZ) -> DataFrame:
    """Positions from clustered + segmented events; keeps ``cluster``, ``seg`` and
    ``first_row`` (cluster order) for ordering."""
    seg = rollup_segments(ev, as_of, tz)
    roles = segment_role(ev)
    names = best_company(ev)
    owner = interview_owner(ev, seg)
    p = seg.join(roles, ["cluster", "seg"], "left").join(owner, ["cluster", "seg"], "left").join(names, "cluster", "left")
    role = F.coalesce("seg_role", F.lit(""))
    company = F.col("company_name")
    key = F.concat_ws(
        "|",
        T.norm(F.coalesce(T.nonblank(F.col("latest_company_key")), company)),
        T.norm(role),
        F.col("latest_thread_id"),
    )
    interviewer = F.coalesce(
        F.when(F.col("next_interview") != "", T.nonblank(F.col("shown_interviewer"))),
        F.col("recent_interviewer"),
    )
    terminal = T.is_terminal("category", "status")
    return p.select(
        key.alias("key"),
        company.alias("company"),
        F.when(role == "", F.lit("—")).otherwise(role).alias("role"),
        "status",
        "category",
        "status_source",
        "summary",
        "last_update",
        "next_interview",
        "rounds",
        TF.is_stale("last_update", terminal, as_of).alias("stale"),
        "latest_thread_id",
        "latest_message_id",
        "link",
        interviewer.alias("interviewer"),
        "cluster",
        "seg",
    )


def cluster_rank(ev: DataFrame) -> DataFrame:
    """Leader order of each cluster (the order positions were emitted in)."""
    return ev.groupBy("cluster").agg(F.min(concat_order()).alias("cluster_order"))


def order_positions(pos: DataFrame, by: str = "interview") -> DataFrame:
    """SO-01 / SO-02. ``interview``: shown interview ascending (none last), then
    last update descending; ``recent``: last update descending; ``company``:
    company A–Z with Unicode collation. The lists are sorted stably after the
    default order, so ties fall back to it, then to emission order."""
    # a column, as an expression would be worked out in each comparison of the sort
    pos = pos.withColumn("_wm", F.when(F.col("next_interview") != "", wall_minutes("next_interview")))
    default = [F.col("_wm").asc_nulls_last(), F.col("last_update").desc()]
    if "cluster_order" in pos.columns:
        default += [F.col("cluster_order"), F.col("seg")]
    if by == "recent":
        return pos.orderBy(F.col("last_update").desc(), *default).drop("_wm")
    if by == "company":
        return pos.orderBy(F.expr("company COLLATE UNICODE"), *default).drop("_wm")
    return pos.orderBy(*default).drop("_wm")
