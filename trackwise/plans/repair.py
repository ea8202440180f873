"""Repair: raw-cache read, known/unseen threads, keyed status updates and
re-classification with a long-form diff (SRC-05, ST-01, ST-03, JN-03..05,
JN-09, FLT-11, ML-01..03, SNK-04, PL-02/03 core).

All steps are joins and aggregations keyed by message id or (thread, received);
nothing is looked up row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import text as T
from trackwise.operators import scorer as S
from trackwise.plans import ingest as I
from trackwise.session import cut_lineage

RAW_FIELDS = ["thread_id", "received", "sender_name", "sender_domain", "subject", "body", "links"]


def read_raw(raw: DataFrame) -> DataFrame:
    """SRC-05: one entry per message id; the *last* write wins, the cache position
    is the *first* write (``first_seq``); links JSON that is corrupt or not an
    array reads as []."""
    links = F.coalesce(F.try_parse_json(T.blank("links")), F.parse_json(F.lit("[]")))
    arr = F.when(F.schema_of_variant(links).startswith("ARRAY"), F.variant_get(links, "$", "array<string>"))
    r = raw.filter(T.blank("message_id") != "").withColumn("links_arr", F.coalesce(arr, F.array().cast("array<string>")))
    content = F.struct(*[F.col(c) for c in RAW_FIELDS if c != "links"], F.col("links_arr").alias("links"))
    g = r.groupBy("message_id").agg(F.max_by(content, "seq").alias("c"), F.min("seq").alias("first_seq"))
    return g.select("message_id", "first_seq", "c.*")


def known_threads(tracker: DataFrame, processed: DataFrame) -> DataFrame:
    """ST-01: tracker threads ∪ legacy markers."""
    t = tracker.filter(T.blank("thread_id") != "").select("thread_id")
    return t.unionByName(I.legacy_threads(processed)).distinct()


def unseen_messages(messages: DataFrame, threads: DataFrame, processed: DataFrame) -> DataFrame:
    """ST-03: archive messages of known threads never processed (key-wise EXCEPT)."""
    ids = processed.select("message_id").distinct()
    return messages.join(threads, "thread_id", "left_semi").join(ids, "message_id", "left_anti")


def validate_status(updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-11: (accepted, rejected) status updates by the whitelist."""
    ok = F.coalesce(F.col("status").isin(*fixed.OVERRIDE_STATUSES), F.lit(False))  # a null status is rejected
    return updates.filter(ok), updates.filter(~ok)


def resolve_targets(tracker: DataFrame, updates: DataFrame) -> DataFrame:
    """JN-09: the row an update id points at — exact message id, else the latest
    row (by received) of the thread with that id. Unknown ids give no row."""
    by_msg = tracker.filter(T.blank("message_id") != "").groupBy("message_id").agg(F.min("seq").alias("seq_m"))
    by_thread = tracker.groupBy("thread_id").agg(
        F.max_by("seq", F.struct(F.col("received"), -F.col("seq"))).alias("seq_t")
    )
    u = updates.join(by_msg, updates["id"] == by_msg["message_id"], "left").drop("message_id")
    u = u.join(by_thread, u["id"] == by_thread["thread_id"], "left").drop("thread_id")
    return u.select(*updates.columns, F.coalesce("seq_m", "seq_t").alias("target_seq"))


def apply_patch(base: DataFrame, patch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """SNK-04: left join on ``key`` and take the patched value where present."""
    p = patch.select(key, *[F.col(c).alias(f"__p_{c}") for c in cols])
    j = base.join(p, key, "left")
    return j.select(*[F.coalesce(F.col(f"__p_{c}"), F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def status_patch(tracker: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ML-01: (seq, status) to be set, one row a ``seq``, and the rejected updates. An update whose id
    matches no row, or whose status is not allowed, is rejected."""
    if "ord" not in updates.columns:
        raise ValueError("updates need an order column 'ord'")
    ok, bad = validate_status(updates)
    targets = resolve_targets(tracker, ok)
    unknown = targets.filter(F.col("target_seq").isNull()).select("id", "status")
    # several updates to one row: the last one in update order wins
    patch = targets.filter(F.col("target_seq").isNotNull()).groupBy("target_seq").agg(F.max_by("status", "ord").alias("status"))
    return patch.withColumnRenamed("target_seq", "seq"), bad.select("id", "status").unionByName(unknown)


def update_status(tracker: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ML-01: returns (patched tracker, rejected updates)."""
    patch, rejected = status_patch(tracker, updates)
    return apply_patch(tracker, patch, "seq", ["status"]), rejected


def attach_raw(tracker: DataFrame, raw_latest: DataFrame, messages: DataFrame) -> DataFrame:
    """JN-03 / JN-04 / JN-05: the row's message content — cache by message id,
    else the cache entry of the same (thread, received) that comes first in cache
    order, else the archive by message id, else the archive by (thread, received).
    Adds ``raw`` (struct or null) and ``raw_from`` ('cache', 'archive', null)."""
    content = F.struct(*[F.col(c) for c in ["message_id"] + RAW_FIELDS])
    by_id = raw_latest.select(F.col("message_id").alias("_mid"), content.alias("r_id"))
    by_tr = raw_latest.groupBy("thread_id", "received").agg(F.min_by(content, "first_seq").alias("r_tr"))
    arch = messages.select(*(["message_id"] + RAW_FIELDS), "seq")
    a_content = F.struct(*[F.col(c) for c in ["message_id"] + RAW_FIELDS])
    a_id = arch.select(F.col("message_id").alias("_aid"), a_content.alias("a_id"))
    a_tr = arch.groupBy("thread_id", "received").agg(F.min_by(a_content, "seq").alias("a_tr"))
    # a blank id finds nothing and must not meet other blanks in one task: it joins on a key of its own
    own = F.concat(F.lit("\u0001"), F.col("seq").cast("string"))
    t = tracker.withColumn("_mkey", F.when(T.blank("message_id") != "", F.col("message_id")).otherwise(own))
    t = t.join(by_id, t["_mkey"] == by_id["_mid"], "left").drop("_mid")
    t = t.join(by_tr, ["thread_id", "received"], "left")
    t = t.join(a_id, t["_mkey"] == a_id["_aid"], "left").drop("_aid", "_mkey")
    # the archive is searched by thread only if there is one
    t = t.withColumn("_tkey", F.when(T.blank("thread_id") != "", F.col("thread_id")).otherwise(own))
    a_tr = a_tr.withColumnRenamed("thread_id", "_tkey")
    t = t.join(a_tr, ["_tkey", "received"], "left").drop("_tkey").select(*tracker.columns, "r_id", "r_tr", "a_id", "a_tr")
    has_id = T.blank("message_id") != ""
    cache = F.coalesce(F.when(has_id, F.col("r_id")), F.col("r_tr"))
    archive = F.when(has_id, F.col("a_id")).otherwise(F.col("a_tr"))
    return t.withColumn("raw", F.coalesce(cache, archive)).withColumn(
        "raw_from", F.when(cache.isNotNull(), "cache").when(archive.isNotNull(), "archive")
    ).drop("r_id", "r_tr", "a_id", "a_tr")


def reclassify(attached: DataFrame, scorer, candidate: str = "") -> DataFrame:
    """Rules, then the scorer for undecided rows with signal. Adds ``route``, ``new_source`` and ``new``.

    The scorer gets whole requests, one a message; what it says is stored before it is read (a table of
    answers is joined instead)."""
    r = attached.filter(F.col("raw").isNotNull())
    for c in ["subject", "body", "sender_name", "sender_domain", "links"]:
        r = r.withColumn(f"m_{c}", F.col("raw")[c])
    subj, body = "m_subject", "m_body"
    cat = F.col("rule_cat")
    r = r.withColumn("rule_cat", T.rule_category(subj, body))
    r = r.withColumn("needs", cat.isNull() & T.has_signal(subj, body))
    r = r.withColumn("rule_company", F.when(cat.isNotNull(), T.extract_company(subj, body, "m_sender_name", "m_sender_domain")))
    r = r.withColumn("rule_role", F.when(cat.isNotNull(), T.extract_role(subj)))
    table = hasattr(scorer, "answers")
    if not table:
        r = cut_lineage(r)  # read twice below
    rule = F.when(
        cat.isNotNull(),
        F.struct(
            F.lit(True).alias("is_relevant"),
            F.col("rule_company").alias("company"),
            F.col("rule_role").alias("role"),
            cat.alias("category"),
            F.when(cat == "Rejection", "Rejected").otherwise("Applied").alias("step"),
            F.lit(None).cast("string").alias("interview_datetime"),
            T.blank(subj).alias("summary"),
            F.lit("").alias("apply_url"),
            F.lit("").alias("interviewer_name"),
        ),
    )
    if table:
        scored = scorer.answers().select("request_id", S.normalize_response("json").alias("analysis"))
    else:
        requests = S.build_requests(r.filter("needs").select("raw.*").dropDuplicates(["message_id"]))
        scored = cut_lineage(S.score(requests, scorer))
    scored = scored.withColumnRenamed("request_id", "_rid")
    r = r.join(scored, F.col("raw")["message_id"] == F.col("_rid"), "left").drop("_rid")
    text = T.mail_text(subj, body)
    guarded = S.strip_self(S.guard_offer(F.when(F.col("needs"), F.col("analysis")), text), candidate)
    return r.select(
        *attached.columns,
        F.when(cat.isNotNull(), "rule").when(~F.col("needs"), "no_signal")
        .when(F.col("analysis").isNull(), "failed").otherwise("scored").alias("route"),
        F.when(cat.isNotNull(), "rule").otherwise("ai").alias("new_source"),
        F.coalesce(rule, guarded).alias("new"),
    )


def diff_reclassified(classified: DataFrame) -> DataFrame:
    """ML-02 (+ §2.13-D protections): long-form changes (seq, company, role,
    field, old_value, new_value) for step / category / interviewDateTime /
    status."""
    a = F.col("new")
    c = classified.filter(F.col("route").isin("rule", "scored") & a["is_relevant"])
    guard = (F.col("new_source") == "rule") & (a["category"] == "Applied") & ~T.blank("category").isin("Applied", "Other", "")
    c = c.filter(~guard)
    new_interview = F.when(
        (F.col("new_source") == "rule") & a["interview_datetime"].isNull(), T.blank("interview_datetime")
    ).otherwise(T.blank(a["interview_datetime"]))
    c = c.withColumn("n_step", a["step"]).withColumn("n_cat", a["category"]).withColumn("n_iv", new_interview)
    changed = (F.col("n_step") != F.col("step")) | (F.col("n_cat") != F.col("category")) | (F.col("n_iv") != F.col("interview_datetime"))
    c = c.filter(changed)

    def ch(field: str, old: Column, new: Column, cond: Column) -> Column:
        return F.when(cond, F.struct(F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value")))

    items = F.array(
        ch("step", F.col("step"), F.col("n_step"), F.col("n_step") != F.col("step")),
        ch("category", F.col("category"), F.col("n_cat"), F.col("n_cat") != F.col("category")),
        ch("interviewDateTime", F.col("interview_datetime"), F.col("n_iv"), F.col("n_iv") != F.col("interview_datetime")),
        ch("status", F.col("status"), F.col("n_step"), (F.col("status") == F.col("step")) & (F.col("n_step") != F.col("status"))),
    )
    return c.select("seq", "company", "role", F.inline(F.filter(items, lambda x: x.isNotNull())))


def apply_reclassified(tracker: DataFrame, changes: DataFrame, dry_run: bool = True) -> DataFrame:
    """ML-03: apply the diff (status only where it still mirrored the old step);
    a dry run returns the tracker unchanged."""
    if dry_run:
        return tracker
    col_of = {"step": "step", "category": "category", "interviewDateTime": "interview_datetime", "status": "status"}
    patch = changes.groupBy("seq").pivot("field", list(col_of)).agg(F.first("new_value"))
    patch = patch.select("seq", *[F.col(f).alias(c) for f, c in col_of.items()])
    return apply_patch(tracker, patch, "seq", list(col_of.values()))


def recovered_raw(attached: DataFrame) -> DataFrame:
    """Raw rows found in the archive, one a message: what a pass appends to the cache, dry run or not."""
    return attached.filter(F.col("raw_from") == "archive").select("raw.*").dropDuplicates(["message_id"])


def reprocess_metrics(attached: DataFrame, classified: DataFrame) -> DataFrame:
    """AG-09: one row of counters of a pass."""
    seen = attached.agg(
        F.count("*").alias("rows_examined"),
        F.count_if(F.col("raw").isNull()).alias("skipped_no_raw"),
        F.count_distinct(F.when(F.col("raw_from") == "archive", F.col("raw")["message_id"])).alias("backfilled_raw"),
    )
    done = classified.agg(
        F.count_if(F.col("route").isin("rule", "scored")).alias("reclassified"),
        F.count_if(F.col("route").isin("scored", "failed")).alias("ai_calls"),
        F.count_if(F.col("route") == "failed").alias("failed"),
    )
    return seen.crossJoin(F.broadcast(done))  # one row each


def reprocess(tracker: DataFrame, raw: DataFrame, messages: DataFrame, scorer, candidate: str = "") -> dict:
    """PL-03: raw resolve → classify → protect → diff. Returns the diff, the raw
    rows recovered from the archive (appended to raw even on a dry run, Q6), the
    unrecoverable rows and the counters."""
    attached = attach_raw(tracker, read_raw(raw), messages)
    classified = reclassify(attached, scorer, candidate)
    return {
        "changes": diff_reclassified(classified),
        "recovered": recovered_raw(attached),
        "unrecoverable": attached.filter(F.col("raw").isNull()).select("seq"),
        "classified": classified,
        "metrics": reprocess_metrics(attached, classified),
    }
