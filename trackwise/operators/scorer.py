"""Scorer interface and response handling (UD-01, FN-11..13, FN-22, JN-10).

A scorer is any ``DataFrame(request_id, subject, body, ...) → DataFrame(request_id,
status, json)``. Two are provided:

* ``TableScorer`` — the responses already exist in a table (one row per request
  and model, with an HTTP status); failover between two models is a join.
* ``PandasScorer`` — wraps a Python function over pandas batches with
  ``mapInPandas`` (Arrow batches, declared schema). Only the rows that really
  need scoring reach it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import patterns as P
from trackwise.functions import text as T

ANALYSIS_FIELDS = [
    "is_relevant",
    "company",
    "role",
    "category",
    "step",
    "interview_datetime",
    "summary",
    "apply_url",
    "interviewer_name",
]


def _by_request(responses: DataFrame, primary: str, fallback: str) -> DataFrame:
    """(request_id, p, f): the answer that counts of either model. Of repeated answers an answered one (status 200) comes
    first, then the smallest status, then the smallest text, null last: the order says nothing, but keeps reruns equal."""
    status = F.col("http_status")
    best = F.struct(
        F.coalesce(status != 200, F.lit(True)).alias("unanswered"), status.alias("status"), F.col("json").isNull().alias("none"), "json"
    )
    of = lambda model: F.min(F.when(F.col("model") == model, best))
    known = responses.filter(F.col("model").isin(primary, fallback) & F.col("request_id").isNotNull())
    return known.groupBy("request_id").agg(of(primary).alias("p"), of(fallback).alias("f"))


def fallback_responses(
    requests: DataFrame, responses: DataFrame, primary: str = "primary", fallback: str = "fallback"
) -> DataFrame:
    """JN-10: the primary model's answer; on a retryable status (429/503) the
    fallback model's answer instead (when it is a different model); any other
    failure is final (json null). One row a request, however often it or its answers are repeated."""
    asked = requests.select("request_id").filter(F.col("request_id").isNotNull()).distinct()
    j = asked.join(_by_request(responses, primary, fallback), "request_id", "left")
    p_ok, f_ok = F.col("p.status") == 200, F.col("f.status") == 200
    retry = F.col("p.status").isin(*fixed.RETRYABLE_HTTP) & F.lit(primary != fallback)
    json = F.when(p_ok, F.col("p.json")).when(retry & f_ok, F.col("f.json"))
    model = F.when(p_ok, F.lit(primary)).when(retry & f_ok, F.lit(fallback))
    return j.select("request_id", model.alias("model"), json.alias("json"))


class TableScorer:
    """Scores by looking the request up in a responses table (default)."""

    def __init__(self, responses: DataFrame, primary: str = "primary", fallback: str = "fallback"):
        self.responses, self.primary, self.fallback = responses, primary, fallback

    def __call__(self, requests: DataFrame) -> DataFrame:
        return fallback_responses(requests, self.responses, self.primary, self.fallback).select("request_id", "json")

    def answers(self) -> DataFrame:
        """The answer to every request that the table has, so that a plan may join it instead of listing its requests."""
        asked = self.responses.filter(F.col("model") == self.primary).select("request_id")
        return fallback_responses(asked, self.responses, self.primary, self.fallback).select("request_id", "json")


class PandasScorer:
    """Wraps ``fn(pandas.DataFrame of requests) -> pandas.Series of JSON text``.

    Runs with ``mapInPandas`` over Arrow batches; ``partitions`` spreads the
    requests over that many tasks."""

    def __init__(self, fn: Callable[[pd.DataFrame], pd.Series], partitions: int | None = None):
        self.fn, self.partitions = fn, partitions

    def __call__(self, requests: DataFrame) -> DataFrame:
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pd.DataFrame({"request_id": pdf["request_id"], "json": fn(pdf).astype("string")})

        src = requests.repartition(self.partitions) if self.partitions else requests
        return src.mapInPandas(run, "request_id string, json string")


def build_requests(msgs: DataFrame) -> DataFrame:
    """FN-22: scorer request rows: the whole body, links, sender hints, date."""
    return msgs.select(
        F.col("message_id").alias("request_id"),
        T.blank("subject").alias("subject"),
        T.blank("body").alias("body"),
        F.col("received").alias("email_date"),
        T.blank("sender_name").alias("sender_name"),
        T.blank("sender_domain").alias("sender_domain"),
        F.array_join(F.coalesce(F.col("links"), F.array().cast("array<string>")), "\n").alias("links"),
    )


def _vtype(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def _vstr(v: Column, path: str) -> Column:
    """String field, null unless the JSON value is a string."""
    return F.when(_vtype(v, path) == "STRING", F.variant_get(v, path, "string"))


def normalize_response(json: str | Column = "json") -> Column:
    """FN-11: untyped scorer output → analysis struct, or null when the output is
    not an object or has no boolean relevance flag. Strings are trimmed; an
    invalid category becomes Other; missing step → the category's default; a
    URL must be http(s)."""
    v = F.try_parse_json(T.col(json))
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    flag_ok = F.coalesce(_vtype(v, "$.is_relevant") == "BOOLEAN", F.lit(False))
    cat_raw = _vstr(v, "$.category")
    category = F.when(cat_raw.isin(*fixed.CATEGORIES), cat_raw).otherwise(F.lit("Other"))
    default_step = F.coalesce(*[F.when(category == k, F.lit(s)) for k, s in fixed.DEFAULT_STEP.items()])

    def trimmed_or(path: str, default):
        s = T.jtrim(_vstr(v, path))
        return F.when(_vstr(v, path).isNotNull() & (s != ""), s).otherwise(default)

    url = T.jtrim(_vstr(v, "$.apply_url"))
    analysis = F.struct(
        F.variant_get(v, "$.is_relevant", "boolean").alias("is_relevant"),
        trimmed_or("$.company", F.lit("Unknown")).alias("company"),
        trimmed_or("$.role", F.lit("Unknown")).alias("role"),
        category.alias("category"),
        trimmed_or("$.step", default_step).alias("step"),
        trimmed_or("$.interview_datetime", F.lit(None).cast("string")).alias("interview_datetime"),
        F.coalesce(T.jtrim(_vstr(v, "$.summary")), F.lit("")).alias("summary"),
        F.when(_vstr(v, "$.apply_url").isNotNull() & url.rlike(P.HTTP_PREFIX), url).otherwise(F.lit("")).alias("apply_url"),
        F.coalesce(T.jtrim(_vstr(v, "$.interviewer_name")), F.lit("")).alias("interviewer_name"),
    )
    return F.when(is_obj & flag_ok, analysis)


def guard_offer(a: str | Column = "analysis", text: Column | None = None) -> Column:
    """FN-12: an 'Offer' that schedules an interview time and never talks
    compensation is an Invitation; a step mentioning 'offer' becomes Interview."""
    a = T.col(a)
    text = T.mail_text() if text is None else text
    hit = (a["category"] == "Offer") & (T.blank(a["interview_datetime"]) != "") & ~text.rlike(P.COMPENSATION)
    return F.when(
        a.isNotNull() & hit,
        a.withField("category", F.lit("Invitation")).withField(
            "step", F.when(a["step"].rlike(P.OFFER_WORD), F.lit("Interview")).otherwise(a["step"])
        ),
    ).otherwise(a)


def strip_self(a: str | Column = "analysis", candidate: str = "") -> Column:
    """FN-13: blank the interviewer when it is the candidate (any case)."""
    a = T.col(a)
    me = candidate.strip().lower()
    if not me:
        return a
    return F.when(
        a.isNotNull() & (T.norm(a["interviewer_name"]) == F.lit(me)), a.withField("interviewer_name", F.lit(""))
    ).otherwise(a)


def score(requests: DataFrame, scorer) -> DataFrame:
    """UD-01: run a scorer and normalise its answers → (request_id, analysis)."""
    return scorer(requests).select("request_id", normalize_response("json").alias("analysis"))
