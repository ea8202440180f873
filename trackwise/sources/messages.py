"""Message assembly from header, part and page tables (SRC-02, FN-03, FN-04, SO-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import patterns as P
from trackwise.functions import text as T

HREF = r"(?i)href\s*=\s*[\"']([^\"']+)[\"']"
URL = r"(?i)(https?://[^\s<>\"')]+)"


def assemble_messages(
    headers: DataFrame, meta: DataFrame, marker: str = fixed.SELF_MARKER_HEADER, marker_value: str = fixed.SELF_MARKER_VALUE
) -> DataFrame:
    """SRC-02: message_id, thread_id, subject, from_header, received, is_self. The time is the internal one, else the Date header's,
    else blank (undated: this never asks the clock)."""
    has = lambda n: F.lower("name") == n
    first = headers.groupBy("message_id").agg(
        *[F.min_by(F.when(has(n), F.col("value")), F.when(has(n), F.col("pos"))).alias(a)
          for n, a in (("subject", "subject"), ("from", "from_header"), ("date", "date"), (marker.lower(), "mark"))]
    )
    m = meta.join(first, "message_id", "left")
    at = F.coalesce(F.timestamp_millis("internal_ms"), F.try_to_timestamp(T.blank("date")))
    iso = F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return m.select(
        "message_id",
        "thread_id",
        F.coalesce("subject", F.lit(fixed.NO_SUBJECT)).alias("subject"),
        T.blank("from_header").alias("from_header"),
        F.coalesce(iso, F.lit("")).alias("received"),
        F.coalesce(F.col("mark") == marker_value, F.lit(False)).alias("is_self"),
    )


def decoded(data: str | Column = "data") -> Column:
    """Text of URL-safe base64."""
    return F.decode(F.unbase64(F.translate(T.blank(data), "-_", "+/")), "UTF-8")


def select_body(parts: DataFrame) -> DataFrame:
    """FN-03: (message_id, body): the first text/plain part with text in depth-first order, else the top part."""
    text = decoded()
    plain = (F.col("mime") == "text/plain") & (text != "")
    picked = parts.groupBy("message_id").agg(
        F.min_by(F.when(plain, text), F.when(plain, F.col("path"))).alias("plain"), F.min_by(text, "path").alias("top")
    )
    return picked.select("message_id", F.coalesce("plain", "top", F.lit("")).alias("body"))


def harvest_links(html: Column | None = None, text: Column | None = None) -> Column:
    """FN-04 + SO-05: links of an HTML and a plain text, cleaned, without noise, in order of first appearance, all of them."""
    found = []
    if html is not None:
        found.append(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)))
    if text is not None:
        found.append(F.regexp_extract_all(text, F.lit(URL), F.lit(1)))
    trailing = "[" + "".join("\\" + c for c in fixed.LINK_TRAILING_CHARS) + "]+\\z"
    clean = F.transform(F.flatten(F.array(*found)), lambda u: F.regexp_replace(T.jtrim(u), trailing, ""))
    return F.array_distinct(F.filter(clean, lambda u: u.rlike("(?i)^https?://") & ~u.rlike(P.JUNK_LINK)))
