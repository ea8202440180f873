"""Serving view over positions: tabs, search, counts, exports (FLT-09/10/13,
AG-10, FN-18..21, SO-02 via ``positions.order_positions``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions import patterns as P
from trackwise.functions import text as T
from trackwise.functions import timefn as TF

TABS = ["Active", "Needs attention", "Rejected", "All"]


def tab_condition(tab: str) -> Column:
    """FLT-09."""
    if tab == "Active":
        return ~T.is_terminal("category", "status")
    if tab == "Needs attention":
        return F.col("stale") | (T.norm("category") == "invitation")
    if tab == "Rejected":
        return (T.norm("category") == "rejection") | (T.norm("status") == "rejected")
    return F.lit(True)


def filter_positions(pos: DataFrame, tab: str) -> DataFrame:
    return pos.filter(tab_condition(tab))


def search_positions(pos: DataFrame, q: str) -> DataFrame:
    """FLT-10: case-insensitive substring on company or role; '' passes all."""
    qn = q.strip().lower()
    if not qn:
        return pos
    return pos.filter(T.norm("company").contains(qn) | T.norm("role").contains(qn))


def tab_counts(pos: DataFrame) -> DataFrame:
    """AG-10: the four (overlapping) tab counts in one pass."""
    return pos.agg(
        *[F.count_if(tab_condition(t)).alias(t.lower().replace(" ", "_")) for t in TABS]
    )


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _compact(w: Column) -> Column:
    return F.date_format(w, "yyyyMMdd'T'HHmm'00'")


def form_encode(c: Column) -> Column:
    """application/x-www-form-urlencoded (space → '+')."""
    return F.url_encode(c)


def component_encode(c: Column) -> Column:
    """encodeURIComponent style: %20 for space, ! ' ( ) ~ * left as is."""
    e = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for enc, ch in [("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")]:
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e


def calendar_feed(pos: DataFrame, tz: str = fixed.DISPLAY_TZ) -> DataFrame:
    """FN-18: one calendar row per position with a parsable shown interview:
    start, start + 1 h (day rollover included), title, zone, details, URL."""
    w = TF.wall_clock("next_interview")
    title = F.concat(
        F.when(T.is_real_role("role"), F.concat(F.col("role"), F.lit(" @ "))).otherwise(F.lit("Interview @ ")),
        F.col("company"),
    )
    # the start keeps the numerals as they were written; the end is a time, so it rolls over
    part = [F.regexp_extract(T.jtrim("next_interview"), TF.WALL_RE, i) for i in range(1, 6)]
    start = F.concat(*part[:3], F.lit("T"), *part[3:], F.lit("00"))
    end = _compact(w + F.expr("INTERVAL 1 HOUR"))
    dates = F.concat(start, F.lit("/"), end)
    details = F.when(F.col("link") != "", F.concat(F.lit("Link: "), F.col("link")))
    url = F.concat(
        F.lit(fixed.CALENDAR_BASE + "action=TEMPLATE&text="),
        form_encode(title),
        F.lit("&dates="),
        form_encode(dates),
        F.lit("&ctz=" ),
        form_encode(F.lit(tz)),
        F.coalesce(F.concat(F.lit("&details="), form_encode(details)), F.lit("")),
    )
    return pos.filter(w.isNotNull()).select(
        "key",
        start.alias("start"),
        end.alias("end"),
        title.alias("title"),
        F.lit(tz).alias("ctz"),
        F.coalesce(details, F.lit("")).alias("details"),
        url.alias("url"),
    )


def company_domain(link: str | Column = "link") -> Column:
    """FN-19: host of the link without 'www.', null for recruiting/scheduler/search
    hosts or unparsable links."""
    host = F.lower(F.try_parse_url(T.blank(link), F.lit("HOST")))
    host = F.regexp_replace(host, "^www\\.", "")
    return F.when((host != "") & ~host.rlike(P.NON_COMPANY_HOST), host)


def outbound_links(pos: DataFrame) -> DataFrame:
    """FN-20: company link (job link, else a careers search), people search for a
    named interviewer, and the avatar letter."""
    search = F.concat(F.lit(fixed.SEARCH_BASE), component_encode(F.concat(F.col("company"), F.lit(" careers"))))
    people_kw = F.concat_ws(" ", T.nonblank(F.col("interviewer")), T.nonblank(F.col("company")))
    people = F.when(
        F.col("interviewer") != "", F.concat(F.lit(fixed.PEOPLE_SEARCH_BASE), component_encode(people_kw))
    )
    letter = F.upper(F.substring(T.jtrim("company"), 1, 1))
    return pos.select(
        "key",
        F.when(F.col("link") != "", F.col("link")).otherwise(search).alias("company_href"),
        (T.is_known_company("company") | (F.col("link") != "")).alias("company_linked"),
        F.coalesce(people, F.lit("")).alias("people_search"),
        F.when(letter == "", F.lit("?")).otherwise(letter).alias("letter"),
        F.coalesce(company_domain("link"), F.lit("")).alias("logo_domain"),
    )


_WALL_RE = TF.WALL_RE


def format_interview(c: str | Column) -> Column:
    """'—' for blank, the raw text when unparsable, else 'Mon d, yyyy, h:mm AM'."""
    s = T.jtrim(c)
    raw = T.blank(c)
    part = lambda i: F.regexp_extract(s, _WALL_RE, i).cast("int")
    y, mo, d, h, mi = (part(i) for i in range(1, 6))
    month = F.coalesce(F.get(F.array(*[F.lit(m) for m in fixed.MONTHS]), mo - 1), F.lit("undefined"))
    h12 = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    text = F.concat(
        month, F.lit(" "), d.cast("string"), F.lit(", "), y.cast("string"), F.lit(", "),
        h12.cast("string"), F.lit(":"), _two(mi), F.lit(" "), F.when(h >= 12, "PM").otherwise("AM"),
    )
    return F.when(raw == "", F.lit("—")).when(~s.rlike(_WALL_RE), raw).otherwise(text)


def format_day(c: str | Column, tz: str = fixed.DISPLAY_TZ) -> Column:
    """Medium date in ``tz`` ('Jan 5, 2024'); '—' for blank, raw when unparsable."""
    t = TF.instant(c)
    return (
        F.when(T.blank(c) == "", F.lit("—"))
        .when(t.isNull(), T.blank(c))
        .otherwise(F.date_format(F.from_utc_timestamp(t, tz), "MMM d, yyyy"))
    )


def format_positions(pos: DataFrame, tz: str = fixed.DISPLAY_TZ) -> DataFrame:
    """FN-21."""
    return pos.select(
        "key",
        format_interview("next_interview").alias("interview_label"),
        format_day("last_update", tz).alias("last_update_label"),
    )
