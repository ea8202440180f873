"""Serving-view queries over positions (FLT-09/10/13, AG-10, FN-18..21, PL-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.checks import duck as D
from trackwise.checks import oracles as O
from trackwise.checks.duck_adapters import with_views
from trackwise.checks.registry import _positions, register
from trackwise.functions import patterns as P
from trackwise.operators import view as V
from trackwise.plans.view import build_view
from trackwise.sources import adapters as A

TZ = fixed.DISPLAY_TZ


def _pos_sql(select: str, where: str = "TRUE") -> str:
    return with_views("tracker", extra=O.positions_ctes()) + f"SELECT {select} FROM positions WHERE {where}"


_ACTIVE = f"NOT {D.is_terminal('category', 'status')}"
_ATTN = f"(stale OR {D.norm('category')} = 'invitation')"
_REJ = f"({D.norm('category')} = 'rejection' OR {D.norm('status')} = 'rejected')"


@register("view_tabs", _pos_sql(f"key, {_ACTIVE} AS in_active, {_ATTN} AS in_attention, {_REJ} AS in_rejected"))
def view_tabs(spark, sf_dir):
    """FLT-09: tab membership of every position."""
    pos = _positions(spark, sf_dir, ordered=False)
    return pos.select(
        "key",
        V.tab_condition("Active").alias("in_active"),
        V.tab_condition("Needs attention").alias("in_attention"),
        V.tab_condition("Rejected").alias("in_rejected"),
    )


@register(
    "tab_counts",
    _pos_sql(
        f"count(*) FILTER (WHERE {_ACTIVE}) AS active, count(*) FILTER (WHERE {_ATTN}) AS needs_attention, "
        f"count(*) FILTER (WHERE {_REJ}) AS rejected, count(*) AS all"
    ),
)
def tab_counts(spark, sf_dir):
    """AG-10."""
    return V.tab_counts(_positions(spark, sf_dir, ordered=False))


SEARCH_Q = "data"


@register(
    "search_positions",
    _pos_sql("key, company, role", f"strpos({D.norm('company')}, '{SEARCH_Q}') > 0 OR strpos({D.norm('role')}, '{SEARCH_Q}') > 0"),
)
def search_positions(spark, sf_dir):
    """FLT-10."""
    return V.search_positions(_positions(spark, sf_dir, ordered=False), SEARCH_Q).select("key", "company", "role")


@register(
    "view_active_search",
    _pos_sql("key, company, role, status", f"{_ACTIVE} AND (strpos({D.norm('company')}, 'a') > 0 OR strpos({D.norm('role')}, 'a') > 0)"),
)
def view_active_search(spark, sf_dir):
    """PL-06: tab → search → sort over PL-04 (order checked in unit tests)."""
    view, _counts = build_view(A.tracker(spark, sf_dir), A.TRACKER_AS_OF, tab="Active", q="a", sort="company")
    return view.select("key", "company", "role", "status")


def _form(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def _component(x: str) -> str:
    e = f"url_encode({x})"
    for enc, ch in [("%2A", "*"), ("%21", "!"), ("%27", "''"), ("%28", "("), ("%29", ")")]:
        e = f"replace({e}, '{enc}', '{ch}')"
    return e


def _calendar_sql() -> str:
    wc = D.wall_clock("next_interview")
    title = f"(CASE WHEN {D.is_real_role('role')} THEN role || ' @ ' ELSE 'Interview @ ' END || company)"
    start = f"strftime({wc}, '%Y%m%dT%H%M00')"
    end = f"strftime({wc} + INTERVAL 1 HOUR, '%Y%m%dT%H%M00')"
    dates = f"({start} || '/' || {end})"
    details = "(CASE WHEN link <> '' THEN 'Link: ' || link END)"
    url = (
        f"'{fixed.CALENDAR_BASE}action=TEMPLATE&text=' || {_form(title)} || '&dates=' || {_form(dates)} || "
        f"'&ctz=' || {_form(D.q(TZ))} || coalesce('&details=' || {_form(details)}, '')"
    )
    return _pos_sql(
        f"key, {start} AS start, {end} AS \"end\", {title} AS title, {D.q(TZ)} AS ctz, coalesce({details}, '') AS details, {url} AS url",
        f"{wc} IS NOT NULL",
    )


@register("calendar_feed", _calendar_sql())
def calendar_feed(spark, sf_dir):
    """FN-18."""
    return V.calendar_feed(_positions(spark, sf_dir, ordered=False), TZ)


def _outbound_sql() -> str:
    search_kw = "company || ' careers'"
    search = f"'{fixed.SEARCH_BASE}' || {_component(search_kw)}"
    kw = "concat_ws(' ', nullif(interviewer, ''), nullif(company, ''))"
    people = f"CASE WHEN interviewer <> '' THEN '{fixed.PEOPLE_SEARCH_BASE}' || {_component(kw)} ELSE '' END"
    letter = f"upper(substr({D.jtrim('company')}, 1, 1))"
    host = "lower(regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
    host = f"regexp_replace({host}, '^www\\.', '')"
    domain = f"CASE WHEN {host} <> '' AND NOT {D.rlike(host, P.NON_COMPANY_HOST)} THEN {host} ELSE '' END"
    return _pos_sql(
        f"key, CASE WHEN link <> '' THEN link ELSE {search} END AS company_href, "
        f"({D.is_known_company('company')} OR link <> '') AS company_linked, {people} AS people_search, "
        f"CASE WHEN {letter} = '' THEN '?' ELSE {letter} END AS letter, {domain} AS logo_domain"
    )


@register("outbound_links", _outbound_sql())
def outbound_links(spark, sf_dir):
    """FN-19, FN-20."""
    return V.outbound_links(_positions(spark, sf_dir, ordered=False))


def _format_sql() -> str:
    s = D.jtrim("next_interview")
    part = lambda i: f"CAST({D.extract(s, D.WALL_RE, i)} AS INTEGER)"
    months = "[" + ", ".join(D.q(m) for m in fixed.MONTHS) + "]"
    h = part(4)
    text = (
        f"coalesce(list_extract({months}, {part(2)}), 'undefined') || ' ' || CAST({part(3)} AS VARCHAR) || ', ' || "
        f"CAST({part(1)} AS VARCHAR) || ', ' || CAST(CASE WHEN {h} % 12 = 0 THEN 12 ELSE {h} % 12 END AS VARCHAR) || ':' || "
        f"lpad(CAST({part(5)} AS VARCHAR), 2, '0') || ' ' || CASE WHEN {h} >= 12 THEN 'PM' ELSE 'AM' END"
    )
    label = f"CASE WHEN next_interview = '' THEN '—' WHEN NOT {D.rlike(s, D.WALL_RE)} THEN next_interview ELSE {text} END"
    t = "TRY_CAST(last_update AS TIMESTAMPTZ)"
    day = f"CASE WHEN last_update = '' THEN '—' WHEN {t} IS NULL THEN last_update ELSE strftime({t} AT TIME ZONE {D.q(TZ)}, '%b %-d, %Y') END"
    return _pos_sql(f"key, {label} AS interview_label, {day} AS last_update_label")


@register("format_positions", _format_sql())
def format_positions(spark, sf_dir):
    """FN-21."""
    return V.format_positions(_positions(spark, sf_dir, ordered=False), TZ)
