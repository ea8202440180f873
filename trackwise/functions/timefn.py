"""Time expressions. ``as_of`` and ``tz`` are always arguments, never the clock."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackwise import fixed
from trackwise.functions.text import blank, jtrim

WALL_RE = r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}):(\d{2})"


def parse_as_of(as_of: str | dt.datetime) -> dt.datetime:
    """An instant (aware datetime, UTC) from an ISO string or datetime."""
    if isinstance(as_of, str):
        as_of = dt.datetime.fromisoformat(as_of.replace("Z", "+00:00"))
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=dt.timezone.utc)
    return as_of.astimezone(dt.timezone.utc)


def wall_now(as_of, tz: str = fixed.DISPLAY_TZ) -> dt.datetime:
    """FN-15: 'now' as a wall-clock in ``tz``, truncated to the minute (naive)."""
    local = parse_as_of(as_of).astimezone(ZoneInfo(tz))
    return local.replace(second=0, microsecond=0, tzinfo=None)


def wall_now_lit(as_of, tz: str = fixed.DISPLAY_TZ) -> Column:
    return F.lit(wall_now(as_of, tz)).cast("timestamp_ntz")


def wall_clock(c: str | Column) -> Column:
    """FN-14: 'YYYY-MM-DD[T ]HH:MM' prefix as TIMESTAMP_NTZ; any zone tag is
    ignored; no range check (a 25th hour rolls into the next day)."""
    s = jtrim(c)
    ok = s.rlike(WALL_RE)
    y = F.regexp_extract(s, WALL_RE, 1).cast("int")
    mo = F.regexp_extract(s, WALL_RE, 2).cast("int")
    d = F.regexp_extract(s, WALL_RE, 3).cast("int")
    h = F.regexp_extract(s, WALL_RE, 4).cast("int")
    mi = F.regexp_extract(s, WALL_RE, 5).cast("int")
    base = F.add_months(F.make_date(y, F.lit(1), F.lit(1)), mo - 1).cast("timestamp_ntz")
    return F.when(ok, base + F.make_dt_interval(d - 1, h, mi, F.lit(0)))


def instant(c: str | Column) -> Column:
    """ISO instant text → TIMESTAMP, null when unparsable."""
    return F.try_to_timestamp(blank(c))


def days_since(c: str | Column, as_of) -> Column:
    """FN-16: age in days at ``as_of``; unparsable → 0."""
    t = instant(c)
    now_us = int(parse_as_of(as_of).timestamp() * 1_000_000)
    return F.coalesce((F.lit(now_us) - F.unix_micros(t)) / F.lit(86_400_000_000.0), F.lit(0.0))


def is_stale(last_update: str | Column, terminal: Column, as_of) -> Column:
    return ~terminal & (days_since(last_update, as_of) > fixed.STALE_DAYS)
