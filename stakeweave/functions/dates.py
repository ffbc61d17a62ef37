"""Dates as ISO strings, which may be partial, and time-based decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_prefix(stamp: Column) -> Column:
    return F.when(F.length(stamp) >= 10, F.substring(stamp, 1, 10))


def day_first_to_iso(text: Column) -> Column:
    """DD/MM/YYYY as YYYY-MM-DD without calendar checks."""
    parts = F.split(F.trim(F.coalesce(text, F.lit(""))), "/")
    part = lambda k: F.get(parts, F.lit(k))
    pad = lambda x: F.when(F.length(x) < 2, F.lpad(x, 2, "0")).otherwise(x)
    whole = (F.size(parts) == 3) & F.forall(parts, lambda x: x != "")
    return F.when(whole, F.concat_ws("-", part(2), pad(part(1)), pad(part(0))))


def founded_year(date: Column) -> Column:
    return F.regexp_extract(date, "^([0-9]{4})", 1).try_cast("int")


def full_date(date: Column) -> Column:
    return F.when(date.rlike("^.{4}-.{2}-"), F.when(F.length(date) >= 10, F.substring(date, 1, 10)))


def partial_birth_date(year: Column, month: Column) -> Column:
    """YYYY-MM, YYYY, or an empty string."""
    y = F.lpad(year.cast("string"), 4, "0")
    known_year, known_month = F.coalesce(year, F.lit(0)) != 0, F.coalesce(month, F.lit(0)) != 0
    return F.when(known_year & known_month, F.concat_ws("-", y, F.lpad(month.cast("string"), 2, "0"))).when(known_year, y).otherwise("")


def relationship_dates(periods: Column) -> Column:
    """``struct(since, until)`` of the first relationship period of an array of periods."""
    wanted = F.get(F.filter(periods, lambda p: p["PeriodType"]["$"] == "RELATIONSHIP_PERIOD"), F.lit(0))
    return F.struct(iso_prefix(F.trim(wanted["StartDate"]["$"])).alias("since"), iso_prefix(F.trim(wanted["EndDate"]["$"])).alias("until"))


# Delta windows and the gap in days that each covers.
WINDOWS = (("LastDay", 1.5), ("LastWeek", 6.5), ("LastMonth", 29.0))


def catchup_interval(last: Column, current: Column) -> Column:
    """The smallest window that covers the gap between two stamps; null means reload."""
    form = "yyyy-MM-dd HH:mm:ss"
    a, b = (F.try_to_timestamp(F.trim(x), F.lit(form)) for x in (last, current))
    gap = (F.unix_seconds(b) - F.unix_seconds(a)) / 86400.0
    out = F.when(a.isNull() | b.isNull(), "LastMonth")
    for name, days in WINDOWS:
        out = out.when(gap <= days, name)
    return out


def decide_scrape(entity_id: Column, on_demand: Column, last: Column, depth_done: Column, depth: Column, force: Column, now: Column,
                  ttl_days: int = 30, cooldown_hours: int = 24) -> Column:
    """Why a source run is due or not: cooldown, forced, absent, never_on_demand, stale, deepen, fresh."""
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))
    cooling = F.coalesce(age < cooldown_hours * 3600, F.lit(False)) & F.lit(cooldown_hours > 0)
    return (
        F.when(force & cooling, "cooldown").when(force, "forced").when(entity_id.isNull(), "absent")
        .when(~F.coalesce(on_demand, F.lit(False)), "never_on_demand")
        .when(last.isNull() | (age > ttl_days * 86400), "stale")
        .when(depth > F.coalesce(depth_done, F.lit(0)), "deepen").otherwise("fresh")
    )


def scrape_is_due(reason: Column) -> Column:
    return ~reason.isin("cooldown", "fresh")


def lock_is_stale(acquired: Column, now: Column, hours: float = 6) -> Column:
    return F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(acquired.cast("timestamp")) > hours * 3600
