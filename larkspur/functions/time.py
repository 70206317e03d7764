"""Clocks and calendars. now is always given, never read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def local_midnight(now: Column, zone: str = "Asia/Karachi") -> Column:
    return F.to_utc_timestamp(F.date_trunc("DAY", F.from_utc_timestamp(now, zone)), zone)


def minutes(hhmm: Column) -> Column:
    """Minutes after midnight of HH:MM, null of anything else."""
    ok = hhmm.rlike(r"^\d{1,2}:\d{2}$")
    return F.when(ok, F.split(hhmm, ":")[0].cast("int") * 60 + F.split(hhmm, ":")[1].cast("int"))


def expired(expires: Column, now: Column) -> Column:
    return F.coalesce(expires < now, F.lit(False))


def open_slots(now: Column, hours: Column, zone: str = "Asia/Karachi", days: int = 6, step: int = 30, ahead: int = 14) -> Column:
    """Local start times of meetings on the next open days, now's own included: every step minutes within hours, after now.

    hours: map of lower-cased weekday names to [open, close] as HH:MM; days without valid hours are closed.
    """
    local = F.from_utc_timestamp(now, zone)
    day0 = F.date_trunc("DAY", local)
    all_days = F.transform(F.sequence(F.lit(0), F.lit(ahead)), lambda i: F.timestamp_add("DAY", i, day0))

    def plan(d: Column) -> Column:
        h = F.try_element_at(hours, F.lower(F.date_format(d, "EEEE")))
        return F.struct(d.alias("d"), minutes(F.get(h, F.lit(0))).alias("a"), minutes(F.get(h, F.lit(1))).alias("b"))

    opened = F.slice(F.filter(F.transform(all_days, plan), lambda p: p["a"].isNotNull() & p["b"].isNotNull()), 1, days)
    starts = F.transform(opened, lambda p: F.transform(F.filter(F.sequence(p["a"], F.greatest(p["b"], p["a"]), F.lit(step)), lambda m: m < p["b"]), lambda m: F.timestamp_add("MINUTE", m, p["d"])))
    return F.filter(F.flatten(starts), lambda s: s > local)


def shown(at: Column, zone: str = "Asia/Karachi") -> Column:
    """A moment as people of a zone read it."""
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd HH:mm")
