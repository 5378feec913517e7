"""Business days and weeks in a named zone; instants are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Bucharest"


def day_start(day: Column, zone: str = ZONE) -> Column:
    """Instant at which the local ``day`` begins."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def in_days(day: Column, instant: Column, first: str, last: str, zone: str = ZONE) -> Column:
    """Whether the date, or where it is null the instant, lies in the local days ``first`` to ``last``.

    Filters stand on the bare columns, so that they reach the scan.
    """
    low, high = F.lit(first).cast("date"), F.lit(last).cast("date")
    return day.between(low, high) | (day.isNull() & (instant >= day_start(low, zone)) & (instant < day_start(F.date_add(high, 1), zone)))


def local_week(instant: Column, zone: str = ZONE) -> Column:
    """Monday of the local week."""
    return F.date_trunc("week", F.from_utc_timestamp(instant, zone)).cast("date")


def preset_days(preset: str, now: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """First and last local day of ``today``, ``week`` (from Monday) or ``month``; nulls for any other name."""
    today = F.from_utc_timestamp(now, zone).cast("date")
    if preset == "today":
        return today, today
    if preset == "week":
        first = F.date_trunc("week", today.cast("timestamp")).cast("date")
        return first, F.date_add(first, 6)
    if preset == "month":
        return F.trunc(today, "month"), F.last_day(today)
    none = F.lit(None).cast("date")
    return none, none
