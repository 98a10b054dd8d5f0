"""Fixed-offset local time, time-of-day bins and the day/night rules.

Stored time is UTC. "Local" means a fixed shift without daylight saving. Result
columns year/month/day stay UTC, clear-sky days are local; both are intended.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCAL_MINUTES = 600


def local_time(t: Column, minutes: int = LOCAL_MINUTES) -> Column:
    return F.timestamp_add("MINUTE", F.lit(minutes), t)


def local_day(t: Column, minutes: int = LOCAL_MINUTES) -> Column:
    return F.to_date(local_time(t, minutes))


def tod_bin(t: Column, minutes: int = 5, offset: int = LOCAL_MINUTES) -> Column:
    """Local time of day in minutes, rounded down to a multiple of ``minutes``."""
    lt = local_time(t, offset)
    minute = F.minute(lt)
    return (F.hour(lt) * 60 + minute - minute % minutes).cast("int")


def dated_bin(t: Column, minutes: int = 30, offset: int = LOCAL_MINUTES) -> Column:
    """Like :func:`tod_bin` but keeping the date, as a time stamp."""
    lt = local_time(t, offset)
    return F.timestamp_add("MINUTE", -(F.minute(lt) % minutes), F.date_trunc("minute", lt))


def day_night(t: Column, rule: str = "utc_20_7") -> Column:
    """'day' or 'night' under one of three rules.

    utc_20_7    UTC hour >= 20 or <= 7 (default)
    local_8_16  local hour 8 to 16
    local_9_16  local hour 9 to 16
    """
    if rule == "utc_20_7":
        is_day = (F.hour(t) >= 20) | (F.hour(t) <= 7)
    elif rule == "local_8_16":
        is_day = F.hour(local_time(t)).between(8, 16)
    elif rule == "local_9_16":
        is_day = F.hour(local_time(t)).between(9, 16)
    else:
        raise ValueError(f"unknown day/night rule {rule!r}")
    return F.when(is_day, "day").otherwise("night")


def calendar(t: Column) -> dict[str, Column]:
    """UTC year, month and day columns of a time stamp."""
    return {
        "year": F.year(t).cast("bigint"),
        "month": F.month(t).cast("bigint"),
        "day": F.dayofmonth(t).cast("bigint"),
    }
