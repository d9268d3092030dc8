"""Times of a service day, as integers and instants.

A service day's seconds count from its anchor, local noon less twelve hours, and may pass 86400.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_HOURS = 72


def gtfs_seconds(text: Column) -> Column:
    """``H:MM:SS`` (one to three digits of hours, 72 at most) as seconds; anything else is null."""
    t = F.trim(text)
    part = [F.try_to_number(F.nullif(F.regexp_extract(t, r"^([0-9]{1,3}):([0-9]{2}):([0-9]{2})$", k), F.lit("")), F.lit("999")).cast("int") for k in (1, 2, 3)]
    ok = t.rlike(r"^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$") & (part[0] <= MAX_HOURS) & (part[1] < 60) & (part[2] < 60)
    return F.when(ok, part[0] * 3600 + part[1] * 60 + part[2])


def gtfs_date(text: Column) -> Column:
    """``YYYYMMDD`` as a date; anything else is null."""
    t = F.trim(text)
    return F.when(t.rlike(r"^[0-9]{8}$"), F.try_to_date(t, "yyyyMMdd"))


def anchor_epoch(day: Column, zone: str = "Europe/Paris") -> Column:
    """Epoch second of a date's service-day anchor. The session's zone has to be UTC."""
    noon = F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 12 hours"), zone)
    return F.unix_timestamp(noon) - 43200


def service_date(at: Column, zone: str = "Europe/Paris") -> Column:
    """Local date of an instant (timestamp)."""
    return F.to_date(F.from_utc_timestamp(at, zone))


def weekday_bit(day: Column) -> Column:
    """Bit of the weekday in a service's ``days`` mask, Monday lowest."""
    return F.call_function("shiftleft", F.lit(1), F.weekday(day))


def clock(seconds: Column) -> Column:
    """Seconds since the anchor as ``HH:MM:SS``, hours past 23 kept."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.concat_ws(":", *(F.lpad(x.cast("string"), 2, "0") for x in (h, m, s)))
