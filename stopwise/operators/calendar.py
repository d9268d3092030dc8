"""Which services run on which dates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timeutil import anchor_epoch, weekday_bit


def _regular(services: DataFrame, day: Column) -> DataFrame:
    return services.where(day.between(F.col("start_date"), F.col("end_date")) & (F.col("days").bitwiseAND(weekday_bit(day)) != 0))


def active_services(services: DataFrame, exceptions: DataFrame, day: dt.date) -> DataFrame:
    """(service_id): removed beats added beats regular."""
    at = F.lit(day)
    on = exceptions.where((F.col("date") == at) & (F.col("exception_type") == 1)).select("service_id")
    off = exceptions.where((F.col("date") == at) & (F.col("exception_type") == 2)).select("service_id")
    return _regular(services, at).select("service_id").union(on).distinct().join(off, "service_id", "left_anti")


def services_in_range(services: DataFrame, exceptions: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """(service_id, date) for each date from ``first`` to ``last`` on which the service runs."""
    low, high = F.greatest("start_date", F.lit(first)), F.least("end_date", F.lit(last))
    days = services.where(low <= high).withColumn("date", F.explode(F.sequence(low, high)))
    regular = days.where(F.col("days").bitwiseAND(weekday_bit(F.col("date"))) != 0).select("service_id", "date")
    within = exceptions.where(F.col("date").between(F.lit(first), F.lit(last)))
    on = within.where("exception_type = 1").select("service_id", "date")
    off = within.where("exception_type = 2").select("service_id", "date")
    return regular.union(on).distinct().join(off, ["service_id", "date"], "left_anti")


def service_passes(queries: DataFrame, latest_s: int, zone: str = "Europe/Paris", look_back_s: int = 0) -> DataFrame:
    """(query_id, service_date, since_s) for (query_id, epoch_s): today, and the day before while its late trips may still run."""
    local = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("epoch_s"), zone))
    both = queries.withColumn("service_date", F.explode(F.array(local, F.date_sub(local, 1)))).withColumn("today", F.col("service_date") == local)
    both = both.withColumn("since_s", F.col("epoch_s") - anchor_epoch(F.col("service_date"), zone))
    return both.where(F.col("today") | (F.col("since_s") - look_back_s <= latest_s)).select("query_id", "service_date", "since_s")
