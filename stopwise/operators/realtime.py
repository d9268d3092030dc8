"""Live updates over the timetable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MARGIN_CAP_S = 21_600


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in arrival order; aggregation before the shuffle, no window."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select(*keys, "x.*")


def apply_times(scheduled: Column, absolute: Column, other_absolute: Column, delay: Column, other_delay: Column, trip_delay: Column) -> Column:
    """Absolute time wins, then the other event's absolute time, then the schedule with the first delay known."""
    return F.coalesce(absolute, other_absolute, scheduled + F.coalesce(delay, other_delay, trip_delay, F.lit(0)))


def trip_delay(updates: DataFrame) -> DataFrame:
    """(trip_id, canceled, delay_s, margin_s, n_delays): what routing needs to know of a trip."""
    return updates.groupBy("trip_id").agg(
        F.bool_or("canceled").alias("canceled"), F.max_by("delay_s", F.when(F.col("delay_s").isNotNull(), F.struct("ts", "event_id"))).alias("delay_s"),
        F.least(F.max(F.abs("delay_s")), F.lit(MARGIN_CAP_S)).alias("margin_s"), F.count("delay_s").alias("n_delays"),
    )


def stop_updates(updates: DataFrame) -> DataFrame:
    """(trip_id, off, delay_s, skipped): the last word on each stop event."""
    rows = updates.where("not is_vehicle").groupBy("trip_id", "off")
    return rows.agg(F.max_by(F.struct("delay_s", "skipped"), F.struct("ts", "event_id")).alias("x")).select("trip_id", "off", "x.delay_s", "x.skipped")


def with_realtime(events: DataFrame, stops: DataFrame, trips: DataFrame) -> DataFrame:
    """Stop events with ``rt_departure_s``, ``rt_arrival_s``, ``skipped``, ``canceled``, ``has_rt``."""
    out = events.join(stops.withColumnRenamed("delay_s", "stop_delay"), ["trip_id", "off"], "left").join(trips.select("trip_id", "canceled", F.col("delay_s").alias("trip_delay")), "trip_id", "left")
    delay = F.coalesce("stop_delay", "trip_delay", F.lit(0))
    out = out.withColumn("rt_departure_s", F.col("departure_s") + delay).withColumn("rt_arrival_s", F.col("arrival_s") + delay)
    out = out.withColumn("has_rt", F.col("skipped").isNotNull() | F.col("trip_delay").isNotNull() | F.coalesce("canceled", F.lit(False)))
    return out.withColumn("skipped", F.coalesce("skipped", F.lit(False))).withColumn("canceled", F.coalesce("canceled", F.lit(False))).drop("stop_delay", "trip_delay")


def trip_status(trips: DataFrame) -> DataFrame:
    """CANCELLED before DELAYED or EARLY by the sign, then ON_TIME; PARTIAL where only a delay of nothing is known."""
    status = F.when(F.col("canceled"), "CANCELLED").when(F.col("delay_s") > 0, "DELAYED").when(F.col("delay_s") < 0, "EARLY").when(F.col("delay_s") == 0, "ON_TIME").otherwise("PARTIAL")
    return trips.select("trip_id", status.alias("status"))


def journey_status(canceled: Column, delayed: Column, alerted: Column, live: Column) -> Column:
    return F.when(canceled, "CANCELLED").when(delayed, "DELAYED").when(alerted, "DISRUPTED").when(live, "ON_TIME").otherwise("SCHEDULED")


def stats(updates: DataFrame, rollup: bool = False, group: str = "feed") -> DataFrame:
    """Counts by feed; with ``rollup`` a total as well, whose feed is null."""
    grouped = updates.rollup(group) if rollup else updates.groupBy(group)
    return grouped.agg(F.count("*").alias("n"), F.count_if("canceled").alias("n_canceled"), F.count_if("skipped").alias("n_skipped"), F.count_if("is_vehicle").alias("n_vehicles"), F.count("delay_s").alias("n_delays"), F.count_distinct("trip_id").alias("n_trips"))


def vehicle_estimate(events: DataFrame, now_s: int, stops: DataFrame) -> DataFrame:
    """(trip_id, off, state, fraction, lat, lon) of each trip that is under way at ``now_s``.

    At a stop between arrival and departure; between two stops on the straight line by elapsed time, INCOMING past 0.92.
    """
    w = W.partitionBy("trip_id").orderBy("off")
    rows = events.select("trip_id", "off", "stop_id", "rt_arrival_s", "rt_departure_s").withColumn("next_stop", F.lead("stop_id").over(w)).withColumn("next_arrival", F.lead("rt_arrival_s").over(w))
    at_stop = F.lit(now_s).between(F.col("rt_arrival_s"), F.col("rt_departure_s"))
    between = (F.lit(now_s) > F.col("rt_departure_s")) & (F.lit(now_s) < F.col("next_arrival"))
    rows = rows.where(at_stop | between)
    fraction = F.when(at_stop, 0.0).otherwise((now_s - F.col("rt_departure_s")) / F.greatest(F.col("next_arrival") - F.col("rt_departure_s"), F.lit(1)))
    rows = rows.withColumn("fraction", fraction).withColumn("state", F.when(at_stop, "STOPPED_AT").when(F.col("fraction") > 0.92, "INCOMING_AT").otherwise("UNDER_WAY"))
    here = stops.select("stop_id", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"))
    there = stops.select(F.col("stop_id").alias("next_stop"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = rows.join(here, "stop_id").join(there, "next_stop", "left")
    lat = F.col("lat1") + F.col("fraction") * (F.coalesce("lat2", "lat1") - F.col("lat1"))
    lon = F.col("lon1") + F.col("fraction") * (F.coalesce("lon2", "lon1") - F.col("lon1"))
    first = F.row_number().over(W.partitionBy("trip_id").orderBy("off"))
    return rows.select("trip_id", "off", "state", "fraction", lat.alias("lat"), lon.alias("lon"), first.alias("n")).where("n = 1").drop("n")


def vehicle_pins(events: DataFrame, now_s: int, reach_s: int = 1800) -> DataFrame:
    """(trip_id, off, state) of trips that are not under way: before the first departure INCOMING_AT it, after the last arrival STOPPED_AT it.

    Only those that start or ended within ``reach_s`` of ``now_s``.
    """
    ends = events.groupBy("trip_id").agg(F.min(F.struct("off", F.col("rt_departure_s").alias("s"))).alias("a"), F.max(F.struct("off", F.col("rt_arrival_s").alias("s"))).alias("b"))
    early, late = F.lit(now_s) < F.col("a.s"), F.lit(now_s) > F.col("b.s")
    near = (early & (F.col("a.s") - now_s <= reach_s)) | (late & (now_s - F.col("b.s") <= reach_s))
    return ends.where(near).select("trip_id", F.when(early, F.col("a.off")).otherwise(F.col("b.off")).alias("off"), F.when(early, "INCOMING_AT").otherwise("STOPPED_AT").alias("state"))
