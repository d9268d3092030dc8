"""Which stop events the router may board: live times, modes and exclusions, earlier service days, headway runs.

Each step maps stop events to stop events, so that they combine and the rounds of ``router`` stay as they are. Events with live times have
``shift``, the delay at the boarding stop, which a rider takes along, and ``own_delay``, a stop's own delay, which wins over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_S = 86_400
#: Runs of a headway window that are offered at most; the schedule has no more.
RUNS = 32


def usable(events: DataFrame, modes: tuple[int, ...] = (), wheelchair: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """Events of trips of the route types ``modes`` (none given: all), without trips known to be inaccessible, and without ``excluded`` (trip_id)."""
    if modes:
        events = events.where(F.col("route_type").isin(*modes))
    if wheelchair:
        events = events.where(F.coalesce(F.col("wheelchair"), F.lit(0)) != 2)
    return events if excluded is None else events.join(excluded.select("trip_id"), "trip_id", "left_anti")


def live(events: DataFrame, stops: DataFrame, trips: DataFrame) -> DataFrame:
    """Events at their live times: without cancelled trips, skipped stops neither boarded nor left at.

    ``stops`` (trip_id, off, delay_s, skipped) and ``trips`` (trip_id, canceled, delay_s) are the last words of the updates.
    """
    out = events.join(stops.withColumnRenamed("delay_s", "own_delay"), ["trip_id", "off"], "left").join(trips.select("trip_id", "canceled", F.col("delay_s").alias("trip_delay")), "trip_id", "left")
    out = out.where(~F.coalesce("canceled", F.lit(False))).withColumn("shift", F.coalesce("own_delay", "trip_delay", F.lit(0)).cast("long"))
    closed = F.coalesce("skipped", F.lit(False))
    out = out.withColumn("departure_s", F.greatest(F.col("departure_s") + F.col("shift"), F.lit(0)))
    for kind in ("pickup_type", "drop_off_type"):
        out = out.withColumn(kind, F.when(closed, F.lit(1)).otherwise(F.col(kind)))
    return out.drop("canceled", "trip_delay", "skipped")


def headway_runs(events: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Events with ``run``: 0 for a trip by its schedule; a trip with headway windows gives its runs (from 1) instead.

    ``frequencies`` (trip_id, start_s, end_s, headway_s); a run's times are the trip's own, moved so that it starts with the run. Windows that do not move on are left out.
    """
    windows = frequencies.where((F.col("headway_s") > 0) & (F.col("end_s") > F.col("start_s")))
    n = F.least(F.ceil((F.col("end_s") - F.col("start_s")) / F.col("headway_s")), F.lit(RUNS)).cast("int")
    starts = windows.select("trip_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("start_s") + k * F.col("headway_s"))).alias("k", "run_s"), "start_s")
    order = F.row_number().over(_by_start()).alias("run")
    starts = starts.select("trip_id", "run_s", order)
    base = events.groupBy("trip_id").agg(F.min_by("departure_s", "off").alias("base_s"))
    runs = events.join(starts.join(base, "trip_id"), "trip_id")
    move = (F.col("run_s") - F.col("base_s")).cast("long")
    runs = runs.select(*(F.col(c) + move if c in ("arrival_s", "departure_s") else F.col(c) for c in events.columns), "run").toDF(*events.columns, "run")
    return events.join(frequencies.select("trip_id").distinct(), "trip_id", "left_anti").withColumn("run", F.lit(0)).unionByName(runs)


def _by_start():
    from pyspark.sql import Window as W

    return W.partitionBy("trip_id").orderBy("run_s", "start_s")


def service_days(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    """Events of both service days on today's clock, with ``day`` (0: today, 1: the day before, whose times past 24 hours still matter)."""
    late = yesterday.where(F.greatest("arrival_s", "departure_s") >= DAY_S)
    moved = late.select(*((F.col(c) - DAY_S).alias(c) if c in ("arrival_s", "departure_s") else F.col(c) for c in today.columns))
    return today.withColumn("day", F.lit(0)).unionByName(moved.withColumn("day", F.lit(1)))


def keyed(events: DataFrame) -> DataFrame:
    """Events whose ``trip_id`` tells service days and runs apart: 256 times the trip, 128 for the day before, and the run."""
    day = F.col("day") if "day" in events.columns else F.lit(0)
    run = F.col("run") if "run" in events.columns else F.lit(0)
    return events.withColumn("trip_id", (F.col("trip_id") * 256 + day * 128 + run).cast("long"))
