"""Departure boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def board(events: DataFrame, active: DataFrame, stops: DataFrame, from_s: int, limit: int | None) -> DataFrame:
    """Next departures at ``stops`` (stop_id) from ``from_s`` on, on a day with the ``active`` services.

    ``events``: stop events with service_id. ``stops`` and ``active`` are small beside them; whether they are broadcast is
    for their measured size to say.
    """
    out = events.where((F.col("pickup_type") != 1) & (F.col("departure_s") >= from_s)).join(stops, "stop_id", "left_semi").join(active, "service_id", "left_semi")
    out = out.select("stop_id", "trip_id", "route_id", "off", "departure_s")
    return out.orderBy("departure_s", "trip_id", "off", "stop_id").limit(limit) if limit else out


def next_by_stop(events: DataFrame, active: DataFrame, from_s: int, k: int) -> DataFrame:
    """The next ``k`` departures of every stop."""
    rows = events.where((F.col("pickup_type") != 1) & (F.col("departure_s") >= from_s)).join(active, "service_id", "left_semi")
    rank = F.row_number().over(W.partitionBy("stop_id").orderBy("departure_s", "trip_id", "off"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("stop_id", "rank", "trip_id", "route_id", "off", "departure_s")


def frequency_boarding(frequencies: DataFrame, at_s: int) -> DataFrame:
    """(trip_id, start_s, board_s): first run of a frequency window at or after ``at_s``; the window's end is exclusive."""
    steps = F.ceil(F.greatest(F.lit(at_s) - F.col("start_s"), F.lit(0)) / F.col("headway_s"))
    board_s = F.col("start_s") + steps * F.col("headway_s")
    return frequencies.where("headway_s > 0").select("trip_id", "start_s", board_s.alias("board_s"), "end_s").where("board_s < end_s").select("trip_id", "start_s", "board_s")
