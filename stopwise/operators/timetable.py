"""Trips, stop events and what is derived from their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ((0, "TRAM"), (1, "METRO"), (2, "RAIL"), (3, "BUS"), (4, "FERRY"), (5, "CABLE_CAR"), (6, "GONDOLA"), (7, "FUNICULAR"), (11, "TROLLEYBUS"), (12, "MONORAIL"))
RANGES = ((100, 199, "RAIL"), (200, 299, "BUS"), (400, 499, "METRO"), (700, 799, "BUS"), (900, 999, "TRAM"))
PATHWAYS = ((1, "WALKWAY"), (2, "STAIRS"), (3, "MOVING_SIDEWALK"), (4, "ESCALATOR"), (5, "ELEVATOR"), (6, "FARE_GATE"), (7, "EXIT_GATE"))


def _named(code: Column, pairs: tuple[tuple[int, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for k, name in reversed(pairs):
        out = F.when(code == k, F.lit(name)).otherwise(out)
    return out


def route_mode(route_type: Column) -> Column:
    """Mode of a route type, extended ranges included; others are OTHER."""
    out = F.lit("OTHER")
    for low, high, name in reversed(RANGES):
        out = F.when(route_type.between(low, high), F.lit(name)).otherwise(out)
    return F.coalesce(_named(route_type, MODES), out)


def pathway_mode(code: Column) -> Column:
    return F.coalesce(_named(code, PATHWAYS), F.lit("UNKNOWN"))


def pathway_seconds(traversal_s: Column, length_m: Column) -> Column:
    """Traversal time, else length at walking speed, else a minute."""
    usable = length_m.isNotNull() & ~F.isnan(length_m) & (length_m > 0)
    return F.coalesce(traversal_s, F.when(usable, F.ceil(length_m / 1.2)).cast("int"), F.lit(60))


def wheelchair_seconds(duration_s: Column, mode: Column) -> Column:
    """Stairs and escalators cost a hundredfold."""
    return F.when(mode.isin(2, 4), duration_s * 100).otherwise(duration_s)


def is_station(location_type: Column, parent_id: Column) -> Column:
    return (location_type == 1) | ((location_type == 0) & parent_id.isNull())


def with_offsets(stop_times: DataFrame, trip: str = "trip_id", *order: str) -> DataFrame:
    """``off``: contiguous position in the trip, from 0."""
    return stop_times.withColumn("off", F.row_number().over(W.partitionBy(trip).orderBy(*order)) - 1)


def links(stop_times: DataFrame) -> DataFrame:
    """(trip_id, off, from_stop, to_stop, run_s): consecutive stops."""
    w = W.partitionBy("trip_id").orderBy("off")
    out = stop_times.select("trip_id", "off", F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(w).alias("to_stop"), (F.lead("arrival_s").over(w) - F.col("departure_s")).alias("run_s"))
    return out.where("to_stop is not null")


def running_distance(stop_times: DataFrame, distance: Column) -> DataFrame:
    """``total``: sum of ``distance`` up to and with the row, by trip."""
    w = W.partitionBy("trip_id").orderBy("off").rowsBetween(W.unboundedPreceding, W.currentRow)
    return stop_times.withColumn("total", F.sum(distance).over(w))


def interpolate(stop_times: DataFrame) -> DataFrame:
    """Fill blank times between timed stops; (trip_id, off, arrival_s, departure_s, shape_dist, lat, lon) in and out, with ``timepoint``.

    The weight along a gap is shape distance where it is complete, never falls and rises over all, else straight-line
    distance where all stops have coordinates and it is positive, else the index. Trips whose first or last
    stop has no time are dropped. Halves round away from zero. All is one order of a trip's stops, so that rows are sorted once.
    """
    from ..functions.geo import haversine

    order = W.partitionBy("trip_id").orderBy("off")
    before, after = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.currentRow, W.unboundedFollowing)
    timed = F.col("arrival_s").isNotNull() | F.col("departure_s").isNotNull()
    rows = stop_times.withColumn("a", F.coalesce("arrival_s", "departure_s")).withColumn("d", F.coalesce("departure_s", "arrival_s")).withColumn("timed", timed)
    ends = F.first("timed").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) & F.last("timed").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.withColumn("ends", ends).where("ends")
    leg = haversine(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("leg", leg)
    rows = rows.withColumn("line", F.sum(F.coalesce("leg", F.lit(0.0))).over(before))
    falls = ~F.col("timed") & (F.lag("shape_dist").over(order) > F.col("shape_dist"))
    off_shape, off_map = F.col("shape_dist").isNull() | F.coalesce(falls, F.lit(False)), F.col("lat").isNull() | F.col("lon").isNull()
    rows = rows.withColumn("off_shape", off_shape.cast("int")).withColumn("off_map", off_map.cast("int")).withColumn("last_shape", F.lag("shape_dist").over(order))
    rows = rows.withColumn("n_shape", F.sum("off_shape").over(before) - F.col("off_shape")).withColumn("n_map", F.sum("off_map").over(before) - F.col("off_map"))
    # counts up to a timed stop: their difference is what lies in the gap, its first stop included; a distance that never falls is greatest before the next timed stop
    mark = F.struct("off", "a", "d", "shape_dist", "line", "n_shape", "n_map", "last_shape")
    rows = rows.withColumn("low", F.last(F.when(F.col("timed"), mark), True).over(before)).withColumn("high", F.first(F.when(F.col("timed"), mark), True).over(after))
    complete = (F.col("high.n_shape") == F.col("low.n_shape")) & (F.col("high.shape_dist") >= F.col("high.last_shape"))
    by_shape = complete & (F.col("high.shape_dist") > F.col("low.shape_dist"))
    placed = (F.col("high.n_map") == F.col("low.n_map")) & (F.col("high.line") > F.col("low.line"))
    share = (
        F.when(by_shape, (F.col("shape_dist") - F.col("low.shape_dist")) / (F.col("high.shape_dist") - F.col("low.shape_dist")))
        .when(placed, (F.col("line") - F.col("low.line")) / (F.col("high.line") - F.col("low.line")))
        .otherwise((F.col("off") - F.col("low.off")) / (F.col("high.off") - F.col("low.off")))
    )
    filled = F.round(F.col("low.d") + share * (F.col("high.a") - F.col("low.d"))).cast("int")
    keep = [c for c in stop_times.columns if c not in ("arrival_s", "departure_s", "timepoint")]
    return rows.select(*keep, F.when(F.col("timed"), F.col("a")).otherwise(filled).cast("int").alias("arrival_s"), F.when(F.col("timed"), F.col("d")).otherwise(filled).cast("int").alias("departure_s"), F.col("timed").cast("int").alias("timepoint"))


def denormalised(trips: DataFrame, routes: DataFrame, agencies: DataFrame) -> DataFrame:
    """Trips with their route and agency; a route without agency takes the feed's only one."""
    only = agencies.agg(F.when(F.count("*") == 1, F.first("agency_id")).alias("only_agency"))
    out = trips.join(routes, "route_id", "left").crossJoin(F.broadcast(only))
    out = out.withColumn("agency_id", F.coalesce("agency_id", "only_agency")).drop("only_agency")
    return out.join(agencies, "agency_id", "left")


def line_groups(stop_times: DataFrame) -> DataFrame:
    """(trip_id, line_key): trips of one line have the same stops in the same order."""
    stops = F.transform(F.array_sort(F.collect_list(F.struct("off", "stop_id"))), lambda x: x["stop_id"])
    return stop_times.groupBy("trip_id").agg(F.array_join(stops, ",").alias("line_key"))


def line_positions(stop_times: DataFrame) -> DataFrame:
    """(trip_id, line_key, position): rank in the line by first departure, then id."""
    first = stop_times.groupBy("trip_id").agg(F.min_by("departure_s", "off").alias("first_s"))
    rows = line_groups(stop_times).join(first, "trip_id")
    return rows.select("trip_id", "line_key", (F.row_number().over(W.partitionBy("line_key").orderBy("first_s", "trip_id")) - 1).alias("position"))


#: Seconds of first departures of a line that one task puts in order.
FIFO_SLOT_S = 900


def fifo_lines(stop_times: DataFrame) -> DataFrame:
    """(line_key, n_trips, fifo): no trip of the line is overtaken at any stop by the next one, and all may be boarded and left alike there.

    Each trip is one row with its events in order. Trips are compared with the one before in slots of their line's first departures, and the first of a slot
    with the last of the slot before it.
    """
    event = F.struct("off", "stop_id", "departure_s", "arrival_s", "pickup_type", "drop_off_type")
    trips = stop_times.groupBy("trip_id").agg(F.array_sort(F.collect_list(event)).alias("e"))
    times = F.transform("e", lambda x: F.struct(x["departure_s"].alias("d"), x["arrival_s"].alias("a"), x["pickup_type"].alias("p"), x["drop_off_type"].alias("o")))
    trips = trips.select("trip_id", F.array_join(F.transform("e", lambda x: x["stop_id"]), ",").alias("line_key"), F.col("e")[0]["departure_s"].alias("first_s"), times.alias("times"))
    trips = trips.withColumn("slot", F.floor(F.col("first_s") / FIFO_SLOT_S))

    def fine(one, two):  # two comes after one; what is not known breaks nothing
        later = (two["d"] >= one["d"]) & (two["a"] >= one["a"]) & (two["p"] == one["p"]) & (two["o"] == one["o"])
        return F.coalesce(later, F.lit(True))

    def kept(before, now):
        return F.coalesce(F.forall(F.zip_with(before, now, fine), lambda x: x), F.lit(True))

    order = W.partitionBy("line_key", "slot").orderBy("first_s", "trip_id")
    at = F.struct("first_s", "trip_id")
    slots = trips.withColumn("kept", kept(F.lag("times").over(order), F.col("times"))).groupBy("line_key", "slot")
    slots = slots.agg(F.count("*").alias("n"), F.bool_and("kept").alias("kept"), F.min_by("times", at).alias("first"), F.max_by("times", at).alias("last"))
    line = W.partitionBy("line_key").orderBy("slot")
    slots = slots.withColumn("joint", kept(F.lag("last").over(line), F.col("first")))
    return slots.groupBy("line_key").agg(F.sum("n").alias("n_trips"), F.bool_and(F.col("kept") & F.col("joint")).alias("fifo"))


def scheduled_runs(stop_times: DataFrame, least_s: int = 30) -> DataFrame:
    """(trip_id, off, run_s, from_stop): seconds from the stop before by schedule, ``least_s`` at least."""
    w = W.partitionBy("trip_id").orderBy("off")
    rows = stop_times.select("trip_id", "off", F.greatest(F.col("arrival_s") - F.lag("departure_s").over(w), F.lit(least_s)).alias("run_s"), F.lag("stop_id").over(w).alias("from_stop"))
    return rows.where("from_stop is not null")


def layout_links(stop_times: DataFrame) -> DataFrame:
    """(a, b, weight): how often two stops follow each other in either direction."""
    low, high = F.least("from_stop", "to_stop"), F.greatest("from_stop", "to_stop")
    return links(stop_times).groupBy(low.alias("a"), high.alias("b")).agg(F.count("*").alias("weight"))


def trip_transfers(stop_times: DataFrame, trips: DataFrame, buffer_s: int = 120) -> DataFrame:
    """(trip_id, off, line, to_trip, to_off): at each alighting the earliest trip of each other line from the same stop.

    ``trips`` (trip_id, line). The earliest trip is found per distinct (stop, line, time), not per pair of events:
    departures and alightings of a stop and line are merged by time, and the next departure is the first one after.
    """
    events = stop_times.join(trips, "trip_id")
    boards = events.where("pickup_type <> 1").select("stop_id", F.col("line").alias("to_line"), F.col("departure_s").alias("t"), F.struct("departure_s", F.col("trip_id").alias("to_trip"), F.col("off").alias("to_off")).alias("board"))
    lines_at = boards.select("stop_id", "to_line").distinct()
    alights = events.where("drop_off_type <> 1").select("stop_id", "trip_id", "off", "line", (F.col("arrival_s") + buffer_s).alias("t"))
    asks = alights.join(lines_at, "stop_id")
    nothing = F.lit(None)
    both = asks.select("stop_id", "to_line", "t", F.lit(0).alias("kind"), "trip_id", "off", "line", nothing.cast(boards.schema["board"].dataType).alias("board")).union(
        boards.select("stop_id", "to_line", "t", F.lit(1).alias("kind"), nothing.cast("long").alias("trip_id"), nothing.cast("long").alias("off"), nothing.cast("long").alias("line"), "board")
    )
    w = W.partitionBy("stop_id", "to_line").orderBy(F.desc("t"), F.desc("kind"), F.desc("board")).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = both.withColumn("next", F.last("board", True).over(w)).where("kind = 0 and next is not null")
    # the trip's own later run of its line is marked as seen and nothing else of that line is offered
    return found.where(F.col("next.to_trip") != F.col("trip_id")).select("trip_id", "off", F.col("to_line").alias("line"), F.col("next.to_trip").alias("to_trip"), F.col("next.to_off").alias("to_off"))
