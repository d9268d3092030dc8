"""The questions a client may ask, as functions from tables to tables.

Each takes its time as an argument and a batch of requests where the work allows one. Limits are clamped as the service's are.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import labels
from .functions.geo import haversine, in_box
from .functions.text import normalize
from .operators import access, alerts, calendar, departures, realtime, router, search, spatial


def clamp(value: float, low: float, high: float) -> float:
    return min(max(value, low), high)


class Service:
    """An epoch (stops, trips, events, services, exceptions, walks ...) and an overlay (updates, vehicles, alerts) as named tables.

    Events carry service_id and route_id. Missing tables are errors only of the questions that need them.
    """

    def __init__(self, epoch: dict[str, DataFrame], overlay: dict[str, DataFrame] | None = None, zone: str = "Europe/Paris"):
        self.epoch, self.overlay, self.zone = epoch, overlay or {}, zone

    def _active(self, day: dt.date) -> DataFrame:
        return calendar.active_services(self.epoch["services"], self.epoch["exceptions"], day)

    def health(self, now_s: int) -> DataFrame:
        trips = self.epoch["trips"].agg(F.count("*").alias("trips"))
        age = self.overlay["updates"].agg((now_s - F.max("at_s")).alias("age_s"))
        return trips.crossJoin(age).select(F.when(F.col("trips") > 0, "ok").otherwise("empty").alias("status"), "trips", "age_s", (F.coalesce("age_s", F.lit(10**9)) < 300).alias("live"))

    def stops(self, search_for: str | None = None, near: tuple[float, float, float] | None = None, limit: int = 15) -> DataFrame:
        """By text, or around (lat, lon, radius), or both: then the text filters four times the limit of near ones."""
        limit = int(clamp(limit, 1, 100))
        rows = self.epoch["stops"]
        if near:
            lat, lon, radius = near[0], near[1], clamp(near[2], 1, 5000)
            d = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
            rows = rows.withColumn("distance_m", d).where(F.col("distance_m") <= radius).orderBy("distance_m", "stop_id").limit(limit * (4 if search_for else 1))
            if search_for:
                rows = rows.where(F.contains(normalize(F.col("name")), normalize(labels.clamped(F.lit(search_for)))))
            return rows.limit(limit)
        asks = rows.sparkSession.range(1).select(labels.clamped(F.lit(search_for or "")).alias("query"))
        return search.stop_search(rows, asks, limit).orderBy("rank")

    def stop(self, stop_id) -> DataFrame:
        """The stop, its parent and its children, with ``relation``."""
        rows = self.epoch["stops"]
        own = rows.where(F.col("stop_id") == stop_id)
        parent = rows.join(own.select(F.col("parent_id").alias("stop_id")), "stop_id", "left_semi")
        children = rows.where(F.col("parent_id") == stop_id)
        return own.withColumn("relation", F.lit("self")).unionByName(parent.withColumn("relation", F.lit("parent"))).unionByName(children.withColumn("relation", F.lit("child")))

    def addresses(self, search_for: str, limit: int = 8) -> DataFrame:
        asks = self.epoch["addresses"].sparkSession.range(1).select(labels.clamped(F.lit(search_for)).alias("query"))
        return search.address_suggest(self.epoch["addresses"], asks, int(clamp(limit, 1, 30))).orderBy("rank")

    def places(self, search_for: str, limit: int = 12) -> DataFrame:
        limit = int(clamp(limit, 1, 30))
        return search.places(self.stops(search_for, limit=limit), self.addresses(search_for, limit), limit).orderBy("rank")

    def agencies(self) -> DataFrame:
        return self.epoch["agencies"].orderBy("agency_id")

    def departures(self, stop_ids: list, day: dt.date, from_s: int, limit: int = 10, live: bool = True) -> DataFrame:
        """Scheduled departures from ``from_s`` on, with live times and cancellations where known."""
        wanted = self.epoch["stops"].where(F.col("stop_id").isin(*stop_ids) | F.col("parent_id").isin(*stop_ids)).select("stop_id")
        rows = departures.board(self.epoch["events"], self._active(day), wanted, from_s, int(clamp(limit, 1, 200)))
        if not live or "rt_events" not in self.overlay:
            return rows
        updates = self.overlay["rt_events"]
        full = rows.join(self.epoch["events"].select("trip_id", "off", "arrival_s"), ["trip_id", "off"])
        return realtime.with_realtime(full, realtime.stop_updates(updates), realtime.trip_delay(updates)).where("not skipped")

    def trip(self, trip_id) -> DataFrame:
        return self.epoch["events"].where(F.col("trip_id") == trip_id).orderBy("off")

    def trip_realtime(self, trip_id) -> DataFrame:
        return realtime.trip_status(realtime.trip_delay(self.overlay["rt_events"].where(F.col("trip_id") == trip_id)))

    def shape(self, shape_id) -> DataFrame:
        return self.epoch["shapes"].where(F.col("shape_id") == shape_id)

    def alerts(self, limit: int = 50) -> DataFrame:
        return self.overlay["alerts"].orderBy("alert_id").limit(int(clamp(limit, 1, 500)))

    def traffic_messages(self, now_s: int, limit: int = 40) -> DataFrame:
        periods = F.array(F.struct(F.col("active_start").alias("start"), F.col("active_end").alias("end")))
        rows = alerts.deduplicated(self.overlay["alerts"].where(alerts.active_now(periods, now_s)))
        return rows.orderBy("alert_id").limit(int(clamp(limit, 1, 200)))

    def vehicles(self, now_s: int, day: dt.date, box: tuple[float, float, float, float] | None = None, limit: int = 200) -> DataFrame:
        """Reported positions first, then estimates of running trips that have updates and report none."""
        gps = self.overlay["vehicles"].select("trip_id", "lat", "lon", F.lit("GPS").alias("source"))
        running = self.epoch["events"].join(self._active(day), "service_id", "left_semi")
        updates = self.overlay["rt_events"]
        live = realtime.with_realtime(running, realtime.stop_updates(updates), realtime.trip_delay(updates)).where("not canceled")
        rest = realtime.vehicle_estimate(live, now_s, self.epoch["stops"]).join(updates.select("trip_id").distinct(), "trip_id", "left_semi").join(gps, "trip_id", "left_anti")
        rows = gps.unionByName(rest.select("trip_id", "lat", "lon", F.concat(F.lit("ESTIMATED_"), "state").alias("source")))
        if box:
            rows = rows.where(in_box(F.col("lat"), F.col("lon"), *box))
        return rows.orderBy(F.when(F.col("source") == "GPS", 0).otherwise(1), "trip_id").limit(int(clamp(limit, 1, 1000)))

    def itineraries(self, queries: DataFrame, day: dt.date, max_transfers: int = 6, walk_m: float = 2_500.0, buffer_s: int = 120, results: int = 5) -> DataFrame:
        """Journeys of a batch: (query_id, from_lat, from_lon, to_lat, to_lon, depart_s), Pareto-best and ranked in each query."""
        boardable = self.epoch["stops"].where("lat is not null and lon is not null")
        walk_m = clamp(walk_m, 0, 5_000)
        start = access.of_points(queries.select("query_id", F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")), boardable, walk_m)
        end = access.of_points(queries.select("query_id", F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")), boardable, walk_m)
        first = start.join(queries.select("query_id", "depart_s"), "query_id").select("query_id", "stop_id", (F.col("depart_s") + F.col("duration_s")).cast("long").alias("arr"))
        running = self.epoch["events"].join(self._active(day), "service_id", "left_semi")
        n = router.max_rounds(0, max_transfers)
        labels_ = router.rounds(first, running, self.epoch.get("walks"), n, buffer_s)
        found = router.reconstruct(labels_, end.select("query_id", "stop_id").distinct(), n)
        found = found.join(end.select("query_id", F.col("stop_id").alias("target"), F.col("duration_s").alias("egress_s"), F.col("distance_m").alias("egress_m")), ["query_id", "target"])
        found = found.join(start.select("query_id", F.col("stop_id").alias("origin"), F.col("duration_s").alias("access_s"), F.col("distance_m").alias("access_m")), ["query_id", "origin"]).where("departure_s is not null")
        found = found.withColumn("arrival_s", F.col("arrival_s") + F.col("egress_s")).withColumn("departure_s", F.col("departure_s") - F.col("access_s")).withColumn("walk_m", F.round(F.col("access_m") + F.col("egress_m")).cast("long"))
        found = found.withColumn("journey_id", F.substring(F.sha2(F.to_json(F.struct("query_id", "legs")), 256), 1, 32))
        best = router.pareto(found.dropDuplicates(["query_id", "journey_id"]))
        return router.ranked(best).where(F.col("rank") <= int(clamp(results, 1, 20)))

    def nearest_stops(self, points: DataFrame, radius_m: float, k: int) -> DataFrame:
        return spatial.nearest(points, self.epoch["stops"], clamp(radius_m, 1, 5000), k)

    def levels(self) -> DataFrame:
        return self.epoch["levels"].orderBy("level_index", "level_name")

    def pathways(self, stop_id, limit: int = 100) -> DataFrame:
        rows = self.epoch["pathways"].where((F.col("from_stop") == stop_id) | (F.col("to_stop") == stop_id))
        return rows.orderBy("pathway_id").limit(int(clamp(limit, 1, 500)))

    def feed_preference(self, feeds: DataFrame, first: str) -> DataFrame:
        """Feeds with the preferred one at the head."""
        rank = F.row_number().over(W.orderBy(F.when(F.col("feed_id") == first, 0).otherwise(1), "feed_id"))
        return feeds.withColumn("rank", rank)
