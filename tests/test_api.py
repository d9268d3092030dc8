"""The client's questions over the derived network."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stopwise.api import Service
from stopwise.functions import labels, registered
from stopwise.operators import access, search, walking
from stopwise.sources.derived import Network

FOLDER, DAY = "/root/testdata/sf0.001", dt.date(2024, 1, 15)


@pytest.fixture(scope="module")
def service(spark):
    net = Network(spark, FOLDER)
    w = F.col("wheelchair")
    raw_id = F.concat(F.lit("net:"), F.col("stop_id").cast("string"))
    stops = net.stops.select("*", raw_id.alias("raw_id"), search.place_kind(raw_id, F.when(w == 1, 1).otherwise(0), w == 0).alias("place_kind"), F.lit(True).alias("has_departures"))
    epoch = {"stops": stops, "trips": net.trips, "events": net.events_of(net.trips), "services": net.services, "exceptions": net.calendar_dates, "walks": walking.walk_graph(net.stops, 2_500.0), "addresses": net.addresses}
    updates = net.rt_events
    gps = updates.where("is_vehicle").join(net.stop_times, ["trip_id", "off"]).join(net.stops, "stop_id").groupBy("trip_id").agg(F.max_by("lat", "event_id").alias("lat"), F.max_by("lon", "event_id").alias("lon"))
    overlay = {"rt_events": updates, "updates": updates.select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at_s")), "vehicles": gps, "alerts": net.alerts}
    return Service({k: v.cache() for k, v in epoch.items()}, overlay)


def test_boards_and_trips(service):
    rows = service.departures([0, 3, 7], DAY, 28_800, live=True).collect()
    assert 0 < len(rows) <= 10 and all(r.departure_s >= 28_800 for r in rows)
    trip = service.trip(rows[0].trip_id).collect()
    assert [r.off for r in trip] == list(range(8))
    assert service.departures([999], DAY, 0).count() == 0


def test_search_and_places(service):
    assert service.stops("stop 1").first().name == "Stop 1"
    near = service.stops(near=(48.8, 2.2, 9_999_999), limit=3).collect()
    assert len(near) <= 3 and all(r.distance_m <= 5000 for r in near)
    assert service.places("stop 1").first().kind == "stop"
    assert {r.relation for r in service.stop(0).collect()} >= {"self"}
    assert service.addresses("rue de").count() <= 8


def test_live_answers(service):
    h = service.health(1_706_745_600).first()
    assert h.status == "ok" and h.trips == 1500
    assert service.vehicles(28_800, DAY, limit=50).count() <= 50
    assert service.traffic_messages(1_705_302_000, 5).count() == 5 and service.alerts(3).count() == 3
    assert service.trip_realtime(0).count() <= 1


def test_itineraries_of_a_batch(service, spark):
    asks = spark.createDataFrame([(1, 48.8, 2.2, 48.83, 2.25, 28_000), (2, 48.81, 2.21, 48.86, 2.3, 30_000), (3, 0.0, 0.0, 1.0, 1.0, 0)], "query_id long, from_lat double, from_lon double, to_lat double, to_lon double, depart_s long")
    rows = service.itineraries(asks, DAY, walk_m=5_000).collect()
    for r in rows:
        assert r.query_id in (1, 2) and r.departure_s >= (28_000, 30_000)[r.query_id - 1] and r.arrival_s > r.departure_s
        clock = 0
        for leg in r.legs:
            assert leg.arrival_s >= (leg.departure_s or clock) >= clock
            clock = leg.arrival_s
        assert all(a.to_stop == b.from_stop for a, b in zip(r.legs, r.legs[1:], strict=False))
    assert {r["rank"] for r in rows if r.query_id == 1} == set(range(1, 1 + sum(r.query_id == 1 for r in rows)))


def test_enriched_journeys(spark):
    legs = spark.createDataFrame([(1, 1, 7, 0, 2, 100, 200), (2, 1, 8, 0, 1, 100, 150)], "journey_id long, leg int, trip_id long, off long, alight_off long, departure_s long, arrival_s long")
    live = spark.createDataFrame([(7, 0, 160, 160, False, True), (7, 2, 300, 290, False, True), (8, 0, 100, 100, True, True)], "trip_id long, off long, rt_departure_s long, rt_arrival_s long, canceled boolean, has_rt boolean")
    none = spark.createDataFrame([], "journey_id long, leg int")
    rows = access.enriched(legs, live, none).collect()
    assert [(r.journey_id, r.departure_s, r.arrival_s, r.status) for r in rows] == [(1, 160, 290, "DELAYED")]


def test_place_clusters(spark):
    stops = spark.createDataFrame([(1, "Gare de Lyon", 48.0, 2.0), (2, "Lyon RER", 48.04, 2.0), (3, "Other", 48.001, 2.0)], "stop_id long, name string, lat double, lon double")
    got = {(r.stop_id, r.member): r.duration_s for r in access.place_clusters(stops).collect()}
    assert (1, 2) in got and got[1, 3] <= 93 and (2, 3) not in got


def test_labels(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    lit = lambda v: F.lit(v).cast("string")

    def label(mode=None, trip=None, short=None, long=None):
        return one(labels.map_label(lit(mode), lit(trip), lit(None), lit(short), lit(long), lit(None), lit(None)))

    assert label("RAIL", "6001", None, "TGV INOUI") == "TGV InOui 6001" and label("RAIL", None, "A") == "RER A"
    assert label("METRO", None, "14") == "Métro 14" and label("TRAM", None, "3a") == "Tram T3a" and label("BUS", None, "38") == "Bus 38"
    assert label("RAIL", None, "J", "Transilien J") == "Transilien J" and label() == "train"
    assert one(labels.human_ref(F.lit("STIF:Line::C01742:"))) == "C01742" and one(labels.human_ref(F.lit("SNCF:20240115"))) == "SNCF"
    work = F.lit("Travaux sur les RER B et D : saturation sur les lignes 4 et 5")
    assert not one(labels.alert_fits_leg(work, lit(None), F.lit("5"), F.lit("METRO"))) and one(labels.alert_fits_leg(work, lit(None), F.lit("B"), F.lit("RAIL")))
    assert not one(labels.alert_fits_leg(F.lit("Info trafic routier"), lit(None), F.lit("B"), F.lit("RAIL")))
    assert one(labels.is_uuid(F.lit("0b3a5a3e-1111-2222-3333-444455556666"))) and one(labels.masked_url(F.lit("redis://u:p@h/0"))) == "redis://***@h/0"
    assert one(labels.stop_key(F.lit("stop_area:IDFM:71517"))) == "71517"


def test_sql_functions(spark):
    assert len(registered.register(spark)) == 4
    row = spark.sql("select haversine_m(48.0D, 2.0D, 48.01D, 2.0D) d, bearing_deg(48.0D, 2.0D, 48.0D, 3.0D) b, gtfs_seconds('24:45:00') s, service_anchor_s(date '2026-03-29', 'Europe/Paris') a").first()
    assert round(row.d) == 1112 and 89 < row.b < 90 and row.s == 89100 and row.a == 1774735200
