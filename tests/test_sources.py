"""Feeds built in memory, as they come over the wire."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from stopwise.sources import gtfs, gtfsrt, siri

FILES = {
    "feed/Stops.TXT": "﻿stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station\nA,Alpha,48.8,2.3,0,P\nB,,48.81,2.3,0,\nC,Gamma,48.82,2.3,0,\nP,Parent,48.8,2.3,1,\n",
    "routes.txt": "route_id,route_short_name,route_type,agency_id\nR,1,,\n",
    "trips.txt": "route_id,service_id,trip_id,trip_headsign\nR,wk,T,first\nR,wk,T,second\nR,wk,U,ragged\n",
    "stop_times.txt": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nT,08:00:00,08:01:00,A,1\nT,,,B,5\nT,08:21:00,08:21:00,C,9\nT,09:00:00,09:00:00,ZZ,10\nU,,,A,1\nU,24:45:00,24:45:00,C,2\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20240101,\n",
    "calendar_dates.txt": "service_id,date,exception_type\nwk,20240106,1\nwk,20240108,2\nwk,20240109,7\nwk,bad,1\n",
    "frequencies.txt": "trip_id,start_time,end_time,headway_secs\nT,06:00:00,12:00:00,600\nT,06:00:00,12:00:00,0\n",
    "transfers.txt": "from_stop_id,to_stop_id,min_transfer_time\nA,B,\nA,QQ,60\n",
    "pathways.txt": "from_stop_id,to_stop_id,pathway_mode,is_bidirectional,traversal_time,length\nA,B,2,1,,24\n",
    "object_codes_extension.txt": "object_type,object_id,object_system,object_code\nvj,T,siri,OP:VJ::77:\nvj,U,siri,77\n",
}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("feeds") / "net.zip"
    with zipfile.ZipFile(path, "w") as z:
        for name, text in FILES.items():
            z.writestr(name, text)
    return gtfs.Feed(spark, str(path))


def test_stops_and_defaults(feed):
    rows = {r.stop_id: r for r in feed.stops.collect()}
    assert set(rows) == {"net:A", "net:B", "net:C", "net:P"}
    assert rows["net:B"].name == "B" and rows["net:A"].parent_id == "net:P" and rows["net:P"].location_type == 1
    assert feed.routes.first().route_type == 3
    assert {r.trip_id: r.headsign for r in feed.trips.collect()} == {"net:T": "second", "net:U": "ragged"}


def test_blank_times_are_filled_and_untimed_ends_dropped(feed):
    rows = [(r.trip_id, r.off, r.arrival_s, r.timepoint) for r in feed.stop_times().orderBy("trip_id", "off").collect()]
    assert rows == [("net:T", 0, 28800, 1), ("net:T", 1, 28860 + 600, 0), ("net:T", 2, 30060, 1)]


def test_horizon_keeps_trips_that_run_in_it(spark, tmp_path):
    import datetime as dt

    files = {**FILES, "trips.txt": FILES["trips.txt"] + "R,old,V,gone\nR,once,W,special\n", "agency.txt": "agency_id,agency_name,agency_timezone\na,A,Nowhere/Land\nb,B,Europe/Berlin\nc,C,Europe/Paris\n"}
    files["calendar.txt"] += "old,1,1,1,1,1,1,1,20200101,20201231\n"
    files["calendar_dates.txt"] += "once,20240106,1\n"
    with zipfile.ZipFile(tmp_path / "net.zip", "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    kept = lambda *days: sorted(r.trip_id for r in gtfs.Feed(spark, str(tmp_path / "net.zip"), horizon=tuple(dt.date(2024, 1, d) for d in days)).trips.collect())
    assert kept(5, 7) == ["net:T", "net:U", "net:W"] and kept(7, 7) == [] and kept(9, 9) == ["net:T", "net:U"]
    assert gtfs.Feed(spark, str(tmp_path / "net.zip")).timezone.first().timezone == "Europe/Berlin"


def test_calendar(feed):
    import datetime as dt

    from stopwise.operators.calendar import active_services

    running = lambda d: active_services(feed.services, feed.calendar_dates, d).count()
    assert [running(dt.date(2024, 1, d)) for d in (5, 6, 7, 8, 9)] == [1, 1, 0, 0, 1]
    assert feed.calendar_dates.count() == 2


def test_other_tables(feed):
    assert feed.frequencies.count() == 1
    assert [(r.from_stop, r.to_stop, r.duration_s) for r in feed.transfers.collect()] == [("net:A", "net:B", 120)]
    assert feed.pathways.first().duration_s == 20 and feed.pathways.first().pathway_id == "A->B"
    assert {r.key: r.object_id for r in feed.aliases.collect()}["77"] == "U"
    assert feed.levels.count() == 0 and feed.shapes.count() == 0 and feed.fare_rules.count() == 0


def test_archives_are_checked():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("stops.txt", "stop_id\nA\n")
    with pytest.raises(ValueError, match="stop_times"):
        gtfs.validate(buffer.getvalue())
    with pytest.raises(ValueError, match="larger"):
        list(gtfs.entry_rows(buffer.getvalue(), "stops.txt", cap=3))


def test_address_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;numero;rep;nom_voie;code_postal;nom_commune;lon;lat\n1;12;bis;Rue de Rivoli;75001;Paris;2.35;48.85\n2;x;;Rue Haute;75001;Paris;;48.85\n")
    rows = gtfs.addresses(spark, str(tmp_path / "a.csv")).collect()
    assert [(r.num, r.rep, r.street) for r in rows] == [(12, "bis", "Rue de Rivoli")]


def field(number, value):
    def varint(n):
        n &= (1 << 64) - 1
        out = b""
        while n >= 0x80:
            out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def test_live_feed_of_all_kinds(spark):
    header = field(1, field(1, "2.0") + field(3, 1700))
    trip = field(1, "t1") + field(3, "20240115")
    update = field(3, field(1, trip) + field(2, field(1, 4) + field(2, field(1, -30)) + field(4, "S")) + field(2, field(1, 5) + field(5, 1)))
    gone = field(3, field(1, field(5, "R") + field(4, 3)))
    vehicle = field(4, field(1, trip) + field(2, field(1, 48.5) + field(2, 2.5)) + field(5, 1690) + field(8, field(1, "bus9")))
    nowhere = field(4, field(2, field(1, 0.0) + field(2, 0.0)))
    alert = field(5, field(1, field(2, 99)) + field(5, field(2, "R")) + field(10, field(1, field(1, "Stau") + field(2, "de")) + field(1, field(1, "Bouchon") + field(2, "fr"))))
    data = header + b"".join(field(2, field(1, f"e{k}") + x) for k, x in enumerate((update, gone, vehicle, nowhere, alert)))
    data += field(2, field(1, "dead") + field(2, 1) + update)
    payloads = spark.createDataFrame([("f", bytearray(data)), ("f", bytearray(b"\xff\xff\xff")), ("f", None)], "feed_id string, content binary")
    rows = gtfsrt.entities(payloads).cache()
    assert sorted(r.kind for r in rows.collect()) == ["alert", "trip", "trip", "vehicle"]
    stops = {(r.trip_key, r.stop_sequence): r for r in gtfsrt.stop_updates(rows).collect()}
    assert stops["f:t1", 4].arrival_delay == -30 and stops["f:t1", 5].skipped
    assert stops["f:#r=R&d=&sd=&st=", None].canceled
    from stopwise.functions.text import pick_translation

    assert rows.where("kind = 'alert'").select(pick_translation(F.col("header")).alias("h")).first().h == "Bouchon"


def test_siri_estimated_timetable(spark):
    call = {"StopPointRef": {"value": "STIF:StopPoint:Q:1:"}, "AimedArrivalTime": "2024-01-15T08:00:00Z", "ExpectedArrivalTime": "2024-01-15T08:02:00Z", "DepartureStatus": "cancelled", "ArrivalStatus": "onTime"}
    journey = {"LineRef": {"value": "L1"}, "DatedVehicleJourneyRef": {"value": "J1"}, "EstimatedCalls": {"EstimatedCall": [call, {**call, "ExpectedArrivalTime": None, "ArrivalStatus": "delayed"}]}}
    one = {"Siri": {"ServiceDelivery": {"EstimatedTimetableDelivery": [{"EstimatedJourneyVersionFrame": [{"EstimatedVehicleJourney": [journey]}]}]}}}
    rows = spark.createDataFrame([("f", json.dumps(one)), ("f", "<xml/>"), ("f", None), ("f", "{}")], "feed_id string, content string")
    got = siri.estimated_calls(rows).orderBy("call_at").collect()
    assert [(r.journey_ref, r.line_ref, r.arrival_delay, r.skipped) for r in got] == [("J1", "L1", 120, False), ("J1", "L1", 120, False)]
    kinds = [r.k for r in rows.select(siri.payload_format(F.col("content")).alias("k")).collect()]
    assert kinds == ["json", "xml", "empty", "json"]


def test_siri_monitoring_and_messages(spark):
    visit = {"MonitoredVehicleJourney": {"LineRef": "L2", "FramedVehicleJourneyRef": {"DatedVehicleJourneyRef": "J2"}, "VehicleLocation": {"Latitude": 48.1, "Longitude": 2.2}, "MonitoredCall": {"StopPointRef": "S", "AimedDepartureTime": "2024-01-15T08:00:00Z", "ExpectedDepartureTime": "2024-01-15T07:59:00Z"}}}
    message = {"InfoMessageIdentifier": {"value": "m1"}, "InfoChannelRef": {"value": "Perturbation"}, "ValidUntilTime": "2024-01-15T10:00:00Z", "Content": {"LineRef": [{"value": "L2"}], "Message": [{"MessageText": {"value": "Arrêt non desservi"}}]}}
    body = {"ServiceDelivery": {"StopMonitoringDelivery": {"MonitoredStopVisit": visit}, "GeneralMessageDelivery": [{"InfoMessage": [message]}]}}
    rows = spark.createDataFrame([("f", json.dumps(body))], "feed_id string, content string")
    seen = siri.monitored_visits(rows)
    assert [(r.journey_ref, r.departure_delay) for r in seen.collect()] == [("J2", -60)]
    assert [(r.vehicle_id, r.lat) for r in siri.positions(seen).collect()] == [("J2", 48.1)]
    got = siri.messages(rows).first()
    assert (got.message_id, got.severity, got.line_ref, got.text) == ("m1", "SEVERE", "L2", "Arrêt non desservi")


def test_every_payload_finds_its_parser(spark):
    from stopwise.operators import ingest

    header = field(1, field(1, "2.0") + field(3, 1700))
    trip = field(1, "t1")
    update, vehicle = field(3, field(1, trip)), field(4, field(1, trip) + field(2, field(1, 48.5) + field(2, 2.5)))
    both = header + field(2, field(1, "a") + update) + field(2, field(1, "b") + vehicle)
    call = {"StopPointRef": "S", "AimedArrivalTime": "2024-01-15T08:00:00Z"}
    timetable = json.dumps({"Siri": {"ServiceDelivery": {"EstimatedTimetableDelivery": [{"EstimatedJourneyVersionFrame": [{"EstimatedVehicleJourney": [{"DatedVehicleJourneyRef": "J", "EstimatedCalls": {"EstimatedCall": [call]}}]}]}]}}})
    rows = [("p", None, bytearray(both)), ("q", None, bytearray(header + field(2, field(1, "a") + update))), ("j", timetable, None), ("k", None, bytearray(b"\xef\xbb\xbf" + timetable.encode())), ("x", "<xml/>", None), ("e", "", None), ("n", None, None), ("o", "{}", None)]
    got = ingest.ingest(spark.createDataFrame(rows, "feed_id string, content string, bytes binary"))
    kinds = {r.feed_id: r.kind for r in ingest.kind_of(got["entities"].select("feed_id", "kind"), ["feed_id"]).collect()}
    assert kinds == {"p": "mixed", "q": "trip"}
    assert sorted(r.feed_id for r in got["calls"].collect()) == ["j", "k"]
    assert got["visits"].count() == 0 and got["messages"].count() == 0
    assert sorted(r.feed_id for r in got["unknown"].collect()) == ["e", "n", "o", "x"]


def test_names_of_stops_and_repetitions(spark):
    from stopwise.functions.text import repetition_fits, stop_ref_keys

    rows = spark.createDataFrame([("STIF:StopPoint:Q:412986:",), ("99",), ("net:7",), ("IDFM:4001",)], "ref string").select("ref", stop_ref_keys(F.lit("f"), F.col("ref")).alias("k"))
    got = {r.ref: r.k for r in rows.collect()}
    assert got["99"] == ["99", "f:99"] and got["net:7"] == ["net:7"]
    assert got["STIF:StopPoint:Q:412986:"][1:4] == ["f:412986", "f:IDFM:412986", "f:IDFM:monomodalStopPlace:412986"] and "412986" in got["STIF:StopPoint:Q:412986:"]
    assert got["IDFM:4001"].count("IDFM:4001") == 1 and "StopPoint:4001" in got["IDFM:4001"]
    asked = spark.createDataFrame([(None, "bis", True), ("b", "bis", True), ("b", "b", True), ("bis", "b", False), ("t", "bis", False), ("", None, True), ("B", "Bis", True)], "a string, h string, want boolean")
    assert asked.where(repetition_fits(F.col("a"), F.col("h")) != F.col("want")).count() == 0
