"""Cases with known answers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stopwise.functions import geo, text, timeutil
from stopwise.operators import alerts, calendar, departures, fares, preprocess, realtime, resolve, router, search, shapes, spatial, timetable, walking

EVENTS = "trip_id long, off long, stop_id long, arrival_s long, departure_s long, pickup_type int, drop_off_type int"


def events(spark, trips):
    """trips: {id: [(stop, arrival, departure)]}"""
    rows = [(t, k, s, a, d, int(k == len(calls) - 1), int(k == 0)) for t, calls in trips.items() for k, (s, a, d) in enumerate(calls)]
    return spark.createDataFrame(rows, EVENTS)


def start(spark, stop, at):
    return spark.createDataFrame([(1, stop, at)], "query_id long, stop_id long, arr long")


def best(labels, stop):
    return {r.stop_id: r.arr for r in router.earliest(labels).collect()}.get(stop)


def test_times_of_day(spark):
    rows = ["08:00:00", "24:45:00", "7:05:09", "72:00:00", "73:00:00", "08:60:00", "8:1:00", "x", "", None, "008:00:00"]
    got = [r.s for r in spark.createDataFrame([(r,) for r in rows], "t string").select(timeutil.gtfs_seconds(F.col("t")).alias("s")).collect()]
    assert got == [28800, 89100, 25509, 259200, None, None, None, None, None, None, 28800]
    days = ["20240115", "20240231", "2024-01-15", "", None]
    got = [r.d for r in spark.createDataFrame([(d,) for d in days], "t string").select(timeutil.gtfs_date(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(2024, 1, 15), None, None, None, None]


def test_anchors_over_clock_changes(spark):
    days = ["2026-01-15", "2026-03-29", "2026-10-25"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(timeutil.anchor_epoch(F.col("d").cast("date")).alias("a")).collect()
    assert [dt.datetime.fromtimestamp(r.a, dt.timezone.utc).strftime("%m-%d %H:%M") for r in got] == ["01-14 23:00", "03-28 22:00", "10-24 23:00"]
    eight_thirty = [r.a + 30600 for r in got]
    assert [dt.datetime.fromtimestamp(x, dt.timezone.utc).strftime("%H:%M") for x in eight_thirty] == ["07:30", "06:30", "07:30"]


def test_night_service_of_the_day_before(spark):
    services = spark.createDataFrame([(1, 1 << 4, dt.date(2026, 1, 1), dt.date(2026, 12, 31))], "service_id int, days int, start_date date, end_date date")
    none = spark.createDataFrame([], "service_id int, date date, exception_type int")
    at = int(dt.datetime(2026, 7, 24, 22, 30, tzinfo=dt.timezone.utc).timestamp())  # Saturday 00:30 in Paris
    asks = spark.createDataFrame([(1, at)], "query_id int, epoch_s long")
    passes = {r.service_date: r.since_s for r in calendar.service_passes(asks, 25 * 3600 + 900).collect()}
    assert passes == {dt.date(2026, 7, 25): 1800, dt.date(2026, 7, 24): 88200}
    running = {d: calendar.active_services(services, none, d).count() for d in passes}
    assert running == {dt.date(2026, 7, 25): 0, dt.date(2026, 7, 24): 1}
    trips = events(spark, {1: [(1, 89100, 89100), (2, 90900, 90900)]})
    assert best(router.rounds(start(spark, 1, 88200), trips, None, 2), 2) == 90900


def test_removal_beats_addition(spark):
    services = spark.createDataFrame([(1, 31, dt.date(2024, 1, 1), dt.date(2024, 1, 31))], "service_id int, days int, start_date date, end_date date")
    changes = spark.createDataFrame([(1, dt.date(2024, 1, 6), 1), (1, dt.date(2024, 1, 13), 1), (1, dt.date(2024, 1, 13), 2), (1, dt.date(2024, 1, 8), 2)], "service_id int, date date, exception_type int")
    days = [r.date.day for r in calendar.services_in_range(services, changes, dt.date(2024, 1, 5), dt.date(2024, 1, 14)).orderBy("date").collect()]
    assert days == [5, 6, 9, 10, 11, 12]


def test_earlier_trip_boarded_later_on_the_line(spark):
    m = lambda h, n: h * 3600 + n * 60
    trips = events(spark, {1: [(1, m(7, 50), m(7, 50)), (2, m(8, 5), m(8, 5)), (9, m(8, 20), m(8, 20))], 2: [(1, m(8, 10), m(8, 10)), (2, m(8, 25), m(8, 25)), (9, m(8, 40), m(8, 40))]})
    walk = spark.createDataFrame([(1, 8, 1), (2, 8, 2)], "query_id long, arr long, stop_id long").select("query_id", F.col("stop_id"), F.lit(m(8, 0)).cast("long").alias("arr"))
    labels = router.rounds(walk.withColumn("query_id", F.lit(1).cast("long")), trips, None, 2)
    assert best(labels, 9) == m(8, 20)


def test_five_legs_need_five_rounds(spark):
    trips = events(spark, {k: [(k, 28800 + k * 1200, 28800 + k * 1200), (k + 1, 29400 + k * 1200, 29400 + k * 1200)] for k in range(5)})
    labels = router.rounds(start(spark, 0, 28800), trips, None, 5)
    assert best(labels, 5) == 29400 + 4 * 1200 and best(router.rounds(start(spark, 0, 28800), trips, None, 4), 5) is None
    goal = spark.createDataFrame([(1, 5)], "query_id long, stop_id long")
    j = router.reconstruct(labels, goal, 5).collect()
    assert len(j) == 1 and j[0].transfers == 4 and [x.trip_id for x in j[0].legs] == [0, 1, 2, 3, 4]


def test_journeys_replay_and_walk(spark):
    trips = events(spark, {1: [(1, 28800, 28800), (2, 29400, 29430), (3, 30000, 30000)], 2: [(4, 29700, 29700), (5, 30300, 30300)]})
    walks = spark.createDataFrame([(2, 4, 90), (4, 2, 90)], "from_stop long, to_stop long, duration_s int")
    labels = router.rounds(start(spark, 1, 28700), trips, walks, 3)
    j = router.reconstruct(labels, spark.createDataFrame([(1, 5)], "query_id long, stop_id long"), 3).first()
    assert [(x.kind, x.from_stop, x.to_stop) for x in j.legs] == [("ride", 1, 2), ("walk", 2, 4), ("ride", 4, 5)]
    assert (j.departure_s, j.arrival_s, j.transfers, j.walk_legs) == (28800, 30300, 1, 1)


def test_delay_breaks_a_transfer(spark):
    m = lambda h, n: h * 3600 + n * 60
    base = {1: [(1, m(8, 0), m(8, 0)), (2, m(8, 10), m(8, 10))], 2: [(2, m(8, 15), m(8, 15)), (3, m(8, 30), m(8, 30))], 3: [(2, m(8, 30), m(8, 30)), (3, m(8, 45), m(8, 45))]}
    assert best(router.rounds(start(spark, 1, m(7, 55)), events(spark, base), None, 3), 3) == m(8, 30)
    late = spark.createDataFrame([(1, dt.datetime(2024, 1, 1), 1, 1, False, False, 600, False)], "event_id long, ts timestamp, trip_id long, off long, canceled boolean, skipped boolean, delay_s long, is_vehicle boolean")
    live = realtime.with_realtime(events(spark, base), realtime.stop_updates(late), realtime.trip_delay(late))
    live = live.select("trip_id", "off", "stop_id", F.col("rt_arrival_s").alias("arrival_s"), F.col("rt_departure_s").alias("departure_s"), "pickup_type", "drop_off_type")
    assert best(router.rounds(start(spark, 1, m(7, 55)), live, None, 3), 3) == m(8, 45)


def test_trip_based_search_equals_rounds_on_fifo_lines(spark):
    rng = np.random.default_rng(3)
    trips = {}
    for line in range(6):
        stops = rng.permutation(12)[:5]
        for run in range(4):
            t = 28800 + int(rng.integers(0, 600)) + run * 900
            trips[line * 10 + run] = [(int(s), t + 300 * k, t + 300 * k) for k, s in enumerate(stops)]
    ev = events(spark, trips).cache()
    lines = spark.createDataFrame([(t, t // 10) for t in trips], "trip_id long, line long")
    tr = timetable.trip_transfers(ev, lines)
    a = {(r.stop_id): r.arr for r in router.trip_rounds(start(spark, 0, 28800), ev, tr, 4).collect()}
    b = {(r.stop_id): r.arr for r in router.earliest(router.rounds(start(spark, 0, 28800), ev, None, 4)).collect() if r.stop_id != 0}
    a.pop(0, None)
    assert a == b


def test_frequency_windows(spark):
    rows = spark.createDataFrame([(1, 21600, 43200, 600), (2, 30000, 40000, 900), (3, 10000, 20000, 300), (4, 28000, 28801, 801)], "trip_id int, start_s int, end_s int, headway_s int")
    assert {r.trip_id: r.board_s for r in departures.frequency_boarding(rows, 28900).collect()} == {1: 29400, 2: 30000}


def test_wheelchairs_and_pathways(spark):
    rows = spark.createDataFrame([(2, 60, None), (5, 90, None), (1, None, 24.0), (1, None, float("nan")), (9, None, None)], "mode int, t int, l double")
    s = timetable.pathway_seconds(F.col("t"), F.col("l"))
    got = rows.select(timetable.wheelchair_seconds(s, F.col("mode")).alias("s"), timetable.pathway_mode(F.col("mode")).alias("m")).collect()
    assert [r.s for r in got] == [6000, 90, 20, 60, 60] and got[4].m == "UNKNOWN"


def test_interpolation_weights(spark):
    schema = "trip_id int, off int, arrival_s int, departure_s int, shape_dist double, lat double, lon double"
    rows = [(1, 0, 0, 0, 0.0, 0.0, 0.0), (1, 1, None, None, 1.0, 0.0, 0.5), (1, 2, 400, 400, 4.0, 0.0, 1.0)]
    rows += [(2, 0, 0, 0, 0.0, 0.0, 0.0), (2, 1, None, None, None, 0.0, 0.25), (2, 2, 400, 400, 4.0, 0.0, 1.0)]
    rows += [(3, 0, 0, 0, None, None, None), (3, 1, None, None, None, None, None), (3, 2, 401, 401, None, None, None), (4, 0, None, None, 0.0, 0.0, 0.0), (4, 1, 5, 5, 1.0, 0.0, 0.0)]
    got = {(r.trip_id, r.off): r.arrival_s for r in timetable.interpolate(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1, 1], got[2, 1], got[3, 1]) == (100, 100, 201) and (4, 1) not in got


def test_grid_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [(k, float(48.8 + rng.random() * 0.05), float(2.2 + rng.random() * 0.05)) for k in range(150)]
    stops = spark.createDataFrame(pts, "stop_id long, lat double, lon double")

    def d(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(x))

    want = {(a[0], b[0]) for a in pts for b in pts if a != b and 1 < d(a, b) <= 600}
    assert {(r.from_stop, r.to_stop) for r in spatial.hub_links(stops, 600).collect()} == want
    edges = walking.walk_graph(stops.withColumn("parent_id", F.lit(None).cast("long")), 600)
    assert edges.count() == len(want) and edges.agg(F.min("duration_s")).first()[0] >= 75


def test_fares(spark):
    attributes = spark.createDataFrame([(1, 2.0, "EUR", 1, 5400), (2, 1.5, "EUR", 0, 5400), (3, 9.0, "EUR", None, None), (4, 1.0, "EUR", None, 100)], "fare_id long, price double, currency string, transfers int, duration_s long")
    rules = spark.createDataFrame([(1, 7, None, None, None), (2, None, None, None, None), (3, 7, 1, None, None), (4, None, None, None, 5)], "fare_id long, route_id long, origin_id long, destination_id long, contains_id long")
    legs = spark.createDataFrame([(1, 1, 7, 2, 2, 0), (1, 2, 7, 2, 2, 600), (1, 3, 7, 2, 2, 1200), (2, 1, 8, 1, 1, 0), (3, 1, 7, 1, 1, 0), (4, 1, 8, 5, 1, 0), (4, 2, 8, 1, 5, 100), (4, 3, 8, 5, 5, 101)], "journey_id long, leg int, route_id long, origin_id long, destination_id long, board_s long")
    priced = fares.best_fares(legs, rules, attributes)
    assert {(r.journey_id, r.leg): r.fare_id for r in priced.collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (2, 1): 2, (3, 1): 3, (4, 1): 4, (4, 2): 4, (4, 3): 4}
    got = {r.journey_id: (r.price, r.tickets) for r in fares.journey_fares(priced).collect()}
    assert got == {1: (4.0, 2), 2: (1.5, 1), 3: (9.0, 1), 4: (2.0, 2)}
    open_leg = priced.select("journey_id", "leg", "board_s", "fare_id", "price", "currency", "transfers", "duration_s").union(spark.createDataFrame([(1, 9, 99, None, None, None, None, None)], "a long, b int, c long, d long, e double, f string, g int, h long"))
    assert {r.journey_id: r.price for r in fares.journey_fares(open_leg).collect()}[1] is None


def test_references(spark):
    trips = spark.createDataFrame([("L", 1, 85500), ("L", 2, 28800), ("L", 3, 28900)], "line string, trip_id long, dep_s long")
    asks = spark.createDataFrame([("a", "L", 28790), ("b", "L", 28850), ("c", "L", 85600), ("d", "M", 28800), ("e", "L", 60000)], "ref string, line string, at_s long")
    assert {r.ref: r.trip_id for r in resolve.by_time(asks, trips).collect()} == {"a": 2, "b": 2, "c": 1}
    names = spark.createDataFrame([(1, "net:abc123456"), (2, "net:xbc123456"), (3, "net:zzz999999")], "trip_id long, name string")
    tails = spark.createDataFrame([("p", "c123456"), ("q", "abc123456"), ("r", "99")], "ref string, tail string")
    assert {r.ref: r.trip_id for r in resolve.by_tail(tails, names).collect()} == {"q": 1}
    found = resolve.cascade(tails.withColumn("candidates", F.array("tail")), [("key", lambda left: resolve.by_keys(left, spark.createDataFrame([("99", 7)], "key string, trip_id long"))), ("tail", lambda left: resolve.by_tail(left.select("ref", "tail"), names))])
    assert {(r.ref, r.trip_id, r.step) for r in found.collect()} == {("r", 7, "key"), ("q", 1, "tail")}


def test_alert_texts(spark):
    one = lambda col: spark.range(1).select(col.alias("x")).first().x
    assert one(text.clean_html(F.lit("<p>A&amp;B&nbsp; &lt;b&gt;c</p>\n d"))) == "A&B c d"
    pick = lambda *t: one(text.pick_translation(F.array(*(F.struct(F.lit(a).alias("lang"), F.lit(b).alias("text")) for a, b in t))))
    assert pick(("de", "Hitze"), ("fr", "Chaleur"), ("en", "Heat")) == "Chaleur"
    assert pick(("de", "Hitze"), ("es", "Calor")) == "Calor" and pick(("de", "Hitze")) == "Hitze"
    assert one(text.place_key(F.lit("Gare d'Aulnay-sous-Bois RER"))) == "aulnay sous bois"
    assert one(text.fold_accents(F.lit("Œuvre À l'été"))) == "OEuvre A l'ete"
    split = one(text.split_number(F.lit("12 bis Rue de Rivoli")))
    assert (split.num, split.rep, split.street) == ("12", "bis", "rue de rivoli")
    assert one(text.expand_street(F.lit("bd haussmann"))) == "boulevard haussmann"
    assert one(geo.contrast_text(F.lit("#ffcd00"))) == "000000" and one(geo.contrast_text(F.lit("003ca6"))) == "FFFFFF"
    rows = spark.createDataFrame([(1, "H", "same body"), (2, "h ", "Same body"), (3, None, None)], "alert_id int, header string, description string")
    assert [r.alert_id for r in alerts.deduplicated(rows).collect()] == [1]


def test_address_search(spark):
    rows = [(k, n, s, "75001", "Paris", 48.0, 2.0) for k, (n, s) in enumerate([(12, "Rue de Rivoli"), (14, "Rue de Rivoli"), (5, "Boulevard Haussmann"), (3, "Rue Haute"), (8, "Avenue Gambetta")])]
    table = spark.createDataFrame(rows, "address_id long, num int, street string, postcode string, city string, lat double, lon double")
    asks = spark.createDataFrame([("12 rue de rivoli",), ("bd hausman",), ("rivolli",), ("99 rivoli",), ("paris",)], "query string")
    got = {(r.query, r.rank): (r.kind, r.label) for r in search.address_suggest(table, asks).collect()}
    assert got["12 rue de rivoli", 1] == ("address", "12 Rue de Rivoli 75001 Paris")
    assert got["bd hausman", 1] == ("street", "Boulevard Haussmann 75001 Paris") and got["rivolli", 1][1].startswith("Rue de Rivoli")
    assert got["99 rivoli", 1][0] == "street" and ("paris", 1) in got


def test_vehicle_estimates(spark):
    rows = spark.createDataFrame([(1, 0, 1, 0, 100), (1, 1, 2, 200, 230), (2, 0, 1, 0, 60), (2, 1, 2, 1000, 1000), (3, 0, 1, 900, 950)], "trip_id long, off long, stop_id long, rt_arrival_s long, rt_departure_s long")
    stops = spark.createDataFrame([(1, 48.0, 2.0), (2, 49.0, 2.0)], "stop_id long, lat double, lon double")
    at = lambda now: {r.trip_id: (r.state, round(r.lat, 3)) for r in realtime.vehicle_estimate(rows, now, stops).collect()}
    assert at(150) == {1: ("UNDER_WAY", 48.5), 2: ("UNDER_WAY", round(48 + 90 / 940, 3))}
    assert at(220)[1] == ("STOPPED_AT", 49.0) and at(195)[1][0] == "INCOMING_AT"


def test_shapes(spark):
    lat, lon = np.array([48.0, 48.01, 48.02, 48.01, 48.0]), np.full(5, 2.0)
    assert shapes.monotone(lat, lon, np.array([48.0, 48.01, 48.02, 48.01, 48.0]), np.full(5, 2.0)) == [0, 1, 2, 3, 4]
    total = np.cumsum(shapes.metres(lat, lon))
    y, _ = shapes.along(lat, lon, total[0], total[2], 0.5)
    assert round(y, 4) == 48.01 and shapes.along(lat, lon, 5.0, 5.2, 0.5) is None
    assert shapes.snapped_unit(980.0) == 1000.0 and shapes.snapped_unit(0.31) == 0.3048 and shapes.snapped_unit(50.0) == 50.0
    assert shapes.simplified([(0, 0), (1, 0.001), (2, 0), (2, 2)], 0.01) == [(0, 0), (2, 0), (2, 2)]
    line = spark.createDataFrame([("s", [(48.0, 2.0), (48.01, 2.0), (48.02, 2.0)])], "shape_id string, points array<struct<lat:double,lon:double>>")
    assert shapes.shape_distances(line).agg(F.round(F.max("total_m"))).first()[0] == round(total[2])
    assert len(shapes.simplify(line, 1e-6).first().points) == 2
    trips = line.select(F.lit("t").alias("trip_id"), "points", F.col("points").alias("stops"))
    assert shapes.stop_vertices(trips).first().vertices == [0, 1, 2]
    assert line.select(F.size(shapes.sliced(F.col("points"), F.lit(1), F.lit(2))).alias("n")).first().n == 2


def test_cells_flags_and_store(spark, tmp_path):
    stops = spark.createDataFrame([(k, 48 + k * 0.01, 2 + (k * 7 % 16) * 0.01) for k in range(16)], "stop_id long, lat double, lon double")
    cells = preprocess.cells(stops, 2)
    assert sorted(r["count"] for r in cells.groupBy("cell").count().collect()) == [4, 4, 4, 4]
    trips = events(spark, {k: [(k, 28800 + k * 900, 28800 + k * 900), (k + 1, 29400 + k * 900, 29400 + k * 900)] for k in range(6)})
    flags = preprocess.arc_flags(start(spark, 0, 28800), trips, None, cells, 4)
    words = preprocess.flag_words(flags)
    assert {r.trip_id for r in words.collect()} == {0, 1, 2, 3} and preprocess.broken(flags, trips).count() == 0
    mark = preprocess.fingerprint([trips, stops])
    assert mark == preprocess.fingerprint([stops.repartition(3), trips.repartition(2)]) and mark != preprocess.fingerprint([stops])
    made = []
    for _ in range(2):
        kept = preprocess.stored("flags", str(tmp_path), mark, lambda: made.append(1) or words)
    assert len(made) == 1 and kept.count() == 4


def test_state_stream(spark, tmp_path):
    from stopwise.streaming import state

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "feed_id string, kind string, key string, ts timestamp, generation long, payload string"
    t = lambda m: dt.datetime(2024, 1, 15, 8, m)
    batches = [[("f", "trip", "a", t(0), 1, "1"), ("f", "trip", "b", t(1), 1, "1"), ("f", "trip", "a", t(2), 1, "2")], [("f", "trip", "b", t(5), 2, "9"), ("f", "vehicle", "v", t(5), 1, "x")]]
    source, out = tmp_path / "in", tmp_path / "out"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{source}/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(source))
        state.publish(state.upserts(stream), str(out)).trigger(availableNow=True).start().awaitTermination(120)
    changes = spark.read.option("basePath", str(out)).parquet(*[str(p) for p in out.iterdir() if p.name.startswith("version=")])
    view = {(r.kind, r.key): r.payload for r in state.live_view(changes).collect()}
    assert view == {("trip", "b"): "9", ("vehicle", "v"): "x"}
    assert state.changed(changes, ["v"]).count() == 1


@pytest.mark.parametrize("mode", ["window", "dedupe"])
def test_streams_with_watermarks(spark, tmp_path, mode):
    from stopwise.streaming import state

    rows = [("f", dt.datetime(2024, 1, 15, 8, m), 60.0 * m, f"k{m % 2}") for m in range(4)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["feed_id", "ts", "delay_s", "merge_key"])).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("feed_id string, ts timestamp, delay_s double, merge_key string").parquet(f"{tmp_path}/in")
    out = state.delays_by_window(stream) if mode == "window" else state.deduplicated_alerts(stream)
    name = f"seen_{mode}"
    out.writeStream.format("memory").queryName(name).outputMode("append" if mode == "dedupe" else "complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table(name).count() == (2 if mode == "dedupe" else 3)
