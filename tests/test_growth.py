"""What keeps queries in bounds on large tables: how pairs are made, what is joined and sorted, how tasks are dealt."""

import itertools
import math

from pyspark.sql import functions as F

from stopwise.operators import access, alerts, dealing, fares, resolve, router, spatial, timetable, walking
from stopwise.plans import live, network
from stopwise.sources.derived import Network

FOLDER = "/root/testdata/sf0.001"
EVENTS = "trip_id long, off long, stop_id long, arrival_s long, departure_s long, pickup_type int, drop_off_type int"
STOPS = "stop_id long, parent_id long, lat double, lon double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def above_join(df):
    return plan(df).split("Join")[0]


def places(spark, rows):
    return spark.createDataFrame([(k, p, float(a), float(b)) for k, p, a, b in rows], STOPS)


def metres(a, b):
    (p, q), (r, s) = ((math.radians(x) for x in y) for y in (a, b))
    return 2 * 6_371_000.0 * math.asin(math.sqrt(math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2))


def test_trips_of_a_line_are_compared_without_a_join(spark):
    """a trip is one row; trips of two slots are compared too."""

    def line(trip, start, run, k):
        return [(trip, i, 10 * k + i, start + i * run, start + i * run + 5, 0, 0) for i in range(3)]

    rows = line(1, 890, 100, 1) + line(2, 910, 50, 1) + line(3, 890, 100, 2) + line(4, 910, 100, 2) + line(5, 880, 100, 2)
    df = timetable.fifo_lines(spark.createDataFrame(rows, EVENTS))
    assert "Join" not in plan(df)
    assert {(r.line_key, r.n_trips, r.fifo) for r in df.collect()} == {("10,11,12", 2, False), ("20,21,22", 3, True)}


def test_pairs_of_legs_and_alerts_are_not_compared(spark):
    """alerts are found for each kind of leg; a leg's own trip, both of its stops and its route may name one alert."""
    legs = spark.createDataFrame([(1, "7", "r", "a", "b"), (2, "8", "r", "a", "b"), (3, "9", "q", None, "b"), (4, "8", "z", "c", "c")], "leg_id long, trip_id string, route_id string, from_stop string, to_stop string")
    index = spark.createDataFrame([("trip", "7", 1), ("trip", "7", 2), ("route", "r", 2), ("stop", "a", 3), ("stop", "b", 3), ("route", "7", 9)], "kind string, key string, alert_id long")
    df = alerts.for_legs(legs, index)
    assert "Aggregate" not in above_join(df)
    assert sorted((r.leg_id, r.alert_id) for r in df.collect()) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)]


def test_descriptors_meet_the_least_trip_only(spark):
    """no pair of a reference and each live trip of its route."""
    asks = [(r, d, s) for r in ("net:1", "1", "far:1", None) for d in (None, 0, 1) for s in (None, "x", "y")]
    trips = [(k, *v) for k, v in enumerate((r, d, s) for r in ("net:1", "net:2", None) for d in (1, None, 0) for s in ("y", None, "x"))]
    refs = spark.createDataFrame([(k, *v) for k, v in enumerate(asks)], "ref long, route_id string, direction_id long, start_date string")
    df = resolve.by_descriptor(refs, spark.createDataFrame(trips, "trip_id long, route_id string, direction_id long, start_date string"))
    assert " OR " not in next(line for line in plan(df).splitlines() if "Join" in line)
    want = {}
    for ref, (route, d, s) in enumerate(asks):
        fits = [t for t, r, td, ts in trips if route and r and (r == route or r.split(":")[1] == route or r == route.split(":")[-1]) and d in (None, td) and s in (None, ts)]
        want |= {ref: min(fits)} if fits else {}
    assert {r.ref: r.trip_id for r in df.collect()} == want


def near_by_hand(points, stops, radius, k):
    out = set()
    for p, _, *at in points:
        found = sorted((round(d, 3), s) for s, _, *there in stops if (d := round(metres(at, there), 3)) <= radius)
        out |= {(p, s, n + 1) for n, (_, s) in enumerate(found[:k])}
    return out


def test_nearest_stops_are_ranked_by_position(spark):
    """many points and stops of one position are measured and ranked once."""
    at = [(48.8 + 0.003 * (k % 3), 2.2 + 0.004 * (k % 4)) for k in range(12)]
    stops = [(k, None, *at[k * 7 % 12]) for k in range(60)]
    points = [(k, None, *at[k * 5 % 12]) for k in range(40)]
    df = spatial.nearest(places(spark, points).withColumnRenamed("stop_id", "point_id"), places(spark, stops), 400.0, 4, digits=3)
    assert "Window" not in above_join(df)
    assert {(r.point_id, r.stop_id, r.rank) for r in df.collect()} == near_by_hand(points, stops, 400.0, 4)
    stars = walking.star_links(places(spark, stops), places(spark, points[:5]), 400.0, 4, digits=3)
    assert {(r.place_id, r.stop_id, r["rank"]) for r in stars.collect()} == {x for x in near_by_hand(points[:5], stops, 400.0, 4) if x[0] != x[1]}


def test_nearest_stops_are_ranked_by_what_is_shown(spark):
    """of distances that are one to the millimetre the least stop is first."""
    stops = [(2, None, 48.801, 2.2), (1, None, 48.801 + 1e-10, 2.2)]
    df = spatial.nearest(places(spark, [(9, None, 48.8, 2.2)]).withColumnRenamed("stop_id", "point_id"), places(spark, stops), 400.0, 2, digits=3)
    assert [(r.stop_id, r["rank"]) for r in df.orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_walks_take_the_time_of_whole_millimetres(spark):
    """120.0003 m are 120 m, and a hundred seconds."""
    rows = [(1, 1, 48.8, 2.2), (2, 2, 48.8 + math.degrees(120.0003 / 6_371_000.0), 2.2), (3, 1, 48.8005, 2.2)]
    df = walking.walk_graph(places(spark, rows), 500.0)
    assert "Aggregate" not in plan(df).split("Union")[0]
    got = {(r.from_stop, r.to_stop): r.duration_s for r in df.collect()}
    assert got[1, 2] == got[2, 1] == 100 and got[1, 3] == walking.SIBLING_S and len(got) == 6


def test_walks_are_made_from_reached_stops_only(spark):
    """The same labels as with all walks."""
    net = Network(spark, FOLDER)
    start = net.stops.where("stop_id in (0, 3)").select(F.col("stop_id").alias("query_id"), "stop_id", F.lit(28_800).alias("arr"))
    asked = []

    def walks(starts):
        asked.append({r.stop_id for r in starts.collect()})
        return walking.walk_graph(net.stops, 2_500.0, starts=starts)

    some, every = (router.rounds(start, network.day_events(net), w, 2) for w in (walks, walking.walk_graph(net.stops, 2_500.0)))
    labels = [sorted(map(str, df.collect())) for df in (some, every)]
    assert labels[0] == labels[1]
    rides = [{r.stop_id for r in some.where(f"round = {k} and kind = 'ride'").collect()} for k in (1, 2)]
    assert asked == rides


def test_rows_of_a_parent_are_not_compared(spark):
    """a query that holds two stops of a parent has each once, at no cost."""
    stops = places(spark, [(1, 9, 0, 0), (2, 9, 0, 0), (3, 9, 0, 0), (9, None, 0, 0), (4, None, 0, 0)])
    asks = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (3, 4), (4, 9), (4, 3)], "query_id long, stop_id long")
    df = access.of_stops(asks, stops)
    assert "Aggregate" not in plan(df).split("Union")[0]
    assert sorted((r.query_id, r.stop_id, r.duration_s) for r in df.collect()) == [(1, 1, 0), (1, 2, 0), (1, 3, 60), (2, 1, 60), (2, 2, 60), (2, 3, 60), (2, 9, 0), (3, 4, 0), (4, 1, 60), (4, 2, 60), (4, 3, 0), (4, 9, 0)]


def test_pairs_of_stops_are_dealt_by_their_number(spark, monkeypatch):
    """two positions with many stops are many tasks, and give each pair once."""
    monkeypatch.setattr(dealing, "ROWS_A_TASK", 200)
    at = [(48.8, 2.2), (48.802, 2.2)]
    stops = [(k, None, *at[k % 2]) for k in range(60)]
    df = spatial.hub_links(places(spark, stops), 500.0)
    assert df.rdd.getNumPartitions() >= 60 * 60 / 2 / 200
    assert sorted((r.from_stop, r.to_stop) for r in df.collect()) == [(a, b) for a, b in itertools.product(range(60), repeat=2) if (a - b) % 2]


def test_shortest_links_are_made_up_to_the_last_one(spark):
    """as all links in order; links beyond the distance that holds enough are not made."""
    stops = [(k, None, 48.8 + 0.001 * (k % 5) ** 2, 2.2 + 0.0013 * (k % 3)) for k in range(45)]
    every = sorted((d, a, b) for a, _, *x in stops for b, _, *y in stops if a < b and 1 < metres(x, y) <= 900 and (d := round(metres(x, y), 3)))
    for k in (1, 9, 10, 40, 5000):
        got = [(r.distance_m, r.from_stop, r.to_stop) for r in spatial.shortest_links(places(spark, stops), 900.0, k).collect()]
        assert got == every[:k]


def test_legs_are_ordered_once_for_their_fares(spark):
    """no second reading of the legs to bring fares to those without one."""
    text = plan(live.journey_fare(Network(spark, FOLDER)))
    assert text.count("Window [") == 1


def test_fares_are_found_for_kinds_of_legs(spark):
    """Legs are not multiplied by the rules' keys nor put together again; those without route or zone have fares too."""
    legs = spark.createDataFrame([(1, 5, 1, 2), (2, None, 1, 2), (3, 5, None, 2), (4, 6, 1, 3)], "leg long, route_id long, origin_id long, destination_id long")
    rules = spark.createDataFrame([(10, 5, None, None, None), (11, None, None, 2, None), (12, None, None, None, 2)], "fare_id long, route_id long, origin_id long, destination_id long, contains_id long")
    prices = spark.createDataFrame([(10, 3.0), (11, 2.0), (12, 1.0)], "fare_id long, price double")
    prices = prices.select("fare_id", "price", F.lit("EUR").alias("currency"), F.lit(0).alias("transfers"), F.lit(0).alias("duration_s"))
    df = fares.best_fares(legs, rules, prices)
    assert "Aggregate" not in plan(df) and "Generate" not in plan(df)
    assert {r.leg: r.fare_id for r in df.collect()} == {1: 10, 2: 11, 3: 10}
    assert {r.leg: r.fare_id for r in fares.best_fares(legs, rules, prices, unpriced=True).collect()} == {1: 10, 2: 11, 3: 10, 4: None}


def test_names_are_brought_down_before_they_are_joined(spark):
    """parts that several trips have find nothing, whether of one name or of several."""
    names = spark.createDataFrame([(1, "T00123456"), (2, "T00777777"), (3, "T00777777"), (4, "T11123499"), (5, "T22123499")], "trip_id long, name string")
    refs = spark.createDataFrame([("a", "123456"), ("b", "777777"), ("c", "123499"), ("d", "1123499"), ("e", "T0012345"), ("f", "T0077777")], "ref string, tail string")
    df = resolve.by_tail(refs, names)
    assert "count(distinct" not in plan(df)
    assert {r.ref: r.trip_id for r in df.collect()} == {"a": 1, "d": 4, "e": 1}


def test_equal_trips_are_one_run(spark, tmp_path):
    """trips with the same stops, times and windows are routed once, as the least of them."""
    orders, days = spark.read.parquet(f"{FOLDER}/orders.parquet"), 68_400 * 150
    for name in ("supplier", "events"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    orders.union(orders.withColumn("o_orderkey", F.col("o_orderkey") + days)).write.parquet(f"{tmp_path}/orders.parquet")
    one, two = Network(spark, FOLDER), Network(spark, str(tmp_path))
    assert network.day_events(two).count() == 2 * network.day_events(one).count()
    for with_windows in (False, True):
        runs = [sorted(map(str, network.day_runs(net, net.frequencies if with_windows else None).collect())) for net in (one, two)]
        assert runs[0] == runs[1]
    start = one.stops.where("stop_id in (0, 3)").select(F.col("stop_id").alias("query_id"), "stop_id", F.lit(28_800).alias("arr"))
    labels = [sorted(map(str, router.rounds(start, events, None, 2).collect())) for events in (network.day_events(two), network.day_runs(two))]
    assert labels[0] == labels[1]


def test_stops_of_a_trip_are_sorted_once(spark):
    """weights of a gap come from counts along the trip."""
    rows = [(1, k, a, a, s, None, None) for k, (a, s) in enumerate([(0, 0.0), (None, 3.0), (None, 4.0), (100, 10.0), (None, 9.0), (None, 12.0), (200, 14.0), (None, 16.0), (None, 15.0), (300, 20.0), (None, 25.0), (400, 24.0)])]
    df = timetable.interpolate(spark.createDataFrame(rows, "trip_id long, off long, arrival_s long, departure_s long, shape_dist double, lat double, lon double"))
    assert df._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert [r.arrival_s for r in df.orderBy("off").collect()] == [0, 30, 40, 100, 133, 167, 200, 233, 267, 300, 350, 400]


def test_no_frame_of_references_in_time_reaches_to_the_end(spark):
    """such a frame is gone through anew for each row, which grows with the square of the references of a line and slot."""
    runs = spark.createDataFrame([(1, 10, 1000), (1, 11, 3000), (1, 12, 3000), (1, 13, 4000)], "line long, trip_id long, dep_s long")
    asks = [(1, 1000), (2, 1030), (3, 1890), (4, 1950), (5, 2990), (6, 3000), (7, 3100), (8, 3500), (9, 3501), (10, 4899), (11, 4901), (12, 99)]
    df = resolve.by_time(spark.createDataFrame([(r, 1, t) for r, t in asks], "ref long, line long, at_s long"), runs)
    assert "unboundedfollowing" not in plan(df)
    assert {r.ref: r.trip_id for r in df.collect()} == {1: 10, 2: 10, 3: 10, 5: 11, 6: 11, 9: 13, 10: 13}


def test_steps_of_a_cascade_run_once(spark):
    """what a step found is not looked for again by the steps after it."""
    refs = spark.createDataFrame([(k,) for k in range(9)], "ref long")
    ran = spark.sparkContext.accumulator(0)

    def step(n):
        def seen(k):
            ran.add(1)
            return k

        return lambda left: left.where(F.col("ref") % 4 == n).select(F.udf(seen, "long")("ref").alias("ref"), F.col("ref").alias("trip_id"))

    df = resolve.cascade(refs, [(str(n), step(n)) for n in range(3)])
    assert sorted((r.ref, r.step) for r in df.collect()) == sorted((k, str(k % 4)) for k in range(9) if k % 4 < 3)
    assert ran.value == 7 and "Join" not in plan(df)
