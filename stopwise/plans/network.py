"""Queries over the timetable, the calendar and the walk graph, each with its SQL counterpart."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, timeutil
from ..lineage import cut
from ..operators import calendar, departures, spatial, timetable, walking
from ..sources.derived import Network, with_views

DAY, AT_S, RADIUS = dt.date(2024, 1, 15), 28_800, 2_500.0
ORIGINS = (0, 3, 7)
QUERIES, SQL = {}, {}

HAVERSINE = "2 * 6371000.0::double * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


def query(sql: str | None = None, views: bool = True):
    """Register a query of (network) under its function's name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql) if views else sql
        return f

    return register


def active(net: Network) -> DataFrame:
    return calendar.active_services(net.services, net.calendar_dates, DAY)


def day_events(net: Network) -> DataFrame:
    """Stop events of the day's trips: services are filtered before the events are made."""
    return net.events_of(net.trips.join(active(net), "service_id", "left_semi"))


def day_runs(net: Network, frequencies: DataFrame | None = None) -> DataFrame:
    """Stop events of the day's distinct runs, for routing that asks nothing else of a trip: of trips with the same stops, times and headway windows the least.

    Equal trips reach the same stops at the same times, and of equal arrivals the router takes the least trip, so that the others change no label.
    """
    trips = net.trips.join(active(net), "service_id", "left_semi").select("trip_id", "pattern_id", "first_dep_s")
    if frequencies is None:
        return net.events_of(cut(net.runs_of(trips)))
    windows = frequencies.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("start_s", "end_s", "headway_s"))).alias("windows"))
    return net.events_of(cut(net.runs_of(trips.join(windows, "trip_id", "left"), "windows").drop("windows")))


@query("select stop_id, trip_id, route_id, off, departure_s from stop_times join trips using (trip_id) where service_id in (from active) and pickup_type <> 1 and departure_s >= 28800 and stop_id in (0, 3, 7) order by departure_s, trip_id, off, stop_id limit 50")
def departures_board(net: Network) -> DataFrame:
    wanted = net.stops.where(F.col("stop_id").isin(*ORIGINS)).select("stop_id")
    return departures.board(day_events(net), active(net), wanted, AT_S, 50)


@query("select stop_id, rank::int as rank, trip_id, route_id, off, departure_s from (select *, row_number() over (partition by stop_id order by departure_s, trip_id, off) as rank from stop_times join trips using (trip_id) where service_id in (from active) and pickup_type <> 1 and departure_s >= 28800) where rank <= 5")
def departures_all_stops(net: Network) -> DataFrame:
    return departures.next_by_stop(day_events(net), active(net), AT_S, 5)


@query("select service_id from active")
def active_services(net: Network) -> DataFrame:
    return active(net)


@query("""
with days as (select service_id, cast(unnest(generate_series(greatest(start_date, date '2024-01-10'), least(end_date, date '2024-01-24'), interval 1 day)) as date) as date, days from services)
select service_id, date from (select service_id, date from days where days & (1 << (isodow(date) - 1)) > 0 union select service_id, date from calendar_dates where exception_type = 1 and date between date '2024-01-10' and date '2024-01-24')
where (service_id, date) not in (select (service_id, date) from calendar_dates where exception_type = 2)""")
def services_in_range(net: Network) -> DataFrame:
    return calendar.services_in_range(net.services, net.calendar_dates, dt.date(2024, 1, 10), dt.date(2024, 1, 24))


@query("""
with q as (select event_id as query_id, floor(epoch(ts))::bigint as epoch_s, cast(ts + interval 1 hour as date) as today from events),
both_days as (select query_id, epoch_s, today, today as service_date from q union all select query_id, epoch_s, today, cast(today - 1 as date) from q),
anchored as (select *, epoch_s - (epoch(service_date::timestamp)::bigint - 3600) as since_s from both_days)
select query_id, service_date, since_s from anchored where service_date = today or since_s <= (select max(greatest(arrival_s, departure_s)) from stop_times)""")
def service_day_passes(net: Network) -> DataFrame:
    asks = net.raw("events").select(F.col("event_id").alias("query_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch_s"))
    latest = net.stop_times.agg(F.max(F.greatest("arrival_s", "departure_s"))).first()[0]
    return calendar.service_passes(asks, latest)


@query("""
with t as (select o_orderkey, lpad((o_orderkey % 80)::varchar, 1 + (o_orderkey % 3)::int, '0') || ':' || lpad((o_orderkey % 67)::varchar, 2, '0') || ':' || lpad((o_orderkey % 61)::varchar, 2, '0') as text from orders)
select o_orderkey, text, case when regexp_matches(text, '^[0-9]{1,3}:[0-9]{2}:[0-9]{2}$') and split_part(text, ':', 1)::int <= 72 and split_part(text, ':', 2)::int < 60 and split_part(text, ':', 3)::int < 60
then split_part(text, ':', 1)::int * 3600 + split_part(text, ':', 2)::int * 60 + split_part(text, ':', 3)::int end as seconds from t""", views=False)
def gtfs_time_parse(net: Network) -> DataFrame:
    o = F.col("o_orderkey")
    two = [F.lpad((o % n).cast("string"), 2, "0") for n in (67, 61)]
    hours = F.expr("lpad(cast(o_orderkey % 80 as string), cast(1 + o_orderkey % 3 as int), '0')")
    rows = net.raw("orders").select("o_orderkey", F.concat_ws(":", hours, *two).alias("text"))
    return rows.withColumn("seconds", timeutil.gtfs_seconds(F.col("text")))


@query("""
with t as (select o_orderkey, strftime(o_orderdate, '%Y%m%d') || case when o_orderkey % 7 = 0 then '9' else '' end as text, o_orderdate from orders)
select o_orderkey, text, case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) end as day from t""", views=False)
def gtfs_date_parse(net: Network) -> DataFrame:
    rows = net.raw("orders").select("o_orderkey", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.when(F.col("o_orderkey") % 7 == 0, "9").otherwise("")).alias("text"))
    return rows.withColumn("day", timeutil.gtfs_date(F.col("text")))


@query("select distinct cast(ts as date) as day, epoch(cast(ts as date)::timestamp)::bigint - 3600 as anchor_s from events", views=False)
def service_anchor(net: Network) -> DataFrame:
    days = net.raw("events").select(F.to_date("ts").alias("day")).distinct()
    return days.withColumn("anchor_s", timeutil.anchor_epoch(F.col("day")))


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, (row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1)::int as off from lineitem", views=False)
def stop_offsets(net: Network) -> DataFrame:
    rows = timetable.with_offsets(net.raw("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "off")


@query("select * from (select trip_id, off, stop_id as from_stop, lead(stop_id) over w as to_stop, lead(arrival_s) over w - departure_s as run_s from stop_times window w as (partition by trip_id order by off)) where to_stop is not null")
def trip_links(net: Network) -> DataFrame:
    return timetable.links(net.stop_times)


@query(f"""
with pairs as (select t.trip_id, t.off, s.lat, s.lon, lag(s.lat) over w as plat, lag(s.lon) over w as plon from stop_times t join stops s using (stop_id) window w as (partition by trip_id order by off)),
legs as (select a.trip_id, a.off, coalesce(round({HAVERSINE.format(a="p", b="a")}), 0)::bigint as leg_m from pairs a join (select trip_id, off, plat as lat, plon as lon from pairs) p using (trip_id, off))
select trip_id, off, leg_m, (sum(leg_m) over (partition by trip_id order by off))::bigint as total from legs""")
def running_distance(net: Network) -> DataFrame:
    from pyspark.sql import Window as W

    rows = net.stop_times.select("trip_id", "off", "stop_id").join(net.stops.select("stop_id", "lat", "lon"), "stop_id")
    w = W.partitionBy("trip_id").orderBy("off")
    leg = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    rows = rows.select("trip_id", "off", F.coalesce(F.round(leg), F.lit(0)).cast("long").alias("leg_m"))
    return timetable.running_distance(rows, F.col("leg_m"))


@query("""
with blank as (select trip_id, off, case when (trip_id + off) % 3 = 0 and off not in (0, 7) then null else arrival_s end as a, case when (trip_id + off) % 3 = 0 and off not in (0, 7) then null else departure_s end as d from stop_times),
around as (select *, last_value(case when a is not null then off end ignore nulls) over (partition by trip_id order by off) as lo, last_value(d ignore nulls) over (partition by trip_id order by off) as ld,
first_value(case when a is not null then off end ignore nulls) over (partition by trip_id order by off rows between current row and unbounded following) as ho, first_value(a ignore nulls) over (partition by trip_id order by off rows between current row and unbounded following) as ha from blank)
select trip_id, off, coalesce(a, round(ld + (off - lo)::double / (ho - lo) * (ha - ld)))::int as arrival_s, coalesce(d, round(ld + (off - lo)::double / (ho - lo) * (ha - ld)))::int as departure_s, (a is not null)::int as timepoint from around""")
def stop_time_interpolation(net: Network) -> DataFrame:
    gone = ((F.col("trip_id") + F.col("off")) % 3 == 0) & ~F.col("off").isin(0, 7)
    nothing = F.lit(None).cast("double")
    rows = net.stop_times.select("trip_id", "off", *(F.when(~gone, F.col(c)).alias(c) for c in ("arrival_s", "departure_s")), *(nothing.alias(c) for c in ("shape_dist", "lat", "lon")))
    return timetable.interpolate(rows).select("trip_id", "off", "arrival_s", "departure_s", "timepoint")


@query("select distinct p_size * 20 as route_type, case when p_size * 20 between 100 and 199 then 'RAIL' when p_size * 20 between 200 and 299 then 'BUS' when p_size * 20 between 400 and 499 then 'METRO' when p_size * 20 between 700 and 799 then 'BUS' when p_size * 20 between 900 and 999 then 'TRAM' else 'OTHER' end as mode from part where p_size > 1", views=False)
def route_mode(net: Network) -> DataFrame:
    rows = net.raw("part").where("p_size > 1").select((F.col("p_size") * 20).alias("route_type")).distinct()
    return rows.withColumn("mode", timetable.route_mode(F.col("route_type")))


@query("select s_suppkey, (s_suppkey % 3 = 1 or (s_suppkey % 3 = 0 and s_suppkey % 2 = 0)) as station from supplier", views=False)
def station_flag(net: Network) -> DataFrame:
    k = F.col("s_suppkey")
    return net.raw("supplier").select(k, timetable.is_station(k % 3, F.when(k % 2 == 1, k)).alias("station"))


PATHWAYS_SQL = """
paths as (select p_partkey as path_id, (1 + p_partkey % 7)::int as mode, case when p_partkey % 3 = 0 then p_size end as traversal_s, case when p_partkey % 3 = 1 then p_retailprice / 10 end as length_m from part)"""


def _paths(net: Network) -> DataFrame:
    k = F.col("p_partkey")
    return net.raw("part").select(k.alias("path_id"), (1 + k % 7).cast("int").alias("mode"), F.when(k % 3 == 0, F.col("p_size")).alias("traversal_s"), F.when(k % 3 == 1, F.col("p_retailprice") / 10).alias("length_m"))


NAMES_SQL = "case mode when 1 then 'WALKWAY' when 2 then 'STAIRS' when 3 then 'MOVING_SIDEWALK' when 4 then 'ESCALATOR' when 5 then 'ELEVATOR' when 6 then 'FARE_GATE' when 7 then 'EXIT_GATE' else 'UNKNOWN' end"


@query(f"with {PATHWAYS_SQL} select path_id, {NAMES_SQL} as mode_name, coalesce(traversal_s, ceil(length_m / 1.2::double)::int, 60) as seconds from paths", views=False)
def pathway_cost(net: Network) -> DataFrame:
    return _paths(net).select("path_id", timetable.pathway_mode(F.col("mode")).alias("mode_name"), timetable.pathway_seconds(F.col("traversal_s"), F.col("length_m")).alias("seconds"))


@query(f"with {PATHWAYS_SQL} select path_id, coalesce(traversal_s, ceil(length_m / 1.2::double)::int, 60) * case when mode in (2, 4) then 100 else 1 end as seconds from paths", views=False)
def wheelchair_cost(net: Network) -> DataFrame:
    seconds = timetable.pathway_seconds(F.col("traversal_s"), F.col("length_m"))
    return _paths(net).select("path_id", timetable.wheelchair_seconds(seconds, F.col("mode")).alias("seconds"))


def _agencies(net: Network) -> DataFrame:
    return net.raw("region").select(F.col("r_regionkey").cast("long").alias("agency_id"), F.col("r_name").alias("agency_name"))


@query("""
with routes as (select n_nationkey::bigint as route_id, n_name as route_name, case when n_nationkey % 6 = 5 then null else n_regionkey::bigint end as agency_id from nation)
select t.trip_id, t.route_id, r.route_name, r.agency_id, g.r_name as agency_name from trips t left join routes r using (route_id) left join region g on g.r_regionkey = r.agency_id""")
def trip_denorm(net: Network) -> DataFrame:
    k = F.col("n_nationkey")
    routes = net.raw("nation").select(k.cast("long").alias("route_id"), F.col("n_name").alias("route_name"), F.when(k % 6 != 5, F.col("n_regionkey")).cast("long").alias("agency_id"))
    return timetable.denormalised(net.trips.select("trip_id", "route_id"), routes, _agencies(net)).select("trip_id", "route_id", "route_name", "agency_id", "agency_name")


@query("select r_regionkey::bigint as agency_id, r_name as agency_name from region", views=False)
def agencies(net: Network) -> DataFrame:
    return _agencies(net).orderBy("agency_id")


LINKS_SQL = f"links as (select a.stop_id as from_stop, b.stop_id as to_stop, round({HAVERSINE.format(a='a', b='b')}, 3) as distance_m from stops a join stops b on a.stop_id <> b.stop_id where {HAVERSINE.format(a='a', b='b')} between 1.0000001 and {RADIUS})"


@query(f"with {LINKS_SQL} from links")
def hub_links(net: Network) -> DataFrame:
    return spatial.hub_links(net.stops, RADIUS).withColumn("distance_m", F.round("distance_m", 3))


@query(f"with d as (select p.address_id as point_id, s.stop_id, round({HAVERSINE.format(a='p', b='s')}, 3) as distance_m from addresses p, stops s) select point_id, stop_id, distance_m, rank::int as rank from (select *, row_number() over (partition by point_id order by distance_m, stop_id) as rank from d where distance_m <= {RADIUS}) where rank <= 3")
def near_stops(net: Network) -> DataFrame:
    points = net.addresses.select(F.col("address_id").alias("point_id"), "lat", "lon")
    return spatial.nearest(points, net.stops, RADIUS, 3, digits=3)


@query(f"with d as (select a.stop_id as place_id, b.stop_id, round({HAVERSINE.format(a='a', b='b')}, 3) as distance_m from stops a, stops b where a.wheelchair = 1), ranked as (select *, row_number() over (partition by place_id order by distance_m, stop_id) as rank from d where distance_m <= 5000) select place_id, stop_id, distance_m, rank::int as rank from ranked where rank <= 4 and place_id <> stop_id")
def place_star_links(net: Network) -> DataFrame:
    return walking.star_links(net.stops, net.stops.where("wheelchair = 1"), 5000.0, 4, digits=3)


SIBLINGS_SQL = "siblings as (select a.stop_id as from_stop, b.stop_id as to_stop, 120 as duration_s, 50.0::double as distance_m from stops a join stops b on a.parent_id = b.parent_id and a.stop_id <> b.stop_id)"


@query(f"with {SIBLINGS_SQL} from siblings")
def sibling_edges(net: Network) -> DataFrame:
    return walking.siblings(net.stops)


WALK_SQL = f"{SIBLINGS_SQL}, {LINKS_SQL}, walk as (select from_stop, to_stop, duration_s, distance_m from siblings union all select from_stop, to_stop, greatest(ceil(distance_m / 1.2::double)::int, 75), distance_m from links l where not exists (select 1 from siblings s where s.from_stop = l.from_stop and s.to_stop = l.to_stop))"


@query(f"with {WALK_SQL} from walk")
def walk_graph(net: Network) -> DataFrame:
    return walking.walk_graph(net.stops, RADIUS).withColumn("distance_m", F.round("distance_m", 3))


@query("select trip_id, string_agg(stop_id, ',' order by off) as line_key from stop_times group by trip_id")
def line_groups(net: Network) -> DataFrame:
    return timetable.line_groups(net.stop_times)


RANKED_SQL = "keys as (select trip_id, string_agg(stop_id, ',' order by off) as line_key, min(departure_s) as first_s from stop_times group by trip_id), ranked as (select trip_id, line_key, (row_number() over (partition by line_key order by first_s, trip_id) - 1)::int as position from keys)"


@query(f"with {RANKED_SQL} from ranked")
def line_positions(net: Network) -> DataFrame:
    return timetable.line_positions(net.stop_times)


@query(f"with {RANKED_SQL}, seen as (select line_key, trip_id, coalesce(departure_s >= lag(departure_s) over w and arrival_s >= lag(arrival_s) over w and pickup_type = lag(pickup_type) over w and drop_off_type = lag(drop_off_type) over w, true) as kept from stop_times join ranked using (trip_id) window w as (partition by line_key, off order by position)) select line_key, count(distinct trip_id) as n_trips, bool_and(kept) as fifo from seen group by line_key")
def line_fifo(net: Network) -> DataFrame:
    return timetable.fifo_lines(net.stop_times)


@query("with l as (select stop_id as a, lead(stop_id) over (partition by trip_id order by off) as b from stop_times) select least(a, b) as a, greatest(a, b) as b, count(*) as weight from l where b is not null group by 1, 2 having least(a, b) is not null")
def layout_links(net: Network) -> DataFrame:
    return timetable.layout_links(net.stop_times)


#: As-of join: of each stop and line the first departure at or after a time, the least trip of equal ones.
TRANSFERS_SQL = """boards as (select stop_id, line, departure_s, min((trip_id, off)) as b from ev where pickup_type <> 1 group by 1, 2, 3),
asks as (select e.trip_id, e.off, e.stop_id, l.line, e.arrival_s + 120 as t from ev e join (select distinct stop_id, line from boards) l using (stop_id) where e.drop_off_type <> 1),
tr as (select a.trip_id, a.off, a.line, (b.b)[1] as to_trip, (b.b)[2] as to_off from asks a asof join boards b on a.stop_id = b.stop_id and a.line = b.line and b.departure_s >= a.t)"""


@query(f"with ev as (select s.*, t.pattern_id as line from stop_times s join trips t using (trip_id)), {TRANSFERS_SQL} from tr where to_trip <> trip_id")
def trip_transfers(net: Network) -> DataFrame:
    return timetable.trip_transfers(net.stop_times, net.trips.select("trip_id", F.col("pattern_id").alias("line")))


@query("with s as (select *, start_s + ceil(greatest(28800 - start_s, 0) / headway_s)::bigint * headway_s as board_s from frequencies) select trip_id, start_s, board_s from s where board_s < end_s")
def frequency_board(net: Network) -> DataFrame:
    return departures.frequency_boarding(net.frequencies, AT_S)


@query("with f as (select stop_id as edge, (1 << (trip_id % 8)::int) as flag from stop_times) select edge, bit_or(flag)::bigint as flags, bit_or(flag) & 5 <> 0 as toward_0_or_2 from f group by edge")
def cell_flags(net: Network) -> DataFrame:
    """Flags of eight cells for each edge, and whether they meet a set of cells."""
    flag = F.expr("shiftleft(1L, cast(trip_id % 8 as int))")
    rows = net.stop_times.groupBy(F.col("stop_id").alias("edge")).agg(F.bit_or(flag).alias("flags"))
    return rows.withColumn("toward_0_or_2", F.col("flags").bitwiseAND(F.lit(5)) != 0)


@query("with f as (select trip_id, bit_or(1 << (stop_id % 8)::int) as flags from stop_times group by trip_id) select flags::bigint as flags, count(*) as n, (row_number() over (order by count(*) desc, flags))::int as rank from f group by flags")
def pattern_rank(net: Network) -> DataFrame:
    """Flag patterns by how many trips share them: the dictionary of a compressed store."""
    from pyspark.sql import Window as W

    flag = F.expr("shiftleft(1L, cast(stop_id % 8 as int))")
    per = net.stop_times.groupBy("trip_id").agg(F.bit_or(flag).alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))
    return per.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "flags")))
