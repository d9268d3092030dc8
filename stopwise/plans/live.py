"""Queries over live updates, fares, references and alerts, with their SQL counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import alerts as al
from ..operators import fares, realtime, resolve
from ..sources.derived import Network, with_views
from .network import AT_S, DAY, ORIGINS, active, day_events

NOW = 1_705_302_000
QUERIES, SQL = {}, {}


def query(sql: str | None = None, recursive: bool = False):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql, recursive)
        return f

    return register


TRIP_SQL = """rt_trip as (select trip_id, bool_or(canceled) as canceled, arg_max(delay_s, (ts, event_id)) filter (delay_s is not null) as delay_s, least(max(abs(delay_s)), 21600) as margin_s, count(delay_s) as n_delays from rt_events group by trip_id)"""
STOP_SQL = """rt_stop as (select trip_id, off, delay_s, skipped from (select *, row_number() over (partition by trip_id, off order by ts desc, event_id desc) as n from rt_events where not is_vehicle) where n = 1)"""
LIVE_SQL = f"""{TRIP_SQL}, {STOP_SQL}, live as (select e.*, e.departure_s + coalesce(s.delay_s, t.delay_s, 0) as rt_departure_s, e.arrival_s + coalesce(s.delay_s, t.delay_s, 0) as rt_arrival_s,
s.skipped is not null or t.delay_s is not null or coalesce(t.canceled, false) as has_rt, coalesce(s.skipped, false) as skipped, coalesce(t.canceled, false) as canceled
from (select s.* from stop_times s join trips t using (trip_id) where t.service_id in (from active)) e left join rt_stop s using (trip_id, off) left join rt_trip t using (trip_id))"""


@query(f"with {TRIP_SQL} from rt_trip")
def rt_adjust(net: Network) -> DataFrame:
    return realtime.trip_delay(net.rt_events)


def _live(net: Network) -> DataFrame:
    updates = net.rt_events
    return realtime.with_realtime(day_events(net), realtime.stop_updates(updates), realtime.trip_delay(updates))


@query(f"with {LIVE_SQL} select trip_id, off, stop_id, rt_departure_s, rt_arrival_s, has_rt, skipped, canceled from live")
def rt_apply_departure(net: Network) -> DataFrame:
    return _live(net).select("trip_id", "off", "stop_id", "rt_departure_s", "rt_arrival_s", "has_rt", "skipped", "canceled")


@query(f"with {LIVE_SQL} select stop_id, trip_id, off, departure_s, rt_departure_s, canceled from live where stop_id in {ORIGINS} and pickup_type <> 1 and not skipped and departure_s >= {AT_S} order by departure_s, trip_id, off, stop_id limit 50")
def departures_rt(net: Network) -> DataFrame:
    rows = _live(net).where(F.col("stop_id").isin(*ORIGINS) & (F.col("pickup_type") != 1) & ~F.col("skipped") & (F.col("departure_s") >= AT_S))
    return rows.orderBy("departure_s", "trip_id", "off", "stop_id").limit(50).select("stop_id", "trip_id", "off", "departure_s", "rt_departure_s", "canceled")


@query("select distinct trip_id from rt_events where canceled")
def canceled_trips(net: Network) -> DataFrame:
    return net.rt_events.where("canceled").select("trip_id").distinct()


STATS_SQL = "count(*) as n, count_if(canceled)::bigint as n_canceled, count_if(skipped)::bigint as n_skipped, count_if(is_vehicle)::bigint as n_vehicles, count(delay_s) as n_delays, count(distinct trip_id) as n_trips"


def _by_feed(net: Network) -> DataFrame:
    return net.rt_events.withColumn("feed", F.concat(F.lit("feed"), (F.col("trip_id") % 4).cast("string")))


@query(f"select 'feed' || (trip_id % 4)::varchar as feed, {STATS_SQL} from rt_events group by 1")
def rt_stats(net: Network) -> DataFrame:
    return realtime.stats(_by_feed(net))


@query(f"select feed, {STATS_SQL} from (select *, 'feed' || (trip_id % 4)::varchar as feed from rt_events) group by rollup (feed)")
def rt_stats_rollup(net: Network) -> DataFrame:
    return realtime.stats(_by_feed(net), rollup=True)


@query(f"with {TRIP_SQL} select trip_id, case when canceled then 'CANCELLED' when delay_s > 0 then 'DELAYED' when delay_s < 0 then 'EARLY' when delay_s = 0 then 'ON_TIME' else 'PARTIAL' end as status from rt_trip")
def trip_status(net: Network) -> DataFrame:
    return realtime.trip_status(realtime.trip_delay(net.rt_events))


@query(f"with {LIVE_SQL} select trip_id, count(*) as n_stops, min(rt_departure_s) as first_s, max(rt_arrival_s) as last_s, bool_or(skipped) as any_skipped, bool_or(canceled) as canceled from live group by trip_id")
def trip_detail(net: Network) -> DataFrame:
    return _live(net).groupBy("trip_id").agg(F.count("*").alias("n_stops"), F.min("rt_departure_s").alias("first_s"), F.max("rt_arrival_s").alias("last_s"), F.bool_or("skipped").alias("any_skipped"), F.bool_or("canceled").alias("canceled"))


GPS_SQL = "gps as (select trip_id, off, stop_id, s.lat, s.lon from (select *, row_number() over (partition by trip_id order by ts desc, event_id desc) as n from rt_events where is_vehicle) v join stop_times t using (trip_id, off) join stops s using (stop_id) where n = 1)"


def _gps(net: Network) -> DataFrame:
    last = realtime.latest(net.rt_events.where("is_vehicle").select("trip_id", "off", "ts", "event_id"), ["trip_id"], ["ts", "event_id"])
    at = net.stop_times.select("trip_id", "off", "stop_id").join(net.stops.select("stop_id", "lat", "lon"), "stop_id")
    return last.select("trip_id", "off").join(at, ["trip_id", "off"]).select("trip_id", "off", "stop_id", "lat", "lon")


@query(f"with {GPS_SQL} select trip_id, off, stop_id, round(lat, 6) as lat, round(lon, 6) as lon from gps")
def vehicles_gps(net: Network) -> DataFrame:
    return _gps(net).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


@query(f"with {GPS_SQL} select trip_id, off, stop_id from gps where round(lat, 6) between 48.82::double and 48.90::double and round(lon, 6) between 2.25::double and 2.40::double")
def vehicles_bbox(net: Network) -> DataFrame:
    lat, lon = F.round("lat", 6), F.round("lon", 6)
    return _gps(net).where(geo.in_box(lat, lon, 48.82, 2.25, 48.90, 2.40)).select("trip_id", "off", "stop_id")


ESTIMATE_SQL = """est as (select * from (select *, row_number() over (partition by trip_id order by off) as n from (select trip_id, off, stop_id, next_stop, 
case when 28800 between rt_arrival_s and rt_departure_s then 0.0::double else (28800 - rt_departure_s)::double / greatest(next_arrival - rt_departure_s, 1) end as fraction, 28800 between rt_arrival_s and rt_departure_s as halted
from (select *, lead(stop_id) over (partition by trip_id order by off) as next_stop, lead(rt_arrival_s) over (partition by trip_id order by off) as next_arrival from live)
where 28800 between rt_arrival_s and rt_departure_s or (28800 > rt_departure_s and 28800 < next_arrival))) where n = 1)"""


@query(f"with {LIVE_SQL}, {ESTIMATE_SQL} select trip_id, off, case when halted then 'STOPPED_AT' when fraction > 0.92::double then 'INCOMING_AT' else 'UNDER_WAY' end as state, round(fraction, 6) as fraction, round(a.lat + fraction * (coalesce(b.lat, a.lat) - a.lat), 5) as lat from est join stops a using (stop_id) left join stops b on b.stop_id = est.next_stop")
def vehicle_estimate(net: Network) -> DataFrame:
    rows = realtime.vehicle_estimate(_live(net), AT_S, net.stops)
    return rows.select("trip_id", "off", "state", F.round("fraction", 6).alias("fraction"), F.round("lat", 5).alias("lat"))


@query(f"with {LIVE_SQL}, {ESTIMATE_SQL} select trip_id, off from est where trip_id in (select trip_id from rt_events) and trip_id not in (select trip_id from rt_events where is_vehicle) and trip_id not in (select trip_id from rt_events where canceled)")
def vehicles_synthetic(net: Network) -> DataFrame:
    """Estimated positions of trips that have updates but no position of their own."""
    updates = net.rt_events
    rows = realtime.vehicle_estimate(_live(net), AT_S, net.stops).select("trip_id", "off")
    rows = rows.join(updates.select("trip_id").distinct(), "trip_id", "left_semi").join(updates.where("is_vehicle").select("trip_id"), "trip_id", "left_anti")
    return rows.join(updates.where("canceled").select("trip_id"), "trip_id", "left_anti")


LEGS_SQL = "legs as (select l_orderkey as journey_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as leg, l_partkey % 40 as route_id, l_suppkey % 4 as origin_id, (l_suppkey + 1) % 4 as destination_id, 28800 + l_linenumber * 1500 as board_s from lineitem)"
BEST_SQL = """best as (select * from (select l.*, r.fare_id, a.price, a.currency, a.transfers, a.duration_s, row_number() over (partition by l.journey_id, l.leg order by -(case when r.route_id is not null then 4 else 0 end + case when r.origin_id is not null then 2 else 0 end + case when r.destination_id is not null then 2 else 0 end + case when r.contains_id is not null then 1 else 0 end), a.price, r.fare_id) as n
from legs l join fare_rules r on (r.route_id is null or r.route_id = l.route_id) and (r.origin_id is null or r.origin_id = l.origin_id) and (r.destination_id is null or r.destination_id = l.destination_id) and (r.contains_id is null or r.contains_id = l.origin_id or r.contains_id = l.destination_id) join fare_attributes a on a.fare_id = r.fare_id) where n = 1)"""
FOLD_SQL = f"""{LEGS_SQL}, {BEST_SQL}, every as (select l.*, b.fare_id, b.price, b.currency, b.transfers, b.duration_s from legs l left join best b using (journey_id, leg)),
fold as (select journey_id, leg, price, 1 as tickets, fare_id as held, 0 as used, board_s as since from every where leg = 1
union all select e.journey_id, e.leg, case when g then f.price else f.price + e.price end, case when g then f.tickets else f.tickets + 1 end, e.fare_id, case when g then f.used + 1 else 0 end, case when g then f.since else e.board_s end
from fold f join (select * from every) e on e.journey_id = f.journey_id and e.leg = f.leg + 1, lateral (select coalesce(f.held = e.fare_id and (e.transfers is null or f.used < e.transfers) and (e.duration_s is null or e.board_s - f.since <= e.duration_s), false) as g))"""


def _legs(net: Network) -> DataFrame:
    from ..operators.timetable import with_offsets

    rows = with_offsets(net.raw("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = F.col("l_suppkey")
    return rows.select(F.col("l_orderkey").alias("journey_id"), (F.col("off") + 1).alias("leg"), (F.col("l_partkey") % 40).alias("route_id"), (s % 4).alias("origin_id"), ((s + 1) % 4).alias("destination_id"), (28800 + F.col("l_linenumber") * 1500).alias("board_s"))


@query(f"with {LEGS_SQL}, {BEST_SQL} select journey_id, leg::int as leg, fare_id, round(price, 4) as price from best")
def fare_best(net: Network) -> DataFrame:
    return fares.best_fares(_legs(net), net.fare_rules, net.fare_attributes).select("journey_id", "leg", "fare_id", F.round("price", 4).alias("price"))


@query(f"with {LEGS_SQL}, {BEST_SQL} select journey_id, count(*) as legs, count(distinct fare_id) as fares, sum(cast(round(price * 1000) as bigint))::bigint as single_mills from best group by journey_id")
def fare_tickets(net: Network) -> DataFrame:
    rows = fares.best_fares(_legs(net), net.fare_rules, net.fare_attributes)
    return rows.groupBy("journey_id").agg(F.count("*").alias("legs"), F.count_distinct("fare_id").alias("fares"), F.sum(F.round(F.col("price") * 1000).cast("long")).alias("single_mills"))


@query(f"with {FOLD_SQL} select f.journey_id, case when x.priced then round(f.price, 6) end as price, case when x.priced then f.tickets end::int as tickets from fold f join (select journey_id, max(leg) as leg, bool_and(fare_id is not null) and count(distinct currency) = 1 as priced from every group by journey_id) x using (journey_id, leg)", recursive=True)
def journey_fare(net: Network) -> DataFrame:
    """Tickets used again along a journey."""
    rows = fares.best_fares(_legs(net), net.fare_rules, net.fare_attributes, unpriced=True)
    found = fares.journey_fares(rows.select("journey_id", "leg", "board_s", "fare_id", "price", "currency", "transfers", "duration_s"))
    return found.withColumn("price", F.round("price", 6))


@query("select event_id as ref, trip_id from rt_events join trips using (trip_id) where event_id % 3 <> 2")
def resolve_trip_exact_alias(net: Network) -> DataFrame:
    """References by name and by alias; of three kinds one is unknown and finds nothing."""
    t, e = F.col("trip_id"), F.col("event_id")
    name, alias = F.concat(F.lit("net:"), t.cast("string")), F.concat(F.lit("OP:VehicleJourney::"), t.cast("string"), F.lit(":LOC"))
    keys = net.trips.select(name.alias("key"), "trip_id").union(net.trips.select(alias.alias("key"), "trip_id"))
    refs = net.rt_events.select(e.alias("ref"), F.when(e % 3 == 0, F.array(F.lit("none"), name)).when(e % 3 == 1, F.array(alias)).otherwise(F.array(F.lit("none"))).alias("candidates"))
    return resolve.by_keys(refs, keys)


BEFORE_SQL = """active_before as (select service_id from (select service_id from services where date '2024-01-14' between start_date and end_date and days & (1 << (isodow(date '2024-01-14') - 1)) > 0
union select service_id from calendar_dates where date = date '2024-01-14' and exception_type = 1) where service_id not in (select service_id from calendar_dates where date = date '2024-01-14' and exception_type = 2))"""
CLOCK_SQL = f"""{BEFORE_SQL}, runs as (select pattern_id as line, trip_id, first_dep_s as dep_s from trips where service_id in (from active)
union all select pattern_id, trip_id, first_dep_s - 86400 from trips where service_id in (from active_before) and first_dep_s >= 43200)"""


def _clock(net: Network) -> DataFrame:
    """Departures of the day and of the day before on the day's clock."""
    from ..operators import calendar

    before = calendar.active_services(net.services, net.calendar_dates, DAY - dt.timedelta(days=1))
    today, yesterday = (net.trips.join(days, "service_id", "left_semi").select(F.col("pattern_id").alias("line"), "trip_id", F.col("first_dep_s").alias("dep_s")) for days in (active(net), before))
    return resolve.on_clock(today, yesterday)


@query(f"""with {CLOCK_SQL}, asks as (select event_id as ref, e.trip_id % 40 as line, (t.first_dep_s + event_id % 1300 - 650) % 86400 as at_s from rt_events e join trips t using (trip_id)),
near as (select ref, r.line, r.dep_s, r.trip_id, abs(r.dep_s - at_s) as delta, row_number() over (partition by ref order by abs(r.dep_s - at_s), r.trip_id) as n from asks a join runs r on r.line = a.line and abs(r.dep_s - at_s) <= 900)
select ref, trip_id from near x where n = 1 and (delta <= 60 or (select count(*) from runs r where r.line = x.line and abs(r.dep_s - x.dep_s) <= 120) <= 1)""")
def resolve_trip_time(net: Network) -> DataFrame:
    trips = net.trips.select(F.col("pattern_id").alias("line"), "trip_id", F.col("first_dep_s").alias("dep_s"))
    asks = net.rt_events.join(trips.hint("merge"), "trip_id").select(F.col("event_id").alias("ref"), "line", ((F.col("dep_s") + F.col("event_id") % 1300 - 650) % 86_400).alias("at_s"))
    return resolve.by_time(asks, _clock(net))


_NAME_SQL = "'T' || lpad((trip_id * 7919 % 1000000)::varchar, 8, '0')"


@query(f"""with names as (select trip_id, {_NAME_SQL} as name from trips),
asks as (select event_id as ref, case event_id % 3 when 2 then left({_NAME_SQL}, 8) else right({_NAME_SQL}, (6 + event_id % 3)::int) end as tail from rt_events),
parts as (select trip_id, unnest([right(name, 6), right(name, 7), left(name, 8), right(name, 8)]) as part from names)
select ref, min(n.trip_id) as trip_id from asks join parts n on n.part = tail group by ref having count(distinct n.trip_id) = 1""")
def resolve_trip_fuzzy(net: Network) -> DataFrame:
    """Tails of six and seven letters end a name; beginnings of eight stand anywhere in one."""
    name = F.concat(F.lit("T"), F.lpad((F.col("trip_id") * 7919 % 1000000).cast("string"), 8, "0"))
    asks = net.rt_events.withColumn("name", name).select(F.col("event_id").alias("ref"), F.expr("if(event_id % 3 = 2, left(name, 8), right(name, cast(6 + event_id % 3 as int)))").alias("tail"))
    return resolve.by_tail(asks, net.trips.select("trip_id", name.alias("name")))


_LIVE_TRIPS_SQL = "lt as (select distinct e.trip_id, 'net:' || t.route_id::varchar as route_id, case when e.trip_id % 3 <> 0 then e.trip_id % 2 end as direction_id, case when e.trip_id % 5 <> 0 then '20240115' end as start_date from rt_events e join trips t using (trip_id))"


@query(f"""with {_LIVE_TRIPS_SQL}, asks as (select event_id as ref, case when event_id % 4 = 0 then (event_id % 40)::varchar when event_id % 4 = 3 then 'far:' || (event_id % 40)::varchar else 'net:' || (event_id % 40)::varchar end as route_id, case when event_id % 3 = 0 then event_id % 2 end as direction_id, case when event_id % 7 = 0 then '20240115' end as start_date from rt_events)
select ref, min(trip_id) as trip_id from asks a join lt l on (l.route_id = a.route_id or split_part(l.route_id, ':', 2) = a.route_id) and (a.direction_id is null or a.direction_id = l.direction_id) and (a.start_date is null or a.start_date = l.start_date) group by ref""")
def resolve_trip_descriptor(net: Network) -> DataFrame:
    """References that name only a route, a direction or a date."""
    t, e = F.col("trip_id"), F.col("event_id")
    live_trips = net.rt_events.select("trip_id").distinct().join(net.trips.select("trip_id", "route_id").hint("merge"), "trip_id")  # ids in order pack too well to tell their number by size
    live_trips = live_trips.select("trip_id", F.concat(F.lit("net:"), F.col("route_id").cast("string")).alias("route_id"), F.when(t % 3 != 0, t % 2).alias("direction_id"), F.when(t % 5 != 0, "20240115").alias("start_date"))
    route = (e % 40).cast("string")
    asks = net.rt_events.select(e.alias("ref"), F.when(e % 4 == 0, route).when(e % 4 == 3, F.concat(F.lit("far:"), route)).otherwise(F.concat(F.lit("net:"), route)).alias("route_id"), F.when(e % 3 == 0, e % 2).alias("direction_id"), F.when(e % 7 == 0, "20240115").alias("start_date"))
    return resolve.by_descriptor(asks, live_trips)


@query(f"""with {CLOCK_SQL}, asks as (select event_id as ref, e.trip_id, t.pattern_id as line, (t.first_dep_s + event_id % 700) % 86400 as at_s, case event_id % 5 when 0 then 'net:' || e.trip_id::varchar when 1 then 'OP:VehicleJourney::' || e.trip_id::varchar || ':LOC' when 2 then 'X' || right({_NAME_SQL.replace("trip_id", "e.trip_id")}, 7) else 'none' end as name from rt_events e join trips t using (trip_id)),
exact as (select ref, trip_id, 'exact' as step from asks where event_kind(ref) = 0), alias as (select ref, trip_id, 'alias' as step from asks where event_kind(ref) = 1),
near as (select ref, r.line, r.dep_s, r.trip_id, abs(r.dep_s - at_s) as delta, row_number() over (partition by ref order by abs(r.dep_s - at_s), r.trip_id) as n from asks a join runs r on r.line = a.line and abs(r.dep_s - at_s) <= 900 where event_kind(ref) >= 2),
timed as (select ref, trip_id, 'time' as step from near x where n = 1 and (delta <= 60 or (select count(*) from runs r where r.line = x.line and abs(r.dep_s - x.dep_s) <= 120) <= 1)),
tails as (select ref, min(n.trip_id) as trip_id, 'tail' as step from asks a join (select trip_id, right({_NAME_SQL}, 7) as part from trips) n on n.part = right(a.name, 7) where event_kind(ref) = 2 and ref not in (select ref from timed) group by ref having count(distinct n.trip_id) = 1)
from exact union all from alias union all from timed union all from tails""".replace("event_kind(ref)", "ref % 5"))
def resolve_cascade(net: Network) -> DataFrame:
    """The whole way: name, alias, line and time, tail; each step only for what the steps before left over."""
    t, e = F.col("trip_id"), F.col("event_id")
    own, alias = F.concat(F.lit("net:"), t.cast("string")), F.concat(F.lit("OP:VehicleJourney::"), t.cast("string"), F.lit(":LOC"))
    name = F.concat(F.lit("T"), F.lpad((t * 7919 % 1000000).cast("string"), 8, "0"))
    asks = net.rt_events.join(net.trips.select("trip_id", F.col("pattern_id").alias("line"), "first_dep_s").hint("merge"), "trip_id")
    called = F.when(e % 5 == 0, own).when(e % 5 == 1, alias).when(e % 5 == 2, F.concat(F.lit("X"), F.right(name, F.lit(7)))).otherwise("none")
    asks = asks.select(e.alias("ref"), "line", ((F.col("first_dep_s") + e % 700) % 86_400).alias("at_s"), called.alias("name"))
    trips = net.trips

    def named(column):
        return lambda left: resolve.by_keys(left.select("ref", F.array("name").alias("candidates")), trips.select(column.alias("key"), "trip_id"))

    clock = _clock(net)
    steps = [("exact", named(own)), ("alias", named(alias)), ("time", lambda left: resolve.by_time(left.select("ref", "line", "at_s"), clock))]
    steps.append(("tail", lambda left: resolve.by_tail(left.where("name like 'X%'").select("ref", F.right("name", F.lit(7)).alias("tail")), trips.select("trip_id", name.alias("name")))))
    return resolve.cascade(asks, steps)


@query(f"select alert_id, active_start <= {NOW} and (active_end is null or active_end >= {NOW}) as active, active_end is not null and active_end < {NOW} as ended from alerts")
def alert_active(net: Network) -> DataFrame:
    periods = F.array(F.struct(F.col("active_start").alias("start"), F.col("active_end").alias("end")))
    return net.alerts.select("alert_id", al.active_now(periods, NOW).alias("active"), al.ended(periods, NOW).alias("ended"))


@query("select min(alert_id) as alert_id from alerts where lower(trim(header)) || lower(trim(description)) <> '' group by lower(trim(header)) || '|' || substring(lower(trim(description)), 1, 160)")
def alert_dedupe(net: Network) -> DataFrame:
    return al.deduplicated(net.alerts.select("alert_id", "header", "description")).select("alert_id")


def _informed(net: Network) -> DataFrame:
    a = F.col("alert_id")
    return net.alerts.select(
        "alert_id", F.when(a % 5 == 0, F.array(F.concat(F.lit("net:"), (a % 100).cast("string")))).otherwise(F.array().cast("array<string>")).alias("trip_ids"),
        F.array(F.concat(F.lit("net:"), F.col("route_id").cast("string"))).alias("route_ids"), F.when(a % 3 == 0, F.array((a % 50).cast("string"))).otherwise(F.array().cast("array<string>")).alias("stop_ids"),
    )


INDEX_SQL = """idx as (select 'trip' as kind, unnest(['net:' || (alert_id % 100)::varchar, (alert_id % 100)::varchar]) as key, alert_id from alerts where alert_id % 5 = 0
union select 'route', unnest(['net:' || route_id::varchar, route_id::varchar]), alert_id from alerts union select 'stop', (alert_id % 50)::varchar, alert_id from alerts where alert_id % 3 = 0)"""


@query(f"with {INDEX_SQL} select kind, key, count(*) as n, min(alert_id) as first_alert from idx group by kind, key")
def alert_index(net: Network) -> DataFrame:
    return al.inverted(_informed(net)).groupBy("kind", "key").agg(F.count("*").alias("n"), F.min("alert_id").alias("first_alert"))


@query(f"with {INDEX_SQL}, legs as (select trip_id as leg_id, trip_id::varchar as trip, route_id::varchar as route, min(case when off = 0 then stop_id end)::varchar as a, min(case when off = 7 then stop_id end)::varchar as b from trips join stop_times using (trip_id) group by 1, 2, 3) select distinct leg_id, alert_id from legs join idx on (kind = 'trip' and key = trip) or (kind = 'route' and key = route) or (kind = 'stop' and key in (a, b))")
def alerts_for_leg(net: Network) -> DataFrame:
    ends = net.stop_times.groupBy("trip_id").agg(*(F.min(F.when(F.col("off") == k, F.col("stop_id"))).cast("string").alias(n) for k, n in ((0, "from_stop"), (7, "to_stop"))))
    legs = net.trips.join(ends, "trip_id").select(F.col("trip_id").alias("leg_id"), F.col("trip_id").cast("string").alias("trip_id"), F.col("route_id").cast("string").alias("route_id"), "from_stop", "to_stop")
    return al.for_legs(legs, al.inverted(_informed(net)))


@query("with w as (select distinct alert_id, unnest(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+')) as word from alerts) select alert_id, p_type as line from w join (select distinct split_part(lower(p_name), ' ', 2) as word, split_part(p_name, ' ', 2) as p_type from part union select 'the', 'the' union select 'en', 'en') using (word)")
def alert_lines(net: Network) -> DataFrame:
    second = net.raw("part").select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("line")).distinct()
    lines = second.union(net.spark.sql("select explode(array('the', 'en')) as line")).distinct()
    return al.mentioned_lines(net.alerts, lines)
