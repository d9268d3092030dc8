"""Queries over equipment, map views, walks between stops and departure profiles, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import equipment, realtime, router, walking
from ..sources.derived import Network, with_views
from .journeys import ORIGINS, TARGETS, rounds_sql
from .live import GPS_SQL, LIVE_SQL, _gps, _live
from .network import AT_S, HAVERSINE, RADIUS, WALK_SQL, day_runs

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


@query("""with items as (select event_id as equipment_id, case event_id % 2 when 0 then 'stop_area:IDFM:' || (event_id % 90)::varchar else 'idfm:7' || (1000 + event_id % 50)::varchar end as s from events),
k as (select equipment_id, replace(replace(regexp_replace(regexp_replace(lower(s), '^(stop_area:|stop_point:)', ''), '^(idfm:|idfm%3a)', ''), 'idfm:', ''), ':', '') as a from items), t as (select stop_id, case when stop_id % 2 = 0 then stop_id::varchar else (1000 + stop_id)::varchar end as b from stops)
select distinct stop_id, equipment_id from k, t where a = b or (length(b) >= 4 and ends_with(a, b)) or (length(a) >= 4 and ends_with(b, a))""")
def equipment_by_stop(net: Network) -> DataFrame:
    e = F.col("event_id")
    stop = F.when(e % 2 == 0, F.concat(F.lit("stop_area:IDFM:"), (e % 90).cast("string"))).otherwise(F.concat(F.lit("idfm:7"), (1000 + e % 50).cast("string")))
    items = net.raw("events").select(e.alias("equipment_id"), stop.alias("stop_id"))
    s = F.col("stop_id")
    stops = net.stops.select(s.alias("id"), F.when(s % 2 == 0, s.cast("string")).otherwise((1000 + s).cast("string")).alias("stop_id"))
    found = equipment.by_stop(items, stops)
    return found.join(stops, "stop_id").select(F.col("id").alias("stop_id"), "equipment_id")


@query(f"with {GPS_SQL} select trip_id % 40 as line, count(*) as n from gps where round(lat, 6) between 48.82::double and 48.95::double and round(lon, 6) between 2.2::double and 2.45::double group by 1 order by n desc, line limit 10")
def viewport_lines(net: Network) -> DataFrame:
    rows = _gps(net).select((F.col("trip_id") % 40).alias("line"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
    return equipment.viewport_lines(rows, (48.82, 2.2, 48.95, 2.45), 10)


@query(f"with {WALK_SQL}, pairs as (select a.stop_id as from_stop, b.stop_id as to_stop, {HAVERSINE.format(a='a', b='b')} as d from stops a, stops b where a.stop_id in {ORIGINS} and a.stop_id <> b.stop_id) select from_stop, to_stop, coalesce(duration_s, greatest(ceil(d / 1.2::double)::int, 30)) as duration_s from pairs left join walk using (from_stop, to_stop) where duration_s is not null or d <= 6000")
def walk_between(net: Network) -> DataFrame:
    a = net.stops.where(F.col("stop_id").isin(*ORIGINS)).select(F.col("stop_id").alias("from_stop"))
    b = net.stops.select(F.col("stop_id").alias("to_stop"))
    edges = walking.walk_graph(net.stops, RADIUS, starts=a.select(F.col("from_stop").alias("stop_id")))
    return walking.between(a.join(b, F.col("from_stop") != F.col("to_stop")), edges, net.stops, 6_000.0)  # from three named stops to all


@query(f"with {LIVE_SQL}, ends as (select trip_id, min(rt_departure_s) filter (off = 0) as a, max(rt_arrival_s) filter (off = 7) as b from live group by trip_id) select trip_id, case when {AT_S} < a then 0 else 7 end::bigint as off, case when {AT_S} < a then 'INCOMING_AT' else 'STOPPED_AT' end as state from ends where ({AT_S} < a and a - {AT_S} <= 1800) or (not {AT_S} < a and {AT_S} > b and {AT_S} - b <= 1800)")
def vehicle_pins(net: Network) -> DataFrame:
    return realtime.vehicle_pins(_live(net), AT_S)


_SEEDS = f"start as (select distinct o.stop_id * 1000000 + e.departure_s as query_id, o.stop_id, e.departure_s as arr from stops o join ev e using (stop_id) where o.stop_id in {ORIGINS} and e.pickup_type <> 1 and e.departure_s between {AT_S} and {AT_S + 1799})"


@query(rounds_sql(2, False, _SEEDS) + f""", p as (select query_id // 1000000 as q, stop_id, query_id % 1000000 as seed_s, arr from best2 where stop_id in {TARGETS})
select q::bigint as query_id, stop_id as target, seed_s::bigint as seed_s, arr as arrival_s from p where not exists (select 1 from p o where o.q = p.q and o.stop_id = p.stop_id and o.seed_s > p.seed_s and o.arr <= p.arr)""")
def departure_profile(net: Network) -> DataFrame:
    """Departures of half an hour of which none is overtaken by a later one."""
    events = day_runs(net)
    start = net.stops.where(F.col("stop_id").isin(*ORIGINS)).select(F.col("stop_id").alias("query_id"), "stop_id", F.lit(AT_S).alias("arr"))
    seeds = router.departure_seeds(start, events, 1_800).select((F.col("query_id") * 1_000_000 + F.col("seed_s")).alias("query_id"), "stop_id", F.col("seed_s").alias("arr"))
    labels = router.earliest(router.rounds(seeds, events, None, 2))
    labels = labels.select(F.floor(F.col("query_id") / 1_000_000).alias("query_id"), "stop_id", (F.col("query_id") % 1_000_000).alias("seed_s"), "arr")
    targets = labels.where(F.col("stop_id").isin(*TARGETS)).select("query_id", "stop_id").distinct()
    return router.profile(labels, targets).select("query_id", F.col("stop_id").alias("target"), "seed_s", F.col("arr").alias("arrival_s"))
