"""Queries over names, colours and references, with their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import access
from ..sources.derived import Network, with_views
from .network import HAVERSINE

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


def _values(table: dict[str, str]) -> str:
    return ", ".join(f"('{k}', '{v}')" for k, v in table.items())


@query(f"with names(code, short) as (values {_values(labels.PRODUCT_NAMES)}), codes as (select p_partkey, 'C0' || (1371 + p_partkey % 700)::varchar as code from part) select p_partkey, code, short as short_name from codes left join names using (code)")
def product_names(net: Network) -> DataFrame:
    code = F.concat(F.lit("C0"), (1371 + F.col("p_partkey") % 700).cast("string"))
    return net.raw("part").select("p_partkey", code.alias("code")).withColumn("short_name", labels.product_short_name(F.col("code")))


@query(f"with palette(k, c) as (values {_values(labels.PALETTE)}), lines as (select p_partkey, case p_partkey % 3 when 0 then 'T' || (p_partkey % 15)::varchar when 1 then (p_partkey % 16)::varchar else chr(65 + (p_partkey % 24)::int) end as short from part) select p_partkey, short, c as color, case when c is null then null when short in ({', '.join(repr(x) for x in sorted(labels.BLACK_TEXT))}) then '000000' else 'FFFFFF' end as text_color from lines left join palette on k = short")
def line_colors(net: Network) -> DataFrame:
    k = F.col("p_partkey")
    letter = F.call_function("chr", (65 + k % 24).cast("long"))
    short = F.when(k % 3 == 0, F.concat(F.lit("T"), (k % 15).cast("string"))).when(k % 3 == 1, (k % 16).cast("string")).otherwise(letter)
    rows = net.raw("part").select(k, short.alias("short")).withColumn("x", labels.line_colors(F.col("short"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return rows.select("p_partkey", "short", "x.color", "x.text_color")


@query("""with t as (select trip_id, case when trip_id % 5 = 0 then 'N' || trip_id::varchar when trip_id % 5 = 1 then '20240115' end as name, case when trip_id % 3 = 0 then route_id::varchar end as route, case when trip_id % 2 = 0 then 'Terminus ' || pattern_id::varchar || ' by the long river road' end as head, 'OP:VehicleJourney::' || trip_id::varchar || 'x:20240115' as ref from trips)
select trip_id, case when name like 'N%' then name when route is not null and head is not null then route || ' → ' || substring(head, 1, 24) when route is not null then route when head is not null then substring(head, 1, 32) else trip_id::varchar || 'x' end as label from t""")
def display_label(net: Network) -> DataFrame:
    t = F.col("trip_id")
    s = t.cast("string")
    name = F.when(t % 5 == 0, F.concat(F.lit("N"), s)).when(t % 5 == 1, F.lit("20240115"))
    route = F.when(t % 3 == 0, F.col("route_id").cast("string"))
    head = F.when(t % 2 == 0, F.concat(F.lit("Terminus "), F.col("pattern_id").cast("string"), F.lit(" by the long river road")))
    ref = F.concat(F.lit("OP:VehicleJourney::"), s, F.lit("x:20240115"))
    return net.trips.select("trip_id", labels.display_label(name, F.lit(None).cast("string"), route, head, ref).alias("label"))


@query("""with e as (select event_id, case event_id % 6 when 0 then 'Ascenseur quai' when 1 then 'Escalator' when 2 then 'LIFT 3' when 3 then 'Escalier mécanique' else 'Porte' end as name, case event_id % 5 when 0 then 'OK' when 1 then 'en panne' when 2 then 'Hors service' when 3 then 'unavailable' else 'other' end as state from events)
select event_id, case event_id % 6 when 0 then 'Elevator' when 1 then 'Escalator' when 2 then 'Elevator' when 3 then 'Escalator' else 'Other' end as kind, case event_id % 5 when 0 then 'Available' when 4 then 'Unknown' else 'Unavailable' end as status from e""")
def equipment_status(net: Network) -> DataFrame:
    e = F.col("event_id")
    name = F.when(e % 6 == 0, "Ascenseur quai").when(e % 6 == 1, "Escalator").when(e % 6 == 2, "LIFT 3").when(e % 6 == 3, "Escalier mécanique").otherwise("Porte")
    state = F.when(e % 5 == 0, "OK").when(e % 5 == 1, "en panne").when(e % 5 == 2, "Hors service").when(e % 5 == 3, "unavailable").otherwise("other")
    return net.raw("events").select("event_id", labels.equipment_kind(name).alias("kind"), labels.equipment_status(state).alias("status"))


@query("""select s_suppkey, case s_suppkey % 4 when 0 then 'STIF:StopPoint:Q:' || (1000 + s_suppkey)::varchar || ':' when 1 then 'STIF:StopPoint:Q:' || s_suppkey::varchar || ':' when 2 then null else case when s_suppkey >= 1000 then 'STIF:StopPoint:Q:' || s_suppkey::varchar || ':' end end as ref from supplier""")
def monitoring_ref(net: Network) -> DataFrame:
    k = F.col("s_suppkey")
    s = k.cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("idfm:"), (1000 + k).cast("string"))).when(k % 4 == 1, F.concat(F.lit("idfm:STIF:StopPoint:Q:"), s)).when(k % 4 == 2, F.concat(F.lit("idfm:monomodalStopPlace:4"), s)).otherwise(s)
    return net.raw("supplier").select(k, labels.monitoring_ref(raw).alias("ref"))


@query("select o_orderkey, case o_orderkey % 3 when 0 then o_orderkey::varchar when 1 then o_orderkey::varchar || ':b' end as journey, case o_orderkey % 3 when 1 then 'RATP-SIV:VehicleJourney::' || o_orderkey::varchar || ':b:LOC' end as live_ref from orders")
def journey_refs(net: Network) -> DataFrame:
    o = F.col("o_orderkey")
    s = o.cast("string")
    code = F.when(o % 3 == 0, F.concat(F.lit("SNCF:VehicleJourney::"), s, F.lit(":LOC"))).when(o % 3 == 1, F.concat(F.lit("ratp:ServiceJourney:"), s, F.lit(":b:LOC"))).otherwise(F.concat(F.lit("X:Line:"), s))
    static = F.when(o % 3 == 1, code)
    return net.raw("orders").select(o, labels.journey_id(code).alias("journey"), labels.siri_journey_ref(static).alias("live_ref"))


@query(f"with a as (select address_id as query_id, lat, lon from addresses), d as (select query_id, stop_id, {HAVERSINE.format(a='a', b='s')} as distance_m from a, stops s), r as (select *, row_number() over (partition by query_id order by distance_m, stop_id) as n from d where distance_m <= 2500) select query_id, stop_id, greatest(ceil(distance_m / 1.2::double)::int, 1) as duration_s from r where n <= 16")
def access_stops(net: Network) -> DataFrame:
    points = net.addresses.select(F.col("address_id").alias("query_id"), "lat", "lon")
    return access.of_points(points, net.stops, 2_500.0).select("query_id", "stop_id", "duration_s")


@query("with s as (select stop_id, stop_id as query_id, parent_id from stops), a as (select query_id, stop_id, 0 as duration_s from s union all select s.query_id, k.stop_id, 60 from s join stops k on k.parent_id = s.parent_id and k.stop_id <> s.stop_id) from a")
def access_siblings(net: Network) -> DataFrame:
    asks = net.stops.select(F.col("stop_id").alias("query_id"), "stop_id")
    return access.of_stops(asks, net.stops).select("query_id", "stop_id", "duration_s")


@query("select journey_id, leg::int as leg, coalesce(block_id = lag(block_id) over (partition by journey_id order by leg), false) as same_vehicle from (select trip_id // 4 as journey_id, trip_id % 4 as leg, case when trip_id % 5 > 0 then block_id % 3 end as block_id from trips)")
def same_vehicle(net: Network) -> DataFrame:
    t = F.col("trip_id")
    rows = net.trips.select(F.floor(t / 4).alias("journey_id"), (t % 4).cast("int").alias("leg"), F.lit("f").alias("feed_id"), F.when(t % 5 > 0, F.col("block_id") % 3).alias("block_id"))
    return access.same_vehicle(rows).select("journey_id", "leg", "same_vehicle")


@query("with e as (select value, event_type from events) select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, max(value) as most, round(avg(value), 6) as mean from e group by event_type")
def latency_percentiles(net: Network) -> DataFrame:
    p = lambda q: F.round(F.percentile("value", q), 6)
    return net.raw("events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"))
