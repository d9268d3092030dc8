"""Smaller questions: horizons, buckets, orders after live updates, lines of alerts, chains of stops, cells; with their SQL counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..operators import calendar, preprocess, spatial
from ..sources.derived import Network, with_views
from .live import LIVE_SQL, _live
from .network import DAY, HAVERSINE, RADIUS

QUERIES, SQL = {}, {}
HORIZON = 2


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


@query("""with days as (select service_id, cast(unnest(generate_series(greatest(start_date, date '2024-01-14'), least(end_date, date '2024-01-17'), interval 1 day)) as date) as date, days from services),
runs as (select service_id, date from days where days & (1 << (isodow(date) - 1)) > 0 union select service_id, date from calendar_dates where exception_type = 1 and date between date '2024-01-14' and date '2024-01-17')
select trip_id from trips where service_id in (select service_id from runs where (service_id, date) not in (select (service_id, date) from calendar_dates where exception_type = 2))""")
def service_horizon(net: Network) -> DataFrame:
    """Trips whose service runs on a day from yesterday to the horizon."""
    days = calendar.services_in_range(net.services, net.calendar_dates, DAY - dt.timedelta(days=1), DAY + dt.timedelta(days=HORIZON))
    return net.trips.join(days.select("service_id").distinct(), "service_id", "left_semi").select("trip_id")


@query("select floor(epoch(ts) / 60)::bigint as minute, count(*) as n from events group by 1")
def minute_buckets(net: Network) -> DataFrame:
    """Requests of one minute share a stored answer."""
    return net.raw("events").groupBy(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).alias("minute")).agg(F.count("*").alias("n"))


@query(f"""with {LIVE_SQL}, j as (select trip_id, max(rt_arrival_s) as arrival_s, max(rt_arrival_s) - min(rt_departure_s) as duration_s from live where not canceled group by trip_id)
select trip_id, (row_number() over (partition by trip_id % 40 order by arrival_s, duration_s, trip_id % 4, trip_id))::int as rank from j""")
def live_order(net: Network) -> DataFrame:
    """After live times are known: arrival, duration, transfers."""
    rows = _live(net).where("not canceled").groupBy("trip_id").agg(F.max("rt_arrival_s").alias("arrival_s"), (F.max("rt_arrival_s") - F.min("rt_departure_s")).alias("duration_s"))
    order = W.partitionBy(F.col("trip_id") % 40).orderBy("arrival_s", "duration_s", F.col("trip_id") % 4, "trip_id")
    return rows.select("trip_id", F.row_number().over(order).alias("rank"))


@query(f"select from_stop, to_stop from (select a.stop_id as from_stop, b.stop_id as to_stop, round({HAVERSINE.format(a='a', b='b')}, 3) as d from stops a, stops b where a.stop_id < b.stop_id) where d > 1 and d <= {RADIUS} order by d, from_stop, to_stop limit 300")
def shortest_links(net: Network) -> DataFrame:
    """The shortest pairs of stops within reach; a top-k, not a cut of the walk graph."""
    return spatial.shortest_links(net.stops, RADIUS, 300).select("from_stop", "to_stop")


@query("""with words as (select alert_id, unnest(list_distinct(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+'))) as word from alerts), seen as (select alert_id, word as line from words where word in ('the', 'en', 'de', 'la'))
select alert_id, string_agg(line, ',' order by line) as lines from (select alert_id, route_id::varchar as line from alerts union select alert_id, line from seen) group by alert_id""")
def alert_all_lines(net: Network) -> DataFrame:
    """Lines that an alert names as concerned, and those that its text mentions."""
    words = F.array_intersect(F.split(F.lower("description"), r"[^\p{L}\p{N}]+"), F.array(*map(F.lit, ("the", "en", "de", "la"))))
    lines = F.array_union(F.array(F.col("route_id").cast("string")), F.coalesce(words, F.array().cast("array<string>")))
    return net.alerts.select("alert_id", F.array_join(F.array_sort(lines), ",").alias("lines"))


_REPS = ("", "b", "bis", "t", "ter", "a", "quater")


@query(f"""with held as (select address_id, ({list(_REPS)})[1 + address_id % {len(_REPS)}] as h from addresses), asked as (select unnest({list(_REPS)}) as a)
select a as asked, count(*) as n from held, asked where a = '' or a = h or (length(a) = 1 and starts_with(h, a)) group by a""")
def repetition_matches(net: Network) -> DataFrame:
    """Addresses that each repetition fits."""
    reps = F.array(*map(F.lit, _REPS))
    held = net.addresses.select(F.element_at(reps, (F.col("address_id") % len(_REPS) + 1).cast("int")).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    pairs = held.select("n", "h", F.explode(reps).alias("asked")).where(text.repetition_fits(F.col("asked"), F.col("h")))
    return pairs.groupBy("asked").agg(F.sum("n").alias("n"))


@query("""with c as (select t.block_id, t.first_dep_s, t.trip_id, s.off, s.stop_id, lag(s.stop_id) over (partition by t.block_id order by t.first_dep_s, t.trip_id, s.off) as before from trips t join stop_times s using (trip_id) where t.service_id in (from active))
select block_id, count(*) as n, sum(stop_id)::bigint as checksum, arg_min(stop_id, (first_dep_s, trip_id, off)) as first_stop, arg_max(stop_id, (first_dep_s, trip_id, off)) as last_stop from c where before is null or before <> stop_id group by block_id""")
def block_chain(net: Network) -> DataFrame:
    """Stops of a vehicle's trips in a row, a stop that follows itself once: what a journey's line on the map is made of."""
    from .network import day_events

    order = W.partitionBy("block_id").orderBy("first_dep_s", "trip_id", "off")
    rows = day_events(net).withColumn("before", F.lag("stop_id").over(order)).where("before is null or before <> stop_id")
    at = F.struct("first_dep_s", "trip_id", "off")
    return rows.groupBy("block_id").agg(F.count("*").alias("n"), F.sum("stop_id").alias("checksum"), F.min_by("stop_id", at).alias("first_stop"), F.max_by("stop_id", at).alias("last_stop"))


@query("""with a as (select stop_id, lat, lon, ntile(2) over (order by lat, lon, stop_id) - 1 as c from stops), b as (select *, c * 2 + ntile(2) over (partition by c order by lon, lat, stop_id) - 1 as d from a)
select stop_id, (d * 2 + ntile(2) over (partition by d order by lat, lon, stop_id) - 1)::bigint as cell from b""")
def stop_cells(net: Network) -> DataFrame:
    """Eight balanced cells of stops by bisection."""
    return preprocess.cells(net.stops, 3).select("stop_id", F.col("cell").cast("long").alias("cell"))


_CELLS_SQL = "cells as (select stop_id, (d * 2 + ntile(2) over (partition by d order by lat, lon, stop_id) - 1)::bigint as cell from (select *, c * 2 + ntile(2) over (partition by c order by lon, lat, stop_id) - 1 as d from (select stop_id, lat, lon, ntile(2) over (order by lat, lon, stop_id) - 1 as c from stops)))"


@query(f"with {_CELLS_SQL}, r as (select a.trip_id, a.off, c.cell from stop_times a join stop_times b on b.trip_id = a.trip_id and b.off > a.off join cells c on c.stop_id = b.stop_id where a.pickup_type <> 1 and b.drop_off_type <> 1) select trip_id, off as board_off, bit_or(1::bigint << cell::int) as w0 from r group by 1, 2")
def ride_cells(net: Network) -> DataFrame:
    """Cells that a ride from each boarding reaches, as words of flags."""
    where = preprocess.cells(net.stops, 3)
    a = net.stop_times.where("pickup_type <> 1").select("trip_id", F.col("off").alias("board_off"))
    b = net.stop_times.where("drop_off_type <> 1").select("trip_id", "off", "stop_id")
    rows = a.join(b, "trip_id").where("off > board_off").join(where, "stop_id").select("trip_id", "board_off", F.col("cell").cast("int").alias("cell"))
    return preprocess.flag_words(rows).select("trip_id", "board_off", "w0")
