"""Routing over what can be boarded: live times, modes, headway runs, both service days; with their SQL counterparts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import boarding, calendar, realtime, router
from ..sources.derived import Network, with_views
from .journeys import START_SQL, TARGETS, _start
from .live import BEFORE_SQL, STOP_SQL, TRIP_SQL
from .network import DAY, ORIGINS, active, day_events, day_runs

QUERIES, SQL = {}, {}
NIGHT_S = 3_600


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


DAY_SQL = "day_ev as (select s.*, t.route_type, t.wheelchair from stop_times s join trips t using (trip_id) where t.service_id in (from active))"
PLAIN_SQL = "0 as shift, 0 as own_delay"
LIVE_EVENTS_SQL = f"""{TRIP_SQL}, {STOP_SQL}, {DAY_SQL}, ev as materialized (select e.trip_id, e.off, e.stop_id, e.arrival_s, greatest(e.departure_s + coalesce(s.delay_s, t.delay_s, 0), 0) as departure_s,
coalesce(s.delay_s, t.delay_s, 0) as shift, s.delay_s as own_delay, case when coalesce(s.skipped, false) then 1 else e.pickup_type end as pickup_type, case when coalesce(s.skipped, false) then 1 else e.drop_off_type end as drop_off_type
from day_ev e left join rt_stop s using (trip_id, off) left join rt_trip t using (trip_id) where not coalesce(t.canceled, false))"""
MODES_SQL = f"{DAY_SQL}, ev as materialized (select *, {PLAIN_SQL} from day_ev where route_type in (1, 3) and wheelchair <> 2 and trip_id not in (select trip_id from rt_events where canceled))"
HEADWAY_SQL = f"""{DAY_SQL}, runs as (select trip_id, start_s, unnest(range(start_s, end_s, headway_s)) as run_s from frequencies), counted as (select *, row_number() over (partition by trip_id order by run_s) as run from runs),
base as (select trip_id, arg_min(departure_s, off) as base_s from day_ev group by trip_id),
ev as materialized (select trip_id * 256 as trip_id, off, stop_id, arrival_s, departure_s, pickup_type, drop_off_type, {PLAIN_SQL} from day_ev where trip_id not in (select trip_id from frequencies)
union all select e.trip_id * 256 + run, off, stop_id, arrival_s + run_s - base_s, departure_s + run_s - base_s, pickup_type, drop_off_type, {PLAIN_SQL} from day_ev e join counted using (trip_id) join base using (trip_id))"""
DAYS_SQL = f"""{BEFORE_SQL}, {DAY_SQL}, late as (select s.* from stop_times s join trips t using (trip_id) where t.service_id in (from active_before) and greatest(arrival_s, departure_s) >= 86400),
ev as materialized (select trip_id * 256 as trip_id, off, stop_id, arrival_s, departure_s, pickup_type, drop_off_type, {PLAIN_SQL} from day_ev
union all select trip_id * 256 + 128, off, stop_id, arrival_s - 86400, departure_s - 86400, pickup_type, drop_off_type, {PLAIN_SQL} from late)"""


def boards_sql(events: str, n: int, start: str = START_SQL) -> str:
    """Tables best0 ... bestN over events with ``shift`` and ``own_delay``: each trip is boarded where it leaves earliest."""
    parts = [events, start, "best0 as materialized (from start)", "front0 as materialized (from start)"]
    for k in range(1, n + 1):
        p = k - 1
        parts += [
            f"board{k} as (select f.query_id, e.trip_id, arg_min({{o: e.off, s: e.shift}}, (e.departure_s, e.off)) as b from front{p} f join ev e using (stop_id) where e.pickup_type <> 1 and e.departure_s >= f.arr + {0 if k == 1 else 120} group by 1, 2)",
            f"ride{k} as materialized (select b.query_id, e.stop_id, min(greatest(e.arrival_s + coalesce(e.own_delay, b.b.s), 0)) as arr from board{k} b join ev e on e.trip_id = b.trip_id and e.off > b.b.o and e.drop_off_type <> 1 group by 1, 2)",
            f"front{k} as materialized (select r.* from ride{k} r left join best{p} l using (query_id, stop_id) where l.arr is null or r.arr < l.arr)",
            f"best{k} as materialized (select query_id, stop_id, min(arr)::bigint as arr from (from front{k} union all from best{p}) group by 1, 2)",
        ]
    return "with " + ",\n".join(parts)


@query(boards_sql(LIVE_EVENTS_SQL, 3) + " from best3")
def raptor_rounds_live(net: Network) -> DataFrame:
    """Delays shift boarding and arrival, cancelled trips and skipped stops are left out."""
    updates = net.rt_events
    events = boarding.live(day_events(net), realtime.stop_updates(updates), realtime.trip_delay(updates))
    return router.earliest(router.rounds(_start(net), events, None, 3))


@query(boards_sql(MODES_SQL, 3) + " from best3")
def raptor_modes(net: Network) -> DataFrame:
    """Two modes only, no trip known to be inaccessible, none of the cancelled ones."""
    events = boarding.usable(day_events(net), (1, 3), True, net.rt_events.where("canceled").select("trip_id").distinct())
    return router.earliest(router.rounds(_start(net), events, None, 3))


@query(boards_sql(HEADWAY_SQL, 3) + " from best3")
def raptor_frequency(net: Network) -> DataFrame:
    """Trips with headway windows are boarded by their runs."""
    runs = day_runs(net, net.frequencies)
    windows = cut(net.frequencies.join(runs.select("trip_id"), "trip_id", "left_semi"))
    events = cut(boarding.keyed(boarding.headway_runs(runs, windows)))
    return router.earliest(router.rounds(_start(net), events, None, 3))


_NIGHT_SQL = f"start as (select stop_id as query_id, stop_id, {NIGHT_S}::bigint as arr from stops where stop_id in {ORIGINS})"


@query(boards_sql(DAYS_SQL, 3, _NIGHT_SQL) + " from best3")
def raptor_service_days(net: Network) -> DataFrame:
    """At one in the morning the trips of the day before still run."""
    before = calendar.active_services(net.services, net.calendar_dates, DAY - dt.timedelta(days=1))
    yesterday = net.events_of(net.trips.join(before, "service_id", "left_semi"))
    events = boarding.keyed(boarding.service_days(day_events(net), yesterday))
    start = _start(net).withColumn("arr", F.lit(NIGHT_S).cast("long"))
    return router.earliest(router.rounds(start, events, None, 3))


@query(boards_sql(DAY_SQL + f", ev as materialized (select *, {PLAIN_SQL} from day_ev)", 4) + f" from best4 where stop_id in {TARGETS}")
def raptor_targets(net: Network) -> DataFrame:
    """Only labels that can still improve a target are kept; the targets' arrivals are those of the whole search."""
    targets = _start(net).select("query_id").crossJoin(net.stops.where(F.col("stop_id").isin(*TARGETS)).select("stop_id"))  # two handfuls of named stops
    labels = router.rounds(_start(net), day_runs(net), None, 4, targets=targets)
    return router.earliest(labels).where(F.col("stop_id").isin(*TARGETS))


@query("select trip_id, max(greatest(coalesce(arrival_s, 0), coalesce(departure_s, 0)) + coalesce(delay_s, 0)) as last_s from rt_events join stop_times using (trip_id, off) where not is_vehicle group by trip_id")
def rt_last_stop_time(net: Network) -> DataFrame:
    """Latest time that the updates of a trip name."""
    at = net.stop_times.select("trip_id", "off", "arrival_s", "departure_s")
    rows = net.rt_events.where("not is_vehicle").join(at, ["trip_id", "off"])
    return rows.groupBy("trip_id").agg(F.max(F.greatest("arrival_s", "departure_s") + F.coalesce("delay_s", F.lit(0))).alias("last_s"))


@query("select distinct s.trip_id, s.off, greatest(s.arrival_s - lag(s.departure_s) over (partition by s.trip_id order by s.off), 30) as run_s, lag(s.stop_id) over (partition by s.trip_id order by s.off) as from_stop from stop_times s qualify from_stop is not null")
def scheduled_run(net: Network) -> DataFrame:
    """From the stop before to each stop by schedule, half a minute at least."""
    from ..operators import timetable

    return timetable.scheduled_runs(net.stop_times)
