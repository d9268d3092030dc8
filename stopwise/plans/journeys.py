"""Routing queries with their SQL counterparts, which unroll the rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine
from ..operators import router, timetable, walking
from ..sources.derived import Network, with_views
from .network import AT_S, HAVERSINE, ORIGINS, RADIUS, TRANSFERS_SQL, WALK_SQL, day_events, day_runs

QUERIES, SQL = {}, {}
ROUNDS, TARGETS = 4, (1, 2, 5, 8, 13, 21)

EVENTS_SQL = "ev as materialized (select s.* from stop_times s join trips t using (trip_id) where t.service_id in (from active))"
START_SQL = f"start as (select stop_id as query_id, stop_id, {AT_S}::bigint as arr from stops where stop_id in {ORIGINS})"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(Network(spark, folder))
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return register


def rounds_sql(n: int, walk: bool, start: str = START_SQL, events: str = EVENTS_SQL) -> str:
    """Tables best0 ... bestN (query_id, stop_id, arr) after each round."""
    parts = ([f"{WALK_SQL}"] if walk else []) + [events, start, "best0 as materialized (from start)", "front0 as materialized (from start)"]
    for k in range(1, n + 1):
        p = k - 1
        parts += [
            f"board{k} as (select f.query_id, e.trip_id, min(e.off) as off from front{p} f join ev e using (stop_id) where e.pickup_type <> 1 and e.departure_s >= f.arr + {0 if k == 1 else 120} group by 1, 2)",
            f"ride{k} as materialized (select b.query_id, e.stop_id, min(e.arrival_s) as arr from board{k} b join ev e on e.trip_id = b.trip_id and e.off > b.off and e.drop_off_type <> 1 group by 1, 2)",
            f"new{k} as materialized (select r.* from ride{k} r left join best{p} l using (query_id, stop_id) where l.arr is null or r.arr < l.arr)",
            f"mid{k} as materialized (select query_id, stop_id, min(arr) as arr from (from new{k} union all from best{p}) group by 1, 2)",
        ]
        if walk:
            parts += [
                f"hop{k} as (select n.query_id, w.to_stop as stop_id, min(n.arr + w.duration_s) as arr from new{k} n join walk w on w.from_stop = n.stop_id group by 1, 2)",
                f"walked{k} as materialized (select h.* from hop{k} h left join mid{k} l using (query_id, stop_id) where l.arr is null or h.arr < l.arr)",
                f"front{k} as materialized (select query_id, stop_id, min(arr) as arr from (from new{k} union all from walked{k}) group by 1, 2)",
                f"best{k} as materialized (select query_id, stop_id, min(arr) as arr from (from mid{k} union all from walked{k}) group by 1, 2)",
            ]
        else:
            parts += [f"front{k} as (from new{k})", f"best{k} as (from mid{k})"]
    return "with " + ",\n".join(parts)


def _start(net: Network) -> DataFrame:
    at = net.stops.where(F.col("stop_id").isin(*ORIGINS))
    return at.select(F.col("stop_id").alias("query_id"), "stop_id", F.lit(AT_S).cast("long").alias("arr"))


def _walks(net: Network) -> Callable[[DataFrame], DataFrame]:
    return lambda starts: walking.walk_graph(net.stops, RADIUS, starts=starts)


@query(rounds_sql(1, False) + " from best1")
def raptor_one_round(net: Network) -> DataFrame:
    return router.earliest(router.rounds(_start(net), day_runs(net), None, 1))


@query(rounds_sql(1, True) + " from best1")
def raptor_walk(net: Network) -> DataFrame:
    return router.earliest(router.rounds(_start(net), day_runs(net), _walks(net), 1))


@query(rounds_sql(ROUNDS, True) + f" from best{ROUNDS}")
def raptor_rounds(net: Network) -> DataFrame:
    return router.earliest(router.rounds(_start(net), day_runs(net), _walks(net), ROUNDS))


def _goal(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("stop_id").isin(*TARGETS)).select("query_id", "stop_id").distinct()


_IMPROVED = " union all ".join(f"select query_id, stop_id, {k}::int as round, arr from best{k} b where not exists (select 1 from best{k - 1} p where p.query_id = b.query_id and p.stop_id = b.stop_id and p.arr <= b.arr)" for k in range(1, ROUNDS + 1))


@query(rounds_sql(ROUNDS, True) + f" select query_id, stop_id as target, round, arr as arrival_s from ({_IMPROVED}) where stop_id in {TARGETS}")
def itineraries_by_round(net: Network) -> DataFrame:
    labels = router.rounds(_start(net), day_runs(net), _walks(net), ROUNDS)
    rows = router.per_round(labels, _goal(labels)).where("round > 0")
    return rows.select("query_id", F.col("stop_id").alias("target"), "round", F.col("arr").alias("arrival_s"))


@query()
def itineraries(net: Network) -> DataFrame:
    """Journeys with their legs; checked by replaying them in the tests."""
    labels = router.rounds(_start(net), day_runs(net), _walks(net), ROUNDS)
    found = router.reconstruct(labels, _goal(labels), ROUNDS)
    return found.withColumn("journey_id", F.substring(F.sha2(F.to_json(F.struct("query_id", "target", "legs")), 256), 1, 32))


_SEEDS_SQL = f"start as (select o * 1000000 + s as query_id, o as stop_id, s::bigint as arr from (select unnest({list(ORIGINS)})::bigint as o) cross join (select unnest(list_distinct(list_concat(range(32400 - 7200, 32401, 900), [32340]))) as s) where o in (select stop_id from stops))"


@query(rounds_sql(3, False, _SEEDS_SQL) + f" select (query_id // 1000000)::bigint as query_id, stop_id as target, max(query_id % 1000000)::bigint as leave_s from best3 where arr <= 32400 and stop_id in {TARGETS} group by 1, 2")
def arrive_by(net: Network) -> DataFrame:
    """Latest seed of the last two hours that still arrives by nine."""
    asks = net.stops.where(F.col("stop_id").isin(*ORIGINS)).select(F.col("stop_id").alias("origin"), F.lit(32_400).alias("deadline_s"))
    seeds = router.arrive_by_seeds(asks, 7_200).withColumn("query_id", F.col("origin") * 1_000_000 + F.col("seed_s"))
    labels = router.rounds(seeds.select("query_id", F.col("origin").alias("stop_id"), F.col("seed_s").alias("arr")), day_runs(net), None, 3)
    rows = router.earliest(labels).where(F.col("stop_id").isin(*TARGETS) & (F.col("arr") <= 32_400))
    return rows.groupBy(F.floor(F.col("query_id") / 1_000_000).alias("query_id"), F.col("stop_id").alias("target")).agg(F.max(F.col("query_id") % 1_000_000).alias("leave_s"))


_DAY_SQL = "ev as materialized (select s.*, t.pattern_id as line from stop_times s join trips t using (trip_id) where t.service_id in (from active))"


def _trip_rounds_sql(n: int) -> str:
    parts = [_DAY_SQL, TRANSFERS_SQL.replace("tr as (", "every as (") + ", tr as materialized (from every where to_trip <> trip_id)", START_SQL, "f0 as materialized (select query_id, trip_id, min(off) as off from start join ev using (stop_id) where pickup_type <> 1 and departure_s >= arr group by 1, 2)", "k0 as (from f0)"]
    for k in range(1, n):
        parts += [
            f"n{k} as (select query_id, to_trip as trip_id, min(to_off) as off from f{k - 1} f join tr on tr.trip_id = f.trip_id and tr.off > f.off group by 1, 2)",
            f"f{k} as materialized (select n.* from n{k} n left join k{k - 1} s using (query_id, trip_id) where s.off is null or n.off < s.off)",
            f"k{k} as materialized (select query_id, trip_id, min(off) as off from (from k{k - 1} union all from f{k}) group by 1, 2)",
        ]
    return "with " + ",\n".join(parts) + f" select query_id, stop_id, min(arrival_s) as arr from k{n - 1} f join ev e on e.trip_id = f.trip_id and e.off > f.off and e.drop_off_type <> 1 group by 1, 2"


@query(_trip_rounds_sql(3))
def tbr_rounds(net: Network) -> DataFrame:
    events = day_events(net)
    transfers = timetable.trip_transfers(events.select("trip_id", "off", "stop_id", "arrival_s", "departure_s", "pickup_type", "drop_off_type"), net.trips.select("trip_id", F.col("pattern_id").alias("line")))
    from ..lineage import cut

    return router.trip_rounds(_start(net), events, cut(transfers), 3)


@query(f"with a as (select * from stops where stop_id in {ORIGINS}), b as (select * from stops where stop_id in {TARGETS}) select a.stop_id as from_stop, b.stop_id as to_stop, greatest(ceil(round({HAVERSINE.format(a='a', b='b')}, 3) / 1.2::double)::int, 30) as walk_s from a, b where {HAVERSINE.format(a='a', b='b')} <= 20000")
def pure_walk(net: Network) -> DataFrame:
    a = net.stops.where(F.col("stop_id").isin(*ORIGINS)).select(F.col("stop_id").alias("from_stop"), "lat", "lon")
    b = net.stops.where(F.col("stop_id").isin(*TARGETS)).select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    d = F.round(haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 3)
    rows = a.crossJoin(b).withColumn("d", d).where("d <= 20000")  # two handfuls of named stops
    return rows.select("from_stop", "to_stop", F.greatest(F.ceil(F.col("d") / 1.2).cast("int"), F.lit(30)).alias("walk_s"))


_JOURNEYS_SQL = "journeys as (select trip_id as journey_id, trip_id % 300 as query_id, first_dep_s as departure_s, first_dep_s + 900 + (trip_id * 31) % 3600 as arrival_s, trip_id % 4 as transfers, (trip_id * 17) % 1500 as walk_m from trips)"


def _journeys(net: Network) -> DataFrame:
    t = F.col("trip_id")
    return net.trips.select(t.alias("journey_id"), (t % 300).alias("query_id"), F.col("first_dep_s").alias("departure_s"), (F.col("first_dep_s") + 900 + (t * 31) % 3600).alias("arrival_s"), (t % 4).alias("transfers"), ((t * 17) % 1500).alias("walk_m"))


@query(f"with {_JOURNEYS_SQL} from journeys j where not exists (select 1 from journeys o where o.query_id = j.query_id and o.arrival_s <= j.arrival_s and o.transfers <= j.transfers and o.walk_m <= j.walk_m and o.departure_s >= j.departure_s and (o.arrival_s < j.arrival_s or o.transfers < j.transfers or o.walk_m < j.walk_m or o.departure_s > j.departure_s))")
def pareto_front(net: Network) -> DataFrame:
    return router.pareto(_journeys(net))


@query(f"with {_JOURNEYS_SQL} select journey_id, query_id, (row_number() over (partition by query_id order by arrival_s, arrival_s - departure_s, transfers, departure_s, walk_m, journey_id))::int as rank from journeys")
def journey_sort(net: Network) -> DataFrame:
    return router.ranked(_journeys(net)).select("journey_id", "query_id", "rank")


@query(f"with {_JOURNEYS_SQL} select journey_id, query_id, (row_number() over (partition by query_id order by departure_s desc, arrival_s, transfers, walk_m, arrival_s - departure_s, journey_id))::int as rank from journeys")
def journey_sort_arrive_by(net: Network) -> DataFrame:
    return router.ranked(_journeys(net), True).select("journey_id", "query_id", "rank")
