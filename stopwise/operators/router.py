"""Round-based routing of many queries at once.

A label says when a query reaches a stop. A round boards every trip that can still be caught at a stop whose label
improved, rides it on, keeps the best arrival of each stop, and walks one hop from stops that riding improved. Queries
(and departure seeds) are rows, so a batch of any size is the same few joins per round; the driver only loops over rounds.
Each round's labels are cut from their lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut

KEY = ["query_id", "stop_id"]
#: How a label came about: start, ride of a trip, walk.
START, RIDE, WALK = "start", "ride", "walk"


def max_rounds(rounds: int, max_transfers: int) -> int:
    return min(12, max(rounds, max_transfers + 2, 4))


def ride(frontier: DataFrame, events: DataFrame, buffer_s: int) -> DataFrame:
    """(query_id, stop_id, arr, trip_id, board_stop, board_off, board_s, off): every stop that the boarded trips reach.

    Of each trip the stop where it leaves earliest of those where it can be caught is boarded. A stop is reached with its own delay if it has one, else with the
    delay at boarding.
    """
    boards = frontier.join(events.where("pickup_type <> 1").select("stop_id", "trip_id", "off", "departure_s", "shift"), "stop_id").where(F.col("departure_s") >= F.col("arr") + buffer_s)
    boards = boards.groupBy("query_id", "trip_id").agg(F.min(F.struct(F.col("departure_s").alias("board_s"), F.col("off").alias("board_off"), F.col("stop_id").alias("board_stop"), "shift")).alias("b"))
    onward = events.where("drop_off_type <> 1").select("trip_id", "off", "stop_id", "arrival_s", "own_delay")
    arr = F.greatest(F.col("arrival_s") + F.coalesce("own_delay", "b.shift"), F.lit(0)).cast("long")
    out = boards.join(onward, "trip_id").where(F.col("off") > F.col("b.board_off"))
    return out.select("query_id", "stop_id", arr.alias("arr"), "trip_id", "b.board_stop", "b.board_off", "b.board_s", "off")


def _best(rows: DataFrame) -> DataFrame:
    """Of each query and stop the earliest row; ties by trip and offsets."""
    rest = [c for c in rows.columns if c not in KEY]
    return rows.groupBy(*KEY).agg(F.min(F.struct("arr", *[c for c in rest if c != "arr"])).alias("x")).select(*KEY, *(f"x.{c}" for c in rest))


def _improving(rows: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(*KEY, F.col("arr").alias("known"))
    return rows.join(known, KEY, "left").where(F.col("known").isNull() | (F.col("arr") < F.col("known"))).drop("known")


def rounds(start: DataFrame, events: DataFrame, walks: DataFrame | Callable[[DataFrame], DataFrame] | None, n: int, buffer_s: int = 120, targets: DataFrame | None = None) -> DataFrame:
    """Labels of all rounds: (query_id, stop_id, arr, round, kind, trip_id, board_stop, board_off, board_s, off, from_stop).

    ``start`` (query_id, stop_id, arr); no buffer before the first boarding. A stop has a row for each round that improved it.
    ``walks`` (from_stop, to_stop, duration_s) may be a function that makes them from given stops (stop_id): walks between all stops grow with the
    square of the stops, those from stops that rides reach do not.
    Round k's rides and walks have ``round`` k, starting from 1; the start has 0. The strict one-hop walk is used: only
    stops improved by riding in this round are walked from. With ``targets`` (query_id, stop_id), labels that are not earlier than the query's
    latest best target cannot improve one and are not kept; labels of the targets themselves stay exact.
    """
    nothing = {c: F.lit(None).cast("long") for c in ("trip_id", "board_stop", "board_off", "board_s", "off", "from_stop")}
    labels = cut(start.select(*KEY, F.col("arr").cast("long").alias("arr"), F.lit(0).alias("round"), F.lit(START).alias("kind"), *(v.alias(c) for c, v in nothing.items())))
    every, frontier = labels, labels.select(*KEY, "arr")
    for c in ("shift", "own_delay"):
        if c not in events.columns:
            events = events.withColumn(c, F.lit(0).cast("long"))
    events = events.select("trip_id", "off", "stop_id", "arrival_s", "departure_s", "pickup_type", "drop_off_type", "shift", "own_delay").persist()
    wanted = None if targets is None else targets.select(*KEY).distinct()
    for k in range(1, n + 1):
        best = earliest(every)  # over the cut labels of all rounds, which are small beside the events
        rides = _improving(_best(ride(frontier, events, 0 if k == 1 else buffer_s)), best)
        if wanted is not None:
            rides = _within(rides, best, wanted)
        rides = cut(rides.select(*KEY, "arr", F.lit(k).alias("round"), F.lit(RIDE).alias("kind"), "trip_id", "board_stop", "board_off", "board_s", "off", F.lit(None).cast("long").alias("from_stop")))
        new = rides
        if walks is not None:
            edges = walks(rides.select("stop_id").distinct()) if callable(walks) else walks
            hops = rides.select("query_id", F.col("stop_id").alias("from_stop"), "arr").join(edges.select("from_stop", F.col("to_stop").alias("stop_id"), "duration_s"), "from_stop")
            hops = _improving(_best(hops.select("query_id", "stop_id", (F.col("arr") + F.col("duration_s")).cast("long").alias("arr"), "from_stop")), earliest(every.union(rides)))
            hops = cut(hops.select(*KEY, "arr", F.lit(k).alias("round"), F.lit(WALK).alias("kind"), *(nothing[c].alias(c) for c in ("trip_id", "board_stop", "board_off", "board_s", "off")), "from_stop"))
            new = rides.union(hops)
        frontier = new.groupBy(*KEY).agg(F.min("arr").alias("arr"))
        every = every.union(new)
        if rides.isEmpty():
            break
    events.unpersist()  # the labels are cut, so nothing asks for the events again
    return every


def _within(rows: DataFrame, best: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows that can still improve a target of their query: all while a target is not reached, then those before the latest best target."""
    reached = targets.join(best, KEY, "left").groupBy("query_id").agg(F.when(F.count_if(F.col("arr").isNull()) == 0, F.max("arr")).alias("limit"))
    return rows.join(reached, "query_id", "left").where(F.col("limit").isNull() | (F.col("arr") < F.col("limit"))).drop("limit")


def earliest(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*KEY).agg(F.min("arr").alias("arr"))


def per_round(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, stop_id, round, arr): at the targets each round that arrives earlier than all before."""
    rows = labels.join(targets, KEY, "left_semi").groupBy(*KEY, "round").agg(F.min("arr").alias("arr"))
    before = F.min("arr").over(W.partitionBy(*KEY).orderBy("round").rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("arr") < F.col("before"))).drop("before")


def reconstruct(labels: DataFrame, targets: DataFrame, n: int) -> DataFrame:
    """(query_id, target, round, departure_s, arrival_s, transfers, walk_legs, legs): journeys of the targets' best labels per round.

    ``legs`` are structs (kind, from_stop, to_stop, trip_id, board_off, off, departure_s, arrival_s) in travel order. One backward
    step is one join of the few targets with the labels.
    """
    rank = F.row_number().over(W.partitionBy(*KEY, "round").orderBy("arr", F.when(F.col("kind") == RIDE, 0).otherwise(1)))
    one = cut(labels.withColumn("n", rank).where("n = 1").drop("n"))
    goal = per_round(one, targets).select("query_id", F.col("stop_id").alias("target"), "round")
    fields = "array<struct<kind:string,from_stop:long,to_stop:long,trip_id:long,board_off:long,off:long,departure_s:long,arrival_s:long>>"
    ride_leg = F.struct(F.lit(RIDE).alias("kind"), F.col("board_stop").alias("from_stop"), F.col("stop_id").alias("to_stop"), "trip_id", "board_off", "off", F.col("board_s").alias("departure_s"), F.col("arr").alias("arrival_s"))
    left = goal.select("query_id", "target", F.col("round").alias("at_round"), F.col("target").alias("stop_id"), F.col("round").alias("goal_round"), F.lit(None).cast("long").alias("must"), F.array().cast(fields).alias("legs"))
    done = None
    for _ in range(2 * n + 1):
        # the label used is the last one of a round not after this one (and, behind a walk, the ride of the same round)
        found = left.join(one.withColumnRenamed("round", "r"), KEY).where((F.col("r") <= F.col("at_round")) & (F.col("must").isNull() | (F.col("kind") != WALK)))
        pick = F.row_number().over(W.partitionBy("query_id", "target", "goal_round").orderBy(F.desc("r"), "arr"))
        found = found.withColumn("n", pick).where("n = 1").drop("n", "at_round")
        found = cut(found)
        ended = found.where(F.col("kind") == START).select("query_id", "target", "goal_round", F.col("arr").alias("start_s"), F.col("stop_id").alias("origin"), "legs")
        done = ended if done is None else done.union(ended)
        walked = F.struct(F.lit(WALK).alias("kind"), "from_stop", F.col("stop_id").alias("to_stop"), *(F.lit(None).cast("long").alias(c) for c in ("trip_id", "board_off", "off", "departure_s")), F.col("arr").alias("arrival_s"))
        leg = F.when(F.col("kind") == RIDE, F.array(ride_leg)).otherwise(F.array(walked)).cast(fields)
        back = F.when(F.col("kind") == RIDE, F.col("board_stop")).otherwise(F.col("from_stop"))
        at = F.when(F.col("kind") == RIDE, F.col("r") - 1).otherwise(F.col("r"))
        left = found.where(F.col("kind") != START).select("query_id", "target", at.alias("at_round"), back.alias("stop_id"), "goal_round", F.when(F.col("kind") == WALK, F.lit(1)).cast("long").alias("must"), F.concat(leg, F.col("legs")).alias("legs"))
        if left.isEmpty():
            break
    rides = F.filter("legs", lambda x: x["kind"] == RIDE)
    return done.select(
        "query_id", "target", F.col("goal_round").alias("round"), "origin", F.get(rides, F.lit(0))["departure_s"].alias("departure_s"), F.element_at("legs", -1)["arrival_s"].alias("arrival_s"),
        F.greatest(F.size(rides) - 1, F.lit(0)).alias("transfers"), (F.size("legs") - F.size(rides)).alias("walk_legs"), "legs",
    ).where(F.size("legs") > 0)


def trip_rounds(start: DataFrame, events: DataFrame, transfers: DataFrame, n: int) -> DataFrame:
    """(query_id, stop_id, arr) by the trip-based search: rounds hop along precomputed trip-to-trip transfers.

    State is the earliest offset at which a query is on a trip; a round continues only segments that came earlier onto a trip.
    """
    boards = start.join(events.where("pickup_type <> 1"), "stop_id").where(F.col("departure_s") >= F.col("arr"))
    frontier = cut(boards.groupBy("query_id", "trip_id").agg(F.min("off").alias("off")))
    known, reached = frontier, None
    hop = transfers.select("trip_id", F.col("off").alias("alight"), "to_trip", "to_off")
    onward = events.where("drop_off_type <> 1").select("trip_id", F.col("off").alias("at"), "stop_id", "arrival_s")
    for _ in range(n):
        got = frontier.join(onward, "trip_id").where("at > off").groupBy("query_id", "stop_id").agg(F.min("arrival_s").alias("arr"))
        reached = got if reached is None else reached.union(got)
        nexts = frontier.join(hop, "trip_id").where("alight > off").groupBy("query_id", F.col("to_trip").alias("trip_id")).agg(F.min("to_off").alias("off"))
        old = known.select("query_id", "trip_id", F.col("off").alias("seen"))
        frontier = cut(nexts.join(old, ["query_id", "trip_id"], "left").where("seen is null or off < seen").drop("seen"))
        known = cut(known.union(frontier).groupBy("query_id", "trip_id").agg(F.min("off").alias("off")))
        reached = cut(reached.groupBy("query_id", "stop_id").agg(F.min("arr").alias("arr")))
        if frontier.isEmpty():
            break
    return reached


def arrive_by_seeds(queries: DataFrame, look_back_s: int = 21_600, step_s: int = 900) -> DataFrame:
    """(query_id, seed_s, stop_id, deadline_s): departure seeds every quarter of an hour before the deadline, and one a minute before it."""
    steps = F.concat(F.sequence(F.col("deadline_s") - look_back_s, F.col("deadline_s"), F.lit(step_s)), F.array(F.col("deadline_s") - 60))
    return queries.withColumn("seed_s", F.explode(F.array_distinct(steps)))


def pareto(journeys: DataFrame, group: str = "query_id") -> DataFrame:
    """Journeys that no other one of the query beats: arrival, transfers and walk not more, departure not less, one of them better.

    Journeys beaten by the one of least walk among the earlier arrivals of as many transfers go first, in one pass by arrival; only those left are compared with each other.
    """
    earlier = W.partitionBy(group, "transfers").orderBy("arrival_s").rangeBetween(W.unboundedPreceding, -1)
    least = F.min(F.struct("walk_m", (-F.col("departure_s")).alias("back"))).over(earlier)
    beaten = (F.col("least.walk_m") <= F.col("walk_m")) & (-F.col("least.back") >= F.col("departure_s"))
    journeys = journeys.withColumn("least", least).where(~F.coalesce(beaten, F.lit(False))).drop("least")
    cols = ["arrival_s", "transfers", "walk_m", "departure_s"]
    other = journeys.select(F.col(group).alias("o_group"), *(F.col(c).alias(f"o_{c}") for c in cols)).distinct()
    better = (F.col("o_arrival_s") <= F.col("arrival_s")) & (F.col("o_transfers") <= F.col("transfers")) & (F.col("o_walk_m") <= F.col("walk_m")) & (F.col("o_departure_s") >= F.col("departure_s"))
    strict = (F.col("o_arrival_s") < F.col("arrival_s")) | (F.col("o_transfers") < F.col("transfers")) | (F.col("o_walk_m") < F.col("walk_m")) | (F.col("o_departure_s") > F.col("departure_s"))
    return journeys.join(other, (F.col(group) == F.col("o_group")) & better & strict, "left_anti")


def ranked(journeys: DataFrame, arrive_by: bool = False, group: str = "query_id") -> DataFrame:
    """``rank`` of each journey in its query, in the order for departing or for arriving."""
    duration = F.col("arrival_s") - F.col("departure_s")
    order = [F.desc("departure_s"), "arrival_s", "transfers", "walk_m", duration, "journey_id"] if arrive_by else ["arrival_s", duration, "transfers", "departure_s", "walk_m", "journey_id"]
    return journeys.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def departure_seeds(origins: DataFrame, events: DataFrame, window_s: int) -> DataFrame:
    """(query_id, seed_s, stop_id): every distinct departure from a query's stops within the window, for (query_id, stop_id, arr).

    One batch over all seeds takes the place of searching again from just after each journey found.
    """
    boards = origins.join(events.where("pickup_type <> 1").select("stop_id", "departure_s"), "stop_id")
    return boards.where((F.col("departure_s") >= F.col("arr")) & (F.col("departure_s") < F.col("arr") + window_s)).select("query_id", F.col("departure_s").alias("seed_s"), "stop_id").distinct()


def profile(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(query_id, stop_id, seed_s, arr): of labels with ``seed_s`` those that no later departure reaches as early."""
    best = labels.join(targets, KEY, "left_semi").groupBy(*KEY, "seed_s").agg(F.min("arr").alias("arr"))
    later = F.min("arr").over(W.partitionBy(*KEY).orderBy(F.desc("seed_s")).rowsBetween(W.unboundedPreceding, -1))
    return best.withColumn("later", later).where(F.col("later").isNull() | (F.col("arr") < F.col("later"))).drop("later")
