"""From live references to static trips: exact, alias, time, unique tail; each step only for what the steps before left over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lineage import cut

TOLERANCE_S, AMBIGUOUS_S, CERTAIN_S = 900, 120, 60
TAIL_LEAST, TAIL_INSIDE = 6, 8


def by_keys(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(ref, trip_id): refs (ref, candidates array) by the first candidate that is a key (key, trip_id); the first key of a name wins."""
    first = keys.groupBy("key").agg(F.min("trip_id").alias("trip_id"))
    tried = refs.select("ref", F.posexplode("candidates").alias("at", "key"))
    return tried.join(first, "key").groupBy("ref").agg(F.min_by("trip_id", "at").alias("trip_id"))


def by_time(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """(ref, trip_id): refs (ref, line, at_s) to the trip of the line whose departure is nearest within the tolerance, of equals the least trip.

    ``runs`` (line, trip_id, dep_s) are on the clock of ``at_s`` (``on_clock``). A trip with another one of its line within two minutes is
    ambiguous unless it is within one minute of the reference. References and runs of a line are merged by time, in slots as
    long as the tolerance to which runs of the neighbouring slots are added, so that no pair of them is made.
    """
    near = W.partitionBy("line").orderBy("dep_s").rangeBetween(-AMBIGUOUS_S, AMBIGUOUS_S)
    # counted by line and time: a line has at most a day of seconds
    per = runs.groupBy("line", "dep_s").agg(F.min("trip_id").alias("trip_id"), F.count_distinct("trip_id").alias("n"))
    per = per.withColumn("close", F.sum("n").over(near)).drop("n")
    slot = F.floor(F.col("dep_s") / TOLERANCE_S)
    there = per.select("line", F.explode(F.array(slot - 1, slot, slot + 1)).alias("slot"), F.col("dep_s").alias("t"), F.struct("dep_s", "trip_id", "close").alias("run"), F.lit(None).cast(refs.schema["ref"].dataType).alias("ref"))
    asks = refs.select("line", F.floor(F.col("at_s") / TOLERANCE_S).alias("slot"), F.col("at_s").alias("t"), F.lit(None).cast(there.schema["run"].dataType).alias("run"), "ref")
    # both ways from the first row on: a frame that reaches to the end is gone through anew for each row
    w, so_far = W.partitionBy("line", "slot"), (W.unboundedPreceding, W.currentRow)
    before = w.orderBy("t", F.col("ref").isNotNull()).rowsBetween(*so_far)
    after = w.orderBy(F.desc("t"), F.col("ref").isNotNull()).rowsBetween(*so_far)
    both = there.unionByName(asks).withColumn("a", F.last("run", True).over(before)).withColumn("b", F.last("run", True).over(after)).where("ref is not null")
    found = [F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.dep_s") - F.col("t")).alias("delta"), F.col(f"{c}.trip_id").alias("trip_id"), F.col(f"{c}.close").alias("close"))) for c in "ab"]
    both = both.select("ref", F.least(*found).alias("x"))
    return both.where((F.col("x.delta") <= TOLERANCE_S) & ((F.col("x.close") <= 1) | (F.col("x.delta") <= CERTAIN_S))).select("ref", "x.trip_id")


def on_clock(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    """(line, trip_id, dep_s) of both days' trips on today's clock; of the day before those of its second half, 24 hours earlier."""
    return today.unionByName(yesterday.where(F.col("dep_s") >= 43_200).withColumn("dep_s", F.col("dep_s") - 86_400))


def by_tail(refs: DataFrame, trips: DataFrame, least: int = TAIL_LEAST, inside: int = TAIL_INSIDE) -> DataFrame:
    """(ref, trip_id): refs (ref, tail) whose tail ends exactly one trip's name (name, trip_id), or stands anywhere in it from ``inside`` letters on.

    Names are filed under their endings, and from ``inside`` letters on under all their parts, of the lengths that tails have, which makes
    the search an equi-join. A name gives no more parts than it has letters for each length; trips of one name and names of one part
    are brought down to their least and greatest trip before anything is joined, which are the same where there is one.
    """
    asks = refs.where(F.length("tail") >= least)
    lengths = [r[0] for r in asks.select(F.length("tail").alias("n")).distinct().collect()]  # as many as a name has letters
    if not lengths:
        return asks.join(trips.limit(0), F.lit(False)).select("ref", "trip_id")
    anywhere, at_end = "transform(sequence(1, length(name) - {n} + 1), k -> substring(name, k, {n}))", "array(right(name, {n}))"
    parts = [F.expr(f"case when length(name) >= {n} then {(anywhere if n >= inside else at_end).format(n=n)} end") for n in sorted(lengths)]
    names = trips.groupBy("name").agg(F.min("trip_id").alias("low"), F.max("trip_id").alias("high"))
    ends = names.select("low", "high", F.explode(F.array_distinct(F.flatten(F.array_compact(F.array(*parts))))).alias("tail"))
    ends = ends.groupBy("tail").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    hits = asks.join(ends, "tail").groupBy("ref").agg(F.min("low").alias("trip_id"), F.max("high").alias("high"))
    return hits.where("trip_id = high").select("ref", "trip_id")


def by_descriptor(refs: DataFrame, live: DataFrame) -> DataFrame:
    """(ref, trip_id): refs (ref, route_id, direction_id, start_date) that name a route, and a direction and date or not, to the least live trip of that kind.

    ``live`` (trip_id, route_id, direction_id, start_date). Routes are equal as they stand, or one is the other's name without its feed. What a
    reference names the live trip has to have.
    """
    tail = F.element_at(F.split("route_id", ":"), -1)
    keys = live.where("route_id is not null").select("trip_id", F.col("direction_id").alias("d"), F.col("start_date").alias("s"), F.explode(F.array_distinct(F.array(F.struct(F.lit("as it is").alias("how"), F.col("route_id").alias("key")), F.struct(F.lit("tail").alias("how"), tail.alias("key"))))).alias("k")).select("trip_id", "d", "s", "k.*")
    # the least trip of each route, direction and date, and of each with the direction, the date or both left open: a reference meets one row of it
    least = keys.groupBy("how", "key", "d", "s").agg(F.min("trip_id").alias("trip_id"))
    open_d, open_s = (F.lit(None).cast(keys.schema[c].dataType) for c in "ds")
    sides = [F.when(given, F.struct(d.alias("d"), s.alias("s"))) for d, s, given in ((F.col("d"), F.col("s"), F.col("d").isNotNull() & F.col("s").isNotNull()), (F.col("d"), open_s, F.col("d").isNotNull()), (open_d, F.col("s"), F.col("s").isNotNull()), (open_d, open_s, F.lit(True)))]
    least = least.select("how", "key", "trip_id", F.explode(F.array_compact(F.array(*sides))).alias("x")).groupBy(F.col("how").alias("l_how"), F.col("key").alias("l_key"), "x.d", "x.s").agg(F.min("trip_id").alias("trip_id"))
    asks = refs.select("ref", "direction_id", "start_date", F.explode(F.array_distinct(F.array(F.struct(F.lit("as it is").alias("how"), F.col("route_id").alias("key")), F.struct(F.lit("tail").alias("how"), F.col("route_id").alias("key")), F.struct(F.lit("as it is").alias("how"), tail.alias("key"))))).alias("k")).select("ref", "direction_id", "start_date", "k.*")
    same = (F.col("how") == F.col("l_how")) & (F.col("key") == F.col("l_key")) & F.col("d").eqNullSafe(F.col("direction_id")) & F.col("s").eqNullSafe(F.col("start_date"))
    return asks.join(least, same).groupBy("ref").agg(F.min("trip_id").alias("trip_id"))


def cascade(refs: DataFrame, steps: list) -> DataFrame:
    """(ref, trip_id, step): ``steps`` are (name, function of the refs still open); earlier ones win.

    What a step found and what it left over are cut from their lineage: else each step would run all steps before it twice.
    """
    found, left = None, cut(refs)
    for k, (name, step) in enumerate(steps):
        part = cut(step(left).withColumn("step", F.lit(name)))
        found = part if found is None else found.unionByName(part)
        if k + 1 < len(steps):
            left = cut(left.join(part.select("ref"), "ref", "left_anti"))
    return found
