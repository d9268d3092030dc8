"""Fare estimates."""

from __future__ import annotations

from functools import reduce
from itertools import product
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lineage import cut
from .dealing import if_small

# What a rule can ask of a leg, with the weight of its being asked.
FILTERS = (("route_id", 4), ("origin_id", 2), ("destination_id", 2), ("contains_id", 1))


def best_fares(legs: DataFrame, rules: DataFrame, fares: DataFrame, unpriced: bool = False) -> DataFrame:
    """(leg columns, fare_id, price, currency, transfers, duration_s): for each leg the most specific rule, then the cheapest, then the least id; legs without a rule go, or stay ``unpriced``.

    A rule's null filters match anything; ``contains_id`` matches either zone of the leg. Instead of a nested loop, a leg is looked up under each of the keys
    that a rule for it can have (each filter set or open, the last one under both zones), and of the rules of one key only the best is kept. What is looked up are the distinct routes and zones of
    legs, which are few beside the legs; of these each leg then takes its fare.
    """
    names = [name for name, _ in FILTERS]

    def key(values: list[Column]) -> Column:
        return F.concat_ws("|", *(F.coalesce(v.cast("string"), F.lit("*")) for v in values))

    weight = sum((F.when(F.col(name).isNotNull(), w).otherwise(0) for name, w in FILTERS), F.lit(0))
    priced = rules.join(fares, "fare_id").select(weight.alias("weight"), key([F.col(n) for n in names]).alias("key"), "price", "fare_id", "currency", "transfers", "duration_s")
    best_rule = priced.groupBy("key", "weight").agg(F.min(F.struct("price", "fare_id", "currency", "transfers", "duration_s")).alias("r"))
    keys = []
    for sets in product((False, True), repeat=len(FILTERS)):
        for zone in ("origin_id", "destination_id") if sets[-1] else ("",):
            columns = [*names[:-1], zone]
            usable = F.lit(True)
            for name, used in zip(columns, sets, strict=True):
                usable = usable & F.col(name).isNotNull() if used else usable
            keys.append(F.when(usable, key([F.col(n) if used else F.lit(None) for n, used in zip(columns, sets, strict=True)])))
    kind = names[:-1]
    tried = legs.select(*kind).distinct().withColumn("key", F.explode(F.array_distinct(F.array_compact(F.array(*keys))))).join(best_rule, "key")
    best = F.min(F.struct((-F.col("weight")).alias("w"), "r")).alias("x")
    found = if_small(cut(tried.groupBy(*(F.col(c).alias(f"of_{c}") for c in kind)).agg(best)))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in kind))
    return legs.join(found, same, "left" if unpriced else "inner").select(*legs.columns, "x.r.fare_id", "x.r.price", "x.r.currency", "x.r.transfers", "x.r.duration_s")


def journey_fares(legs: DataFrame) -> DataFrame:
    """(journey_id, price, tickets) for legs (journey_id, leg, board_s, fare_id, price, currency, transfers, duration_s); unpriced or mixed currency gives null.

    Legs are folded in order: a held ticket of the same fare serves again while transfers are left (null: any number) and
    its first boarding is not longer ago than the fare's duration (null: any time).
    """
    ordered = F.array_sort(F.collect_list(F.struct("leg", "board_s", "fare_id", "price", "transfers", "currency", "duration_s")))
    rows = legs.groupBy("journey_id").agg(ordered.alias("legs"))
    start = F.struct(F.lit(0.0).alias("price"), F.lit(0).alias("tickets"), F.lit(None).cast("long").alias("held"), F.lit(0).alias("used"), F.lit(0).cast("long").alias("since"))

    def fold(now, leg):
        again = (now["held"] == leg["fare_id"]) & (leg["transfers"].isNull() | (now["used"] < leg["transfers"])) & (leg["duration_s"].isNull() | (leg["board_s"] - now["since"] <= leg["duration_s"]))
        again = F.coalesce(again, F.lit(False))
        return F.struct(
            F.when(again, now["price"]).otherwise(now["price"] + leg["price"]).alias("price"), F.when(again, now["tickets"]).otherwise(now["tickets"] + 1).alias("tickets"),
            leg["fare_id"].alias("held"), F.when(again, now["used"] + 1).otherwise(F.lit(0)).alias("used"), F.when(again, now["since"]).otherwise(leg["board_s"]).cast("long").alias("since"),
        )

    total = F.aggregate("legs", start, fold)
    priced = F.forall("legs", lambda x: x["fare_id"].isNotNull()) & (F.size(F.array_distinct(F.transform("legs", lambda x: x["currency"]))) == 1)
    rows = rows.select("journey_id", priced.alias("priced"), total.alias("t"))
    return rows.select("journey_id", F.when(F.col("priced"), F.col("t.price")).alias("price"), F.when(F.col("priced"), F.col("t.tickets")).alias("tickets"))
