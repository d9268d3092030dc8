"""State tables of streams as batch operators: latest values, evictions, caps, quotas, buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIP_TTL_S, VEHICLE_TTL_S, ALERT_TTL_S = 7_200, 900, 21_600


def evicted(state: DataFrame, now: Column, ttl_s: int, cap: int, seen: str, last: str | None = None) -> DataFrame:
    """Rows that stay: seen (and, where given, going on) within the time to live; of these the ``cap`` newest by ``seen``, then by key."""
    fresh = state.where(F.col(seen) >= now - ttl_s)
    if last:
        fresh = fresh.where(F.col(last).isNull() | (F.col(last) >= now - ttl_s))
    return fresh.orderBy(F.desc(seen), "key").limit(cap)


def newest(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The ``n`` newest rows of each group."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(order), "key"))
    return rows.withColumn("n", rank).where(F.col("n") <= n).drop("n")


def daily_quota(requests: DataFrame, budget: int, zone: str = "Europe/Paris") -> DataFrame:
    """``granted``: the first ``budget`` requests of each local day."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    rank = F.row_number().over(W.partitionBy("day", "client").orderBy("ts", "event_id"))
    return requests.withColumn("day", day).withColumn("granted", rank <= budget)


def token_bucket(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(client, granted, refused): requests of each client folded in order through a bucket."""
    times = F.array_sort(F.collect_list("at_s"))
    rows = requests.groupBy("client").agg(times.alias("times"))
    start = F.struct(F.lit(float(burst)).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("granted"))

    def fold(now, at):
        tokens = F.least(F.lit(float(burst)), now["tokens"] + F.coalesce(at - now["last"], F.lit(0.0)) * rate)
        ok = tokens >= 1.0
        return F.struct(F.when(ok, tokens - 1.0).otherwise(tokens).alias("tokens"), at.alias("last"), (now["granted"] + F.when(ok, 1).otherwise(0)).cast("long").alias("granted"))

    granted = F.aggregate("times", start, fold, lambda s: s["granted"])
    return rows.select("client", granted.alias("granted"), (F.size("times") - granted).alias("refused"))
