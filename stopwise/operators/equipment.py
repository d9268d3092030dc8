"""Lifts and escalators by stop, and what a map view is interested in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import equipment_kind, equipment_status, stop_key


def catalog(raw: DataFrame) -> DataFrame:
    """(equipment_id, stop_id, kind, status) from (equipment_id, stop_id, name, state)."""
    return raw.select("equipment_id", "stop_id", equipment_kind(F.col("name")).alias("kind"), equipment_status(F.col("state")).alias("status"))


def by_stop(items: DataFrame, stops: DataFrame) -> DataFrame:
    """(stop_id, equipment_id): equal normalised keys, or one key ending in the other from four characters on.

    Endings are exploded on both sides' longer keys, so that the search is an equi-join.
    """
    a = items.select("equipment_id", stop_key(F.col("stop_id").cast("string")).alias("a")).where("a <> ''")
    b = stops.select("stop_id", stop_key(F.col("stop_id").cast("string")).alias("b")).where("b <> ''")

    def ends(rows: DataFrame, c: str) -> DataFrame:
        cuts = F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1)))
        return rows.withColumn("end", F.explode(F.transform(cuts, lambda k: F.substring(c, k, F.length(c)))))

    one = ends(a, "a").join(b, F.col("end") == F.col("b")).select("stop_id", "equipment_id")
    other = ends(b, "b").join(a, F.col("end") == F.col("a")).select("stop_id", "equipment_id")
    return one.union(other).distinct()


def unavailable(items: DataFrame) -> DataFrame:
    return items.where("status = 'Unavailable'")


def viewport_lines(vehicles: DataFrame, box: tuple[float, float, float, float], limit: int = 40) -> DataFrame:
    """(line, n): lines seen in a box, most first."""
    from ..functions.geo import in_box

    rows = vehicles.where(in_box(F.col("lat"), F.col("lon"), *box)).groupBy("line").agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "line").limit(limit)
