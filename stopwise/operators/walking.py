"""The walk graph: pathways, transfers, hub links, sibling platforms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import walk_seconds
from .dealing import dealt_join
from .spatial import grid_join, nearest

SIBLING_S, SIBLING_M, LEAST_S = 120, 50.0, 75


def _starts(stops: DataFrame, starts: DataFrame | None) -> DataFrame:
    return stops if starts is None else stops.join(starts.select("stop_id").distinct(), "stop_id", "left_semi")


def siblings(stops: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Stops of one parent, each pair in both directions; with ``starts`` (stop_id) only the pairs from those."""
    a = _starts(stops, starts).where("parent_id is not null").select("parent_id", F.col("stop_id").alias("from_stop"))
    b = stops.where("parent_id is not null").select("parent_id", F.col("stop_id").alias("to_stop"))
    return dealt_join(a, b, ["parent_id"]).where("from_stop <> to_stop").select("from_stop", "to_stop", F.lit(SIBLING_S).alias("duration_s"), F.lit(SIBLING_M).alias("distance_m"))


def proximity(stops: DataFrame, radius_m: float, starts: DataFrame | None = None) -> DataFrame:
    """Stops within the radius that are no siblings; the walk takes the time of whole millimetres."""
    a = _starts(stops, starts).select(F.col("stop_id").alias("from_stop"), F.col("parent_id").alias("from_parent"), "lat", "lon")
    b = stops.select(F.col("stop_id").alias("to_stop"), F.col("parent_id").alias("to_parent"), "lat", "lon")
    apart = (F.col("from_stop") != F.col("to_stop")) & (F.col("distance_m") > 1.0) & ~F.coalesce(F.col("from_parent") == F.col("to_parent"), F.lit(False))
    return grid_join(a, b, radius_m).where(apart).select("from_stop", "to_stop", walk_seconds(F.round("distance_m", 3), least=LEAST_S).alias("duration_s"), "distance_m")


def star_links(stops: DataFrame, places: DataFrame, radius_m: float = 900.0, k: int = 32, digits: int | None = None) -> DataFrame:
    """(place_id, stop_id, distance_m, rank): place shells to their nearest boardable stops."""
    return nearest(places.select(F.col("stop_id").alias("place_id"), "lat", "lon"), stops, radius_m, k, "place_id", digits).where("place_id <> stop_id")


def pathway_edges(pathways: DataFrame) -> DataFrame:
    """(from_stop, to_stop, duration_s, distance_m, mode), both ways where a pathway is bidirectional."""
    back = pathways.where("is_bidirectional").select(F.col("to_stop").alias("from_stop"), F.col("from_stop").alias("to_stop"), "duration_s", "distance_m", "mode")
    return pathways.select("from_stop", "to_stop", "duration_s", "distance_m", "mode").unionByName(back)


def walk_graph(stops: DataFrame, radius_m: float, pathways: DataFrame | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(from_stop, to_stop, duration_s, distance_m): pathways first, then siblings, then proximity; a pair is taken from the first that has it.

    Pairs grow with the square of the stops in an area; with ``starts`` (stop_id) only those from these stops are made. No pair is in
    two of the sources, so that none is sorted or shuffled once it is made.
    """
    rows = siblings(stops, starts).unionByName(proximity(stops, radius_m, starts))
    if pathways is None:
        return rows
    edges = pathway_edges(pathways).groupBy("from_stop", "to_stop").agg(F.min(F.struct("duration_s", "distance_m")).alias("x")).select("from_stop", "to_stop", "x.*")
    if starts is not None:
        edges = edges.join(starts.select(F.col("stop_id").alias("from_stop")).distinct(), "from_stop", "left_semi")
    return edges.unionByName(rows.join(edges.select("from_stop", "to_stop"), ["from_stop", "to_stop"], "left_anti"))


def between(pairs: DataFrame, edges: DataFrame, stops: DataFrame, most_m: float, speed: float = 1.2) -> DataFrame:
    """(from_stop, to_stop, duration_s): the cheapest edge, else the straight line up to ``most_m`` at half a minute or more."""
    from ..functions.geo import haversine

    best = edges.groupBy("from_stop", "to_stop").agg(F.min("duration_s").alias("edge_s"))
    a = stops.select(F.col("stop_id").alias("from_stop"), "lat", "lon")
    b = stops.select(F.col("stop_id").alias("to_stop"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    rows = pairs.join(best, ["from_stop", "to_stop"], "left").join(a, "from_stop").join(b, "to_stop")
    d = haversine(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    straight = F.when(d <= most_m, walk_seconds(d, speed, 30))
    return rows.select("from_stop", "to_stop", F.coalesce("edge_s", straight).alias("duration_s")).where("duration_s is not null")
