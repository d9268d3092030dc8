"""Polylines: interpolation, projection of stops, units of distance, simplification.

Scans along a line in which each step depends on the one before are Arrow-batched pandas functions; everything else is an expression.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M

SLACK_M, UNIT_TOLERANCE = 25.0, 0.25
#: Metres in a feed's unit of distance: metre, kilometre, foot, mile.
UNITS = (1.0, 1000.0, 0.3048, 1609.344)


def metres(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Distance of each point from the one before; the first is 0."""
    p, q = np.radians(lat), np.radians(lon)
    a = np.sin(np.diff(p) / 2) ** 2 + np.cos(p[:-1]) * np.cos(p[1:]) * np.sin(np.diff(q) / 2) ** 2
    return np.r_[0.0, 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(a)))]


def along(lat: np.ndarray, lon: np.ndarray, a: float, b: float, share: float) -> tuple[float, float] | None:
    """Point at ``share`` of the way from distance ``a`` to ``b`` along the line, backwards too; none under half a metre."""
    total = np.cumsum(metres(lat, lon))
    if abs(b - a) < 0.5:
        return None
    at = a + share * (b - a)
    return float(np.interp(at, total, lat)), float(np.interp(at, total, lon))


def monotone(lat: np.ndarray, lon: np.ndarray, stop_lat: np.ndarray, stop_lon: np.ndarray) -> list[int]:
    """For each stop in order the vertex where the line passes it, never before the last stop's vertex.

    Of the vertices from there on the first whose distance is within the slack of the least one is taken, so that loops and
    out-and-back lines are not skipped.
    """
    out, low = [], 0
    for y, x in zip(stop_lat, stop_lon, strict=True):
        cos = max(0.2, math.cos(math.radians(y)))
        d = np.hypot((lat[low:] - y) * 111_320, (lon[low:] - x) * 111_320 * cos)
        low += int(np.argmax(d <= d.min() + SLACK_M))
        out.append(low)
    return out


def snapped_unit(metres_per_unit: float) -> float:
    """The known unit within a quarter of the measured ratio, else the ratio itself."""
    near = [u for u in UNITS if abs(metres_per_unit / u - 1) <= UNIT_TOLERANCE]
    return min(near, key=lambda u: abs(metres_per_unit / u - 1)) if near else metres_per_unit


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker with an explicit stack: vertices farther than ``tolerance`` from the chord stay."""
    if len(points) < 3:
        return points
    xy, keep, todo = np.array(points), {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        chord, rel = xy[b] - xy[a], xy[a + 1 : b] - xy[a]
        length = np.hypot(*chord)
        d = np.abs(chord[0] * rel[:, 1] - chord[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        k = int(np.argmax(d))
        if d[k] > tolerance:
            keep.add(a + 1 + k)
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return [points[k] for k in sorted(keep)]


def simplify(lines: DataFrame, tolerance: float) -> DataFrame:
    """(id, points) with fewer points; points are array<struct<lat, lon>>."""
    from ..shipping import ship

    ship(lines.sparkSession)

    @F.pandas_udf("array<struct<lat:double,lon:double>>")
    def run(points: pd.Series) -> pd.Series:
        return points.map(lambda ps: [{"lat": a, "lon": b} for a, b in simplified([(p["lat"], p["lon"]) for p in ps], tolerance)])

    return lines.withColumn("points", run("points"))


def stop_vertices(trips: DataFrame) -> DataFrame:
    """(trip_id, vertices) for (trip_id, points, stops), both arrays of struct<lat, lon> in order."""
    from ..shipping import ship

    ship(trips.sparkSession)

    @F.pandas_udf("array<int>")
    def run(points: pd.Series, stops: pd.Series) -> pd.Series:
        def one(ps, ss):
            split = lambda rows: (np.array([r["lat"] for r in rows]), np.array([r["lon"] for r in rows]))
            return monotone(*split(ps), *split(ss))

        return pd.Series([one(p, s) for p, s in zip(points, stops, strict=True)])

    return trips.select("trip_id", run("points", "stops").alias("vertices"))


def shape_distances(shapes: DataFrame) -> DataFrame:
    """(shape_id, k, lat, lon, total_m) of (shape_id, points): cumulative metres by a window, one row for each vertex."""
    from ..functions.geo import haversine

    rows = shapes.select("shape_id", F.posexplode("points").alias("k", "p")).select("shape_id", "k", "p.lat", "p.lon")
    w = W.partitionBy("shape_id").orderBy("k")
    leg = F.coalesce(haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return rows.withColumn("leg", leg).withColumn("total_m", F.sum("leg").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("leg")


def sliced(points: Column, first: Column, last: Column) -> Column:
    """Vertices from one index to another, both included, consecutive repeats dropped."""
    part = F.slice(points, first + 1, F.greatest(last - first + 1, F.lit(0)))
    kept = F.filter(part, lambda p, k: (k == 0) | (p != F.get(part, k - 1)))
    return kept
