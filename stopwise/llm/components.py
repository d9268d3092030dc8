"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step keeps a forest with the same components and at most as many edges; the number of steps
grows with the logarithm of the longest path. Edges stay in tables, never on the driver; a node with a large share
of the edges is met by a broadcast of its own row (``common.spread_join``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import release
from .common import cut_lineage, spread_join


#: Edges of a node that one task may hold.
HOT_EDGES = 50_000


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows")).select("u", F.least("u", "m").alias("m"), "n_rows")
    return spread_join(both, least, "u", 2 * total, least=HOT_EDGES).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
    low = spread_join(down, least, "u", total, least=HOT_EDGES).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.union(least.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_steps: int = 50) -> DataFrame:
    """``edges`` (u long, v long) -> (node, root): each node that has an edge, with the least node it can reach.

    The least node itself is left out. Loops, repeated and reversed edges are allowed; an empty
    table gives an empty one.
    """
    edges = cut_lineage(edges.select("u", "v"))
    now = cut_lineage(_small_star(edges, edges.count()))
    seen = _digest(now)
    for _ in range(max_steps):
        if not seen[0]:
            break
        release(now)
        larger = cut_lineage(_large_star(now, seen[0]))
        now = cut_lineage(_small_star(larger, 2 * seen[0]))
        before, seen = seen, _digest(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
