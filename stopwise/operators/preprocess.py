"""Preprocessing that only prunes: cells of the network, arc flags, and their store under a content fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import router

LEVELS = 8


def cells(stops: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(stop_id, cell): balanced bisection by coordinates, alternating directions; ``2 ** levels`` cells."""
    rows = stops.select("stop_id", "lat", "lon", F.lit(0).alias("cell"))
    for k in range(levels):
        order = ["lat", "lon"] if k % 2 == 0 else ["lon", "lat"]
        half = F.ntile(2).over(W.partitionBy("cell").orderBy(*order, "stop_id")) - 1
        rows = rows.withColumn("half", half).withColumn("cell", F.col("cell") * 2 + F.col("half")).drop("half")
    return rows.select("stop_id", "cell")


def arc_flags(sources: DataFrame, events: DataFrame, walks: DataFrame | None, where: DataFrame, rounds: int = 3) -> DataFrame:
    """(trip_id, board_off, cell): rides that lie on an earliest arrival at some stop of the cell, for (query_id, stop_id, arr) sources.

    A ride without any row may be left out of searches towards the cell. Sources are rows of one batch search; flags are traced
    back along its labels by one join a leg.
    """
    labels = router.rounds(sources, events, walks, rounds)
    best = router.earliest(labels)
    goals = labels.join(best, ["query_id", "stop_id", "arr"], "left_semi").where(F.col("kind") != router.START).select("query_id", "stop_id", "round").distinct()
    journeys = router.reconstruct(labels, goals.select("query_id", "stop_id").distinct(), rounds)
    used = journeys.select("target", F.explode("legs").alias("leg")).where("leg.kind = 'ride'").select("target", "leg.trip_id", "leg.board_off")
    return used.join(where.select(F.col("stop_id").alias("target"), "cell"), "target").select("trip_id", "board_off", "cell").distinct()


def flag_words(flags: DataFrame) -> DataFrame:
    """(trip_id, board_off, w0 ... w3): the set of cells as four words of 64 bits."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("cell") % 64)
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("cell") / 64) == k, bit)), F.lit(0).cast("long")).alias(f"w{k}") for k in range(4)]
    return flags.groupBy("trip_id", "board_off").agg(*words)


def fingerprint(tables: list[DataFrame]) -> str:
    """Digest of tables' rows whatever their order: what a stored result depends on."""
    total = None
    for table in tables:
        row = table.select(F.xxhash64(*table.columns).alias("h")).agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(30,0)")).cast("string").alias("s"))
        part = row.select(F.concat_ws("|", "n", F.coalesce("s", F.lit("")), F.lit(",".join(table.columns))).alias("d"))
        total = part if total is None else total.union(part)
    return total.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256)).first()[0][:32]


def stored(name: str, folder: str, mark: str, make) -> DataFrame:
    """The table kept under the fingerprint ``mark``, made and written first if there is none. Broken keys are for ``broken`` to find."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    spark, path = SparkSession.active(), f"{folder}/{name}/fingerprint={mark}"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def broken(flags: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of a stored table that refer to no ride of the timetable."""
    return flags.join(events.select("trip_id", F.col("off").alias("board_off")), ["trip_id", "board_off"], "left_anti")


def cache_key(*parts: Column) -> Column:
    """Key of a stored answer: 32 hex digits of its parts."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)
