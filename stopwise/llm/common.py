"""Helpers shared by the training-data operators.

Null ids and null texts are ordinary values everywhere in this subpackage: a null text counts as
an empty one, a null id is kept in the output as null. Columns an operator does not name are
never read, so extra columns with clashing names cannot disturb it. Ids may be of any type that sorts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import cut as cut_lineage
from ..shipping import ship

#: ASCII white space as the word rule ``[^\x20\x09-\x0D]+`` has it, for Java and DuckDB regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: Texts are handed to Python code in slices of at most about so many bytes.
SLICE_BYTES = 8 << 20
#: The same for code that makes arrays of several times the texts' size beside tables of its own.
SMALL_SLICE = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id counts as in the training part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4, F.lit(0))


def held_out(doc_id: str = "doc_id") -> Column:
    return fold(doc_id) == 2


def row_key(*columns: str) -> Column:
    """What a row is known by: two hashes of 64 bits over the values of ``columns``, null or not, so that 10^11 rows meet by chance about once in 10^16 corpora."""
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(1), *values).alias("b"))


#: A table of so many narrow rows (hashes, ids) at most is broadcast: about 16 MB.
SMALL_ROWS = 500_000


def if_small(df: DataFrame) -> DataFrame:
    """``df``, which has to be cut from its lineage, marked for broadcast only if its counted rows are ``SMALL_ROWS`` at most; else joins shuffle it."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


#: Narrow rows of a cut table that one task may read.
PART_ROWS = 20_000


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``df``, narrow rows, cut from its lineage, and how many they are, counted as they are written.

    A small table is read back by few tasks, so that each step on it makes few tasks and few files, however many partitions it came from.
    """
    seen = Observation()
    out = cut_lineage(df.observe(seen, F.count(F.lit(1)).alias("n")))
    rows = seen.get["n"]
    return out.coalesce(max(1, -(-rows // PART_ROWS))), rows


def small(df: DataFrame, rows: int) -> DataFrame:
    """``if_small`` for a table whose rows are counted."""
    return F.broadcast(df) if rows <= SMALL_ROWS else df


#: A key of no more rows than this is left to one task.
HOT_ROWS = 2_000


def spread_join(rows: DataFrame, table: DataFrame, on: str, total: int, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """``rows`` joined with ``table`` (one row for each ``on``, which counts its rows in ``n_rows``) without putting a hot key into one task.

    Keys of more than ``total / SMALL_ROWS`` rows are fewer than ``SMALL_ROWS`` if ``total`` is the number of ``rows``, so their part of ``table`` is
    broadcast, by a proven bound; the others are shuffled.
    """
    above = max(least, total // SMALL_ROWS)
    if total <= above:
        return rows.join(table.drop("n_rows"), on, how)
    hot, cool = table.where(F.col("n_rows") > above).drop("n_rows"), table.where(F.col("n_rows") <= above).drop("n_rows")
    keys = F.broadcast(hot.select(on))
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(keys, on, "left_anti").join(cool, on, how))


def table_join(rows: DataFrame, table: DataFrame, n: int, on: str, total: int, how: str = "inner", least: int = HOT_ROWS) -> DataFrame:
    """``spread_join`` with a table of ``n`` counted rows, broadcast whole if these are ``SMALL_ROWS`` at most."""
    if n <= SMALL_ROWS:
        return rows.join(F.broadcast(table.drop("n_rows")), on, how)
    return spread_join(rows, table, on, total, how, least)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores as it takes to be no column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def map_arrow(df: DataFrame, schema: T.StructType | str, work: Callable[[pa.RecordBatch], pa.RecordBatch], limit: int = SLICE_BYTES) -> DataFrame:
    """Apply ``work`` to Arrow batches cut to about ``limit`` bytes; rows stay in the partition they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded(batch, limit):
                yield work(part)
            batch = part = None  # else it stays beside the next one
        pa.default_memory_pool().release_unused()  # workers live on, beside those of later steps

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def bounded(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``limit`` bytes; a single longer row is a slice of its own."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * limit / max(batch.nbytes, 1)))
    for at in range(0, rows, step):
        yield batch.slice(at, step)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
