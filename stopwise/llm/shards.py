"""Sharding by a two-pass external shuffle.

Pass one scatters records uniformly into buckets that fit in memory, by a seeded hash of id and
text. Pass two puts each bucket through a Fisher-Yates shuffle of its own seed and writes it: the
buckets in order are one random permutation of all records, which is cut into shards whose row
counts differ by at most one (law ``rows``). What the driver holds is one count for each bucket, as Arrow,
``MAX_BUCKETS`` rows of 12 bytes at most; at 100 TB a bucket is then 100 MB.

Rows that are equal in id and text fall into one bucket. A bucket that outgrows its size because
of them is shuffled in runs of bucket size, in the order of the hash, so that memory stays bounded;
only equal rows meet at the cut. Rows equal in id and text stand in the order of their other columns. A rerun over the same rows gives the same shards.

Edge cases: an empty table gives no rows; null ids and texts are scattered like others; more shards than rows
leave shards empty; a column of ``df`` called ``shard`` or ``slot`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from .common import fresh

MAX_BUCKETS = 1 << 20
ROW_BYTES = 16


def record_bytes(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")


def shuffled(df: DataFrame, shards: int, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = 16 << 20) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard)."""
    df = df.drop("shard", "slot")
    size = df.agg(F.sum(record_bytes(text_col)).alias("bytes"), F.count("*").alias("rows")).first()
    total, n_buckets = size["rows"], int(min(MAX_BUCKETS, max(1, -(-(size["bytes"] or 0) // bucket_bytes))))
    mixed = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    bucket = F.pmod(F.shiftrightunsigned(mixed, 20), F.lit(n_buckets)).cast("int")
    starts = np.zeros(n_buckets + 1, np.int64)
    counts = df.groupBy(bucket.alias("bucket")).count().toArrow()  # n_buckets rows at most
    starts[counts.column(0).to_numpy() + 1] = counts.column(1).to_numpy()
    starts = np.cumsum(starts)
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed(held: list[pa.RecordBatch], k: int, done: int) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            order = np.random.default_rng([seed, k, done]).permutation(rows.num_rows)  # a Fisher-Yates shuffle
            at = starts[k] + done + np.arange(rows.num_rows)
            shard = at * shards // total
            slot = at - -(-shard * total // shards)
            out = rows.take(pa.array(order)).select(range(len(names)))
            out = pa.Table.from_arrays([*out.columns, pa.array(shard.astype(np.int32)), pa.array(slot)], names=[*names, "shard", "slot"])
            yield from out.combine_chunks().to_batches(max_chunksize=2_000)

        held, size, now, done = [], 0, None, 0
        for batch in batches:
            keys = batch.column(len(names)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if now is not None and (keys[a] != now or size > 4 * bucket_bytes):
                    yield from placed(held, now, done)
                    done = done + sum(x.num_rows for x in held) if keys[a] == now else 0
                    held, size = [], 0
                now = int(keys[a])
                part = batch.slice(a, b - a)
                held.append(part)
                size += int(part.nbytes)
        if held:
            yield from placed(held, now, done)

    place, order = fresh(df, "bucket", "mixed")
    keyed = df.select(*names, bucket.alias(place), mixed.alias(order))
    others = [f.name for f in df.schema.fields if f.name not in (id_col, text_col) and not isinstance(f.dataType, T.MapType)]
    dealt = keyed.repartitionById(min(n_buckets, 1 << 16), place).sortWithinPartitions(place, order, id_col, text_col, *others)
    ship(df.sparkSession)
    return dealt.drop(order).mapInArrow(run, schema)


def write(df: DataFrame, path: str) -> None:
    """Write a ``shuffled`` table as one folder for each shard, rows in the order of their slots."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
