"""Mixing sources to target weights along a time-varying curriculum.

Targets. Sources in order of code point (null last) weigh 5, 2, 1, repeating, and share all words; a target stops at three
times its source's words and the excess goes to the others by weight, until none is above.

Curriculum. Training time runs from 0 to 1. A source's rate at time t is ``target * (1 + slope * (2 t - 1))``: its share
rises or falls along the way, and the integral of the rate over [0, t], its cumulative demand, ends at the target.
A source's documents, in the order of a seeded hash, are a stream of words that is passed up to three times; the
stretch of each document on that stream is taken as far as the demand goes. Inverting the cumulative demand
at the middle of a taken stretch gives its position, by which the mix is range-sorted.

The stream's offsets are prefix sums in two levels (hash cells, then rows in a cell), so that no
source, however large, is summed in one task; so are the sums over the sources, however many. Everything depends on the rows alone: reruns agree.
``plan`` takes the last document of a pass in part, so that targets are met to the word; ``mixed`` moves whole documents and takes
one where its middle lies before the target.

Edge cases: a null text has no word; documents without a word take nothing; a null id is ordered by its text; rows equal in id, source and size are told apart
only by number, and of rows equal in id, source and text ``mixed`` gives the least of all columns for each; a table without words has targets of 0; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, fresh, n_words, row_key

WEIGHTS, MOST, SLOPES, SEED = (5, 2, 1), 3, (-0.5, 0.0, 0.5), "mix-1"
#: Rows of a cell of the stream, about.
CELL_ROWS = 1_000_000


def source_key(source: str = "source") -> Column:
    """Sorts by code point with null last, and is never null."""
    return F.coalesce(F.concat(F.lit("a"), F.col(source).cast("string")), F.lit("b"))


def sums_before(df: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """``df`` with the sum of each value over the rows before, in two levels: ranges of the order, then rows in a range.

    ``order`` has to tell all rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.select("*", *(v.alias(f"{k}_here") for k, v in values.items())).repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    parts = rows.groupBy("part").agg(*(F.sum(f"{k}_here").alias(f"{k}_part") for k in values))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    parts = parts.select("part", *(F.coalesce(F.sum(f"{k}_part").over(earlier), F.lit(0)).alias(f"{k}_part") for k in values))
    within = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(F.broadcast(parts), "part")
    return rows.select(*df.columns, *((F.col(f"{k}_part") + F.coalesce(F.sum(f"{k}_here").over(within), F.lit(0))).alias(k) for k in values))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target, slope) for each source of (key, size)."""
    per = cut_lineage(sizes.groupBy("key").agg(F.sum("size").alias("source_size")))
    per = sums_before(per, ["key"], rank=F.lit(1).cast("long")).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long"))
    # filled up in the order in which the limits are reached
    per = cut_lineage(per.withColumn("reached", F.col("source_size") * 1.0 / F.col("weight")))
    total, every = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    per = sums_before(per, ["reached", "key"], stopped=MOST * F.col("source_size"), passed=F.col("weight"))
    full = MOST * F.col("source_size") * (every - F.col("passed")) < F.col("weight") * (total - F.col("stopped"))
    per = cut_lineage(per.withColumn("full", full))
    taken, weights = per.agg(F.coalesce(F.sum(F.when(F.col("full"), MOST * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0))).first()
    share = F.col("weight").cast("double") * (total - taken) / F.lit(weights or None).cast("long")
    target = F.when(F.col("full"), (MOST * F.col("source_size")).cast("double")).otherwise(share)
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), (F.col("rank") % len(SLOPES) + 1).cast("int"))
    return per.select("key", "source_size", target.alias("target"), slope.alias("slope"))


def position(demand: Column, target: Column, slope: Column) -> Column:
    """Time at which the cumulative demand target * (t + slope * (t * t - t)) reaches ``demand``."""
    c = demand / target
    b = 1 - slope
    return F.when(slope == 0, c).otherwise((F.sqrt(b * b + 4 * slope * c) - b) / (2 * slope))


def stream(rows: DataFrame) -> DataFrame:
    """``rows`` (key, size, order string, ...), cut from their lineage, with ``start``: words that stand before the row in its source's stream."""
    digits = max(3, (rows.count() // CELL_ROWS).bit_length() // 4 + 1)
    rows = rows.withColumn("cell", F.substring("order", 1, digits))
    cells = rows.groupBy("key", "cell").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cells = cells.select("key", "cell", before.alias("before"))
    within = W.partitionBy("key", "cell").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("upto", F.sum("size").over(within))
    return rows.join(cells, ["key", "cell"]).withColumn("start", F.col("before") + F.col("upto") - F.col("size")).drop("cell", "before", "upto")


def plan(docs: DataFrame, whole: bool = False, *carry: Column) -> DataFrame:
    """One row for each document: size, source_size, target, ``taken`` words and ``passes`` (array of pass, taken, position).

    ``whole``: take a document in a pass wholly or not at all, by where its middle lies.
    """
    size = n_words(F.col("text"))
    order = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit(""))))))
    rows = cut_lineage(docs.select("doc_id", source_key().alias("key"), size.alias("size"), order.alias("order"), *carry))
    placed = stream(rows).join(targets(rows), "key")
    aim = F.floor("target").cast("long")
    parts = []
    for k in range(MOST):
        start = F.col("start") + k * F.col("source_size")
        if whole:
            take = F.when((F.col("size") > 0) & (2 * start + F.col("size") <= 2 * aim), F.col("size")).otherwise(F.lit(0).cast("long"))
        else:
            take = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), aim - start))
        at = position((start + take / 2).cast("double"), F.col("target"), F.col("slope"))
        parts.append(F.struct(F.lit(k).alias("pass"), take.alias("taken"), at.alias("position")))
    every = F.filter(F.array(*parts), lambda p: p["taken"] > 0)
    placed = placed.withColumn("passes", every)
    taken = F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p["taken"])
    return placed.withColumn("taken", taken).drop("key", "start", "slope")


def mixed(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them (whole documents), range-sorted by training position."""
    columns = columns or tuple(docs.columns)
    same, position = fresh(docs, "same", "position")
    way = plan(docs, True, row_key("doc_id", "source", "text").alias("same")).select(F.col("same").alias(same), F.col("passes.position").alias(position))
    repeated = cut_lineage(way.groupBy(same).count().where("count > 1").select(same))
    way, left = way.where(F.size(position) > 0), docs.withColumn(same, row_key("doc_id", "source", "text"))
    if not repeated.isEmpty():  # of equal rows one is met by the passes of all
        one = left.join(repeated, same, "left_semi").groupBy(same).agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*", same)
        left = left.join(repeated, same, "left_anti").select(*docs.columns, same).unionByName(one)
    out = left.join(way, same).select(*docs.columns, same, F.explode(position).alias(position))
    n = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return out.repartitionByRange(int(n), position, same).sortWithinPartitions(position, same).select(*columns)


def mix_sql() -> str:
    """DuckDB SQL for the rows of ``op7``: the same targets, stream and positions."""
    takes = [f"greatest(0, least(size, aim - (start + {k} * source_size)))" for k in range(MOST)]
    cases = "\n".join(
        f"when {t} > 0 then case when slope = 0 then ((start + {k} * source_size) + {t} / 2.0) / target else (sqrt((1 - slope) * (1 - slope) + 4 * slope * (((start + {k} * source_size) + {t} / 2.0) / target)) - (1 - slope)) / (2 * slope) end"
        for k, t in enumerate(takes)
    )
    weights, slopes = "[" + ", ".join(map(str, WEIGHTS)) + "]", "[" + ", ".join(f"{s}::double" for s in SLOPES) + "]"
    return f"""
with sized as (
  select doc_id, coalesce('a' || source, 'b') as key, md5('{SEED}:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))) as ord,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size from documents),
per as (select key, sum(size)::bigint as source_size, row_number() over (order by key) - 1 as rank from sized group by key),
weighed as (select *, ({weights})[1 + rank % {len(WEIGHTS)}]::bigint as weight, ({slopes})[1 + rank % {len(SLOPES)}] as slope from per),
filled as (
  select *, (sum(source_size) over ())::bigint as total,
         coalesce(sum({MOST} * source_size) over (order by source_size * 1.0::double / weight, key rows between unbounded preceding and 1 preceding), 0)::bigint as stopped,
         (sum(weight) over (order by source_size * 1.0::double / weight, key rows between current row and unbounded following))::bigint as rest from weighed),
marked as (select *, {MOST} * source_size * rest < weight * (total - stopped) as is_full from filled),
summed as (
  select *, total - (sum(case when is_full then {MOST} * source_size else 0 end) over ())::bigint as remaining,
         (sum(case when is_full then 0 else weight end) over ())::bigint as weights from marked),
aimed as (select key, source_size, slope, case when is_full then ({MOST} * source_size)::double else weight::double * remaining / weights end as target from summed),
placed as (
  select s.doc_id, s.size, a.source_size, a.target, a.slope, floor(a.target)::bigint as aim,
         (sum(s.size) over (partition by s.key order by s.ord, s.doc_id, s.size rows between unbounded preceding and current row))::bigint - s.size as start
  from sized s join aimed a using (key))
select doc_id, size, source_size, target, ({" + ".join(takes)})::bigint as taken, round(case {cases} end, 9) as first_position from placed
"""
