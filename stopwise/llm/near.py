"""Near copies by SimHash, completed to every pair of a Jaccard similarity of 4/5 or more.

A document's set holds its distinct 5-word shingles (as ``simhash`` splits words), as 64-bit hashes. Two documents link
when the Jaccard similarity of their sets is at least 4/5; one connected component is one group. Equal sets are one node.

Search. The SimHash of a set and the Gray-order index (``simhash.link_edges``) find sets that differ little; each link is confirmed on
the whole sets. At a similarity of 4/5 two fingerprints of 64 bits differ in 10 bits as a rule, far beyond what an index of that kind
can search, so the rest is found by prefixes: under any total order of the shingles, two sets of that similarity share one
of their first ``n - ceil(4n/5) + 1``, so every node is filed under those alone and no link is lost. The order puts shingles
that are frequent in a sample of documents last, which keeps the lists short; the sample changes the time only, never the result.

Lists of up to ``SHORT`` nodes give their pairs that are apart so far and whose sizes and parities allow the similarity. Longer ones
never give all pairs: their nodes are compared by sketches (parities of at least twice as many parts as shingles, which differ in no more
places than the sets), from the most central on, and only the pairs of a spanning forest go on to be confirmed on the whole sets. A list of which a
pair fails is gone through again without the failed pairs, until none fails. Lists of more than ``BLOCK`` nodes are dealt out by pairs of blocks.

Edge cases: null, empty and blank texts are one group. Texts of up to five words are one shingle. Null ids keep their row. Ids may be numbers or texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import release
from ..shipping import ship
from .common import SMALL_ROWS, SMALL_SLICE, cut_counted, cut_lineage, map_arrow, raw_texts, row_key, small, table_join
from .components import HOT_EDGES, components
from .simhash import bit_totals, keep_least, link_edges

WIDTH = 5
SHORT, BLOCK = 4, 2048
#: Times that a list is gone through by forests; after that all its pairs are given.
ROUNDS = 2
#: Least number of longs of a sketch; the exclusive or of its longs, the parities of 64 parts, is kept in the lists.
SKETCH = 16
#: Documents of the sample, the share of them (as a count) from which a shingle is frequent, and how many frequent ones are known.
SAMPLE, FREQUENT, KNOWN = 12_000, 3, 200_000
#: Only shingles below this are counted, as heads hold few others.
LOW = np.uint64(int(0.4 * 2**64))
_PRIME, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)
_NONE = np.zeros(0, np.int64)


def shingles(text: bytes) -> np.ndarray:
    """Distinct shingles of a text, sorted."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    width = min(WIDTH, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _PRIME + w[k : k + len(h)]
    h = (h ^ (h >> np.uint64(33))) * _MIX
    return np.unique(h ^ (h >> np.uint64(33)))


def fingerprint(found: np.ndarray) -> int:
    """SimHash of a set."""
    return int(np.packbits(bit_totals(found) * 2 > len(found), bitorder="little").view(np.int64)[0]) if len(found) else 0


def parities(found: np.ndarray) -> np.ndarray:
    """Of each of some parts of the shingles, whether the set holds an odd number; sets differ in at least as many shingles as parities.

    The parts are about twice the shingles, 64 * ``SKETCH`` at least and a power of two; two halves xored are the parities of half as many.
    """
    parts = max(64 * SKETCH, 1 << (2 * len(found) - 1).bit_length()) if len(found) else 64 * SKETCH
    return np.packbits(np.bincount((found & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1, bitorder="little").view(np.int64)


def head(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles under which a set is filed: rare ones before frequent ones, else by value."""
    n = len(found)
    if not n:
        return found
    late = frequent[np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)] == found if len(frequent) else np.zeros(n, bool)
    return np.concatenate([found[~late], found[late]])[: n - (4 * n + 4) // 5 + 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([*(x.view(np.int64) for x in arrays), _NONE])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """Each list as an array; null as empty."""
    values, at = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
    return [values[a:b] for a, b in zip(at, at[1:], strict=False)]


def _frequent(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Shingles of at least ``FREQUENT`` documents of the sample, ``KNOWN`` at most."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [x[x < LOW] for x in map(shingles, raw_texts(batch.column(0)))]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], ["h"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.where(F.pmod(row_key(id_col, text_col)["a"], F.lit(every)) == 0).select(F.col(text_col).alias("text"))
    rows = map_arrow(sample, "h long", work, SMALL_SLICE).groupBy("h").count().where(F.col("count") >= FREQUENT)
    most = rows.orderBy(F.desc("count"), "h").limit(KNOWN).select("h").toArrow().column(0)
    return np.sort(most.to_numpy().view(np.uint64))


def sets_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, key, node, check, n, fp, parity, sketch, head, row), where ``node`` and ``check`` are hashes of the set and ``row`` is unique;
    (node, n_rows, key, row) with the least key and row of each node, and the number of nodes.
    """
    frequent = _frequent(docs, id_col, text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in raw_texts(batch.column(2))]
        whole = [xxhash.xxh3_128_intdigest(x.tobytes()) for x in sets]
        node, check = (np.array([x >> s & 2**64 - 1 for x in whole], np.uint64).view(np.int64) for s in (0, 64))
        odd = [parities(x) for x in sets]
        folded = np.array([np.bitwise_xor.reduce(x) for x in odd], np.int64)  # parities of 64 coarser parts
        made = [pa.array(node), pa.array(check), pa.array([len(x) for x in sets], pa.int32()), pa.array([fingerprint(x) for x in sets], pa.int64()), pa.array(folded), _lists(odd), _lists([head(x, frequent) for x in sets])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "key", "node", "check", "n", "fp", "parity", "sketch", "head"])

    def counted(prints: DataFrame) -> tuple[DataFrame, int]:
        return cut_counted(prints.groupBy("node").agg(F.count("*").alias("n_rows"), F.min("key").alias("key"), F.min("row").alias("row"), F.min("check").alias("low"), F.max("check").alias("high")))

    narrow = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    made = map_arrow(narrow, f"doc_id {kind}, key struct<a: long, b: long>, node long, check long, n int, fp long, parity long, sketch array<long>, head array<long>", work, SMALL_SLICE)
    prints = cut_lineage(made.withColumn("row", F.monotonically_increasing_id()))
    counts, total = counted(prints)
    # of different sets that meet in 64 bits by chance the node takes up the other 64 bits too
    clash, clashes = cut_counted(counts.where("low <> high").select("node"))
    if clashes:
        other = prints.join(small(clash, clashes), "node", "left_semi").withColumn("node", F.xxhash64("node", "check")).select(prints.columns)
        prints = cut_lineage(prints.join(small(clash, clashes), "node", "left_anti").select(prints.columns).union(other))
        counts, total = counted(prints)
    return prints, counts.drop("low", "high"), total


def _possible(n: np.ndarray, parity: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    na, nb = n[a].astype(np.int64), n[b].astype(np.int64)
    return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * np.bitwise_count((parity[a] ^ parity[b]).view(np.uint64)).astype(np.int64) <= na + nb)


def _groups(batches: Iterator[pa.RecordBatch], width: int, enough: int) -> Iterator[list[pa.Array]]:
    """Columns of whole runs of equal values in the first ``width`` columns, which are sorted and never null."""
    held: list[pa.RecordBatch] = []
    rows, least = 0, enough
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids = [whole.column(k).to_numpy() for k in range(width)]
            new = np.zeros(rows - 1, bool)
            for x in ids:
                new |= x[1:] != x[:-1]
            start = int(np.flatnonzero(np.r_[True, new])[-1])
            if start:  # the last run may go on in the next batch
                yield [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.slice(0, start).columns]
                held, rows = whole.slice(start).to_batches(), rows - start
            least = max(enough, 2 * rows)
    if rows:
        yield [c.combine_chunks() for c in pa.Table.from_batches(held).combine_chunks().columns]


def short_pairs(filed: DataFrame, most: int) -> DataFrame:
    """(a, b, token, size) of (token, node, root, n, parity): pairs of nodes to confirm, from lists of up to ``most``; of a longer list its token and size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 1, 50_000):
            token, node, root, n, parity = (x.to_numpy(zero_copy_only=False) for x in columns)
            starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            size = np.diff(np.r_[starts, len(token)])
            end, short = np.repeat(starts + size, size), np.repeat(size <= most, size)
            a, b = [_NONE], [_NONE]
            for k in range(1, most):
                x = np.flatnonzero(short & (np.arange(len(token)) + k < end))
                x = x[(root[x] != root[x + k]) & _possible(n, parity, x, x + k)]
                a.append(np.minimum(node[x], node[x + k]))
                b.append(np.maximum(node[x], node[x + k]))
            apart = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            long = apart & (size > most)
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            nodes = [pa.concat_arrays([pa.array(np.ascontiguousarray(x)), pa.nulls(int(long.sum()), pa.int64())]) for x in pairs.T]
            rest = [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(x)]) for x in (token[starts[long]], size[long].astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*nodes, *rest], ["a", "b", "token", "size"])

    ship(filed.sparkSession)
    dealt = filed.repartition("token").sortWithinPartitions("token", "n", "node").select("token", "node", "root", "n", "parity")
    return dealt.mapInArrow(run, "a long, b long, token long, size long")


def forest(node: np.ndarray, root: np.ndarray, n: np.ndarray, parity: np.ndarray, sketch: list[np.ndarray], failed: list[np.ndarray], side: np.ndarray | None, whole: bool) -> list[tuple[int, int]]:
    """Pairs of places whose sketches allow the similarity, as many as connect what they connect; with ``whole`` all of them that are apart.

    ``failed`` names nodes that are known not to link. With ``side``, only pairs of different sides count.
    """
    odd = np.unpackbits(parity.view(np.uint8).reshape(-1, 8), axis=1)
    middle = np.packbits(2 * odd.sum(axis=0) > len(odd)).view(np.int64)[0]
    order = np.lexsort((node, np.bitwise_count((parity ^ middle).view(np.uint64))))
    length = np.array([len(x) for x in sketch])
    place = np.zeros(len(node), np.int64)
    rows = {}
    for size in np.unique(length).tolist():
        some = np.flatnonzero(length == size)
        rows[size] = np.stack([sketch[k] for k in some.tolist()]).view(np.uint64)
        place[some] = np.arange(len(some))
    part = np.unique(root, return_inverse=True)[1]
    left = np.ones(len(node), bool)
    out = []
    for i in order.tolist():
        left[i] = False
        able = left & (part != part[i]) & (5 * np.minimum(n, n[i]) >= 4 * np.maximum(n, n[i]))
        if side is not None:
            able &= side != side[i]
        able = np.flatnonzero(able)
        if not len(able):
            if not (part != part[i]).any():
                break
            continue
        mine, near = sketch[i].view(np.uint64), [_NONE]
        for size in {len(mine) // 2, len(mine), 2 * len(mine)} & rows.keys():
            some = able[length[able] == size]
            theirs, own = rows[size][place[some]], mine
            if size > len(mine):
                theirs = theirs[:, : len(mine)] ^ theirs[:, len(mine) :]
            elif size < len(mine):
                own = mine[:size] ^ mine[size:]
            near.append(some[9 * np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64) <= n[some].astype(np.int64) + n[i]])
        near = np.concatenate(near)
        if len(failed[i]):
            near = near[~np.isin(node[near], failed[i])]
        if whole:
            out += [(i, k) for k in near.tolist()]
        elif len(near):
            parts, first = np.unique(part[near], return_index=True)
            out += [(i, k) for k in near[first].tolist()]
            part[np.isin(part, parts)] = part[i]
    return out


def long_pairs(rows: DataFrame, whole: bool) -> DataFrame:
    """(a, b, token) of (token, low, high, side, node, root, n, parity, sketch, failed): pairs of nodes to confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _groups(batches, 3, 4_000):
            token, low, high, side, node, root, n, parity = (x.to_numpy(zero_copy_only=False) for x in columns[:8])
            sketch, failed = _arrays(columns[8]), _arrays(columns[9])
            cuts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]), True])
            a, b, t = [], [], []
            for x, y in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
                sides = side[x:y] if low[x] != high[x] else None
                for i, k in forest(node[x:y], root[x:y], n[x:y], parity[x:y], sketch[x:y], failed[x:y], sides, whole):
                    a.append(min(node[x + i], node[x + k]))
                    b.append(max(node[x + i], node[x + k]))
                    t.append(token[x])
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.int64)) for v in (a, b, t)], ["a", "b", "token"])

    ship(rows.sparkSession)
    dealt = rows.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high", "node").select("token", "low", "high", "side", "node", "root", "n", "parity", "sketch", "failed")
    return dealt.mapInArrow(run, "a long, b long, token long")


def screened(pairs: DataFrame, total: int, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes, ``total`` of them and cut from their lineage, whose sketches allow the similarity."""
    if total <= SMALL_ROWS // 2:  # only the sketches asked for are moved
        nodes = nodes.join(F.broadcast(pairs.select(F.col("a").alias("node")).union(pairs.select("b"))), "node", "left_semi")
    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"sketch{side}")), side)
    # sizes of a pair differ by a quarter at most, so that the longer sketch is folded once if at all
    k, m = "cast(k as int)", "least(size(sketcha), size(sketchb))"
    fold = " ^ ".join(f"get(sketch{x}, {k}) ^ coalesce(get(sketch{x}, {k} + {m}), 0L)" for x in "ab")
    apart = f"aggregate(sequence(0, {m} - 1), 0, (n, k) -> n + bit_count({fold}))"
    sizes = "5 * least(na, nb) >= 4 * greatest(na, nb)"
    return pairs.where(sizes).where(f"9 * ({apart}) <= na + nb").select("a", "b")


def confirmed(pairs: DataFrame, docs: DataFrame, counts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(u, v): the pairs (a, b) of nodes whose whole sets are similar enough; ``pairs`` has to be cut from its lineage."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(x) for x in raw_texts(batch.column(1))])], ["node", "s"])

    asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    key = small(*cut_counted(counts.select("node", "key").join(asked, "node", "left_semi")))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")).join(key, "key").select("node", "text")
    sets = map_arrow(rows, "node long, s array<long>", work, SMALL_SLICE).dropDuplicates(["node"])  # one exchange serves both joins
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.size("sa") + F.size("sb"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _near_roots(edges: DataFrame, steps: int = 2) -> tuple[DataFrame, int]:
    """(node, root): the least node within some steps, and how many nodes; those of one root are connected, and those around one node or two have one root."""
    both, total = cut_counted(edges.select(F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("other"))))
    roots, n = cut_counted(both.groupBy("node").agg(F.min("other").alias("root"), F.count("*").alias("n_rows")).select("node", F.least("node", "root").alias("root"), "n_rows"))
    for _ in range(steps - 1):
        seen = table_join(both, roots.select(F.col("node").alias("other"), "root", "n_rows"), n, "other", total, least=HOT_EDGES).select("node", "root", F.lit(0).cast("long").alias("n_rows"))
        roots, n = cut_counted(seen.union(roots).groupBy("node").agg(F.min("root").alias("root"), F.max("n_rows").alias("n_rows")))
    release(edges)
    return roots.select("node", "root"), n


def _roots(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, root) of every node that has an edge, and how many: near roots first, then components of what is left between them."""
    near, n = _near_roots(edges, 3)
    left = edges.join(small(near.select(F.col("node").alias("u"), F.col("root").alias("a")), n), "u").join(small(near.select(F.col("node").alias("v"), F.col("root").alias("b")), n), "v")
    left, apart = cut_counted(left.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    if not apart:
        return near, n
    star, met = cut_counted(components(left).select(F.col("node").alias("root"), F.col("root").alias("top")))
    return cut_counted(near.join(small(star, met), "root", "left").select("node", F.coalesce("top", "root").alias("root")))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(doc_id, key, root): one row for each row of ``docs``; ``root`` is a node that stands for the group."""
    prints, counts, total = sets_of(docs, id_col, text_col)
    many, repeated = cut_counted(counts.where("n_rows > 1").select("node", F.col("row").alias("first")))
    # one row of each node; heads are moved only where many nodes have several rows
    if repeated <= SMALL_ROWS:
        nodes = prints.join(F.broadcast(many), "node", "left").where("first is null or row = first")
    else:
        nodes = prints.join(counts.select("row"), "row", "left_semi")
    nodes = nodes.select("node", "n", "fp", "parity", "sketch", "head")
    release(docs)

    def proven(pairs: DataFrame) -> tuple[DataFrame, int]:
        found = cut_counted(confirmed(pairs, docs, counts, id_col, text_col))
        release(docs)
        return found

    def candidates(pairs: DataFrame) -> DataFrame:
        pairs = cut_counted(pairs.distinct())
        release(docs)
        return cut_counted(screened(*pairs, nodes))[0]

    # what SimHash finds
    prints_of, prints_n = cut_counted(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("n_rows")))
    equal, equals = cut_counted(prints_of.where("n_rows > 1"))
    equal = table_join(nodes.select("node", "fp"), equal, equals, "fp", total).where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    links, linked = cut_counted(link_edges(prints_of.select("fp")))
    release(docs)
    for end, side in (("u", "a"), ("v", "b")):
        links = small(links, linked).join(prints_of.select(F.col("fp").alias(end), F.col("least").alias(side)), end)
    edges = proven(candidates(equal.union(links.select("a", "b"))))[0]
    roots = _near_roots(edges)
    # short lists
    at = F.coalesce("root", "node").alias("root")
    filed = nodes.join(small(*roots), "node", "left").select(F.explode("head").alias("token"), "node", at, "n", "parity")
    first = cut_counted(short_pairs(filed, short))[0]
    release(docs)
    edges = edges.union(proven(candidates(first.where("token is null").select("a", "b")))[0])
    # long lists
    long, lists = cut_counted(first.where("token is not null").select("token", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    failed, fails = long.limit(0).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), 0
    for turn in range(ROUNDS + 1):
        if not lists:
            break
        roots = _near_roots(edges, 2 + turn)
        if lists <= SMALL_ROWS:
            rows = nodes.select(F.explode("head").alias("token"), "node", "n", "parity", "sketch").join(F.broadcast(long), "token")
        else:
            rows = nodes.select(F.explode("head").alias("token"), "node").join(long, "token").join(nodes.select("node", "n", "parity", "sketch"), "node")
        rows = rows.join(small(*roots), "node", "left")
        if fails:
            bad = failed.union(failed.select(F.col("b"), F.col("a"))).groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("failed"))
            rows = rows.join(bad, "node", "left")
        else:
            rows = rows.withColumn("failed", F.lit(None))
        rows = rows.withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        # first within blocks, then between any two
        others = F.array("side") if not turn else F.sequence(F.lit(0), F.col("blocks") - 1)
        rows = rows.select("token", "node", at, "n", "parity", "sketch", "side", F.coalesce("failed", F.array().cast("array<long>")).alias("failed"), F.explode(others).alias("other"))
        rows = rows.withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other"))
        found = cut_counted(long_pairs(rows, turn == ROUNDS))[0]
        pairs = cut_counted(found.select("a", "b").distinct())[0]
        release(docs)
        good, goods = proven(pairs)
        edges = edges.union(good)
        wrong, wrongs = cut_counted(pairs.join(small(good.select(F.col("u").alias("a"), F.col("v").alias("b")), goods), ["a", "b"], "left_anti"))
        again = found.join(small(wrong, wrongs), ["a", "b"], "left_semi").select("token")
        if not turn:
            again = again.union(long.where("blocks > 1").select("token"))
        again = small(*cut_counted(again.distinct()))
        failed, fails = cut_counted(failed.union(wrong))
        long, lists = cut_counted(long.join(again, "token", "left_semi"))
    of, n = cut_counted(counts.join(small(*_roots(edges)), "node", "left").select("node", at, "n_rows"))
    release(docs)
    return table_join(prints.select("doc_id", "key", "node"), of, n, "node", prints.count() if n > SMALL_ROWS else 0).select("doc_id", "key", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group: that of the least id, nulls last; of rows equal in id and text the least of all columns."""
    of = cut_counted(grouped(docs, id_col, text_col, short, block))[0]
    release(docs)
    return keep_least(docs, of, id_col, text_col)
