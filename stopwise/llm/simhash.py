"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: a document's 64-bit SimHash over its 3-word shingles. Two fingerprints link when at
most ``radius`` (3) bits differ; documents in one connected component are one group.

Search. Equal fingerprints are merged first. Cut into ``radius + 1`` blocks, two linking
fingerprints agree in one block at least, so every fingerprint goes once to each block's *upper node*
(all that share those bits). A node of more than ``node_limit`` members is divided again in the
same way over the bits that remain (four times at most, when no more than 2**21 different members
can be left), so that a node always fits in memory and no link is lost. Within a node, members are
sorted by Gray rank, so that neighbours differ in few bits; runs of eight form a lower node that
stores the bits they all share as mask and pattern, eight of these a higher one, and so on to the
node's root. The search descends pairs of nodes at once and drops a pair as soon as the shared bits
that differ exceed the radius, which prunes whole groups, or when both are already connected.
A node emits the links of a spanning forest, never all its pairs.

A fingerprint or component with a large share of the rows is met by a broadcast of its own row
(``common.spread_join``), never put into one task.

Edge cases: null, empty and blank texts have fingerprint 0 and link like any other. Texts of
fewer than three words are one shingle. Null ids keep their row; a group's id ignores nulls. Ids may be numbers or texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import cut_lineage, fresh, if_small, map_arrow, raw_texts, row_key, spread_join
from .components import components

WIDTH, SEED, RADIUS = 3, 42, 3
FAN = 8
#: Bits per block at each division of an upper node: 64 = 4 x 16, 48 = 4 x 12, 36 = 4 x 9, 27 = 7 + 7 + 7 + 6.
BLOCKS = ((16, 16, 16, 16), (12, 12, 12, 12), (9, 9, 9, 9), (7, 7, 7, 6))
_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, lowest bit first."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    total = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    if whole:  # sums of 255 rows fit in a byte, which is much faster to add
        total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    words = text.lower().split()  # of bytes: folds A-Z and splits at ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return _hash(b" ".join(words))
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))
    hashes = np.fromiter(map(_hash, shingles), np.uint64, len(words) - width + 1)
    return int(np.packbits(bit_totals(hashes) * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, fp): the fingerprint as a signed long, and what the row is known by."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.fromiter(map(fingerprint, raw_texts(batch.column(2))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "key", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return map_arrow(narrow, f"doc_id {kind}, key struct<a: long, b: long>, fp long", work)


def _gray_rank(code: Column) -> Column:
    """Position of ``code`` in the reflected Gray sequence, with the sign bit turned so that longs sort as unsigned."""
    for k in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, k))
    return code.bitwiseXOR(F.lit(-(2**63)))


def _divide(rows: DataFrame, level: int) -> DataFrame:
    """Each member once under each block of the bits that remain; (path, kept, code, fp), the block's bits first in ``code``."""
    widths = BLOCKS[level]
    rest = sum(widths)
    mask = F.lit((1 << rest) - 1 if rest < 64 else -1)
    low, at, made = F.col("code").bitwiseAND(mask), 0, []
    for k, width in enumerate(widths):
        turned = low if not at else F.shiftleft(low, at).bitwiseOR(F.shiftrightunsigned(low, rest - at)).bitwiseAND(mask)
        high = F.col("code").bitwiseAND(F.bitwise_not(mask))
        made.append(F.struct((F.col("path") * 4 + k).alias("path"), F.lit(64 - rest + width).alias("kept"), high.bitwiseOR(turned).alias("code"), "fp"))
        at += width
    return rows.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def _node() -> Column:
    """The upper node's shared bits."""
    return F.expr("shiftrightunsigned(code, 64 - kept)")


def upper_nodes(distinct: DataFrame, node_limit: int) -> DataFrame:
    """(path, node, code, fp): every fingerprint under upper nodes of at most ``node_limit`` members where bits are left to divide by."""
    rows, parts = distinct.select(F.lit(1).alias("path"), F.lit(0).alias("kept"), F.col("fp").alias("code"), "fp"), []
    for level in range(len(BLOCKS)):
        rows = _divide(rows, level).withColumn("node", _node())
        if level == len(BLOCKS) - 1:
            parts.append(rows)
            break
        large = cut_lineage(rows.groupBy("path", "node").count().where(F.col("count") > node_limit).select("path", "node"))
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, ["path", "node"], "left_anti"))
        rows = cut_lineage(rows.join(large, ["path", "node"], "left_semi").drop("node"))
    out = parts[0].select("path", "node", "code", "fp")
    for more in parts[1:]:
        out = out.union(more.select("path", "node", "code", "fp"))
    return out


class Forest:
    """Least member of each item's set, as arrays, and the links that made the sets."""

    def __init__(self, n: int):
        self.of = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            a, b = self.of[u], self.of[v]
            apart = a != b
            if not apart.any():
                return
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            order = np.lexsort((low, high))
            high, low = high[order], low[order]
            one = np.flatnonzero(np.r_[True, high[1:] != high[:-1]])  # each set is hooked to the least one it links to
            self.of[high[one]] = low[one]
            self.links.append((u[order[one]], v[order[one]]))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def _tree(codes: np.ndarray, groups: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels from the members up; of each node (first child, mask, pattern). The last level has a root for each group."""
    first, mask, pattern, owner, levels = np.arange(len(codes) + 1), np.full(len(codes), ~np.uint64(0)), codes, groups, []
    while True:
        levels.append((first, mask, pattern))
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if len(starts) == len(owner):
            return levels
        size = np.diff(np.r_[starts, len(owner)])
        first = np.flatnonzero((np.arange(len(owner)) - np.repeat(starts, size)) % FAN == 0)
        ones = np.bitwise_and.reduceat(pattern & mask, first)
        # a bit is shared if it is in each child's mask and has one value there
        both = np.bitwise_and.reduceat(mask, first)
        some = np.bitwise_or.reduceat(pattern & mask, first)
        mask = both & (ones | ~some)
        pattern, owner, first = ones & mask, owner[first], np.r_[first, len(owner)]


def _children(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of a child of ``a`` and a child of ``b``, each pair of a node with itself once."""
    na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
    n = na * nb
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    nb, fa, fb = np.repeat(nb, n), np.repeat(first[a], n), np.repeat(first[b], n)
    x, y = fa + at // nb, fb + at % nb
    keep = (x <= y) | (np.repeat(a, n) != np.repeat(b, n))
    return x[keep], y[keep]


def spanning_links(codes: np.ndarray, groups: np.ndarray, radius: int = RADIUS, chunk: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, member) of a spanning forest of the links within each group.

    ``codes`` are sorted by group, then by Gray rank. Memory: the tree and about ``64 * chunk`` pairs.
    """
    levels, forest = _tree(codes, groups), Forest(len(codes))
    tops = np.arange(len(levels[-1][1]))
    todo = [(len(levels) - 1, tops[at : at + chunk], tops[at : at + chunk]) for at in range(0, len(tops), chunk)]
    whole: list[np.ndarray] = []

    def connected() -> list[np.ndarray]:
        """For each level, the set that all members of a node are in, or -1."""
        out = [forest.of]
        for first, _, _ in levels[1:]:
            low, high = (f.reduceat(out[-1], first[:-1]) for f in (np.minimum, np.maximum))
            out.append(np.where(low == high, low, -1))
        return out

    pairs = 0
    while todo:
        level, a, b = todo.pop()
        if whole:
            apart = (whole[level][a] < 0) | (whole[level][a] != whole[level][b])
            a, b = a[apart], b[apart]
        if level:
            a, b = _children(levels[level][0], a, b)
            level -= 1
        _, mask, pattern = levels[level]
        near = np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= radius
        a, b = a[near], b[near]
        if level:
            todo += [(level, a[at : at + chunk], b[at : at + chunk]) for at in range(0, len(a), chunk)]
        else:
            forest.link(a[a != b], b[a != b])
            pairs += len(a)
            if pairs > 4 * len(codes):  # many links: from now on leave out what is connected already
                whole, pairs = connected(), 0
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(u for u, _ in forest.links)]), np.concatenate([none, *(v for _, v in forest.links)])


def link_edges(distinct: DataFrame, node_limit: int = 50_000, radius: int = RADIUS) -> DataFrame:
    """(u, v) over distinct fingerprints: links within ``radius`` bits that connect exactly what all such links connect."""
    if radius >= len(BLOCKS[0]):
        raise ValueError("radius must be below the number of blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: list[np.ndarray]) -> pa.RecordBatch:
            path, node, code, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            groups = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (node[1:] != node[:-1])])
            u, v = spanning_links(code.view(np.uint64), groups, radius)
            return pa.RecordBatch.from_arrays([pa.array(fp[u]), pa.array(fp[v])], ["u", "v"])

        held: list[list[np.ndarray]] = []
        rows, enough = 0, 20_000
        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            rows += batch.num_rows
            if rows >= enough:
                held = [[np.concatenate(x) for x in zip(*held, strict=True)]]
                path, node = held[0][:2]
                start = rows - int(np.argmin(np.r_[((path == path[-1]) & (node == node[-1]))[::-1], False]))
                if start:  # the last node may go on in the next batch
                    yield found([[x[:start] for x in held[0]]])
                    held, rows = [[x[start:] for x in held[0]]], rows - start
                enough = max(20_000, 2 * rows)
        if rows:
            yield found(held)

    nodes = upper_nodes(distinct, node_limit).select("path", "node", "code", "fp", _gray_rank(F.col("code")).alias("rank"))
    dealt = nodes.repartition("path", "node").sortWithinPartitions("path", "node", "rank").select("path", "node", "code", "fp")
    ship(distinct.sparkSession)
    return dealt.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_limit: int = 50_000) -> DataFrame:
    """(doc_id, fp long, component_id): one row for each row of ``docs``; the component is the least id reachable."""
    return _grouped(docs, id_col, text_col, node_limit).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, node_limit: int) -> DataFrame:
    """(doc_id, key, fp, root, component_id): ``root`` is a fingerprint that stands for the component."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_rows")))
    star = components(link_edges(distinct.select("fp"), node_limit))
    member = star.union(star.select(F.col("root").alias("node"), "root").distinct())
    known = cut_lineage(distinct.join(member.select(F.col("node").alias("fp"), "root"), "fp"))
    least = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n_rows"))
    moved = spread_join(known.select("fp", "root"), least, "root", known.count())
    of = distinct.join(moved, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "least").alias("component_id"), "n_rows")
    return spread_join(prints, cut_lineage(of), "fp", prints.count()).select("doc_id", "key", "fp", "root", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_limit: int = 50_000) -> DataFrame:
    """``docs`` with one row of each group: that of the least id, nulls last; of rows equal in id and text the least of all columns."""
    return keep_least(docs, cut_lineage(_grouped(docs, id_col, text_col, node_limit)), id_col, text_col)


def keep_least(docs: DataFrame, of: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with one row of each ``root`` of ``of`` (doc_id, key, root), which has to be cut from its lineage."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "key")).alias("x")
    kept = of.groupBy("root").agg(first).select("x.key")
    gone = cut_lineage(of.select("key").distinct().join(kept, "key", "left_anti"))
    repeated = cut_lineage(of.groupBy("key").count().where("count > 1").select("key"))
    (own,) = fresh(docs, "key")
    gone, again = if_small(gone.withColumnRenamed("key", own)), if_small(repeated.withColumnRenamed("key", own))
    keyed = docs.withColumn(own, row_key(id_col, text_col))
    left = keyed.join(gone, own, "left_anti")
    if repeated.isEmpty():
        return left.drop(own)
    once = left.join(again, own, "left_semi").groupBy(own).agg(F.min(F.struct(*docs.columns)).alias("x")).select("x.*")
    return left.join(again, own, "left_anti").drop(own).unionByName(once)
