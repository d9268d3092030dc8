"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are all words of a text. Added are the beginnings of words (``STEMS`` letters) that stand out in toxic examples, because compounding
languages hide a marker in the front of words. A term's weight is ``(1 + log tf) * idf``, times ``1 + BOOST * relevance`` where its
*relevance* is how far the lower bound (of ``Z`` standard errors, after Wilson) of its toxic share lies above the share of all examples: 0 for
words that tell nothing and for words seen too seldom to tell. Document frequencies are counted over all documents.

Search. Labelled examples become unit vectors, sorted so that like stands by like, in blocks of ``BLOCK``. For each term the index
holds its weights by example and the largest of each block; a query's products with these maxima bound its cosine with any example of a block.
Blocks of the highest bounds are read first; blocks whose bound is below the ``K``-th cosine found are never read. Where the bounds do not part the
blocks, or no term of the query weighs enough (``PEAK``) that they could, all examples are read by term: terms of many examples as one product of
matrices for ``GROUP`` queries, the others by their lists. The result is exact either way.
The nearest ``K`` examples (and all that tie with the last) vote, each with weight 1 / (distance + ``SOFT``), against ``PRIOR`` votes of the base rate;
the share is the score, and the nearest examples' ids are its evidence.

Bounds of the fit: ``max_examples`` labelled rows of the training part, drawn by a seeded hash, give the relevance; of those the least
``max_index`` by that hash are the examples of the index. Everything else covers all rows.

Edge cases: a text without a word (also null or empty) gets the prior's share with the labelled examples without a word as its neighbours; a text none of whose
words an example has gets the base rate; without labels every score is 0; with labels of one kind only no term is relevant. Repeated labels of an id count by
their majority (a tie is toxic); repeated ids with different texts are different examples. A null label or a null id teaches nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import bounded, cut_lineage, held_out, if_small, map_arrow, row_key, texts

THRESHOLD, Z, RELEVANT, BOOST = 0.3, 5.0, 0.1, 200.0
BLOCK, K, SOFT, PRIOR = 64, 24, 0.03, 13.0
#: Blocks read one by one; if more cannot be left out by their bounds, or these are nearly alike from the start, all is read by term.
FIRST, ALIKE = 3, 0.2
#: Least weight in a unit query of its heaviest term for the bounds to be looked at; queries that share a product of matrices.
PEAK, GROUP = 0.3, 64
#: Words whose terms are kept once seen.
SEEN = 200_000
STEMS = (4, 5, 6, 7, 8)
SEED = 5
_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def stems(word: str) -> tuple[str, ...]:
    return tuple(word[:k] + "*" for k in STEMS if len(word) >= k)


def term_id(term: str) -> int:
    """The term as a signed 64-bit hash."""
    h = xxhash.xxh64_intdigest(term)
    return h - (h >> 63 << 64)


def sampled_labels(labels: DataFrame, max_examples: int) -> DataFrame:
    """(doc_id, toxic, draw): about ``max_examples`` ids of the training part at most."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30))
    if n > max_examples:
        rows = rows.where(draw < int(max_examples / n * (1 << 30)))
    return rows.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic")).withColumn("draw", draw)


def _sketched(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The least hash of a text's five-word shingles: copies and near copies mostly share it, other texts do not."""
    out = []
    for text in texts(batch.column(1)):
        words = words_of(text)
        shingles = zip(*(words[k:] for k in range(min(5, max(len(words), 1)))), strict=False)
        out.append(min((xxhash.xxh64_intdigest(" ".join(x)) for x in shingles), default=0) >> 1)
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["key", "sketch"])


def relevances(examples: DataFrame) -> dict[int, float]:
    """Relevance of each term (words and beginnings of words) that has one; copies of a text count once."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: tuple[Counter[str], Counter[str]] = Counter(), Counter()
        for text, label in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            words = set(words_of(text))
            seen[label].update(words.union(*map(stems, words)))
        every = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_arrays([pa.array([term_id(t) for t in every], pa.int64()), *(pa.array([c[t] for t in every], pa.int64()) for c in seen)], ["term", "clean", "toxic"])

    once = map_arrow(examples.select("key", "text"), "key struct<a: long, b: long>, sketch long", _sketched).groupBy("sketch").agg(F.min("key").alias("key"))
    apart = cut_lineage(examples.join(if_small(cut_lineage(once.select("key"))), "key", "left_semi").dropDuplicates(["key"]).select("text", "toxic"))
    total = {r[0]: r[1] for r in apart.groupBy("toxic").count().collect()}
    n1, n = total.get(1, 0), total.get(0, 0) + total.get(1, 0)
    if not 0 < n1 < n:
        return {}
    counts = map_arrow(apart, "term long, clean long, toxic long", work).groupBy("term").agg(F.sum("toxic").alias("a"), (F.sum("toxic") + F.sum("clean")).alias("n"))
    p, m, zz = F.col("a") / F.col("n"), F.col("n"), Z * Z
    low = (p + zz / (2 * m) - Z * F.sqrt(p * (1 - p) / m + zz / (4 * m * m))) / (1 + zz / m)
    found = counts.select("term", ((low - n1 / n) / (1 - n1 / n)).alias("r")).where(F.col("r") > 0).toArrow()  # a part of the bounded sample's terms
    return dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))


class Terms(dict):
    """Term of each word: its number, -1 for none, or -2 - k for all in ``several[k]`` where beginnings of the word are terms too; words are kept once seen."""

    def __init__(self, ids: np.ndarray, markers: Mapping[int, str]):
        """``ids``: sorted hashes of the terms; ``markers``: the beginnings of words that count as terms, by their hashes."""
        super().__init__()
        self.of = {t: k for k, t in enumerate(ids.tolist())}
        self.markers = {m: self.of[t] for t, m in markers.items() if t in self.of}
        self.starts = {m[: STEMS[0]] for m in self.markers}
        self.several: list[list[int]] = []

    def __missing__(self, word: str) -> int:
        found = self.of.get(term_id(word), -1)
        if word[: STEMS[0]] in self.starts:
            more = [self.markers[s] for s in stems(word) if s in self.markers]
            if more:
                self.several.append(more if found < 0 else [found, *more])
                found = -1 - len(self.several)
        self[word] = found
        return found

    def numbers(self, words: Collection[str]) -> np.ndarray:
        """Numbers of the terms of all ``words``, as often as they come."""
        if len(self) > SEEN:
            self.clear()
            self.several.clear()
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        more = [k for x in found[found < -1].tolist() for k in self.several[-2 - x]]
        return np.concatenate([found[found >= 0], np.array(more, np.int64)])

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(term, times) of a text."""
        return np.unique(self.numbers(words_of(text)), return_counts=True)


def terms_of(word: str, markers: Collection[int]) -> list[int]:
    return [term_id(word), *(t for s in stems(word) if (t := term_id(s)) in markers)]


def document_frequency(docs: DataFrame, ids: np.ndarray, markers: Mapping[int, str]) -> tuple[np.ndarray, int]:
    """How many of all documents have each term; the number of documents. One row for each term and partition is shuffled at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, count = Terms(ids, markers), np.zeros(len(ids) + 1, np.int64)
        for batch in batches:
            for part in bounded(batch):
                for text in texts(part.column(0)):
                    count[place.numbers(set(words_of(text)))] += 1  # a term once, however many words have it
                count[-1] += part.num_rows
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["term", "n"])

    ship(docs.sparkSession)
    found = docs.select("text").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(ids) + 1, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out[:-1], int(out[-1])


class BlockMaxIndex:
    """Unit vectors of labelled examples in blocks: weights by term and example, by block, and the largest of each term and block."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], who: list, weight: np.ndarray):
        """``vectors``: (term, times) of each example; ``weight``: of each term, idf with its boost."""
        self.weight = weight
        self.base = sum(toxic) / len(toxic) if toxic else 0.0
        units = [self.unit(*v) for v in vectors]
        key = [(int(t[w.argmax()]) if len(t) else -1, -float(w.max(initial=0))) for t, w in units]
        order = sorted(range(len(units)), key=lambda k: (key[k], str(who[k])))
        self.bare = [k for k in order if not len(units[k][0])]
        order = self.bare + [k for k in order if len(units[k][0])]
        self.toxic, self.who, self.n = np.array([toxic[k] for k in order], np.int64), [who[k] for k in order], len(order)
        self.bare = np.arange(len(self.bare))
        size = np.array([len(units[k][0]) for k in order], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(units[k][0] for k in order)])
        value = np.concatenate([np.zeros(0), *(units[k][1] for k in order)])
        owner = np.repeat(np.arange(self.n), size)
        # by block: entries of consecutive examples stand together
        self.blocks = -(-self.n // BLOCK)
        self.term, self.value, self.owner = term, value, owner
        self.start = np.searchsorted(owner, np.arange(self.blocks + 1) * BLOCK)
        # by term: of terms that many examples have all weights, of the others those that are there
        by = np.argsort(term, kind="stable")
        start = np.searchsorted(term[by], np.arange(len(weight) + 1))
        common = np.flatnonzero(np.diff(start) > max(self.n // 16, BLOCK))
        self.dense_row = np.full(len(weight), -1)
        self.dense_row[common] = np.arange(len(common))
        rare = by[self.dense_row[term[by]] < 0]
        self.posted, self.post_value, self.post_start = owner[rare], value[rare], np.searchsorted(term[rare], np.arange(len(weight) + 1))
        self.query = np.zeros(len(weight))
        # largest of each term and block
        cell = term[by] * self.blocks + owner[by] // BLOCK
        new = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(value[by], new) if len(new) else np.zeros(0)
        self.most_block, self.most_start = cell[new] % max(self.blocks, 1), np.searchsorted(cell[new] // max(self.blocks, 1), np.arange(len(weight) + 1))

    def unit(self, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(times)) * self.weight[term]
        return term, w / np.sqrt((w * w).sum()) if len(w) else w

    @staticmethod
    def _gather(start: np.ndarray, term: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all entries of the terms, and the query's weight at each."""
        a, n = start[term], start[term + 1] - start[term]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return at, np.repeat(w, n)

    @cached_property
    def dense(self) -> np.ndarray:
        """Weights of the terms that many examples have, by term and example; made where it is needed, not sent."""
        row = self.dense_row[self.term]
        out = np.zeros((int(self.dense_row.max(initial=-1)) + 1, self.n))
        out[row[row >= 0], self.owner[row >= 0]] = self.value[row >= 0]
        return out

    def shares(self, units: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms of many examples add to the cosine of each query with each example."""
        many = np.zeros((len(units), len(self.dense)))
        for own, (term, w) in zip(many, units, strict=True):
            row = self.dense_row[term]
            own[row[row >= 0]] = w[row >= 0]
        return many @ self.dense

    def _all(self, term: np.ndarray, w: np.ndarray, share: np.ndarray | None) -> np.ndarray:
        """Cosine of every example."""
        rare = self.dense_row[term] < 0
        at, own = self._gather(self.post_start, term[rare], w[rare])
        return np.bincount(self.posted[at], self.post_value[at] * own, self.n) + (self.shares([(term, w)])[0] if share is None else share)

    def nearest(self, term: np.ndarray, times: np.ndarray, k: int = K, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(cosine, example) of the nearest ``k`` that share a term, and of all that tie with the last; ``share``: the query's row of ``shares``."""
        term, w = self.unit(term, times)
        cosine = self._by_block(term, w, k, share) if w.max(initial=0) >= PEAK else self._all(term, w, share)
        floor = max(np.partition(cosine, -min(k, self.n))[-min(k, self.n)] - 1e-9, 1e-12)
        near = np.flatnonzero(cosine >= floor)
        near = near[np.argsort(-cosine[near], kind="stable")]
        return cosine[near], near

    def _by_block(self, term: np.ndarray, w: np.ndarray, k: int, share: np.ndarray | None) -> np.ndarray:
        """Cosines, 0 in blocks that hold none of the nearest ``k``."""
        at, own = self._gather(self.most_start, term, w)
        bound = np.bincount(self.most_block[at], self.most[at] * own, self.blocks)
        order = np.argsort(-bound, kind="stable")
        self.query[term] = w
        cosine = np.zeros(self.n)
        floor, done = 0.0, 0
        while done < len(order) and bound[order[done]] > 0 and bound[order[done]] >= floor - 1e-9:
            if done >= FIRST or (not done and bound[order[min(FIRST, len(order) - 1)]] > ALIKE * bound[order[0]]):  # bounds that do not part the blocks: all by term
                cosine = self._all(term, w, share)
                break
            b = order[done]
            x, y = self.start[b], self.start[b + 1]
            cosine[b * BLOCK : (b + 1) * BLOCK] = np.bincount(self.owner[x:y] - b * BLOCK, self.value[x:y] * self.query[self.term[x:y]], min(BLOCK, self.n - b * BLOCK))
            done += 1
            floor = np.partition(cosine, -min(k, self.n))[-min(k, self.n)]
        self.query[term] = 0
        return cosine

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list]]:
        """``score`` of each of the vectors."""
        out = []
        for at in range(0, len(vectors), GROUP):
            group = vectors[at : at + GROUP]
            out += [self.score(*v, share) for v, share in zip(group, self.shares([self.unit(*v) for v in group]), strict=True)]
        return out

    def score(self, term: np.ndarray, times: np.ndarray, share: np.ndarray | None = None) -> tuple[float, list]:
        if not self.n:
            return 0.0, []
        if len(term):
            cosine, near = self.nearest(term, times, share=share)
        else:
            cosine, near = np.ones(len(self.bare)), self.bare
        vote = 1 / (1 - np.minimum(cosine, 1.0) + SOFT)
        return float(((vote * self.toxic[near]).sum() + PRIOR * self.base) / (vote.sum() + PRIOR)), [self.who[k] for k in near[:5].tolist()]


class Model:
    """What scoring needs: the index and its terms."""

    def __init__(self, index: BlockMaxIndex, ids: np.ndarray, markers: Mapping[int, str]):
        self.index, self.ids, self.markers = index, ids, markers


def learn(docs: DataFrame, labels: DataFrame, max_examples: int = 20_000, max_index: int = 4096) -> Model | None:
    """None without labels. What comes to the driver is bounded by the two parameters and the number of different words of so many texts."""
    known = cut_lineage(sampled_labels(labels, max_examples))
    # about max_examples ids at most, so the texts stay where they are
    examples = docs.where(~held_out()).select("doc_id", row_key("doc_id", "text").alias("key"), "text").join(if_small(known), "doc_id")
    examples = cut_lineage(examples)
    if examples.isEmpty():
        return None
    relevance = relevances(examples)
    relevant = frozenset(t for t, r in relevance.items() if r >= RELEVANT)
    n = examples.count()
    few = examples if n <= max_index else examples.where(F.col("draw") < _cut(examples, max_index))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms, times, marks = [], [], []
        for text in texts(batch.column(1)):
            found: Counter[int] = Counter()
            for word, n in Counter(words_of(text)).items():
                for t in terms_of(word, relevant):
                    found[t] += n
            terms.append(list(found))
            times.append(list(found.values()))
            marks.append(list({s for word in set(words_of(text)) for s in stems(word) if term_id(s) in relevant}))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), batch.column(2), pa.array(marks, pa.list_(pa.string()))], ["doc_id", "terms", "times", "toxic", "marks"])

    kind = examples.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(few.select("doc_id", "text", "toxic"), f"doc_id {kind}, terms array<long>, times array<int>, toxic int, marks array<string>", work).toArrow()
    terms, times = (rows.column(c).combine_chunks() for c in ("terms", "times"))
    cuts = np.cumsum(np.r_[0, terms.value_lengths().to_numpy(zero_copy_only=False)])
    markers = {term_id(s): s for s in pc.unique(rows.column("marks").combine_chunks().flatten()).to_pylist()}
    ids, at = np.unique(terms.flatten().to_numpy(), return_inverse=True)
    df, total = document_frequency(docs, ids, markers)
    weight = (np.log((1 + total) / (1 + df)) + 0.1) * (1 + BOOST * np.array([max(relevance.get(t, 0.0), 0.0) for t in ids.tolist()]))
    n_times = times.flatten().to_numpy()
    vectors = [(at[a:b], n_times[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return Model(BlockMaxIndex(vectors, rows.column("toxic").to_pylist(), rows.column("doc_id").to_pylist(), weight), ids, markers)


def _cut(examples: DataFrame, most: int) -> int:
    """A draw below which at most ``most`` examples lie, near that many."""
    draws = np.sort(examples.select("draw").toArrow().column(0).to_numpy())  # max_examples longs or so
    return int(draws[most])


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, evidence) of every document; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the parameters of the fit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        place = found and Terms(found.ids, found.markers)
        for batch in batches:
            for part in bounded(batch):
                made = found.index.scores([place.vector(text) for text in texts(part.column(1))]) if found else [(0.0, [])] * part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in made], pa.float64()), pa.array([e for _, e in made], pa.list_(part.schema.field(0).type))], ["doc_id", "score", "evidence"])

    ship(docs.sparkSession)
    narrow = docs.select("doc_id", "text")
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double, evidence array<{kind}>")
