"""Language identification by cross-parsing entropy.

For each language, a suffix automaton holds labelled text. A document is parsed against each one into the fewest
phrases, each the longest match that occurs in the labelled text (or one new letter). The language
with the fewest phrases, normalised by log2 of its labelled length, wins.

Fitting is bounded: ``sample_docs`` labelled documents a language, the least by a seeded hash, of which each
gives a stretch of ``sample_chars`` characters (64 x 600 by default) from a place anywhere in it that the hash names; that bound is all that limits it.
Prediction reads every letter: a text is parsed in segments of ``SEGMENT`` letters, so that long and short documents
advance side by side in arrays; a border costs each language the same. Every labelled letter is a symbol of its own: the
``DENSE`` most frequent ones of a language have columns in its table, the transitions of its others are looked up in sorted
keys, so that large alphabets cost memory by their text, not by their size.

``reject_unknown`` lets go what is in none of the languages: texts without a letter, and texts of ``LEAST`` characters or more whose phrases
have fewer than ``FIT`` characters on average even under the best language (other languages, strings of random letters).

Edge cases: ``und`` (score 0) where the text is null or has no letter, or where nothing could be learned; equal
counts go to the language that sorts first.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SMALL_SLICE, cut_lineage, fresh, held_out, if_small, map_arrow, texts

SEGMENT = 512
DENSE = 61
UNKNOWN = "und"
LEAST, FIT = 40, 1.6


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts each substring of ``symbols``; state 0 is the start."""
    step, link, length, last = [{}], [-1], [0], 0
    for c in symbols:
        now = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    return step


class ParseTable:
    """One language's automaton: at row + column stands the next row, with bit 0 set where a new phrase starts at this symbol."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        """``symbols`` of the labelled text, of ``n_symbols`` in all; the last of these is padding."""
        own, n = np.unique(symbols[symbols > 0], return_counts=True)
        own = own[np.lexsort((own, -n))]
        # columns: 0 no letter, the dense letters, any other letter, padding; an even number, so that the lowest bit of a row's offset is free
        other = len(own[:DENSE]) + 1
        pad, self.stride = other + 1, other + 2 + other % 2
        #: Of each symbol its column, and its number among the letters without one (0: none).
        self.column = np.full(n_symbols, other, np.uint8)
        self.rare = np.zeros(n_symbols, np.int64)
        self.column[0], self.column[-1] = 0, pad
        self.column[own[:DENSE]] = np.arange(1, len(own[:DENSE]) + 1)
        self.rare[own[DENSE:]] = np.arange(1, len(own[DENSE:]) + 1)
        self.width = len(own[DENSE:]) + 1
        states = suffix_automaton(np.where(self.rare[symbols] > 0, self.stride + self.rare[symbols], self.column[symbols]).tolist())
        table = np.full((len(states), self.stride), -1, np.int32)  # about 8 MB for 38,000 letters of an alphabet of 35
        keys, to = [], []
        for k, (row, nexts) in enumerate(zip(table, states, strict=True)):
            for c, x in nexts.items():
                if c < self.stride:
                    row[c] = x
                else:
                    keys.append(k * self.width + c - self.stride)
                    to.append(x)
        root = np.maximum(table[0], 0) * self.stride
        new = table < 0
        new[0] = True  # each symbol at the start begins a phrase
        table *= self.stride
        np.copyto(table, (root | 1).astype(np.int32), where=new)
        table[:, pad] = np.arange(len(states)) * self.stride  # padding changes nothing
        self.table = table.ravel()
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.to = np.array(keys, np.int64)[order], (np.array(to, np.int64)[order] * self.stride).astype(np.int32)
        self.first = np.zeros(self.width, np.int32)  # the row after a rare letter that begins a phrase
        at_root = self.keys < self.width
        self.first[self.keys[at_root]] = self.to[at_root]

    def phrases(self, columns: np.ndarray) -> np.ndarray:
        """Number of phrases of each segment; ``columns`` holds the symbols of all segments place by place."""
        row, total = np.zeros(columns.shape[1], np.int32), np.zeros(columns.shape[1], np.int32)
        for symbols in columns:
            now = self.table[row + self.column[symbols]]
            if len(self.keys):
                rare = self.rare[symbols]
                some = np.flatnonzero(rare)
                state, rare = row[some].astype(np.int64) // self.stride, rare[some]
                key = state * self.width + rare
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                now[some] = np.where((self.keys[at] == key) & (state > 0), self.to[at], self.first[rare] | 1)
            total += now & 1
            row = now & ~1
        return total


class CrossParser:
    def __init__(self, samples: tuple[tuple[str, str], ...]):
        """``samples``: (language, labelled text), one for each language."""
        self.langs = [lang for lang, _ in samples]
        points = [_points(text.lower()) for _, text in samples]
        letters = np.unique(np.concatenate([x[_is_letter()[x]] for x in points] or [np.zeros(0, np.uint32)]))
        self.pad = len(letters) + 2
        self.symbol = np.zeros(0x110000, np.min_scalar_type(self.pad))
        self.symbol[_is_letter()] = self.pad - 1  # a letter that the labelled text lacks
        self.symbol[letters] = np.arange(1, len(letters) + 1)
        self.tables = [ParseTable(self.symbol[x], self.pad + 1) for x in points]
        self.bits = np.array([math.log2(max(len(x), 2)) for x in points])

    def phrases(self, docs: list[np.ndarray]) -> np.ndarray:
        """Number of phrases of each document (symbols) under each language."""
        parts = np.array([-(-len(x) // SEGMENT) for x in docs], np.int64)
        starts = np.cumsum(parts) - parts
        grid = np.full((parts.sum(), SEGMENT), self.pad, self.symbol.dtype)
        flat = grid.reshape(-1)
        for x, at in zip(docs, starts * SEGMENT, strict=True):
            flat[at : at + len(x)] = x
        columns = np.ascontiguousarray(grid.T)
        out = np.zeros((len(docs), len(self.langs)))
        some = parts > 0
        for k, table in enumerate(self.tables):
            if some.any():
                out[some, k] = np.add.reduceat(table.phrases(columns), starts[some])
        return out

    def predict(self, batch: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and characters to a phrase of each text."""
        points = [_points(x.lower()) for x in batch]
        letters = np.array([bool(_is_letter()[x].any()) for x in points], bool)
        if not self.langs or not letters.any():
            return [UNKNOWN] * len(batch), np.zeros(len(batch)), np.zeros(len(batch))
        phrases = self.phrases([self.symbol[x] for x in points])
        cost = phrases * self.bits
        best = cost.argmin(axis=1)
        fit = np.fromiter(map(len, points), float, len(points)) / np.maximum(phrases[np.arange(len(best)), best], 1)
        ordered = np.sort(cost, axis=1)
        second = ordered[:, 1] if len(self.langs) > 1 else np.full(len(batch), np.inf)
        score = np.where(letters, 1 - ordered[:, 0] / np.maximum(second, 1e-9), 0.0)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best, letters, strict=True)], np.clip(score, 0, 1), fit


@lru_cache(maxsize=1)
def _parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def learn(docs: DataFrame, sample_docs: int = 64, sample_chars: int = 600, seed: int = 11) -> tuple[tuple[str, str], ...]:
    """(language, labelled text) from documents that are not held out; what comes to the driver is bounded by the parameters."""
    rows = docs.where(F.col("lang").isNotNull() & ~held_out()).select("lang", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    first = F.pmod(F.shiftrightunsigned("h", 30), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1).cast("int") + 1
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    share = cut_lineage(rows.groupBy("lang").count()).select("lang", F.least(F.lit(1.0), F.lit(2.0 * sample_docs) / F.col("count")).alias("share"))
    # the sample is drawn over hashes; its texts are met by a broadcast of those, 2 * sample_docs a language or so
    drawn = rows.select("lang", "h").join(if_small(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    few = rows.join(if_small(cut_lineage(drawn.select("lang", "h").distinct())), ["lang", "h"], "left_semi")
    few = few.groupBy("lang", "h").agg(F.min(F.substring("text", first, F.lit(sample_chars))).alias("text"))  # equal rows count once
    found: dict[str, list[tuple[int, str]]] = {}
    for lang, h, text in few.collect():
        found.setdefault(lang, []).append((h % (1 << 30), text))
    return tuple((lang, "\n".join(text for _, text in sorted(found[lang])[:sample_docs])) for lang in sorted(found))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], *carry: str, names: tuple[str, str, str] = ("lang_pred", "score", "fit")) -> DataFrame:
    """Columns ``carry`` of ``docs`` with language, score and characters to a phrase under ``names``, which replace any of these names; only the text is looked at."""
    kept = [c for c in carry if c not in names]
    narrow = docs.select(*kept) if "text" in kept else docs.select(*kept, "text")
    at = narrow.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, fit = _parser(samples).predict(texts(batch.column(at)))
        arrays = [*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(score), pa.array(fit)]
        return pa.RecordBatch.from_arrays(arrays, [*kept, *names])

    fields = [*narrow.schema.fields[: len(kept)], *(T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))]
    return map_arrow(narrow, T.StructType(fields), work, SMALL_SLICE)


def reject_unknown(docs: DataFrame, samples: tuple[tuple[str, str], ...]) -> DataFrame:
    """``docs`` without the documents that are in none of the learned languages."""
    lang, score, fit = fresh(docs, "lang_pred", "score", "fit")
    found = identify(docs, samples, *docs.columns, names=(lang, score, fit))
    return found.where((F.col(lang) != UNKNOWN) & ((F.length("text") < LEAST) | (F.col(fit) >= FIT))).select(*docs.columns)
