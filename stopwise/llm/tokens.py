"""Token counts of a byte-pair tokenizer by rank-synchronous array merging.

Texts are cut into pre-tokens at borders that no piece crosses, so that each pre-token can be counted
alone and each different one only once per worker. New pre-tokens of a batch are held as one ragged array of
symbol numbers; in each round every sequence applies its lowest-rank pair wherever it stands (from the left, where
places overlap), all sequences at once, until none has a pair left. What survives is counted; a symbol without a
piece counts one token for each of its UTF-8 bytes (byte fallback). Pre-tokens of more than ``LONG`` letters go one by one, their places
queued by rank, so that time grows with the merges. Where a merge makes a pair of no higher rank than its own, places may not be
merged at once; such pre-tokens are seen and merged one place at a time.

Edge cases: null and empty texts have no token. Special strings inside texts are ordinary text. White space is
kept as it is. No text is cut.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

MARK = "▁"
CACHE_WORDS = 400_000
#: Longer pre-tokens are merged alone; longer ones than this many letters are not kept once counted.
LONG, KEPT = 400, 100
_NORMAL, _UNKNOWN_RANK = 1, np.int32(2**31 - 1)


def _disjoint(places: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of places (sorted) each of which covers itself and the one after it, those that do not overlap, from the left on."""
    if not len(places):
        return places
    fresh = np.r_[True, after[:-1] != places[1:]]
    at = np.arange(len(places))
    return places[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]


class PieceCounter:
    """Counts the pieces of a sentencepiece BPE model that normalises nothing but the white-space mark."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
        ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
        score = {model.id_to_piece(i): model.get_score(i) for i in ids}
        if any(MARK in piece.lstrip(MARK) for piece in score):
            raise ValueError("pieces cross word borders; pre-tokens cannot be counted alone")
        if any("\n" in piece for piece in score):
            raise ValueError("pieces hold line ends")
        rank_of = {s: k for k, s in enumerate(sorted(set(score.values()), reverse=True))}
        letters = sorted({c for piece in score for c in piece})
        self.symbol = {s: k for k, s in enumerate([*letters, *(p for p in score if len(p) > 1)])}
        self.base = len(self.symbol)
        pairs = []
        for piece, s in score.items():
            for cut in range(1, len(piece)):
                a, b = self.symbol.get(piece[:cut]), self.symbol.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.base + b, rank_of[s], self.symbol[piece]))
        pairs.sort()
        self.pair_keys = np.array([p[0] for p in pairs] or [-1], np.int64)
        self.pair_rank = np.array([p[1] for p in pairs] or [_UNKNOWN_RANK], np.int32)
        self.pair_to = np.array([p[2] for p in pairs] or [0], np.int32)
        # tokens of a surviving symbol: one if it is a piece, else its bytes; letters outside the model never merge
        self.cost = np.array([1 if s in score else len(s.encode()) for s in self.symbol], np.int64)
        # symbol of each code point; a letter of no piece: -1 less its number of UTF-8 bytes
        point = np.arange(0x110000)
        self.letter = (-2 - (point >= 0x80) - (point >= 0x800) - (point >= 0x10000)).astype(np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(len(letters))
        self.cache: dict[str, int] = {}

    def _look_up(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * self.base + b
        key[(a < 0) | (b < 0)] = -2
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_rank[at], _UNKNOWN_RANK), self.pair_to[at]

    def merged(self, words: list[str]) -> np.ndarray:
        """Number of tokens of each (non-empty) pre-token."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        total = np.zeros(len(words), np.int64)
        for k in np.flatnonzero(length > LONG).tolist():
            total[k] = self._long(words[k])
        short = np.flatnonzero(length <= LONG)
        seq = np.repeat(short, length[short])
        sym = self._letters("".join([words[k] for k in short.tolist()]) if len(short) < len(words) else "".join(words))

        def count(sym: np.ndarray, seq: np.ndarray) -> None:
            total[:] += np.bincount(seq, self._costs(sym), len(words)).astype(np.int64)

        rank, to = self._look_up(sym, np.r_[sym[1:], np.int32(-1)])
        rank[np.r_[seq[1:] != seq[:-1], True][: len(seq)]] = _UNKNOWN_RANK
        while len(seq):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.r_[starts, len(seq)])
            live = np.repeat(best < _UNKNOWN_RANK, size)
            if not live.all():  # sequences without a pair are done
                count(sym[~live], seq[~live])
                sym, seq, rank, to = sym[live], seq[live], rank[live], to[live]
                if not len(seq):
                    break
                size, best = size[best < _UNKNOWN_RANK], best[best < _UNKNOWN_RANK]
            at = _disjoint(low := np.flatnonzero(rank == np.repeat(best, size)), low + 1)
            floor = rank[at]
            beyond = np.minimum(at + 2, len(sym) - 1)
            early, _ = self._look_up(to[at], sym[beyond])
            odd = [seq[at[(early <= floor) & (beyond == at + 2) & (seq[beyond] == seq[at])]]]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # where they are once the right halves are gone
            sym, seq, rank, to = sym[keep], seq[keep], rank[keep], to[keep]
            some = at > 0
            for here, least in ((at, floor), (at[some] - 1, floor[some])):
                after = np.minimum(here + 1, len(sym) - 1)
                r, t = self._look_up(sym[here], sym[after])
                r[(after == here) | (seq[after] != seq[here])] = _UNKNOWN_RANK
                rank[here], to[here] = r, t
                odd.append(seq[here[r <= least]])
            if len(odd := np.unique(np.concatenate(odd))):  # the order of merges matters there
                for k in odd.tolist():
                    total[k] = self._sequential(words[k])
                keep = ~np.isin(seq, odd)
                sym, seq, rank, to = sym[keep], seq[keep], rank[keep], to[keep]
        return total

    def _letters(self, text: str) -> np.ndarray:
        return self.letter[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]

    def _costs(self, sym: np.ndarray) -> np.ndarray:
        return np.where(sym >= 0, self.cost[np.maximum(sym, 0)], -1 - sym)

    def _long(self, word: str) -> int:
        """The same for one long pre-token: places are queued by rank, so that a round costs what it merges and not the whole length."""
        sym = np.r_[self._letters(word), np.int32(-1)]  # the last stands for the end
        n = len(word)
        after, before, alive = np.arange(1, n + 2), np.arange(-1, n), np.ones(n + 1, bool)
        rank, to = self._look_up(sym, np.r_[sym[1:], np.int32(-1)])
        queued: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def queue(places: np.ndarray) -> None:
            places = places[rank[places] < _UNKNOWN_RANK]
            places = places[np.argsort(rank[places], kind="stable")]
            found = rank[places]
            cuts = np.flatnonzero(found[1:] != found[:-1]) + 1
            for part in np.split(places, cuts) if len(places) else ():
                r = int(rank[part[0]])
                if r not in queued:
                    queued[r] = []
                    heapq.heappush(ranks, r)
                queued[r].append(part)

        queue(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(queued.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            at = _disjoint(at, after[at])
            if not len(at):
                continue
            right = after[at]
            beyond = after[right]
            early, _ = self._look_up(to[at], sym[beyond])
            sym[at] = to[at]
            alive[right] = False
            after[at], before[beyond] = beyond, at
            touched = np.unique(np.r_[at, before[at][before[at] >= 0]])
            rank[touched], to[touched] = self._look_up(sym[touched], sym[after[touched]])
            if (early <= r).any() or (rank[touched] <= r).any():
                return self._sequential(word)
            queue(touched)
        return int(self._costs(sym[:n][alive[:n]]).sum())

    def _sequential(self, word: str) -> int:
        """The same, one merge at a time, for the rare pre-tokens in which a merge makes a pair of lower rank than its own."""
        sym = self._letters(word).tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(a: int, b: int) -> None:
            if a >= 0 and b < n:
                pair = sym[a], sym[b]
                if pair not in known:
                    rank, to = self._look_up(np.array(pair[:1]), np.array(pair[1:]))
                    known[pair] = int(rank[0]), int(to[0])
                if known[pair][0] < _UNKNOWN_RANK:
                    heapq.heappush(heap, (known[pair][0], a, *pair, known[pair][1]))

        for a in range(n - 1):
            push(a, a + 1)
        gone = [False] * n
        while heap:
            _, a, left, right, to = heapq.heappop(heap)
            b = after[a]
            if gone[a] or b >= n or sym[a] != left or sym[b] != right:
                continue
            sym[a], gone[b], after[a] = to, True, after[b]
            if after[b] < n:
                before[after[b]] = a
            push(before[a], a)
            push(a, after[a])
        return int(self._costs(np.array([x for x, out in zip(sym, gone, strict=True) if not out], np.int32)).sum())

    def _tokens(self, words: list[str]) -> list[int]:
        """Tokens of each word after a space; of a word that begins with a line end, of that and the word as it is."""
        bare = [w[1:] if w[0] == "\n" else MARK + w for w in words]
        out = np.fromiter((w[0] == "\n" for w in words), np.int64, len(words))
        some = np.flatnonzero(np.fromiter(map(len, bare), np.int64, len(bare)))
        out[some] += self.merged([bare[k] for k in some.tolist()])
        return out.tolist()

    def _learn(self, words: set[str]) -> list[str]:
        """Fill the cache with ``words``; returns the new ones too long to be kept for later texts."""
        new = list(words.difference(self.cache))
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(words)
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            self.cache.update(zip(part, self._tokens(part), strict=True))
        return [w for w in new if len(w) > KEPT]

    def count(self, batch: Iterable[str]) -> list[int]:
        split, odd = [], []
        for k, text in enumerate(batch):
            text = text.replace(MARK, " ")
            words = text.replace("\n", " \n").split(" ") if text else []
            if "" in words:  # runs of spaces: cut into pre-tokens one by one
                odd.append((k, _PRE_TOKEN.findall(MARK + text.replace(" ", MARK))))
                words = []
            split.append(words)
        long = self._learn(set().union(*split))
        out = [sum(map(self.cache.__getitem__, words)) for words in split]
        for word in long:
            del self.cache[word]
        for k, words in odd:
            kinds, n = np.unique(np.array(words, object), return_counts=True)
            ends = kinds == "\n"
            out[k] = int(n[ends].sum() + (self.merged(kinds[~ends].tolist()) * n[~ends]).sum())
        return out


#: A run of white-space marks with the letters that follow up to the next mark or line end; a line end alone.
_PRE_TOKEN = re.compile(rf"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


@lru_cache(maxsize=2)
def _counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def token_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text; ``model`` is the name of a public tokenizer file."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        import public_tokenizers

        counts = _counter(str(public_tokenizers.path(model))).count(texts(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    narrow = docs.select(F.struct(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")).alias("doc_id"), F.col(text_col).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = map_arrow(narrow, f"doc_id {kind}, n_tokens long", work)
    return out.select(F.col("doc_id.id").alias("doc_id"), "doc_id.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
