"""Token counts by rank-synchronous merging of ragged numpy arrays.

All pre-tokens of a batch lie one after the other in one array of symbols. In each round every sequence applies its own
lowest-ranked pair, at all places at once and from left to right; sequences without a mergeable pair leave with the
number of symbols that are left. A merge can only make pairs of later rank, so this equals merging one pair at a time.
"""

from __future__ import annotations

import numpy as np

from quern.llm.backtrack import Vocabulary

NONE = np.iinfo(np.int64).max


class RankSync:
    def __init__(self, vocab: Vocabulary):
        pairs = np.array([(a * vocab.size + b, vocab.rank[m], m) for (a, b), m in vocab.merge.items()], np.int64).reshape(-1, 3)
        pairs = pairs[np.argsort(pairs[:, 0])]
        self.keys, self.ranks, self.made = (np.ascontiguousarray(pairs[:, k]) for k in range(3))
        self.by_rank = self.made[np.argsort(self.ranks)]
        self.size = vocab.size
        self.single = np.full(256, -1, np.int64)
        for b, i in vocab.single.items():
            self.single[b] = i

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def counts(self, words: list[str]) -> list[int]:
        """Number of tokens of each pre-token."""
        data = [w.encode() for w in words]
        out = np.zeros(len(data), np.int64)
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        who = np.flatnonzero(sizes)
        symbols = self.single[np.frombuffer(b"".join(data), np.uint8)]
        if (symbols < 0).any():
            raise ValueError("a byte is not in the vocabulary")
        sizes = sizes[who]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        rank = np.full(len(symbols), NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self._rank(symbols[inner], symbols[inner + 1])
        while len(who):
            begins = np.cumsum(sizes) - sizes
            lowest = np.minimum.reduceat(rank, begins)
            done = lowest == NONE
            if done.any():
                out[who[done]] = sizes[done]
                stay = np.repeat(~done, sizes)
                symbols, rank, last = symbols[stay], rank[stay], last[stay]
                who, sizes, lowest = who[~done], sizes[~done], lowest[~done]
                if not len(who):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, sizes))
            # Of pairs that overlap, as in aaaa, every second one from the left of its run applies.
            if len(hit) > 1:
                fresh = np.concatenate([[True], np.diff(hit) > 1])
                run = np.flatnonzero(fresh)
                hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) % 2 == 0]
            symbols[hit] = self.by_rank[rank[hit]]
            last[hit] = last[hit + 1]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            moved = hit - np.arange(len(hit))  # one symbol goes for each merge before
            gone = np.zeros(len(symbols), np.int64)
            gone[hit + 1] = 1
            sizes = sizes - np.add.reduceat(gone, np.cumsum(sizes) - sizes)
            symbols, rank, last = symbols[keep], rank[keep], last[keep]
            again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[again] = NONE
            again = again[~last[again]]
            rank[again] = self._rank(symbols[again], symbols[again + 1])
        return out.tolist()
