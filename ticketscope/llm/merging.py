"""Byte-pair merges of many words at once, on ragged arrays of symbols.

In every round each word finds its pair of lowest rank and all words merge theirs at the same
time; words without a pair leave the arrays.

Merging all places of a pair in one round gives what one merge at a time gives if a merge that
uses a symbol has a higher rank than the merge that makes it. This is checked on construction.
"""

from __future__ import annotations

import numpy as np

_NONE = np.int64(1 << 40)


class PairTable:
    """Rank and result of every pair of symbols, in a hash table of arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, results: np.ndarray, byte_ids: np.ndarray):
        made = np.full(int(max(results.max(initial=0), byte_ids.max(), pairs.max(initial=0))) + 1, -1)
        np.maximum.at(made, results, ranks)
        if len(pairs) and (made[pairs].max(axis=1) >= ranks).any():
            raise ValueError("A merge precedes the merge of its parts")
        self.byte_ids = byte_ids.astype(np.int64)
        self.width = np.int64(len(made))
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.mask = (1 << self.bits) - 1
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, _NONE, np.int64)
        self.results = np.zeros(1 << self.bits, np.int64)
        taken, order = self._slot(keys), np.arange(len(keys))
        while len(order):
            free = np.flatnonzero(self.keys[taken] == -1)
            slots, first = np.unique(taken[free], return_index=True)
            put = free[first]
            self.keys[slots] = keys[order[put]]
            self.ranks[slots] = ranks[order[put]]
            self.results[slots] = results[order[put]]
            rest = np.ones(len(order), bool)
            rest[put] = False
            order, taken = order[rest], (taken[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a slot without rank if there is no such merge."""
        keys = left * self.width + right
        slot = self._slot(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            open_ = open_[(there != keys[open_]) & (there != -1)]
        return slot

    def merge(self, words: list[bytes], want_symbols: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(symbols left of all words, how many of each word); no word may be empty.

        Without ``want_symbols`` the first array is empty.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            slot = self.find(symbols[:-1], symbols[1:])
            rank = np.append(np.where(inside, self.ranks[slot], _NONE), _NONE)
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            low = np.repeat(low, sizes)
            at = np.flatnonzero((rank == low) & (rank < _NONE))
            # Of overlapping places (a a a) every other one counts, from the left.
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1])[:len(at)])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
            symbols[at] = self.results[slot[at]]
            counts -= np.bincount(owner[at], minlength=len(counts))
            open_ = low < _NONE
            if want_symbols:
                done.append((owner[~open_], symbols[~open_]))
            open_[at + 1] = False
            symbols, owner = symbols[open_], owner[open_]
        if not done:
            return np.zeros(0, np.int64), counts
        # A word leaves the arrays whole, so a stable sort by word keeps its symbols in order.
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        return np.concatenate([s for _, s in done])[order], counts
