"""What is known about pre-tokens, looked up for a whole batch at a time.

A pre-token of up to 15 bytes is its own key, two 64-bit numbers that hold its bytes and its
length, in an open hash table of arrays; longer ones are keys of a dictionary. Every pre-token of
a batch is found by a few array operations. The cache is bounded: once it is full it keeps what it
has, and starts anew if a batch finds less than two thirds of its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

_KEY = 15
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class PieceCache:
    """Ids and their number of every pre-token.

    ``resolve`` gives for a list of distinct pre-tokens the ids of all, one after the other, and
    how many each has. The ids may be left out (empty) if only numbers are wanted.
    """

    def __init__(
        self, resolve: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], bits: int = 20
    ):
        self.resolve = resolve
        self.bits = bits
        self._clear()

    def _clear(self) -> None:
        self.key0 = np.zeros(1 << self.bits, np.uint64)
        self.key1 = np.zeros(1 << self.bits, np.uint64)  # zero: free, as a length is never zero
        self.entry = np.zeros(1 << self.bits, np.int32)
        self.long: dict[bytes, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _keys(self, utf8: bytes, starts: np.ndarray, sizes: np.ndarray):
        padded = utf8 + bytes(16)
        words = np.ndarray((len(utf8) + 9,), "<u8", padded, strides=(1,))
        key0 = words[starts] & _LOW_BYTES[np.minimum(sizes, 8)]
        key1 = words[starts + 8] & _LOW_BYTES[np.clip(sizes - 8, 0, 7)]
        key1 |= np.minimum(sizes, 255).astype(np.uint64) << np.uint64(56)
        return key0, key1

    def _slots(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        mixed = key0 * np.uint64(0x9E3779B97F4A7C15) ^ key1 * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x165667B19E3779F9)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, key0: np.ndarray, key1: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 if there is none."""
        slot = self._slots(key0, key1)
        there = self.key1[slot]
        same = (there == key1) & (self.key0[slot] == key0)
        found = np.where(same, self.entry[slot], -1)
        open_ = np.flatnonzero(~same & (there != 0))
        while len(open_):
            at = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = at
            there = self.key1[at]
            same = (there == key1[open_]) & (self.key0[at] == key0[open_])
            found[open_[same]] = self.entry[at[same]]
            open_ = open_[~same & (there != 0)]
        return found

    def _insert(self, key0: np.ndarray, key1: np.ndarray, entries: np.ndarray) -> None:
        slot = self._slots(key0, key1)
        while len(slot):
            free = np.flatnonzero(self.key1[slot] == 0)
            at, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.key0[at], self.key1[at], self.entry[at] = key0[put], key1[put], entries[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            key0, key1, entries = key0[rest], key1[rest], entries[rest]
            slot = (slot[rest] + 1) & ((1 << self.bits) - 1)

    def look_up(self, utf8: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first id in ``pool``, number of ids) of each pre-token; ``offsets`` end with the total."""
        starts, sizes = offsets[:-1], np.diff(offsets)
        key0, key1 = self._keys(utf8, starts, sizes)
        found = self._find(key0, key1)
        long = np.flatnonzero(sizes > _KEY)
        at, till = starts[long].tolist(), offsets[long + 1].tolist()
        slices = [utf8[a:b] for a, b in zip(at, till)]
        found[long] = np.fromiter((self.long.get(s, -1) for s in slices), np.int64, len(long))
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return self.starts[found], self.counts[found]
        if 3 * len(missing) > len(found) and len(self.counts) > 0.6 * (1 << self.bits):
            self._clear()
            return self.look_up(utf8, offsets)
        fresh: dict[bytes, int] = {}
        first: list[int] = []
        own = np.empty(len(missing), np.int64)
        spans = zip(missing.tolist(), starts[missing].tolist(), offsets[missing + 1].tolist())
        for i, (piece, a, b) in enumerate(spans):
            word = utf8[a:b]
            number = fresh.get(word)
            if number is None:
                number = fresh[word] = len(first)
                first.append(piece)
            own[i] = number
        ids, counts = self.resolve(list(fresh))
        kept = len(self.counts)
        all_starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.pool)])
        all_counts = np.concatenate([self.counts, counts])
        pool = np.concatenate([self.pool, ids.astype(np.int32)])
        found[missing] = kept + own
        self.pool_now = pool
        if len(all_counts) <= 0.7 * (1 << self.bits):
            self.starts, self.counts, self.pool = all_starts, all_counts, pool
            at = np.array(first, np.int64)
            short = sizes[at] <= _KEY
            self._insert(key0[at[short]], key1[at[short]], kept + np.flatnonzero(short))
            self.long.update((w, kept + n) for w, n in fresh.items() if len(w) > _KEY)
        return all_starts[found], all_counts[found]

    def ids(self, utf8: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, how many each has)."""
        self.pool_now = self.pool
        starts, counts = self.look_up(utf8, offsets)
        ends = np.cumsum(counts)
        index = np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool_now[index], counts
