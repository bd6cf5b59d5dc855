"""Where byte-level BPE cuts a text before its merges, found without a regular expression.

Each code point has a class. A class is a function from the state before a character to the state
after it; the functions that can be composed of these are few, so that each has a number and
composition is a table. Prefix products over a batch are then an associative scan: first inside
blocks, all blocks at once, then over the blocks.

The cuts are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np

# Character classes. SHORT and LONG are apostrophes before s t m d and before re ve ll.
LETTER, NUMBER, OTHER, SPACE, WHITE, SHORT, LONG = range(7)
# States: a token has just ended, or the kind of the token that is open. LEFT1 and LEFT2: inside
# a contraction of which one or two letters are left.
ENDED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, LEFT1, LEFT2 = range(8)

# White_Space code points.
_WHITE = (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
_BLOCK = 128


@functools.cache
def class_table() -> np.ndarray:
    """The class of every code point, as one byte each."""
    found = np.full(0x110000, OTHER, np.uint8)
    category = unicodedata.category
    kinds = np.array([category(chr(i))[0] for i in range(0x110000)])
    found[kinds == "L"] = LETTER
    found[kinds == "N"] = NUMBER
    found[list(_WHITE)] = WHITE
    found[0x20] = SPACE
    return found


def _step(kind: int, state: int) -> int:
    if kind == LETTER:
        return {LEFT1: ENDED, LEFT2: LEFT1}.get(state, IN_LETTERS)
    if kind in (SHORT, LONG) and state not in (IN_OTHER, AFTER_SPACE):
        return LEFT1 if kind == SHORT else LEFT2
    return {NUMBER: IN_NUMBERS, SPACE: AFTER_SPACE, WHITE: IN_WHITE}.get(kind, IN_OTHER)


def _starts(kind: int, state: int) -> bool:
    """Whether a token starts at a character; of white space, the first of a run."""
    if kind == LETTER:
        return state not in (IN_LETTERS, AFTER_SPACE, LEFT1, LEFT2)
    if kind == NUMBER:
        return state not in (IN_NUMBERS, AFTER_SPACE)
    if kind in (SPACE, WHITE):
        return state not in (AFTER_SPACE, IN_WHITE)
    return state not in (IN_OTHER, AFTER_SPACE)


@functools.cache
def _functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(after, compose, starts): functions 0-6 are the classes, 7-13 those that begin a text.

    after[f, state]; compose[f, g] is f and then g; starts[class, state].
    """
    plain = [tuple(_step(k, s) for s in range(8)) for k in range(7)]
    numbers: dict[tuple, int] = {}
    for f in plain + [(p[ENDED],) * 8 for p in plain]:
        numbers.setdefault(f, len(numbers))
    # Classes may share a function, so the first 14 numbers are given through this list.
    basis = [numbers[f] for f in plain + [(p[ENDED],) * 8 for p in plain]]
    while True:
        known = list(numbers)
        for f in known:
            for g in known:
                numbers.setdefault(tuple(g[s] for s in f), len(numbers))
        if len(numbers) == len(known):
            break
    after = np.array(list(numbers), np.uint8)
    compose = np.array(
        [[numbers[tuple(g[s] for s in f)] for g in numbers] for f in numbers], np.uint16
    )
    starts = np.array([[_starts(k, s) for s in range(8)] for k in range(7)])
    return after, compose, (starts, np.array(basis, np.uint16))


def _states(kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The state before each character; ``first`` are the positions where texts begin."""
    after, compose, (_, basis) = _functions()
    width = len(after)
    flat = compose.ravel()
    functions = basis[kinds]
    functions[first] = basis[kinds[first] + 7]
    n = len(functions)
    blocks = -(-n // _BLOCK)
    grid = np.zeros(blocks * _BLOCK, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(blocks, _BLOCK).T)
    for t in range(1, _BLOCK):
        grid[t] = flat[grid[t - 1].astype(np.int32) * width + grid[t]]
    state, entry = ENDED, []
    table = after.tolist()
    for last in grid[-1].tolist():
        entry.append(state)
        state = table[last][state]
    reached = after[grid, np.array(entry, np.uint8)[None, :]].T.ravel()[:n]
    before = np.empty(n, np.uint8)
    before[1:] = reached[:-1]
    before[:1] = ENDED
    before[first] = ENDED
    return before


def cuts(texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, byte offset of every pre-token, first pre-token of every text).

    The two offset arrays end with the total.
    """
    joined = "".join(texts)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    utf8 = joined.encode()
    if not joined:
        return utf8, np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64)
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    kinds = class_table()[points]
    first = (ends - lengths)[lengths > 0]
    last = ends[lengths > 0] - 1
    white = (kinds == SPACE) | (kinds == WHITE)
    # Apostrophes that can begin a contraction, if no other token holds them.
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        end_of = last[np.searchsorted(last, marks)]
        one = points[np.minimum(marks + 1, len(points) - 1)]
        two = points[np.minimum(marks + 2, len(points) - 1)]
        has1, has2 = marks + 1 <= end_of, marks + 2 <= end_of
        short = has1 & np.isin(one, [ord(c) for c in "stmd"])
        pairs = [("r", "e"), ("v", "e"), ("l", "l")]
        long = has2 & np.any([(one == ord(a)) & (two == ord(b)) for a, b in pairs], axis=0)
        kinds[marks[short]] = SHORT
        kinds[marks[long]] = LONG
    before = _states(kinds, first)
    _, _, (starts, _) = _functions()
    is_start = starts.ravel()[kinds.astype(np.int32) * 8 + before]
    # The last of several white-space characters stands alone or goes with what follows.
    next_black = np.zeros(len(kinds), bool)
    next_black[:-1] = ~white[1:]
    next_black[last] = False
    is_start |= white & next_black
    at = np.flatnonzero(is_start)
    if len(utf8) == len(points):
        offsets = at
    else:
        sizes = np.ones(len(points), np.int8)
        for bound in (0x80, 0x800, 0x10000):
            sizes += points >= bound
        offsets = (np.cumsum(sizes, dtype=np.int64) - sizes)[at]
    firsts = np.searchsorted(at, ends - lengths)
    return utf8, np.append(offsets, len(utf8)), np.append(firsts, len(at))


def pieces(texts: Sequence[str]) -> tuple[list[bytes], np.ndarray]:
    """(all pre-tokens as bytes, first pre-token of every text and the total)."""
    utf8, offsets, firsts = cuts(texts)
    at = offsets.tolist()
    return [utf8[a:b] for a, b in zip(at, at[1:])], firsts


def parts(text: str, limit: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that can be cut on their own.

    A token always ends between black and white, and nothing before that place depends on what
    follows it, so parts begin at such a place. Without one the rest stays whole.
    """
    start = 0
    while len(text) - start > limit:
        at = start + limit
        while at < len(text) and not (text[at] in " \n\t" and not text[at - 1].isspace()):
            at += 1
        yield text[start:at]
        start = at
    if start < len(text) or not start:
        yield text[start:]
