"""Recompression of letters: rounds that name runs and pairs, the same way everywhere.

Each round is a Spark aggregation over all base records (repeats.name_rounds): the tasks count what is to be named, the
sums decide, and the names are numbers given once for all tasks. The first round names maximal runs of one letter by
(letter, length). Each further round sorts all names into left and right ones and names the adjacent pairs of a left and
a right symbol by (name, name); other symbols stay. So equal parts get equal names in all records. Symbols cover the
text without a gap.

What a symbol depends on is kept as its context: the letters whose knowledge alone fixes that the symbol stands there.
A substring that holds the context of a symbol has that symbol in its interior wherever the substring occurs.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240117)
#: Names of the 26 letters; 0 separates records and belongs to none.
LETTER = np.concatenate([[0], _RNG.integers(1, 1 << 63, 26, dtype=np.uint64)]).astype(np.uint64)
BASE = np.uint64(int(_RNG.integers(1 << 40, 1 << 62)) * 2 + 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_A, _B = (np.uint64(int(x) * 2 + 1) for x in _RNG.integers(1 << 40, 1 << 62, 2))
_S29, _S32 = np.uint64(29), np.uint64(32)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = x ^ (x >> _S32)
    x *= _A
    x ^= x >> _S29
    x *= _B
    x ^= x >> _S32
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (BASE, BASE_INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


class Fingerprints:
    """Fingerprints of all substrings of a text of codes 0 to 26: keys to meet by. They never decide what is equal."""

    def __init__(self, codes: np.ndarray):
        up, self.down = _powers(len(codes) + 1)
        self.sums = np.empty(len(codes) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(LETTER[codes] * up[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def windows(self, width: int) -> np.ndarray:
        """Of each substring of `width` letters, by its start."""
        out = self.sums[width:] - self.sums[:-width]
        out *= self.down[: len(out)]
        return out


class Names:
    """The names that the rounds gave so far, the same in all tasks: runs by (letter, length), then pairs by (name, name), one table a round."""

    def __init__(self) -> None:
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # a round each: sorted codes and their names
        self.last = 0

    def add(self, codes: list[int]) -> None:
        """The next round's table: codes get the names that follow."""
        self.tables.append((np.array(sorted(codes), dtype=np.uint64), np.arange(self.last + 1, self.last + 1 + len(codes), dtype=np.uint64)))
        self.last += len(codes)

    def of(self, r: int, codes: np.ndarray) -> np.ndarray:
        """The names of round r's codes; 0 for those without one."""
        known, names = self.tables[r]
        if not len(known):
            return np.zeros(len(codes), dtype=np.uint64)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return np.where(known[at] == codes, names[at], np.uint64(0))


def _runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and codes (letter, length) of the maximal runs of one letter."""
    new = np.empty(len(codes), dtype=bool)
    new[0] = True
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    start = np.flatnonzero(new).astype(np.int32)
    end = np.append(start[1:], np.int32(len(codes)))
    return start, end, (codes[start].astype(np.uint64) << _S32) | (end - start).astype(np.uint64)


def _pairs(name: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Round r's left symbols, and the places at which a left symbol stands before a right one."""
    is_left = (mix(name) >> np.uint64(r + 7)) & np.uint64(1) == 1
    return is_left, np.flatnonzero(is_left[:-1] & ~is_left[1:] & (name[:-1] != 0) & (name[1:] != 0))


def parse(codes: np.ndarray, names: Names, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names, starts, and context bounds [from, to) of the symbols after the run round and the pair rounds that names has.

    codes: letters as 1 to 26; a 0 stands before, between and after the records. Runs that no round named are called 0
    and join no pair, pairs that no round named stay two symbols: either way a matter of the letters in the context.
    """
    start, end, run = _runs(codes)
    name = names.of(0, run)
    low, high = start - 1, end + 1
    for r in range(len(names.tables) - 1 if rounds is None else rounds):
        is_left, at = _pairs(name, r)
        called = names.of(r + 1, (name[at] << _S32) | name[at + 1])
        at, called = at[called > 0], called[called > 0]
        keep = np.ones(len(name), dtype=bool)
        keep[at + 1] = False
        merged = name.copy()
        merged[at] = called
        kept = np.flatnonzero(keep)
        left = is_left[kept]
        # a left symbol depends on its right neighbour, a right one that stays on its left neighbour
        following, before = np.minimum(kept + left, len(name) - 1), np.maximum(kept - ~left, 0)
        name, start, low, high = merged[kept], start[kept], low[before], high[following]
    return name, start, low, high


def counted(codes: np.ndarray, names: Names) -> tuple[np.ndarray, np.ndarray]:
    """What the next round has to name: the distinct runs or pairs of codes, and how often each occurs."""
    if not names.tables:
        run = _runs(codes)[2]
        return np.unique(run[run >> _S32 != 0], return_counts=True)
    name = parse(codes, names)[0]
    _, at = _pairs(name, len(names.tables) - 1)
    return np.unique((name[at] << _S32) | name[at + 1], return_counts=True)
