"""The symmetric DUST mask of low-complexity stretches, by its published definition (Morgulis and others, 2006)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.constants import DUST_THRESHOLD, DUST_WINDOW

_CODE = np.full(256, 4, dtype=np.int32)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _CODE[_c + 32] = _i


def _perfect(codes: np.ndarray, widest: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the perfect intervals of letters: score above the limit, and no part with a higher one.

    codes: 0 to 3, and 4 for a break. The score of l triplets is the number of pairs of equal ones over l - 1.
    """
    n = len(codes) - 2
    broken = (codes[:-2] > 3) | (codes[1:-1] > 3) | (codes[2:] > 3)
    t = np.where(broken, -1 - np.arange(n), codes[:-2] * 16 + codes[1:-1] * 4 + codes[2:])
    breaks = np.append(np.flatnonzero(broken), n)
    room = breaks[np.searchsorted(breaks, np.arange(n))] - np.arange(n)  # triplets up to the next break
    pairs = np.zeros(n, dtype=np.float32)  # of the interval of `size` triplets at each start
    before = np.zeros(n, dtype=np.float32)  # earlier equal triplets within the interval, by its last triplet
    best = np.zeros(n, dtype=np.float64)  # highest score of any part of the interval one triplet shorter
    starts, ends = [], []
    for size in range(2, min(widest, n) + 1):
        d, m = size - 1, n - size + 1
        before[d:] += t[d:] == t[:-d]
        pairs = pairs[:m] + before[d : d + m]
        score = np.where(room[:m] >= size, pairs / np.float64(d), 0.0)
        inner = np.maximum(best[:m], best[1 : m + 1])
        hit = np.flatnonzero((score > limit) & (score >= inner))
        starts.append(hit)
        ends.append(hit + size + 2)
        best = np.maximum(score, inner)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate(starts) if starts else none, np.concatenate(ends) if ends else none


def _suspects(codes: np.ndarray, widest: int, limit: float) -> np.ndarray:
    """Triplets at which a perfect interval of letters may end; of most texts none.

    No part of a perfect interval has a higher score than the whole. So what its last m triplets add, the earlier triplets equal
    to them, is more than limit * m for every m below its length. Short and long intervals are looked for one after
    the other, as the equal triplets of a short one are close by. Those of another text count too: that only adds suspects.
    """
    n, few = len(codes) - 2, max(1, int(2 * limit))  # an interval of `few` triplets, all equal, is not above the limit
    broken = (codes[:-2] > 3) | (codes[1:-1] > 3) | (codes[2:] > 3)
    t = np.where(broken, 64 + np.arange(n) % 190, codes[:-2] * 16 + codes[1:-1] * 4 + codes[2:]).astype(np.uint8)
    equal = np.zeros(n, dtype=np.uint8 if widest < 256 else np.int32)
    out = np.zeros(n, dtype=bool)
    low = 1
    for last, upto in ((few, 2 * few + 1), (2 * few + 1, 5 * few), (5 * few, widest)):
        upto = min(upto, widest, n)
        for d in range(low, upto):
            equal[d:] += (t[d:] == t[:-d]).view(np.uint8)
        low = max(low, upto)
        if upto > last:
            sums = np.concatenate([[0], np.cumsum(equal, dtype=np.int64)])
            out[last - 1 :] |= sums[last:] - sums[:-last] > limit * last
    return np.flatnonzero(out)


def dust_batch(texts: list[str | None], window: int = DUST_WINDOW, threshold: int = DUST_THRESHOLD) -> list[list[tuple[int, int]]]:
    """Of each text the masked half-open intervals, merged where they touch; characters other than ACGT break a text. Null: none."""
    data = [(t or "").encode("ascii", "replace") for t in texts]
    begin = np.concatenate([[0], np.cumsum([len(b) + 1 for b in data])]).astype(np.int64)
    codes = _CODE[np.frombuffer(b"\n".join(data) + b"\n\n\n", dtype=np.uint8)]
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    some = np.unique(np.searchsorted(begin, _suspects(codes, window - 2, threshold / 10), "right") - 1)
    some = some[some < len(data)]
    if not len(some):
        return out
    data = [data[i] for i in some.tolist()]
    begin = np.concatenate([[0], np.cumsum([len(b) + 1 for b in data])]).astype(np.int64)
    start, end = _perfect(_CODE[np.frombuffer(b"\n".join(data) + b"\n\n\n", dtype=np.uint8)], window - 2, threshold / 10)
    if not len(start):
        return out
    # merged as arrays: a text of few letters has thousands of perfect intervals
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    # stretches that a break parts never touch: the break lies between them
    first = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
    start, end = start[first], end[np.append(first[1:], len(end)) - 1]
    of = np.searchsorted(begin, start, "right") - 1
    for r, a, b in zip(some[of].tolist(), (start - begin[of]).tolist(), (end - begin[of]).tolist(), strict=True):
        out[r].append((a, b))
    return out


def dust_intervals(text: str | None) -> list[tuple[int, int]]:
    """dust_batch of one text."""
    return dust_batch([text])[0]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def dust_udf(text: pd.Series) -> pd.Series:
    """dust_batch over a column."""
    out = []
    for i in range(0, len(text), 2000):
        out += [[{"start": a, "end": b} for a, b in x] for x in dust_batch(list(text.iloc[i : i + 2000]))]
    return pd.Series(out)
