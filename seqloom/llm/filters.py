"""A filter of bounded size over 64-bit hashes: no hash that was put in is ever ruled out."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter, 32 MB; one that is too small for what is put in lets more through, never less.
MOST_BITS = 28


def filter_words(hashes: DataFrame, rows: int) -> tuple[int, np.ndarray]:
    """Bits (a power of two, as its exponent) and words of the filter of hashes (h), of which there are `rows`; or-ed together by aggregation."""
    bits = min(MOST_BITS, max(6, (16 * max(1, rows) - 1).bit_length()))
    places = F.array(F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned(F.shiftleft("h", bits), 64 - bits))
    found = hashes.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("value")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    out[found.column("word").to_numpy()] = found.column("value").to_numpy()
    return bits, out


def may_hold(bits: int, words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each of the hashes (unsigned) may have been put in."""
    mask, out = words.view(np.uint64), np.ones(len(h), dtype=bool)
    for p in (h >> np.uint64(64 - bits), (h << np.uint64(bits)) >> np.uint64(64 - bits)):
        out &= (mask[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out
