"""Scalars of the sampling design and the finite-population estimates, and their text forms."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.constants import FAMILY_MISS, PRECISIONS


def least_fraction(precision: str) -> float:
    """The least relative abundance of a precision, any case."""
    return 1.0 / PRECISIONS[precision.strip().lower()]


def sample_capacity(groups: int, precision: str, family_miss: float = FAMILY_MISS) -> int:
    """Draws after which each of `groups` groups of the least abundance is missed with a chance below its share of family_miss.

    Rounded to the safe side; no groups is an error.
    """
    if groups < 1:
        raise ValueError("a sample capacity needs at least one group")
    miss = math.nextafter(family_miss / groups, 0.0)
    delta = math.nextafter(least_fraction(precision), 0.0)
    n = math.ceil(math.log(miss) / math.log1p(-delta))
    while math.nextafter(math.exp(n * math.log1p(-delta)), math.inf) > miss:
        n += 1
    return n


def tail_reaches(population: int, marked: int, sample: int, seen: int, upper: bool, threshold: float, inclusive: bool) -> bool:
    """Whether P(X >= seen) (upper) or P(X <= seen) of the hypergeometric X exceeds (inclusive: reaches) the threshold.

    Terms are relative to the mode's and found by the ratio of neighbours, so nothing overflows or cancels.
    """
    least, most = max(0, sample - (population - marked)), min(sample, marked)
    mode = min(max((sample + 1) * (marked + 1) // (population + 2), least), most)
    inside, outside = [], []

    def add(x: int, w: float) -> None:
        (inside if (x >= seen if upper else x <= seen) else outside).append(w)

    add(mode, 1.0)
    for step in (1, -1):
        x, w = mode, 1.0
        while least <= x + step <= most:
            if step > 0:
                w *= (marked - x) / (x + 1) * (sample - x) / (population - marked - sample + x + 1)
            else:
                w *= x / (marked - x + 1) * (population - marked - sample + x) / (sample - x + 1)
            x += step
            add(x, w)
            if w < 1e-18:
                break
    part, rest = math.fsum(inside), math.fsum(outside)
    bound = threshold * (part + rest)
    return part >= bound if inclusive else part > bound


def population_interval(population: int, sample: int, seen: int, alpha: float) -> tuple[int, int]:
    """The exact equal-tailed interval for the number of marked fragments in the population.

    A census gives (seen, seen). Impossible counts and an alpha outside (0, 1) are errors.
    """
    if not (0 <= seen <= sample <= population and sample > 0 and 0 < alpha < 1):
        raise ValueError("not a sample of this population")
    if sample == population:
        return seen, seen
    least, most = seen, population - (sample - seen)
    lower = least
    if seen:
        lo, hi = least, most  # the first M whose upper tail exceeds alpha / 2
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if tail_reaches(population, mid, sample, seen, True, alpha / 2, False) else (mid + 1, hi)
        lower = max(least, lo - 1)
    else:
        lower = 0
    if seen == sample:
        return lower, population
    lo, hi = least, most  # the last M whose lower tail reaches alpha / 2
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if tail_reaches(population, mid, sample, seen, False, alpha / 2, True) else (lo, mid - 1)
    return lower, min(most, lo + 1)


@F.pandas_udf(T.StructType([T.StructField("lower_count", T.LongType()), T.StructField("upper_count", T.LongType())]))
def interval_udf(population: pd.Series, sample: pd.Series, seen: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    """population_interval over columns; null where an argument is null. Impossible counts end the query with an error."""
    out = []
    for args in zip(population, sample, seen, alpha, strict=True):
        out.append((None, None) if any(pd.isna(x) for x in args) else population_interval(*map(int, args[:3]), float(args[3])))
    return pd.DataFrame(out, columns=["lower_count", "upper_count"]).astype("Int64")


def decimal_text(x: float, places: int = 6) -> str:
    """Fixed decimals, half-even on the exact binary value, without trailing zeros and a trailing dot."""
    out = f"{x:.{places}f}"
    return out.rstrip("0").rstrip(".") if "." in out else out


def outward_percent(fraction: float, upper: bool) -> str:
    """A fraction as a percentage of at most ten decimals, rounded away from the interval's inside."""
    v = fraction * 1e12
    v = math.ceil(math.nextafter(v, math.inf)) if upper else math.floor(math.nextafter(v, -math.inf))
    return decimal_text(min(max(v, 0), 10**12) / 1e10, 10)


@F.pandas_udf(T.StringType())
def decimal_text_udf(x: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else decimal_text(v, int(p)) for v, p in zip(x, places, strict=True)])


def shortest_text(x: float) -> str:
    """The shortest decimals that read back as x, never with an exponent."""
    return np.format_float_positional(x, trim="-")


@F.pandas_udf(T.StringType())
def shortest_text_udf(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else shortest_text(v) for v in x])


@F.pandas_udf(T.StringType())
def outward_lower_udf(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else outward_percent(v, False) for v in x])


@F.pandas_udf(T.StringType())
def outward_upper_udf(x: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else outward_percent(v, True) for v in x])


def library_fraction(support: Column, selected: Column, population: Column, total: Column) -> Column:
    """p = (x / n) * P / N, in this order; null where n or N is 0."""
    return F.when((selected > 0) & (total > 0), support / selected * population / total)


def target_score(p: Column, delta: Column) -> Column:
    """(p - delta) / (p + delta)."""
    return (p - delta) / (p + delta)
