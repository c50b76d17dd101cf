"""The engine's functions under names that SQL can call.

What built-ins express is registered as a SQL function, which Catalyst inlines; the rest as pandas functions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.constants import ALPHABET, COMPLEMENT, FORWARD_CODE, REVERSE_CODE
from seqloom.functions.dust import dust_udf
from seqloom.functions.stats import interval_udf, outward_lower_udf, outward_upper_udf, sample_capacity


def _code(text: str) -> str:
    return f"least(translate({text}, '{ALPHABET}', '{FORWARD_CODE}'), translate(reverse({text}), '{ALPHABET}', '{REVERSE_CODE}'))"


@F.pandas_udf(T.LongType())
def _capacity(groups: pd.Series, precision: pd.Series) -> pd.Series:
    """sample_capacity over columns; null for nulls, no groups and unknown precisions."""
    out = []
    for g, p in zip(groups, precision, strict=True):
        try:
            out.append(sample_capacity(int(g), p))
        except (ValueError, TypeError, KeyError, AttributeError):
            out.append(None)
    return pd.Series(out, dtype="Int64")


def register_functions(spark: SparkSession) -> None:
    """Register, for this session:

    revcomp(text), canonical_kmer(text): of letters in any case. kmers(text, k): array of (pos, kmer), canonical, without
    those that hold another character than IUPAC letters; texts shorter than k have none. dust_intervals(text): array of
    (start, end). hypergeom_interval(population, sample, seen, alpha): (lower_count, upper_count).
    sample_capacity(groups, precision). outward_pct_lower(fraction), outward_pct_upper(fraction). Nulls give nulls, but
    dust_intervals(null) is an empty array.
    """
    word = "substr(upper(text), p + 1, k)"
    each = f"transform(sequence(0, length(text) - k), p -> named_struct('pos', p, 'word', {word}))"
    good = f"filter({each}, x -> x.word rlike '^[{ALPHABET}]+$')"
    for signature, body in (
        ("revcomp(text STRING) RETURNS STRING", f"translate(reverse(upper(text)), '{ALPHABET}', '{COMPLEMENT}')"),
        ("canonical_kmer(text STRING) RETURNS STRING", _code("upper(text)")),
        ("kmers(text STRING, k INT) RETURNS ARRAY<STRUCT<pos: INT, kmer: STRING>>", f"CASE WHEN length(text) >= k THEN transform({good}, x -> named_struct('pos', x.pos, 'kmer', {_code('x.word')})) WHEN text IS NOT NULL THEN array() END"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    for name, f in (("dust_intervals", dust_udf), ("hypergeom_interval", interval_udf), ("sample_capacity", _capacity), ("outward_pct_lower", outward_lower_udf), ("outward_pct_upper", outward_upper_udf)):
        spark.udf.register(name, f)
