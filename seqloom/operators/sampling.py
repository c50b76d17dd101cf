"""Bottom-k samples: priority keys, the two modes, and the scalars of the design."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.common import bottom_k_per_group
from seqloom.constants import PRECISIONS
from seqloom.functions.seq import normalized_read_id

DOMAIN = "seqloom-fragment-v1"


def priority_key(fragment_id: Column | str, ordinal: Column | str, index: str = "") -> Column:
    """32 hex digits: the first half of SHA-256 over the domain, the index, the normalised id and the ordinal, each framed.

    A null id counts as empty. The digest is Spark's own; see the README for how this differs from the reference's hash.
    """
    name = F.coalesce(normalized_read_id(fragment_id), F.lit(""))
    text = F.concat_ws("|", F.lit(DOMAIN), F.lit(index), F.length(name).cast("string"), name, F.col(ordinal) if isinstance(ordinal, str) else ordinal)
    return F.substring(F.sha2(text, 256), 1, 32)


def keyed(fragments: DataFrame, index: str = "") -> DataFrame:
    """(ordinal, run_id, id, key): each fragment once, under its smallest normalised id; index as in priority_key."""
    rows = fragments.filter("ordinal is not null").groupBy("ordinal").agg(F.min("run_id").alias("run_id"), F.min(F.coalesce(normalized_read_id("id"), F.lit(""))).alias("id"))
    return rows.withColumn("key", priority_key("id", "ordinal", index))


def keyed_reads(fragments: DataFrame, index: str = "") -> DataFrame:
    """(ordinal, run_id, r1, r2, id, key): keyed() and the fragment's reads, in one shuffle."""
    once = [F.min("run_id").alias("run_id"), F.min("r1").alias("r1"), F.min("r2").alias("r2"), F.min(F.coalesce(normalized_read_id("id"), F.lit(""))).alias("id")]
    return fragments.filter("ordinal is not null").groupBy("ordinal").agg(*once).withColumn("key", priority_key("id", "ordinal", index))


def bottom_k(rows: DataFrame, k: int, key: str = "key", tie: str = "ordinal") -> DataFrame:
    """The k rows of the smallest (key, tie); all of them if there are fewer. No row passes through the driver.

    bottom_k of a union is bottom_k of the parts' bottom_k, so pieces can be sampled one by one.
    """
    rows = rows.withColumns({"_all": F.lit(0), "_k": F.lit(k)})
    return bottom_k_per_group(rows, ["_all"], key, tie, "_k").drop("_all", "_k")


def bottom_k_by_run(rows: DataFrame, design: DataFrame) -> DataFrame:
    """For each run of design (run_id, capacity) its bottom-k rows. Runs that aren't listed give none."""
    design = design.filter("run_id is not null").groupBy("run_id").agg(F.max("capacity").alias("_k"))
    return bottom_k_per_group(rows.join(design, "run_id"), ["run_id"], "key", "ordinal", "_k").drop("_k")


def screen(rows: DataFrame, design: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Sample, then gate: the sampled rows with their verdict."""
    return bottom_k_by_run(rows, design).join(verdicts, "ordinal")


def full(rows: DataFrame, design: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Gate, then sample: only passing rows compete for the sample's places."""
    return bottom_k_by_run(rows.join(verdicts.filter("verdict = 'Pass'").select("ordinal"), "ordinal", "left_semi"), design).withColumn("verdict", F.lit("Pass"))


def design_scalars(design: DataFrame, rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(run_id, mode, precision, input_fragments, population, selected, selection_probability, expected_support) of each run.

    The population is counted, never taken from what a run declared: all its fragments in screen mode, those that pass
    in full mode; runs in screen mode need no verdicts. selection_probability is 0 for an empty population; expected_support is null then. An unknown
    precision has no expected support either.
    """
    per = rows.select("ordinal", "run_id").join(verdicts, "ordinal", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "Pass").alias("passed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    d = design.select("run_id", F.lower("mode").alias("mode"), F.lower("precision").alias("precision"), "capacity").join(per, "run_id", "left")
    d = d.withColumn("input_fragments", zero("n")).withColumn("population", F.when(F.col("mode") == "full", zero("passed")).otherwise(zero("n")))
    d = d.withColumn("selected", F.least("population", "capacity"))
    d = d.withColumn("selection_probability", F.when(F.col("population") > 0, F.col("selected") / F.col("population")).otherwise(F.lit(0.0)))
    delta = F.lit(None).cast("double")
    for name, parts in PRECISIONS.items():
        delta = F.when(F.col("precision") == name, F.lit(1.0) / parts).otherwise(delta)
    expected = F.when(F.col("selected") > 0, F.col("selected") * delta * F.col("input_fragments") / F.col("population"))
    return d.select("run_id", "mode", "precision", "input_fragments", "population", "selected", "selection_probability", expected.alias("expected_support"))
