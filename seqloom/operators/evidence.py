"""Aggregation of fragment evidence by group: counters, covered stretches, occupied windows, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.constants import OCCUPANCY_WINDOWS


def run_counters(evidence: DataFrame, by: list[str]) -> DataFrame:
    """(by, aligned_fragments, unassigned_fragments): unassigned are aligned fragments that support no group."""
    return evidence.groupBy(*by).agg(F.count_if("aligned").alias("aligned_fragments"), F.count_if(F.col("aligned") & (F.col("kind") != "Supporting")).alias("unassigned_fragments"))


def group_counters(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Counts by group: supporting_selected_fragments, cross_group_ambiguous_fragments, host_confounded_fragments, split_events, discordant_fragments.

    A fragment counts for each of its groups; partial counts are combined before the shuffle, so a group that a third
    of all fragments support is no hot spot.
    """
    rows = evidence.select(*by, "kind", F.explode("groups").alias("group_ordinal"), "split_groups", "discordant_groups")
    supports = F.col("kind") == "Supporting"
    return rows.groupBy(*by, "group_ordinal").agg(
        F.count_if(supports).alias("supporting_selected_fragments"),
        F.count_if(F.col("kind") == "Unresolved").alias("cross_group_ambiguous_fragments"),
        F.count_if(F.col("kind") == "Confounded").alias("host_confounded_fragments"),
        F.count_if(supports & F.array_contains("split_groups", F.col("group_ordinal"))).alias("split_events"),
        F.count_if(supports & F.array_contains("discordant_groups", F.col("group_ordinal"))).alias("discordant_fragments"),
    )


def coverage_union(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, end): disjoint merged stretches of intervals (by, start, end); touching ones are one.

    A reference has few distinct intervals against its hits; equal ones are counted once before they are ordered, so a
    group that holds a third of all hits sorts no more rows than its reference has distinct intervals.
    """
    once = intervals.select(*by, "start", "end").distinct()
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = once.withColumn("_new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def occupied_windows(merged: DataFrame, groups: DataFrame, by: list[str], windows: int = OCCUPANCY_WINDOWS) -> DataFrame:
    """(by, occupied_windows): how many of the equal windows of the reference the merged stretches touch.

    References of unknown or no length have none.
    """
    rows = merged.join(groups.select("group_ordinal", "representative_length"), "group_ordinal").filter("representative_length > 0")
    first = F.expr(f"cast(start * {windows} div representative_length as int)")
    last = F.least(F.expr(f"cast((end - 1) * {windows} div representative_length as int)"), F.lit(windows - 1))
    rows = rows.select(*by, first.alias("first"), last.alias("last")).filter("first <= last")
    return rows.select(*by, F.explode(F.sequence("first", "last")).alias("w")).groupBy(*by).agg(F.count_distinct("w").alias("occupied_windows"))


def group_evidence(evidence: DataFrame, intervals: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """The counters of each observed group with covered_bases and occupied_windows; by is e.g. ["run_id"]."""
    keys = [*by, "group_ordinal"]
    merged = coverage_union(intervals, keys)
    bases = merged.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias("covered_bases"))
    spread = occupied_windows(merged, groups, keys)
    rows = group_counters(evidence, by).join(bases, keys, "left").join(spread, keys, "left")
    return rows.fillna(0, ["covered_bases", "occupied_windows"])


def labelled(counted: DataFrame, groups: DataFrame) -> DataFrame:
    """counted with evidence_status, attribution_status and integration_status; groups gives the number of members."""
    n = groups.select("group_ordinal", F.size("member_ids").alias("_members"))
    some = F.col("supporting_selected_fragments") > 0
    rows = counted.join(n, "group_ordinal", "left")
    attribution = F.when(some & (F.col("_members") == 1), "RESOLVED_TO_REFERENCE_GROUP").when(some, "AMBIGUOUS_WITHIN_GROUP").when(F.col("cross_group_ambiguous_fragments") > 0, "UNRESOLVED_ACROSS_GROUPS").otherwise("CONFOUNDED_WITH_HOST")
    return rows.withColumns({
        "evidence_status": F.when(some, "REFERENCE_SIGNAL_OBSERVED").otherwise("INDETERMINATE_EVIDENCE"),
        "attribution_status": attribution,
        "integration_status": F.when(some & ((F.col("split_events") > 0) | (F.col("discordant_fragments") > 0)), "DIAGNOSTIC_EVIDENCE_OBSERVED").otherwise("NOT_OBSERVED"),
    }).drop("_members")


def ranked(counted: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Supported groups with support_rank (support down, then representative id), share of all support and totals, per run.

    A run's ranking is as long as the panel, not as its reads.
    """
    rows = counted.filter("supporting_selected_fragments > 0").join(groups.select("group_ordinal", "representative_id", "representative_length"), "group_ordinal")
    order = Window.partitionBy(*by).orderBy(F.desc("supporting_selected_fragments"), "representative_id", "group_ordinal")
    every = Window.partitionBy(*by)
    total = F.sum("supporting_selected_fragments").over(every)
    return rows.withColumns({
        "support_rank": F.row_number().over(order),
        "total_target_support_fragments": total,
        "supported_reference_groups": F.count(F.lit(1)).over(every),
        "target_support_share_pct": F.col("supporting_selected_fragments") * F.lit(100.0) / total,
    })
