"""From hits to evidence: which group, if any, a fragment supports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_hits(hits: DataFrame) -> DataFrame:
    """hits with a query length above 0, role HOST, or TARGET with a group; `ratio` is score / length.

    A missing score counts as 0, a negative one too. The quotient of two integers below 2**26 is exact enough that
    ratios are equal as doubles only if they are equal. Rows with a null ordinal or mate are left out.
    """
    role = F.upper("role")
    score = F.greatest(F.coalesce("alignment_score", F.lit(0)), F.lit(0))
    rows = hits.withColumn("role", role).filter((F.col("query_length") > 0) & F.col("ordinal").isNotNull() & F.col("mate").isNotNull())
    rows = rows.filter((F.col("role") == "HOST") | ((F.col("role") == "TARGET") & F.col("target_group_ordinal").isNotNull()))
    return rows.withColumns({"alignment_score": score, "ratio": score / F.col("query_length"), "supplementary": F.coalesce("supplementary", F.lit(False))})


def best_hits(hits: DataFrame) -> DataFrame:
    """(ordinal, mate, hits, best_host, best_target, confounded) and the extreme places of host hits: one row an end.

    confounded: the end has a target hit, and a host hit that is as good or better.
    """
    host, target = F.col("role") == "HOST", F.col("role") == "TARGET"
    ends = usable_hits(hits).groupBy("ordinal", "mate").agg(
        F.count(F.lit(1)).alias("hits"),
        F.max(F.when(host, F.col("ratio"))).alias("best_host"),
        F.max(F.when(target, F.col("ratio"))).alias("best_target"),
        F.max(F.when(host, F.col("query_start"))).alias("host_from"),
        F.min(F.when(host, F.col("query_end"))).alias("host_to"),
        F.max(F.when(host & F.col("supplementary"), F.col("query_start"))).alias("extra_from"),
        F.min(F.when(host & F.col("supplementary"), F.col("query_end"))).alias("extra_to"),
    )
    return ends.withColumn("confounded", F.coalesce(F.col("best_host") >= F.col("best_target"), F.lit(False)))


def tied_groups(hits: DataFrame, ends: DataFrame) -> DataFrame:
    """(ordinal, mate, target_group_ordinal, split): the groups whose hits reach an end's best target hit.

    split: some target hit of the group and some host hit lie on disjoint parts of the read, one of them being
    supplementary. Whether such a host hit exists shows in the extremes of host places, so no pairs are formed.
    """
    t = usable_hits(hits).filter("role = 'TARGET'").join(ends, ["ordinal", "mate"])
    apart = lambda lo, hi: F.coalesce((F.col(lo) >= F.col("query_end")) | (F.col(hi) <= F.col("query_start")), F.lit(False))
    split = F.when(F.col("supplementary"), apart("host_from", "host_to")).otherwise(apart("extra_from", "extra_to"))
    groups = t.groupBy("ordinal", "mate", "target_group_ordinal").agg(F.bool_or(F.col("ratio") == F.col("best_target")).alias("tied"), F.bool_or(split).alias("split"))
    return groups.filter("tied").drop("tied")


def fragment_evidence(hits: DataFrame) -> DataFrame:
    """(ordinal, kind, groups, aligned, split_groups, discordant_groups) of each fragment with a usable hit.

    kind is NoTargetEvidence; Confounded if any end is, with all groups; else, of the groups that every end with
    targets has, one: Supporting, several: Unresolved; none: Unresolved with all groups. Lists are sorted.
    """
    ends = best_hits(hits)
    per_end = ends.groupBy("ordinal").agg(
        F.count(F.col("best_target")).alias("target_ends"),
        F.bool_or("confounded").alias("confounded"),
        F.bool_or(F.col("best_target").isNull() & F.col("best_host").isNotNull()).alias("host_only"),
    )
    groups = tied_groups(hits, ends).groupBy("ordinal", "target_group_ordinal").agg(F.count(F.lit(1)).alias("in_ends"), F.bool_or("split").alias("split"))
    g = groups.groupBy("ordinal").agg(
        F.sort_array(F.collect_list(F.struct("target_group_ordinal", "in_ends"))).alias("all"),
        F.sort_array(F.collect_list(F.when(F.col("split"), F.col("target_group_ordinal")))).alias("split_groups"),
    )
    rows = per_end.join(g, "ordinal", "left")
    every = F.transform("all", lambda x: x.target_group_ordinal)
    common = F.transform(F.filter("all", lambda x: x.in_ends == F.col("target_ends")), lambda x: x.target_group_ordinal)
    rows = rows.select("*", every.alias("every"), common.alias("common"))
    none = F.array().cast("array<int>")
    kind = F.when(F.col("target_ends") == 0, "NoTargetEvidence").when(F.col("confounded"), "Confounded").when(F.size("common") == 1, "Supporting").otherwise("Unresolved")
    rows = rows.withColumn("kind", kind)
    chosen = F.when(F.col("kind") == "NoTargetEvidence", none).when((F.col("kind") == "Confounded") | (F.size("common") == 0), F.col("every")).otherwise(F.col("common"))
    lone = (F.col("kind") == "Supporting") & (F.col("target_ends") == 1) & F.col("host_only")
    return rows.select("ordinal", "kind", chosen.alias("groups"), F.lit(True).alias("aligned"), F.coalesce("split_groups", none).alias("split_groups"), F.when(lone, F.col("common")).otherwise(none).alias("discordant_groups"))


def supporting_intervals(hits: DataFrame, evidence: DataFrame, groups: DataFrame) -> DataFrame:
    """(ordinal, group_ordinal, start, end): target places of the tied-best hits of fragments that support the group.

    Clipped to the reference length of groups (group_ordinal, representative_length) where that is known; empty ones are left out.
    """
    own = evidence.filter("kind = 'Supporting'").select("ordinal", F.col("groups")[0].alias("target_group_ordinal"))
    t = usable_hits(hits).filter("role = 'TARGET'").join(own, ["ordinal", "target_group_ordinal"]).join(best_hits(hits).select("ordinal", "mate", "best_target"), ["ordinal", "mate"]).filter("ratio = best_target")
    t = t.join(groups.select(F.col("group_ordinal").alias("target_group_ordinal"), "representative_length"), "target_group_ordinal", "left")
    start, end = F.least("target_start", "target_end"), F.greatest("target_start", "target_end")
    rows = t.select("ordinal", F.col("target_group_ordinal").alias("group_ordinal"), start.alias("start"), F.least(end, "representative_length").alias("end"))
    return rows.filter("start < end")
