"""The whole analysis of reads against a panel, per run: gate, sample, align, adjudicate, aggregate, estimate, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import checkpointed, materialized
from seqloom.constants import FAMILY_INTERVAL, PRECISIONS
from seqloom.functions.stats import interval_udf, library_fraction, target_score
from seqloom.operators import adjudicate, evidence, gate, grouping, sampling
from seqloom.operators.align import align


def delta_of(precision: str) -> F.Column:
    """The least relative abundance of a precision column, any case; null for an unknown one."""
    out = F.lit(None).cast("double")
    for name, parts in PRECISIONS.items():
        out = F.when(F.lower(precision) == name, F.lit(1.0) / parts).otherwise(out)
    return out


def estimates(counted: DataFrame, scalars: DataFrame, groups: DataFrame) -> DataFrame:
    """Ranked supported groups of each run with fraction, estimated_fragments, sampling_target_score and the exact interval.

    counted: group_evidence by run_id; scalars: design_scalars. The interval's error is shared by all groups of the panel.
    """
    many = groups.count()
    rows = evidence.ranked(counted, groups, ["run_id"]).join(groups.select("group_ordinal", "target_group_id", "member_ids", "representative_description"), "group_ordinal").join(scalars, "run_id")
    p = library_fraction(F.col("supporting_selected_fragments"), F.col("selected"), F.col("population"), F.col("input_fragments"))
    rows = rows.withColumn("fraction", p).withColumn("estimated_fragments", F.col("fraction") * F.col("input_fragments"))
    rows = rows.withColumn("sampling_target_score", target_score(F.col("fraction"), delta_of("precision")))
    alpha = FAMILY_INTERVAL / max(1, many)
    bounds = interval_udf("population", "selected", "supporting_selected_fragments", F.lit(alpha))
    rows = evidence.labelled(rows, groups).withColumn("interval_level", F.lit(1.0 - alpha))
    return rows.withColumn("_b", bounds).select("*", "_b.*").drop("_b")


def analyse(fasta: DataFrame, fragments: DataFrame, design: DataFrame, mode: str | None = None, masked: bool = True) -> DataFrame:
    """estimates() of every run of `design` from records and reads; mode screen or full for all, or null for each run's own."""
    records = grouping.panel_records(fasta)
    groups = checkpointed(grouping.reference_groups(records.filter("not is_host")))
    contigs = checkpointed(grouping.contigs(records, groups))
    return analyse_indexed(groups, contigs, records, fragments, design, mode, masked)[0]


def analyse_indexed(
    groups: DataFrame, contigs: DataFrame, kmers: DataFrame, fragments: DataFrame, design: DataFrame, mode: str | None = None, masked: bool = True,
    index: str = "", seeds: DataFrame | None = None, words: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The same from an index's tables; and the runs' figures (design_scalars with passed, aligned_fragments and input_mode).

    index: the digest of profile and index, which goes into the sampling keys. seeds and words: the contigs' seeds and the
    gate's filter, where the index has them stored.

    screen samples and then gates, full gates and then samples: the two differ in what the sample stands for. So the gate
    sees the sample alone in screen mode and all fragments of a run in full mode; passed and not_evaluable count over these.
    """
    reads = checkpointed(sampling.keyed_reads(fragments, index))
    keyed = reads.select("ordinal", "run_id", "id", "key")
    design = design.withColumn("mode", F.lower(F.lit(mode) if mode else F.col("mode")))
    by_full = design.filter("mode = 'full' and run_id is not null").select("run_id").distinct()
    screened = sampling.bottom_k_by_run(keyed, design.filter("mode = 'screen'")).select("ordinal", "run_id")
    screened = checkpointed(screened.join(by_full, "run_id", "left_anti"))
    gated = reads.join(screened.select("ordinal"), "ordinal", "left_semi").unionByName(reads.join(by_full, "run_id", "left_semi").select(reads.columns))
    verdicts = checkpointed(gate.gate(gated, kmers, masked, words))
    passing = keyed.join(verdicts.filter("verdict = 'Pass'").select("ordinal"), "ordinal", "left_semi")
    drawn = sampling.bottom_k_by_run(passing, design.filter("mode = 'full'"))
    sampled = screened.select("ordinal").unionByName(drawn.select("ordinal"))
    sampled = sampled.join(verdicts.filter("verdict = 'Pass'").select("ordinal"), "ordinal", "left_semi")
    selected = checkpointed(reads.join(sampled, "ordinal", "left_semi"))
    hits = checkpointed(align(gate.read_ends(selected), contigs, seeds=seeds))
    kinds = reads.groupBy("run_id").agg(F.when(F.count("r2") == 0, "SE").when(F.count("r2") == F.count(F.lit(1)), "PE").otherwise("MIXED").alias("input_mode"))
    passed = verdicts.join(keyed.select("ordinal", "run_id"), "ordinal").groupBy("run_id").agg(F.count_if(F.col("verdict") == "Pass").alias("passed"), F.count_if(F.col("verdict") == "NotEvaluable").alias("not_evaluable"))
    found = evidence.run_counters(adjudicate.fragment_evidence(hits).join(reads.select("ordinal", "run_id"), "ordinal"), ["run_id"])
    scalars = sampling.design_scalars(design, keyed, verdicts).join(kinds, "run_id", "left").join(passed, "run_id", "left").join(found, "run_id", "left")
    scalars = checkpointed(scalars.fillna(0, ["passed", "not_evaluable", "aligned_fragments", "unassigned_fragments"]))
    return estimates(evidence_by_run(hits, reads, groups), scalars, groups), scalars


def drawn(keyed: DataFrame, design: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(ordinal): the fragments that pass of each run's sample, drawn in the run's own mode; verdicts are of all fragments."""
    design = design.withColumn("mode", F.lower("mode"))
    screened = sampling.screen(keyed, design.filter("mode = 'screen'"), verdicts).filter("verdict = 'Pass'")
    return screened.select("ordinal").unionByName(sampling.full(keyed, design.filter("mode = 'full'"), verdicts).select("ordinal"))


def evidence_by_run(hits: DataFrame, fragments: DataFrame, groups: DataFrame) -> DataFrame:
    """group_evidence of hits by the run of their fragment."""
    run = fragments.filter("ordinal is not null").groupBy("ordinal").agg(F.min("run_id").alias("run_id"))
    found = checkpointed(adjudicate.fragment_evidence(hits).join(run, "ordinal"))
    intervals = materialized(adjudicate.supporting_intervals(hits, found, groups).join(run, "ordinal"))
    return evidence.group_evidence(found, intervals, groups, ["run_id"])
