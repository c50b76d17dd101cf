"""Queries of the analysis operators: name -> (spark, sf_dir) -> DataFrame, all over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import checkpointed, ensure_checkpoint_dir, materialized, spread, table
from seqloom.constants import MATCH, MIN_COVERED, TOP_ROWS
from seqloom.functions import seq
from seqloom.functions.dust import dust_udf
from seqloom.operators import adjudicate, align, evidence, gate, grouping, rank, sampling
from seqloom.plans import run
from seqloom.sources import fasta as fasta_source
from seqloom.sources import fastq as fastq_source
from seqloom.sources import index as index_source
from seqloom.sources import report
from seqloom.streaming import sample as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Fragments of the one sample over all runs.
BOTTOM_K = 2048


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _records(spark: SparkSession, d: str) -> DataFrame:
    return grouping.panel_records(table(spark, d, "fasta"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return grouping.reference_groups(_records(spark, d).filter("not is_host"))


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return gate.fragments_once(table(spark, d, "fragments"))


def _scratch(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


# ---- k-mers and the gate


@query
def kmer_canonical(spark: SparkSession, d: str) -> DataFrame:
    return seq.with_kmers(spread(_records(spark, d), "sequence"), ["rec_ordinal"], "sequence")


@query
def target_kmer_set(spark: SparkSession, d: str) -> DataFrame:
    return gate.target_kmers(_records(spark, d))


@query
def kmer_semi_join(spark: SparkSession, d: str) -> DataFrame:
    return gate.kmer_hits(gate.read_ends(_fragments(spark, d)), _records(spark, d))


@query
def panel_hit_rank(spark: SparkSession, d: str) -> DataFrame:
    """Panel records ranked by the fragments that share a k-mer with them."""
    records = _records(spark, d).filter("not is_host").select("rec_ordinal", "id", "sequence")
    keys = materialized(grouping.dense_ordinals(records.select("rec_ordinal", "id").distinct(), ["rec_ordinal", "id"], "number"))
    same = records["rec_ordinal"].eqNullSafe(keys["rec_ordinal"]) & (records["id"] == keys["id"])
    found = rank.shared(records.join(keys, same).select("number", "sequence"), _fragments(spark, d))
    hits = found.join(keys, "number").select("rec_ordinal", "id", "fragments", "kmer_hits")
    down = hits.withColumns({"_f": -F.col("fragments"), "_k": -F.col("kmer_hits")})
    rows = grouping.dense_ordinals(down, ["_f", "_k", "id", "rec_ordinal"], "n")
    return rows.select(*hits.columns, (F.col("n") + 1).cast("int").alias("place"))


@query
def bloom_summary(spark: SparkSession, d: str) -> DataFrame:
    return gate.bloom_summary(gate.panel_kmers(_records(spark, d)))


@query
def bloom_size(spark: SparkSession, d: str) -> DataFrame:
    """How many k-mers the filter holds, and its bits: what bloom_summary has besides the bits set."""
    return bloom_summary(spark, d).select("inserted", "bits")


@query
def bloom_probe(spark: SparkSession, d: str) -> DataFrame:
    """Fragments with a k-mer that the filter lets pass, and how many of these k-mers are truly in the panel."""
    kmers = materialized(gate.panel_kmers(_records(spark, d)))
    ends = seq.with_kmers(gate.read_ends(_fragments(spark, d)), ["ordinal"], "sequence", only=gate.bloom_test(kmers)).select("ordinal", "kmer")
    rows = ends.join(kmers.select("kmer", F.lit(1).alias("held")), "kmer", "left")
    return rows.groupBy("ordinal").agg(F.count(F.lit(1)).alias("passed"), F.count("held").alias("held"))


@query
def bloom_held(spark: SparkSession, d: str) -> DataFrame:
    """bloom_probe's fragments with panel k-mers, and how many: none that the panel holds is lost to the filter."""
    return bloom_probe(spark, d).filter("held > 0").select("ordinal", "held")


@query
def dust_intervals(spark: SparkSession, d: str) -> DataFrame:
    return gate.read_ends(_fragments(spark, d)).select("ordinal", "mate", F.inline(dust_udf("sequence")))


def _states(spark: SparkSession, d: str, masked: bool, fragments: DataFrame | None = None) -> DataFrame:
    ends = gate.read_ends(materialized(_fragments(spark, d)) if fragments is None else fragments)
    return gate.gate_states(ends, gate.hit_runs(ends, _records(spark, d)), masked)


def _gated(spark: SparkSession, d: str, masked: bool, fragments: DataFrame | None = None) -> DataFrame:
    fragments = materialized(_fragments(spark, d)) if fragments is None else fragments
    return gate.gate_verdicts(fragments, _states(spark, d, masked, fragments))


@query
def gate_state_unmasked(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d, False)


@query
def gate_verdict_unmasked(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d, False)


@query
def gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d, True)


@query
def gate_counts(spark: SparkSession, d: str) -> DataFrame:
    fragments = materialized(_fragments(spark, d))
    rows = _gated(spark, d, True, fragments).join(fragments.select("ordinal", "run_id"), "ordinal")
    return rows.groupBy("run_id", "verdict").agg(F.count(F.lit(1)).alias("fragments"))


# ---- panel groups and names


@query
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("rec_ordinal", seq.reverse_complement("sequence").alias("reverse_complement"), F.sha2(seq.canonical_strand("sequence"), 256).alias("digest"))


@query
def reference_groups(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).withColumn("member_ids", F.array_join("member_ids", ";"))


@query
def group_ledger(spark: SparkSession, d: str) -> DataFrame:
    return grouping.group_ledger(_groups(spark, d))


@query
def contig_union(spark: SparkSession, d: str) -> DataFrame:
    return grouping.contigs(_records(spark, d), _groups(spark, d))


@query
def read_id_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fragments").select("ordinal", "piece_no", seq.normalized_read_id("id").alias("read_id"))


@query
def sample_id(spark: SparkSession, d: str) -> DataFrame:
    """Sample names of files that would hold the runs' reads."""
    files = table(spark, d, "fragments").select("run_id", F.when(F.col("r2").isNull(), "_1").otherwise("_R1").alias("end")).distinct()
    return files.select("run_id", "end", seq.sample_id(F.concat(F.lit("reads/"), "run_id", "end", F.lit(".fastq.gz"))).alias("sample_id"))


@query
def duplicate_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that repeat within a source: what a strict reader refuses."""
    return _records(spark, d).groupBy("source", "id").agg(F.count(F.lit(1)).alias("records")).filter("records > 1")


@query
def input_census(spark: SparkSession, d: str) -> DataFrame:
    return _census(_fragments(spark, d))


def _census(fragments: DataFrame) -> DataFrame:
    rows = fragments.groupBy("run_id").agg(F.count(F.lit(1)).alias("fragments"), F.count("r2").alias("paired"))
    return rows.withColumn("input_mode", F.when(F.col("paired") == 0, "SE").when(F.col("paired") == F.col("fragments"), "PE").otherwise("MIXED"))


# ---- sampling


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    return sampling.keyed(table(spark, d, "fragments"))


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    return checkpointed(gate_verdict(spark, d))


@query
def bottom_k_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.bottom_k(_keyed(spark, d), BOTTOM_K)


@query
def screen_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sample, then gate the sample alone."""
    sampled = checkpointed(sampling.bottom_k_by_run(_keyed(spark, d), table(spark, d, "sampling_design")))
    reads = checkpointed(_fragments(spark, d).join(sampled.select("ordinal"), "ordinal", "left_semi"))
    return sampled.join(gate.gate(reads, _records(spark, d)), "ordinal")


@query
def full_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.full(_keyed(spark, d), table(spark, d, "sampling_design"), _verdicts(spark, d))


@query
def mode_containment(spark: SparkSession, d: str) -> DataFrame:
    """Per run: passing fragments of the screen sample, and how many of these the full sample holds: all."""
    keyed, design, verdicts = materialized(_keyed(spark, d)), table(spark, d, "sampling_design"), _verdicts(spark, d)
    screened = sampling.screen(keyed, design, verdicts).filter("verdict = 'Pass'").select("ordinal", "run_id")
    held = sampling.full(keyed, design, verdicts).select("ordinal", F.lit(1).alias("held"))
    return screened.join(held, "ordinal", "left").groupBy("run_id").agg(F.count(F.lit(1)).alias("screen_passed"), F.count("held").alias("in_full"))


@query
def sampling_design(spark: SparkSession, d: str) -> DataFrame:
    return sampling.design_scalars(table(spark, d, "sampling_design"), _keyed(spark, d), _verdicts(spark, d))


# ---- adjudication of the given hits


@query
def usable_hits(spark: SparkSession, d: str) -> DataFrame:
    return adjudicate.usable_hits(table(spark, d, "hits")).select("ordinal", "mate", "role", "target_group_ordinal", "alignment_score", "query_length", "supplementary", "ratio")


@query
def best_hits(spark: SparkSession, d: str) -> DataFrame:
    return adjudicate.best_hits(table(spark, d, "hits")).select("ordinal", "mate", "hits", "best_host", "best_target")


@query
def host_confounding(spark: SparkSession, d: str) -> DataFrame:
    return adjudicate.best_hits(table(spark, d, "hits")).filter("confounded").select("ordinal", "mate")


@query
def split_groups(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "hits")
    return adjudicate.tied_groups(hits, adjudicate.best_hits(hits))


@query
def adjudicated(spark: SparkSession, d: str) -> DataFrame:
    rows = adjudicate.fragment_evidence(table(spark, d, "hits"))
    return rows.select("ordinal", "kind", *[F.array_join(c, ";").alias(c) for c in ("groups", "split_groups", "discordant_groups")])


@query
def discordant(spark: SparkSession, d: str) -> DataFrame:
    rows = adjudicate.fragment_evidence(table(spark, d, "hits"))
    return rows.select("ordinal", F.explode("discordant_groups").alias("group_ordinal"))


# ---- aggregation


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    run_of = _fragments(spark, d).select("ordinal", "run_id")
    return adjudicate.fragment_evidence(table(spark, d, "hits")).join(run_of, "ordinal")


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    hits, groups = table(spark, d, "hits"), table(spark, d, "reference_groups")
    rows = adjudicate.supporting_intervals(hits, adjudicate.fragment_evidence(hits), groups)
    return rows.join(_fragments(spark, d).select("ordinal", "run_id"), "ordinal")


@query
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    return evidence.run_counters(_evidence(spark, d), ["run_id"])


@query
def supporting_intervals(spark: SparkSession, d: str) -> DataFrame:
    return _intervals(spark, d)


@query
def coverage_union(spark: SparkSession, d: str) -> DataFrame:
    return evidence.coverage_union(_intervals(spark, d), ["run_id", "group_ordinal"])


@query
def occupied_windows(spark: SparkSession, d: str) -> DataFrame:
    return evidence.occupied_windows(coverage_union(spark, d), table(spark, d, "reference_groups"), ["run_id", "group_ordinal"])


@query
def group_evidence(spark: SparkSession, d: str) -> DataFrame:
    return run.evidence_by_run(table(spark, d, "hits"), table(spark, d, "fragments"), table(spark, d, "reference_groups"))


@query
def group_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.labelled(group_evidence(spark, d), table(spark, d, "reference_groups"))
    return rows.select("run_id", "group_ordinal", "evidence_status", "attribution_status", "integration_status")


@query
def given_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The given evidence rows, repeated ones once, summed by panel group."""
    rows = table(spark, d, "group_evidence").distinct()
    counts = ("supporting_selected_fragments", "host_confounded_fragments", "cross_group_ambiguous_fragments", "split_events", "discordant_fragments")
    return rows.groupBy("group_ordinal").agg(F.count_distinct("run_id").alias("runs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts])


# ---- estimates and reports


def _estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimates of each run from the given hits of its drawn sample alone, with the run's input_mode.

    Each step is stored: one plan of all would be planned anew on the driver as often as one of its many stages ends.
    """
    fragments, design = materialized(_fragments(spark, d)), table(spark, d, "sampling_design")
    verdicts, keyed = checkpointed(_gated(spark, d, True, fragments)), materialized(_keyed(spark, d))
    scalars = checkpointed(sampling.design_scalars(design, keyed, verdicts).join(_census(fragments).select("run_id", "input_mode"), "run_id", "left"))
    hits = materialized(table(spark, d, "hits").join(checkpointed(run.drawn(keyed, design, verdicts)), "ordinal", "left_semi"))
    groups = table(spark, d, "reference_groups")
    return checkpointed(run.estimates(checkpointed(run.evidence_by_run(hits, fragments, groups)), scalars, groups))


SCORE = ("run_id", "group_ordinal", "fraction", "estimated_fragments", "sampling_target_score")


@query
def abundance_score(spark: SparkSession, d: str) -> DataFrame:
    """As its SQL has it: the given hits of all fragments over the sample's size, so a fraction may exceed 1. For estimates see sampled_abundance_score."""
    scalars = checkpointed(sampling.design_scalars(table(spark, d, "sampling_design"), _keyed(spark, d), _verdicts(spark, d)))
    return run.estimates(group_evidence(spark, d), scalars, table(spark, d, "reference_groups")).select(*SCORE)


@query
def sampled_abundance_score(spark: SparkSession, d: str) -> DataFrame:
    return _estimates(spark, d).select(*SCORE)


@query
def interval_report(spark: SparkSession, d: str) -> DataFrame:
    return _estimates(spark, d).select("run_id", "group_ordinal", "population", "selected", "supporting_selected_fragments", "lower_count", "upper_count")


@query
def ranked_report_numeric(spark: SparkSession, d: str) -> DataFrame:
    rows = evidence.ranked(group_evidence(spark, d), table(spark, d, "reference_groups"), ["run_id"])
    return rows.select("run_id", "group_ordinal", "representative_id", "support_rank", "supporting_selected_fragments", "total_target_support_fragments", "supported_reference_groups", "target_support_share_pct")


@query
def top_rows(spark: SparkSession, d: str) -> DataFrame:
    """The short list of each run."""
    return ranked_report_numeric(spark, d).filter(F.col("support_rank") <= TOP_ROWS).select("run_id", "support_rank", "group_ordinal")


@query
def report_text(spark: SparkSession, d: str) -> DataFrame:
    return report.report_rows(_estimates(spark, d))


@query
def report_counts(spark: SparkSession, d: str) -> DataFrame:
    """The report's columns that are counts and names, as numbers."""
    same = ("total_target_support_fragments", "supported_reference_groups", "discordant_fragments", "input_mode", "input_fragments", "occupied_windows", "support_rank", "run_id")
    renamed = {"representative_id": "reference_id", "supporting_selected_fragments": "support_fragments", "covered_bases": "covered_bp", "representative_length": "reference_length_bp", "split_events": "split_support_fragments", "selected": "selected_fragments"}
    return _estimates(spark, d).select(*same, *[F.col(a).alias(b) for a, b in renamed.items()])


# ---- alignment and whole runs


@query
def diagonal_chain(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    contigs = records.select(F.concat(F.lit("rec_"), "rec_ordinal").alias("name"), "sequence")
    return align.diagonal_chains(gate.read_ends(_fragments(spark, d)), contigs)


@query
def seed_table(spark: SparkSession, d: str) -> DataFrame:
    """The aligner's seeds by contig name, spelled out from the segments that an index stores."""
    contigs = align.numbered(checkpointed(grouping.contigs(_records(spark, d), checkpointed(_groups(spark, d)))))
    return align.contig_seeds(contigs).join(contigs.select("cid", "name"), "cid").select("name", "at", "kmer")


@query
def aligned_hits(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d)
    groups = checkpointed(_groups(spark, d))
    return align.align(gate.read_ends(_fragments(spark, d)), checkpointed(grouping.contigs(records, groups)))


@query
def aligned_exact(spark: SparkSession, d: str) -> DataFrame:
    """The aligned hits that match their whole read: what a plain search for the reads' letters finds too."""
    whole = aligned_hits(spark, d).filter((F.col("alignment_score") == MATCH * F.col("query_length")) & (F.col("query_length") >= MIN_COVERED))
    return whole.select("ordinal", "mate", "role", "target_group_ordinal", "target_start", "target_end").distinct()


@query
def report_targets(spark: SparkSession, d: str) -> DataFrame:
    """The target records of each run's short list, 26 text fields."""
    return report.top_targets(report.target_rows(_estimates(spark, d)))


def _run(spark: SparkSession, d: str, mode: str | None) -> DataFrame:
    rows = run.analyse(table(spark, d, "fasta"), table(spark, d, "fragments"), table(spark, d, "sampling_design"), mode)
    return rows.withColumn("member_ids", F.array_join("member_ids", ";"))


@query
def run_screen(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "screen")


@query
def run_full(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d, "full")


# ---- sources, sinks, streams


@query
def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records with unique ids written as FASTA and read again."""
    path = _scratch(spark)
    firsts = _records(spark, d).groupBy("id").agg(F.min(F.struct("description", "sequence")).alias("x")).select("id", "x.*")
    fasta_source.write_fasta(firsts, path)
    return fasta_source.read_fasta(spark, path).select("id", "description", "sequence")


@query
def fastq_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """First ends written as FASTQ and read again."""
    path = _scratch(spark)
    rows = _fragments(spark, d).select(F.concat(F.lit("fragment-"), "ordinal").alias("id"), "r1").filter("r1 is not null")
    fastq_source.write_fastq(rows, "r1", path)
    return fastq_source.read_fastq(spark, path).select("id", "sequence")


@query
def fastq_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of the pairs written as gzip FASTQ, a file a partition and end, and read again as pairs with dense ordinals."""
    paths = [_scratch(spark) for _ in range(2)]
    rows = _fragments(spark, d).filter("r1 is not null and r2 is not null").repartitionByRange("ordinal").sortWithinPartitions("ordinal")
    rows = checkpointed(rows.select(F.concat(F.lit("fragment-"), "ordinal").alias("id"), "r1", "r2"))
    for mate, (read, path) in enumerate(zip(("r1", "r2"), paths, strict=True), 1):
        fastq_source.write_fastq(rows.withColumn("id", F.concat("id", F.lit(f"/{mate} some comment"))), read, path, "gzip")
    return fastq_source.read_fragments(spark, *paths)


@query
def ledger_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The panel's ledger written as tab-separated text, and read again with its checks."""
    path = _scratch(spark)
    index_source.write_ledger(_groups(spark, d), path)
    return index_source.read_ledger(spark, path)


@query
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The index of the panel, built, verified and read again."""
    path = _scratch(spark)
    index_source.build_index(_records(spark, d), path)
    _, tables = index_source.load_index(spark, path)
    return tables["groups"].select("group_ordinal", "target_group_id", "representative_id", "representative_length")


@query
def stream_bottom_k(spark: SparkSession, d: str) -> DataFrame:
    return streaming.stream_bottom_k(streaming.stream_table(spark, d, "fragments"), table(spark, d, "sampling_design"))


@query
def stream_window_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = streaming.stream_window_counts(streaming.stream_table(spark, d, "fragments"))
    return rows.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))
