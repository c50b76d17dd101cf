"""The queries of the eight problems: name -> (spark, sf_dir) -> DataFrame, over whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import checkpointed, materialized, table
from seqloom.llm import block_sample, collapse, leakage, ledger_sample, neardup, packing, repeats, splitting


def _limit(spark: SparkSession, sf_dir: str, purpose: str) -> tuple[int, int]:
    row = table(spark, sf_dir, "token_limits").filter(F.col("purpose") == purpose).first()
    return row.max_tokens, row.overlap_tokens


def kmer_length(spark: SparkSession, sf_dir: str) -> int:
    """Of the manifest row that was built last."""
    return table(spark, sf_dir, "index_manifest").filter("kmer_length is not null").orderBy(F.desc("built_at"), F.desc("contract_id")).first().kmer_length


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(table(spark, d, "fasta"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of near-equal records; ambiguous: fragments that the evidence calls ambiguous across groups, for records named as representatives."""
    groups = neardup.near_groups(table(spark, d, "fasta")).withColumnRenamed("key", "rec_ordinal")
    names = table(spark, d, "fasta").select("rec_ordinal", F.lower(F.trim("id")).alias("name"))
    evidence = table(spark, d, "group_evidence").select("run_id", "group_ordinal", "cross_group_ambiguous_fragments").distinct()
    evidence = evidence.groupBy("group_ordinal").agg(F.sum("cross_group_ambiguous_fragments").alias("ambiguous"))
    panel = table(spark, d, "reference_groups").select("group_ordinal", F.lower(F.trim("representative_id")).alias("name"))
    ambiguous = panel.join(evidence, "group_ordinal").filter("name is not null").groupBy("name").agg(F.sum("ambiguous").alias("ambiguous"))
    rows = groups.join(names, "rec_ordinal").join(ambiguous, "name", "left")
    return rows.select("rec_ordinal", F.col("group").alias("group_rec"), "links", "ambiguous")


def _canon(spark: SparkSession, d: str) -> DataFrame:
    return collapse.canonical_fasta(table(spark, d, "fasta")).unionByName(collapse.canonical_groups(table(spark, d, "reference_groups")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return collapse.redundant(_canon(spark, d))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse.collapsed(_canon(spark, d))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    """The draw over all pieces; sample_keys is the ledger's first edition, the draw writes the next one."""
    first = ledger_sample.ledger_keys(table(spark, d, "sample_keys"))
    return ledger_sample.draw(table(spark, d, "fragments"), first, ledger_sample.ledger_folder(spark))


def p3_grown(spark: SparkSession, d: str) -> DataFrame:
    """Two draws with one ledger: of the earlier half of the pieces, then of all; early tells what the first one selected."""
    fragments, first = table(spark, d, "fragments"), ledger_sample.ledger_keys(table(spark, d, "sample_keys"))
    folder = f"{ledger_sample.ledger_folder(spark)}/grown-{uuid.uuid4().hex}"
    half = fragments.agg(F.max("piece_no")).first()[0] or 0
    early = ledger_sample.draw(fragments.filter(F.coalesce("piece_no", F.lit(-1)) * 2 <= half), first, folder)
    late = ledger_sample.draw(fragments, first, folder)
    rows = late.join(early.select("ordinal", F.lit(True).alias("early")), "ordinal", "full")
    return rows.select("ordinal", "run_id", "origin", F.coalesce("early", F.lit(False)).alias("early"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    span = 2 * kmer_length(spark, d)
    rows = repeats.shared_spans((table(spark, d, "fasta"), "rec_ordinal", "sequence"), (table(spark, d, "fragments"), "ordinal", "r1"), span)
    return rows.select(F.when(F.col("tbl") == 0, "fasta").otherwise("fragments").alias("tbl"), F.col("rec").alias("rec_key"), "span_start", "span_end")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d)


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each record and each fragment, how much of it is shared elsewhere."""
    spans = checkpointed(_spans(spark, d)).withColumnRenamed("rec_key", "rec")
    out = []
    for name, key, text in (("fasta", "rec_ordinal", "sequence"), ("fragments", "ordinal", "r1")):
        own = repeats.shares(spans.filter(F.col("tbl") == name), table(spark, d, name), key, text)
        out.append(own.select(F.lit(name).alias("tbl"), F.col("rec").alias("rec_key"), "n_letters", "covered", "share"))
    return out[0].unionByName(out[1])


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return block_sample.block_sample(table(spark, d, "fragments"), table(spark, d, "sampling_design"))


def p5_sizes(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p5_sample, by run: its size, no fragment twice, none of another run."""
    rows = materialized(p5_sample(spark, d))
    own = table(spark, d, "fragments").filter("ordinal is not null").groupBy("ordinal").agg(F.min("run_id").alias("own"))
    rows = rows.join(own, "ordinal", "left")
    return rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("sampled"), F.count_distinct("ordinal").alias("fragments"), F.count_if(F.coalesce(F.col("own") != F.col("run_id"), F.lit(True))).alias("strangers"))


def _packed(spark: SparkSession, d: str, purpose: str) -> DataFrame:
    return packing.pack(packing.token_counts(table(spark, d, "documents")), _limit(spark, d, purpose)[0])


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "pack")


def p6_pack_small(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d, "pack_small")


def p6_placed(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of p6_pack: each text is there once, without a gap, in containers none of which is overfull."""
    limit = _limit(spark, d, "pack")[0]
    packed = packing.pack(packing.token_counts(table(spark, d, "documents")), limit)
    fill = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill"))
    rows = packed.join(fill, "container")
    gap = F.sum(F.when(F.col("token_start") == F.col("piece_no") * limit, 0).otherwise(1)) + F.max("token_end") - F.sum("n_tokens")
    return rows.groupBy("doc_id").agg(F.count_if(F.col("piece_no") == 0).alias("texts"), gap.alias("gaps"), F.count_if(F.col("fill") > limit).alias("overfull"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each leak and its place."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the documents that leak no item."""
    documents = table(spark, d, "documents")
    return leakage.without_leaks(documents.select("doc_id", "source"), p7_found(spark, d))


def p8_split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(table(spark, d, "documents"), *_limit(spark, d, "split"))


def p8_rejoined(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each text, of those that were split as the pieces of p8_split give it."""
    documents = table(spark, d, "documents").filter("text is not null")
    pieces = materialized(p8_split(spark, d))
    whole = documents.join(pieces.select("doc_id"), "doc_id", "left_anti").select("doc_id", "text")
    return splitting.rejoined(pieces).unionByName(whole).select("doc_id", F.sha2("text", 256).alias("digest"))


def p8_split_wide(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_long(table(spark, d, "documents"), *_limit(spark, d, "split_wide"))


_ALL = (
    p1_found, p1_groups, p2_found, p2_collapsed, p3_sample, p3_grown, p4_found, p4_shares, p5_sample, p5_sizes,
    p6_pack, p6_pack_small, p6_placed, p7_found, p7_matches, p7_clean, p8_split, p8_split_wide, p8_rejoined,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
