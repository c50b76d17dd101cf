"""Equivalence groups of panel records, their ledger, and the contigs of host and panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import checkpointed, letters
from seqloom.constants import ALPHABET
from seqloom.functions.seq import canonical_strand


def dense_ordinals(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with dense 0-based ordinals by `order`, without a window over all rows in one task.

    Rows are range-partitioned and sorted; one count a partition gives each its first ordinal. Ties get any order.
    """
    rows = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = rows.select("*", F.monotonically_increasing_id().alias("__dense_at"))
    pid = F.shiftright("__dense_at", 33)
    counts = at.groupBy(pid.alias("__dense_pid")).agg(F.count(F.lit(1)).alias("__dense_n"))  # a row a partition
    before = F.coalesce(F.sum("__dense_n").over(Window.orderBy("__dense_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("__dense_pid", before.alias("__dense_before"))
    out = at.withColumn("__dense_pid", pid).join(firsts, "__dense_pid")
    return out.select(*df.columns, (F.col("__dense_before") + F.col("__dense_at").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def panel_records(fasta: DataFrame) -> DataFrame:
    """(rec_ordinal, source, id, description, sequence, is_host): records with letters, all of them IUPAC.

    The sequence is its letters; an id is its first word, the description is trimmed and freed of leading bars.
    Records without an id or with other letters are left out, as a strict reader would refuse their file.
    """
    name = F.regexp_extract(F.trim("id"), r"^(\S+)", 1)
    about = F.trim(F.regexp_replace(F.trim(F.coalesce("description", F.lit(""))), r"^\|+", ""))
    is_host = F.coalesce(F.lower(F.trim("source")) == "host.fa", F.lit(False))
    rows = fasta.select("rec_ordinal", "source", name.alias("id"), about.alias("description"), letters("sequence").alias("sequence"), is_host.alias("is_host"))
    return rows.filter((F.col("id") != "") & F.col("sequence").rlike(f"^[{ALPHABET}]+$"))


def reference_groups(records: DataFrame) -> DataFrame:
    """(group_ordinal, target_group_id, representative_id, representative_description, member_ids, representative_length, contig_name).

    Records (id, description, sequence) equal on either strand form a group; its id digests the canonical sequence,
    members are sorted by bytes and named once, the representative is the smallest id with its smallest description.
    Groups are numbered by id. A group's member list is as long as its distinct ids.
    """
    canon = records.select("id", "description", F.sha2(canonical_strand("sequence"), 256).alias("digest"), F.length("sequence").cast("long").alias("n"))
    # first by member, so that a record copied very often is aggregated before the member lists are built
    members = canon.groupBy("digest", "id").agg(F.min("description").alias("description"), F.max("n").alias("n"))
    groups = members.groupBy("digest").agg(F.sort_array(F.collect_list("id")).alias("member_ids"), F.min(F.struct("id", "description")).alias("first"), F.max("n").alias("representative_length"))
    groups = groups.select(F.concat(F.lit("sha256:"), "digest").alias("target_group_id"), F.col("first.id").alias("representative_id"), F.col("first.description").alias("representative_description"), "member_ids", "representative_length")
    rows = dense_ordinals(groups, ["target_group_id"], "group_ordinal")
    return rows.select("group_ordinal", *groups.columns, F.concat(F.lit("target_"), "group_ordinal").alias("contig_name"))


def group_ledger(groups: DataFrame) -> DataFrame:
    """One row a group and member: (group_ordinal, target_group_id, representative_id, member_ordinal, member_id, representative_length)."""
    return groups.select("group_ordinal", "target_group_id", "representative_id", F.posexplode("member_ids").alias("member_ordinal", "member_id"), "representative_length")


def contigs(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(name, role, target_group_ordinal, sequence): host records in order, then a contig a group with its representative's own strand.

    Where several records bear the representative's id, the one of the smallest record ordinal that belongs to the group counts.
    A group whose representative isn't among the records ends the query with an error.
    """
    host = dense_ordinals(records.filter("is_host").select("rec_ordinal", "sequence"), ["rec_ordinal"], "n")
    host = host.select(F.concat(F.lit("host_"), "n").alias("name"), F.lit("HOST").alias("role"), F.lit(None).cast("long").alias("target_group_ordinal"), "sequence")
    own = records.filter("not is_host").select(F.col("id").alias("representative_id"), F.concat(F.lit("sha256:"), F.sha2(canonical_strand("sequence"), 256)).alias("target_group_id"), "rec_ordinal", "sequence")
    firsts = own.groupBy("representative_id", "target_group_id").agg(F.min(F.struct("rec_ordinal", "sequence")).alias("x"))
    sequence = F.when(F.col("x").isNull(), F.raise_error(F.concat(F.lit("no record bears the representative id "), "representative_id"))).otherwise(F.col("x.sequence"))
    target = groups.join(firsts, ["representative_id", "target_group_id"], "left").select(F.col("contig_name").alias("name"), F.lit("TARGET").alias("role"), F.col("group_ordinal").alias("target_group_ordinal"), sequence.alias("sequence"))
    return host.unionByName(target)
