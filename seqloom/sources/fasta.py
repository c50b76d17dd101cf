"""FASTA as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.constants import ALPHABET
from seqloom.operators.grouping import dense_ordinals


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(source, rec_ordinal, id, description, sequence) of one or more plain FASTA files.

    Files are split at record starts, so a large one is read by many tasks. The id is the header's first word; the
    description what follows, trimmed and freed of leading bars; the sequence the rest without blanks, upper-case.
    Text before the first header, a header without an id, an empty sequence, and letters outside the IUPAC set end
    the query with an error, as do repeated ids and files without a record: see check_fasta.
    """
    raw = spark.read.text(path, lineSep="\n>").select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    first = F.startswith("value", F.lit(">"))
    body = F.when(first, F.substring("value", F.lit(2), F.length("value"))).otherwise(F.col("value"))
    # a later part of a file begins behind "\n>"; a file's own first part, the first row of its first block, must begin with ">"
    begins = raw.filter("_block = 0").groupBy(F.col("source").alias("_file")).agg(F.min("_at").alias("_first"))  # a row a file
    raw = raw.join(begins, raw.source == begins._file)
    stray = (F.col("_at") == F.col("_first")) & (F.col("_block") == 0) & ~first
    raw = raw.withColumn("_body", F.when(stray & F.col("value").rlike(r"\S"), F.raise_error(F.concat(F.lit("text before the first header in "), "source"))).otherwise(body)).filter(F.col("_body").rlike(r"\S"))
    header = F.substring_index(F.regexp_replace("_body", "\r", "\n"), "\n", 1)
    rest = F.substring(F.col("_body"), F.length(header) + 1, F.length("_body"))
    sequence = F.upper(F.regexp_replace(rest, r"\s", ""))
    rows = raw.select("source", "_block", "_at", F.regexp_extract(header, r"^(\S*)", 1).alias("id"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(header, r"^\S*", "")), r"^\|+", "")).alias("description"), sequence.alias("sequence"))
    fault = F.when(F.col("id") == "", "a header without an id").when(F.col("sequence") == "", "an empty sequence").when(~F.col("sequence").rlike(f"^[{ALPHABET}]+$"), "a letter outside the IUPAC set")
    rows = rows.withColumn("sequence", F.when(fault.isNotNull(), F.raise_error(F.concat(fault, F.lit(" in "), "source", F.lit(", record "), "id"))).otherwise(F.col("sequence")))
    return dense_ordinals(rows, ["source", "_block", "_at"], "rec_ordinal").select("source", "rec_ordinal", "id", "description", "sequence")


def check_fasta(records: DataFrame) -> None:
    """Raise ValueError if there is no record, or an id repeats within a file."""
    if records.isEmpty():
        raise ValueError("no FASTA record")
    twice = records.groupBy("source", "id").count().filter("count > 1").select("id").first()
    if twice:
        raise ValueError(f"the id {twice.id} repeats")


def write_fasta(records: DataFrame, path: str) -> None:
    """Records (id, description, sequence) as FASTA text files in the folder `path`, lines of 60 letters."""
    lines = F.regexp_replace("sequence", "(.{60})(?=.)", "$1\n")
    about = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise("")
    records.select(F.concat(F.lit(">"), "id", about, F.lit("\n"), lines).alias("value")).write.text(path)
