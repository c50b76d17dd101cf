"""A panel index as a folder of Parquet tables with a manifest, and the ledger as strict tab-separated text."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.common import hadoop_path
from seqloom.constants import KMER, profile_digest
from seqloom.operators import align, gate, grouping

LEDGER_SCHEMA = "group_ordinal long, target_group_id string, representative_id string, member_ordinal int, member_id string, representative_length long"
_TABLES = ("groups", "contigs", "kmers", "seeds", "words")
_FIELDS = {"contract", "profile_digest", "kmer_length", *_TABLES, "bloom", "host_fasta_sha256", "target_fasta_sha256", "reference_set_digest"}
CONTRACT = "seqloom-index-v3"


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order or partitions."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))
    half = lambda a: F.sum(F.conv(F.substring("h", a, 12), 16, 10).cast("decimal(38,0)"))
    r = rows.agg(F.count(F.lit(1)), half(1), half(13), half(25)).first()
    return hashlib.sha256(repr(tuple(str(x) for x in r)).encode()).hexdigest()


def build_index(records: DataFrame, path: str, k: int = KMER, sources: tuple[str, str] = ("", "")) -> dict:
    """Write groups, contigs, k-mers, the aligner's seeds and the gate's filter of records (see panel_records) to the new folder `path`; return the manifest.

    sources: digests of the host's and the panel's files. All is written beside `path` and renamed at last; a failure
    leaves nothing.
    """
    spark = records.sparkSession
    target, fs = hadoop_path(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    part = f"{path.rstrip('/')}.part.{uuid.uuid4().hex}"

    def written(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{part}/{name}")
        return spark.read.parquet(f"{part}/{name}")

    try:
        groups = written("groups", grouping.reference_groups(records.filter("not is_host")))
        contigs = written("contigs", grouping.contigs(records, groups))
        kmers = written("kmers", gate.target_kmers(records, k))
        n = kmers.count()
        tables = {"groups": groups, "contigs": contigs, "kmers": kmers, "seeds": written("seeds", align.contig_segments(contigs, k)), "words": written("words", gate.bloom_words(kmers, gate.bloom_bits(n)))}
        manifest = {"contract": CONTRACT, "profile_digest": profile_digest(), "kmer_length": k, **{t: table_digest(df) for t, df in tables.items()}}
        manifest |= {"bloom": gate.bloom_summary(kmers, tables["words"]).first().asDict(), "host_fasta_sha256": sources[0], "target_fasta_sha256": sources[1]}
        manifest["reference_set_digest"] = hashlib.sha256("|".join([*sources, *(manifest[t] for t in _TABLES)]).encode()).hexdigest()
        spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{part}/manifest")
        if not fs.rename(hadoop_path(spark, part)[0], target):
            raise OSError(f"cannot rename {part} to {path}")
    except Exception:
        fs.delete(hadoop_path(spark, part)[0], True)
        raise
    return manifest


def index_digest(manifest: dict) -> str:
    """SHA-256 of the manifest's canonical text."""
    return hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()


def load_index(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict, dict[str, DataFrame]]:
    """The manifest and the tables; a wrong contract, missing or unknown fields, other contents, or contigs that don't match the groups are errors that ask for a rebuild."""
    there, fs = hadoop_path(spark, f"{path}/manifest")
    rows = spark.read.text(f"{path}/manifest").collect() if fs.exists(there) else []
    try:
        manifest = json.loads(rows[0].value) if len(rows) == 1 else {}
    except ValueError:
        manifest = {}
    if set(manifest) != _FIELDS or manifest["contract"] != CONTRACT or manifest["profile_digest"] != profile_digest():
        raise ValueError("not an index of this contract and profile; rebuild it")
    tables = {t: spark.read.parquet(f"{path}/{t}") for t in _TABLES}
    if verify:
        for t, df in tables.items():
            if table_digest(df) != manifest[t]:
                raise ValueError(f"the table {t} differs from the manifest; rebuild the index")
        validate_groups(tables["groups"])
        targets = tables["contigs"].filter("role = 'TARGET'").select("target_group_ordinal")
        n = tables["groups"].count()
        if targets.count() != n or targets.distinct().count() != n:
            raise ValueError("contigs and groups do not match one to one; rebuild the index")
    return manifest, tables


def validate_groups(groups: DataFrame) -> None:
    """Ordinals must be dense from 0 and group ids strictly ascending with them; members strictly ascending."""
    r = groups.agg(F.count(F.lit(1)).alias("n"), F.min("group_ordinal").alias("lo"), F.max("group_ordinal").alias("hi"), F.count_distinct("group_ordinal").alias("d")).first()
    if r.n and (r.lo != 0 or r.hi != r.n - 1 or r.d != r.n):
        raise ValueError("group ordinals are not dense; rebuild the index")
    # neighbours by ordinal meet through a join, not through one window over all groups
    after = groups.select((F.col("group_ordinal") - 1).alias("group_ordinal"), F.col("target_group_id").alias("next_id"))
    wrong = groups.join(after, "group_ordinal").filter("next_id <= target_group_id")
    members = groups.filter(F.array_sort(F.array_distinct("member_ids")) != F.col("member_ids"))
    if not wrong.isEmpty() or not members.isEmpty():
        raise ValueError("the ledger is not strictly ascending; rebuild the index")


def write_ledger(groups: DataFrame, path: str) -> None:
    grouping.group_ledger(groups).orderBy("group_ordinal", "member_ordinal").write.csv(path, sep="\t", header=True)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger with its exact header and types, checked for dense member ordinals and ascending members."""
    rows = spark.read.csv(path, sep="\t", header=True, schema=LEDGER_SCHEMA, mode="FAILFAST", enforceSchema=False)
    order = Window.partitionBy("group_ordinal").orderBy("member_ordinal")
    checked = rows.withColumns({"_at": F.row_number().over(order) - 1, "_last": F.lag("member_id").over(order)})
    bad = checked.filter((F.col("_at") != F.col("member_ordinal")) | (F.col("_last") >= F.col("member_id"))).limit(1).count()
    if bad:
        raise ValueError("the ledger is not dense and ascending")
    return rows
