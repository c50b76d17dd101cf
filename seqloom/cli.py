"""Command line: index a panel, run reads against it."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import ship_package
from seqloom.constants import Precision, RunMode
from seqloom.functions.stats import sample_capacity
from seqloom.functions.seq import sample_id
from seqloom.plans.run import analyse_indexed
from seqloom.sources import fasta, fastq, index, report


def records_of(spark: SparkSession, host: str, target: str) -> DataFrame:
    """Host and panel files as the records an index is built of."""
    parts = []
    for path, is_host in ((host, True), (target, False)):
        rows = fasta.read_fasta(spark, path)
        fasta.check_fasta(rows)
        parts.append(rows.withColumn("is_host", F.lit(is_host)))
    return parts[0].unionByName(parts[1])


def build(spark: SparkSession, host: str, target: str, out: str) -> dict:
    """Index the panel `target` with the background `host` (FASTA files) in the new folder `out`; verify it; return the manifest."""
    ship_package(spark)
    known = fastq.content_digests(spark, [host, target])
    manifest = index.build_index(records_of(spark, host, target), out, sources=(known[host], known[target]))
    index.load_index(spark, out)
    return manifest


def run(spark: SparkSession, r1: str, r2: str | None, index_path: str, out: str, mode: str = RunMode.SCREEN, precision: str = Precision.STANDARD) -> report.RunSummary:
    """Reports of one sample in the new folder `out`; on failure that folder holds perf.json with the error alone."""
    clock = report.Performance(spark.sparkContext.defaultParallelism)
    if os.path.exists(out):
        raise FileExistsError(out)
    ship_package(spark)
    name = ""
    try:
        name = spark.range(1).select(sample_id(F.lit(r1)).alias("s")).first().s
        manifest, tables = index.load_index(spark, index_path)
        profile, digest = manifest["profile_digest"], index.index_digest(manifest)
        clock.stage("index_load_ms")
        reads = fastq.read_fragments(spark, r1, r2).withColumn("run_id", F.lit(name))
        content = fastq.input_digest(spark, r1, r2)
        many = tables["groups"].count()
        capacity = sample_capacity(many, precision)
        design = spark.createDataFrame([(name, str(mode), str(precision), capacity)], "run_id string, mode string, precision string, capacity long")
        clock.stage("scan_sample_ms")
        rows, scalars = analyse_indexed(tables["groups"], tables["contigs"], tables["kmers"], reads, design, index=f"{profile}|{digest}", seeds=tables["seeds"], words=tables["words"])
        figures = scalars.first().asDict()
        if not figures["input_fragments"]:
            raise ValueError("no fragments")
        limited = figures["not_evaluable"] > 0
        figures |= {"profile_digest": profile, "index_digest": digest, "input_digest": content, "sample_capacity": capacity, "target_family_size": many,
                    "analysis_status": "CONFORMANT_WITH_LIMITATIONS" if limited else "CONFORMANT_COMPLETE",
                    "reason_codes": f"TARGET_KMER_NOT_EVALUABLE_INPUT_FRAGMENTS={figures['not_evaluable']}" if limited else ""}
        clock.stage("selected_analysis_ms")
        return report.write_report(rows, figures, out, clock)
    except Exception as e:
        report.write_failure(out, e, clock, name)
        raise


class _Once(argparse.Action):
    """A flag that may be given once."""

    def __call__(self, parser, namespace, values, option_string=None):  # noqa: ANN001
        given = getattr(namespace, "_given", set())
        if self.dest in given:
            parser.error(f"{option_string} is given twice")
        namespace._given = given | {self.dest}
        setattr(namespace, self.dest, values)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="seqloom", allow_abbrev=False)
    commands = parser.add_subparsers(dest="command", required=True)
    i = commands.add_parser("index", allow_abbrev=False)
    for flag in ("--host-fa", "--target-fa", "--out"):
        i.add_argument(flag, required=True, action=_Once)
    r = commands.add_parser("run", allow_abbrev=False)
    for flag in ("--r1", "--index", "--out"):
        r.add_argument(flag, required=True, action=_Once)
    r.add_argument("--r2", action=_Once)
    r.add_argument("--mode", choices=[str(m) for m in RunMode], default="screen", action=_Once)
    r.add_argument("--precision", choices=[str(p) for p in Precision], default="standard", action=_Once)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("seqloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if a.command == "index":
            build(spark, a.host_fa, a.target_fa, a.out)
        else:
            print(run(spark, a.r1, a.r2, a.index, a.out, a.mode, a.precision))
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
