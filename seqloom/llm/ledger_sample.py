"""Problem 3: a sample that is stable as the data grows.

Method: a persisted selection ledger. Every fragment the ledger holds is kept, by join. Fragments it has not seen fill
growth quotas: each (run, piece) is filled up to ceil(rate x its fragments), from the unseen ones with the lowest hash
priority; a piece whose kept fragments reach that already adds none. Each draw writes the next edition of the ledger,
with all that it selected, before it gives its sample; the next draw takes that edition. So whatever is added later,
new pieces and runs, more rows of an old piece, or a fragment delivered again under another piece or run, no selected
fragment leaves the sample.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import bottom_k_per_group, ensure_checkpoint_dir, hadoop_path, materialized

GROWTH_RATE = 0.125
SEED = "seqloom-ledger-1"
#: The session's setting that names the folder of the ledger's editions.
LEDGER_DIR = "seqloom.ledger.dir"


def ledger_keys(sample_keys: DataFrame) -> DataFrame:
    """(ordinal, key): one row a fragment. Keys are trimmed, lower-cased and freed of 0x; what isn't 32 hex digits then, or is null, is no key."""
    key = F.regexp_replace(F.lower(F.trim("key")), "^0x", "")
    rows = sample_keys.select("ordinal", key.alias("key")).filter(F.col("key").rlike("^[0-9a-f]{32}$"))
    return rows.groupBy("ordinal").agg(F.min("key").alias("key"))


def ledger_sample(fragments: DataFrame, ledger: DataFrame, rate: float = GROWTH_RATE, seed: str = SEED) -> DataFrame:
    """(ordinal, run_id, piece_no, origin, priority): the selected fragments, each once.

    ledger: (ordinal, key), unique by ordinal, and origin where it has that column; entries of fragments that aren't
    there select nothing. origin is 'ledger' (kept; priority is the ledger's key) or 'growth' (priority is the hash);
    a fragment kept by an edition that has its origin keeps that too, so a draw repeated with its own edition is the
    same. Redelivered rows count once, under the smallest run and piece they came with. A null piece counts as piece -1
    and a null run as a run of its own. Rows with a null ordinal are no fragments.
    """
    once = fragments.filter(F.col("ordinal").isNotNull()).groupBy("ordinal").agg(F.min("run_id").alias("run_id"), F.min(F.coalesce("piece_no", F.lit(-1))).alias("piece_no"))
    origin = F.col("origin") if "origin" in ledger.columns else F.lit("ledger")
    all_rows = materialized(once.join(ledger.select("ordinal", "key", origin.alias("origin")), "ordinal", "left"))
    kept = all_rows.filter(F.col("key").isNotNull()).select("ordinal", "run_id", "piece_no", "origin", F.col("key").alias("priority"))
    unseen = all_rows.filter(F.col("key").isNull()).select("ordinal", "run_id", "piece_no", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("ordinal").cast("string")), 256).alias("priority"))
    quotas = all_rows.groupBy("run_id", "piece_no").agg((F.ceil(F.count(F.lit(1)) * F.lit(float(rate))) - F.count("key")).alias("quota")).filter("quota > 0")
    quotas = materialized(quotas.select(F.col("run_id").alias("q_run"), F.col("piece_no").alias("q_piece"), "quota"))
    unseen = unseen.join(quotas, F.col("run_id").eqNullSafe(F.col("q_run")) & (F.col("piece_no") == F.col("q_piece"))).drop("q_run", "q_piece")
    grown = bottom_k_per_group(unseen, ["run_id", "piece_no"], "priority", "ordinal", "quota")
    return kept.unionByName(grown.select("ordinal", "run_id", "piece_no", F.lit("growth").alias("origin"), "priority"))


def extend_ledger(fragments: DataFrame, ledger: DataFrame, path: str, rate: float = GROWTH_RATE, seed: str = SEED) -> DataFrame:
    """Write the ledger's next edition (ordinal, key, origin) to the new folder `path` and return it; the next draw takes it as its ledger.

    A growth fragment enters under its priority. Nothing that the ledger held leaves it, even where `fragments` is only
    a newly arrived part of the data.
    """
    origin = F.col("origin") if "origin" in ledger.columns else F.lit("ledger")
    held = ledger.select("ordinal", "key", origin.alias("origin")).filter("ordinal is not null")
    drawn = ledger_sample(fragments, held, rate, seed).select("ordinal", F.col("priority").alias("key"), "origin")
    fresh = drawn.join(held.select("ordinal"), "ordinal", "left_anti")
    held.unionByName(fresh).write.mode("errorifexists").parquet(path)
    return fragments.sparkSession.read.parquet(path)


def selected(fragments: DataFrame, ledger: DataFrame) -> DataFrame:
    """The sample that an edition of the ledger stands for: (ordinal, run_id, piece_no, origin, priority) of its fragments that are there."""
    once = fragments.filter(F.col("ordinal").isNotNull()).groupBy("ordinal").agg(F.min("run_id").alias("run_id"), F.min(F.coalesce("piece_no", F.lit(-1))).alias("piece_no"))
    return once.join(ledger, "ordinal").select("ordinal", "run_id", "piece_no", "origin", F.col("key").alias("priority"))


def ledger_folder(spark: SparkSession) -> str:
    """The folder that spark.conf names for the editions (seqloom.ledger.dir), else a new one in the shared checkpoint folder."""
    named = spark.conf.get(LEDGER_DIR, None)
    if named:
        return named.rstrip("/")
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/ledger-{uuid.uuid4().hex}"


def editions(spark: SparkSession, folder: str) -> tuple[int, int]:
    """The number of the newest edition that was written whole, and of the newest one of all; 0 if there is none."""
    path, fs = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    numbers = {int(n.removeprefix("edition=")): n for n in names if n.startswith("edition=")}
    whole = [k for k, n in numbers.items() if fs.exists(hadoop_path(spark, f"{folder}/{n}/_SUCCESS")[0])]
    return max(whole, default=0), max(numbers, default=0)


def draw(fragments: DataFrame, first: DataFrame, folder: str, rate: float = GROWTH_RATE, seed: str = SEED) -> DataFrame:
    """Extend the newest whole edition in `folder` (or `first`, where there is none) by what `fragments` need, and return the sample.

    The edition is written before the sample is read from it; one that a lost draw left unfinished is passed over. One draw
    at a time may use a folder: two at once would write the same edition, and the later one fails.
    """
    spark = fragments.sparkSession
    whole, last = editions(spark, folder)
    ledger = spark.read.parquet(f"{folder}/edition={whole}") if whole else first
    return selected(fragments, extend_ledger(fragments, ledger, f"{folder}/edition={last + 1}", rate, seed))
