"""Helpers every module shares: table access, checkpoints, the spelling of letters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir. Only a local session may do without: it gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written once to the checkpoint folder; its lineage ends there and lost executors cost nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def letters(col: Column | str) -> Column:
    """The characters A to Z of a sequence after upper-casing, in order; null stays null."""
    return F.regexp_replace(F.upper(F.col(col) if isinstance(col, str) else col), "[^A-Z]", "")


def spread(df: DataFrame, text: str, least: int = 1 << 18, most: int = 1 << 24) -> DataFrame:
    """df, dealt out so that a task has `least` to `most` letters of the column `text`: for steps that make a row of each letter.

    Such rows are hundreds of times larger than the compressed file they come from, by whose size Spark cuts its tasks.
    """
    letters_in = df.agg(F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0))).first()[0]
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = max(letters_in // most, min(cores, letters_in // least)) + 1
    return df.repartition(int(parts))


def bottom_k_per_group(df: DataFrame, group: list[str], hex_key: str, tie: str, quota: str, digits: int = 3) -> DataFrame:
    """Rows of df that are among the first `quota` of their group by (hex_key, tie), exactly.

    hex_key is a lower-case hex string column spread evenly (a digest). A histogram of its first `digits` symbols
    finds, in each group, the one slice that holds the cut; only that slice is ranked. So a group of any size is
    spread over many tasks: no window ever holds more than about group / 16**digits rows, unless keys repeat.
    A null or non-positive quota selects nothing. Null keys are never selected. Nulls in group columns form a group.
    """
    df = df.filter(F.col(hex_key).isNotNull()).withColumn("_slice", F.substring(hex_key, 1, digits))
    named = [F.col(g).alias(f"_g_{g}") for g in group]
    hist = df.groupBy(*named, F.col("_slice").alias("_h_slice")).agg(F.count(F.lit(1)).alias("_n"), F.max(quota).alias("_quota"))
    from pyspark.sql import Window

    upto = Window.partitionBy(*[f"_g_{g}" for g in group]).orderBy("_h_slice").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0))).filter(F.col("_before") < F.col("_quota"))
    on = F.col("_slice") == F.col("_h_slice")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    near = df.join(hist, on)
    whole = near.filter(F.col("_before") + F.col("_n") <= F.col("_quota"))
    rank = F.row_number().over(Window.partitionBy(*[f"_g_{g}" for g in group], "_h_slice").orderBy(hex_key, tie))
    part = near.filter(F.col("_before") + F.col("_n") > F.col("_quota")).withColumn("_rank", rank).filter(F.col("_before") + F.col("_rank") <= F.col("_quota"))
    columns = [c for c in df.columns if c != "_slice"]
    return whole.select(*columns).unionByName(part.select(*columns))


def materialized(df: DataFrame) -> DataFrame:
    """df, written once as a compressed Parquet table in the shared checkpoint folder, and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    sc = df.sparkSession.sparkContext
    path = f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    sc._seqloom_tables = [*getattr(sc, "_seqloom_tables", []), path]
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_path(spark: SparkSession, text: str):
    """A path as Hadoop's object, and its file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def drop_tables(spark: SparkSession) -> None:
    """Delete the tables that materialized() wrote in this session: call it when the results built on them are written."""
    sc = spark.sparkContext
    for text in getattr(sc, "_seqloom_tables", []):
        path, fs = hadoop_path(spark, text)
        fs.delete(path, True)
    sc._seqloom_tables = []


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were started elsewhere; once a context."""
    import zipfile
    from pathlib import Path

    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="seqloom-")) / "seqloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(str(archive))
    sc._seqloom_shipped = True
