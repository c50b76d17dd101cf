"""The sample and the counters over pieces as they arrive (Structured Streaming)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.common import ensure_checkpoint_dir, hadoop_path
from seqloom.operators.sampling import bottom_k_by_run, keyed


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A table's files as a stream; a table of one file or of a folder of them."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    one = spark.read.parquet(f"{sf_dir}/{name}.parquet").select("_metadata.file_name").first()
    if one and one.file_name == f"{name}.parquet":  # a single file is no folder to watch
        return files.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return files.parquet(f"{sf_dir}/{name}.parquet")


def _home(spark: SparkSession, folder: str | None) -> str:
    ensure_checkpoint_dir(spark)
    return folder.rstrip("/") if folder else f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _written(spark: SparkSession, folder: str) -> list[int]:
    """The batches whose tables (batch=<number>) stand whole in the folder."""
    path, fs = hadoop_path(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(hadoop_path(spark, f"{folder}/{n}/_SUCCESS")[0]))


def stream_bottom_k(fragments: DataFrame, design: DataFrame, trigger: dict | None = None, folder: str | None = None) -> DataFrame:
    """Per run the bottom-k sample of all pieces of the stream: equal to the sample of the whole table.

    bottom_k(A + B) = bottom_k(bottom_k(A) + bottom_k(B)): each batch is merged into the state, a Parquet table of at
    most `capacity` rows a run, written anew under the batch's number; a batch that is replayed after a failure reads
    the state before it again, so it counts once. Fragments delivered again are merged by ordinal.
    folder: where the state and the stream's log are kept; a query started again with the same folder goes on after the
    last whole batch. Without one the state lasts for this call.
    """
    spark = fragments.sparkSession
    home = _home(spark, folder)
    design = design.select("run_id", "capacity")

    def merge(batch: DataFrame, number: int) -> None:
        rows = keyed(batch)
        before = [n for n in _written(spark, f"{home}/state") if n < number]
        if before:
            state = batch.sparkSession.read.parquet(f"{home}/state/batch={max(before)}")
            rows = state.unionByName(rows).groupBy("ordinal").agg(F.min("run_id").alias("run_id"), F.min("id").alias("id"), F.min("key").alias("key"))
        bottom_k_by_run(rows, design).write.mode("overwrite").parquet(f"{home}/state/batch={number}")

    query = fragments.writeStream.foreachBatch(merge).option("checkpointLocation", f"{home}/log").trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    done = _written(spark, f"{home}/state")
    if not done:
        return spark.createDataFrame([], "ordinal long, run_id string, id string, key string")
    return spark.read.parquet(f"{home}/state/batch={max(done)}")


def stream_window_counts(fragments: DataFrame, width: str = "6 hours", folder: str | None = None) -> DataFrame:
    """(run_id, window_start, fragments, reads): arrivals of all pieces of the stream by run and window of arrival time.

    Equal to the counts over the whole table, however its rows are ordered and its files batched: no watermark drops a
    late row or holds back a window. A fragment delivered again at the same time counts once, at another time again;
    rows without an arrival time are in no window. Each batch writes its own arrivals, once each, under its number, so
    one replayed after a failure counts once; arrivals that repeat between batches are merged where they are counted.
    folder: as in stream_bottom_k.
    """
    spark = fragments.sparkSession
    home = _home(spark, folder)
    rows = fragments.withColumn("arrived_at", F.col("arrived_at").cast("timestamp")).filter("arrived_at is not null").select("ordinal", "arrived_at", "run_id", F.col("r2").isNotNull().alias("paired"))

    def once(arrivals: DataFrame) -> DataFrame:
        return arrivals.groupBy("ordinal", "arrived_at").agg(F.min("run_id").alias("run_id"), F.bool_or("paired").alias("paired"))

    def keep(batch: DataFrame, number: int) -> None:
        once(batch).write.mode("overwrite").parquet(f"{home}/arrivals/batch={number}")

    query = rows.writeStream.foreachBatch(keep).option("checkpointLocation", f"{home}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    arrivals = spark.read.schema(rows.schema).parquet(f"{home}/arrivals/batch=*") if _written(spark, f"{home}/arrivals") else spark.createDataFrame([], rows.schema)
    counts = once(arrivals).groupBy("run_id", F.window("arrived_at", width)).agg(F.count(F.lit(1)).alias("fragments"), F.sum(F.when(F.col("paired"), 2).otherwise(1)).alias("reads"))
    return counts.select("run_id", F.col("window.start").alias("window_start"), "fragments", "reads")
