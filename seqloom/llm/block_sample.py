"""Problem 5: a uniform sample of fixed size from data of unknown length that arrives in pieces.

Method: block acceptance-rejection. The blocks are the Parquet row groups. A light pass over the footers and the run
column alone counts each run's rows in each row group. For each run, draws choose one of its row groups uniformly and an
offset below the largest number of its rows in any of them; only the row groups drawn are read, and of these the key
columns alone. A draw is rejected if that offset doesn't exist in the chosen group, was drawn before, or is a
redelivery, i.e. not the first row of its fragment; draws go on until `capacity` fragments are accepted. Every fragment
has the same chance in each draw, so the accepted set is uniform. Whether a row is its fragment's first is found in a
scan of the item column for the few items drawn, behind a filter of bounded size, so that the table is never shuffled.
Draws are numbered hashes, so the result depends on the seed and the files alone. Runs with no more fragments than
their capacity are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import bottom_k_per_group, checkpointed, materialized
from seqloom.llm.filters import filter_words, may_hold

SEED = 20250301
#: Draws made in one step of a task.
STEP = 1 << 16


def _parquet(file: str):
    """A Parquet file of any file system that Arrow knows, by Spark's name of it."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(unquote(re.sub("^file:/+", "/", file)))
    return pq.ParquetFile(where.open_input_file(path))


def row_groups(table: DataFrame) -> DataFrame:
    """(file, file_hash, group_no, start): of each Parquet file of table its row groups and their first rows' indexes, from its footer."""

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, code in zip(b.column("file").to_pylist(), b.column("file_hash").to_pylist(), strict=True):
                meta = _parquet(file).metadata
                sizes = [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
                starts = [sum(sizes[:i]) for i in range(len(sizes))]
                yield pa.RecordBatch.from_pydict({"file": pa.array([file] * len(sizes), pa.string()), "file_hash": pa.array([code] * len(sizes), pa.int64()), "group_no": pa.array(range(len(sizes)), pa.int32()), "start": pa.array(starts, pa.int64())})

    files = table.select(F.col("_metadata.file_path").alias("file")).distinct()  # reads no column of the table
    return files.repartition("file").select("file", F.xxhash64("file").alias("file_hash")).mapInArrow(footers, "file string, file_hash long, group_no int, start long")


def run_blocks(groups: DataFrame, run: str) -> DataFrame:
    """(run_id, file, file_hash, group_no, start, n): how many rows each run has in each row group, from its column `run` alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                runs = pc.value_counts(_parquet(row["file"]).read_row_group(row["group_no"], columns=[run]).column(0).combine_chunks())
                names, n = runs.field(0).cast(pa.string()), runs.field(1)
                same = lambda v, kind, k=len(n): pa.array([v] * k, kind)
                yield pa.RecordBatch.from_arrays([names, same(row["file"], pa.string()), same(row["file_hash"], pa.int64()), same(row["group_no"], pa.int32()), same(row["start"], pa.int64()), n], ["run_id", "file", "file_hash", "group_no", "start", "n"])

    return groups.repartition("file", "group_no").mapInArrow(count, "run_id string, file string, file_hash long, group_no int, start long, n long").filter("run_id is not null")


def drawn_rows(draws: DataFrame, run: str, item: str) -> DataFrame:
    """(run_id, item, file_hash, at, draw) of draws (run_id, file, file_hash, group_no, start, slot, draw) that exist: only the row groups named are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = at = items = names = first = size = None
        for b in batches:
            if not b.num_rows:
                continue
            file, group, start = b.column("file").to_pylist(), b.column("group_no").to_pylist(), b.column("start").to_pylist()
            cut = [i for i in range(len(file)) if not i or (file[i], group[i]) != (file[i - 1], group[i - 1])] + [len(file)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if opened != (file[i], group[i]):
                    opened = file[i], group[i]
                    t = _parquet(file[i]).read_row_group(group[i], columns=[run, item])
                    runs = pc.dictionary_encode(t.column(run).cast(pa.string()).combine_chunks(), null_encoding="encode")
                    code, items = runs.indices.to_numpy(), t.column(item).combine_chunks()
                    at = np.argsort(code, kind="stable")  # rows by run, in the group's order
                    size = np.bincount(code, minlength=len(runs.dictionary))
                    names, first = {v: k for k, v in enumerate(runs.dictionary.to_pylist())}, np.cumsum(size) - size
                own = b.slice(i, j - i)
                which = np.array([names.get(v, -1) for v in own.column("run_id").to_pylist()])
                slot = own.column("slot").to_numpy()
                ok = (which >= 0) & (slot < np.where(which >= 0, size[which], 0))
                rows = at[first[which[ok]] + slot[ok]]
                keep = pa.array(ok)
                out = pa.RecordBatch.from_arrays([own.column("run_id").filter(keep), items.take(pa.array(rows)), own.column("file_hash").filter(keep), pa.array(rows + start[i]), own.column("draw").filter(keep)], ["run_id", "item", "file_hash", "at", "draw"])
                yield out.filter(pc.is_valid(out.column("item")))

    spread = draws.repartition("file", "group_no").sortWithinPartitions("file", "group_no")
    return spread.mapInArrow(read, "run_id string, item long, file_hash long, at long, draw long")


def all_rows(fragments: DataFrame, runs: DataFrame, run: str, item: str) -> DataFrame:
    """(run_id, item, file_hash, at, draw) of every row of the runs listed; draw is null."""
    rows = fragments.select(F.col(run).alias("run_id"), F.col(item).cast("long").alias("item"), F.xxhash64("_metadata.file_path").alias("file_hash"), F.col("_metadata.row_index").alias("at"))
    return rows.filter("item is not null").join(runs.select("run_id"), "run_id").withColumn("draw", F.lit(None).cast("long"))


def first_deliveries(fragments: DataFrame, rows: DataFrame, item: str) -> DataFrame:
    """Those of rows (run_id, item, file_hash, at, draw) that are the first of their item in the whole table."""
    rows = materialized(rows)
    bits, words = filter_words(rows.select(F.xxhash64("item").alias("h")), rows.count())
    held = fragments.sparkSession.sparkContext.broadcast(words)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(may_hold(bits, held.value, b.column("h").to_numpy().view(np.uint64))))

    place = F.col(item).cast("long").alias("item"), F.xxhash64("_metadata.file_path").alias("file_hash"), F.col("_metadata.row_index").alias("at")
    scan = fragments.select(*place).filter("item is not null").select("item", F.xxhash64("item").alias("h"), "file_hash", "at").mapInArrow(keep, "item long, h long, file_hash long, at long")
    first = scan.groupBy("item").agg(F.min(F.struct("file_hash", "at")).alias("first")).select("item", "first.*")
    return materialized(rows.join(first, ["item", "file_hash", "at"]).select("run_id", "item", "draw"))


def block_sample(fragments: DataFrame, design: DataFrame, seed: int = SEED, run: str = "run_id", item: str = "ordinal") -> DataFrame:
    """(run_id, ordinal, draw): for each run of design (run_id, capacity) min(capacity, its fragments) distinct fragments.

    draw numbers the accepting draw; it is null where the run was taken whole. Runs without rows, and capacities that
    are null or below 1, give none; of a run listed twice the larger capacity counts. Rows with a null item or run are
    no fragments of any run; a fragment delivered under two runs is one of the first. `fragments` must be read straight
    from Parquet.
    """
    design = design.filter("capacity > 0 and run_id is not null").groupBy("run_id").agg(F.max("capacity").alias("capacity"))
    blocks = run_blocks(materialized(row_groups(fragments)), run).join(design.select("run_id"), "run_id", "left_semi")
    blocks = materialized(blocks.withColumn("block", F.row_number().over(Window.partitionBy("run_id").orderBy("file_hash", "group_no")) - 1))
    runs = blocks.groupBy("run_id").agg(F.sum("n").alias("n"), F.max("n").alias("tallest"), F.count(F.lit(1)).alias("blocks"))
    runs = materialized(runs.join(design, "run_id"))
    parts: list[DataFrame] = []

    def counted(few: DataFrame) -> DataFrame:
        """few (runs), with the exact number of fragments as n; those of runs that are taken whole go to the result."""
        rows = first_deliveries(fragments, all_rows(fragments, few, run, item), item)
        exact = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("exact"))
        known = checkpointed(few.join(exact, "run_id", "left").withColumn("n", F.coalesce("exact", F.lit(0))).drop("exact"))
        parts.append(rows.join(known.filter("n <= capacity").select("run_id"), "run_id"))
        return known.filter("n > capacity")

    # Runs that may have no more fragments than their capacity are counted exactly: at most 2 * capacity rows each.
    left = runs.filter("n > 2 * capacity").unionByName(counted(runs.filter("n <= 2 * capacity")))
    rate, trusted = 1.1, False
    while not left.isEmpty():
        # Draws expected until `capacity` distinct fragments are accepted, with a margin; doubled until that is so.
        need = F.expr("blocks * tallest * ln(n / (n - capacity))")
        many = left.withColumn("draws", F.ceil(F.lit(rate) * need + 8 * F.sqrt(need) + 64).cast("long"))
        # A run's draws are cut into ranges, so that none is made in one task.
        steps = F.explode(F.sequence(F.lit(0), F.expr(f"(draws - 1) div {STEP}")))
        each = many.select("*", steps.alias("step")).repartition(F.col("run_id"), F.col("step"))
        each = each.select("*", F.explode(F.sequence(F.col("step") * STEP, F.least(F.col("draws"), (F.col("step") + 1) * STEP) - 1)).alias("draw"))
        pick = lambda salt, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "run_id", "draw"), F.col(most))
        each = each.select("run_id", "draw", pick("block", "blocks").alias("block"), pick("slot", "tallest").alias("slot"))
        once = each.groupBy("run_id", "block", "slot").agg(F.min("draw").alias("draw"))  # later draws of it are rejected
        exist = once.join(blocks, ["run_id", "block"]).filter("slot < n")
        accepted = first_deliveries(fragments, drawn_rows(exist.select("run_id", "file", "file_hash", "group_no", "start", "slot", "draw"), run, item), item)
        got = accepted.groupBy("run_id").agg(F.count(F.lit(1)).alias("got"))
        state = checkpointed(left.join(got, "run_id", "left").withColumn("full", F.coalesce("got", F.lit(0)) >= F.col("capacity")).drop("got"))
        done = accepted.join(state.filter("full").select("run_id", "capacity"), "run_id").withColumn("place", F.lpad(F.hex("draw"), 16, "0"))
        # The first `capacity` accepting draws: ranges of 65536 draws are counted, and only the one that holds the cut is ranked.
        parts.append(bottom_k_per_group(done, ["run_id"], "place", "item", "capacity", digits=12).select("run_id", "item", "draw"))
        left, rate = state.filter("not full").drop("full"), rate * 2
        if not trusted and not left.isEmpty():  # so many redeliveries that the rows say little: count these runs exactly
            left, trusted = counted(left), True
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("run_id", F.col("item").alias("ordinal"), "draw")
