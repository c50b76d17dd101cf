"""Problem 2: records that say the same thing in another spelling.

Method: canonical records are range-partitioned and sorted (Spark's external sort), then each partition scans its
adjacent rows, comparing full keys. The row key is part of the sort order, so that a key held by a third of all rows
is spread over many partitions; the few runs that cross a partition's edge are joined up by one small record a
partition (digests of its first and last key, where its last run began).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import checkpointed, letters


def canonical_fasta(fasta: DataFrame) -> DataFrame:
    """(tbl, canon, key): the letters of each record; rows without any letter, with a null sequence or a null key are left out."""
    return fasta.select(F.lit("fasta").alias("tbl"), letters("sequence").alias("canon"), F.col("rec_ordinal").cast("long").alias("key")).filter((F.length("canon") > 0) & F.col("key").isNotNull())


def canonical_groups(groups: DataFrame) -> DataFrame:
    """(tbl, canon, key): the id and the sorted set of member ids, lower-cased, only a-z and 0-9 kept.

    Packed elements are split at ; and , first. Elements that are null, or empty once cleaned, are no members.
    A row with a null in either column, or a null key, is left out; an empty member list is an ordinary (empty) set.
    """
    clean = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    parts = F.flatten(F.transform(F.filter("member_ids", lambda m: m.isNotNull()), lambda m: F.split(m, "[;,]")))
    members = F.array_sort(F.array_distinct(F.filter(F.transform(parts, clean), lambda m: m != "")))
    canon = F.concat(clean(F.col("target_group_id")), F.lit("|"), F.array_join(members, ","))
    rows = groups.filter(F.col("target_group_id").isNotNull() & F.col("member_ids").isNotNull())
    return rows.select(F.lit("reference_groups").alias("tbl"), canon.alias("canon"), F.col("group_ordinal").cast("long").alias("key")).filter("key is not null")


def _runs(batch: pa.RecordBatch, last: tuple | None, start: int | None) -> tuple[np.ndarray, tuple, int]:
    """For each row the key of the first row of its run; `last` and `start` are the previous row's record and run.

    The record is compared in full: by part (the partition it was sorted in), tbl and canon.
    """
    part, tbl, canon, key = batch.column("part").to_numpy(), batch.column("tbl"), batch.column("canon"), batch.column("key").to_numpy()
    n = batch.num_rows
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = pc.or_(pc.not_equal(tbl[1:], tbl[: n - 1]), pc.not_equal(canon[1:], canon[: n - 1])).to_numpy(zero_copy_only=False)
    fresh[1:] |= part[1:] != part[:-1]
    fresh[0] = last is None or last != (part[0], tbl[0].as_py(), canon[0].as_py())
    began = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
    out = np.where(began >= 0, key[began], start if start is not None else 0)
    return out, (int(part[n - 1]), tbl[n - 1].as_py(), canon[n - 1].as_py()), int(out[-1])


def _digest(record: tuple) -> bytes:
    """SHA-256 of a record's table and full key: what the driver sees of it."""
    return hashlib.sha256(f"{record[1]}|{record[2]}".encode("utf-8", "replace")).digest()


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A small row a partition: digests of its first and last record, where its last run began, and whether it is one run."""
    first = last = start = None
    whole = True
    for b in batches:
        if b.num_rows:
            first = first or (b.column("part")[0].as_py(), b.column("tbl")[0].as_py(), b.column("canon")[0].as_py())
            _, last, start = _runs(b, last, start)
            whole = whole and last == first
    if first:
        yield pa.RecordBatch.from_pydict({"part": pa.array([first[0]], pa.int32()), "first": [_digest(first)], "last": [_digest(last)], "start": pa.array([start], pa.int64()), "whole": [whole]})


def copies(canon: DataFrame) -> DataFrame:
    """(tbl, representative, key) for each row of canon (tbl, canon, key); representative: the smallest equal key.

    canon must hold no nulls. Rows repeated byte for byte, key included, stay as many rows. An empty input gives none.
    Rows are sorted by the digest of their key before the key of the row, so that the bounds of the ranges, which Spark
    samples on the driver, stay small however long the texts are. A row keeps the number of the partition it was sorted
    in as a column, so the result may be united, coalesced or filtered like any other.
    """
    order = ["digest", "key"]
    rows = canon.select("tbl", "canon", "key", F.unhex(F.sha2(F.concat("tbl", F.lit("|"), "canon"), 256)).alias("digest"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = checkpointed(rows.select("tbl", "canon", "key", F.spark_partition_id().alias("part")))
    edges = rows.mapInArrow(_edges, "part int, first binary, last binary, start long, whole boolean")
    carried: dict[int, int] = {}  # by partition: where the run began that reaches over its lower edge; one record a partition
    last, start = None, None
    for e in sorted(edges.collect(), key=lambda e: e.part):  # two digests a partition
        reaches = last == e.first
        if reaches:
            carried[e.part] = start
        start = start if reaches and e.whole else e.start
        last = e.last

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start = None, None
        for whole in batches:
            part = whole.column("part").to_numpy()
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                b = whole.slice(i, j - i)
                own = int(part[i])
                if (last is None or last[0] != own) and own in carried:
                    last, start = (own, b.column("tbl")[0].as_py(), b.column("canon")[0].as_py()), carried[own]
                out, last, start = _runs(b, last, start)
                yield pa.RecordBatch.from_arrays([b.column("tbl"), pa.array(out, pa.int64()), b.column("key")], ["tbl", "representative", "key"])

    return rows.mapInArrow(scan, "tbl string, representative long, key long")


def collapsed(canon: DataFrame) -> DataFrame:
    """(tbl, representative, copies): one row for each distinct record, with the exact number of its rows."""
    return copies(canon).groupBy("tbl", "representative").agg(F.count(F.lit(1)).alias("copies"))


def redundant(canon: DataFrame) -> DataFrame:
    """(tbl, key_a, key_b): one row for each copy key_b of the smallest equal key key_a."""
    return copies(canon).filter("key <> representative").select("tbl", F.col("representative").alias("key_a"), F.col("key").alias("key_b"))
