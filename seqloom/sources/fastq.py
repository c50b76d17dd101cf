"""FASTQ, plain or gzip of any number of members, as a Python data source."""

from __future__ import annotations

import gzip
import hashlib
import os
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_SCHEMA = "file string, part long, at long, id string, sequence string"
_BATCH = 8192
#: Bytes of a plain file read by one task; a gzip file is one task's, as it can't be split.
PART_BYTES = 64 << 20
#: Decoded bytes of one link of a content digest.
LINK_BYTES = 64 << 20


class FastqError(ValueError):
    """A file that isn't whole FASTQ."""


def _located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _identity(path: str) -> tuple[int, int | None]:
    where, own = _located(path)
    info = where.get_file_info(own)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size, info.mtime_ns


def files_of(path: str) -> list[str]:
    """A file, several with commas between, or the files of a folder but hidden ones and markers."""
    out = []
    for one in path.split(","):
        where, own = _located(one)
        if where.get_file_info(own).type == fs.FileType.Directory:
            names = sorted(i.base_name for i in where.get_file_info(fs.FileSelector(own)) if i.type == fs.FileType.File)
            out += [f"{one.rstrip('/')}/{n}" for n in names if n[0] not in "._"]
        else:
            out.append(one)
    return out


def _decoded(path: str) -> BinaryIO:
    where, own = _located(path)
    stream = where.open_input_file(own)
    return gzip.GzipFile(fileobj=stream) if path.endswith(".gz") else stream


def _lines(stream: BinaryIO, size: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, from large reads."""
    rest = b""
    while block := stream.read(size):
        lines = (rest + block).split(b"\n")
        rest = lines.pop()
        for line in lines:
            yield line + b"\n"
    if rest:
        yield rest


def _is_record(lines: list[bytes]) -> bool:
    return lines[0].startswith(b"@") and lines[2].startswith(b"+") and len(lines[1].rstrip(b"\r\n")) == len(lines[3].rstrip(b"\r\n"))


def _record_start(path: str, begin: int, look: int = 40) -> int:
    """The place of the first record that begins at or after byte `begin`: the one phase of four lines in which all of the next lines are records."""
    where, own = _located(path)
    with where.open_input_file(own) as f:
        f.seek(begin - 1)
        lines = _lines(f)
        at = begin - 1 + len(next(lines, b""))  # the line that was cut ends here; nothing of it where begin follows a line's end
        ahead = [line for line, _ in zip(lines, range(look), strict=False)]
    if len(ahead) < 8:  # the last record or two: they belong to the part before, which reads on to the end
        return at + sum(map(len, ahead))
    fits = [p for p in range(4) if all(_is_record(ahead[i : i + 4]) for i in range(p, len(ahead) - 3, 4))]
    if len(fits) != 1:
        raise FastqError(f"{path}: no certain record start after byte {begin}")
    return at + sum(map(len, ahead[: fits[0]]))


def records(path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple[str, str]]:
    """(id, sequence) of each record: the id is the trimmed header, the sequence is verbatim.

    begin, end: of a plain file, only the records that begin in these bytes.
    """
    before = _identity(path)
    with _decoded(path) as stream:
        if begin:
            begin = _record_start(path, begin)
            stream.seek(begin)
        stop = _record_start(path, end) if end is not None and end < before[0] else None
        lines, n, at = _lines(stream), 0, begin
        while (stop is None or at < stop) and (head := next(lines, None)) is not None:
            at += len(head)
            head = head.rstrip(b"\r\n")
            if not head.startswith(b"@"):
                raise FastqError(f"{path}: record {n} does not start with @")
            parts = []
            for what in ("sequence", "plus line", "quality"):
                line = next(lines, None)
                if line is None:
                    raise FastqError(f"{path}: record {n} is truncated, its {what} is missing")
                at += len(line)
                parts.append(line.rstrip(b"\r\n"))
            name = head[1:].decode("utf-8").strip()
            if not name:
                raise FastqError(f"{path}: record {n} has no id")
            if not parts[1].startswith(b"+"):
                raise FastqError(f"{path}: record {n} has no + line")
            if len(parts[0]) != len(parts[2]):
                raise FastqError(f"{path}: record {n} has {len(parts[0])} letters and {len(parts[2])} qualities")
            yield name, parts[0].decode("latin-1")
            n += 1
    if before != _identity(path):
        raise FastqError(f"{path} changed while being read")


class _Part(InputPartition):
    def __init__(self, path: str, begin: int, end: int | None):
        self.path, self.begin, self.end = path, begin, end


class FastqReader(DataSourceReader):
    def __init__(self, options: dict):
        self.files, self.size = files_of(options["path"]), int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for f in self.files:
            size = 0 if f.endswith(".gz") else _identity(f)[0]
            cuts = range(0, max(size, 1), self.size)
            out += [_Part(f, a, a + self.size if a + self.size < size else None) for a in cuts]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names, reads, n = [], [], 0
        for name, sequence in records(partition.path, partition.begin, partition.end):
            names.append(name)
            reads.append(sequence)
            if len(names) == _BATCH:
                yield self._batch(partition, n, names, reads)
                n += len(names)
                names, reads = [], []
        yield self._batch(partition, n, names, reads)

    @staticmethod
    def _batch(part: _Part, first: int, names: list[str], reads: list[str]) -> pa.RecordBatch:
        n = len(names)
        columns = [pa.array([part.path] * n, pa.string()), pa.array([part.begin] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(names, pa.string()), pa.array(reads, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["file", "part", "at", "id", "sequence"])


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path): (file, part, at, id, sequence); at is a record's place in its part of the file.

    path: a file, several with commas between, or a folder. Plain files are split into parts of partBytes bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """(file, ordinal, id, sequence): ordinal is the dense place of a record in its file.

    Where a file is split, the records of its parts are counted first, and each part's ordinals follow those before it.
    """
    spark.dataSource.register(FastqSource)
    rows = spark.read.format("fastq").option("partbytes", part_bytes).load(path)
    if all(f.endswith(".gz") or _identity(f)[0] <= part_bytes for f in files_of(path)):
        return rows.select("file", F.col("at").alias("ordinal"), "id", "sequence")
    order = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("file").alias("_file"), F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("_n"))  # a row a part
    before = counts.select("_file", "_part", F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_before"))
    placed = rows.join(before, (rows.file == before._file) & (rows.part == before._part))
    return placed.select("file", (F.col("_before") + F.col("at")).alias("ordinal"), "id", "sequence")


def read_fragments(spark: SparkSession, r1: str, r2: str | None = None) -> DataFrame:
    """(ordinal, id, r1, r2) of a single-end file, or of the files of both ends, record by record.

    Several files of an end (commas between, or a folder) follow each other in the given order: the n-th file of r1 goes
    with the n-th of r2. Unequal numbers of files or records and pairs of different normalised ids end the query with an
    error.
    """
    from seqloom.functions.seq import normalized_read_id

    def end(path: str, read: str, name: str) -> DataFrame:
        files = files_of(path)
        rows = read_fastq(spark, path)
        if len(files) == 1:
            return rows.select(F.lit(0).alias("_nth"), "ordinal", normalized_read_id("id").alias(name), F.col("sequence").alias(read))
        number = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "file string, _nth int")
        return rows.join(number, "file").select("_nth", "ordinal", normalized_read_id("id").alias(name), F.col("sequence").alias(read))

    left = end(r1, "r1", "id")
    if r2 is not None:
        if len(files_of(r1)) != len(files_of(r2)):
            raise FastqError("the ends have different numbers of files")
        fault = F.when(F.col("r1").isNull() | F.col("r2").isNull(), "different record counts").when(~F.col("id").eqNullSafe(F.col("id2")), "Paired IDs do not match")
        both = left.join(end(r2, "r2", "id2"), ["_nth", "ordinal"], "full_outer")
        left = both.select("_nth", "ordinal", F.when(fault.isNotNull(), F.raise_error(fault)).otherwise(F.col("id")).alias("id"), "r1", "r2")
    else:
        left = left.withColumn("r2", F.lit(None).cast("string"))
    if len(files_of(r1)) == 1:
        return left.drop("_nth")
    sizes = left.groupBy(F.col("_nth").alias("_file")).agg(F.count(F.lit(1)).alias("_n"))  # a row a file
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = left.join(sizes.select("_file", before.alias("_before")), F.col("_nth") == F.col("_file"))
    return left.select((F.col("_before") + F.col("ordinal")).alias("ordinal"), "id", "r1", "r2")


def write_fastq(rows: DataFrame, read: str, path: str, compression: str = "none") -> None:
    """Rows (id and the column `read`) as FASTQ text in the folder `path`, with the best quality throughout; compression: none or gzip."""
    text = F.concat(F.lit("@"), "id", F.lit("\n"), read, F.lit("\n+\n"), F.regexp_replace(read, ".", "I"))
    rows.filter(F.col(read).isNotNull()).select(text.alias("value")).write.option("compression", compression).text(path)


def content_digests(spark: SparkSession, files: list[str]) -> dict[str, str]:
    """Of each file a digest of its decoded bytes: SHA-256 over the SHA-256 of each link of LINK_BYTES bytes.

    Tasks digest the links, those of a plain file one by one, those of a gzip file in one task; 32 bytes a link come back.
    """
    jobs = [(f, a, None if f.endswith(".gz") else LINK_BYTES) for f in files for a in ([0] if f.endswith(".gz") else range(0, max(1, _identity(f)[0]), LINK_BYTES))]

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, begin, size in pdf.itertuples(index=False):
                with _decoded(path) as f:
                    if begin:
                        f.seek(int(begin))
                    link = int(begin)
                    while True:
                        h, left = hashlib.sha256(), LINK_BYTES
                        while left and (block := f.read(min(left, 1 << 20))):
                            h.update(block)
                            left -= len(block)
                        if left < LINK_BYTES or link == int(begin):
                            out.append((path, link, h.hexdigest()))
                        if left or not pd.isna(size):
                            break
                        link += LINK_BYTES
            yield pd.DataFrame(out, columns=["file", "link", "digest"])

    rows = spark.createDataFrame(jobs, "file string, begin long, size long").repartition(min(len(jobs), 4 * spark.sparkContext.defaultParallelism))
    links = sorted(map(tuple, rows.mapInPandas(digest, "file string, link long, digest string").collect()))
    return {f: hashlib.sha256("".join(d for g, _, d in links if g == f).encode()).hexdigest() for f in files}


def input_digest(spark: SparkSession, r1: str, r2: str | None = None) -> str:
    """One digest of the mode and the ends' contents, each framed by its length."""
    ends = [files_of(p) for p in (r1, r2) if p]
    known = content_digests(spark, sorted({f for e in ends for f in e}))
    h = hashlib.sha256(b"seqloom-input-v2")
    for part in ("PE" if r2 else "SE", *["|".join(known[f] for f in e) for e in ends]):
        h.update(len(part).to_bytes(8, "big") + part.encode())
    return h.hexdigest()
