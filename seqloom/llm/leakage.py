"""Problem 7: evaluation texts that leak into training text.

Method: training suffix arrays. A suffix is a text from one of its words on. Only training suffixes whose first `words`
words occur in some item can match, so a filter of bounded size over the items' word runs first leaves out all others,
in one pass over the documents; what remains are passages, equal ones once. Their suffixes are range-partitioned and
sorted: each partition is one shard of the suffix array. Every test suffix is sent to the shards of its range and
binary-searched there. Of the training suffixes it meets, it reports those whose word before differs (a match begins)
and those whose word behind the first `words` differs (a match ends); beginnings and ends on one diagonal make the
maximal matches, so that each is reported once, whatever its length. Neither documents nor items pass the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import materialized
from seqloom.llm.filters import filter_words, may_hold
from seqloom.llm.repeats import _ranges

WORDS = 12
#: Suffixes of one beginning in one shard; those of a more frequent one are spread over several.
HOT = 50_000
#: Bytes of text handled at once in a task.
PORTION = 1 << 21
_ESCAPES = re.compile(r"\\+[nrt]")
_KEEP = bytes(i if 48 <= i < 58 or 97 <= i < 123 else 32 for i in range(256))
_RNG = np.random.default_rng(20250412)
_LETTER = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1 << 40, 1 << 62)) * 2 + 1


def plain(text: str) -> bytes:
    """The text lower-cased, with all but a-z and 0-9 as blanks; runs of backslashes with n, r or t after them are blanks."""
    if "\\" in text:
        text = _ESCAPES.sub(" ", text)
    return text.lower().encode("utf-8", "replace").translate(_KEEP)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Words:
    """The words of plain bytes: where each begins and ends, and a hash of each."""

    def __init__(self, data: bytes):
        parts, a = [], 0
        while a < len(data):
            b = data.find(b" ", min(a + PORTION, len(data)))  # a part ends at a blank
            b = len(data) if b < 0 else b
            parts.append([x + a if i < 2 else x for i, x in enumerate(self._part(np.frombuffer(data, dtype=np.uint8, count=b - a, offset=a)))])
            a = b
        self.start, self.end, self.hash = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, dtype=np.int64),) * 2 + (np.empty(0, dtype=np.uint64),)

    @staticmethod
    def _part(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        solid = np.zeros(len(b) + 2, dtype=np.int8)
        solid[1:-1] = b != 32
        step = np.diff(solid)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        size = 1 << max(16, len(b).bit_length())
        if _Words._powers is None or len(_Words._powers[0]) < size:
            _Words._powers = _powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))
        up, down = _Words._powers
        sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[b] * up[: len(b)], out=sums[1:])
        return start, end, (sums[end] - sums[start]) * down[start]

    _powers: tuple[np.ndarray, np.ndarray] | None = None


def run_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash of each run of `words` words, by its first; it only ever rules runs out."""
    n = max(0, len(hashes) - words + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        out += hashes[i : i + n] * _LETTER[i] * np.uint64(2 * i + 1)
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _texts(batch: pa.RecordBatch, key: str) -> Iterator[tuple[list, bytes, np.ndarray]]:
    """Keys, plain bytes and the end of each text in them (a blank stands between two), a portion at a time."""
    keys, texts, ends, n = [], [], [], 0
    for k, t in zip(batch.column(key).to_pylist(), batch.column("text"), strict=True):
        keys.append(k)
        texts.append(plain(t.as_py()))
        n += len(texts[-1]) + 1
        ends.append(n)
        if n >= PORTION:
            yield keys, b" ".join(texts), np.array(ends)
            keys, texts, ends, n = [], [], [], 0
    if keys:
        yield keys, b" ".join(texts), np.array(ends)


def _tests(items: DataFrame, words: int) -> DataFrame:
    """(item_id, digest, text): each item's words with single blanks between, for items of `words` words or more."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [plain(t.as_py()).split() for t in b.column("text")]
            keep = [i for i, w in enumerate(own) if len(w) >= words]
            yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(keep, pa.int64())), pa.array([b" ".join(own[i]).decode() for i in keep], pa.string())], ["item_id", "text"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null and item_id is not null").mapInArrow(clean, "item_id long, text string")
    return materialized(rows.select("item_id", F.sha2("text", 256).alias("digest"), "text"))


def _filter_words(tests: DataFrame, words: int) -> tuple[int, np.ndarray]:
    """The filter of the tests' word runs."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(run_hashes(_Words(t.as_py().encode()).hash, words).view(np.int64))], ["h"])

    runs = tests.mapInArrow(hashes, "h long")
    return filter_words(runs, runs.count())


def _passages(documents: DataFrame, tests: DataFrame, words: int) -> DataFrame:
    """(doc_id, word_offset, digest, text): the stretches of each document all of whose word runs the filter lets pass."""
    bits, found = _filter_words(tests, words)
    held = documents.sparkSession.sparkContext.broadcast(found)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, offsets, texts = [], [], []
            for keys, data, ends in _texts(batch, "doc_id"):
                w = _Words(data)
                h = run_hashes(w.hash, words)
                if not len(h):
                    continue
                at = np.flatnonzero(may_hold(bits, held.value, h))
                of = np.searchsorted(ends, w.start[at], "right")
                inside = of == np.searchsorted(ends, w.start[at + words - 1], "right")
                at, of = at[inside], of[inside]
                if not len(at):
                    continue
                head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])])
                tail = np.r_[head[1:], len(at)] - 1
                first_word = np.searchsorted(w.start, np.where(of[head] > 0, ends[of[head] - 1], 0))
                for i, j, d, f in zip(at[head], at[tail] + words - 1, of[head], first_word, strict=True):
                    docs.append(keys[d])
                    offsets.append(int(i - f))
                    texts.append(b" ".join(data[w.start[i] : w.end[j]].split()).decode())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "word_offset", "text"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null and doc_id is not null").mapInArrow(cut, "doc_id long, word_offset long, text string")
    return materialized(rows.select("doc_id", "word_offset", F.sha2("text", 256).alias("digest"), "text"))


def _suffixes(texts: DataFrame, words: int, side: int) -> DataFrame:
    """(begin, part, side, digest, pos, before, behind): the suffixes of each distinct text, by their first `words` words and the words around these."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for digest, t in zip(b.column("digest").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = t.split(" ")
                n = len(own) - words + 1
                cols[0] += [" ".join(own[i : i + words]) for i in range(n)]
                cols[1] += [digest] * n
                cols[2] += range(n)
                cols[3] += [None, *own[: n - 1]]
                cols[4] += [*own[words:], None]
                if len(cols[0]) >= 50_000:
                    yield batch_of(cols)
                    cols = [[], [], [], [], []]
            yield batch_of(cols)

    def batch_of(cols: list[list]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["begin", "digest", "pos", "before", "behind"])

    rows = texts.select("digest", "text").dropDuplicates(["digest"]).mapInArrow(explode, "begin string, digest string, pos long, before string, behind string")
    return rows.withColumns({"part": F.lit(0), "side": F.lit(side)})


def _shards(batches: Iterator[pa.RecordBatch], most: int = 100_000) -> Iterator[pa.Table]:
    """Rows that come sorted by (begin, part), in tables that hold all rows of each."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held).combine_chunks()
            last = pc.and_(pc.equal(t.column("begin"), t.column("begin")[-1]), pc.equal(t.column("part"), t.column("part")[-1]))
            cut = n - pc.sum(last).as_py()
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), n - cut
    if held:
        yield pa.Table.from_batches(held)


def _turns(group: np.ndarray, word: pa.ChunkedArray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (training row, test row) of one beginning whose `word` differs; a missing word differs from all.

    The training suffixes are an array sorted by (beginning, word); each test suffix is binary-searched for the range
    of its beginning and, within it, of its word, and takes what lies to either side of the latter.
    """
    code = pc.fill_null(pc.dictionary_encode(word.combine_chunks()).indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    wide = np.int64(int(code.max(initial=0)) + 2)
    code[train & (code == 1)] = 0  # no test has this one
    order = np.flatnonzero(train)
    array = group[order] * wide + code[order]
    sort = np.argsort(array, kind="stable")
    order, array = order[sort], array[sort]
    tests = np.flatnonzero(~train)
    low, high = np.searchsorted(array, group[tests] * wide), np.searchsorted(array, (group[tests] + 1) * wide)
    a, b = (np.searchsorted(array, group[tests] * wide + code[tests], s) for s in ("left", "right"))
    rows = np.concatenate([_ranges(low, a - low), _ranges(b, high - b)])
    return order[rows], np.concatenate([np.repeat(tests, a - low), np.repeat(tests, high - b)])


def _maximal(train: DataFrame, test: DataFrame, words: int, hot: int) -> DataFrame:
    """(train, test, longest, pos): of each pair of texts with a common run of words the longest one, and where it begins in train."""
    often = materialized(train.groupBy("begin").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("begin", (F.col("n") / hot).cast("int").alias("more")))
    if not often.isEmpty():
        parts = F.coalesce("more", F.lit(0)) + 1
        train = train.join(often, "begin", "left").withColumn("part", F.pmod(F.hash("digest", "pos"), parts)).drop("more")
        test = test.join(often, "begin", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("more")
    rows = train.unionByName(test).repartitionByRange("begin", "part").sortWithinPartitions("begin", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _shards(batches):
            fresh = np.ones(t.num_rows, dtype=bool)
            begin, part = t.column("begin").combine_chunks(), t.column("part").combine_chunks()
            fresh[1:] = pc.or_(pc.not_equal(begin[1:], begin[:-1]), pc.not_equal(part[1:], part[:-1])).to_numpy(zero_copy_only=False)
            group, is_train = np.cumsum(fresh), t.column("side").to_numpy() == 0
            pos = t.column("pos").to_numpy()
            for word, kind in (("before", 0), ("behind", 1)):
                a, b = _turns(group, t.column(word), is_train)
                digest = t.column("digest")
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (digest.take(pa.array(a)), digest.take(pa.array(b)), pa.array(pos[a] - pos[b]), pa.array(pos[a]), pa.array(np.full(len(a), kind, dtype=np.int32)))], ["train", "test", "diagonal", "pos", "kind"])

    turns = rows.mapInArrow(search, "train string, test string, diagonal long, pos long, kind int")
    line = ["train", "test", "diagonal"]
    nth = F.row_number().over(Window.partitionBy(*line, "kind").orderBy("pos"))
    # beginnings and ends alternate along a diagonal: the n-th end belongs to the n-th beginning
    matches = turns.withColumn("nth", nth).groupBy(*line, "nth").agg(F.min(F.when(F.col("kind") == 0, F.col("pos"))).alias("pos"), F.max(F.when(F.col("kind") == 1, F.col("pos"))).alias("last"))
    best = matches.groupBy("train", "test").agg(F.min(F.struct((F.col("pos") - F.col("last")).alias("short"), "pos")).alias("best"))
    return best.select("train", "test", (F.lit(words) - F.col("best.short")).alias("longest"), "best.pos")


def leaks(documents: DataFrame, items: DataFrame, words: int = WORDS, hot: int = HOT) -> DataFrame:
    """(doc_id, item_id, longest, word_offset): documents that share `words` or more consecutive words with an item.

    longest is the length in words of the longest verbatim match, word_offset its (first) place in the document.
    Null texts, rows with a null id, and texts with fewer words match nothing. Rows of one doc_id are one document and
    rows of one item_id one item: a pair of ids comes out once, with the longest match of any of their rows.
    """
    tests = _tests(items, words)
    passages = _passages(documents, tests, words)
    found = _maximal(_suffixes(passages, words, 0), _suffixes(tests, words, 1), words, hot)
    ids = tests.select("item_id", F.col("digest").alias("test")).distinct()
    where = passages.select("doc_id", "word_offset", F.col("digest").alias("train"))
    rows = where.join(found.join(ids, "test"), "train")
    best = rows.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("longest")).alias("short"), (F.col("word_offset") + F.col("pos")).alias("at"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.short")).alias("longest"), F.col("best.at").alias("word_offset"))


def without_leaks(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no leaked passage, all columns kept."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
