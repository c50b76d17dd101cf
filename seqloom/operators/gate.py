"""The k-mer gate: panel k-mers, the reads' hits among them, and the verdict of each fragment."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.common import checkpointed, materialized, spread
from seqloom.constants import ALPHABET, KMER, MIN_COVERED, MIN_HITS
from seqloom.functions.dust import dust_udf
from seqloom.functions.seq import map_words, narrow_shared, narrow_word, reverse_complement, with_kmers, with_narrow_segments


def target_kmers(records: DataFrame, k: int = KMER) -> DataFrame:
    """(kmer, records): the distinct canonical k-mers of the panel's records, and how many records hold each."""
    return with_kmers(spread(records.filter("not is_host"), "sequence"), ["rec_ordinal"], "sequence", k).select("rec_ordinal", "kmer").distinct().groupBy("kmer").agg(F.count(F.lit(1)).alias("records"))


def panel_kmers(records: DataFrame, k: int = KMER) -> DataFrame:
    """(kmer): the distinct k-mers alone, in one shuffle; all that the gate needs."""
    return with_kmers(spread(records.filter("not is_host"), "sequence"), [], "sequence", k).select("kmer").distinct()


def fragments_once(fragments: DataFrame) -> DataFrame:
    """(ordinal, run_id, r1, r2): a redelivered fragment counts once. Rows with a null ordinal are left out."""
    return fragments.filter("ordinal is not null").groupBy("ordinal").agg(F.min("run_id").alias("run_id"), F.min("r1").alias("r1"), F.min("r2").alias("r2"))


def read_ends(fragments: DataFrame) -> DataFrame:
    """(ordinal, mate, sequence): the ends of each fragment; a null end is no end."""
    ends = F.array(F.struct(F.lit(1).alias("mate"), F.col("r1").alias("sequence")), F.struct(F.lit(2).alias("mate"), F.col("r2").alias("sequence")))
    return fragments.select("ordinal", F.inline(ends)).filter("sequence is not null")


def both_strands(ends: DataFrame) -> DataFrame:
    """(end, sequence): ends (ordinal, mate 1 or 2, sequence) as read and reverse-complemented, upper-case. Ordinals are below 2**61."""
    up = F.upper("sequence")
    end = F.shiftleft(F.col("ordinal").cast("long"), 2).bitwiseOR((F.col("mate").cast("long") - 1) * 2)
    return ends.select(F.inline(F.array(F.struct(end.alias("end"), up.alias("sequence")), F.struct((end + 1).alias("end"), reverse_complement(up).alias("sequence")))))


def hit_runs(ends: DataFrame, records: DataFrame, k: int = KMER) -> DataFrame:
    """(ordinal, mate, runs): for each end with k-mers of the panel's records, the sorted runs of their places (see _run).

    Reads of both strands and the panel meet by the words of their segments, one row for some four k-mers, and what else
    they share is in the numbers beside the words. Segments whose word a Bloom filter of the panel rules out are dropped
    in the task that makes them.
    """
    records = records.filter("not is_host").select("sequence")
    letters = records.agg(F.coalesce(F.sum(F.length("sequence").cast("long")), F.lit(0))).first()[0]
    records = spread(records, "sequence")
    # there is a word in some four letters; more words make the filter let more through, never less
    only = word_test(records, letters // 4, k)
    oriented = both_strands(ends).withColumn("letters", F.length("sequence"))
    reads = with_narrow_segments(oriented, ["end", "letters"], "sequence", k, only=only)
    # a strand's places are counted from the end's beginning: of the reverse strand, base + before is the last k-mer's place
    base = F.when(F.col("end").bitwiseAND(F.lit(1)) == 1, F.col("letters") - k - F.col("pos")).otherwise(F.col("pos"))
    reads = reads.select("end", base.alias("base"), "a", "b")
    before, shared = narrow_shared("a", "b", "pa", "pb", k)
    panel = with_narrow_segments(records, [], "sequence", k).select(F.col("a").alias("pa"), F.col("b").alias("pb"))
    met = reads.join(panel.hint("merge"), narrow_word("a") == narrow_word("pa")).select("end", "base", before.alias("before"), shared.alias("n")).filter("n > 0")
    first = F.when(F.col("end").bitwiseAND(F.lit(1)) == 1, F.col("base") + F.col("before") - F.col("n") + 1).otherwise(F.col("base") - F.col("before"))
    runs = met.select(F.shiftright("end", 1).alias("end"), _run(first, F.col("n")).alias("run")).groupBy("end").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    return runs.select(F.shiftright("end", 1).alias("ordinal"), (F.col("end").bitwiseAND(F.lit(1)) + 1).cast("int").alias("mate"), "runs")


def _run(first: Column, n: Column) -> Column:
    """A run of n (up to 7) places from first on, as one number; in their order runs are sorted by their first place."""
    return F.shiftleft(first.cast("long"), 3).bitwiseOR(n.cast("long"))


def _first(run: Column) -> Column:
    return F.shiftright(run, 3)


def _after(run: Column) -> Column:
    return F.shiftright(run, 3) + run.bitwiseAND(F.lit(7))


def _union(runs: str, more: int = 0) -> Column:
    """How many places lie in the sorted runs, each prolonged by `more`."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))

    def add(acc: Column, run: Column) -> Column:
        after = _after(run) + more
        return F.struct(F.greatest(acc.end, after).alias("end"), (acc.sum + F.greatest(F.lit(0).cast("long"), after - F.greatest(acc.end, _first(run)))).alias("sum"))

    return F.aggregate(runs, start, add, lambda acc: acc.sum)


def _places(runs: str) -> Column:
    """The distinct places of runs."""
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.sequence(_first(r), _after(r) - 1)))).cast("array<int>")


def kmer_hits(ends: DataFrame, kmers: DataFrame, k: int = KMER, words: DataFrame | None = None) -> DataFrame:
    """(ordinal, mate, pos): places of the ends' k-mers that are in the panel (left semi-join); kmers: the panel's records, or a table of its k-mers.

    Records are searched by hit_runs. Of a table, the Bloom filter drops most k-mers of the reads inside the task that makes them, so that about the true
    hits are shuffled to the exact join. Each panel k-mer is one row there, so no read k-mer multiplies; one that very
    many reads hold makes a skewed partition of the reads' side, which adaptive execution splits. words: the filter of
    kmers, where an index has it stored; kmers must be a table then.
    """
    if "kmer" not in kmers.columns:
        return hit_runs(ends, kmers, k).select("ordinal", "mate", F.explode(_places("runs")).alias("pos"))
    kmers = materialized(kmers.select("kmer")) if words is None else kmers.select("kmer")
    reads = with_kmers(ends, ["ordinal", "mate"], "sequence", k, only=bloom_test(kmers, words=words))
    return reads.join(kmers, "kmer", "left_semi").select("ordinal", "mate", "pos")


def gate_states(ends: DataFrame, hits: DataFrame, masked: bool, k: int = KMER) -> DataFrame:
    """(ordinal, mate, hits, covered, present, evaluable, chain_ok) of every end; hits: kmer_hits or hit_runs.

    hits counts all places, masked ones too; covered is the union length of their windows; present and evaluable look
    at unmasked places only. Without a mask every valid k-mer is unmasked.
    """
    if "runs" not in hits.columns:
        hits = hits.groupBy("ordinal", "mate").agg(F.array_sort(F.collect_set(_run(F.col("pos"), F.lit(1)))).alias("runs"))
    # an end is evaluable if it has a k-mer of IUPAC letters; only masked ends need a look at each of them
    has_kmer = F.upper("sequence").rlike(f"[{ALPHABET}]{{{k}}}")
    whole = ends.select("ordinal", "mate", has_kmer.alias("evaluable"))
    present = F.lit(True)
    if masked:
        masks = checkpointed(ends.filter(has_kmer).select("ordinal", "mate", "sequence", dust_udf("sequence").alias("mask")).filter(F.size("mask") > 0))
        inside = lambda pos: F.coalesce(F.exists("mask", lambda m: (m.start <= pos) & (pos < m.end)), F.lit(False))
        hits = hits.join(masks.drop("sequence"), ["ordinal", "mate"], "left")
        present = F.col("mask").isNull() | F.exists(_places("runs"), lambda pos: ~inside(pos))
        open_ = with_kmers(masks, ["ordinal", "mate", "mask"], "sequence", k).filter(~inside(F.col("pos"))).groupBy("ordinal", "mate").agg(F.lit(True).alias("open_kmer"))
        seen = masks.select("ordinal", "mate", F.lit(True).alias("masked")).join(open_, ["ordinal", "mate"], "left")
        whole = whole.join(seen, ["ordinal", "mate"], "left").select("ordinal", "mate", F.when(F.col("masked"), F.coalesce("open_kmer", F.lit(False))).otherwise(F.col("evaluable")).alias("evaluable"))
    per = hits.select("ordinal", "mate", _union("runs").alias("hits"), _union("runs", k - 1).alias("covered"), present.alias("present"))
    out = whole.join(per, ["ordinal", "mate"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    chain = (F.coalesce("hits", F.lit(0)) >= MIN_HITS) & (F.coalesce("covered", F.lit(0)) >= MIN_COVERED)
    return out.select("ordinal", "mate", zero("hits"), zero("covered"), no("present"), no("evaluable"), chain.alias("chain_ok"))


def gate_verdicts(fragments: DataFrame, states: DataFrame) -> DataFrame:
    """(ordinal, verdict): Pass if some end has an unmasked hit and some end, maybe another, has a chain; else NotEvaluable if no end has an unmasked k-mer; else Negative."""
    per = states.groupBy("ordinal").agg(F.bool_or("present").alias("p"), F.bool_or("chain_ok").alias("c"), F.bool_or("evaluable").alias("e"))
    verdict = F.when(F.col("p") & F.col("c"), "Pass").when(F.coalesce("e", F.lit(False)), "Negative").otherwise("NotEvaluable")
    return fragments.select("ordinal").join(per, "ordinal", "left").select("ordinal", verdict.alias("verdict"))


def gate(fragments: DataFrame, kmers: DataFrame, masked: bool = True, words: DataFrame | None = None) -> DataFrame:
    """Verdicts of fragments (ordinal, r1, r2) against the panel's k-mers; kmers and words as in kmer_hits."""
    ends = read_ends(fragments)
    hits = kmer_hits(ends, kmers, words=words) if "kmer" in kmers.columns else hit_runs(ends, kmers)
    return gate_verdicts(fragments, gate_states(ends, hits, masked))


# ---- the probabilistic filter, for a bounded first look

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.random.default_rng(41).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
HASHES = 4
#: Bits of the filter's largest edition, 32 MB; it is only ever broadcast up to this.
MOST_BITS = 1 << 28


def bloom_bits(kmers: int) -> int:
    """Sixteen bits a k-mer, rounded up to a power of two, at least 64 and at most MOST_BITS."""
    return min(MOST_BITS, max(64, 1 << (16 * max(1, kmers) - 1).bit_length()))


def bloom_places(codes: np.ndarray, bits: int, hashes: int = HASHES) -> np.ndarray:
    """The bit places of each k-mer code (fixed-length bytes or 64-bit numbers), by double hashing; a row a k-mer."""
    letters = np.ascontiguousarray(codes).view(np.uint8).reshape(len(codes), -1)
    h = letters.astype(np.uint64) @ _MULTIPLIERS[: letters.shape[1]]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h2 = (h ^ _GOLDEN) * np.uint64(0xD6E8FEB86659FD93)
    h2 = (h2 ^ (h2 >> np.uint64(32))) | np.uint64(1)
    return (h[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * h2[:, None]) & np.uint64(bits - 1)


def _word_values(codes: pa.Array, bits: int, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of the filter that the codes touch, and their bits in them."""
    if pa.types.is_integer(codes.type):
        raw = codes.to_numpy()
    else:
        ends = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset : codes.offset + len(codes) + 1]
        raw = np.frombuffer(codes.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].reshape(len(codes), -1)  # all of one length
    p = np.unique(bloom_places(raw, bits, hashes).ravel())
    word, first = np.unique(p >> np.uint64(6), return_index=True)
    return word.astype(np.int64), np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first).view(np.int64)


def bloom_words(kmers: DataFrame, bits: int, hashes: int = HASHES) -> DataFrame:
    """(word, value): the non-zero 64-bit words of the filter of kmers (kmer), or-ed together by aggregation."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, _word_values(b.column(0), bits, hashes))), ["word", "value"])

    return kmers.select("kmer").mapInArrow(places, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value"))


#: 64-bit words of a block of the filter.
BLOCK = 1 << 15
_BLOCK_ROWS = "block int, data binary"


def _packed(pieces: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """A batch a block that isn't empty, its words compressed."""
    for n, piece in pieces:
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())], ["block", "data"])


def filter_blocks(kmers: DataFrame, bits: int, hashes: int = HASHES) -> DataFrame:
    """(block, data): the filter of kmers (kmer) in compressed blocks of BLOCK words, each once; kmers may repeat.

    A task sets its k-mers' bits in a filter of its own, so that it sends each block once, however many k-mers it has,
    and no word travels as a row.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _own_blocks((b.column(0) for b in batches if b.num_rows), bits, hashes)

    return _merged_blocks(kmers.select("kmer").mapInArrow(build, _BLOCK_ROWS))


def word_blocks(records: DataFrame, bits: int, hashes: int, k: int = KMER) -> DataFrame:
    """filter_blocks of the words of the records' segments; the worker that makes a task's words sets their bits."""
    return _merged_blocks(map_words(records, "sequence", lambda words: _own_blocks(map(pa.array, words), bits, hashes), _BLOCK_ROWS, k))


def _own_blocks(codes: Iterable[pa.Array], bits: int, hashes: int) -> Iterator[pa.RecordBatch]:
    """The packed blocks of a task's own filter."""
    own = np.zeros(bits // 64, dtype=np.int64)
    for c in codes:
        word, value = _word_values(c, bits, hashes)
        own[word] |= value
    yield from _packed((n, own[n * BLOCK :][:BLOCK]) for n in range(-(-len(own) // BLOCK)))


def _merged_blocks(blocks: DataFrame) -> DataFrame:
    """The tasks' blocks, or-ed together."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                piece = np.frombuffer(zlib.decompress(data), dtype=np.int64)
                own[n] = own[n] | piece if n in own else piece
        yield from _packed(own.items())

    return blocks.repartition("block").mapInArrow(merge, _BLOCK_ROWS)


def stored_blocks(words: DataFrame) -> DataFrame:
    """(block, data) of stored words (word, value), as filter_blocks has them; the last block may be longer than the filter."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            word, value = b.column(0).to_numpy(), b.column(1).to_numpy()
            for n in np.unique(word // BLOCK).tolist():
                here = word // BLOCK == n
                own.setdefault(n, np.zeros(BLOCK, dtype=np.int64))[word[here] % BLOCK] |= value[here]
        yield from _packed(own.items())

    return words.repartition(F.expr(f"word div {BLOCK}")).select("word", "value").mapInArrow(gather, _BLOCK_ROWS)


def bloom_summary(kmers: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(inserted, bits, hashes, fill, false_positive_rate) of the filter of kmers; words: its words, if they are stored."""
    n = kmers.count()
    bits = bloom_bits(n)
    fill = F.coalesce(F.sum(F.bit_count("value")), F.lit(0)) / F.lit(float(bits))
    rows = (bloom_words(kmers, bits) if words is None else words).agg(fill.alias("fill"))
    return rows.select(F.lit(n).cast("long").alias("inserted"), F.lit(bits).cast("long").alias("bits"), F.lit(HASHES).alias("hashes"), "fill", F.pow("fill", F.lit(float(HASHES))).alias("false_positive_rate"))


#: The filter that this process has inflated last, by its name.
_INFLATED: dict[str, np.ndarray] = {}


def _inflated(name: str, held: Broadcast, bits: int) -> np.ndarray:
    """The words of a filter that was broadcast in compressed blocks; inflated once in each worker process, never on the driver."""
    if name not in _INFLATED:
        _INFLATED.clear()  # a stage uses one; executors' memory is short
        filled = np.zeros(bits // 64, dtype=np.int64)
        for n, data in held.value:
            here = filled[n * BLOCK :][:BLOCK]
            here[:] = np.frombuffer(zlib.decompress(data), dtype=np.int64)[: len(here)]
        _INFLATED[name] = filled
    return _INFLATED[name]


def bloom_test(kmers: DataFrame, count: int | None = None, words: DataFrame | None = None, hashes: int = HASHES) -> Callable[[np.ndarray], np.ndarray]:
    """Whether each of an array of codes may be in kmers (all of one length): no true one is missed.

    count: the number of kmers or more, where it is known; else they are counted. words: bloom_words of kmers, of as many
    bits as their number asks for, where they are stored. Fewer hashes are cheaper to make and let some more through.

    The filter is at most 32 MB. It passes the driver in compressed blocks, one partition of them at a time. A panel of so many k-mers that this many bits fill up lets more through,
    never less. An empty panel lets nothing through.
    """
    bits = bloom_bits(kmers.count() if count is None else count)
    return _blocks_test(filter_blocks(kmers, bits, hashes) if words is None else stored_blocks(words), bits, hashes)


def word_test(records: DataFrame, count: int, k: int = KMER, hashes: int = 2) -> Callable[[np.ndarray], np.ndarray]:
    """bloom_test of the words of the records' segments, about `count`."""
    bits = bloom_bits(count)
    return _blocks_test(word_blocks(records, bits, hashes, k), bits, hashes)


def _blocks_test(found: DataFrame, bits: int, hashes: int) -> Callable[[np.ndarray], np.ndarray]:
    """bloom_test by the filter's blocks."""
    held, name = found.sparkSession.sparkContext.broadcast([(r.block, bytes(r.data)) for r in found.toLocalIterator()]), uuid.uuid4().hex

    def test(codes: np.ndarray) -> np.ndarray:
        p = bloom_places(codes, bits, hashes)
        w = _inflated(name, held, bits).view(np.uint64)[(p >> np.uint64(6)).astype(np.int64)]
        return ((w >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)

    return test
