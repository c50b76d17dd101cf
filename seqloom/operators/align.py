"""Reads against contigs: shared k-mers as seeds, chains of seeds on a diagonal, and a banded affine-gap local alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import spread
from seqloom.constants import GAP_EXTEND, GAP_OPEN, KMER, MATCH, MIN_COVERED, MIN_HITS, MIN_SCORE, MISMATCH
from seqloom.functions.seq import reverse_complement, segment_kmers, shared_kmers, with_segments
from seqloom.operators import gate

#: Diagonals to either side of a chain's that the alignment may visit.
BAND = 12
#: Letters from one contig tile to the next, at least.
TILE = 4096
#: Bits a contig k-mer below which a filter of bounded size would let nearly all through.
FILTER_BITS = 4
#: Parts in which the places of a simple repeat's k-mer are joined.
PARTS = 16


def _unpacked_end() -> list[Column]:
    """ordinal, mate and strand of the column end, an oriented end as one number, which keeps the many rows of seeds narrow."""
    mate = (F.shiftright("end", 1).bitwiseAND(F.lit(1)) + 1).cast("int")
    strand = F.when(F.col("end").bitwiseAND(F.lit(1)) == 1, "-").otherwise("+")
    return [F.shiftright("end", 2).alias("ordinal"), mate.alias("mate"), strand.alias("strand")]


def contig_id(name: Column | str = "name") -> Column:
    """A contig's number in the rows of seeds: a digest of its name, distinct for the contigs of one reference (see numbered)."""
    return F.xxhash64(name)


def numbered(contigs: DataFrame) -> DataFrame:
    """contigs with their contig_id as cid; two names of one number end the query with an error."""
    twice = contigs.select("name", contig_id().alias("cid")).distinct().groupBy("cid").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError("two contig names have one digest; rename one of them")
    return contigs.withColumn("cid", contig_id())


def _prefilter(contigs: DataFrame, refs: DataFrame, k: int) -> Callable[[np.ndarray], np.ndarray] | None:
    """A test that drops most words no contig holds; none where the contigs are too long for a bounded filter to tell."""
    most = contigs.agg(F.coalesce(F.sum(F.greatest(F.length("sequence") - (k - 1), F.lit(0)).cast("long")), F.lit(0))).first()[0]
    return gate.bloom_test(refs.select(F.col("word").alias("kmer")), most, hashes=2) if most * FILTER_BITS <= gate.MOST_BITS else None


def contig_segments(contigs: DataFrame, k: int = KMER) -> DataFrame:
    """(cid, at, word, beside, simple): the k-mers of the contigs' given strand in segments of one word each (see with_segments): what an index stores for the aligner."""
    rows = spread(contigs.select(contig_id().alias("cid"), "sequence"), "sequence")
    return with_segments(rows, ["cid"], "sequence", k).withColumnRenamed("pos", "at")


def contig_seeds(contigs: DataFrame, k: int = KMER) -> DataFrame:
    """(cid, at, kmer): every k-mer of the contigs' given strand and its place, spelled out from the segments."""
    return segment_kmers(contig_segments(contigs, k).withColumnRenamed("at", "pos"), ["cid"], k).withColumnRenamed("pos", "at")


def _seeds(ends: DataFrame, contigs: DataFrame, k: int, refs: DataFrame | None = None) -> DataFrame:
    """(end, cid, diagonal, pos, n): n successive k-mers from pos on of an oriented end, which a contig holds on a diagonal; each of its places is in one row.

    Reads and contigs meet by the words of their segments, as numbers; what else two segments share is in the numbers
    beside the words. Pairs of read and contig without a common k-mer never leave the join. Segments of reads whose word
    a Bloom filter of the contigs rules out are dropped in the task that makes them, before the shuffle.
    Low-complexity stretches give seeds like all others. The places of a simple repeat's word are spread over PARTS
    parts, and the reads' word is sent to each, so that no task joins all of them; of other frequent words adaptive
    execution splits the skewed partitions. refs: contig_segments, if they are stored.
    The rows come partitioned by end and contig, as all that follows needs them.
    """
    refs = contig_segments(contigs, k) if refs is None else refs
    only = _prefilter(contigs, refs, k)
    reads = with_segments(gate.both_strands(ends), ["end"], "sequence", k, only=only)
    refs = refs.select("cid", "at", "word", F.col("beside").alias("ref_beside"), F.when(F.col("simple"), F.pmod(F.hash("cid", "at"), F.lit(PARTS))).otherwise(0).alias("part"))
    parts = F.when(F.col("simple"), F.array(*map(F.lit, range(PARTS)))).otherwise(F.array(F.lit(0)))
    reads = reads.select("end", "pos", "word", "beside", F.explode(parts).alias("part"))
    before, shared = shared_kmers("beside", "ref_beside", k)
    # Spark takes the seeds for as small as the contigs' file: without the hint it would broadcast them
    met = reads.join(refs.hint("merge"), ["word", "part"]).filter(shared > 0)
    rows = met.select("end", "cid", (F.col("at") - F.col("pos")).alias("diagonal"), (F.col("pos") - before).alias("pos"), shared.cast("int").alias("n"))
    return rows.repartition("end", "cid")


def diagonal_chains(ends: DataFrame, contigs: DataFrame, k: int = KMER, min_hits: int = MIN_HITS, min_covered: int = MIN_COVERED) -> DataFrame:
    """(ordinal, mate, strand, name, diagonal, seeds, covered): seeds of one end on one diagonal of a contig, if they are enough.

    A seed is a k-mer of the oriented read at the same distance (diagonal = contig place - read place) in the contig;
    covered is the union length of the seeds on the read.
    """
    keys = ["end", "cid", "diagonal"]
    before = F.lag(F.col("pos") + F.col("n") - 1).over(Window.partitionBy(*keys).orderBy("pos"))
    rows = _seeds(ends, contigs, k).withColumn("new", F.least(F.lit(k), F.coalesce(F.col("pos") - before, F.lit(k))) + F.col("n") - 1)
    chains = rows.groupBy(*keys).agg(F.sum("n").alias("seeds"), F.sum("new").alias("covered")).filter((F.col("seeds") >= min_hits) & (F.col("covered") >= min_covered))
    return chains.join(numbered(contigs).select("cid", "name"), "cid").select(*_unpacked_end(), "name", "diagonal", "seeds", "covered")


def band_chains(ends: DataFrame, contigs: DataFrame, k: int = KMER, min_hits: int = MIN_HITS, min_covered: int = MIN_COVERED, seeds: DataFrame | None = None) -> DataFrame:
    """(end, cid, diagonal, anchor): every place at which an alignment of an oriented end with a contig must be tried.

    A place is a run of seeds on one diagonal, anchor the read place of its first seed. A run ends where the best
    alignment through it might, too: k * MATCH outweighs that many mismatches, so seeds less far apart are always joined.
    It stands if its seeds are enough, alone or together with those of another run in the same order on read and
    contig, whose diagonal is at most BAND away: the two sides of an insertion or a deletion.
    """
    keys = ["end", "cid"]
    by_place = Window.partitionBy(*keys, "diagonal").orderBy("pos")
    gap = F.col("pos") - F.lag(F.col("pos") + F.col("n") - 1).over(by_place)
    rows = _seeds(ends, contigs, k, seeds).withColumn("gap", gap)
    rows = rows.withColumn("run", F.sum(F.when(F.col("gap") <= k + k * MATCH // -MISMATCH, 0).otherwise(1)).over(by_place)).withColumn("new", F.least(F.lit(k), F.coalesce("gap", F.lit(k))) + F.col("n") - 1)
    runs = rows.groupBy(*keys, "diagonal", "run").agg(F.min("pos").alias("anchor"), F.max(F.col("pos") + F.col("n") - 1).alias("last"), F.sum("n").alias("seeds"), F.sum("new").alias("covered"))
    runs = runs.groupBy(*keys).agg(F.collect_list(F.struct("diagonal", "anchor", "last", "seeds", "covered")).alias("runs"))

    def stands(x: Column) -> Column:
        def partner(y: Column) -> Column:
            near = (F.abs(y.diagonal - x.diagonal) <= BAND) & (y.seeds + x.seeds >= min_hits)
            ordered = (y.anchor - x.anchor) * (y.anchor + y.diagonal - x.anchor - x.diagonal) > 0
            apart = F.greatest(x.anchor, y.anchor) - F.least(x.last, y.last) - k
            union = F.greatest(x.last, y.last) + k - F.least(x.anchor, y.anchor) - F.greatest(apart, F.lit(0))
            return near & ordered & (union >= min_covered)

        return ((x.seeds >= min_hits) & (x.covered >= min_covered)) | F.exists("runs", partner)

    return runs.select(*keys, F.inline(F.filter("runs", stands))).select(*keys, "diagonal", "anchor")


_CODE = np.full(256, 9, dtype=np.uint8)
for _i, _c in enumerate(b"ACGT"):
    _CODE[_c] = _i


def _encoded(reads: list[str], refs: list[str], diagonals: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The reads' letters as codes, and those of the contigs from `band` before each diagonal on; padding never matches."""
    n, longest, width = len(reads), max(map(len, reads)), 2 * band + 1
    query = np.full((n, longest), 8, dtype=np.uint8)
    target = np.full((n, longest + width), 7, dtype=np.uint8)
    for r in range(n):
        q = _CODE[np.frombuffer(reads[r].encode("ascii", "replace"), dtype=np.uint8)]
        query[r, : len(q)] = np.where(q == 9, 8, q)
        lo = int(diagonals[r]) - band  # the reference place of the first cell of the band
        piece = refs[r][max(0, lo) : max(0, lo + longest + width)]
        at = max(0, -lo)
        target[r, at : at + len(piece)] = _CODE[np.frombuffer(piece.encode("ascii", "replace"), dtype=np.uint8)]
    return query, target


def _through(equal: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """The first place from each anchor on whose letters match: a seed may begin with ambiguous letters, which never do."""
    later = equal & (np.arange(equal.shape[1]) >= np.asarray(anchors)[:, None])
    return np.where(later.any(axis=1), later.argmax(axis=1), anchors).astype(np.int64)


def ungapped(reads: list[str], refs: list[str], diagonals: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of banded_local for alignments on their own diagonal, and for which pairs they are its rows.

    They are where the score is so high that any gap would cost more than the letters that are left to gain: nearly all
    reads with one difference or none.
    """
    query, target = _encoded(reads, refs, diagonals, 0)
    equal = query == target[:, : query.shape[1]]
    anchors, gain = _through(equal, anchors), np.where(equal, MATCH, MISMATCH)
    n, length = len(reads), np.array([len(r) for r in reads])
    run, begin = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    best, first, last = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(query.shape[1]):
        fresh = (run <= 0) & (i <= anchors)
        begin = np.where(fresh, i, begin)
        run = np.where(fresh, 0, run) + gain[:, i]
        up = (run > best) & (i >= anchors)
        best, first, last = np.where(up, run, best), np.where(up, begin, first), np.where(up, i + 1, last)
    rows = np.stack([best, first, last, diagonals + first, diagonals + last], axis=1)
    return rows, best > MATCH * length - GAP_OPEN - GAP_EXTEND


def gaps_lose(reads: list[str], refs: list[str], diagonals: np.ndarray, anchors: np.ndarray, scores: np.ndarray, band: int = BAND) -> np.ndarray:
    """For which pairs every alignment with a gap scores below `scores`, those of ungapped: then its row is banded_local's.

    A gap costs least with one letter. Where no stretch of another diagonal in the band gains as much as that, a path that
    ends or begins off the anchor's diagonal loses; one that leaves it and comes back pays for a gap more than it has
    stretches. So the best score with any parts of the diagonal skipped at that price bounds all of them.
    """
    query, target = _encoded(reads, refs, diagonals, band)
    anchors = _through(query == target[:, band : band + query.shape[1]], anchors)
    n, width, gap = len(reads), 2 * band + 1, GAP_OPEN + GAP_EXTEND
    run, top = np.zeros((n, width), dtype=np.int32), np.zeros((n, width), dtype=np.int32)
    gains = np.empty((n, query.shape[1]), dtype=np.int32)
    for i in range(query.shape[1]):
        gain = (query[:, i : i + 1] == target[:, i : i + width]) * np.int32(MATCH - MISMATCH) + np.int32(MISMATCH)
        gains[:, i] = gain[:, band]
        np.maximum(run, 0, out=run)
        run += gain
        np.maximum(top, run, out=top)
    top[:, band] = 0
    off = top.max(axis=1)
    price = 2 * gap - off
    on, skipped, bound = np.zeros(n, dtype=np.int64), np.full(n, -(1 << 20), dtype=np.int64), np.zeros(n, dtype=np.int64)
    for i in range(query.shape[1]):
        on = np.maximum(on, skipped)
        on = np.where(i <= anchors, np.maximum(on, 0), on) + gains[:, i]
        bound = np.where(i >= anchors, np.maximum(bound, on), bound)
        skipped = np.where(i == anchors, on - price, np.maximum(skipped, on - price))
    return (off < gap) & (bound == scores)


def banded_local(reads: list[str], refs: list[str], diagonals: np.ndarray, band: int = BAND, anchors: np.ndarray | None = None) -> np.ndarray:
    """Best local alignments, all pairs at once: a row each of score, read start and end, reference start and end.

    Affine gaps; only cells within `band` of the given diagonal are visited. Letters other than ACGT never match.
    anchors: read places, one a pair; the best alignment that goes through this place of the given diagonal, so that a
    better one nearby doesn't hide it.
    """
    n, longest, width = len(reads), max(map(len, reads)), 2 * band + 1
    query, target = _encoded(reads, refs, diagonals, band)
    offset = np.arange(width, dtype=np.int32)
    low = np.int32(-(1 << 20))
    h = np.zeros((n, width), dtype=np.int32)
    f = np.full((n, width), low, dtype=np.int32)
    begin = np.tile(offset, (n, 1))  # where the alignment of a cell began: read place * 2**12 + cell of its row
    f_begin = begin.copy()
    best = np.zeros((n, 3), dtype=np.int64)  # score, end cell, begin
    stay = np.full((n, 1), low, dtype=np.int32)
    anchor = None if anchors is None else _through(query == target[:, band : band + longest], anchors)[:, None]
    for i in range(longest):
        match = np.where(query[:, i : i + 1] == target[:, i : i + width], MATCH, MISMATCH).astype(np.int32)
        # a gap in the reference: the previous row, one cell to the right
        right, right_f = np.hstack([h[:, 1:], stay]), np.hstack([f[:, 1:], stay])
        open_ = right - (GAP_OPEN + GAP_EXTEND)
        go = right_f - GAP_EXTEND
        b_right, fb_right = np.hstack([begin[:, 1:], begin[:, -1:]]), np.hstack([f_begin[:, 1:], f_begin[:, -1:]])
        f, f_begin = np.maximum(open_, go), np.where(open_ >= go, b_right, fb_right)
        fresh = h <= 0 if anchor is None else (h <= 0) & (i <= anchor)
        diagonal = np.where(fresh, 0, h) + match
        d_begin = np.where(fresh, (i << 12) + offset, begin)
        h, begin = np.maximum(diagonal, f), np.where(diagonal >= f, d_begin, f_begin)
        # a gap in the read: the best cell to the left in this row
        lifted = ((h + offset * GAP_EXTEND).astype(np.int64) << 12) | (width - 1 - offset)
        top = np.maximum.accumulate(lifted, axis=1)
        e = np.full_like(h, low)
        e[:, 1:] = (top[:, :-1] >> 12) - offset[1:] * GAP_EXTEND - GAP_OPEN
        source = (width - 1 - (top[:, :-1] & 0xFFF)).astype(np.int64)
        better = e[:, 1:] > h[:, 1:]
        moved = np.take_along_axis(begin, source, axis=1)
        begin = np.hstack([begin[:, :1], np.where(better, moved, begin[:, 1:])])
        h = np.maximum(h, e)
        if anchor is None:
            h = np.maximum(h, 0)
        else:
            h = np.where(i <= anchor, np.maximum(h, 0), np.maximum(h, low))
            elsewhere = (i == anchor) & (offset != band)
            h, f = np.where(elsewhere, low, h), np.where(i == anchor, low, np.maximum(f, low))
        cell = h.argmax(axis=1)
        score = h[np.arange(n), cell]
        up = score > best[:, 0] if anchor is None else (score > best[:, 0]) & (i >= anchor[:, 0])
        best[up] = np.stack([score, (i << 12) + cell, begin[np.arange(n), cell]], axis=1)[up]
    q_end, t_end, q_start, t_start = best[:, 1] >> 12, best[:, 1] & 0xFFF, best[:, 2] >> 12, best[:, 2] & 0xFFF
    base = np.asarray(diagonals, dtype=np.int64) - band
    return np.stack([best[:, 0], q_start, q_end + 1, base + q_start + t_start, base + q_end + t_end + 1], axis=1)


def contig_tiles(contigs: DataFrame, reach: int, stride: int) -> DataFrame:
    """(cid, tile, ref, role, target_group_ordinal): pieces of the contigs, one every `stride` letters, that go `reach` letters into the next."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column("sequence")[i].as_py() or ""
                starts = range(0, max(len(text), 1), stride)
                for j in range(0, len(starts), 1024):
                    some = starts[j : j + 1024]
                    same = [b.column(c).take(pa.array([i] * len(some))) for c in ("cid", "role", "target_group_ordinal")]
                    refs = pa.array([text[a : a + stride + reach] for a in some], pa.string())
                    yield pa.RecordBatch.from_arrays([same[0], pa.array([a // stride for a in some], pa.int64()), refs, *same[1:]], ["cid", "tile", "ref", "role", "target_group_ordinal"])

    rows = numbered(contigs).select("cid", "role", F.col("target_group_ordinal").cast("long").alias("target_group_ordinal"), "sequence")
    return rows.mapInArrow(cut, "cid long, tile long, ref string, role string, target_group_ordinal long")


def align(ends: DataFrame, contigs: DataFrame, min_score: int = MIN_SCORE, seeds: DataFrame | None = None) -> DataFrame:
    """Hits (ordinal, mate, role, target_group_ordinal, alignment_score, query_length, query_start, query_end, target_start, target_end, supplementary).

    Each end meets host and target contigs alike, by all of its seeds. Every chain of an
    end and contig (band_chains) is aligned through its anchor; alignments of the same read and contig ranges are one hit.
    A hit is supplementary if it overlaps the end's best hit by less than half of its own read range.
    Contigs come in tiles that hold all that the band of a chain can reach, so that a host chromosome is neither one key
    nor one row of the join. seeds: contig_segments of the contigs, if an index has them stored.
    """
    longest = ends.agg(F.max(F.length("sequence"))).first()[0] or 0
    reach = longest + 2 * BAND + 1
    stride = max(TILE, reach)
    start = F.greatest(F.col("diagonal") - BAND, F.lit(0))
    places = band_chains(ends, contigs, seeds=seeds).withColumn("base", start).withColumn("tile", F.floor(F.col("base") / stride))
    # each end is shuffled once as read, and turned where its chain is on the other strand
    whole = ends.select((F.shiftleft(F.col("ordinal").cast("long"), 1) + F.col("mate") - 1).alias("whole"), F.upper("sequence").alias("sequence"))
    turned = F.when(F.col("end").bitwiseAND(F.lit(1)) == 1, reverse_complement("sequence")).otherwise(F.col("sequence"))
    rows = places.withColumn("whole", F.shiftright("end", 1)).join(whole, "whole").drop("whole").withColumn("sequence", turned).join(contig_tiles(contigs, reach, stride), ["cid", "tile"])
    rows = rows.withColumn("ref", F.substring("ref", (F.col("base") - F.col("tile") * stride + 1).cast("int"), F.length("sequence") + 2 * BAND + 1))

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 1000):
                pdf = whole.iloc[i : i + 1000]
                reads, refs, diagonals, anchors = list(pdf["sequence"]), list(pdf["ref"]), (pdf["diagonal"] - pdf["base"]).to_numpy().astype(np.int64), pdf["anchor"].to_numpy()
                a, settled = ungapped(reads, refs, diagonals, anchors)
                rest = np.flatnonzero(~settled)
                if len(rest):
                    rest = rest[~gaps_lose([reads[i] for i in rest], [refs[i] for i in rest], diagonals[rest], anchors[rest], a[rest, 0])]
                if len(rest):
                    a[rest] = banded_local([reads[i] for i in rest], [refs[i] for i in rest], diagonals[rest], anchors=anchors[rest])
                size = pdf["sequence"].str.len().to_numpy()
                minus = (pdf["end"] & 1 == 1).to_numpy()
                out = pdf[["end", "cid", "role", "target_group_ordinal"]].copy()
                out["alignment_score"], out["query_length"] = a[:, 0], size
                out["query_start"], out["query_end"] = np.where(minus, size - a[:, 2], a[:, 1]), np.where(minus, size - a[:, 1], a[:, 2])
                out["target_start"], out["target_end"] = a[:, 3] + pdf["base"].to_numpy(), a[:, 4] + pdf["base"].to_numpy()
                yield out[out["alignment_score"] >= min_score]

    schema = "end long, cid long, role string, target_group_ordinal long, alignment_score int, query_length int, query_start int, query_end int, target_start long, target_end long"
    # by end, as the window below needs them too; of anchors of one alignment the hit is the same
    ranges = ["ordinal", "mate", "end", "cid", "query_start", "query_end", "target_start", "target_end"]
    found = rows.mapInPandas(extend, schema).select("*", *_unpacked_end()[:2])
    hits = found.repartition("ordinal", "mate").groupBy(*ranges).agg(*[F.max(c).alias(c) for c in ("role", "target_group_ordinal", "alignment_score", "query_length")])
    hits = hits.select("ordinal", "mate", "role", "target_group_ordinal", "alignment_score", "query_length", "query_start", "query_end", "target_start", "target_end")
    order = Window.partitionBy("ordinal", "mate").orderBy(F.desc("alignment_score"), "role", "target_group_ordinal", "target_start", "query_start")
    hits = hits.withColumn("_first", F.first(F.struct("query_start", "query_end")).over(order))
    overlap = F.least("query_end", "_first.query_end") - F.greatest("query_start", "_first.query_start")
    own = F.col("query_end") - F.col("query_start")
    return hits.withColumn("supplementary", F.greatest(overlap, F.lit(0)) * 2 < own).drop("_first").withColumn("target_group_ordinal", F.col("target_group_ordinal").cast("int"))
