"""Sequence functions as column expressions: complement, canonical forms, k-mers, read and sample names."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.constants import ALPHABET, COMPLEMENT, FORWARD_CODE, KMER, REVERSE_CODE


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reverse_complement(c: Column | str) -> Column:
    """Of upper-case IUPAC letters; other characters keep their place in the reversed text."""
    return F.translate(F.reverse(_col(c)), ALPHABET, COMPLEMENT)


def canonical_strand(c: Column | str) -> Column:
    """The smaller of a sequence and its reverse complement, in byte order."""
    return F.least(_col(c), reverse_complement(c))


def canonical_kmer(c: Column | str) -> Column:
    """A k-mer's code, a hex digit a letter: the smaller one of both strands in code order."""
    c = _col(c)
    return F.least(F.translate(c, ALPHABET, FORWARD_CODE), F.translate(F.reverse(c), ALPHABET, REVERSE_CODE))


_FORWARD, _REVERSE = np.full(256, ord("-"), dtype=np.uint8), np.full(256, ord("-"), dtype=np.uint8)
for _table, _digits in ((_FORWARD, FORWARD_CODE), (_REVERSE, REVERSE_CODE)):
    _table[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.frombuffer(_digits.encode(), dtype=np.uint8)
#: Windows encoded at once in a task: a worker's arrays of them, and the batches it sends, take some 10 MB.
_PORTION = 1 << 16


def _encoded(texts: pa.StringArray, k: int, canonical: bool, only: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """The text's number, the place and the code of each k-mer, some at a time; texts hold one byte a character."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    begin, count = offsets[:-1], np.diff(offsets) - k + 1
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]), _PORTION):
        n = np.arange(low, min(low + _PORTION, int(ends[-1])))
        of = np.searchsorted(ends, n, "right")
        pos = n - (ends[of] - count[of])
        at = begin[of] + pos
        first = int(at[0])  # only the letters of these windows are looked at, so memory doesn't grow with the text
        own = raw[first : int(at[-1]) + k]
        forward, backward, at = _FORWARD[own], _REVERSE[own], at - first
        odd = np.concatenate([[0], np.cumsum(forward == ord("-"))])
        good = odd[at + k] == odd[at]
        of, pos, at = of[good], pos[good], at[good]
        code = np.ascontiguousarray(sliding_window_view(forward, k)[at]).view(f"S{k}").ravel()
        if canonical and len(code):
            other = np.ascontiguousarray(sliding_window_view(backward, k)[at][:, ::-1]).view(f"S{k}").ravel()
            code = np.where(other < code, other, code)
        if only is not None and len(code):
            chosen = only(code)
            of, pos, code = of[chosen], pos[chosen], code[chosen]
        places = np.arange(0, k * len(code) + 1, k, dtype=np.int32)
        yield of, pos, pa.Array.from_buffers(pa.string(), len(code), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(code))])


def with_kmers(df: DataFrame, keep: list[str], text: str, k: int = KMER, canonical: bool = True, only: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """keep columns, pos (0-based) and kmer: every canonical k-mer of IUPAC letters in `text`, any case.

    Not canonical: the k-mers of the given strand only, in the same code.
    Another character ends all k-mers that would hold it. Null texts and texts shorter than k give no row.
    Arrow batches are encoded as arrays, some 65 thousand k-mers at a time, however long a text is. `only` picks, from an
    array of codes, those to keep, before they become rows.
    """
    df = df.select(*keep, F.regexp_replace(F.upper(text), f"[^{ALPHABET}]", "-").alias("_t")).filter(F.length("_t") >= k)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for of, pos, kmer in _encoded(batch.column(batch.num_columns - 1), k, canonical, only):
                rows = pa.array(of)
                kept = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pos.astype(np.int32)), kmer], [f.name for f in fields])

    fields = [df.schema[c] for c in keep] + [T.StructField("pos", T.IntegerType()), T.StructField("kmer", T.StringType())]
    return df.mapInArrow(explode, T.StructType(fields))


#: Letters of the longest period of a simple repeat: words of one meet themselves at very many places.
PERIOD = 6
#: Letters that a k-mer has besides its word: two segments' letters beside a word of k - SPAN letters fit in one number.
SPAN = 6
_DIGIT = np.full(256, 16, dtype=np.uint8)
_DIGIT[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = [int(c, 16) for c in FORWARD_CODE]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _span(k: int) -> int:
    if not 1 < k <= 21:
        raise ValueError("segments are made for k-mers of 2 to 21 letters")
    return min(SPAN, k - 1)


def _segments(texts: pa.StringArray, k: int, only: Callable[[np.ndarray], np.ndarray] | None) -> Iterator[tuple[np.ndarray, ...]]:
    """The text's number, word place, word, letters beside it (see with_segments) and the simple words of each segment, some at a time."""
    span = _span(k)
    m = k - span
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    begin, count = offsets[:-1], np.diff(offsets) - k + 1
    ends = np.cumsum(count)
    four = np.uint64(4)
    for low in range(0, int(ends[-1]), _PORTION):
        n = np.arange(low, min(low + _PORTION, int(ends[-1])))
        of = np.searchsorted(ends, n, "right")
        pos = n - (ends[of] - count[of])
        at = begin[of] + pos
        first = int(at[0])
        digit = _DIGIT[raw[first : int(at[-1]) + k]]
        at = at - first
        odd = np.concatenate([[0], np.cumsum(digit == 16)])
        good = odd[at + k] == odd[at]
        of, pos, at = of[good], pos[good], at[good]
        if not len(at):
            continue
        wide = (digit & 15).astype(np.uint64)
        words = np.zeros(len(wide) - m + 1, dtype=np.uint64)
        for j in range(m):
            words = (words << four) | wide[j : j + len(words)]
        order = words * _MIX
        order ^= order >> np.uint64(32)
        windows = len(words) - span
        least, place = order[:windows].copy(), np.arange(windows)
        for j in range(1, span + 1):  # the first of the least words of each window
            other = order[j : j + windows]
            less = other < least
            place[less] = np.flatnonzero(less) + j
            np.minimum(least, other, out=least)
        place = place[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(at)) - 1
        word = words[place[start]]
        if only is not None:
            kept = only(word)
            start, stop, word = start[kept], stop[kept], word[kept]
        w = place[start]
        before, after = w - at[start], at[stop] + span - w
        beside = np.zeros(len(w), dtype=np.uint64)
        for j in range(span):
            left = np.where(j < before, wide[np.maximum(w - 1 - j, 0)], np.uint64(0))
            right = np.where(j < after, wide[np.minimum(w + m + j, len(wide) - 1)], np.uint64(0))
            beside |= (left << np.uint64(4 * j)) | (right << np.uint64(4 * (SPAN + j)))
        beside |= (before.astype(np.uint64) << np.uint64(8 * SPAN)) | (after.astype(np.uint64) << np.uint64(8 * SPAN + 4))
        simple = np.zeros(len(w), dtype=bool)
        for p in range(1, min(PERIOD + 1, m)):
            simple |= (word >> np.uint64(4 * p)) == (word & np.uint64((1 << (4 * (m - p))) - 1))
        yield of[start], pos[start] + before, word.view(np.int64), beside.view(np.int64), simple


def with_segments(df: DataFrame, keep: list[str], text: str, k: int = KMER, only: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """keep columns, pos, word, beside and simple: the k-mers of the given strand (see with_kmers), neighbours with one word in one row.

    A k-mer's word is the one of its k - SPAN letter substrings that a fixed mixing puts first, so that equal k-mers have
    equal words at equal places: whoever joins rows by word meets each pair of equal k-mers exactly once, in some seven
    times fewer pairs of rows. pos is the word's place in the text, word its letters, four bits a letter. beside holds
    the letters of the segment before the word (the nearest in the lowest bits), those after it, and how many of
    either: shared_kmers compares them. simple: words that repeat with a period of up to PERIOD letters. `only` picks,
    from an array of words, those to keep. k is at most 21.
    """
    df = df.select(*keep, F.regexp_replace(F.upper(text), f"[^{ALPHABET}]", "-").alias("_t")).filter(F.length("_t") >= k)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for of, *columns in _segments(batch.column(batch.num_columns - 1), k, only):
                rows = pa.array(of)
                kept = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
                pos, *rest = columns
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pos.astype(np.int32)), *map(pa.array, rest)], [f.name for f in fields])

    _span(k)
    fields = [df.schema[c] for c in keep] + [T.StructField("pos", T.IntegerType()), T.StructField("word", T.LongType())]
    fields += [T.StructField("beside", T.LongType()), T.StructField("simple", T.BooleanType())]
    return df.mapInArrow(explode, T.StructType(fields))


def map_words(df: DataFrame, text: str, make: Callable[[Iterator[np.ndarray]], Iterator[pa.RecordBatch]], schema: str, k: int = KMER) -> DataFrame:
    """What `make` gives for each task's words of with_segments, an array of some of them at a time: no word becomes a row, and one worker does both."""
    df = df.select(F.regexp_replace(F.upper(text), f"[^{ALPHABET}]", "-").alias("_t")).filter(F.length("_t") >= k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from make(word for batch in batches if batch.num_rows for _, _, word, *_ in _segments(batch.column(0), k, None))

    _span(k)
    return df.mapInArrow(run, schema)


def _part(beside: Column, low: int, bits: int) -> Column:
    return F.shiftright(beside, low).bitwiseAND(F.lit((1 << bits) - 1))


def shared_kmers(a: Column | str, b: Column | str, k: int = KMER) -> tuple[Column, Column]:
    """Of two segments with one word (columns beside): how many letters before it are shared, and how many k-mers, below 1 if none."""
    a, b = _col(a), _col(b)
    other = a.bitwiseXOR(b)

    def common(i: int) -> Column:
        x = _part(other, 4 * SPAN * i, 4 * SPAN)
        equal = F.shiftright(F.bit_count(x.bitwiseAND(-x) - 1), 2)  # zero bits below the first that differs, in letters
        return F.least(equal, *[_part(s, 8 * SPAN + 4 * i, 4).cast("int") for s in (a, b)])

    return common(0), common(0) + common(1) - (_span(k) - 1)


def _squeezed(x: np.ndarray) -> np.ndarray:
    """The two low bits of each of sixteen four-bit digits, side by side."""
    for shift, mask in ((2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x


_NOT_PLAIN = np.uint64(0xCCCCCCCCCCCCCCCC)


def narrow(word: np.ndarray, beside: np.ndarray, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (see with_segments) as rows of two numbers, a and b, and the segment of each row.

    The k-mers of A, C, G and T alone are in a, with b = 0. A segment with another letter has a row for all its k-mers
    besides, the word as a negative number and beside: a k-mer with such a letter only equals others with it.
    """
    span, word, beside = np.uint64(_span(k)), word.view(np.uint64), beside.view(np.uint64)
    letters = beside & np.uint64((1 << (8 * SPAN)) - 1)
    before, after = (beside >> np.uint64(8 * SPAN)) & np.uint64(15), beside >> np.uint64(8 * SPAN + 4)
    odd = np.flatnonzero((word | letters) & _NOT_PLAIN)
    cut = letters[odd]
    for j in range(SPAN - 1, -1, -1):  # of these, the letters up to the first odd one to either side are left
        for side, low in ((before, 4 * j), (after, 4 * (SPAN + j))):
            there = odd[(cut >> np.uint64(low)) & np.uint64(12) != 0]
            side[there] = np.minimum(side[there], np.uint64(j))
    for j in range(SPAN):
        for side, low in ((before, 4 * j), (after, 4 * (SPAN + j))):
            there = odd[side[odd] <= j]
            letters[there] &= ~np.uint64(15 << low)
    plain = np.flatnonzero((word & _NOT_PLAIN == 0) & (before + after >= span))
    code = (_squeezed(word[plain]) << np.uint64(30)) | (_squeezed(letters[plain]) << np.uint64(6)) | (before[plain] << np.uint64(3)) | after[plain]
    a = np.concatenate([code.view(np.int64), ~word[odd].view(np.int64)])
    return np.concatenate([plain, odd]), a, np.concatenate([np.zeros(len(plain), dtype=np.int64), beside[odd].view(np.int64)])


def with_narrow_segments(df: DataFrame, keep: list[str], text: str, k: int = KMER, only: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """keep columns, pos, a and b: the rows of with_segments as narrow() has them; equal k-mers are in rows of one narrow_word, see narrow_shared."""
    df = df.select(*keep, F.regexp_replace(F.upper(text), f"[^{ALPHABET}]", "-").alias("_t")).filter(F.length("_t") >= k)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for of, pos, word, beside, _ in _segments(batch.column(batch.num_columns - 1), k, only):
                at, a, b = narrow(word, beside, k)
                rows = pa.array(of[at])
                kept = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pos[at].astype(np.int32)), pa.array(a), pa.array(b)], [f.name for f in fields])

    _span(k)
    fields = [df.schema[c] for c in keep] + [T.StructField("pos", T.IntegerType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]
    return df.mapInArrow(explode, T.StructType(fields))


def narrow_word(a: Column | str) -> Column:
    """What rows of narrow segments must have in common to share a k-mer."""
    return F.when(_col(a) >= 0, F.shiftright(a, 30)).otherwise(_col(a))


def narrow_shared(a1: str, b1: str, a2: str, b2: str, k: int = KMER) -> tuple[Column, Column]:
    """shared_kmers of two rows of narrow segments (columns a and b of each) with one narrow_word."""
    other = F.col(a1).bitwiseXOR(F.col(a2))

    def common(i: int) -> Column:
        x = _part(other, 6 + 2 * SPAN * i, 2 * SPAN)
        equal = F.shiftright(F.bit_count(x.bitwiseAND(-x) - 1), 1)
        return F.least(equal, *[_part(F.col(s), 3 - 3 * i, 3).cast("int") for s in (a1, a2)])

    plain = (common(0), common(0) + common(1) - (_span(k) - 1))
    return tuple(F.when(F.col(a1) >= 0, x).otherwise(y) for x, y in zip(plain, shared_kmers(b1, b2, k), strict=True))


def segment_kmers(df: DataFrame, keep: list[str], k: int = KMER) -> DataFrame:
    """keep columns, pos and kmer: the k-mers of the rows of with_segments, as with_kmers has them for the given strand."""
    before, after = _part(F.col("beside"), 8 * SPAN, 4).cast("int"), _part(F.col("beside"), 8 * SPAN + 4, 4).cast("int")
    digits = lambda c, n: F.lpad(F.lower(F.hex(c)), n, "0")
    left, right = digits(_part(F.col("beside"), 0, 4 * SPAN), F.lit(SPAN)), digits(_part(F.col("beside"), 4 * SPAN, 4 * SPAN), F.lit(SPAN))
    spelled = F.concat(F.right(left, before), digits(F.col("word"), F.lit(k - _span(k))), F.reverse(F.right(right, after)))
    rows = df.select(*keep, (F.col("pos") - before).alias("_at"), spelled.alias("_s"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("_s") - k)).alias("_i"))
    return rows.select(*keep, (F.col("_at") + F.col("_i")).alias("pos"), F.substring("_s", F.col("_i") + 1, F.lit(k)).alias("kmer"))


def normalized_read_id(c: Column | str) -> Column:
    """The first word of a read's name without one trailing /1, else /2; null if there is none."""
    word = F.regexp_extract(_col(c), r"^\s*(\S+)", 1)
    return F.nullif(F.regexp_replace(word, "/[12]$", ""), F.lit(""))


def sample_id(c: Column | str) -> Column:
    """A file's name without its folder and, at most once each and in this order, .gz .fastq .fq _R1 _1."""
    out = F.regexp_extract(_col(c), "([^/]*)$", 1)
    for end in (".gz", ".fastq", ".fq", "_R1", "_1"):
        out = F.when(F.endswith(out, F.lit(end)), F.substring(out, F.lit(1), F.length(out) - len(end))).otherwise(out)
    return out
