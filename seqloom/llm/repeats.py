"""Problem 4: long exact spans shared between records.

Method: recompression (see recompression.py). Spark rounds name runs and pairs globally (name_rounds). In each window of
`span` letters the interior symbol with the least hash of its name is its anchor: equal windows have equal anchors,
wherever they are. Neighbouring windows mostly share one, so that records fall into segments of windows of one anchor,
and segments meet by the anchor's context: long repeats are where the same high-level symbols recur. Within an anchor
the windows are verified letter by letter.
Windows without an interior symbol (long runs and the like) are anchored by themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import letters, materialized
from seqloom.llm.recompression import Fingerprints, Names, counted, mix, parse

ROUNDS = 4
#: Names given in one round, to the most frequent runs or pairs: what every task gets of a round has this bound. Rarer
#: ones stay unnamed, in all records alike, which loses no span.
NAMES = 1 << 16
#: Bits of the largest filter of the base's keys, 32 MB.
KEY_BITS = 28
#: Segments a task verifies, on average.
TASK_ROWS = 200_000
#: Letters parsed at once in a task.
PORTION = 1 << 20
#: Occurrences of one anchor handled in one task; the segments of a more frequent one are aggregated first.
HOT = 100_000
#: place holds, from its top: 1 bit of tbl, 1 bit for letters other than ACGT, 31 bits of pos, 30 bits of the length; one
#: column instead of three, and half of the anchor's fingerprint as key, make the shuffled rows a third smaller.
_SEGMENT = "key int, rec long, place long, seg binary"
_POS_BITS, _LENGTH_BITS = 31, 30
_TWO_BITS = np.full(27, 255, dtype=np.uint8)
_TWO_BITS[[1, 3, 7, 20]] = [0, 1, 2, 3]  # A, C, G, T
_LETTERS = np.array([1, 3, 7, 20], dtype=np.uint8)
_UPPER = np.zeros(256, dtype=np.uint8)
_UPPER[65:91] = _UPPER[97:123] = np.arange(65, 91)


def _coded(column: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts with a 0 before, between and after; where each begins, and its length."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    codes = np.zeros(len(raw) + len(length) + 1, dtype=np.uint8)
    begin = (offsets[:-1] - offsets[0] + np.arange(1, len(length) + 1)).astype(np.int64)
    letter = np.ones(len(codes), dtype=bool)
    letter[begin - 1] = False
    letter[-1] = False
    codes[letter] = raw & 31
    return codes, begin, length.astype(np.int64)


def _place(tbl: int, pos: np.ndarray, n: np.ndarray) -> np.ndarray:
    """n is negative for letters other than ACGT, as in _packed."""
    odd = (n < 0).astype(np.int64)
    return (np.int64(tbl) << 62) | (odd << 61) | (pos.astype(np.int64) << _LENGTH_BITS) | np.abs(n).astype(np.int64)


def _placed(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """tbl, pos and n of _place."""
    n = place & ((1 << _LENGTH_BITS) - 1)
    return place >> 62, (place >> _LENGTH_BITS) & ((1 << _POS_BITS) - 1), np.where((place >> 61) & 1, -n, n)


def _placed_columns(rows: DataFrame) -> DataFrame:
    """The same as columns."""
    n = F.col("place").bitwiseAND(F.lit((1 << _LENGTH_BITS) - 1))
    odd = F.shiftright("place", 61).bitwiseAND(F.lit(1)) == 1
    pos = F.shiftright("place", _LENGTH_BITS).bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return rows.withColumns({"tbl": F.shiftright("place", 62).cast("byte"), "pos": pos, "n": F.when(odd, -n).otherwise(n).cast("int")})


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each of the ranges, one after the other."""
    total = np.cumsum(size)
    out = np.ones(int(total[-1]) if len(total) else 0, dtype=np.int64)
    if len(out):
        size_ok = size > 0
        first, where = start[size_ok], (total - size)[size_ok]
        out[where[0]] = first[0]
        out[where[1:]] = first[1:] - (first[:-1] + size[size_ok][:-1] - 1)
        np.cumsum(out, out=out)
    return out


def segments(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, span: int, names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, first window and number of windows of each segment; windows by their place in codes."""
    name, _, low, high = parse(codes, names)
    n = len(codes)
    rank = mix(name)
    prints = Fingerprints(codes)
    # interior symbols of the window at w: those from `first` to `last`
    first = np.repeat(np.arange(len(low) + 1, dtype=np.int32), np.diff(np.concatenate([[0], np.clip(low + 1, 0, n), [n]])))
    ends = np.clip(high - span, 0, n)
    last = np.repeat(np.arange(-1, len(high), dtype=np.int32), np.diff(np.concatenate([[0], ends, [n]])))
    valid = np.zeros(n + 1, dtype=np.int8)
    valid[begin] = 1
    np.add.at(valid, begin + length - span + 1, -1)
    is_window = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(first[1:], first[:-1], out=new[1:])
    new[1:] |= last[1:] != last[:-1]
    new[1:] |= is_window[1:] != is_window[:-1]
    at = np.flatnonzero(new)
    at = at[is_window[at]]
    a, b = first[at], last[at]
    # range minimum over (rank, place); of equal ranks the leftmost
    bits = max(20, int(len(name)).bit_length())
    table = [((rank >> np.uint64(bits)) << np.uint64(bits)) | np.arange(len(rank), dtype=np.uint64)]
    widest = int(max(1, (b - a + 1).max(initial=1)))
    while 2 << (len(table) - 1) <= widest:
        step, t = 1 << (len(table) - 1), table[-1].copy()
        np.minimum(t[:-step], t[step:], out=t[:-step])
        table.append(t)
    levels = np.stack(table)
    count = b - a + 1
    has = count > 0
    anchor = np.full(len(at), -1, dtype=np.int64)
    k = (np.frexp(count[has])[1] - 1).astype(np.int64)
    best = np.minimum(levels[k, a[has]], levels[k, b[has] - (1 << k) + 1])
    anchor[has] = (best & np.uint64((1 << bits) - 1)).astype(np.int64)
    # stretches of windows with one anchor
    size = np.diff(np.append(at, n))
    size = np.minimum(size, np.diff(np.append(at, n)))
    stop = begin + length - span + 1
    of = np.searchsorted(begin, at, "right") - 1
    size = np.minimum(size, stop[of] - at)
    joined = np.ones(len(at), dtype=bool)
    joined[1:] = (anchor[1:] != anchor[:-1]) | (anchor[1:] < 0)
    head = np.flatnonzero(joined)
    total = np.add.reduceat(size, head) if len(head) else size
    anchor, at = anchor[head], at[head]
    named = anchor >= 0
    key = np.empty(len(at), dtype=np.uint64)
    key[named] = mix(prints.of(low[anchor[named]], high[anchor[named]]) + np.uint64(1))
    if named.all():
        return key, at, total
    # windows without an anchor: one by one, and those that follow each other with equal letters (within a run) together
    lone = _ranges(at[~named], total[~named])
    print_ = mix(prints.of(lone, lone + span))
    change = np.append(np.flatnonzero(codes[1:] != codes[:-1]) + 1, n)
    run_end = change[np.searchsorted(change, lone, "right")]
    cut = np.ones(len(lone), dtype=bool)
    cut[1:] = (run_end[:-1] <= lone[:-1] + span) | (lone[1:] != lone[:-1] + 1)
    h = np.flatnonzero(cut)
    return np.concatenate([key[named], print_[h]]), np.concatenate([at[named], lone[h]]), np.concatenate([total[named], np.diff(np.append(h, len(lone)))])


def _packed(codes: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The letters of the ranges as binary: two bits a letter, or (n negative) a byte a letter where there are others than ACGT."""
    two = _TWO_BITS[codes]
    odd = np.concatenate([[0], np.cumsum(two == 255, dtype=np.int32)])
    plain = odd[start + n] == odd[start]
    two &= 3
    two = np.concatenate([two, np.zeros(4, dtype=np.uint8)])
    four = (two[:-3] << 6) | (two[1:-2] << 4) | (two[2:-1] << 2) | two[3:]
    size = np.where(plain, (n + 3) // 4, n)
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    data = np.empty(int(offsets[-1]), dtype=np.uint8)
    rep = np.repeat(np.arange(len(n)), size)
    k = np.arange(len(data)) - offsets[rep]
    p = plain[rep]
    data[p] = four[start[rep[p]] + 4 * k[p]]
    if not plain.all():
        data[~p] = codes[start[rep[~p]] + k[~p]]
    tail = plain & (n % 4 > 0)
    data[offsets[1:][tail] - 1] &= np.array([0, 0xC0, 0xF0, 0xFC], dtype=np.uint8)[n[tail] % 4]
    return np.where(plain, n, -n).astype(np.int32), pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(n: np.ndarray, seg: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the ranges, and where each begins."""
    seg = seg.combine_chunks() if isinstance(seg, pa.ChunkedArray) else seg
    offsets = np.frombuffer(seg.buffers()[1], dtype=np.int32)[seg.offset : seg.offset + len(seg) + 1].astype(np.int64)
    data = np.frombuffer(seg.buffers()[2], dtype=np.uint8)
    size = np.abs(n).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    codes = np.empty(int(begin[-1]), dtype=np.uint8)
    plain = n > 0
    rep = np.repeat(np.arange(len(n)), size)
    k = np.arange(len(codes)) - begin[rep]
    p = plain[rep]
    if p.all():
        codes[:] = _LETTERS[(data[offsets[rep] + k // 4] >> (6 - 2 * (k % 4)).astype(np.uint8)) & 3]
    else:
        q = ~p
        codes[p] = _LETTERS[(data[offsets[rep[p]] + k[p] // 4] >> (6 - 2 * (k[p] % 4)).astype(np.uint8)) & 3]
        codes[q] = data[offsets[rep[q]] + k[q]]
    return codes, begin[:-1]


def _letter_words(codes: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The `width` letters from each place on as one number of `bits` bits a letter; zeros follow the last letter."""
    wide = np.concatenate([codes, np.zeros(width, dtype=np.uint8)]).astype(np.uint64)
    out, done = np.zeros(len(codes), dtype=np.uint64), 0
    power = 1  # letters in `wide`
    while True:
        if width & power:
            out = (out << np.uint64(bits * power)) | wide[done : done + len(codes)]
            done += power
        if done == width:
            return out
        wide = (wide[:-power] << np.uint64(bits * power)) | wide[power:]
        power *= 2


def _two_bit_words(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The `width` (at most 32) letters from each place of `at` on, two bits each; data: four letters a byte, 8 bytes more than those."""
    eight = np.ndarray((len(data) - 8,), ">u8", data, strides=(1,))
    byte, bit = at >> 2, (at.view(np.uint64) & np.uint64(3)) << np.uint64(1)
    word = eight[byte].astype(np.uint64)
    word <<= bit
    word |= data[byte + 8] >> (np.uint64(8) - bit)
    word >>= np.uint64(64 - 2 * width)
    return word


def _same_windows(word: Callable[[int, np.ndarray | None], np.ndarray], offsets: list[int], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of `rows` windows that brings equal ones together, and where each lot of equal ones begins in it.

    word(o, some): the letters from o on of some windows (None: all) as numbers; over all offsets they make up the
    window. Windows are sorted by a hash of all their letters, and compared by the letters themselves; where a hash
    holds different windows, those are sorted by their letters.
    """
    if len(offsets) <= 4:  # few numbers a window are kept
        held = {o: word(o, None) for o in offsets}
        word = lambda o, some: held[o] if some is None else held[o][some]
    h = np.zeros(rows, dtype=np.uint64)
    for o in offsets:
        h = mix(h + word(o, None) + np.uint64(1))
    bits = np.uint64(max(1, rows.bit_length()))
    number = np.arange(rows, dtype=np.uint64)
    h = np.sort((h >> bits << bits) | number)  # of numbers, several times as fast as argsort
    order = (h & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    h >>= bits

    def others() -> np.ndarray:
        out = np.zeros(rows, dtype=bool)
        out[:1] = True
        for o in offsets:
            w = word(o, order)
            out[1:] |= w[1:] != w[:-1]
        return out

    other = others()
    new = np.ones(rows, dtype=bool)
    new[1:] = h[1:] != h[:-1]
    if (other & ~new).any():
        lot = np.cumsum(new) - 1
        mixed = np.flatnonzero(np.bincount(lot[other & ~new], minlength=lot[-1] + 1)[lot] > 0)
        some = order[mixed]
        order[mixed] = some[np.lexsort([*(word(o, some) for o in offsets), lot[mixed]])]
        other = others()
    return order, np.flatnonzero(other)


def _offsets(span: int, width: int) -> list[int]:
    return sorted({*range(0, span - width + 1, width), span - width})


def shared_windows(n: np.ndarray, seg: pa.Array, low: np.ndarray, high: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of the segments: its segment, its place there, and the least and largest row of the base that holds it.

    low and high: the same of each segment; low > high where no row of the base has it. Windows that hold A, C, G and T
    alone are compared in two bits a letter, straight from the packed segments; the others meet only each other.
    """
    windows = np.abs(n).astype(np.int64) - span + 1
    total = np.concatenate([[0], np.cumsum(windows)])
    of, place = np.repeat(np.arange(len(n)), windows), _ranges(np.zeros(len(n), dtype=np.int64), windows)
    out_low, out_high = np.empty(len(of), dtype=np.int64), np.empty(len(of), dtype=np.int64)

    def fill(rows: np.ndarray | slice, word: Callable[[int, np.ndarray | None], np.ndarray], offsets: list[int]) -> None:
        owner = of[rows]
        if not len(owner):
            return
        order, head = _same_windows(word, offsets, len(owner))
        size, owner = np.diff(np.append(head, len(owner))), owner[order]
        least, most = np.empty_like(order), np.empty_like(order)
        least[order] = np.repeat(np.minimum.reduceat(low[owner], head), size)
        most[order] = np.repeat(np.maximum.reduceat(high[owner], head), size)
        out_low[rows], out_high[rows] = least, most

    seg = seg.combine_chunks() if isinstance(seg, pa.ChunkedArray) else seg
    offsets = np.frombuffer(seg.buffers()[1], dtype=np.int32)[seg.offset : seg.offset + len(seg) + 1].astype(np.int64)
    data = np.frombuffer(seg.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
    begin = 4 * (offsets[:-1] - offsets[0])
    plain: np.ndarray | slice = slice(None)
    odd = np.flatnonzero(n < 0)
    if len(odd):  # a byte a letter: their windows without other letters join the plain ones, four letters a byte
        codes, first = _unpacked(n[odd], seg.take(pa.array(odd)))
        two = _TWO_BITS[codes]
        others = np.concatenate([[0], np.cumsum(two == 255)])
        at = _ranges(first, windows[odd])
        rows = _ranges(total[odd], windows[odd])
        strange = others[at + span] > others[at]
        width = min(12, span)
        five, at_odd = _letter_words(codes, 5, width), at[strange]
        fill(rows[strange], lambda o, some: five[(at_odd if some is None else at_odd[some]) + o], _offsets(span, width))
        is_plain = np.ones(len(of), dtype=bool)
        is_plain[rows[strange]] = False
        plain = np.flatnonzero(is_plain)
        _, packed = _packed(np.where(two == 255, 1, codes), np.zeros(1, dtype=np.int64), np.array([len(codes)]))
        begin[odd] = 4 * len(data) + first
        data = np.concatenate([data, np.frombuffer(packed.buffers()[2], dtype=np.uint8)])
    data = np.concatenate([data, np.zeros(9, dtype=np.uint8)])
    at_plain = (begin[of] + place)[plain]
    width = min(32, span)
    fill(plain, lambda o, some: _two_bit_words(data, (at_plain if some is None else at_plain[some]) + o, width), _offsets(span, width))
    return of, place, out_low, out_high


_NONE_LOW, _NONE_HIGH = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _spans(of: np.ndarray, place: np.ndarray, covered: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment, start and end of each stretch of covered letters."""
    of, place = of[covered], place[covered]
    if not len(of):
        return of, place, place
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (place[1:] != place[:-1] + 1)
    head = np.flatnonzero(new)
    return of[head], place[head], place[np.append(head[1:], len(of)) - 1] + span


def _kinds(n: np.ndarray, seg: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each segment's letters among the distinct ones, and a segment of each: what is equal is searched once."""
    letters = seg.combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    _, first, kind = np.unique(letters * 8 + (np.abs(n) & 3) * 2 + (n < 0), return_index=True, return_inverse=True)
    return kind, first


def _portions(batches: Iterator[pa.RecordBatch], span: int, portion: int) -> Iterator[tuple[np.ndarray, pa.Array, int]]:
    """Record numbers, texts and the place of the first letter, portion letters or so at a time.

    A longer record comes in pieces that overlap by span - 1 letters: each window lies in one piece, and its anchor
    depends on the window's own letters alone, so cutting changes nothing.
    """
    for batch in batches:
        rec, column = batch.column("rec").to_numpy(), batch.column("letters")
        ends = np.cumsum(pc.binary_length(column).to_numpy())
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            if ends[start] - before > portion:
                text = column[start].as_py()
                for first in range(0, len(text) - span + 1, portion):
                    yield rec[start : start + 1], pa.array([text[first : first + portion + span - 1]]), first
                start += 1
            else:
                stop = int(np.searchsorted(ends, before + portion, "right"))
                yield rec[start:stop], column.slice(start, stop - start), 0
                start = stop


def _texts(records: DataFrame, rec: str, text: str) -> DataFrame:
    """(rec, text) for _lettered: ASCII as it is, other texts as their letters, since Python's upper case isn't Spark's."""
    text_ = F.col(text)
    text_ = F.when(F.octet_length(text_) == F.length(text_), text_).otherwise(letters(text_))
    return records.filter(F.col(rec).cast("long").isNotNull() & F.col(text).isNotNull()).select(F.col(rec).cast("long").alias("rec"), text_.alias("text"))


def _lettered(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(rec, letters) of the _texts with at least `span` letters: what common.letters gives, for a tenth of its time."""
    for batch in batches:
        column = batch.column("text")
        if not len(column):
            continue
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets, upper = offsets - offsets[0], _UPPER[raw]
        is_letter = upper > 0
        if not is_letter.all():
            offsets = np.concatenate([[0], np.cumsum(is_letter)])[offsets].astype(np.int32)
            upper = upper[is_letter]
        column = pa.StringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(upper))
        long_enough = pa.array(np.diff(offsets) >= span)
        yield pa.RecordBatch.from_arrays([batch.column("rec").filter(long_enough), column.filter(long_enough)], ["rec", "letters"])


def name_rounds(base: DataFrame, rec: str, text: str, span: int, rounds: int = ROUNDS, most: int = NAMES, portion: int = PORTION) -> Names:
    """The names of a run round and of `rounds` pair rounds, counted over all base records; a Spark aggregation a round.

    Only what occurs in the base needs a name, as every span that counts lies in a base record too. Each round names the
    `most` most frequent runs or pairs.
    """
    rows = _texts(base, rec, text)
    names = Names()
    for _ in range(rounds + 1):
        held = base.sparkSession.sparkContext.broadcast(names)

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for _, column, _ in _portions(_lettered(batches, span), span, portion):
                code, n = counted(_coded(column)[0], held.value)
                yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n, pa.int64())], ["code", "n"])

        sums = rows.mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
        chosen = sums.orderBy(F.desc("n"), "code").limit(most).select("code").collect()  # at most `most` numbers
        following = Names()
        following.tables, following.last = list(names.tables), names.last
        following.add([r.code for r in chosen])
        names = following
    return names


def key_test(base: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Whether each of an array of keys may be one of base's segments: no true one is missed. A bitmap of at most 32 MB."""
    rows = base.count()
    bits = min(KEY_BITS, max(6, (16 * max(1, rows) - 1).bit_length()))
    place = F.shiftrightunsigned("key", 32 - bits)
    found = base.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, p & 63))").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    words[found.column("word").to_numpy()] = found.column("value").to_numpy()
    held = base.sparkSession.sparkContext.broadcast(words)

    def test(keys: np.ndarray) -> np.ndarray:
        p = keys.view(np.uint32) >> np.uint32(32 - bits)
        return (held.value.view(np.uint64)[p >> np.uint32(6)] >> (p & np.uint32(63)).astype(np.uint64)) & np.uint64(1) == 1

    return test


def record_segments(records: DataFrame, tbl: int, rec: str, text: str, span: int, names: Names, only: Callable[[np.ndarray], np.ndarray] | None = None, portion: int = PORTION) -> DataFrame:
    """The segments of each record with at least `span` letters. tbl 0 is the base, in which others look for their spans.

    only: a test of keys; segments of others that it rules out hold no span of the base.
    """
    held = records.sparkSession.sparkContext.broadcast(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rec, column, first in _portions(_lettered(batches, span), span, portion):
            codes, begin, length = _coded(column)
            key, at, windows = segments(codes, begin, length, span, held.value)
            key = (key >> np.uint64(32)).astype(np.uint32).view(np.int32)
            if only is not None:
                may = only(key)
                key, at, windows = key[may], at[may], windows[may]
            of = np.searchsorted(begin, at, "right") - 1
            n, seg = _packed(codes, at, windows + span - 1)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rec[of]), pa.array(_place(tbl, at - begin[of] + first, n)), seg], ["key", "rec", "place", "seg"])

    return _texts(records, rec, text).mapInArrow(cut, _SEGMENT)


def shared_spans(base: tuple[DataFrame, str, str], others: tuple[DataFrame, str, str] | None, span: int, rounds: int = ROUNDS, most: int = NAMES, portion: int = PORTION, hot: int = HOT) -> DataFrame:
    """covered_spans() of records: base and others are (records, key, text); tbl 0 and 1 in the result.

    Null texts and keys, and records of fewer than `span` letters, have no span.
    """
    names = name_rounds(*base, span, rounds, most, portion)
    held = materialized(record_segments(base[0], 0, *base[1:], span, names, portion=portion))
    if others is None:
        return covered_spans(held, span, hot)
    own = materialized(record_segments(others[0], 1, *others[1:], span, names, only=key_test(held), portion=portion))
    return covered_spans(held.unionByName(own), span, hot)


def _frames(batches: Iterator[pa.RecordBatch], most: int = 150_000) -> Iterator[pa.Table]:
    """Rows that come sorted by key, in tables of whole keys."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def key_spans(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """(tbl, rec, a, b): the covered stretches of each segment; batches: segments sorted by key, all of a key together."""
    for t in _frames(batches):
        key, rec = t.column("key").to_numpy(), t.column("rec").to_numpy()
        tbl, pos, n = _placed(t.column("place").to_numpy())
        is_base = tbl == 0
        # keys without a base row, or with a single row in all, cover nothing
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(head, len(key)))
        live = np.repeat((np.add.reduceat(is_base.astype(np.int64), head) > 0) & (size > 1), size)
        if not live.any():
            continue
        key, is_base, rec, pos, tbl = key[live], is_base[live], rec[live], pos[live], tbl[live]
        n, seg = n[live], t.column("seg").filter(pa.array(live))
        kind, first = _kinds(n, seg)
        low, high = np.full(len(first), _NONE_LOW), np.full(len(first), _NONE_HIGH)
        np.minimum.at(low, kind[is_base], rec[is_base])
        np.maximum.at(high, kind[is_base], rec[is_base])
        of, place, low, high = shared_windows(n[first], seg.take(pa.array(first)), low, high, span)
        found = []
        for own, covered in ((is_base, low < high), (~is_base, low <= high)):
            seg_of, start, end = _spans(of, place, covered, span)
            rows = np.flatnonzero(own)
            count = np.bincount(seg_of, minlength=len(first))
            size = count[kind[rows]]
            span_of, rows = _ranges((np.cumsum(count) - count)[kind[rows]], size), np.repeat(rows, size)
            found.append((tbl[rows], rec[rows], pos[rows] + start[span_of], pos[rows] + end[span_of]))
        tbl, rec, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
        # a record delivered again has all its segments here, at the same keys: one of each goes on
        order = np.lexsort((end, start, rec, tbl))
        tbl, rec, start, end = tbl[order], rec[order], start[order], end[order]
        new = np.ones(len(rec), dtype=bool)
        new[1:] = (rec[1:] != rec[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (tbl[1:] != tbl[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(tbl[new].astype(np.int8)), pa.array(rec[new]), pa.array(start[new]), pa.array(end[new])], ["tbl", "rec", "a", "b"])


def covered_spans(all_rows: DataFrame, span: int, hot: int = HOT) -> DataFrame:
    """(tbl, rec, span_start, span_end): the maximal covered stretches of each record.

    all_rows: record_segments() of the base (tbl 0) and others (tbl 1), as tables. A letter of a base record is covered
    by a window that another base record holds too, a letter of one of the others by a window that any base record
    holds. Records of one number count as one, so rows repeated in the others come out once.
    """
    many_rows = all_rows.count()
    parts = max(2 * all_rows.sparkSession.sparkContext.defaultParallelism, -(-many_rows // TASK_ROWS))
    # Keys are counted by bucket first, a bucket holding hot / 4 rows on average: only rows of overfull buckets are counted by key.
    buckets = max(1 << 16, 4 * many_rows // hot)
    bucket = F.pmod("key", F.lit(buckets))
    full = all_rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("bucket")
    full = materialized(full)
    many: list[int] = []
    if not full.isEmpty():
        often = all_rows.select("key", bucket.alias("bucket")).join(full, "bucket").groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > hot).select("key")
        often = materialized(often)
        many = [r.key for r in often.limit(4097).collect()]  # beyond 4096 the table itself is joined
    if not many:
        cold, warm = all_rows, None
    elif len(many) <= 4096:
        cold, warm = all_rows.filter(~F.col("key").isin(many)), all_rows.filter(F.col("key").isin(many))
    else:
        cold, warm = all_rows.join(often, "key", "left_anti"), all_rows.join(often, "key", "left_semi")

    found = cold.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(lambda batches: key_spans(batches, span), "tbl byte, rec long, a long, b long")
    if warm is not None:
        found = found.unionByName(_hot_spans(_placed_columns(warm), span))
    return _merged(found, parts)


def _hot_spans(rows: DataFrame, span: int) -> DataFrame:
    """(tbl, rec, a, b) of anchors with very many segments: equal segments count once, and the answer is joined to all."""
    base_rec = F.when(F.col("tbl") == 0, F.col("rec"))
    kinds = rows.groupBy("key", "n", "seg").agg(F.min(base_rec).alias("low"), F.max(base_rec).alias("high"))
    # the windows of the distinct segments, aggregated by their letters
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            n = b.column("n").to_numpy()
            codes, begin = _unpacked(n, b.column("seg"))
            count = np.abs(n).astype(np.int64) - span + 1
            at = _ranges(begin, count)
            of = np.repeat(np.arange(len(n)), count)
            width, window = _packed(codes, at, np.full(len(at), span))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([b.column("key").take(take), pa.array(width), window, b.column("n").take(take), b.column("seg").take(take), b.column("low").take(take), b.column("high").take(take), pa.array((at - begin[of]).astype(np.int32))], ["key", "width", "window", "n", "seg", "low", "high", "place"])

    each = kinds.mapInArrow(windows, "key int, width int, window binary, n int, seg binary, low long, high long, place int")
    letters_of = ["key", "width", "window"]  # the letters themselves, packed
    held = each.groupBy(*letters_of).agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least is not null")
    each = each.select(*letters_of, "n", "seg", "place").join(held, letters_of)
    each = each.select("key", "n", "seg", "place", (F.col("least") < F.col("most")).alias("twice"))
    answer = rows.select("key", "n", "seg", "tbl", "rec", "pos").join(each, ["key", "n", "seg"]).filter((F.col("tbl") != 0) | F.col("twice"))
    return answer.select("tbl", "rec", (F.col("pos") + F.col("place")).cast("long").alias("a"), (F.col("pos") + F.col("place") + span).cast("long").alias("b")).distinct()


def _merged(found: DataFrame, parts: int) -> DataFrame:
    """Overlapping and touching stretches of a record as one."""
    found = found.repartition(parts, "tbl", "rec")
    order = Window.partitionBy("tbl", "rec").orderBy("a", "b")
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1))
    rows = rows.withColumn("stretch", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("tbl", "rec", "stretch").agg(F.min("a").alias("span_start"), F.max("b").alias("span_end")).drop("stretch")


def shares(spans: DataFrame, records: DataFrame, key: str, text: str) -> DataFrame:
    """(rec, n_letters, covered, share): of each record the letters that lie in spans (rec, span_start, span_end).

    A record without letters, or with a null, has share 0; rows of one key count once, by their longest text.
    """
    size = records.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("rec")).agg(F.coalesce(F.max(F.length(letters(text))), F.lit(0)).cast("long").alias("n_letters"))
    sums = spans.groupBy("rec").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("covered"))
    rows = size.join(sums, "rec", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return rows.withColumn("share", F.when(F.col("n_letters") > 0, F.col("covered") / F.col("n_letters")).otherwise(F.lit(0.0)))
