"""Which reads share k-mers with which records of a panel: both sides packed into pieces that meet by their words, in arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import materialized, spread
from seqloom.constants import ALPHABET, KMER
from seqloom.functions import seq
from seqloom.operators import gate

#: Letters of the words that the filter tells apart, and of those that deal k-mers to parts: of the words in a k-mer, on
#: both strands, the one that a fixed mixing puts first. Neighbours have one word the longer, the shorter it is.
TEST_WORD, PART_WORD = 15, 11
#: Letters of a piece: neighbouring k-mers of one part, two bits a letter in one number.
LETTERS = 32
#: Pieces or rows that a task packs at once, and letters of the panel that make a part; a worker's memory goes with them.
_PACK, _PART = 1 << 19, 1 << 19
_TWICE = np.uint64(2)
_MIX, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)
_ROWS = "part int, side int, n int, data binary"


def _grams(one: np.ndarray, n: int) -> np.ndarray:
    """The n letters from each place on as a number, two bits a letter."""
    if n == 1:
        return one
    if n % 2:
        return (_grams(one, n - 1)[:-1] << _TWICE) | one[n - 1 :]
    half = _grams(one, n // 2)
    return (half[: -(n // 2)] << np.uint64(n)) | half[n // 2 :]


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of n neighbours."""
    out, have = x, 1
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def _mixed(x: np.ndarray, by: np.uint64 = _MIX2) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * by
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _canonical(code: np.ndarray, k: int) -> np.ndarray:
    """The smaller one of a k-mer of A, C, G and T and its reverse complement."""
    x = ~code
    for shift, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    x = ((x >> np.uint64(32)) | (x << np.uint64(32))) >> np.uint64(64 - 2 * k)
    return np.minimum(code, x)


def _first_words(one: np.ndarray, m: int, k: int) -> np.ndarray:
    """The first word of m letters, mixed, of the k-mer at each place: equal for equal canonical k-mers."""
    words = np.minimum(_grams(one, m), _grams((one ^ np.uint64(3))[::-1], m)[::-1])
    return _least(_mixed(words), k - m + 1)


def _runs(of: np.ndarray, at: np.ndarray, key: np.ndarray, most: int = 1 << 30) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring windows of one text and key begin, and their lengths, up to `most`."""
    new = np.ones(len(at), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
    n = np.arange(len(at))
    new |= (n - np.maximum.accumulate(np.where(new, n, 0))) % most == 0
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(at)))


def _windows(texts: pa.StringArray, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Some texts' letters, some at a time, with (text's number, place) of the k-mers of A, C, G and T alone and of those with others."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
    begin, count = offsets[:-1], np.diff(offsets) - k + 1
    ends = np.cumsum(count)
    for low in range(0, int(ends[-1]), seq._PORTION):
        n = np.arange(low, min(low + seq._PORTION, int(ends[-1])))
        of = np.searchsorted(ends, n, "right")
        at = begin[of] + n - (ends[of] - count[of])
        first = int(at[0])
        own = raw[first : int(at[-1]) + k]
        at = at - first
        digit = seq._DIGIT[own]
        strange, rare = (np.concatenate([[0], np.cumsum(x)]) for x in (digit == 16, digit > 3))
        plain = rare[at + k] == rare[at]
        odd = (strange[at + k] == strange[at]) & ~plain
        yield own, (digit & 3).astype(np.uint64), of[plain], at[plain], of[odd], at[odd]


def _odd_codes(own: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The canonical codes of the k-mers at the places, as bytes, and a key of each."""
    code, other = (np.ascontiguousarray(sliding_window_view(t[own], k)[at][:, ::step]).view(f"S{k}").ravel() for t, step in ((seq._FORWARD, 1), (seq._REVERSE, -1)))
    code = np.where(other < code, other, code)
    return code, _mixed(code.view(np.uint8).reshape(len(code), k).astype(np.uint64) @ gate._MULTIPLIERS[:k])


def test_keys(texts: pa.StringArray, k: int = KMER) -> Iterator[np.ndarray]:
    """What the filter holds of some texts: the first long word of each plain k-mer, and the keys of the others."""
    for own, one, of, at, _, odd in _windows(texts, k):
        if len(at):
            key = _first_words(one, TEST_WORD, k)[at]
            yield key[_runs(of, at, key)[0]]
        if len(odd):
            yield _odd_codes(own, odd, k)[1]


def pieces(texts: pa.StringArray, k: int = KMER, only: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text's number, key, data, k-mers) of the pieces of some texts, some at a time; texts hold one byte a character.

    First those of k-mers of A, C, G and T alone: key mixes their word, data are their letters from the highest bits on.
    Then each k-mer with another letter: key mixes it, data is its canonical code as bytes. Equal canonical k-mers have
    equal keys. `only` picks, from an array of test_keys, those whose k-mers to keep. k is 15 to 21.
    """
    for own, one, of, at, odd_of, odd in _windows(texts, k):
        if only is not None and len(at):
            key = _first_words(one, TEST_WORD, k)[at]
            start, size = _runs(of, at, key)
            kept = np.repeat(only(key[start]), size)
            of, at = of[kept], at[kept]
        if len(at):
            key = _first_words(one, PART_WORD, k)[at]
            start, size = _runs(of, at, key, LETTERS - k + 1)
            whole = _grams(np.concatenate([one, np.zeros(LETTERS - 1, dtype=np.uint64)]), LETTERS)[at[start]]
            unused = (2 * (LETTERS - k + 1 - size)).astype(np.uint64)
            yield of[start], key[start], (whole >> unused) << unused, size
        if len(odd):
            code, key = _odd_codes(own, odd, k)
            if only is not None:
                kept = only(key)
                odd_of, code, key = odd_of[kept], code[kept], key[kept]
            yield odd_of, key, code, np.ones(len(code), dtype=np.int64)


def _letters(df: DataFrame, keep: list[str], text: str, k: int) -> DataFrame:
    return df.select(*keep, F.regexp_replace(F.upper(text), f"[^{ALPHABET}]", "-").alias("_t")).filter(F.length("_t") >= k)


def packed(df: DataFrame, owner: str, text: str, side: int, parts: int, k: int = KMER, only: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(part, side, n, data): the pieces of the texts, those of a part packed together (see _pack); parts below 0 are of k-mers with rare letters.

    All pieces of a read that are in one part are in one row, so that what it repeats can be told there; a long record of the panel may have several.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
        waiting = 0
        for batch in (x for b in batches for x in _slices(b)):
            owners = batch.column(0).to_numpy()
            for of, key, data, size in pieces(batch.column(1), k, only):
                if side == 0 and waiting >= _PACK:
                    yield _flushed(held, side)
                    waiting = 0
                part = (((_mixed(key) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                held[data.dtype.kind == "S"].append((part, owners[of], data, size))
                waiting += len(of)
            if waiting >= _PACK:
                yield _flushed(held, side)
                waiting = 0
        yield _flushed(held, side)

    return _letters(df, [F.col(owner).cast("long").alias(owner)], text, k).mapInArrow(run, _ROWS)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows, some two million letters at a time; one row at least."""
    upto = np.cumsum(np.diff(np.frombuffer(batch.column(1).buffers()[1], dtype=np.int32)[batch.column(1).offset :][: batch.num_rows + 1]).astype(np.int64)) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 4 * _PACK, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _flushed(held: dict[bool, list[tuple[np.ndarray, ...]]], side: int) -> pa.RecordBatch:
    rows = []
    for rare, some in held.items():
        if some:
            part, owner, data, size = (np.concatenate(x) for x in zip(*some, strict=True))
            some.clear()
            order = np.lexsort((owner, part))
            part, owner, data, size = part[order], owner[order], data[order], size[order]
            cut = np.flatnonzero(np.diff(part, prepend=-1))
            for a, b in zip(cut.tolist(), [*cut.tolist()[1:], len(part)], strict=False):
                rows.append((-1 - int(part[a]) if rare else int(part[a]), side, b - a, _pack(owner[a:b], data[a:b], size[a:b])))
    columns = zip(*rows, strict=True) if rows else ((),) * 4
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["part", "side", "n", "data"])


_CODEC = pa.Codec("zstd", 1)


def _pack(owner: np.ndarray, data: np.ndarray, size: np.ndarray) -> bytes:
    """Pieces sorted by owner as compressed bytes, byte by byte of all of them: steps from owner to owner, lengths, letters."""
    step = np.diff(owner, prepend=0)
    columns = [step.view(np.uint8).reshape(-1, 8).T, size.astype(np.uint8), data.view(np.uint8).reshape(len(data), -1).T]
    return _CODEC.compress(b"".join(c.tobytes() for c in columns), asbytes=True)


def _unpacked(n: int, data: bytes, rare: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The canonical k-mers of packed pieces and their owners."""
    wide = k if rare else 8
    raw = np.frombuffer(_CODEC.decompress(data, n * (9 + wide), asbytes=True), dtype=np.uint8)
    owner = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.int64).ravel())
    letters = np.ascontiguousarray(raw[9 * n :].reshape(wide, n).T)
    if rare:
        return letters.view(f"S{k}").ravel(), owner
    size = raw[8 * n : 9 * n].astype(np.int64)
    of = np.repeat(np.arange(n), size)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    code = (letters.view(np.uint64).ravel()[of] >> (2 * (LETTERS - k - nth)).astype(np.uint64)) & np.uint64((1 << (2 * k)) - 1)
    return _canonical(code, k), owner[of]


def _pairs(codes: np.ndarray, owners: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a code and an owner (numbers from 0 on), sorted."""
    bits = 64 - 2 * k
    if codes.dtype.kind != "S" and len(owners) and int(owners.max()) < 1 << bits:
        both = np.sort((codes << np.uint64(bits)) | owners.astype(np.uint64))
        both = both[np.append(True, both[1:] != both[:-1])]
        return both >> np.uint64(bits), (both & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.lexsort((owners, codes))
    codes, owners = codes[order], owners[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owners[1:] != owners[:-1])
    return codes[new], owners[new]


class _Part:
    """The panel's k-mers of a part. Those that the same records hold are one class, named by digests of its records' numbers."""

    def __init__(self, codes: np.ndarray, owners: np.ndarray, k: int):
        self.k = k
        self.records, own = np.unique(owners, return_inverse=True)
        codes, self.own = _pairs(codes, own, k)
        self.start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        self.codes, self.size = codes[self.start], np.diff(np.append(self.start, len(codes)))
        number = self.records.astype(np.uint64)[self.own]
        names = [np.add.reduceat(_mixed(number + np.uint64(1), by), self.start) for by in (_MIX2, _MIX3)]
        names[1] &= np.uint64(0xFFFF)  # 80 bits in all
        order = np.lexsort(names)
        names = [x[order] for x in names]
        new = np.append(True, (names[0][1:] != names[0][:-1]) | (names[1][1:] != names[1][:-1]))
        self.names = [x[new].view(np.int64) for x in names]
        self.cls = np.empty(len(order), dtype=np.int64)
        self.cls[order] = np.cumsum(new) - 1
        self.first = order[new]  # a k-mer of each class
        self.reset()

    def reset(self) -> None:
        """Forget what was met."""
        self.seen, self.met = np.zeros(len(self.codes), dtype=np.int64), np.zeros(len(self.first), dtype=bool)

    def meet(self, codes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs of a class and an owner of the codes; how many owners each k-mer has is added up."""
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        held = self.codes[at] == codes
        names, own = np.unique(owners[held], return_inverse=True)
        code, own = _pairs(at[held].astype(np.uint64), own, self.k)
        code = code.astype(np.int64)
        self.seen += np.bincount(code, minlength=len(self.codes))
        cls, own = _pairs(self.cls[code].astype(np.uint64), own, self.k)
        cls = cls.astype(np.int64)
        self.met[cls] = True
        return cls, names[own]

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """The records, and the pairs of one of their k-mers and an owner of it."""
        total = np.zeros(len(self.records), dtype=np.int64)
        np.add.at(total, self.own, np.repeat(self.seen, self.size))
        return self.records[total > 0], total[total > 0]

    def members(self, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of one of the classes and a record of it."""
        begin, size = self.start[self.first[cls]], self.size[self.first[cls]]
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(cls, size), self.records[self.own[np.repeat(begin, size) + nth]]


#: What a row of met() is: a fragment (number) with k-mers of the class (c0, c1); a record (number) of the class; a record and its k-mer hits (n).
#: Then of counted(): one of the fragments with the same set of classes, named (c0, c1), and how many they are (n).
FRAGMENT, RECORD, HITS, SET = range(4)
_FOUND = "kind int, number long, c0 long, c1 long, n long"


def _found(kind: int, number: np.ndarray, c0: np.ndarray | None = None, c1: np.ndarray | None = None, n: np.ndarray | None = None) -> pa.RecordBatch:
    none = np.zeros(len(number), dtype=np.int64)
    columns = [np.full(len(number), kind, dtype=np.int32), number, *(none if c is None else c for c in (c0, c1, n))]
    return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["kind", "number", "c0", "c1", "n"])


class _Task:
    """What a task of met() gives: each class, and each fragment's class, once for many parts."""

    def __init__(self):
        self.numbers: dict[tuple[int, int], int] = {}  # of the classes
        self.fragments: list[tuple[np.ndarray, np.ndarray]] = []
        self.records: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def close(self, part: _Part, pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        self.records.append(part.hits())
        cls = np.flatnonzero(part.met)
        known = len(self.numbers)
        number = np.zeros(len(part.met), dtype=np.int64)
        number[cls] = [self.numbers.setdefault(x, len(self.numbers)) for x in zip(*(c[cls].tolist() for c in part.names), strict=True)]
        fresh, records = part.members(cls[number[cls] >= known])
        yield _found(RECORD, records, part.names[0][fresh], part.names[1][fresh])
        self.fragments += [(number[c], own) for c, own in pairs]
        self.waiting += sum(len(c) for c, _ in pairs) + len(self.records[-1][0])
        if self.waiting > _PACK or len(self.numbers) > _PACK:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.records:
            records, total = (np.concatenate(x) for x in zip(*self.records, strict=True))
            own, at = np.unique(records, return_inverse=True)
            n = np.zeros(len(own), dtype=np.int64)
            np.add.at(n, at, total)
            yield _found(HITS, own, n=n)
        if self.fragments:
            cls, number = (np.concatenate(x) for x in zip(*self.fragments, strict=True))
            order = np.lexsort((number, cls))  # neighbours with one class are compressed well
            cls, number = cls[order], number[order]
            new = np.append(True, (cls[1:] != cls[:-1]) | (number[1:] != number[:-1]))[: len(cls)]
            names = np.array(list(self.numbers), dtype=np.int64).reshape(-1, 2)
            yield _found(FRAGMENT, number[new], *names[cls[new]].T)
        self.__init__()


def met(rows: DataFrame, k: int = KMER) -> DataFrame:
    """(kind, number, c0, c1, n) of packed rows of a panel (side 0) and of reads (side 1).

    A task has the panel's k-mers of one part at a time, and meets it with one row of packed reads after the other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, panel, table, pairs, task = None, [], None, [], _Task()
        for b in batches:
            for part, side, n, data in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if part != now:
                    if table is not None:
                        yield from task.close(table, pairs)
                    now, panel, table, pairs = part, [], None, []
                codes, owners = _unpacked(n, data, part < 0, k)
                if side == 0:
                    panel.append((codes, owners))
                    continue
                if panel:
                    table, panel = _Part(*(np.concatenate(x) for x in zip(*panel, strict=True)), k), []
                if table is not None:
                    pairs.append(table.meet(codes, owners))
                    if sum(len(c) for c, _ in pairs) > _PACK:
                        yield from task.close(table, pairs)
                        table.reset()
                        pairs = []
        if table is not None:
            yield from task.close(table, pairs)
        yield from task.flush()

    return rows.repartition("part").sortWithinPartitions("part", "side").mapInArrow(run, _FOUND)


def counted(rows: DataFrame) -> DataFrame:
    """met() with the fragments of one set of classes counted: a row SET for some of them at a time, and the classes of one of these."""

    def sets(some: list[tuple[np.ndarray, ...]], last: bool) -> tuple[list[pa.RecordBatch], list[tuple[np.ndarray, ...]]]:
        number, c0, c1 = (np.concatenate(x) for x in zip(*some, strict=True))
        whole = number <= number[-1] if last else number < number[-1]  # they come in order; the last may go on
        rest = [(number[~whole], c0[~whole], c1[~whole])]
        number, c0, c1 = number[whole], c0[whole], c1[whole]
        if not len(number):
            return [], rest
        order = np.lexsort((c1, c0, number))
        number, c0, c1 = number[order], c0[order], c1[order]
        new = np.append(True, (number[1:] != number[:-1]) | (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1]))
        number, c0, c1 = number[new], c0[new], c1[new]
        start = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        one = _mixed(c0.view(np.uint64)) + c1.view(np.uint64)
        names = [np.add.reduceat(_mixed(one, by), start).view(np.int64) for by in (_MIX2, _MIX3)]
        order = np.lexsort(names)
        s0, s1 = (x[order] for x in names)
        first = np.flatnonzero(np.append(True, (s0[1:] != s0[:-1]) | (s1[1:] != s1[:-1])))
        chosen = order[first]
        size = np.diff(np.append(start, len(number)))
        mine = np.zeros(len(start), dtype=bool)
        mine[chosen] = True
        mine = np.repeat(mine, size)
        return [_found(SET, number[start[chosen]], s0[first], s1[first], np.diff(np.append(first, len(order)))), _found(FRAGMENT, number[mine], c0[mine], c1[mine])], rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, waiting = [], 0
        for b in batches:
            kind = b.column(0).to_numpy()
            yield b.filter(pa.array(kind != FRAGMENT))
            own = kind == FRAGMENT
            if own.any():
                some.append(tuple(b.column(i).to_numpy()[own] for i in (1, 2, 3)))
                waiting += int(own.sum())
            if waiting > _PACK:
                out, some = sets(some, False)
                waiting = len(some[0][0])
                yield from out
        if waiting:
            yield from sets(some, True)[0]

    return rows.repartition("number").sortWithinPartitions("number").mapInArrow(run, _FOUND)


def covering(own: DataFrame, members: DataFrame, parts: int) -> DataFrame:
    """(record, fragments): how many fragments have a class of each record; own: (number, n, c0, c1), the classes of n fragments; members: (record, c0, c1).

    Each part of the records gets what meets them, and forms the distinct pairs of a number and a record some millions
    at a time; of a class with very many records and fragments, no pair is ever a row.
    """
    members = members.select(F.pmod(F.hash("record"), F.lit(parts)).alias("p"), "record", "c0", "c1")
    held = members.select(F.col("p"), F.lit(0).alias("side"), F.col("record").alias("number"), F.lit(0).cast("long").alias("n"), "c0", "c1")
    asked = own.join(members.select("p", "c0", "c1").distinct(), ["c0", "c1"]).select("p", F.lit(1).alias("side"), "number", "n", "c0", "c1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, classes, some, waiting = None, {}, [], 0
        for b in batches:
            p = b.column(0).to_numpy()
            key = 2 * p.astype(np.int64) + b.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for at, stop in zip(cut.tolist(), [*cut.tolist()[1:], len(key)], strict=True):
                rows = tuple(b.column(i).to_numpy()[at:stop] for i in range(2, 6))
                if p[at] != now:
                    if now is not None:
                        cover.add(some, True)
                        yield cover.result()
                    now, cover, some, waiting = p[at], _Cover(), [], 0
                if key[at] % 2 == 0:
                    cover.hold(rows)
                    continue
                some.append(rows)
                waiting += stop - at
                if waiting > _PACK:
                    some = cover.add(some, False)
                    waiting = len(some[0][0])
        if now is not None:
            cover.add(some, True)
            yield cover.result()

    return held.unionByName(asked).repartition("p").sortWithinPartitions("p", "side", "number").mapInArrow(run, "record long, fragments long")


class _Cover:
    """The records of a part and their classes, and how many fragments have met them."""

    def __init__(self):
        self.held: list[tuple[np.ndarray, ...]] = []
        self.classes: dict[tuple[int, int], int] | None = None

    def hold(self, rows: tuple[np.ndarray, ...]) -> None:
        self.held.append(rows)

    def _close(self) -> None:
        records, _, c0, c1 = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held = []
        self.records, own = np.unique(records, return_inverse=True)
        order = np.lexsort((c1, c0))
        self.own, c0, c1 = own[order], c0[order], c1[order]
        self.start = np.flatnonzero(np.append(True, (c0[1:] != c0[:-1]) | (c1[1:] != c1[:-1])))
        self.size = np.diff(np.append(self.start, len(c0)))
        self.classes = {x: i for i, x in enumerate(zip(c0[self.start].tolist(), c1[self.start].tolist(), strict=True))}
        self.total = np.zeros(len(self.records), dtype=np.int64)

    def add(self, some: list[tuple[np.ndarray, ...]], last: bool) -> list[tuple[np.ndarray, ...]]:
        """Count rows that come in the order of their numbers; gives back those of the last number, which may go on."""
        if self.classes is None:
            self._close()
        if not some:
            return some
        number, n, c0, c1 = (np.concatenate(x) for x in zip(*some, strict=True))
        cls = np.array([self.classes[x] for x in zip(c0.tolist(), c1.tolist(), strict=True)], dtype=np.int64)
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        upto = len(number) if last else int(first[-1])
        after = np.cumsum(self.size[cls])
        at = 0
        while at < upto:
            stop = int(np.searchsorted(after, (after[at - 1] if at else 0) + 4 * _PACK, "right"))
            nth = int(np.searchsorted(first, stop, "right")) - 1  # whole numbers, one at least
            stop = upto if stop >= upto else int(first[nth]) if first[nth] > at else int(first[nth + 1]) if nth + 1 < len(first) else upto
            size = self.size[cls[at:stop]]
            here = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - self.start[cls[at:stop]], size)
            row = np.repeat(np.searchsorted(first, np.arange(at, stop), "right") - 1, size)
            pairs = np.sort((row - row[0]) * len(self.records) + self.own[here])
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
            np.add.at(self.total, pairs % len(self.records), n[first[pairs // len(self.records) + row[0]]])
            at = stop
        return [tuple(x[upto:] for x in (number, n, c0, c1))]

    def result(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[self.total > 0]) for x in (self.records, self.total)], ["record", "fragments"])


def shared(records: DataFrame, fragments: DataFrame, k: int = KMER) -> DataFrame:
    """(number, fragments, kmer_hits) of records (number, sequence) that share a k-mer with some of the fragments (ordinal, r1, r2).

    Numbers may repeat: such rows are one record. fragments counts the distinct ordinals, kmer_hits the distinct k-mers of each of them
    in the record. Fragments with k-mers of the same classes are counted together, before they meet the classes' records.
    """
    records = materialized(spread(records, "sequence"))
    letters = records.agg(F.coalesce(F.sum(F.length("sequence").cast("long")), F.lit(0))).first()[0]
    bits = gate.bloom_bits(letters // 4)  # there is a word in some four letters

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gate._own_blocks((pa.array(key) for b in batches if b.num_rows for key in test_keys(b.column(0), k)), bits, 2)

    only = gate._blocks_test(gate._merged_blocks(_letters(records, [], "sequence", k).mapInArrow(blocks, gate._BLOCK_ROWS)), bits, 2)
    parts = max(4 * records.sparkSession.sparkContext.defaultParallelism, letters // _PART)
    reads = fragments.select("ordinal", F.concat_ws("-", "r1", "r2").alias("sequence"))
    rows = packed(records, "number", "sequence", 0, parts, k).unionByName(packed(reads, "ordinal", "sequence", 1, parts, k, only))
    found = materialized(counted(met(rows, k)))
    sets = found.filter(f"kind = {SET}").groupBy("c0", "c1").agg(F.min("number").alias("number"), F.sum("n").alias("n")).select("number", "n")
    own = found.filter(f"kind = {FRAGMENT}").select("number", "c0", "c1")
    members = found.filter(f"kind = {RECORD}").select(F.col("number").alias("record"), "c0", "c1").distinct()
    total = covering(own.join(sets, "number"), members, max(2 * records.sparkSession.sparkContext.defaultParallelism, letters >> 24))
    hits = found.filter(f"kind = {HITS}").groupBy(F.col("number").alias("record")).agg(F.sum("n").alias("kmer_hits"))
    return total.join(hits, "record").select(F.col("record").alias("number"), "fragments", "kmer_hits")
