"""Problem 8: texts above a token limit, cut into pieces at natural boundaries.

Method: each token end has a boundary strength; a sparse table of range maxima over (strength, position) answers, for
each permissible window of piece lengths, which cut is the strongest, ties going to the rightmost. The next piece
starts `overlap` tokens before the cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.tokens import clean, encoder, shipped, token_lengths

CELL, PARAGRAPH, LINE, SENTENCE, BLANK, CHARACTER = 6, 5, 4, 3, 2, 1
#: Where a cell begins in the three layouts; the closing fence ends one.
_CELL_START = re.compile(rb'^(?:# %%|```[^\s`])|\{\s*"cell_type"', re.M)
#: The end of a line of a cell inside a notebook file.
_FILE_LINE = re.compile(rb'\\n", "')
_CELL_END = re.compile(rb"^```[ \t]*\r?\n", re.M)


def boundary_strengths(data: bytes, ends: np.ndarray) -> np.ndarray:
    """The strength of a cut at each byte offset of `ends`; 0 inside a character, where no cut is allowed."""
    b = np.frombuffer(data, dtype=np.uint8)
    n = len(b)
    s = np.full(n + 1, CHARACTER, dtype=np.int64)
    s[:n][(b & 0xC0) == 0x80] = 0
    blank = (b == 32) | (b == 9) | (b == 10) | (b == 13)
    s[:n][blank] = BLANK
    stop = (b == 46) | (b == 33) | (b == 63)
    s[1:n][stop[:-1] & blank[1:]] = SENTENCE
    if n >= 3:  # the full stop, exclamation and question marks of CJK texts
        wide = (b[:-2] == 0xE3) & (b[1:-1] == 0x80) & (b[2:] == 0x82) | (b[:-2] == 0xEF) & (b[1:-1] == 0xBC) & ((b[2:] == 0x81) | (b[2:] == 0x9F))
        s[3:][wide] = SENTENCE
    # Tokens may hold blanks together with what follows, so a break counts both before and after its blanks.
    solid = np.flatnonzero(~blank)

    def raise_to(at: np.ndarray, value: int) -> None:
        before = np.searchsorted(solid, at)
        for x in (at, np.where(before > 0, solid[before - 1], -1) + 1 if len(solid) else at):
            s[x] = np.maximum(s[x], value)

    line = np.flatnonzero(b == 10) + 1
    raise_to(line, LINE)
    if len(line) > 1:  # a line without anything solid ends a paragraph
        raise_to(line[1:][np.searchsorted(solid, line[1:]) == np.searchsorted(solid, line[:-1])], PARAGRAPH)
    raise_to(np.array([m.start() + 4 for m in _FILE_LINE.finditer(data)], dtype=np.int64), LINE)
    raise_to(np.array([m.start() for m in _CELL_START.finditer(data)], dtype=np.int64), CELL)
    raise_to(np.array([m.end() for m in _CELL_END.finditer(data)], dtype=np.int64), CELL)
    return s[ends]


class RangeMaximum:
    """Sparse table: the position of the largest value in [a, b], of equals the rightmost."""

    def __init__(self, values: np.ndarray, widest: int):
        self.levels = [values * len(values) + np.arange(len(values))]
        step = 1
        while 2 * step <= min(widest, len(values)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-step], last[step:]))
            step *= 2
        self.n = len(values)

    def argmax(self, a: int, b: int) -> int:
        k = min((b - a + 1).bit_length() - 1, len(self.levels) - 1)
        level = self.levels[k]
        return int(max(level[a], level[b - (1 << k) + 1])) % self.n


def cuts(strength: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Token ranges [start, end) of the pieces; strength[i] is that of a cut after token i.

    A piece is cut where the boundary is strongest among lengths from half the limit to the limit. Its successor
    starts `overlap` tokens before the cut, or up to three more where that would be inside a character.
    """
    n = len(strength)
    if n <= limit:
        return [(0, n)] if n else []
    least = max(limit // 2, overlap + 4)
    if least > limit:
        raise ValueError("the overlap must be smaller than the limit by 4 tokens or more")
    best = RangeMaximum(strength, limit - least + 1)
    out, start = [], 0
    while n - start > limit:
        end = best.argmax(start + least - 1, start + limit - 1) + 1
        out.append((start, end))
        start = end - overlap
        while start > 0 and not strength[start - 1]:
            start -= 1
    return [*out, (start, n)]


def split_long(documents: DataFrame, limit: int, overlap: int, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, n_tokens, char_start, char_end, text): the pieces of each text above `limit` tokens, in order.

    token_start and token_end are places in the tokenization of the whole text: the pieces cover it without a gap.
    char_start and char_end are the same in its characters.
    Null, empty and short texts give no piece. Repeated doc_ids are split one by one.
    """
    path = shipped(documents.sparkSession, vocabulary)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lengths = encoder(path()), token_lengths(path())
        names = ["doc_id", "piece_no", "token_start", "token_end", "n_tokens", "char_start", "char_end", "text"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            size = 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = clean(text.as_py())
                data = text.encode()
                if len(data) <= limit:  # a token is at least one byte
                    continue
                ids = np.array(enc.encode_ordinary(text), dtype=np.int64)
                if len(ids) <= limit:
                    continue
                ends = np.cumsum(lengths[ids])
                chars = np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)[ends - 1]  # characters up to each token's end
                for k, (a, b) in enumerate(cuts(boundary_strengths(data, ends), limit, overlap)):
                    piece = data[ends[a - 1] if a else 0 : ends[b - 1]].decode()
                    size += len(piece)
                    for col, v in zip(cols, (doc, k, a, b, b - a, int(chars[a - 1]) if a else 0, int(chars[b - 1]), piece), strict=True):
                        col.append(v)
                if size > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)
                    cols, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    rows = documents.select("doc_id", "text").filter("text is not null")
    return rows.mapInArrow(split, "doc_id long, piece_no int, token_start long, token_end long, n_tokens int, char_start long, char_end long, text string")


def rejoined(pieces: DataFrame) -> DataFrame:
    """(doc_id, text): the pieces of each text put together again, without their overlaps. doc_id must be unique among the texts that were split."""
    own = F.array_sort(F.collect_list(F.struct("piece_no", "char_start", "char_end", "text")))
    new = lambda seen, p: F.substring(p.text, (seen.end - p.char_start + 1).cast("int"), F.length(p.text))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts"))
    step = lambda seen, p: F.struct(p.char_end.alias("end"), F.concat(seen.parts, F.array(new(seen, p))).alias("parts"))
    return pieces.groupBy("doc_id").agg(own.alias("own")).select("doc_id", F.aggregate("own", start, step, lambda seen: F.array_join(seen.parts, "")).alias("text"))
