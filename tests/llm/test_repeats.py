"""Problem 4: covered spans against brute force, and what recompression promises."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from seqloom import common
from seqloom.llm import recompression, repeats

SPAN = 42


def letters(s):
    return re.sub("[^A-Z]", "", s.upper()) if s else ""


def brute(base, others):
    """base, others: (key, text). Sets of (tbl, key, start, end)."""
    where = {}
    for k, s in base:
        for i in range(len(s) - SPAN + 1):
            where.setdefault(s[i : i + SPAN], set()).add(k)
    out = set()
    for tbl, rows in ((0, base), (1, others)):
        for k, s in rows:
            hit = [i for i in range(len(s) - SPAN + 1) if (w := where.get(s[i : i + SPAN])) and (tbl or w - {k})]
            spans = []
            for i in hit:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + SPAN
                else:
                    spans.append([i, i + SPAN])
            out |= {(tbl, k, a, b) for a, b in spans}
    return out


def corpus(seed=1):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = [fresh(n) for n in (42, 43, 60, 200, 500)] + ["A" * 60, "AC" * 40, "ACG" * 30, "A" * 41, "N" * 50]
    base = []
    for _ in range(40):
        base.append(fresh(rng.randrange(0, 50)) + rng.choice(shared) + fresh(rng.randrange(0, 50)) + rng.choice(shared)[: rng.randrange(30, 120)])
    base += [base[0], base[1][:-1], base[2][:70] + "N" + base[2][70:], "", "ACGT", fresh(300), "A" * 300, "T" * 43, "AC" * 100]
    reads = [s[i : i + 100] for s in base for i in (0, 13, 57) if s] + [fresh(100) for _ in range(20)] + ["C" * 100, "A" * 42, "A" * 41, "ZZ" * 40]
    return list(enumerate(base)), list(enumerate(reads))


@pytest.mark.parametrize(("hot", "portion", "most"), [(repeats.HOT, 1 << 20, repeats.NAMES), (3, 1 << 20, 20), (repeats.HOT, 150, repeats.NAMES)])
def test_spans_equal_brute_force(spark, hot, portion, most):
    base, reads = corpus()
    spelled = [(k, s.lower()[:9] + "- \n" + s[9:], "x", "y") for k, s in base] + [(900, None, "x", "y")]
    b = spark.createDataFrame(spelled, "k long, sequence string, key string, seg string").repartition(3)
    r = spark.createDataFrame([*reads, *reads[:30], (901, None), (902, "")], "k long, r1 string")
    got = repeats.shared_spans((b, "k", "sequence"), (r, "k", "r1"), SPAN, most=most, portion=portion, hot=hot)
    rows = [(x.tbl, x.rec, x.span_start, x.span_end) for x in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(base, reads)


def test_hot_anchor_of_other_letters(spark):
    rng = random.Random(3)
    s = "".join(rng.choice("ACGTN") for _ in range(120))
    base = [(i, s[rng.randrange(0, 20) : 100 + rng.randrange(0, 20)]) for i in range(60)]
    df = spark.createDataFrame(base, "k long, sequence string")
    got = repeats.shared_spans((df, "k", "sequence"), None, SPAN, hot=10)
    assert {(x.tbl, x.rec, x.span_start, x.span_end) for x in got.collect()} == brute(base, [])


@pytest.mark.parametrize("span", [512, 4096])
def test_different_texts_of_equal_fingerprints_share_nothing(spark, span):
    """A word of alternating parity and the same with its letters swapped: all fingerprints modulo 2**64 agree."""
    word = "".join("AC"[i.bit_count() % 2] for i in range(span))
    swapped = word.translate(str.maketrans("AC", "CA"))
    for hot in (repeats.HOT, 1):
        df = spark.createDataFrame([(0, word), (1, swapped)], "k long, sequence string")
        assert repeats.shared_spans((df, "k", "sequence"), None, span, hot=hot).count() == 0
        df = spark.createDataFrame([(0, word), (1, swapped), (2, "G" + swapped), (3, word + "T")], "k long, sequence string")
        got = {(x.rec, x.span_start, x.span_end) for x in repeats.shared_spans((df, "k", "sequence"), None, span, hot=hot).collect()}
        assert got == {(0, 0, span), (3, 0, span), (1, 0, span), (2, 1, span + 1)}


def test_empty(spark):
    df = spark.createDataFrame([], "k long, sequence string")
    assert repeats.shared_spans((df, "k", "sequence"), (df, "k", "sequence"), SPAN).count() == 0


def names_of(texts, rounds=repeats.ROUNDS, most=repeats.NAMES):
    codes, names = repeats._coded(pa.array(texts))[0], recompression.Names()
    for _ in range(rounds + 1):
        code, n = recompression.counted(codes, names)
        names.add(code[np.argsort(-n, kind="stable")][:most].tolist())
    return names


def test_equal_substrings_have_equal_interior_symbols():
    rng = random.Random(7)
    for alphabet in ("ACGT", "AC", "AAAC"):
        w = "".join(rng.choice(alphabet) for _ in range(150))
        found = []
        texts = [tuple("".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(2)) for _ in range(6)]
        names = names_of([left + w + right for left, right in texts], most=40)
        for left, right in texts:
            text = left + w + right
            codes = np.array([0, *[ord(c) - 64 for c in text], 0], dtype=np.uint8)
            name, start, low, high = recompression.parse(codes, names)
            at = len(left) + 1
            inside = (low >= at) & (high <= at + len(w))
            found.append(list(zip(name[inside].tolist(), (start[inside] - at).tolist(), strict=True)))
        assert all(f == found[0] for f in found)
        assert alphabet == "AAAC" or found[0]


def test_segments_hold_each_window_once():
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (42, 43, 100, 500)] + ["A" * 90, "ACGTN" * 20]
    codes, begin, length = repeats._coded(pa.array(texts))
    key, at, windows = repeats.segments(codes, begin, length, SPAN, names_of(texts))
    seen = sorted(int(a) + i for a, n in zip(at, windows, strict=True) for i in range(n))
    assert seen == sorted(int(b) + i for b, n in zip(begin, length, strict=True) for i in range(n - SPAN + 1))
    n, seg = repeats._packed(codes, at, windows + SPAN - 1)
    back, _ = repeats._unpacked(n, seg)
    assert (back == codes[repeats._ranges(at, windows + SPAN - 1)]).all() and (n < 0).any()


def test_shares(spark):
    spans = spark.createDataFrame([(0, 0, 42), (0, 50, 92)], "rec long, span_start long, span_end long")
    rows = spark.createDataFrame([(0, "A-" * 168), (1, "ACGT"), (2, None), (1, "ac")], "k long, s string")
    got = {r.rec: (r.n_letters, r.covered, r.share) for r in repeats.shares(spans, rows, "k", "s").collect()}
    assert got == {0: (168, 84, 0.5), 1: (4, 0, 0.0), 2: (0, 0, 0.0)}


def packed(texts):
    codes, begin, length = repeats._coded(pa.array(texts))
    return repeats._packed(codes, begin, length)


@pytest.mark.parametrize("span", [5, 12, 22, 32, 33, 42, 64, 65, 100])
@pytest.mark.parametrize("one_hash", [False, True])
def test_windows_meet_by_all_letters(monkeypatch, span, one_hash):
    """Segments with and without letters other than ACGT; also where all windows have one hash."""
    if one_hash:
        monkeypatch.setattr(repeats, "mix", lambda x: x & np.uint64(0))
    rng = random.Random(span)
    shared = "".join(rng.choice("ACGT") for _ in range(130))
    texts = []
    for i in range(40):
        t = shared[rng.randrange(0, 20) :] if i % 3 else "A" * 120
        t = list(t[: rng.randrange(span, 131)].ljust(span, "T"))
        for _ in range(i % 4):
            t[rng.randrange(len(t))] = rng.choice("ACGTNZ")
        texts.append("".join(t))
    n, seg = packed(texts)
    low = np.array([k if k % 2 else 1 << 40 for k in range(40)])
    high = np.array([k if k % 2 else -1 for k in range(40)])
    where = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - span + 1):
            where.setdefault(t[i : i + span], []).append(k)
    expect = []
    for k, t in enumerate(texts):
        for i in range(len(t) - span + 1):
            held = where[t[i : i + span]]
            expect.append((k, i, min(low[held]), max(high[held])))
    assert list(zip(*(x.tolist() for x in repeats.shared_windows(n, seg, low, high, span)), strict=True)) == expect


def test_copies_of_a_segment_are_searched_once():
    """All windows of all copies were unpacked and sorted before: most of the query's CPU time, and 56 MB at the peak here."""
    rng = random.Random(5)
    n, seg = packed(["".join(rng.choice("ACGT") for _ in range(75))] * 10_000)
    rec, place = np.arange(10_000), repeats._place(0, np.full(10_000, 7), n)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(10_000, np.int32)), pa.array(rec), pa.array(place), seg], ["key", "rec", "place", "seg"])
    tracemalloc.start()
    rows = pa.Table.from_batches(repeats.key_spans(iter([batch]), SPAN)).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((r["tbl"], r["rec"], r["a"], r["b"]) for r in rows) == [(0, k, 7, 82) for k in range(10_000)]
    assert peak < 20e6


def test_texts_come_as_common_letters(spark):
    texts = ["ACGTacgt" * 6, "ac gt\n-" * 20, "ß" * 30, "ı" * 50, "ſ" * 42 + "ﬃ", "é" + "acgt" * 11, "a\0c" * 30, "", None, "A" * 41]
    df = spark.createDataFrame([*enumerate(texts), (None, "A" * 60)], "k int, s string").repartition(3)
    got = repeats._texts(df, "k", "s").mapInArrow(lambda batches: repeats._lettered(batches, SPAN), "rec long, letters string")
    every = {r.k: r.s for r in df.select("k", common.letters("s").alias("s")).collect() if r.k is not None and r.s is not None}
    assert {(r.rec, r.letters) for r in got.collect()} == {(k, s) for k, s in every.items() if len(s) >= SPAN}
