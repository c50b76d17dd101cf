"""Known answers of the scalar functions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import dust, registry, seq, stats
from seqloom.sources import report


def test_capacity_known_answers():
    assert stats.sample_capacity(20560, "standard") == 1_292_678
    assert [stats.sample_capacity(1, p) for p in ("fast", "standard", "SENSITIVE")] == [29_956, 299_572, 2_995_731]
    assert stats.sample_capacity(2, "fast") == 36_887 and stats.sample_capacity(25, "fast") == 62_143
    with pytest.raises(ValueError):
        stats.sample_capacity(0, "fast")


def test_interval_known_answers():
    assert stats.population_interval(35_801_278, 1_268_602, 51, 0.05 / 20560) == (692, 2612)
    assert stats.population_interval(1000, 100, 10, 0.05) == (51, 173)
    assert stats.population_interval(10, 10, 3, 0.05) == (3, 3)
    with pytest.raises(ValueError):
        stats.population_interval(10, 11, 3, 0.05)


def _tails(p, m, n, x):
    w = [math.comb(m, i) * math.comb(p - m, n - i) for i in range(n + 1)]
    return sum(w[x:]), sum(w[: x + 1]), math.comb(p, n)


def test_interval_against_enumeration():
    for p in range(1, 15):
        for n in range(1, p):
            for x in range(n + 1):
                for alpha in (0.05, 0.05 / 20560):
                    lo, hi = stats.population_interval(p, n, x, alpha)
                    feasible = range(x, p - (n - x) + 1)
                    above = [m for m in feasible if _tails(p, m, n, x)[0] / _tails(p, m, n, x)[2] > alpha / 2]
                    below = [m for m in feasible if _tails(p, m, n, x)[1] / _tails(p, m, n, x)[2] >= alpha / 2]
                    assert lo == (0 if x == 0 else max(x, above[0] - 1)), (p, n, x)
                    assert hi == (p if x == n else min(p - (n - x), below[-1] + 1)), (p, n, x)


def test_texts_and_scores():
    assert stats.decimal_text(54.545454545454545, 10) == "54.5454545455"
    assert stats.decimal_text(5e-7) == "0" and stats.decimal_text(100.0) == "100"
    assert stats.outward_percent(1.0, False) == "99.9999999999" and stats.outward_percent(1.0, True) == "100"
    for f in (random.Random(3).random() for _ in range(200)):
        lo, hi = float(stats.outward_percent(f, False)), float(stats.outward_percent(f, True))
        assert lo <= f * 100 <= hi and hi - lo <= 3e-10
    assert report._quoted('a"b') == '"a""b"' and report._quoted("a,b") == '"a,b"' and report._quoted("a") == "a"


def test_target_score(spark):
    d = 1e-5
    rows = spark.createDataFrame([(0.0,), (d,), (3 * d,)], "p double").select(stats.target_score(F.col("p"), F.lit(d)).alias("s")).collect()
    assert [round(r.s, 12) for r in rows] == [-1.0, 0.0, 0.5]


def test_dust_known_answers_and_symmetry():
    assert dust.dust_intervals("A" * 200) == [(0, 200)]
    assert dust.dust_intervals("A" * 80 + "N" + "A" * 80) == [(0, 80), (81, 161)]
    assert dust.dust_batch([None, "", "AC", "ACGT"]) == [[], [], [], []]
    rng, swap = random.Random(5), str.maketrans("ACGT", "TGCA")
    reads = ["".join(rng.choice("ACGT" if rng.random() < 0.3 else "AC") for _ in range(120)) for _ in range(60)]
    for read, a, b in zip(reads, dust.dust_batch(reads), dust.dust_batch([r[::-1].translate(swap) for r in reads]), strict=True):
        n = len(read)
        assert a == [(n - e, n - s) for s, e in reversed(b)]
        assert a == dust.dust_intervals(read)


def test_dust_searches_suspects_alone(monkeypatch):
    """Texts without a stretch above the limit never reach the search, and none with one is lost."""
    rng, searched, perfect = random.Random(8), [], dust._perfect
    plain = ["".join(rng.choice("ACGT") for _ in range(100)) for _ in range(500)]
    low = [t[:40] + "".join(rng.choice(u) for u in (list("ACA"), list("A"), list("AG")) for _ in range(rng.randrange(3, 12))) + t[40:] for t in plain[:50]]
    texts = plain + low + [None, "N" * 90]
    want = []
    for t in texts:  # each text searched on its own
        codes = dust._CODE[np.frombuffer((t or "").encode() + b"\n\n\n", dtype=np.uint8)]
        want.append({i for a, b in zip(*perfect(codes, 62, 2.0), strict=True) for i in range(a, b)})
    monkeypatch.setattr(dust, "_perfect", lambda codes, *a: searched.append(len(codes)) or perfect(codes, *a))
    assert [{i for a, b in x for i in range(a, b)} for x in dust.dust_batch(texts)] == want and sum(map(bool, want)) > 20
    assert sum(searched) < 0.4 * sum(len(t or "") for t in texts)


def _dust_by_definition(read, widest=62):
    t = [read[i : i + 3] for i in range(len(read) - 2)]

    def score(i, j):
        part = t[i:j]
        return sum(part.count(x) * (part.count(x) - 1) // 2 for x in set(part)) / (len(part) - 1) if len(part) > 1 else 0.0

    s = {(i, j): score(i, j) for i in range(len(t)) for j in range(i + 1, min(len(t), i + widest) + 1)}
    masked = set()
    for (i, j), v in s.items():
        if v > 2 and all(s[a, b] <= v for a in range(i, j) for b in range(a + 1, j + 1)):
            masked |= set(range(i, j + 2))
    return masked


def test_dust_by_definition():
    rng = random.Random(9)
    for _ in range(12):
        read = "".join(rng.choice("AC" if rng.random() < 0.7 else "ACGT") for _ in range(26))
        got = {i for a, b in dust.dust_intervals(read) for i in range(a, b)}
        assert got == _dust_by_definition(read)


ALPHABET, COMPLEMENT = "ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"


def _kmers(text, k):
    out = []
    for i in range(len(text) - k + 1):
        w = text[i : i + k].upper()
        if all(c in ALPHABET for c in w):
            f = "".join("0123456789abcde"[ALPHABET.index(c)] for c in w)
            r = "".join("0123456789abcde"[ALPHABET.index(COMPLEMENT[ALPHABET.index(c)])] for c in reversed(w))
            out.append((i, min(f, r)))
    return out


@pytest.mark.parametrize("k", [1, 7, 21, 31])
def test_kmers_against_slices(spark, k):
    rng = random.Random(k)
    texts = ["".join(rng.choice(ALPHABET + "acgtxX-") for _ in range(n)) for n in (0, 1, k - 1, k, k + 1, 99, 100, 120, 121, 350)] + ["A" * 300, None]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = sorted((r.n, r.pos, r.kmer) for r in seq.with_kmers(df, ["n"], "t", k).collect())
    assert got == sorted((n, i, w) for n, t in enumerate(texts) if t for i, w in _kmers(t, k))


def test_canonical_kmer_is_strand_free(spark):
    df = spark.createDataFrame([("ACGTMRWSYKVHDBNACGTMR",)], "s string")
    r = df.select(seq.canonical_kmer("s").alias("a"), seq.canonical_kmer(seq.reverse_complement("s")).alias("b"), seq.reverse_complement(seq.reverse_complement("s")).alias("c")).first()
    assert r.a == r.b and r.c == "ACGTMRWSYKVHDBNACGTMR"


def test_names(spark):
    ids = {"r1/1": "r1", "r1/2 x": "r1", " r1/1/2": "r1/1", "r1/3": "r1/3", "  ": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in ids.items()], "i string, w string")
    assert all(r.w == r.got for r in df.select("w", seq.normalized_read_id("i").alias("got")).collect())
    files = {"a/x_R1.fastq.gz": "x", "x_1.fq": "x", "x_R1_1.fastq.gz": "x_R1", "x.gz.gz": "x.gz"}
    df = spark.createDataFrame(list(files.items()), "f string, w string")
    got = {r.f: r.got for r in df.select("f", seq.sample_id("f").alias("got")).collect()}
    assert got["a/x_R1.fastq.gz"] == "x" and got["x_1.fq"] == "x" and got["x.gz.gz"] == "x.gz"


def test_all_mates_of_verdict_columns():
    assert len(report.COLUMNS) == 24 and len(set(itertools.chain(report.COLUMNS))) == 24


def test_functions_by_name_in_sql(spark):
    registry.register_functions(spark)
    r = spark.sql("SELECT revcomp('acgtm') AS rc, canonical_kmer('TTTT') AS c, kmers('acgXacgt', 3) AS k, kmers('AC', 3) AS none, kmers(CAST(NULL AS STRING), 3) AS lost, dust_intervals(repeat('A', 200)) AS d").first()
    assert (r.rc, r.c, r.none, r.lost) == ("KACGT", "0000", [], None)
    assert [tuple(x) for x in r.k] == [(0, "012"), (4, "012"), (5, "012")]  # CGT is ACG on the other strand
    assert [tuple(x) for x in r.d] == [(0, 200)]
    r = spark.sql("SELECT hypergeom_interval(1000, 100, 10, 0.05D) AS i, sample_capacity(20560L, 'standard') AS n, sample_capacity(0L, 'standard') AS no, outward_pct_lower(1.0D) AS lo, outward_pct_upper(1.0D) AS hi").first()
    assert (tuple(r.i), r.n, r.no, r.lo, r.hi) == ((51, 173), 1_292_678, None, "99.9999999999", "100")
