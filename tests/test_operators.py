"""Operators against small known answers and plain Python."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.common import bottom_k_per_group
from seqloom.functions import seq
from seqloom.operators import adjudicate, align, evidence, gate, grouping, rank, sampling
from seqloom.plans import queries

HITS = "ordinal long, mate int, role string, target_group_ordinal int, alignment_score int, query_length int, query_start int, query_end int, target_start long, target_end long, supplementary boolean"


def hit(ordinal, mate, role, group, score, qs=0, qe=100, ts=0, te=100, extra=False, q=100):
    return (ordinal, mate, role, group, score, q, qs, qe, ts, te, extra)


def xorshift(seed, n):
    out, s = [], seed
    for _ in range(n):
        s ^= (s << 13) & (2**64 - 1)
        s ^= s >> 7
        s ^= (s << 17) & (2**64 - 1)
        out.append("ACGT"[s & 3])
    return "".join(out)


def test_bottom_k_per_group_is_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["%06x" % rng.randrange(1 << 24), "000aaa", None]), i, rng.choice([5])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, h string, i int, q int")
    want = set()
    for g in ("a", "b", None):
        want |= set(sorted((h, i) for gg, h, i, _ in rows if gg == g and h is not None)[:5])
    for parts in (1, 4, 16):
        got = bottom_k_per_group(df.repartition(parts), ["g"], "h", "i", "q").collect()
        assert {(r.h, r.i) for r in got} == want
    assert bottom_k_per_group(df.filter("false"), ["g"], "h", "i", "q").count() == 0
    assert bottom_k_per_group(df.withColumn("q", F.lit(0)), ["g"], "h", "i", "q").count() == 0


def test_bottom_k_is_mergeable(spark):
    rows = spark.range(2000).select(F.col("id").alias("ordinal"), F.sha2(F.col("id").cast("string"), 256).alias("key"))
    whole = {r.ordinal for r in sampling.bottom_k(rows, 100).collect()}
    assert len(whole) == 100 and whole == {r.ordinal for r in rows.orderBy("key", "ordinal").limit(100).collect()}
    parts = sampling.bottom_k(rows.filter("ordinal < 700"), 100).unionByName(sampling.bottom_k(rows.filter("ordinal >= 700"), 100))
    assert {r.ordinal for r in sampling.bottom_k(parts, 100).collect()} == whole


def test_dense_ordinals_with_clashing_names(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "_at int, _pid int")
    got = grouping.dense_ordinals(df, ["_pid"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(500)) and [r["_pid"] for r in got] == list(range(500))
    assert grouping.dense_ordinals(df.filter("false"), ["_pid"], "n").count() == 0


def test_grouping_by_either_strand(spark):
    b = "ACGMRN"
    a = b[::-1].translate(str.maketrans("ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"))
    fasta = spark.createDataFrame([(0, "p.fa", "b", "|| about b ", b), (1, "p.fa", "a ", None, a.lower()), (2, "p.fa", "c", "", "ACG-MR R"), (3, "p.fa", None, "", "ACGT"), (4, "p.fa", "e", "", "ACGE"), (5, "host.fa", "h", "", "ACGT"), (6, "p.fa", "z", "", None)], "rec_ordinal long, source string, id string, description string, sequence string")
    records = grouping.panel_records(fasta)
    groups = grouping.reference_groups(records.filter("not is_host")).collect()
    assert sorted(tuple(g.member_ids) for g in groups) == [("a", "b"), ("c",)]
    assert [g.group_ordinal for g in sorted(groups, key=lambda g: g.target_group_id)] == [0, 1]
    ab = next(g for g in groups if len(g.member_ids) == 2)
    assert ab.representative_id == "a" and ab.representative_description == "" and ab.representative_length == 6
    contigs = {r.name: r for r in grouping.contigs(records, spark.createDataFrame(groups)).collect()}
    assert contigs[ab.contig_name].sequence == a and contigs["host_0"].role == "HOST" and len(contigs) == 3


TARGET = "AGTCGATCCTAGGCTAACGTACGTA"


@pytest.mark.parametrize("masked", [False, True])
def test_gate_thresholds(spark, masked):
    records = spark.createDataFrame([(0, TARGET, False), (1, "A" * 25, False), (2, "C" * 40, True)], "rec_ordinal long, sequence string, is_host boolean")
    kmers = gate.target_kmers(records)
    reads = [("short", TARGET[:20], None), ("one", TARGET[:21], None), ("two", TARGET[:22], None), ("five", TARGET, None), ("lower", TARGET.lower(), None), ("odd", "XXXX" * 10, None), ("empty", "", None), ("none", None, None), ("host", "C" * 40, None), ("pair", TARGET[:21], "A" * 25), ("low", "A" * 25, None)]
    rows = spark.createDataFrame([(i, "r", a, b) for i, (_, a, b) in enumerate(reads)], "ordinal long, run_id string, r1 string, r2 string")
    got = {reads[r.ordinal][0]: r.verdict for r in gate.gate(rows, kmers, masked).collect()}
    want = {"short": "NotEvaluable", "one": "Negative", "two": "Negative", "five": "Pass", "lower": "Pass", "odd": "NotEvaluable", "empty": "NotEvaluable", "none": "NotEvaluable", "host": "Negative", "pair": "Pass", "low": "Pass"}
    if masked:
        want |= {"low": "NotEvaluable", "host": "NotEvaluable"}
    assert got == want


def test_gate_state_counts_masked_hits(spark):
    records = spark.createDataFrame([(0, "A" * 40, False)], "rec_ordinal long, sequence string, is_host boolean")
    ends = spark.createDataFrame([(0, 1, "A" * 30)], "ordinal long, mate int, sequence string")
    r = gate.gate_states(ends, gate.kmer_hits(ends, gate.target_kmers(records)), True).first()
    assert (r.hits, r.covered, r.present, r.evaluable, r.chain_ok) == (10, 30, False, False, True)


def test_bloom_loses_nothing(spark):
    rng = random.Random(2)
    kmers = ["".join(rng.choice("0123") for _ in range(21)) for _ in range(3000)]
    panel = spark.createDataFrame([(k,) for k in kmers[:500]], "kmer string")
    passed = gate.bloom_test(panel)(np.array(kmers, dtype="S21"))
    assert passed[:500].all() and passed.sum() < 600
    assert not gate.bloom_test(panel.filter("false"))(np.array(kmers, dtype="S21")).any()
    s = gate.bloom_summary(panel).first()
    assert s.inserted == 500 and s.bits == 8192 and 0.1 < s.fill < 0.3 and abs(s.false_positive_rate - s.fill**4) < 1e-12


def test_adjudication(spark):
    rows = [
        hit(0, 1, "HOST", None, 80), hit(0, 1, "TARGET", 0, 80),  # a tie goes to the host
        hit(1, 1, "TARGET", 0, 90), hit(1, 1, "TARGET", 1, 90),  # two groups tie
        hit(2, 1, "TARGET", 0, 90), hit(2, 2, "TARGET", 1, 90),  # mates disagree
        hit(3, 1, "TARGET", 0, 90), hit(3, 2, "HOST", None, 50),  # a host mate
        hit(4, 1, "TARGET", 0, 90), hit(4, 1, "TARGET", 1, 90), hit(4, 2, "TARGET", 1, 70), hit(4, 2, "TARGET", 2, 70),  # one in common
        hit(5, 1, "HOST", None, 10),
        hit(6, 1, "TARGET", 0, None), hit(6, 1, "HOST", None, -5),  # both count as 0: the host wins
        hit(7, 1, "TARGET", 0, 90, q=0), hit(7, 1, "TARGET", None, 90), hit(7, 1, "OTHER", 1, 90),
        hit(8, 1, "target", 5, 50, q=100), hit(8, 1, "host", None, 24, q=50),
    ]
    got = {r.ordinal: r for r in adjudicate.fragment_evidence(spark.createDataFrame(rows, HITS)).collect()}
    assert {k: (v.kind, v.groups) for k, v in got.items()} == {
        0: ("Confounded", [0]), 1: ("Unresolved", [0, 1]), 2: ("Unresolved", [0, 1]), 3: ("Supporting", [0]), 4: ("Supporting", [1]),
        5: ("NoTargetEvidence", []), 6: ("Confounded", [0]), 8: ("Supporting", [5]),
    }
    assert got[3].discordant_groups == [0] and got[4].discordant_groups == []
    assert adjudicate.fragment_evidence(spark.createDataFrame([], HITS)).count() == 0


@pytest.mark.parametrize(("t_extra", "h_extra", "apart", "want"), [(True, False, True, [0]), (False, True, True, [0]), (False, False, True, []), (True, True, False, [])])
def test_split_geometry(spark, t_extra, h_extra, apart, want):
    rows = [hit(0, 1, "TARGET", 0, 90, 0, 40, extra=t_extra), hit(0, 1, "HOST", None, 50, 60 if apart else 20, 100, extra=h_extra)]
    assert adjudicate.fragment_evidence(spark.createDataFrame(rows, HITS)).first().split_groups == want


def test_coverage_and_windows(spark):
    rows = [("r", 0, o, 100 + o) for o in range(50)] * 3 + [("r", 1, 0, 10), ("r", 1, 10, 20), ("r", 1, 25, 30), ("s", 1, 5, 6)]
    cover = evidence.coverage_union(spark.createDataFrame(rows, "run_id string, group_ordinal int, start long, end long"), ["run_id", "group_ordinal"])
    got = sorted((r.run_id, r.group_ordinal, r.start, r.end) for r in cover.collect())
    assert got == [("r", 0, 0, 149), ("r", 1, 0, 20), ("r", 1, 25, 30), ("s", 1, 5, 6)]
    groups = spark.createDataFrame([(0, 1000), (1, 30)], "group_ordinal int, representative_length long")
    windows = {(r.run_id, r.group_ordinal): r.occupied_windows for r in evidence.occupied_windows(cover, groups, ["run_id", "group_ordinal"]).collect()}
    assert windows == {("r", 0): 2, ("r", 1): 9, ("s", 1): 1}


def test_banded_alignment_against_full_matrix():
    rng = random.Random(4)

    def smith_waterman(q, t):
        low = -(10**6)
        h = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
        e = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
        f = [[low] * (len(t) + 1) for _ in range(len(q) + 1)]
        best = 0
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                e[i][j] = max(h[i][j - 1] - 14, e[i][j - 1] - 2)
                f[i][j] = max(h[i - 1][j] - 14, f[i - 1][j] - 2)
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if q[i - 1] == t[j - 1] else -8), e[i][j], f[i][j])
                best = max(best, h[i][j])
        return best

    reads, refs, diagonals = [], [], []
    for n in range(30):
        ref = "".join(rng.choice("ACGT") for _ in range(160))
        at = rng.randrange(0, 60)
        read = list(ref[at : at + 80])
        if n % 3 == 1:
            read[30] = "ACGT"[("ACGT".index(read[30]) + 1) % 4]
        if n % 3 == 2:
            del read[40:43]
        if n % 5 == 4:
            read[20:20] = "GATT"
        reads.append("".join(read))
        refs.append(ref)
        diagonals.append(at)
    got = align.banded_local(reads, refs, np.array(diagonals))
    for r in range(30):
        score, q0, q1, t0, t1 = got[r]
        assert score == smith_waterman(reads[r], refs[r])
        assert smith_waterman(reads[r][q0:q1], refs[r][t0:t1]) == score  # the ends are right


def test_alignment_of_reads(spark):
    host, target = xorshift(17, 600), xorshift(91, 600)
    contigs = spark.createDataFrame([("host_0", "HOST", None, host), ("target_0", "TARGET", 0, target)], "name string, role string, target_group_ordinal long, sequence string")
    rc = target[200:320][::-1].translate(str.maketrans("ACGT", "TGCA"))
    ends = spark.createDataFrame([(0, 1, target[5:125]), (1, 1, host[7:127]), (2, 1, rc), (3, 1, "ACGT" * 20), (4, 1, target[100:160] + host[300:360])], "ordinal long, mate int, sequence string")
    got = {}
    for r in align.align(ends, contigs).collect():
        got.setdefault(r.ordinal, []).append((r.role, r.alignment_score, r.query_start, r.query_end, r.target_start, r.target_end, r.supplementary))
    assert got[0] == [("TARGET", 240, 0, 120, 5, 125, False)] and got[1] == [("HOST", 240, 0, 120, 7, 127, False)]
    assert got[2] == [("TARGET", 240, 0, 120, 200, 320, False)] and 3 not in got
    assert {(h[0], h[6]) for h in got[4]} == {("HOST", False), ("TARGET", True)}


def aligned(spark, contigs, reads):
    """The hits of each read as sorted (contig's group, score, read range, contig range)."""
    refs = spark.createDataFrame([(f"target_{i}", "TARGET", i, c) for i, c in enumerate(contigs)], "name string, role string, target_group_ordinal long, sequence string")
    ends = spark.createDataFrame([(i, 1, r) for i, r in enumerate(reads)], "ordinal long, mate int, sequence string")
    got = {i: [] for i in range(len(reads))}
    for r in align.align(ends, refs).collect():
        got[r.ordinal].append((r.target_group_ordinal, r.alignment_score, r.query_start, r.query_end, r.target_start, r.target_end))
    return {i: sorted(hits) for i, hits in got.items()}


def test_every_chain_is_aligned(spark):
    unit, a, b, short = xorshift(17, 100), xorshift(91, 300), xorshift(321, 300), xorshift(5, 10)
    other = "".join("CGTA"["ACGT".index(c)] for c in a[60:90])  # no letter as in a
    got = aligned(spark, [unit * 3, a + unit + b], [unit, a[40:100] + b[200:260], a[:60] + other + a[90:150]])
    assert got[0] == [(0, 200, 0, 100, 0, 100), (0, 200, 0, 100, 100, 200), (0, 200, 0, 100, 200, 300), (1, 200, 0, 100, 300, 400)]  # copies within a contig
    assert got[1] == [(1, 120, 0, 60, 40, 100), (1, 120, 60, 120, 600, 660)]  # two places of one contig
    assert got[2] == [(1, 120, 0, 60, 0, 60), (1, 120, 90, 150, 90, 150)]  # two places on one diagonal
    near = align.banded_local([short * 9] * 4, [short * 12] * 4, np.array([0, 10, 20, 30]), anchors=np.zeros(4))
    assert near.tolist() == [[180, 0, 90, 10 * i, 10 * i + 90] for i in range(4)]  # copies nearer than the band


def test_seeds_beside_an_indel_count_together(spark):
    a = xorshift(91, 300)
    read = a[100:121] + a[124:145]  # one seed to either side of a deletion: neither diagonal has two
    gap = align.GAP_OPEN + 3 * align.GAP_EXTEND
    (hit_,) = aligned(spark, [a], [read, a[100:121]])[0]
    assert hit_ == (0, 84 - gap, 0, 42, 100, 145)
    assert aligned(spark, [a], [a[100:121]])[0] == []


def test_low_complexity_is_aligned(spark):
    short, a, b = xorshift(5, 10), xorshift(7, 50), xorshift(8, 50)
    got = aligned(spark, [a + short * 12 + b, a + "AC" * 40 + b], [short * 9, "AC" * 30])
    assert {(0, 180, 0, 90, 50 + 10 * i, 140 + 10 * i) for i in range(4)} <= set(got[0])
    assert {(1, 120, 0, 60, 50 + 2 * i, 110 + 2 * i) for i in range(11)} <= set(got[1])


def test_ungapped_rows_are_those_of_the_banded_alignment():
    """Wherever an alignment without gaps is settled it is the one that the banded search finds, ties and clipped ends included."""
    rng = np.random.default_rng(12)
    reads, refs, diagonals, anchors = [], [], [], []
    for _ in range(600):
        n, at = int(rng.integers(25, 90)), int(rng.integers(0, 40))
        ref = "".join(rng.choice(list("ACGT" if rng.random() < 0.8 else "AC"), n + 80))
        read = list(ref[at : at + n])
        for _ in range(int(rng.integers(0, 4))):
            i = int(rng.choice([rng.integers(0, n), rng.integers(0, 6), n - 1 - rng.integers(0, 6)]))
            read[i] = rng.choice(list("ACGTN"))
        if rng.random() < 0.2:
            i = int(rng.integers(5, n - 5))
            read[i : i + int(rng.integers(0, 2))] = list(rng.choice(["", "A", "CC"]))
        same = [i for i in range(len(read) - 21) if "".join(read[i : i + 21]) == ref[at + i : at + i + 21]]
        if same:
            reads.append("".join(read)), refs.append(ref), diagonals.append(at), anchors.append(same[0])
    args = reads, refs, np.array(diagonals), np.array(anchors)
    rows, settled = align.ungapped(*args)
    assert settled.mean() > 0.4 and (~settled).any()
    whole = align.banded_local(*args[:3], anchors=args[3])
    assert (rows[settled] == whole[settled]).all()
    lose = align.gaps_lose(*args, rows[:, 0])
    assert lose[~settled].any() and not lose.all()
    assert (rows[lose] == whole[lose]).all()


def test_alignment_begins_after_ambiguous_letters():
    """A seed's first letters may be ambiguous: they match nothing, and the alignment's range leaves them out."""
    text = "NR" + xorshift(11, 60)
    args = [text], [text], np.array([0]), np.array([0])
    row, _ = align.ungapped(*args)
    assert row.tolist() == align.banded_local(*args[:3], anchors=args[3]).tolist() == [[120, 2, 62, 2, 62]]


def test_segments_hold_every_kmer_once_and_meet_as_kmers_do(spark):
    """Segments spelled out are the k-mers of the given strand; joined by word they share just the k-mers that are equal, for several k, with ambiguous letters and repeats."""
    rng = np.random.default_rng(5)
    core = xorshift(9, 120)
    texts = [core, core[30:] + "N" + core[:40], core[:50] + "R" + core[51:], "A" * 60, "CACA" * 20 + core[:25], "acgu-" * 9, "", None, "ACG"]
    texts += ["".join(rng.choice(list("ACGTN"), 70, p=[0.3, 0.3, 0.2, 0.19, 0.01])) for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    for k in (2, 7, 21):
        kmers = seq.with_kmers(df, ["id"], "t", k, canonical=False)
        segments = seq.with_segments(df, ["id"], "t", k).cache()
        plain = sorted(map(tuple, kmers.select("id", "pos", "kmer").collect()))
        assert plain and sorted(map(tuple, seq.segment_kmers(segments, ["id"], k).collect())) == plain
        before, shared = seq.shared_kmers("beside", "b2", k)
        other = segments.select("word", segments.id.alias("id2"), segments.pos.alias("pos2"), segments.beside.alias("b2"))
        met = segments.join(other, "word").select("id", "id2", (F.col("pos") - before).alias("a"), (F.col("pos2") - before).alias("b"), shared.alias("n")).filter("n > 0").collect()
        got = sorted((r.id, r.id2, r.a + i, r.b + i) for r in met for i in range(r.n))
        two = kmers.select("kmer", kmers.id.alias("id2"), kmers.pos.alias("pos2"))
        assert got == sorted(map(tuple, kmers.join(two, "kmer").select("id", "id2", "pos", "pos2").collect()))
    with pytest.raises(ValueError):
        seq.with_segments(df, ["id"], "t", 22)


def test_filter_comes_in_blocks_of_each_task_once(spark):
    """The driver is sent compressed blocks, never a row a word; they hold the bits of bloom_words, of stored words too."""
    rng = random.Random(5)
    panel = spark.createDataFrame([("".join(rng.choice("0123") for _ in range(21)),) for _ in range(3000)], "kmer string").repartition(3)
    for bits in (1 << 16, 1 << 24):
        words = gate.bloom_words(panel, bits)
        want = {r.word: r.value for r in words.collect()}
        for blocks in (gate.filter_blocks(panel.union(panel), bits), gate.stored_blocks(words)):
            rows = blocks.collect()
            got = {r.block * gate.BLOCK + i: v for r in rows for i, v in enumerate(np.frombuffer(zlib.decompress(r.data), dtype=np.int64).tolist()) if v}
            assert got == want and len({r.block for r in rows}) == len(rows) <= -(-bits // 64 // gate.BLOCK)
    assert gate.bloom_test(panel, words=gate.bloom_words(panel, gate.bloom_bits(3000)))(np.array([r.kmer for r in panel.collect()], dtype="S21")).all()


def test_panel_segments_gate_as_kmers_do(spark):
    """Both strands, repeats, letters beside A, C, G and T in and beside the words, ends of reads: the same places and states as by k-mers."""
    rng = random.Random(11)
    genome = ["".join(rng.choice("ACGT" if i % 3 else "ACGTNRYSWKM") for _ in range(300)) for i in range(6)] + ["A" * 60, "ACAC" * 20, "N" * 50, "AAAAAAAAAACTGCATGC" * 5]
    # a record with a repeat, and with a rare letter beside words that another has without it
    genome.append(genome[1][:150] + "N" + genome[1][100:150])
    records = spark.createDataFrame([(i, t, i == 5) for i, t in enumerate(genome)], "rec_ordinal long, sequence string, is_host boolean")
    flip = str.maketrans("ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN")
    texts = []
    for _ in range(300):
        t = rng.choice(genome)
        at = rng.randrange(max(1, len(t) - 40))
        t = list(t[at : at + rng.randrange(15, 90)])
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice("ACGTNRXx-")
        t = "".join(t)
        texts.append(t.lower() if rng.random() < 0.2 else t[::-1].translate(flip) if rng.random() < 0.5 else t)
    ends = spark.createDataFrame([(i // 2, i % 2 + 1, t) for i, t in enumerate(texts)], "ordinal long, mate int, sequence string")
    kmers = gate.target_kmers(records)
    want = sorted(map(tuple, gate.kmer_hits(ends, kmers).collect()))
    assert len(want) > 2000 and sorted(map(tuple, gate.kmer_hits(ends, records).collect())) == want
    assert gate.kmer_hits(ends, records.filter("false")).count() == 0
    for masked in (False, True):
        a, b = (sorted(map(tuple, gate.gate_states(ends, h, masked).collect())) for h in (gate.kmer_hits(ends, kmers), gate.hit_runs(ends, records)))
        assert len(a) == 300 and a == b


def test_word_filter_is_made_by_one_worker_a_task(spark):
    """The panel's words go into the filter where they are made: the bits of filter_blocks of with_segments, and one Python step before the blocks are merged."""
    texts = [(xorshift(i, 90 + 40 * i),) for i in range(1, 9)] + [("ACGN" * 20,), ("",), (None,)]
    records = spark.createDataFrame(texts, "sequence string").repartition(3)
    blocks, words = gate.word_blocks(records, 1 << 16, 2), seq.with_segments(records, [], "sequence").select(F.col("word").alias("kmer"))
    spelled = lambda df: {r.block: zlib.decompress(r.data) for r in df.collect()}
    assert spelled(blocks) == spelled(gate.filter_blocks(words, 1 << 16, 2)) != {}
    assert blocks._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2  # build and merge
    held = np.array([r.kmer for r in words.collect()], dtype=np.uint64)
    assert gate.word_test(records, 400)(held).all() and not gate.word_test(records.filter("false"), 0)(held).any()


def test_memory_of_encoding_does_not_grow_with_the_text():
    """A worker's arrays are of some 65 thousand windows: a text of a million letters takes no more than 40 MB."""
    import tracemalloc

    texts = pa.array([xorshift(3, 1 << 10) * (1 << 10)])
    for make in (lambda: seq._segments(texts, 21, None), lambda: seq._encoded(texts, 21, True)):
        tracemalloc.start()
        assert sum(len(x[0]) for x in make()) > 100_000
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 40 << 20


def test_shared_kmers_of_packed_pieces(spark, monkeypatch):
    """panel_hit_rank's counts by brute force: both strands, repeats within records and reads, rare letters, palindromes, one record in several rows; no k-mer becomes a row."""
    monkeypatch.setattr(rank, "_PACK", 200)
    rng = random.Random(23)
    flip = lambda t: t[::-1].translate(str.maketrans("ACGTMRWSYKVHDBN", "TGCAKYWSRMBDHVN"))
    core = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(3)]
    texts = [core[0], core[0][:90] + "R" + core[0][91:], core[1] + flip(core[1][40:100]) + core[1][:60], core[2], "A" * 90, "ACG" * 40, "N" * 60, core[2][:80] + "NNWSN" + core[2][80:], "ACGTACG", core[0][50:150]]
    numbers = [0, 1, 2, 3, 4, 5, 6, 7, 8, 3]  # the last row is of record 3, too
    records = spark.createDataFrame(list(zip(numbers, texts, strict=True)), "number long, sequence string").repartition(3)
    reads = []
    for i in range(150):
        t = rng.choice(texts)
        at = rng.randrange(max(1, len(t) - 60))
        r1 = t[at : at + rng.randrange(18, 90)]
        if rng.random() < 0.3:
            r1 = r1[:30] + rng.choice("XN-T") + r1[31:]
        r2 = rng.choice([None, "", flip(r1), r1[5:] + r1, flip(rng.choice(core)[20:70])])
        reads.append((i - 75, rng.choice([r1, r1.lower(), None]) if i % 5 == 0 else r1, r2))
    fragments = spark.createDataFrame(reads, "ordinal long, r1 string, r2 string").repartition(2)

    def kmers(t):
        windows = [t.upper()[i : i + 21] for i in range(len(t or "") - 20)] if t else []
        return {min(w, flip(w)) for w in windows if set(w) <= set(seq.ALPHABET)}

    panel, found = {}, {}
    for n, t in zip(numbers, texts, strict=True):
        panel.setdefault(n, set()).update(kmers(t))
    for _, r1, r2 in reads:
        own = kmers(r1) | kmers(r2)
        for n, held in panel.items():
            if own & held:
                f, h = found.get(n, (0, 0))
                found[n] = (f + 1, h + len(own & held))
    assert len(found) == 8
    assert {r.number: (r.fragments, r.kmer_hits) for r in rank.shared(records, fragments).collect()} == found
    assert rank.shared(records.filter("false"), fragments).count() == rank.shared(records, fragments.filter("false")).count() == 0
    monkeypatch.undo()
    long = spark.createDataFrame([(i, xorshift(i + 1, 3000)) for i in range(10)], "number long, sequence string").coalesce(1)
    rows = rank.packed(long, "number", "sequence", 0, 8).collect()
    assert len(rows) == 8 and sum(len(r.data) for r in rows) < 3 * seq.with_kmers(long, [], "sequence").count()


def test_hit_rank_of_records_with_one_ordinal(spark, tmp_path):
    """Records that share their ordinal, or have none, are told apart by their ids."""
    a, b = xorshift(4, 100), xorshift(5, 100)
    rows = [(5, "p.fa", "x", "", a), (5, "p.fa", "y", "", a), (7, "p.fa", "z", "", b), (7, "p.fa", "w", "", b), (None, "p.fa", "v", "", b[:60]), (7, "p.fa", "z", "", a[:40]), (8, "host.fa", "h", "", a)]
    spark.createDataFrame(rows, "rec_ordinal long, source string, id string, description string, sequence string").write.parquet(str(tmp_path / "fasta.parquet"))
    reads = [(1, "r", a[:50], a[20:60]), (1, "r", a[:50], None), (2, "r", b[30:90], None), (None, "r", a, b)]
    spark.createDataFrame(reads, "ordinal long, run_id string, r1 string, r2 string").write.parquet(str(tmp_path / "fragments.parquet"))
    got = [tuple(r) for r in queries.panel_hit_rank(spark, str(tmp_path)).orderBy("place").collect()]
    assert got == [(7, "z", 2, 60, 1), (7, "w", 1, 40, 2), (5, "x", 1, 40, 3), (5, "y", 1, 40, 4), (None, "v", 1, 10, 5)]
