"""Problem 2: adjacent runs of sorted records against a plain dictionary."""

import random
import re

from seqloom.llm import collapse


def canon(t, m):
    clean = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    return clean(t), frozenset(c for x in m if x is not None for p in re.split("[;,]", x) if (c := clean(p)))


def test_groups_in_any_spelling(spark):
    rows = [(0, "sha256:AB", ["a.1", "b"]), (1, "SHA256-ab", ["B;A.1"]), (2, "sha256:ab", ["b", "a1", "a1"]), (3, "sha256:ab", ["a1"]), (4, None, ["a1"]), (5, "sha256:ab", None), (6, "sha256:ab", []), (7, "sha256 ab", [None, ""]), (8, "x", ["a,b"]), (9, "x", ["ab"]), (10, "x", ["b ", "A"]), (None, "x", ["a,b"])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "group_ordinal int, target_group_id string, member_ids array<string>, tbl string")
    got = {(r.key_a, r.key_b) for r in collapse.redundant(collapse.canonical_groups(df)).collect()}
    first, want = {}, set()
    for g, t, m in rows:
        if g is not None and t is not None and m is not None:
            a = first.setdefault(canon(t, m), g)
            want |= {(a, g)} if a != g else set()
    assert got == want == {(0, 1), (0, 2), (6, 7), (8, 10)}


def test_hot_key_over_many_partitions(spark):
    rng = random.Random(1)
    spell = lambda s: "".join(rng.choice([c, c.lower(), c + "-", c + "\n"]) for c in s)
    texts = ["ACGT" if rng.random() < 0.4 else "".join(rng.choice("ACGT") for _ in range(rng.choice([2, 3]))) for _ in range(1500)]
    rows = [(i, spell(t)) for i, t in enumerate(texts)] + [(None, "acgt"), (5000, None), (5001, ""), (5002, "-- 12"), (3, "acgt"), (3, "acgt")]
    want, first = {}, {}
    for i, s in sorted(rows[:1500] + rows[1501:], key=lambda r: r[0]):
        t = re.sub("[^A-Z]", "", (s or "").upper())
        if t:
            a = first.setdefault(t, i)
            want[a] = want.get(a, 0) + 1
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # keeps all partitions, so that runs cross many edges
    try:
        for parts in (1, 9, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            df = spark.createDataFrame(rows, "rec_ordinal long, sequence string")
            got = {r.representative: r.copies for r in collapse.collapsed(collapse.canonical_fasta(df)).collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_empty(spark):
    df = spark.createDataFrame([], "rec_ordinal long, sequence string")
    assert collapse.redundant(collapse.canonical_fasta(df)).count() == 0


def test_result_composes(spark):
    """Unions, coalesced partitions and a run over all partitions give what the parts give alone."""
    rows = [(i, "ACGT" if i % 3 else "ACG" + "ACGT"[i % 4] * (i % 7)) for i in range(3000)]
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    try:
        mixed = collapse.canonical_fasta(spark.createDataFrame(rows, "rec_ordinal long, sequence string"))
        equal = collapse.canonical_fasta(spark.createDataFrame([(i, "acgt") for i in range(4000)], "rec_ordinal long, sequence string"))
        first = {}
        for i, t in sorted(rows):
            first.setdefault(t, i)
        want = sorted((first[t], i) for i, t in rows if first[t] != i)
        pairs = lambda df: sorted((r.key_a, r.key_b) for r in df.collect())
        a, b = collapse.redundant(mixed), collapse.redundant(equal)
        assert pairs(a) == want and pairs(b) == [(0, i) for i in range(1, 4000)]
        assert pairs(a.unionByName(b)) == sorted(want + [(0, i) for i in range(1, 4000)])
        assert pairs(b.unionByName(b)) == sorted([(0, i) for i in range(1, 4000)] * 2)
        assert pairs(a.coalesce(2)) == want and pairs(b.coalesce(1)) == [(0, i) for i in range(1, 4000)]
        assert {r.representative: r.copies for r in collapse.collapsed(equal).coalesce(1).collect()} == {0: 4000}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
