"""Problem 1: trie self-join against brute force."""

import random
import re

import numpy as np

from seqloom.llm import neardup
from seqloom.llm.graph import components


def letters(s):
    return re.sub("[^A-Z]", "", s.upper()) if s is not None else ""


def mutated(rng, s, edits):
    s = list(s)
    for _ in range(edits):
        i = rng.randrange(len(s))
        s[i : i + rng.choice([0, 1])] = rng.choice(["", "A", "C", "GT"])
    return "".join(s)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    out, fresh = [], lambda k: "".join(rng.choice("ACGT") for _ in range(k))
    while len(out) < n:
        base = fresh(rng.choice([60, 150, 400]))
        out.append(base)
        for _ in range(rng.choice([0, 1, 4])):
            out.append(mutated(rng, base, rng.choice([0, 1, 2, 4, 8])))
    return [(i, s if i % 5 else s.lower()[:20] + " \n-" + s[20:]) for i, s in enumerate(out)]


def brute(rows, k=11, j=0.6):
    sets = {i: ({letters(s)[x : x + k] for x in range(len(letters(s)) - k + 1)}, letters(s)) for i, s in rows}
    out = set()
    for a in sets:
        for b in sets:
            (x, s), (y, t) = sets[a], sets[b]
            if a < b and s != t and x and y and len(x & y) / len(x | y) >= j:
                out.add((a, b))
    return out


SCHEMA = "rec_ordinal long, sequence string, cls string, letters string"


def frame(spark, rows):  # with columns that clash with inner names
    return spark.createDataFrame([(i, s, "x", "y") for i, s in rows], SCHEMA)


def test_pairs_equal_brute_force(spark):
    rows = [*corpus(), (1000, None), (1001, ""), (1002, "--"), (1003, "ACGT"), (1004, "ACGTACGTACGT"), (1005, "acgtacgtacgt "), (1006, "A" * 50), (1007, "A" * 20), (1008, "A" * 11 + "C")]
    want = brute(rows)
    assert len(want) > 60
    for parts in (1, 7):
        got = [(r.rec_a, r.rec_b) for r in neardup.near_pairs(frame(spark, rows).repartition(parts)).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_hot_subtries_are_split(spark):
    rows = corpus(2)
    want = brute(rows)
    texts, _ = neardup.classes(frame(spark, rows), "rec_ordinal", "sequence")
    cls = {r.cls for r in texts.collect()}
    got = [(r.cls_a, r.cls_b) for r in neardup.similar_classes(texts, tile=2).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a, b in want if {a, b} <= cls}
    sides = {r.side for r in neardup.split_hot(neardup.trie_leaves(texts), 48, 2).select("side").distinct().collect()}
    assert sides == {-1, 0, 1}


def test_signatures_are_of_each_text_alone():
    texts = [t for _, s in corpus(5) if len(t := letters(s)) >= 11] + ["ACGTACGTACG"]
    trees, sketch = neardup.signatures(texts, 11)
    for i in (0, 7, len(texts) - 1):
        one, own = neardup.signatures([texts[i]], 11)
        assert (one[0] == trees[i]).all() and (own[0] == sketch[i]).all()


def test_trie_traversal_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (30, 16), dtype=np.uint8)
    sketch = base[rng.integers(0, 30, 300)] ^ (np.uint8(1) << rng.integers(0, 8, (300, 16), dtype=np.uint8)) * (rng.random((300, 16)) < 0.4)
    tree, side = rng.integers(0, 4, 300), np.full(300, -1)
    side[tree == 3] = rng.integers(0, 2, (tree == 3).sum())
    for budget in (0, 6, 30):
        i, j = neardup.trie_pairs(sketch, tree, side, budget)
        got = [tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)]
        d = np.bitwise_count(sketch[:, None, :] ^ sketch[None, :, :]).sum(axis=2)
        ok = lambda a, b: tree[a] == tree[b] and (side[a] < 0 or side[a] != side[b]) and d[a, b] <= budget
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a in range(300) for b in range(a + 1, 300) if ok(a, b)}


def test_groups_and_empty(spark):
    rows = corpus(4)
    link = {i: {i} for i, _ in rows}
    for a, b in brute(rows) | {(a, b) for a, s in rows for b, t in rows if a < b and letters(s) == letters(t)}:
        union = link[a] | link[b]
        for x in union:
            link[x] = union
    got = {r.key: r.group for r in neardup.near_groups(frame(spark, rows)).collect()}
    assert got == {i: min(link[i]) for i, _ in rows}
    none = frame(spark, rows).filter("false")
    assert neardup.near_pairs(none).count() == 0 and neardup.near_groups(none).count() == 0


def test_components_of_a_chain(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
