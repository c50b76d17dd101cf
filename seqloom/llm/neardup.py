"""Problem 1: records that differ by a limited amount of editing.

Method: a binary trie self-join. 128 min-hashes of a text's set of substrings give it a sketch, one bit of each, of
which two texts of similarity J agree in (1 + J) / 2 on average, and 32 tries: a leaf's path in a trie is the bits of
two of the min-hashes, in which no error is allowed, and then the sketch. Spark splits every trie at the end of the two
min-hashes; within such a subtrie pairs of nodes are traversed together from the top, differing bits add up, and a pair
of nodes is pruned once the Hamming error budget is exceeded. A subtrie of too many leaves for one task is split
further by its next bits, and each pair of its nodes within the budget is traversed on its own. Two texts of the least
similarity 0.6 miss all 32 tries with a chance of 0.64**32 = 6e-7, of 0.7 with one of 4e-10. Exact sets decide at last.
One setting serves all sizes.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.common import checkpointed, letters, materialized

SUBSTRING, SIMILARITY = 11, 0.6
SKETCH_BITS, TRIES = 128, 32
#: Leaves of a subtrie handled in one task; a larger one is split by its next bits.
TILE = 4096
#: Leaves whose subtries are traversed together.
FRAME = 1 << 16
#: Pairs of nodes of a traversal held at once.
FRONTIER = 1 << 20
#: Letters signed at once: arrays of this size stay in a core's cache.
PORTION = 1 << 15


def _codes(b: np.ndarray, k: int) -> np.ndarray:
    """Codes of the substrings of k letters, five bits a letter (k up to 12), of a text as bytes A to Z."""
    b = (b & np.uint8(31)).astype(np.uint64)
    n = len(b) - k + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k if n > 0 else 0):
        code = (code << np.uint64(5)) | b[i : i + n]
    return code


def substrings(text: str, k: int) -> np.ndarray:
    """Sorted codes of the distinct substrings of k letters A to Z."""
    return np.unique(_codes(np.frombuffer(text.encode("ascii"), dtype=np.uint8), k))


_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, SKETCH_BITS + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def signatures(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts with k letters or more: the subtrie of each in each trie, and the sketches as bytes; a row a text."""
    lengths = np.array([len(t) for t in texts])
    raw = np.frombuffer("".join(texts).encode("ascii"), dtype=np.uint8)
    first = np.cumsum(lengths) - lengths
    last = np.zeros(len(raw), dtype=bool)  # places at which a substring would run over the text's end
    for i in range(1, k):
        last[first + lengths - i] = True
    mixed = _mixed(_codes(np.append(raw, np.zeros(k - 1, dtype=np.uint8)), k)[~last])
    windows = lengths - k + 1
    starts = np.cumsum(windows) - windows
    low = np.empty((len(texts), SKETCH_BITS), dtype=np.uint64)
    hashed = np.empty_like(mixed)
    for i in range(SKETCH_BITS):
        np.multiply(mixed, _MULTIPLIERS[i], out=hashed)
        low[:, i] = np.minimum.reduceat(hashed, starts)
    low = _mixed(low)
    trees = _mixed(low[:, : 2 * TRIES : 2] * _MULTIPLIERS[-1] + low[:, 1 : 2 * TRIES : 2] * _MULTIPLIERS[-2] + np.arange(TRIES, dtype=np.uint64))
    return trees, np.packbits((low >> np.uint64(40)).astype(np.uint8) & np.uint8(1), axis=1)


def error_budget(similarity: float, bits: int = SKETCH_BITS) -> int:
    """Differing bits allowed: five standard deviations above the mean of two texts of the least similarity."""
    p = (1 - similarity) / 2
    return int(bits * p + 5 * (bits * p * (1 - p)) ** 0.5)


def trie_pairs(sketch: np.ndarray, tree: np.ndarray, side: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one tree whose sketches differ in at most `budget` bits.

    sketch: bytes, a row a leaf; tree: the number of each leaf's tree. side: 0 and 1 for the halves of a tree of two
    tiles, of which only pairs across are wanted; -1 in a tree that is joined with itself.
    """
    n_bits = sketch.shape[1] * 8
    order = np.lexsort([*sketch.T[::-1], side, tree])
    sketch, tree, side = sketch[order], tree[order], side[order]
    bits = np.unpackbits(sketch, axis=1)
    zeros = np.vstack([np.zeros((1, n_bits), dtype=np.int32), np.cumsum(bits == 0, axis=0, dtype=np.int32)])
    group = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (side[1:] != side[:-1]), True])
    lo, hi, of, at = group[:-1], group[1:], tree[group[:-1]], side[group[:-1]]
    alone = at < 0
    left, right = np.flatnonzero(at == 0), np.flatnonzero(at == 1)
    meet = np.isin(of[left], of[right])
    left = left[meet]
    right = right[np.searchsorted(of[right], of[left])] if len(left) else right[:0]
    # A node is a range of the sorted leaves: a0, a1 and b0, b1 are the two nodes of a pair, d the bits that differ.
    roots = [np.r_[lo[alone], lo[left]], np.r_[hi[alone], hi[left]], np.r_[lo[alone], lo[right]], np.r_[hi[alone], hi[right]]]
    stack = [(0, [*roots, np.zeros(len(roots[0]), dtype=np.int32)])]
    out_a, out_b = [], []

    def leaves(p: list[np.ndarray]) -> None:
        a0, a1, b0, b1, _ = p
        w = b1 - b0
        n = (a1 - a0) * w
        rep = np.repeat(np.arange(len(n)), n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = a0[rep] + k // w[rep], b0[rep] + k % w[rep]
        keep = (a0[rep] != b0[rep]) | (i < j)
        out_a.append(i[keep])
        out_b.append(j[keep])

    while stack:
        depth, p = stack.pop()
        if len(p[0]) > FRONTIER:  # depth first beyond this, so that memory stays bounded
            half = len(p[0]) // 2
            stack += [(depth, [x[:half] for x in p]), (depth, [x[half:] for x in p])]
            continue
        same = p[0] == p[2]
        live = ~(same & (p[1] - p[0] == 1))  # a leaf with itself
        p = [x[live] for x in p]
        if depth == n_bits:
            leaves(p)
            continue
        single = (p[1] - p[0] == 1) & (p[3] - p[2] == 1)
        if single.any():  # two leaves: the rest of their bits at once
            q = [x[single] for x in p]
            rest = slice(depth // 8, None)
            d = np.bitwise_count(sketch[q[0], rest] ^ sketch[q[2], rest]).sum(axis=1, dtype=np.int32)
            if depth % 8:
                first = sketch[q[0], depth // 8] ^ sketch[q[2], depth // 8]
                d -= np.bitwise_count(first >> np.uint8(8 - depth % 8)).astype(np.int32)
            good = q[4] + d <= budget
            out_a.append(q[0][good])
            out_b.append(q[2][good])
            p = [x[~single] for x in p]
        if not len(p[0]):
            continue
        a0, a1, b0, b1, d = p
        z = zeros[:, depth]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        same = a0 == b0
        kids = [
            (np.ones_like(same), [a0, am, b0, bm, d]),
            (np.ones_like(same), [am, a1, bm, b1, d]),
            (d < budget, [a0, am, bm, b1, d + 1]),
            ((d < budget) & ~same, [am, a1, b0, bm, d + 1]),
        ]
        parts = []
        for ok, c in kids:
            ok = ok & (c[1] > c[0]) & (c[3] > c[2])
            parts.append([x[ok] for x in c])
        stack.append((depth + 1, [np.concatenate(x) for x in zip(*parts, strict=True)]))
    a = np.concatenate(out_a) if out_a else np.empty(0, dtype=np.int64)
    b = np.concatenate(out_b) if out_b else np.empty(0, dtype=np.int64)
    return order[a], order[b]


def classes(records: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(cls, letters): each distinct text with the smallest key that has it; and (key, cls): the class of each record.

    Records with a null key or without any letter are left out.
    """
    rows = records.select(F.col(key).alias("key"), letters(text).alias("letters")).filter((F.length("letters") > 0) & F.col("key").isNotNull())
    rows = rows.withColumns({"h1": F.xxhash64("letters"), "h2": F.xxhash64(F.lit(1), F.reverse("letters"))})
    firsts = rows.groupBy("letters").agg(F.min("key").alias("cls"))
    firsts = checkpointed(firsts)
    ids = firsts.select("cls", F.xxhash64("letters").alias("h1"), F.xxhash64(F.lit(1), F.reverse("letters")).alias("h2"))
    return firsts.select("cls", "letters"), rows.select("key", "h1", "h2").join(ids, ["h1", "h2"]).select("key", "cls")


def _portions(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` letters together."""
    ends, i = np.cumsum(lengths), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def trie_leaves(texts: DataFrame, k: int = SUBSTRING) -> DataFrame:
    """(tree, cls, s0, s1): of each text (cls, letters) its leaf in each trie; tree is the subtrie, s0 and s1 the sketch."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, cls = b.column("letters").to_pylist(), b.column("cls").to_numpy()
            for i, j in _portions(np.array([len(t) for t in own]), PORTION):
                trees, sketch = signatures(own[i:j], k)
                half = sketch.view(">u8").astype(np.uint64).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * TRIES + 1, TRIES, dtype=np.int32)), pa.array(trees.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(cls[i:j]), lists, pa.array(half[:, 0]), pa.array(half[:, 1])], ["cls", "trees", "s0", "s1"])

    spread = texts.filter(F.length("letters") >= k).repartition(F.col("cls"))
    signed = materialized(spread.mapInArrow(sign, "cls long, trees array<long>, s0 long, s1 long"))
    return signed.select(F.explode("trees").alias("tree"), "cls", "s0", "s1")


def split_hot(leaves: DataFrame, budget: int, tile: int) -> DataFrame:
    """leaves (tree, cls, s0, s1) with a side: subtries of more than `tile` leaves split by their next bits.

    A subtrie of n leaves is split by log2(n / tile) bits of the sketch. Each leaf goes to every pair of nodes that its
    own node forms within the budget; the pair's differing bits count again when it is traversed. side is -1 within a
    node, 0 and 1 for the two nodes of a pair.
    """
    hot = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    hot = materialized(hot.select(F.col("tree").alias("hot"), F.least(F.ceil(F.log2(F.col("n") / tile)), F.lit(30)).cast("int").alias("bits")))
    if hot.isEmpty():
        return leaves.withColumn("side", F.lit(-1))
    rows = leaves.join(hot, leaves.tree == hot.hot, "left")
    cold = rows.filter("hot is null").select("tree", "cls", "s0", "s1", F.lit(-1).alias("side"))
    rows = rows.filter("hot is not null").withColumn("node", F.expr("shiftrightunsigned(s0, 64 - bits)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0L, shiftleft(1L, bits) - 1)"))).filter(F.bit_count(F.col("node").bitwiseXOR(F.col("other"))) <= budget)
    pair = F.xxhash64("tree", F.least("node", "other"), F.greatest("node", "other"))
    side = F.when(F.col("node") == F.col("other"), -1).otherwise((F.col("node") > F.col("other")).cast("int"))
    return cold.unionByName(rows.select(pair.alias("tree"), "cls", "s0", "s1", side.alias("side")))


def similar_classes(texts: DataFrame, k: int = SUBSTRING, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(cls_a, cls_b, similarity), cls_a < cls_b: pairs of texts (cls, letters) whose sets of distinct substrings of k letters have a Jaccard similarity of at least `similarity`.

    cls must be unique. Texts with fewer than k letters have no partner.
    """
    budget = error_budget(similarity)
    leaves = split_hot(trie_leaves(texts, k), budget, tile)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by tree; whole trees are traversed together, up to a bounded number of leaves.
        for t in _by_tree(batches):
            tree = t.column("tree").to_numpy()
            fresh = np.r_[True, tree[1:] != tree[:-1]]
            together = ~(fresh & np.r_[fresh[1:], True])  # a lone leaf has no partner
            if not together.any():
                continue
            halves = np.stack([t.column(c).to_numpy()[together] for c in ("s0", "s1")], axis=1)
            sketch = halves.view(np.uint64).astype(">u8").view(np.uint8).reshape(len(halves), -1)
            i, j = trie_pairs(sketch, np.cumsum(fresh[together]), t.column("side").to_numpy()[together], budget)
            cls = t.column("cls").to_numpy()[together]
            a, b = np.minimum(cls[i], cls[j]), np.maximum(cls[i], cls[j])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["cls_a", "cls_b"])

    near = leaves.repartition(F.col("tree")).sortWithinPartitions("tree").mapInArrow(join, "cls_a long, cls_b long")
    near = near.filter("cls_a <> cls_b").distinct()  # most pairs meet in several tries
    a = texts.select(F.col("cls").alias("cls_a"), F.col("letters").alias("text_a"))
    b = texts.select(F.col("cls").alias("cls_b"), F.col("letters").alias("text_b"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = functools.lru_cache(maxsize=8192)(lambda text: substrings(text, k))  # a text comes with each of its partners
        for batch in batches:
            both = np.empty(batch.num_rows)
            for row, (x, y) in enumerate(zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True)):
                s, t = sets(x), sets(y)
                common = np.count_nonzero(s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t)
                both[row] = common / (len(s) + len(t) - common)
            out = pa.RecordBatch.from_arrays([batch.column("cls_a"), batch.column("cls_b"), pa.array(both, pa.float64())], ["cls_a", "cls_b", "similarity"])
            yield out.filter(pa.array(both >= similarity, pa.bool_()))

    return near.join(a, "cls_a").join(b, "cls_b").mapInArrow(verify, "cls_a long, cls_b long, similarity double")


def _by_tree(batches: Iterator[pa.RecordBatch], most: int = FRAME) -> Iterator[pa.Table]:
    """The rows again, in tables of whole trees."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n >= most:
            t = pa.Table.from_batches(held)
            tree = t.column("tree").to_numpy()
            cut = int(np.searchsorted(tree, tree[-1]))
            if cut:
                yield t.slice(0, cut)
            held, n = t.slice(cut).to_batches(), t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def near_pairs(records: DataFrame, key: str = "rec_ordinal", text: str = "sequence", k: int = SUBSTRING, similarity: float = SIMILARITY) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs of records with different letters and similar sets of substrings."""
    texts, members = classes(records, key, text)
    pairs = similar_classes(texts, k, similarity)
    a = members.select(F.col("key").alias("key_a"), F.col("cls").alias("cls_a"))
    b = members.select(F.col("key").alias("key_b"), F.col("cls").alias("cls_b"))
    rows = pairs.join(a, "cls_a").join(b, "cls_b")
    return rows.select(F.least("key_a", "key_b").alias("rec_a"), F.greatest("key_a", "key_b").alias("rec_b"))


def near_groups(records: DataFrame, key: str = "rec_ordinal", text: str = "sequence", k: int = SUBSTRING, similarity: float = SIMILARITY) -> DataFrame:
    """(key, group, links): each record that has letters, the smallest key of its group, and its class's links to other texts.

    Records are of one group if they are linked by any chain of equal or similar texts; a record without partners is
    a group of its own with no links.
    """
    from seqloom.llm.graph import components

    texts, members = classes(records, key, text)
    pairs = checkpointed(similar_classes(texts, k, similarity).select("cls_a", "cls_b"))
    group = components(pairs, "cls_a", "cls_b").withColumnRenamed("node", "cls")
    ends = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    rows = members.join(group, "cls", "left").join(ends, "cls", "left")
    return rows.select("key", F.coalesce("component", "cls").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))
