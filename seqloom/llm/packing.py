"""Problem 6: texts assigned to containers of a fixed number of tokens.

Method: a grouping genetic algorithm on islands. Items are dealt at random to neighbourhoods of bounded size, each
with several islands; an island evolves a population of packings. Crossover injects whole well-filled containers of
one parent into the other, drops the containers that hold an item twice and best-fits the displaced items: first each
takes the place of the smaller item of a kept container that leaves the least room there, then what is still loose goes
where it fits most tightly. Mutation empties the worst containers. Between rounds each island's elite migrates to the next island of its neighbourhood.
The best packing of any island is kept; items of containers that still have much room are dealt to new neighbourhoods
and evolved once more. Neighbourhoods are rows, so nothing but one of them is ever in one task's hands.
"""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.common import checkpointed, materialized
from seqloom.llm.tokens import clean, encoder, shipped

NEIGHBOURHOOD, ISLANDS, ROUNDS, POPULATION, GENERATIONS = 1500, 2, 2, 6, 20
#: Containers filled less than this are opened again at the end, and their items dealt anew.
OPEN = 0.97


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens): the size of each text; null and empty texts have none."""
    path = shipped(documents.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path())
        for b in batches:
            sizes = [len(enc.encode_ordinary(clean(t.as_py()))) if t.is_valid else 0 for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return documents.select("doc_id", "text").mapInArrow(count, "doc_id long, n_tokens long")


class _Bins:
    """Open containers by room left; best_fit finds the tightest one that has room for an item."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0  # bit r: some container has room r

    def add_bin(self, items: list[int], fill: int) -> None:
        self._put(len(self.bins), self.capacity - fill)
        self.bins.append(items)

    def _put(self, i: int, room: int) -> None:
        self.by_room[room].append(i)
        self.mask |= 1 << room

    def best_fit(self, items: list[int]) -> None:
        sizes, by_room = self.sizes, self.by_room
        for item in items:
            size = sizes[item]
            m = self.mask >> size
            if m:
                room = size + (m & -m).bit_length() - 1
                own = by_room[room]
                i = own.pop()
                if not own:
                    self.mask &= ~(1 << room)
                self.bins[i].append(item)
                self._put(i, room - size)
            else:
                self.add_bin([item], size)


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> float:
    """Fewest containers first; of equal numbers the one with fuller full ones."""
    return -len(bins) + sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def _born(order: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    b = _Bins(sizes, capacity)
    b.best_fit(order)
    return b.bins


def _exchanged(own: list[int], room: int, loose: list[int], keys: list[int], sizes: list[int]) -> int:
    """Swap items of a container for larger loose ones (ascending, keys are their sizes) while that fills it better; the room left."""
    while room and keys:
        gain, place, taken = 0, 0, 0
        for k, i in enumerate(own):
            j = bisect_right(keys, sizes[i] + room) - 1
            if j >= 0 and keys[j] - sizes[i] > gain:
                gain, place, taken = keys[j] - sizes[i], k, j
        if not gain:
            break
        keys.pop(taken)
        own[place], back = loose.pop(taken), own[place]
        at = bisect_left(keys, sizes[back])
        keys.insert(at, sizes[back])
        loose.insert(at, back)
        room -= gain
    return room


def _repaired(kept: list[list[int]], displaced: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    b = _Bins(sizes, capacity)
    loose = sorted(displaced, key=lambda i: sizes[i])
    keys = [sizes[i] for i in loose]
    for own in map(list, kept):
        room = _exchanged(own, capacity - sum(sizes[i] for i in own), loose, keys, sizes)
        b.add_bin(own, capacity - room)
    b.best_fit(loose[::-1])
    return b.bins


def crossover(giver: list[list[int]], taker: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """taker with some of the best-filled containers of giver injected whole."""
    full = sorted(giver, key=lambda b: -sum(sizes[i] for i in b))
    full = full[: max(1, len(full) // 2)]
    gift = rng.sample(full, max(1, len(full) // 2))
    given = {i for b in gift for i in b}
    kept, displaced = [], []
    for b in taker:
        if given.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in given]
    return _repaired([*gift, *kept], displaced, sizes, capacity)


def mutation(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """The worst-filled containers and a few others emptied; their items find new places."""
    order = sorted(bins, key=lambda b: sum(sizes[i] for i in b))
    worst = order[: max(2, len(order) // 20)]
    rest = order[len(worst) :]
    rng.shuffle(rest)
    out = [*worst, *rest[: len(worst)]]
    return _repaired(rest[len(worst) :], [i for b in out for i in b], sizes, capacity)


def evolve(sizes: list[int], capacity: int, population: list[list[list[int]]], generations: int, seed: int, most: int = POPULATION) -> list[list[list[int]]]:
    """A population of packings (lists of containers of item numbers) after some generations, the best first."""
    rng = random.Random(seed)
    population = list(population)
    n = len(sizes)
    descending = sorted(range(n), key=lambda i: -sizes[i])
    while len(population) < most:
        spread = 0.1 * len(population)  # the first is best fit decreasing itself
        order = sorted(range(n), key=lambda i: -sizes[i] * (1 + spread * rng.random())) if spread else descending
        population.append(_born(order, sizes, capacity))
    score = lambda p: -_fitness(p, sizes, capacity)
    ranked = sorted(((score(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
    fewest = -(-sum(sizes) // capacity)
    k = len(ranked)
    for _ in range(generations):
        if len(ranked[0][2]) <= fewest:
            break
        a, b = rng.sample(ranked, 2)
        for child in (crossover(a[2], b[2], sizes, capacity, rng), mutation(ranked[0][2], sizes, capacity, rng)):
            k += 1
            ranked.append((score(child), k, child))
        ranked = sorted(ranked, key=lambda x: x[:2])[:most]
    return [p for _, _, p in ranked]


def _labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _bins_of(labels: list[int]) -> list[list[int]]:
    bins: dict[int, list[int]] = {}
    for i, k in enumerate(labels):
        bins.setdefault(k, []).append(i)
    return [bins[k] for k in sorted(bins)]


def _packed(loose: DataFrame, capacity: int, neighbourhood: int, islands: int, rounds: int, generations: int, seed: int, name: str) -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, n_tokens, container) of loose, which also has the column deal, by which items are dealt to neighbourhoods."""
    cores = loose.sparkSession.sparkContext.defaultParallelism
    shards = -(-loose.count() // neighbourhood) or 1
    dealt = loose.withColumn("shard", F.pmod("deal", F.lit(shards)).cast("int"))
    places = dealt.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("doc_id", "piece_no", "token_start", "token_end", "n_tokens"))).alias("items"))
    state = places.select("shard", "items", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.array().cast("array<array<int>>").alias("population"))
    tasks = max(1, min(shards * islands, max(4 * cores, shards * islands // 64)))
    state = checkpointed(state.repartition(tasks, "shard", "island"))
    for r in range(rounds):

        def step(batches: Iterator[pd.DataFrame], r: int = r) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for shard, island, rows, population in zip(pdf["shard"], pdf["island"], pdf["items"], pdf["population"], strict=True):
                    sizes = [x["n_tokens"] for x in rows]
                    evolved = evolve(sizes, capacity, [_bins_of(list(p)) for p in population], generations, seed * 1_000_003 + int(shard) * 64 + int(island) * 8 + r)
                    out.append([_labels(p, len(sizes)) for p in evolved])
                yield pdf.assign(population=out)

        state = state.mapInPandas(step, state.schema)
        if r + 1 < rounds:  # the elite of an island joins the next one's population; the ring is closed
            ring = Window.partitionBy("shard").orderBy("island")
            ends = Window.partitionBy("shard").orderBy("island").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            elite = F.coalesce(F.lag(F.col("population")[0]).over(ring), F.last(F.col("population")[0]).over(ends))
            state = state.withColumn("elite", elite).withColumn("population", F.concat(F.slice("population", 1, POPULATION - 1), F.array("elite"))).drop("elite")
            state = checkpointed(state.repartition(tasks, "shard", "island"))
    best = F.col("population")[0]
    bins = F.size(F.array_distinct(best))
    chosen = state.withColumn("labels", best).groupBy("shard").agg(F.min(F.struct(bins.alias("bins"), "island", "items", "labels")).alias("b"))
    rows = chosen.select("shard", F.explode(F.arrays_zip(F.col("b.items").alias("items"), F.col("b.labels").alias("labels"))).alias("x"))
    return rows.select("x.items.*", F.concat_ws("-", F.lit(name), "shard", "x.labels").alias("container"))


def pack(sized: DataFrame, capacity: int, neighbourhood: int = NEIGHBOURHOOD, islands: int = ISLANDS, rounds: int = ROUNDS, generations: int = GENERATIONS, seed: int = 7) -> DataFrame:
    """(doc_id, piece_no, token_start, token_end, n_tokens, container): every text of sized (doc_id, n_tokens) in a container.

    Only a text above the capacity is cut: into full containers of its own and a rest that is packed like any item.
    A text of no tokens takes no room but has a container all the same. Repeated doc_ids are items of their own.
    Null sizes count as 0. No rows in, no rows out. Each neighbourhood leaves a container or so with much room; the items
    of all these are dealt to new neighbourhoods and packed once more.
    """
    sized = checkpointed(sized.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("size")))
    sized = sized.withColumn("row", F.monotonically_increasing_id())  # tells repeated rows apart; fixed by the checkpoint
    pieces = F.explode(F.sequence(F.lit(0), F.expr(f"cast(greatest(size - 1, 0) div {capacity} as int)")))
    start = F.col("piece_no").cast("long") * capacity
    items = sized.select("*", pieces.alias("piece_no")).withColumns({"token_start": start, "token_end": F.least(start + capacity, "size")})
    items = items.withColumn("n_tokens", F.col("token_end") - F.col("token_start"))
    full = items.filter(F.col("n_tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), "row", "piece_no"))
    loose = items.filter(F.col("n_tokens") < capacity).withColumn("deal", F.xxhash64(F.lit(seed), "row", "piece_no"))
    settings = capacity, neighbourhood, islands, rounds, generations, seed
    packed = materialized(_packed(loose, *settings, "bin"))
    roomy = packed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).filter(F.col("fill") < OPEN * capacity).select("container")
    roomy = materialized(roomy)
    rest = packed.join(roomy, "container").withColumn("deal", F.xxhash64(F.lit(seed), "container"))
    kept = packed.join(roomy, "container", "left_anti")
    return full.select(packed.columns).unionByName(kept.select(packed.columns)).unionByName(_packed(rest, *settings, "rest"))
