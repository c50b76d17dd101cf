"""Problems 3 and 5: stable and uniform samples."""

import math
import os
import tempfile
from collections import Counter

import pytest

from seqloom.common import table
from seqloom.llm import block_sample, ledger_sample

FRAGMENTS = "ordinal long, id string, run_id string, piece_no int"


def fragments(spark, rows):
    return spark.createDataFrame(rows, FRAGMENTS)


def ledger(spark, rows):
    return ledger_sample.ledger_keys(spark.createDataFrame(rows, "ordinal long, key string"))


def chosen(df):
    rows = df.collect()
    assert len(rows) == len({r.ordinal for r in rows})
    return {r.ordinal: (r.origin, r.priority) for r in rows}


K = "0123456789abcdef" * 2


def test_ledger_spellings(spark):
    rows = [(0, K), (1, K.upper()), (2, f" 0x{K}"), (3, None), (4, "xyz"), (5, K[:-1]), (0, K), (99, K), (None, K)]
    assert {r.ordinal for r in ledger(spark, rows).collect()} == {0, 1, 2, 99, None}


def test_sample_is_stable_under_order_growth_and_redelivery(spark):
    old = [(i, f"f{i}", "a" if i % 3 else None, i % 4) for i in range(400)]
    again = [(i, f"f{i} ", "a" if i % 3 else None, 5) for i in range(0, 400, 9)]
    later = [(i, f"f{i}", "b", 6) for i in range(400, 700)] + [(None, "x", "a", 0), (700, None, "b", None)]
    keys = ledger(spark, [(i, K) for i in range(0, 400, 5)])
    first = chosen(ledger_sample.ledger_sample(fragments(spark, old), keys))
    assert {i for i, (o, _) in first.items() if o == "ledger"} == set(range(0, 400, 5))
    for parts in (1, 6):
        assert chosen(ledger_sample.ledger_sample(fragments(spark, old[::-1]).repartition(parts), keys)) == first
    assert chosen(ledger_sample.ledger_sample(fragments(spark, old + again), keys)) == first
    grown = chosen(ledger_sample.ledger_sample(fragments(spark, old + again + later), keys))
    assert first.items() <= grown.items()
    assert sum(i >= 400 for i in grown) == math.ceil(300 / 8) + 1


def test_quota_is_filled_and_ledger_extends(spark):
    rows = fragments(spark, [(i, f"f{i}", "a", 0) for i in range(80)])
    none = ledger(spark, [])
    first = chosen(ledger_sample.ledger_sample(rows, none))
    assert len(first) == 10
    nxt = ledger_sample.extend_ledger(rows, none, tempfile.mkdtemp() + "/l1")
    assert chosen(ledger_sample.ledger_sample(rows, nxt)) == first == chosen(ledger_sample.selected(rows, nxt))  # nothing more is added
    more = rows.unionByName(fragments(spark, [(i, f"f{i}", "a", 0) for i in range(80, 160)]))
    assert set(first) <= set(chosen(ledger_sample.ledger_sample(more, nxt)))  # even when the old piece itself grows
    assert ledger_sample.ledger_sample(rows.filter("false"), nxt).count() == 0


def test_no_added_row_unseats_a_selected_fragment(spark):
    """Redelivery under lower and higher pieces and other runs, more rows of old pieces, new pieces and runs: 0 lost."""
    folder = tempfile.mkdtemp() + "/ledger"
    rows = [(i, f"f{i}", "ab"[i % 2], 2 + i % 5) for i in range(1500)]
    keys = ledger(spark, [(i, K) for i in range(0, 1500, 40)])
    held = chosen(ledger_sample.draw(fragments(spark, rows), keys, folder))
    assert len(held) > 150 and sum(o == "growth" for o, _ in held.values()) > 100
    again = [
        [(i, f"f{i}", "ab"[i % 2], 0) for i in range(0, 1500, 3)],
        [(i, f"f{i}", "ab"[i % 2], 99) for i in range(0, 1500, 4)],
        [(i, f"f{i}", "0", 1) for i in range(1, 1500, 5)] + [(i, f"f{i}", None, None) for i in range(1, 1500, 7)],
        [(i, f"f{i}", "ab"[i % 2], 2 + i % 5) for i in range(2000, 2900)],
        [(i, f"f{i}", "c", 1) for i in range(3000, 3200)],
    ]
    for more in again:
        rows = rows + more
        now = chosen(ledger_sample.draw(fragments(spark, rows).repartition(3), keys, folder))
        assert held.items() <= now.items()
        held = now
    assert ledger_sample.editions(spark, folder) == (6, 6)
    os.makedirs(f"{folder}/edition=7")  # left by a draw that was lost
    assert chosen(ledger_sample.draw(fragments(spark, rows), keys, folder)) == held  # nothing new, nothing changes


@pytest.fixture(scope="module")
def stored(spark):
    path = tempfile.mkdtemp() + "/fragments.parquet"
    rows = [(i, f"f{i}", "big" if i % 4 else "small", 0) for i in range(2000)]
    rows += rows[:300] + [(3000, "x", None, 0), (None, "y", "big", 0)]
    fragments(spark, rows).repartition(5).write.option("parquet.block.row.count.limit", 100).parquet(path)
    return spark.read.parquet(path)


def design(spark, rows):
    return spark.createDataFrame(rows, "run_id string, capacity long")


def test_block_sample_sizes(spark, stored):
    d = design(spark, [("big", 100), ("small", 5000), ("nothing", 7), ("null", None), ("big", 40)])
    rows = block_sample.block_sample(stored, d).collect()
    n = Counter(r.run_id for r in rows)
    assert n == {"big": 100, "small": 500} and len({r.ordinal for r in rows}) == 600
    assert all(r.ordinal % 4 for r in rows if r.run_id == "big")
    again = block_sample.block_sample(stored, d).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    nearly = block_sample.block_sample(stored, design(spark, [("big", 1499)])).collect()
    assert len({r.ordinal for r in nearly}) == 1499
    assert block_sample.block_sample(stored, design(spark, [("big", 0)])).count() == 0


def test_block_sample_is_uniform(spark, stored):
    """Each of 1500 fragments, delivered once or twice, comes with the same chance: chi-square over 10 draws of 450."""
    seen = Counter()
    for seed in range(10):
        seen.update(r.ordinal for r in block_sample.block_sample(stored, design(spark, [("big", 450)]), seed=seed).collect())
    assert sum(seen.values()) == 10 * 450
    twice = sum(v for k, v in seen.items() if k < 300) / 225
    once = sum(v for k, v in seen.items() if k >= 300) / 1275
    assert abs(twice - 3) < 0.4 and abs(once - 3) < 0.2
    chi = sum((seen[i] - 3) ** 2 / (3 * 0.7) for i in range(2000) if i % 4)
    assert abs(chi - 1499) < 5 * math.sqrt(2 * 1499)


def test_row_groups_cover_files(spark, data):
    t = table(spark, data, "fragments")
    groups = block_sample.row_groups(t)
    assert {r.start for r in groups.filter("group_no = 0").collect()} == {0}
    n = {r.run_id: r["sum(n)"] for r in block_sample.run_blocks(groups, "run_id").groupBy("run_id").sum("n").collect()}
    assert n == {r.run_id: r["count"] for r in t.filter("run_id is not null").groupBy("run_id").count().collect()}


def test_block_sample_of_many_redeliveries(spark):
    """A run whose rows are mostly redeliveries: fewer fragments than its capacity, or hardly more, in very many rows."""
    path = tempfile.mkdtemp() + "/fragments.parquet"
    rows = [(i % 50, "f", "a", 0) for i in range(3000)] + [(1000 + i % 60, "f", "b", 0) for i in range(3000)] + [(1000, "f", "a", 0)]
    fragments(spark, rows).coalesce(1).write.option("parquet.block.row.count.limit", 100).parquet(path)
    got = block_sample.block_sample(spark.read.parquet(path), design(spark, [("a", 100), ("b", 58)])).collect()
    assert {r.ordinal for r in got if r.run_id == "a"} == set(range(50)) and all(r.draw is None for r in got if r.run_id == "a")
    b = [r.ordinal for r in got if r.run_id == "b"]
    assert len(b) == len(set(b)) == 58 and set(b) <= set(range(1000, 1060))
