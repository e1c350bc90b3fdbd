"""Code construction against brute force, run splitting, hot keys."""

import heapq
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framelake.functions import fixed
from framelake.operators import symbols as sy


def huffman_cost(counts):
    heap = list(counts)
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        merged = heapq.heappop(heap) + heapq.heappop(heap)
        cost += merged
        heapq.heappush(heap, merged)
    return cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=40))
def test_optimal_cost(counts):
    lengths = sy._code_lengths(list(range(len(counts))), counts)
    assert len(lengths) == len(counts)
    assert sum(2.0 ** -n for n in lengths.values()) < 1
    # Best code with one more symbol of count 1, which then gives up the longest code.
    own = sum(lengths[i] * n for i, n in enumerate(counts))
    assert own <= huffman_cost([*counts, 1])
    assert own >= huffman_cost(counts) if len(counts) > 1 else own == counts[0]  # one bit each


def test_limit_is_16_bits():
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    lengths = sy._code_lengths(list(range(30)), counts)
    assert max(lengths.values()) == 16 and sum(2.0 ** -n for n in lengths.values()) < 1
    # Rarer symbols never get shorter codes; 0 and 1 have equal counts, so either may be the longer one.
    assert lengths[0] <= lengths[1] and all(lengths[i] >= lengths[i + 1] for i in range(1, 29))


def test_equal_counts_prefer_small_symbols():
    lengths = sy._code_lengths([0, 1, 2, 3], [5, 5, 5, 5])
    assert sorted(lengths.values()) == [2, 2, 2, 3]
    # The reserved symbol pairs with the largest symbol, so that one gets the longer code.
    assert lengths[3] == 3


def test_codes_are_prefix_free(spark):
    rows = [(1, 1, 0, list(fixed.AC_LUMA_COUNTS), list(fixed.AC_LUMA_SYMBOLS))]
    table = spark.createDataFrame(rows, "image_id int, class int, slot int, bits array<int>, vals array<int>")
    codes = [format(r.code, f"0{r.length}b") for r in sy.canonical_codes(table).collect()]
    assert len(codes) == 162
    ordered = sorted(codes)
    assert not any(b.startswith(a) for a, b in itertools.pairwise(ordered))
    assert all("0" in c for c in codes)


def test_bad_tables_are_flagged(spark):
    rows = [(1, 0, 0, [2] + [0] * 15, [0, 1]), (2, 0, 0, [0, 2] + [0] * 14, [1, 1]), (3, 0, 0, [0, 1] + [0] * 14, [16]), (4, 1, 0, [0, 1] + [0] * 14, [16])]
    table = spark.createDataFrame(rows, "image_id int, class int, slot int, bits array<int>, vals array<int>")
    ok = {r.image_id: r.ok for r in sy.canonical_codes(table).collect()}
    assert ok == {1: False, 2: False, 3: False, 4: True}


def test_long_eob_runs_are_split(spark):
    """40,000 empty blocks make one run of 7FFFh and one of the rest, across many chunks."""
    empty = spark.range(40000).select(F.lit(1).alias("image_id"), F.lit(0).alias("ci"), F.col("id").alias("pos"), F.array_repeat(F.lit(0), 64).alias("coef"))
    runs = sorted(r.run for r in sy.eob_runs(empty, 1, 63, 0, chunk=1000).collect())
    assert runs == [40000 - 0x7FFF, 0x7FFF]
    assert sorted(r.run for r in sy.eob_runs(empty, 1, 63, 0, restart=15000, chunk=1000).collect()) == [10000, 15000, 15000]


def test_zero_runs_and_symbols(spark):
    block = [0] * 64
    block[0], block[63], block[1] = 5, -3, 2  # last zigzag position, and the first
    df = spark.createDataFrame([(1, 0, 0, 0, block)], "image_id int, ci int, by int, bx int, coef array<int>")
    assert [(r.pos, r.run) for r in sy.zero_runs(df).collect()] == [(1, 0), (63, 61)]
    counts = {r.symbol: r.n for r in sy.ac_symbol_counts(df, df.select("image_id", "ci", F.lit(0).alias("ac_table"))).collect()}
    assert counts == {0x02: 1, 0xF0: 3, (61 - 48) * 16 + 2: 1}


def test_sizes_add_up(spark):
    """Every image's best tables cost no more than the standard ones."""
    from checks.symbols import positioned, tables
    from tests.conftest import SF

    blocks, comps = positioned(spark, SF), tables(spark, SF)
    report = sy.encoding_report(blocks, comps).collect()
    counts = sy.dc_symbol_counts(sy.dc_diff(blocks), comps).unionByName(sy.ac_symbol_counts(blocks, comps))
    apart = {r.image_id: r.bits for r in sy.coded_size(counts, sy.optimal_lengths(counts).drop("n")).collect()}
    assert {r.image_id: r.optimal_bits for r in report} == apart
    assert report and all(r.saved_bits >= 0 and r.uncodable == 0 for r in report)


def test_unlisted_components_keep_their_counts(spark):
    block = [3, -1] + [0] * 62
    blocks = spark.createDataFrame([(i, c, 0, 0, 0, 1, 1, block) for i, c in ((1, 0), (1, 1), (2, 0))], "image_id int, ci int, by int, bx int, pos long, h int, v int, coef array<int>")
    comps = spark.createDataFrame([(1, 0, 0, 0)], "image_id int, ci int, dc_table int, ac_table int")
    diffs = blocks.select("image_id", "ci", F.col("coef")[0].alias("diff"))
    for counts, each in ((sy.dc_symbol_counts(diffs, comps), 1), (sy.ac_symbol_counts(blocks, comps), 2)):
        found = {}
        for r in counts.collect():
            found[r.image_id, r.slot] = found.get((r.image_id, r.slot), 0) + r.n
        assert found == {(1, 0): each, (1, None): each, (2, None): each}
    assert {r.image_id: r.uncodable for r in sy.encoding_report(blocks, comps).collect()} == {1: 3, 2: 3}


def test_codes_of_odd_tables(spark):
    """Counts below zero, missing counts and missing or NULL symbols: the table is not ok, its codes are still told."""
    flat = lambda *head: [*head, *[0] * (16 - len(head))]
    rows = [
        (0, 1, flat(0, 2, 1), [5, 6, 7]), (1, 1, flat(0, 2, 1), [5, 6]), (2, 1, flat(0, 2, 1), [5, None, 7]), (3, 1, flat(0, 2, -1, 1), [5, 6, 7]),
        (4, 1, [0, 1, None, 1], [5, 6]), (5, 1, None, [5]), (6, 1, flat(0, 1), None), (7, 0, flat(0, 1), [16]), (8, None, flat(0, 1), [3]), (9, 1, flat(0, 2), [4, 4]),
        (10, 1, flat(1, 1, 1), [1, 2, 3]), (11, 1, flat(2), [1, 2]),
    ]
    got = sy.canonical_codes(spark.createDataFrame(rows, "t int, class int, bits array<int>, vals array<int>")).collect()
    assert {r.t for r in got if r.ok} == {0, 8, 10} and not [r for r in got if r.t == 5]
    assert [(r.symbol, r.length, r.code) for r in got if r.t == 1] == [(5, 2, 0), (6, 2, 1), (None, 3, 4)]
    assert [(r.symbol, r.length, r.code) for r in got if r.t == 4] == [(5, 2, 0), (None, 4, None)]


def test_codes_are_made_by_many_tasks(spark):
    """A part is one narrow row of a small file and up to 162 codes."""
    import __spark_entry__ as entry
    from tests.conftest import SF

    assert entry.queries()["canonical_codes"](spark, SF).rdd.getNumPartitions() >= 16
