"""Seeded epochs and shards, made in parallel, against the chains that they stand for."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corploom.functions.rng import Rng, draws_below, jumped, raw_draws, state_of
from corploom.operators import packing, windows


def test_jumps_go_where_steps_go():
    rng = Rng(99)
    start, numbers = state_of(rng), [rng.next() for _ in range(1500)]
    assert jumped(start, 1500) == state_of(rng) and jumped(start, 0) == start
    assert raw_draws(start, 1500).tolist() == numbers and raw_draws(jumped(start, 700), 3).tolist() == numbers[700:703]
    assert jumped(jumped(start, 1 << 70), 5) == jumped(start, (1 << 70) + 5)


def test_draws_again_move_the_rest():
    rng, bounds = Rng(3), np.array([(1 << 63) + 12345 + 7 * k for k in range(400)] + [1, 2, 3, 10**9], np.uint64)
    want = [rng.below(int(b)) for b in bounds]
    values, again = draws_below(state_of(Rng(3)), bounds)
    assert values.tolist() == want and again > 100
    assert jumped(state_of(Rng(3)), len(bounds) + again) == state_of(rng)


@pytest.mark.parametrize(("n", "draws"), [(0, 8), (1, 8), (2, 8), (3, 1), (100, 16), (1000, 7), (30_000, 4096)])
def test_permutation_is_the_chain(spark, n, draws):
    order = packing.permutation(spark, n, 42, 1, draws).orderBy("place").collect()
    assert [r["place"] for r in order] == list(range(n)) and [r["sequence"] for r in order] == Rng(42).fork(1).permutation(n)
    if n == 100:
        assert [r["sequence"] for r in order][:5] == [10, 8, 63, 80, 68]


def test_numbers_drawn_again_in_an_epoch(spark, monkeypatch):
    """With a generator that refuses a third of the numbers, blocks go on where those before them ended."""
    from corploom.functions import rng

    def picky(state, bounds):
        out, again, source = [], 0, rng.Rng(0)
        source.s = [state >> (64 * k) & rng.MASK for k in range(4)]
        for b in bounds.tolist():
            while (x := source.next()) % 3 == 0:
                again += 1
            out.append(x % b)
        return np.array(out, np.uint64), again

    monkeypatch.setattr(packing, "draws_below", picky)
    source, want = Rng(5).fork(2), []
    for i in range(40, 0, -1):
        while (x := source.next()) % 3 == 0:
            pass
        want.append((i, x % (i + 1)))
    assert sorted(map(tuple, packing.epoch_draws(spark, 41, 5, 2, 6).collect()), reverse=True) == want


def test_epoch_batches_seek(spark):
    whole = sorted(map(tuple, packing.epoch_batches(spark, 103, 8, 7, 3).collect()))
    order = Rng(7).fork(3).permutation(103)
    assert whole == [(3, k // 8, k % 8, order[k]) for k in range(96)]
    assert sorted(map(tuple, packing.epoch_batches(spark, 103, 8, 7, 3, start=5).collect())) == whole[40:]


def greedy(rows, target):
    shard = filled = 0
    out = []
    for o, size in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if size > 0:
            out.append((o, size, shard))
            filled += size
            if filled >= target:
                shard, filled = shard + 1, 0
    return sorted(out, key=repr)


def test_shards_of_skewed_and_repeated_orders(spark):
    rng = random.Random(1)
    ids = [rng.choice([5, 5, 5, None, 10**15, *range(100, 160)]) for _ in range(3000)]
    rows = [(i, rng.randrange(-1, 9)) for i in ids]
    want = greedy(rows, 50)
    for layout in (1, 5, 9):
        rng.shuffle(rows)
        frame = spark.createDataFrame(rows, "o long, s long").repartition(layout)
        assert sorted(map(tuple, packing.greedy_shards(frame, "s", "o", 50, 12).collect()), key=repr) == want


def test_ranges_are_even(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") == 1, 10**15).otherwise(F.col("id") % 50).alias("k"))
    sizes = [r["count"] for r in windows.in_ranges(rows, ["k"], 16).groupBy("block").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
    total = windows.running_total(rows, F.lit(1), ["k"], "n", 16)
    assert total.agg(F.count_distinct("n"), F.max("n")).first() == (20_000, 20_000)
    ordered = [r["k"] for r in total.orderBy("n").collect()]
    assert ordered == sorted(ordered)


def test_running_max_of_hot_keys(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice("aaab") if k % 10 else None, rng.choice([None, rng.randrange(1000)])) for k in range(2000)]
    best, want = {}, []
    for k, key, v in rows:
        best[key] = max((x for x in (best.get(key), v) if x is not None), default=None)
        want.append((k, best[key]))
    frame = spark.createDataFrame(rows, "k long, key string, v long").repartition(5)
    assert sorted((r["k"], r["m"]) for r in windows.running_max(frame, "key", "v", ["k"], "m", 7).collect()) == want


@pytest.mark.parametrize(("n", "draws"), [(0, 8), (1, 8), (2, 8), (3, 1), (100, 16), (30_000, 4096)])
def test_a_few_places_of_a_permutation(spark, monkeypatch, n, draws):
    """They are those of the chain, and no table is written for them."""
    monkeypatch.setattr(packing, "materialize", None)
    want = Rng(42).fork(1).permutation(n)
    for places in (range(min(n, 64)), range(n // 2, min(n, n // 2 + 9)), range(max(0, n - 5), n)):
        assert packing.sequences_at(spark, n, 42, 1, places, draws) == [(p, want[p]) for p in places]
    whole = sorted(map(tuple, packing.epoch_batches(spark, n, 8, 42, 1, 2, 5).collect()))
    assert whole == [(1, p // 8, p % 8, want[p]) for p in range(16, min(40, n - n % 8))]
