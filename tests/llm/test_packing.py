import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 1000), min_size=1, max_size=80), st.integers(1000, 5000))
def test_no_container_overflows_and_few_are_used(lengths, capacity):
    items = np.array(lengths, np.int64)
    where = packing.pack(items, capacity)
    fill = np.bincount(where, weights=items)
    assert fill.max() <= capacity and (fill > 0).all()
    order = sorted(lengths, reverse=True)
    bins = []
    for s in order:  # first fit, falling
        k = next((i for i, b in enumerate(bins) if b + s <= capacity), None)
        if k is None:
            bins.append(s)
        else:
            bins[k] += s
    assert len(fill) <= len(bins) + max(1, len(bins) // 10)


def test_levels_are_chosen_by_the_squares_of_their_counts():
    # three containers at 60 %, then two items of 40 %: both fill a container up, none is opened
    where = packing.sum_of_squares(np.array([60, 60, 60, 40, 40], np.int64), 100, levels=10)
    assert len(set(where.tolist())) == 3


def test_full_sized_items_and_exact_fits():
    assert sorted(packing.pack(np.array([100, 100, 50, 50], np.int64), 100).tolist()).count(0) >= 1
    assert int(packing.pack(np.array([100, 100, 50, 50], np.int64), 100).max()) == 2
    assert len(packing.pack(np.empty(0, np.int64), 100)) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=2, max_size=60), st.integers(500, 900), st.integers(0, 9))
def test_a_turn_keeps_every_item_and_never_adds_containers(lengths, capacity, seed):
    falling = sorted(lengths, reverse=True)
    state = packing.Containers(capacity, levels=32)
    for i, size in enumerate(falling):
        state.place(i, size)
    order = np.random.default_rng(seed)
    used = len(state.fill)
    for _ in range(20):
        there = [c for c, f in enumerate(state.fill) if f]
        state.turn(sorted(order.choice(there, size=min(3, len(there)), replace=False).tolist()), order, falling)
        now = sum(f > 0 for f in state.fill)
        assert now <= used
        used = now
        assert sorted(i for items in state.items for i in items) == list(range(len(falling)))
        assert [sum(falling[i] for i in items) for items in state.items] == state.fill and max(state.fill) <= capacity
        assert sorted(state.empty) == [c for c, f in enumerate(state.fill) if not f]
        partly = sorted((f, c) for c, f in enumerate(state.fill) if 0 < f < capacity)
        assert sorted(x for level in state.at for x in level) == partly and state.count.tolist() == [len(level) for level in state.at]


def test_more_turns_never_cost_containers_and_places_are_the_same_each_time():
    rng = np.random.default_rng(4)
    lengths = np.sort(rng.choice([70, 50, 33, 30, 26], 200) + rng.integers(-2, 2, 200))[::-1]
    plain, better = packing.sum_of_squares(lengths, 100, turns=0), packing.sum_of_squares(lengths, 100)
    assert better.max() <= plain.max()
    assert (better == packing.sum_of_squares(lengths, 100)).all()


NAMES = "e string, ty int, id string, len long, cap long, shard int, grp string, local long, fill long"


def run(spark, data, shard_items=packing.SHARD_ITEMS):
    df = spark.createDataFrame([(*d, 1, "x", 2, 3) for d in data], NAMES)
    return packing.pack_items(df, ["e", "ty"], "id", "len", "cap", shard_items).collect()


@pytest.mark.parametrize("shard_items", [7, 100_000])
def test_every_item_once_and_whole(spark, shard_items):
    rng = random.Random(shard_items)
    data = [(rng.choice(["a", "a", "a", None]), rng.choice([0, 1]), f"i{n}", rng.choice([rng.randint(1, 40), 250, 100]), 100) for n in range(300)]
    dirty = data + data[:30] + [("a", 0, "null", None, 100), ("a", 0, "zero", 0, 100), ("a", 0, None, 5, 100), ("a", 0, "minus", -3, 100)]
    out = run(spark, dirty, shard_items)
    whole, fill = {}, {}
    for r in out:
        whole[r.e, r.ty, r.id] = whole.get((r.e, r.ty, r.id), 0) + r.len
        fill[r.e, r.ty, r.pack_no] = fill.get((r.e, r.ty, r.pack_no), 0) + r.len
        assert r.piece == 0 or r.id in {d[2] for d in data if d[3] > 100}
    assert whole == {(d[0], d[1], d[2]): d[3] for d in data}
    assert max(fill.values()) <= 100 and len(out) == sum(-(-d[3] // 100) for d in data)


def test_of_repeated_rows_the_longest_holds_and_empty_tables_pack_nothing(spark):
    assert [(r.id, r.len) for r in run(spark, [("a", 0, "x", 3, 10), ("a", 0, "x", 7, 10)])] == [("x", 7)]
    assert run(spark, []) == []


def test_shards_waste_little(spark):
    rng = random.Random(9)
    data = [("a", 0, f"i{n}", rng.randint(1, 30), 100) for n in range(3000)]
    packs = len({r.pack_no for r in run(spark, data, 300)})
    assert packs <= -(-sum(d[3] for d in data) // 100) + 12


def test_packs_of_the_data(spark, sf):
    from tidemark.llm.queries import p2_packs, p2_unused

    used = p2_packs(spark, sf).groupBy("epoch_id", "type", "pack_no").agg(F.sum("length").alias("n"), F.max("capacity").alias("c"))
    assert used.filter("n > c").count() == 0
    assert p2_unused(spark, sf).filter("unused_bytes < 0 OR packs < 1").count() == 0
