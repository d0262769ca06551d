"""Filling fixed-capacity containers with items of varying length.

Sum-of-squares packing: every item goes to the fill level at which the sum of the squared counts of partly filled
containers grows least; the counts live in a level array and a container is opened only when none can take the item.
Fills are exact bytes, levels only rank them, so a container never exceeds its capacity. Items come in falling length.
While more containers are used than the lengths call for, a few loosely filled ones are emptied and their items come
once more, to be placed by the same rule; the better of both states holds. The number of such turns is bounded in
proportion to the containers and to those beyond the bound, at every size of group, and a turn takes the same time in all.

Groups of more than SHARD_ITEMS items are cut into shards by a hash, each packed by one task; the items of the
containers that a shard leaves partly filled are then packed once more, together, in shards of the same size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import checkpointed

LEVELS = 1024
#: Turns at most for each container beyond the bound and for each container at all, and turns in vain after which it ends.
TURNS, TURNS_EACH, IN_VAIN = 100, 4, 300
#: Containers emptied a turn, beside the emptiest one.
EMPTIED = 3
SHARD_ITEMS = 200_000
OPEN_BELOW = 0.995
_NEVER = np.iinfo(np.int64).max


class Containers:
    """Containers of one capacity, with the level array of those that are partly filled."""

    def __init__(self, capacity: int, levels: int = LEVELS):
        self.capacity, self.levels = capacity, levels
        self.count = np.zeros(levels + 1, np.int64)
        self.at: list[list[tuple[int, int]]] = [[] for _ in range(levels + 1)]
        self.highest = -1
        self.fill: list[int] = []
        self.items: list[list[int]] = []
        self.empty: list[int] = []
        #: State before a turn of each container it touches; none outside turns.
        self.before: dict[int, list[int]] | None = None

    def _enter(self, c: int) -> None:
        if 0 < self.fill[c] < self.capacity:
            level = self.fill[c] * self.levels // self.capacity
            bisect.insort(self.at[level], (self.fill[c], c))
            self.count[level] += 1
            self.highest = max(self.highest, level)

    def _leave(self, c: int) -> None:
        if 0 < self.fill[c] < self.capacity:
            level = self.fill[c] * self.levels // self.capacity
            place = self.at[level]
            place.pop(bisect.bisect_left(place, (self.fill[c], c)))
            self.count[level] -= 1

    def place(self, item: int, size: int) -> None:
        """Into the fullest container that has room at the level where the squares grow least."""
        step = size * self.levels // self.capacity
        top = min(self.levels - step, self.highest)
        target = None
        if top >= 0:
            here = self.count[: top + 1]
            cost = -np.arange(top + 1)
            if step:
                # from level h to h + step the squares grow by 2 (N[h + step] - N[h] + 1); ties go to the fuller level
                cost += (self.count[step : step + top + 1] - here) * (self.levels + 1)
            cost = np.where(here > 0, cost, _NEVER)
            while cost[h := int(cost.argmin())] != _NEVER:
                k = bisect.bisect_right(self.at[h], (self.capacity - size, len(self.fill))) - 1
                if k >= 0:
                    target = self.at[h][k][1]
                    break
                cost[h] = _NEVER
        if target is None:
            if self.empty:
                target = self.empty.pop()
            else:
                target = len(self.fill)
                self.fill.append(0)
                self.items.append([])
        if self.before is not None and target not in self.before:
            self.before[target] = self.items[target][:]
        self._leave(target)
        self.fill[target] += size
        self.items[target].append(item)
        self._enter(target)

    def take_out(self, c: int) -> list[int]:
        """Empty a container; its items."""
        self._leave(c)
        items, self.items[c], self.fill[c] = self.items[c], [], 0
        self.empty.append(c)
        return items

    def loose(self, order: np.random.Generator) -> list[int]:
        """The emptiest container and EMPTIED others, loosely filled ones rather than full ones."""
        level = int((self.count > 0).argmax())
        chosen = {self.at[level][0][1]} if self.count[level] else set()
        for _ in range(64):
            picks = order.integers(0, len(self.fill), 16).tolist()
            for c, chance in zip(picks, order.random(16).tolist(), strict=True):
                if self.fill[c] and chance < 1.02 - self.fill[c] / self.capacity:
                    chosen.add(c)
                    if len(chosen) > EMPTIED:
                        return sorted(chosen)
        return sorted(chosen)

    def turn(self, chosen: list[int], order: np.random.Generator, lengths: list[int]) -> bool:
        """Empty the chosen containers and place their items anew; undone unless containers are saved or the fills drift
        apart, which leaves more room in one piece."""
        self.before = {c: self.items[c][:] for c in chosen}
        opened = len(self.fill)
        again = [i for c in chosen for i in self.take_out(c)]
        sizes = np.array([lengths[i] for i in again])
        noise = order.choice((0.0, 0.1, 0.5)) * order.standard_normal(len(again))
        for k in np.argsort(-sizes * np.exp(noise), kind="stable").tolist():
            self.place(again[k], lengths[again[k]])
        before, self.before = self.before, None
        old = [sum(lengths[i] for i in items) for items in before.values()]
        new = [self.fill[c] for c in before]
        gain = sum(f > 0 for f in old) - sum(f > 0 for f in new)
        if gain > 0 or (gain == 0 and sum(f * f for f in new) >= sum(f * f for f in old)):
            return True
        for c in before:
            self._leave(c)
        for (c, items), f in zip(before.items(), old, strict=True):
            self.items[c], self.fill[c] = items, f
            self._enter(c)
        del self.items[opened:], self.fill[opened:]
        self.empty = [c for c in {*self.empty, *before} if c < opened and not self.fill[c]]
        return False


def least_containers(lengths: np.ndarray, capacity: int) -> int:
    """A lower bound: by the sum of the lengths, and by how many of the longer ones a container holds at most."""
    found = -(-int(lengths.sum()) // capacity)
    for k in range(1, 9):
        found = max(found, -(-int((lengths * (k + 1) > capacity).sum()) // k))
    return found


def sum_of_squares(lengths: np.ndarray, capacity: int, levels: int = LEVELS, turns: int = TURNS) -> np.ndarray:
    """Container of each item, numbered from 0; lengths fall and none exceeds the capacity."""
    packed = Containers(capacity, levels)
    sizes = lengths.tolist()
    for i, size in enumerate(sizes):
        packed.place(i, size)
    floor = least_containers(lengths, capacity)
    used = len(packed.fill)
    order = np.random.default_rng(0)  # the same turns whenever a task runs again
    left, vain = min(turns * (used - floor), TURNS_EACH * used if turns else 0), 0
    while used > floor and left > 0 and vain < IN_VAIN:
        packed.turn(packed.loose(order), order, sizes)
        now = len(packed.fill) - len(packed.empty)
        left, vain, used = left - 1, 0 if now < used else vain + 1, now
    where = np.empty(len(sizes), np.int64)
    for number, items in enumerate(items for items in packed.items if items):
        where[items] = number
    return where


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Container numbers from 0 of items in any order, none longer than the capacity."""
    order = np.argsort(-lengths, kind="stable")
    out = np.empty(len(lengths), np.int64)
    full = int((lengths == capacity).sum())  # first in order, each fills a container
    out[order[:full]] = np.arange(full)
    out[order[full:]] = full + sum_of_squares(lengths[order[full:]], capacity)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).dictionary_encode()
            i = np.asarray(c.indices.fill_null(len(c.dictionary)))
            codes[1:] |= i[1:] != i[:-1]
        starts = [0, *np.flatnonzero(codes).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            piece = batch.slice(a, b - a)
            tag = tuple(piece.column(k)[0].as_py() for k in keys)
            if held and tag != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(piece)
            last = tag
    if held:
        yield pa.Table.from_batches(held)


def _packer(keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.Table] = []
        rows = 0
        for table in _groups(batches, keys):
            lengths = table.column("len").to_numpy()
            where = pack(lengths, int(table.column("cap")[0].as_py()))
            fill = np.bincount(where, weights=lengths).astype(np.int64)
            ready.append(table.append_column("local", pa.array(where)).append_column("fill", pa.array(fill[where])))
            rows += table.num_rows
            if rows > 50_000:
                yield from pa.concat_tables(ready).combine_chunks().to_batches()
                ready, rows = [], 0
        if ready:
            yield from pa.concat_tables(ready).combine_chunks().to_batches()

    return run


def _packed(items: DataFrame, names: list[str]) -> DataFrame:
    """items: names, shard, cap, len, item and piece; adds local and fill. The order within a shard is fixed, so a task
    that runs twice places alike."""
    placed = items.repartition(*names, "shard").sortWithinPartitions(*names, "shard", "item", "piece")
    schema = T.StructType([*placed.schema.fields, T.StructField("local", T.LongType()), T.StructField("fill", T.LongType())])
    return placed.mapInArrow(_packer([*names, "shard"]), schema)


def _shard(shards: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64("item", "piece", F.lit(salt)), shards).cast("int")


def pack_items(items: DataFrame, group: list[str], item: str, length: str, capacity: Column | str, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """group, item, piece, length, capacity, pack_no: every item whole in one container, or in pieces if it alone exceeds
    the capacity.

    Items are distinct per group: of repeated rows the greatest length holds. Null, zero and negative lengths are left
    out, as are null items. A longer item is cut into pieces of the capacity and a rest; pieces are numbered from 0. A
    null group is a group of its own. pack_no is unique within a group, with gaps where the group was cut into shards.
    An empty table gives no rows. The capacity must be positive and the same for all rows of a group.

    One job counts the pieces a group while the plan is made. If a group exceeds shard_items, the first packing is
    checkpointed, so that no group is packed twice.
    """
    names = [f"g{i}" for i in range(len(group))]
    cap = F.col(capacity) if isinstance(capacity, str) else capacity
    rows = items.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col(item).alias("item"), F.col(length).cast("long").alias("whole"), cap.cast("long").alias("cap"))
    rows = rows.filter("item IS NOT NULL AND whole > 0")
    distinct = rows.groupBy(*names, "item").agg(F.max("whole").alias("whole"), F.max("cap").alias("cap"))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(whole - 1) div cap")))
    pieces = distinct.select(*names, "item", "whole", "cap", piece.alias("piece")).withColumn("len", F.least("cap", F.expr("whole - piece * cap"))).drop("whole")

    columns = [*names, "shard", "cap", "len", "item", "piece"]
    sizes = rows.groupBy(*names).agg(F.sum(F.expr("(whole - 1) div cap + 1")).alias("n"))  # repeated rows only add to it
    if (sizes.agg(F.max("n")).first()[0] or 0) <= shard_items:
        both = _packed(pieces.withColumn("shard", F.lit(0)).select(columns), names).withColumn("pack_no", F.col("local"))
    else:
        large = sizes.filter(F.col("n") > shard_items).select(*[F.col(n).alias(f"s_{n}") for n in names], F.ceil(F.col("n") / shard_items).cast("int").alias("shards"))
        on = [F.col(n).eqNullSafe(F.col(f"s_{n}")) for n in names]
        sharded = pieces.join(large, on, "left").drop(*[f"s_{n}" for n in names])
        first = sharded.withColumn("shard", F.coalesce(_shard(F.col("shards"), 0), F.lit(-1)))
        first = checkpointed(_packed(first.select(columns), names))
        again = (F.col("shard") >= 0) & (F.col("fill") < F.col("cap") * OPEN_BELOW)
        left = first.filter(again).select(*names, "cap", "len", "item", "piece")
        counts = left.groupBy(*[F.col(n).alias(f"s_{n}") for n in names]).agg(F.ceil(F.count(F.lit(1)) / shard_items).cast("int").alias("shards"))
        rest = left.join(counts, on).withColumn("shard", _shard(F.col("shards"), 1))
        number = lambda turn: F.lit(turn << 56) + F.shiftleft(F.greatest("shard", F.lit(0)).cast("long"), 32) + F.col("local")
        both = first.filter(~again).withColumn("pack_no", number(0)).unionByName(_packed(rest.select(columns), names).withColumn("pack_no", number(1)))
    return both.select(*[F.col(n).alias(g) for g, n in zip(group, names, strict=True)], F.col("item").alias(item), "piece", F.col("len").alias(length), F.col("cap").alias("capacity"), "pack_no")
