"""Overlapping and gapped intervals: continuous periods per entity and the stretches between them.

The aggregate's state is a list of sorted disjoint intervals per entity. Every input partition folds its rows into one
state per entity before anything is shuffled; a reduction tree with a leaf a task then combines FAN_IN neighbouring
states at a time by merging sorted lists, on as many levels as the number of tasks calls for. An entity with more than
SEGMENT_ROWS rows is cut into segments of the axis at its own quantiles, STEPS at a time until none has more, so no state
holds more intervals than that however much of the data the entity owns; the segments are stitched together by their
outermost bounds, one small row each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import lsn
from tidemark.session import checkpointed, scan_tasks

SEGMENT_ROWS = 200_000
FAN_IN = 16
#: Segments that one round of cuts makes of an entity at most.
STEPS = 256


def merge_sorted(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals from ones sorted by start; those that overlap or touch become one."""
    if len(starts) == 0:
        return starts, ends
    reach = np.maximum.accumulate(ends)
    fresh = np.empty(len(starts), bool)
    fresh[0] = True
    np.greater(starts[1:], reach[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    return starts[first], reach[np.append(first[1:] - 1, len(starts) - 1)]


def merge_lists(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Linear merge of two sorted disjoint lists: the stable sort finds two runs and merges them in one walk."""
    starts, ends = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(starts, kind="stable")
    return merge_sorted(starts[order], ends[order])


def _leaf(keys: int, flush: int, leaves: int):
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, list] = {}
        held = 0
        task = _task_id(leaves)

        def out():
            rows = [(k, *s[0]) for k, s in ((k, _reduced(s)) for k, s in states.items())]
            columns = [pa.array([r[0][i] for r in rows]) for i in range(keys)]
            return _state_batch(columns, [r[1] for r in rows], [r[2] for r in rows], [task] * len(rows))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = [batch.column(i).dictionary_encode() for i in range(keys)]
            ids = np.zeros(batch.num_rows, np.int64)
            for c in codes:
                ids = ids * (len(c.dictionary) + 1) + np.asarray(c.indices.fill_null(len(c.dictionary)))
            starts, ends = (np.asarray(batch.column(keys + i)) for i in range(2))
            order = np.lexsort((starts, ids))
            cut = np.flatnonzero(np.diff(ids[order], prepend=ids[order][0] - 1))
            for x, y in zip(cut, np.append(cut[1:], len(order)), strict=True):
                row = order[x]
                key = tuple(batch.column(i)[int(row)].as_py() for i in range(keys))
                part = merge_sorted(starts[order[x:y]], ends[order[x:y]])
                states.setdefault(key, []).append(part)
                held += len(part[0])
            if held > flush:
                states = {k: _reduced(s) for k, s in states.items()}
                held = sum(len(s[0][0]) for s in states.values())
                if held > flush // 2:
                    yield out()
                    states, held = {}, 0
        if states:
            yield out()

    return fold


def _reduced(parts: list) -> list:
    """One list of a balanced tree of pairwise merges."""
    while len(parts) > 1:
        parts = [merge_lists(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts


def _task_id(leaves: int) -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() % leaves if context else 0


def tree_slots(leaves: int, fan_in: int = FAN_IN) -> list[int]:
    """Slots of each level above the leaves, down to one; a slot takes fan_in slots of the level below at most."""
    found = []
    while leaves > 1 or not found:
        leaves = -(-leaves // fan_in)
        found.append(leaves)
    return found


def _state_batch(keys: list[pa.Array], starts: list[np.ndarray], ends: list[np.ndarray], slots: list[int]) -> pa.RecordBatch:
    lists = []
    for parts in (starts, ends):
        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        lists.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]))))
    return pa.RecordBatch.from_arrays([*keys, *lists, pa.array(slots, pa.int64())], names=[f"k{i}" for i in range(len(keys))] + ["starts", "ends", "slot"])


def _lists(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    found = []
    for batch in table.select(["starts", "ends"]).to_batches():
        s, e = batch.column(0), batch.column(1)
        offsets = np.asarray(s.offsets)
        flat_s, flat_e = np.asarray(s.values), np.asarray(e.values)
        shift = np.asarray(e.offsets)
        found += [(flat_s[a:b], flat_e[c:d]) for a, b, c, d in zip(offsets[:-1], offsets[1:], shift[:-1], shift[1:], strict=True)]
    return found


def _combine(keys: int):
    def combine(table: pa.Table) -> pa.Table:
        starts, ends = _reduced(_lists(table))[0]
        first = table.slice(0, 1)
        batch = _state_batch([first.column(f"k{i}").combine_chunks() for i in range(keys)], [starts], [ends], [first.column("slot")[0].as_py()])
        return pa.Table.from_batches([batch])

    return combine


def continuous_periods(df: DataFrame, entity: Sequence[str], start: str, end: str, segment_rows: int = SEGMENT_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """entity, `segment`, `starts`, `ends`: sorted disjoint long intervals [start, end) of each segment of each entity.

    Overlapping and touching intervals are one. Rows with a null bound, or that do not end after they start, cover
    nothing; a null entity is an entity of its own. An entity within segment_rows rows has the single segment 0. One job
    finds the rows of the largest entity while the plan is made; beyond about STEPS segments an entity, each further round
    of cuts starts from a checkpoint.
    """
    names = [f"k{i}" for i in range(len(entity))]
    rows = df.select(*[df[c].alias(n) for c, n in zip(entity, names, strict=True)], df[start].alias("s"), df[end].alias("e")).filter("s IS NOT NULL AND e IS NOT NULL AND e > s")
    leaves = scan_tasks(rows)
    largest = rows.groupBy(*names).count().agg(F.max("count")).first()[0] or 0
    rows = rows.withColumn("seg", F.lit(0).cast("long"))
    rounds = 0
    while largest > segment_rows:
        # a further round looks at the rows several times, so the round before it is made once
        rows = _segmented(checkpointed(rows) if rounds else rows, [*names, "seg"], segment_rows)
        largest = math.ceil(largest / (STEPS // 2))  # quantiles are approximate
        rounds += 1
    schema = T.StructType([rows.schema[n] for n in names] + [T.StructField("seg", T.LongType())] + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("starts", "ends")] + [T.StructField("slot", T.LongType())])
    keyed = [*names, "seg"]
    renamed = lambda d: d.select(*[F.col(n).alias(f"k{i}") for i, n in enumerate(keyed)], *[n for n in d.columns if n not in keyed])
    kschema = T.StructType([T.StructField(f"k{i}", schema[n].dataType) for i, n in enumerate(keyed)] + schema.fields[len(keyed) :])
    state = renamed(rows).mapInArrow(_leaf(len(keyed), 4 * segment_rows, leaves), kschema)
    for slots in tree_slots(leaves, fan_in):
        slot = F.floor(F.col("slot") / fan_in) if slots > 1 else F.lit(0).cast("long")
        state = state.withColumn("slot", slot).groupBy(*[f"k{i}" for i in range(len(keyed))], "slot").applyInArrow(_combine(len(keyed)), kschema)
    return state.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate([*entity, "segment"])], "starts", "ends")


def _segmented(rows: DataFrame, names: list[str], segment_rows: int) -> DataFrame:
    """Cuts every (entity, seg) of more than segment_rows rows into up to STEPS new segments; an interval that crosses a
    cut is split there, so each piece lies in one segment. Only the rows of such entities are looked at for cuts."""
    large = rows.groupBy(*[F.col(n).alias(f"h_{n}") for n in names]).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > segment_rows)
    on = lambda d: [F.col(n).eqNullSafe(d[f"h_{n}"]) for n in names]
    of_large = rows.join(large, on(large)).groupBy(*[f"h_{n}" for n in names])
    cuts = of_large.agg(F.first("n").alias("n"), F.percentile_approx("s", [i / STEPS for i in range(1, STEPS)], 10 * STEPS).alias("q"))
    stride = F.greatest(F.lit(1), F.floor(F.lit(STEPS * segment_rows) / F.col("n")).cast("int"))
    cuts = cuts.select(*[f"h_{n}" for n in names], F.array_sort(F.array_distinct(F.filter("q", lambda x, i: (i + 1) % stride == 0))).alias("cuts"))
    joined = rows.join(cuts, on(cuts), "left").drop(*[f"h_{n}" for n in names])
    inside = F.filter("cuts", lambda c: (c > F.col("s")) & (c < F.col("e")))
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("s"))), F.lit(0))
    bounds = F.concat(F.array("s"), F.coalesce(inside, F.array().cast("array<bigint>")), F.array("e"))
    base = F.col("seg") * STEPS
    pieces = F.transform(F.sequence(F.lit(0), F.size(bounds) - 2), lambda i: F.struct(F.get(bounds, i).alias("s"), F.get(bounds, i + 1).alias("e"), (base + below + i).cast("long").alias("seg")))
    whole = F.array(F.struct("s", "e", base.cast("long").alias("seg")))
    keep = [n for n in names if n != "seg"]
    return joined.select(*keep, F.explode(F.when(F.col("cuts").isNull(), whole).otherwise(pieces)).alias("p")).select(*keep, "p.s", "p.e", "p.seg")


def gaps(periods: DataFrame, entity: Sequence[str]) -> DataFrame:
    """entity, gap_start, gap_end: the complement between neighbouring periods of each entity, segments stitched."""
    names = [f"k{i}" for i in range(len(entity))]
    periods = periods.toDF(*names, "segment", "starts", "ends")
    inner = F.explode(F.arrays_zip(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))).alias("a"), F.slice("starts", 2, 2147483647).alias("b")))
    within = periods.select(*names, inner.alias("g")).select(*names, F.col("g.a").alias("gap_start"), F.col("g.b").alias("gap_end"))
    edges = periods.filter("size(starts) > 0").select(*names, "segment", F.get("starts", F.lit(0)).alias("low"), F.element_at("ends", -1).alias("high"))
    w = Window.partitionBy(*names).orderBy("segment")
    between = edges.select(*names, F.lag("high").over(w).alias("gap_start"), F.col("low").alias("gap_end")).filter("gap_start < gap_end")
    return within.unionByName(between).toDF(*entity, "gap_start", "gap_end")


def period_rows(periods: DataFrame, entity: Sequence[str]) -> DataFrame:
    """entity, period_start, period_end, with periods that meet at a cut between segments joined again."""
    names = [f"k{i}" for i in range(len(entity))]
    periods = periods.toDF(*names, "segment", "starts", "ends")
    exploded = periods.select(*names, "segment", F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "p"), F.size("starts").alias("n"))
    edge = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    w = Window.partitionBy(*names).orderBy("segment", "i")
    flat = exploded.select(*names, "segment", "i", F.col("p.starts").alias("s"), F.col("p.ends").alias("e"), edge.alias("edge"))
    middle = flat.filter(~F.col("edge")).select(*names, F.col("s").alias("period_start"), F.col("e").alias("period_end"))
    chain = flat.filter("edge").withColumn("fresh", (~F.coalesce(F.lag("e").over(w) >= F.col("s"), F.lit(False))).cast("int"))
    chain = chain.withColumn("run", F.sum("fresh").over(w))
    joined = chain.groupBy(*names, "run").agg(F.min("s").alias("period_start"), F.max("e").alias("period_end")).drop("run")
    return middle.unionByName(joined).toDF(*entity, "period_start", "period_end")


def base_periods(bases: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Sorted disjoint periods of log that base backups cover, per (surface_id, timeline), as biased longs."""
    rows = bases.select("surface_id", "timeline", lsn.biased(F.col("start_lsn")).alias("s"), lsn.biased(F.col("end_lsn")).alias("e"))
    return continuous_periods(rows, ["surface_id", "timeline"], "s", "e", segment_rows)


def base_gaps(bases: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(surface_id, timeline, gap_start, gap_end): every stretch between two periods that no base covers.

    Bases with a null or unreadable position, or that do not end after they start, cover nothing. Repeated rows change
    nothing; an empty table has no gaps.
    """
    found = gaps(base_periods(bases, segment_rows), ["surface_id", "timeline"])
    return found.select("surface_id", "timeline", lsn.shown(F.col("gap_start")).alias("gap_start"), lsn.shown(F.col("gap_end")).alias("gap_end"))
