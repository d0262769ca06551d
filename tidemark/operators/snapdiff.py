"""What changed between consecutive full snapshots of a table.

All snapshots of a series are range-partitioned by series and key, so that one range holds the same span of keys of
every snapshot, and sorted by series, key and snapshot, which is the merge of the snapshots' sorted rows. Two pointers,
at a row and at the row before it, walk that stream a batch at a time; columns are compared as arrays. A hot series
spreads over many ranges because its keys do; a task holds one batch and two rows more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import packed_hex, percent_decoded


def snapshot_order(rows: DataFrame, series: Sequence[str], snapshot: str, at: str, fallback: str) -> DataFrame:
    """series, snapshot, `ord`, `next`: each snapshot's place in its series and the snapshot after it.

    A snapshot's time is the greatest of its rows' `at`, or without any its least `fallback`; ties go by snapshot.
    """
    each = rows.groupBy(*series, snapshot).agg(F.coalesce(F.max(at), F.min(fallback)).alias("_at"))
    w = Window.partitionBy(*series).orderBy(F.col("_at").asc_nulls_last(), snapshot)
    return each.select(*series, snapshot, F.row_number().over(w).alias("ord"), F.lead(snapshot).over(w).alias("next"))


def _flags(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.int8())).astype(bool)


def _differs(column: pa.Array, at: np.ndarray, loose: bool = False) -> np.ndarray:
    """Whether the value at each place of `at` but the first differs from that at the place before; nulls are equal, or
    with `loose` equal to everything."""
    held = column.take(pa.array(at))
    a, b = held.slice(0, len(held) - 1), held.slice(1)
    different = _flags(pc.fill_null(pc.not_equal(a, b), False))
    if not loose and held.null_count:
        different |= _flags(pc.is_null(a)) != _flags(pc.is_null(b))
    return different


def _changes(snapshots: pa.Array, keys: pa.Array, change: str, which: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    if len(keys):
        lists = pa.nulls(len(keys), pa.list_(pa.int32())) if which is None else which
        yield pa.RecordBatch.from_arrays([snapshots, keys.cast(pa.string()), pa.array([change] * len(keys), pa.string()), lists], names=["snapshot", "key", "change", "which"])


def _walk(n_series: int, n_fields: int, loose: frozenset[int]):
    """Over rows of series, ord, snapshot, next snapshot, key and fields, sorted by series, key, ord and age. loose:
    fields in which a null differs from nothing."""

    def step(rows: pa.RecordBatch, kept: np.ndarray, same: np.ndarray, begins: bool, ends: bool) -> Iterator[pa.RecordBatch]:
        """Changes between neighbours of the kept rows, of the first if it begins the stream and after the last if it
        ends it. same: whether each row but the first has the series and key of the one before."""
        place = np.asarray(rows.column(n_series))
        take = lambda c, i: rows.column(n_series + c).take(pa.array(i))
        before, now = kept[:-1], kept[1:]
        next_to = same[before] & (place[now] == place[before] + 1)
        gone, new = before[~next_to], now[~next_to]
        if begins:
            new = np.append(kept[:1], new)
        if ends:
            gone = np.append(gone, kept[-1:])
        gone = gone[_flags(pc.is_valid(take(2, gone)))]
        new = new[place[new] > 1]
        yield from _changes(take(2, gone), take(3, gone), "removed")
        yield from _changes(take(1, new), take(3, new), "added")
        if n_fields and len(now):
            differ = np.stack([_differs(rows.column(n_series + 4 + f), kept, f in loose) for f in range(n_fields)]) & next_to
            at = np.flatnonzero(differ.any(axis=0))
            offsets = np.concatenate([[0], np.cumsum(differ[:, at].sum(axis=0))])
            which = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.nonzero(differ[:, at].T)[1].astype(np.int32)))
            yield from _changes(take(1, now[at]), take(3, now[at]), "changed", which)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins, held = True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held else batch
            every = np.arange(rows.num_rows)
            same = ~np.logical_or.reduce([_differs(c, every) for c in (*rows.columns[:n_series], rows.column(n_series + 3))])
            place = np.asarray(rows.column(n_series))
            # rows of a key and snapshot come oldest first, so the latest holds; a row may come after the last one yet
            kept = np.flatnonzero(np.append(~same | (place[1:] != place[:-1]), True))
            if len(kept) > 1:
                yield from step(rows, kept[:-1], same, begins, False)
                begins = False
            held = rows.take(pa.array(kept[-2:]))
        if held:
            every = np.arange(held.num_rows)
            same = ~np.logical_or.reduce([_differs(c, every) for c in (*held.columns[:n_series], held.column(n_series + 3))])
            yield from step(held, every, same, begins, True)

    return walk


def snapshot_changes(rows: DataFrame, series: Sequence[str], snapshot: str, at: str, key: Column, fields: dict[str, Column], recorded: str, loose: Sequence[str] = ()) -> DataFrame:
    """snapshot, key, change (added, removed, changed) and, for changed, the `fields` that differ.

    For each snapshot but the first of its series, against the one before. Of several rows of a key in one snapshot the
    latest `recorded` holds, ties settled by the greater fields. A field in `loose` does not differ from a null.
    Null keys and null snapshots are left out, but a snapshot of null keys only is one that lists nothing; null series
    form a series of their own; a table with one snapshot a series, or none, has no changes. The columns of `rows` may
    bear any names.
    """
    names = [f"s{i}" for i in range(len(series))]
    own = [F.col(c).alias(n) for c, n in zip(series, names, strict=True)]
    times = rows.select(*own, F.col(snapshot).alias("snap"), F.col(at).alias("at"), F.col(recorded).alias("rec")).filter("snap IS NOT NULL")
    order = snapshot_order(times, names, "snap", "at", "rec").select(*[F.col(n).alias(f"o_{n}") for n in names], F.col("snap").alias("o_snap"), "ord", "next")
    on = [F.col("snap") == F.col("o_snap"), *[F.col(n).eqNullSafe(F.col(f"o_{n}")) for n in names]]
    base = rows.select(*own, F.col(snapshot).cast("string").alias("snap"), F.encode(key, "utf-8").alias("key"), F.col(recorded).alias("rec"), *[c.alias(f"f{i}") for i, c in enumerate(fields.values())]).filter("key IS NOT NULL AND snap IS NOT NULL")
    placed = base.join(order, on).drop("o_snap", *[f"o_{n}" for n in names])
    ranged = placed.repartitionByRange(*names, "key").sortWithinPartitions(*names, "key", "ord", "rec", *[f"f{i}" for i in range(len(fields))])
    slim = ranged.select(*names, "ord", "snap", F.col("next").cast("string").alias("next"), "key", *[f"f{i}" for i in range(len(fields))])
    kinds = "snapshot string, key string, change string, which array<int>"
    walk = _walk(len(names), len(fields), frozenset(i for i, f in enumerate(fields) if f in loose))
    found = slim.mapInArrow(walk, kinds)
    labels = F.array(*[F.lit(f) for f in fields])
    return found.select("snapshot", "key", "change", F.transform("which", lambda i: F.get(labels, i)).alias("fields"))


def entry_changes(entries: DataFrame) -> DataFrame:
    """(snapshot_id, path, change, fields) over series of (surface_id, root), ordered by created_at.

    Paths are compared percent-decoded without a leading slash; null, empty and `-` values are the same and hex ones
    have no case; modes count by their lowest 12 bits and a null mode differs from nothing.
    """
    path = F.regexp_replace(percent_decoded(F.col("path")), "^/", "")
    known = lambda c: F.when((c != "") & (c != "-"), c)
    value = known(F.col("value"))
    value = F.when(value.rlike("^[0-9A-Fa-f]+$"), F.lower(value)).otherwise(value)
    fields = {"type": F.col("type"), "value": packed_hex(value), "mode": F.col("mode").bitwiseAND(4095), "target": known(F.col("target"))}
    found = snapshot_changes(entries.filter("path IS NOT NULL"), ["surface_id", "root"], "snapshot_id", "created_at", path, fields, "recorded_at", ["mode"])
    return found.select(F.col("snapshot").alias("snapshot_id"), F.col("key").alias("path"), "change", "fields")
